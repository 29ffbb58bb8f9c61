"""Calibration, cross-threat escalation and ranking (K1-K8).

Per-source facts (temporal flag, distinct threat types, highest severity) are
``groupBy`` aggregates joined back on ``src_ip`` rather than unordered window
partitions: the aggregate is partial before its shuffle, and the equi-join
lets AQE pick broadcast or split a skewed source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (DEFAULT_CONFIG, DEFAULT_EVIDENCE_PREFIX, ESCALATION_SUFFIX, SEVERITY_RANK,
                      DetectionConfig)
from ..functions.rounding import round2_sql

FINAL_COLUMNS = ("src_ip", "dst_ip", "threat_type", "protocol", "flow_count",
                 "confidence", "severity", "evidence")


def join_temporal(alerts: DataFrame, temporal: DataFrame) -> DataFrame:
    """K1: left join of the per-source temporal flag, default false; a null
    source is a source like any other."""
    flag = temporal.select(F.col("src_ip").alias("__src"), "temporal")
    return (alerts.join(flag, F.col("src_ip").eqNullSafe(F.col("__src")), "left").drop("__src")
            .withColumn("temporal", F.coalesce(F.col("temporal"), F.lit(False))))


# K2 as Spark SQL text: one expression per column keeps plan building cheap.
# ``D`` marks double literals (plain decimals would be DECIMAL in Spark SQL).
_RM = "(contains(threat_type, '(Rule + ML)') OR contains(threat_type, 'Aggregated'))"
_BRANCH = f"""CASE
  WHEN contains(threat_type, 'Port Scan') OR contains(threat_type, 'Horizontal Scan') THEN 1
  WHEN flow_count = 1 AND NOT {_RM} THEN 2
  WHEN {_RM} OR (temporal AND severity = 'CONFIRMED') THEN 3
  WHEN flow_count = 2 AND NOT temporal THEN 4
  WHEN severity = 'CONFIRMED' THEN 5
  WHEN severity = 'HIGH' THEN 6
  ELSE 7 END"""
_NEW_SEVERITY = """CASE WHEN branch IN (1, 3, 5) THEN 'CONFIRMED' WHEN branch = 4 THEN 'SUSPICIOUS'
  WHEN branch = 6 THEN 'HIGH' ELSE 'MONITOR' END"""
_CONF = """least(CASE
  WHEN branch = 1 THEN 0.85D + 0.14D * confidence
  WHEN branch = 2 THEN least(0.60D, greatest(0.40D, CASE
      WHEN confidence < 0.6D THEN 0.40D + 0.05D * (confidence / 0.6D)
      WHEN confidence < 0.8D THEN 0.45D + 0.10D * ((confidence - 0.6D) / 0.2D)
      ELSE 0.55D + 0.05D * ((confidence - 0.8D) / 0.2D) END))
  WHEN branch IN (3, 5) THEN 0.75D + 0.24D * confidence
  WHEN branch IN (4, 6) THEN 0.55D + 0.20D * confidence
  ELSE 0.40D + 0.20D * confidence END, 0.99D)"""
_RANK_SQL = ("CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_RANK.items())
             + " ELSE 0 END")
_NAME_SQL = ("CASE {c} " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in SEVERITY_RANK.items()) + " END")


def calibrate(alerts: DataFrame, temporal: DataFrame) -> DataFrame:
    """K2 + K3.  Adds ``branch`` (1..7), ``confidence_raw`` (capped at .99,
    unrounded) and ``confidence`` (``confidence_raw`` rounded to 2 places by its
    exact binary value)."""
    df = join_temporal(alerts, temporal).selectExpr("*", f"{_BRANCH} AS branch")
    prefix = DEFAULT_EVIDENCE_PREFIX.replace("'", "\\'")
    return df.selectExpr(
        "src_ip", "dst_ip", "threat_type", "protocol", "flow_count",
        f"{_NEW_SEVERITY} AS severity",
        f"{_CONF} AS confidence_raw",
        f"coalesce(nullif(evidence, ''), concat('{prefix}', threat_type)) AS evidence",
        "branch", "temporal").selectExpr("*", f"{round2_sql('confidence_raw')} AS confidence")


def per_source_profile(calibrated: DataFrame) -> DataFrame:
    """K4 + K5: distinct threat types and highest severity rank per source.
    The set of types per source is bounded by the number of possible labels
    (rule combinations, the ML suffix, four detector names), so a set-valued
    partial aggregate is safe and needs one shuffle instead of two."""
    return calibrated.groupBy("src_ip").agg(
        F.expr("size(collect_set(threat_type))").alias("threat_types"),
        F.expr(f"max({_RANK_SQL.format(c='severity')})").alias("max_rank"))


def escalate(calibrated: DataFrame) -> DataFrame:
    """K6: sources with >= 2 threat types lift every lower alert to their
    highest severity, +0.10 confidence (capped, not re-rounded) and a suffix.
    Adds ``escalated`` (K7 counts it)."""
    prof = per_source_profile(calibrated)
    top = _NAME_SQL.format(c="max_rank")
    prof = prof.withColumnRenamed("src_ip", "__src")
    lifted = calibrated.join(prof, F.col("src_ip").eqNullSafe(F.col("__src")), "left").drop("__src").selectExpr(
        "*", f"coalesce(threat_types >= 2 AND severity <> {top}, false) AS lift", f"{top} AS top")
    return lifted.selectExpr(
        "src_ip", "dst_ip", "threat_type", "protocol", "flow_count",
        "CASE WHEN lift THEN least(0.99D, confidence + 0.10D) ELSE confidence END AS confidence",
        "CASE WHEN lift THEN least(0.99D, confidence_raw + 0.10D) ELSE confidence_raw END AS confidence_raw",
        "CASE WHEN lift THEN top ELSE severity END AS severity",
        f"CASE WHEN lift THEN concat(evidence, '{ESCALATION_SUFFIX}') ELSE evidence END AS evidence",
        "lift AS escalated", "branch")


def escalated_count(escalated: DataFrame) -> DataFrame:
    """K7."""
    return escalated.agg(F.count_if("escalated").alias("escalated_count"))


def rank_alerts(escalated: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG) -> DataFrame:
    """K8: severity rank, then confidence, descending; the first ``max_alerts``.
    Ties are broken on the remaining columns so the cut is deterministic.
    Planned as TakeOrderedAndProject: each task keeps its own top 1000."""
    return (escalated
            .selectExpr("*", f"{_RANK_SQL.format(c='severity')} AS severity_rank")
            .orderBy(F.desc("severity_rank"), F.desc("confidence"), F.desc("confidence_raw"),
                     "src_ip", "dst_ip", "threat_type", "protocol", "flow_count", "evidence")
            .limit(cfg.max_alerts)
            .drop("severity_rank"))
