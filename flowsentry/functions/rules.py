"""Rule predicates and per-flow rule scoring.

The thresholds arrive as Python floats and enter the plan as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BRUTE_FORCE_PORTS, RULE_SLOTS, SUSPICIOUS_PROTOCOLS
from ..operators.thresholds import Thresholds


def _d(v: float) -> str:
    """A double literal for Spark SQL text (``repr`` round-trips exactly)."""
    return f"{float(v)!r}D"


def rule_sql(thr: Thresholds) -> dict[str, str]:
    """R1-R8 as Spark SQL text, one 0/1 expression per rule slot (a null predicate
    counts as not fired; one expression per column keeps plan building cheap).
    Flow-level ICMP sweep is off: sweeps are found by aggregation (D5)."""
    cfg = thr.cfg
    protos = ", ".join(f"'{p}'" for p in SUSPICIOUS_PROTOCOLS)
    ports = ", ".join(_d(p) for p in BRUTE_FORCE_PORTS)
    preds = {
        "flood_score": f"packets > {_d(cfg.flood_packets)}",
        "suspicious_protocol_score": f"upper(protocol) IN ({protos})",
        "ddos_score": f"packets_per_sec > {_d(thr.ddos_pps)} AND packets > {_d(thr.ddos_packets)}",
        "udp_flood_score": f"udp_ratio = 1.0D AND packets_per_sec > {_d(thr.udp_flood_pps)} "
                           f"AND packets > {_d(cfg.udp_flood_packets)}",
        "exfil_score": f"bytes > {_d(thr.exfil_bytes)} AND bytes_per_packet > {_d(thr.exfil_bpp)}",
        "brute_score": f"dst_port IN ({ports}) AND packets > {_d(thr.brute_packets)}",
        "large_flow_score": f"bytes > {_d(thr.large_flow_bytes)} AND flow_duration < {_d(cfg.large_flow_duration)}",
        "icmp_sweep_score": "false",
    }
    return {k: f"CASE WHEN {v} THEN 1 ELSE 0 END" for k, v in preds.items()}


def with_rule_scores(features: DataFrame, thr: Thresholds) -> DataFrame:
    """Flags, total, severity, label and confidence columns, plus
    ``rules_fired``: the fired rule names as a clean array (the label keeps
    the exact separator artefacts)."""
    cfg = thr.cfg
    flags = rule_sql(thr)
    df = features.selectExpr("*", *[f"{v} AS {k}" for k, v in flags.items()])
    total = " + ".join(name for name, _ in RULE_SLOTS)
    slots = ", ".join(f"CASE WHEN {name} > 0 THEN '{label}' ELSE '' END" for name, label in RULE_SLOTS)
    fired = ", ".join(f"CASE WHEN {name} > 0 THEN '{label}' END" for name, label in RULE_SLOTS)
    return df.selectExpr("*", f"{total} AS total_rule_score").selectExpr(
        "*",
        f"filter(array({fired}), x -> x IS NOT NULL) AS rules_fired",
        "CASE WHEN total_rule_score = 0 THEN CAST(NULL AS STRING) WHEN total_rule_score = 1 THEN 'HIGH' "
        "ELSE 'CONFIRMED' END AS rule_severity",
        f"CASE WHEN total_rule_score = 0 THEN CAST(NULL AS STRING) "
        f"ELSE btrim(replace(concat_ws(';', {slots}), ';;', ';'), ';') END AS rule_threat_type",
        f"CASE WHEN total_rule_score = 0 THEN 0.0D WHEN total_rule_score = 1 THEN {_d(cfg.one_rule_confidence)} "
        f"ELSE {_d(cfg.multi_rule_confidence)} END AS rule_confidence")


def rule_hit_count(scored: DataFrame) -> DataFrame:
    """Flows carrying a rule label."""
    return scored.agg(F.count_if(F.col("rule_threat_type").isNotNull()).alias("rule_hits"))
