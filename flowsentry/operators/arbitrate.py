"""Per-flow arbitration of rule and model verdicts.

``ml_score`` (0..1, high = anomalous) and ``ml_label`` (0/1) are ordinary
columns of the same plan.  Without model output both are constant (score 0,
label 0), which is how the shipped behaviour looks: no flow is ever labelled
an outlier there, so every ``ml_*`` branch below stays dormant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, EVIDENCE_TEXTS, ML_ONLY_TYPE, RULE_ML_SUFFIX, DetectionConfig


# evidence codes of the M10 cascade, in cascade order (0 = not labelled)
EVIDENCE_BY_CODE = {
    0: "",
    1: EVIDENCE_TEXTS["packets"] + "; " + EVIDENCE_TEXTS["bytes"],
    2: EVIDENCE_TEXTS["packets"],
    3: EVIDENCE_TEXTS["bytes"],
    4: EVIDENCE_TEXTS["packets_per_sec"],
    5: EVIDENCE_TEXTS["bytes_per_packet"],
    6: EVIDENCE_TEXTS["flow_duration"],
    7: EVIDENCE_TEXTS["fallback"],
}


def evidence_text(code: Column) -> Column:
    """Text of an M10 evidence code."""
    out = F.lit(None).cast("string")
    for k, v in EVIDENCE_BY_CODE.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def _d(v: float) -> str:
    return f"{float(v)!r}D"


def ml_evidence_code_sql(moments: dict | None) -> str:
    """M10 as a small integer (Spark SQL text): first-match cascade on
    ``feature > mean + 2*std`` of all rows (``moments`` maps feature -> (mean,
    std)).  An integer keeps "first evidence per group" a hash-aggregatable
    ``min_by``."""
    if not moments:
        return "CASE WHEN ml_label = 1 THEN 7 ELSE 0 END"

    def high(c):
        m, s = moments[c]
        return f"{c} > {_d(m + 2 * s)}"

    m, s = moments["flow_duration"]
    return (f"CASE WHEN NOT (ml_label = 1) THEN 0 "
            f"WHEN {high('packets')} THEN CASE WHEN {high('bytes')} THEN 1 ELSE 2 END "
            f"WHEN {high('bytes')} THEN 3 WHEN {high('packets_per_sec')} THEN 4 "
            f"WHEN {high('bytes_per_packet')} THEN 5 WHEN flow_duration < {_d(m - 2 * s)} THEN 6 ELSE 7 END")


def evidence_text_sql(code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in EVIDENCE_BY_CODE.items()) + " END"


def arbitrate(scored: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG,
              moments: dict | None = None) -> DataFrame:
    """B1-B4 on rule-scored flows.  Adds ``ml_score``/``ml_label`` (0) when the
    frame has none, then ``ml_evidence_code``, ``ml_evidence``,
    ``ml_confidence``, ``threat_type``, ``severity`` and ``confidence``
    (Spark SQL text: one expression per column)."""
    missing = [e for c, e in (("ml_score", "0.0D AS ml_score"), ("ml_label", "0 AS ml_label"))
               if c not in scored.columns]
    df = scored.selectExpr("*", *missing) if missing else scored
    df = df.selectExpr("*", f"{ml_evidence_code_sql(moments)} AS ml_evidence_code")
    df = df.selectExpr("*", f"{evidence_text_sql('ml_evidence_code')} AS ml_evidence",
                       "CASE WHEN ml_label = 1 THEN 0.5D + 0.4D * ml_score ELSE 0.0D END AS ml_confidence")
    rule, both = "rule_threat_type IS NOT NULL", "rule_threat_type IS NOT NULL AND ml_label = 1"
    return df.selectExpr(
        "*",
        f"CASE WHEN {both} THEN concat(rule_threat_type, '{RULE_ML_SUFFIX}') WHEN {rule} THEN rule_threat_type "
        f"WHEN ml_label = 1 AND ml_score > {_d(cfg.ml_type_score)} THEN '{ML_ONLY_TYPE}' END AS threat_type",
        f"CASE WHEN rule_severity = 'CONFIRMED' OR (ml_label = 1 AND ml_score > {_d(cfg.ml_confirmed_score)}) "
        f"THEN 'CONFIRMED' WHEN rule_severity = 'HIGH' OR (ml_label = 1 AND ml_score > {_d(cfg.ml_type_score)}) "
        f"THEN 'HIGH' ELSE 'MONITOR' END AS severity",
        f"least(greatest(CASE WHEN {both} THEN rule_confidence + (1.0D - rule_confidence) * ml_confidence * 0.5D "
        f"WHEN {rule} THEN rule_confidence WHEN ml_label = 1 THEN ml_confidence ELSE 0.0D END, 0.0D), 1.0D) "
        f"AS confidence")


def threat_flows(arbitrated: DataFrame) -> DataFrame:
    """B5."""
    return arbitrated.where(F.col("threat_type").isNotNull())
