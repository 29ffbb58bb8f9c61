"""Detection metrics (E1-E7) and IP-level accuracy against ground truth.

IP sets are distinct projections; membership is one left join of the truth
IPs against the detected IPs (both de-duplicated first, so a hot source is a
single row on each side), folded by conditional counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accuracy gate's floors
GATE = {"precision": 0.75, "recall": 0.60, "f1_score": 0.65}


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (never raises under ANSI)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def detection_metrics(stats: DataFrame, alerts: DataFrame, rounded: bool = True) -> DataFrame:
    """One row from the run record and the final alert list."""
    n_alerts = alerts.agg(F.count(F.lit(1)).alias("num_alerts"))
    base = stats.select("total_flows", "threats_detected",
                        *([F.col("processing_time_sec")] if "processing_time_sec" in stats.columns else []))
    row = base.unionByName(n_alerts, allowMissingColumns=True).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in base.columns + ["num_alerts"]])
    rate = F.when(F.col("total_flows") > 0, F.col("threats_detected") / F.col("total_flows") * 100).otherwise(0.0)
    agg_ratio = F.when(F.col("num_alerts") > 0, F.col("threats_detected") / F.col("num_alerts")).otherwise(0.0)
    cols = [F.round(rate, 2).alias("detection_rate_percent") if rounded else rate.alias("detection_rate_percent"),
            "threats_detected", "total_flows", F.col("num_alerts").cast("long").alias("num_alerts"),
            F.round(agg_ratio, 2).alias("aggregation_ratio") if rounded else agg_ratio.alias("aggregation_ratio")]
    if "processing_time_sec" in stats.columns:
        t = F.col("processing_time_sec")
        cols += [t, F.when(t > 0, F.round(F.col("total_flows") / t, 2)).otherwise(0.0)
                 .alias("throughput_flows_per_sec")]
    return row.select(*cols)


def severity_distribution(alerts: DataFrame, rounded: bool = True) -> DataFrame:
    """E3 + E6: count, mean confidence and share of alerts per severity."""
    sev = F.coalesce(F.col("severity"), F.lit("UNKNOWN"))
    g = alerts.groupBy(sev.alias("severity")).agg(F.count(F.lit(1)).alias("count"),
                                                 F.avg("confidence").alias("avg_confidence"))
    # window over the grouped rows only (one per severity): a handful of rows
    total = F.sum("count").over(_everything())
    out = g.withColumn("percent", F.col("count") / total * 100)
    if rounded:
        out = out.withColumn("avg_confidence", F.round("avg_confidence", 3))
    return out


def _everything():
    from pyspark.sql import Window
    return Window.partitionBy()


def threat_type_distribution(alerts: DataFrame) -> DataFrame:
    """E4."""
    t = F.coalesce(F.col("threat_type"), F.lit("UNKNOWN"))
    return alerts.groupBy(t.alias("threat_type")).agg(F.count(F.lit(1)).alias("count"))


def top_threat_types(alerts: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent types with their share of alerts."""
    d = threat_type_distribution(alerts)
    # the total comes from the grouped rows (one per threat type), not a second job
    return (d.withColumn("percent", F.col("count") / F.sum("count").over(_everything()) * 100)
            .orderBy(F.desc("count"), "threat_type").limit(k))


def label_ground_truth(labelled: DataFrame) -> DataFrame:
    """``benign`` when the label contains BENIGN, else ``threat`` (null too)."""
    return labelled.withColumn(
        "ground_truth",
        F.when(F.col("label").contains("BENIGN"), F.lit("benign")).otherwise(F.lit("threat")))


def ground_truth_counts(truth: DataFrame) -> DataFrame:
    """E9."""
    return truth.agg(F.count(F.lit(1)).alias("total_ground_truth"),
                     F.count_if(F.col("ground_truth") == "benign").alias("benign_count"),
                     F.count_if(F.col("ground_truth") == "threat").alias("threat_count"))


def detected_ips(alerts: DataFrame) -> DataFrame:
    """Distinct non-empty alert sources."""
    return (alerts.select("src_ip").where(F.col("src_ip").isNotNull() & (F.col("src_ip") != ""))
            .distinct())


def truth_ips(truth: DataFrame) -> DataFrame:
    """Distinct (class, src_ip); one address may sit in both classes."""
    return truth.select("ground_truth", "src_ip").distinct()


def ip_outcomes(truth: DataFrame, alerts: DataFrame) -> DataFrame:
    """E12 + E13 per IP: ``tp``/``fn`` for threat IPs, ``fp``/``tn`` for benign."""
    det = detected_ips(alerts).withColumn("detected", F.lit(True))
    j = truth_ips(truth).join(det, "src_ip", "left")
    hit = F.coalesce(F.col("detected"), F.lit(False))
    outcome = (F.when((F.col("ground_truth") == "threat") & hit, F.lit("tp"))
               .when(F.col("ground_truth") == "threat", F.lit("fn"))
               .when(hit, F.lit("fp")).otherwise(F.lit("tn")))
    return j.select("ground_truth", "src_ip", outcome.alias("outcome"))


def accuracy(truth: DataFrame, alerts: DataFrame, rounded: bool = True) -> DataFrame:
    """E9 + E14: counts, confusion matrix and rates (0 on empty denominators)."""
    o = ip_outcomes(truth, alerts).agg(
        F.count_if(F.col("ground_truth") == "threat").alias("unique_threat_ips"),
        F.count_if(F.col("ground_truth") == "benign").alias("unique_benign_ips"),
        F.count_if(F.col("outcome") == "tp").alias("true_positives"),
        F.count_if(F.col("outcome") == "fp").alias("false_positives"),
        F.count_if(F.col("outcome") == "tn").alias("true_negatives"),
        F.count_if(F.col("outcome") == "fn").alias("false_negatives"))
    counts = ground_truth_counts(truth)
    row = counts.unionByName(o, allowMissingColumns=True).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in counts.columns + o.columns])
    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    out = row.select("*", precision.alias("precision"), recall.alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    out = out.select(
        "*",
        F.when(p + r > 0, 2 * (p * r) / (p + r)).otherwise(0.0).alias("f1_score"),
        _ratio(tp + tn, F.col("unique_threat_ips") + F.col("unique_benign_ips")).alias("accuracy"),
        _ratio(fp, F.col("unique_benign_ips")).alias("false_positive_rate"),
        _ratio(fn, F.col("unique_threat_ips")).alias("false_negative_rate"))
    if rounded:
        for c in ("precision", "recall", "f1_score", "accuracy", "false_positive_rate", "false_negative_rate"):
            out = out.withColumn(c, F.round(c, 4))
    return out


def accuracy_gate(acc: DataFrame) -> DataFrame:
    """Pass only if every floor is met."""
    ok = F.lit(True)
    for k, floor in GATE.items():
        ok = ok & (F.col(k) >= F.lit(floor))
    return acc.select(*GATE.keys(), ok.alias("passed"))
