"""Summary statistics and chart tables.

All are aggregates with partial aggregation; the one-row run record comes
from one GROUPING SETS aggregate over counts per group, folded into a row.  Chart bins are zero-filled by a union with one zero row per bin
(a frame sized by the bin count) and a sum - no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, DetectionConfig


def threats_detected(arbitrated: DataFrame) -> DataFrame:
    """A1 + A2."""
    return arbitrated.agg(F.count(F.lit(1)).alias("total_flows"),
                          F.count_if(F.col("threat_type").isNotNull()).alias("threats_detected"))


def protocol_counts(flows: DataFrame) -> DataFrame:
    """A3: raw protocol values and their counts (order by ``count`` desc to display)."""
    return flows.groupBy("protocol").agg(F.count(F.lit(1)).alias("count"))


def _protocol_key() -> Column:
    return F.coalesce(F.upper(F.col("protocol")), F.lit("NONE"))


def protocol_distribution(flows: DataFrame) -> DataFrame:
    """A4 in long form: counts folded by ``str(protocol).upper()``."""
    return flows.groupBy(_protocol_key().alias("protocol")).agg(F.count(F.lit(1)).alias("count"))


def protocol_distribution_map(flows: DataFrame) -> DataFrame:
    """A4 as the one-row ``MAP<STRING,BIGINT>`` of the run record.  The map
    holds one entry per distinct protocol name, which is what the record
    carries; it is built from the already-folded counts."""
    return (protocol_distribution(flows)
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("protocol", "count"))))
                 .alias("protocol_distribution")))


def _top_by(threats: DataFrame, key: str, out_key: str, out_count: str) -> DataFrame:
    """Most frequent value of ``key`` among threat flows; ties go to the
    smallest value.  ``min(struct(-count, key))`` picks it without a sort."""
    counts = threats.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(key).alias("k"))).alias("b"))
    return best.select(F.col("b.k").alias(out_key), (-F.col("b.neg")).alias(out_count))


def top_attacker(threats: DataFrame) -> DataFrame:
    """A5 (``N/A``/0 is filled in by :func:`run_stats`)."""
    return _top_by(threats, "src_ip", "top_attacker_ip", "top_attacker_count")


def top_threat_type(threats: DataFrame) -> DataFrame:
    """A6."""
    return _top_by(threats, "threat_type", "top_threat_type", "top_threat_count")


def run_stats(arbitrated: DataFrame, processing_time_sec: float | None = None,
              with_map: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """The one-row record.  The flows are first counted by (source, threat
    type, protocol name), the source only for threats, so all others fold into
    one group per protocol; or ``groups`` (``detect.flow_groups``) is taken,
    which holds these counts already.  The GROUPING SETS over (src_ip),
    (threat_type), (protocol name) and () expand only that small table.  Top
    values take the largest count, ties to the smallest key."""
    source = F.when(F.col("threat_type").isNotNull(), F.col("src_ip")).alias("src_ip")
    if groups is None:
        keyed = arbitrated.groupBy(source, "threat_type", _protocol_key().alias("proto")).agg(F.count(F.lit(1)).alias("n"))
    else:
        keyed = groups.groupBy(source, "threat_type", _protocol_key().alias("proto")).agg(F.sum("flow_count").alias("n"))
    sets = keyed.sparkSession.sql(
        "SELECT grouping_id() AS gid, src_ip, threat_type, proto, sum(n) AS n, "
        "coalesce(sum(n) FILTER (WHERE threat_type IS NOT NULL), 0) AS nt FROM {t} "
        "GROUP BY GROUPING SETS ((src_ip), (threat_type), (proto), ())", t=keyed)
    # grouping_id bits follow (src_ip, threat_type, proto): 3 = by source,
    # 5 = by type, 6 = by protocol, 7 = grand total
    folds = [
        "max(n) FILTER (WHERE gid = 7) AS total_flows",
        "max(nt) FILTER (WHERE gid = 7) AS threats_detected",
        "min(named_struct('neg', -nt, 'k', src_ip)) FILTER (WHERE gid = 3 AND nt > 0) AS a",
        "min(named_struct('neg', -n, 'k', threat_type)) FILTER (WHERE gid = 5 AND threat_type IS NOT NULL) AS t",
    ]
    if with_map:
        folds.append("map_from_entries(array_sort(collect_list(named_struct('protocol', proto, 'count', n)) "
                     "FILTER (WHERE gid = 6))) AS protocol_distribution")
    row = sets.selectExpr("*").agg(*[F.expr(f) for f in folds])
    out = row.select(
        F.coalesce("total_flows", F.lit(0)).cast("long").alias("total_flows"),
        F.coalesce("threats_detected", F.lit(0)).cast("long").alias("threats_detected"),
        F.coalesce(F.col("a.k"), F.lit("N/A")).alias("top_attacker_ip"),
        F.coalesce(-F.col("a.neg"), F.lit(0)).cast("long").alias("top_attacker_count"),
        F.coalesce(F.col("t.k"), F.lit("N/A")).alias("top_threat_type"),
        F.coalesce(-F.col("t.neg"), F.lit(0)).cast("long").alias("top_threat_count"),
        *(["protocol_distribution"] if with_map else []))
    if processing_time_sec is not None:
        out = out.withColumn("processing_time_sec", F.round(F.lit(float(processing_time_sec)), 3))
    return out


def histogram_bin(c: Column, bins: int = 20) -> Column:
    """Bin of ``c`` on [0, 1] with edges ``i / bins`` computed as ``i * (1/bins)``
    (how evenly spaced edges are generated), last bin closed; values outside
    [0, 1] or NaN get null.  Matches comparing against the stored edges."""
    step = 1.0 / bins
    raw = F.least(F.floor(c * bins).cast("int"), F.lit(bins - 1))
    lower = raw.cast("double") * F.lit(step)
    upper = F.when(raw + 1 == bins, F.lit(1.0)).otherwise((raw + 1).cast("double") * F.lit(step))
    adj = (F.when(c < lower, raw - 1)
           .when((raw < bins - 1) & (c >= upper), raw + 1)
           .otherwise(raw))
    return F.when((c >= 0.0) & (c <= 1.0) & ~F.isnan(c), adj)


def binned_counts(df: DataFrame, bin_col: Column, bins: int) -> DataFrame:
    """Zero-filled counts per bin: a partial-aggregated count per bin, unioned
    with one zero row per bin (``spark.range(bins)``) and summed - no join."""
    counts = (df.select(bin_col.alias("bin")).where(F.col("bin").isNotNull())
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    zeros = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("count"))
    return counts.unionByName(zeros).groupBy("bin").agg(F.sum("count").alias("count"))


def score_histogram(scored: DataFrame, column: str = "ml_score", bins: int = 20) -> DataFrame:
    """20 equal bins on [0, 1], zero-filled; ``bin_start``/``bin_end``
    rounded to 2 places."""
    step = 1.0 / bins
    return (binned_counts(scored, histogram_bin(F.col(column), bins), bins)
            .select("bin",
                    F.round(F.col("bin").cast("double") * F.lit(step), 2).alias("bin_start"),
                    F.round(F.when(F.col("bin") + 1 == bins, F.lit(1.0))
                            .otherwise((F.col("bin") + 1).cast("double") * F.lit(step)), 2).alias("bin_end"),
                    "count"))


def _py_round1_text(c: Column) -> Column:
    """``str(round(x, 1))`` for moderate x."""
    r = F.round(c, 1)
    whole = r == F.floor(r)
    return F.when(whole & (F.abs(r) < 1e16), F.concat(r.cast("long").cast("string"), F.lit(".0"))) \
            .otherwise(r.cast("string"))


def time_range(threats: DataFrame) -> tuple:
    """Min and max of finite, non-null threat ``start_time`` (two scalars)."""
    t = F.col("start_time")
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) != F.lit(float("inf")))
    row = threats.where(finite).agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    return (None, None) if row is None or row["lo"] is None else (float(row["lo"]), float(row["hi"]))


def grouped_time_range(groups: DataFrame) -> tuple:
    """:func:`time_range` from the D1 groups."""
    row = groups.where(F.col("threat_type").isNotNull()).agg(F.min("first_finite").alias("lo"), F.max("last_finite").alias("hi")).first()
    return (None, None) if row["lo"] is None else (float(row["lo"]), float(row["hi"]))


def threats_over_time(threats: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG,
                      bounds: tuple | None = None) -> DataFrame:
    """A9 + A10: 30 equal-width bins over [min, max] of threat start times,
    zero-filled, labelled by bin centre (UTC ``HH:mm:ss`` for epoch times,
    ``T+<x>s`` otherwise); one ``N/A`` row when there is nothing to bin."""
    spark = threats.sparkSession
    lo, hi = bounds if bounds is not None else time_range(threats)
    if lo is None:
        return spark.createDataFrame([("N/A", 0)], "time string, threat_count bigint").withColumn(
            "bin", F.lit(0))
    bins = cfg.timeline_bins
    span = hi - lo
    if span <= 0:
        span = 1.0
    width = span / bins
    t = F.col("start_time")
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) != F.lit(float("inf")))
    idx = F.least(F.greatest(F.floor((t - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(0)), F.lit(bins - 1))
    counts = binned_counts(threats.where(finite), idx, bins)
    centre = F.lit(lo) + (F.col("bin").cast("double") + 0.5) * F.lit(width)
    if lo > 1e9:
        label = F.date_format(F.timestamp_seconds(centre), "HH:mm:ss")
    else:
        label = F.concat(F.lit("T+"), _py_round1_text(centre - F.lit(lo)), F.lit("s"))
    return counts.select("bin", label.alias("time"), F.col("count").alias("threat_count"))


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    """A11."""
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))
