"""Alert search and derived views (Q1-Q13).

Values are compared as text; nothing is interpreted as a pattern.  Q1 and Q2
compare without case: where the frame holds the upper-case texts that the
ledger stores (``severity_key``, ``protocol_key``) they are equalities on these
columns, which reach the parquet scan as Q3 does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import binned_counts


def severity_is(value: str) -> Column:
    """Q1: case-insensitive equality."""
    return F.upper(F.coalesce(F.col("severity"), F.lit(""))) == F.lit(value.upper())


def protocol_is(value: str) -> Column:
    """Q2: case-insensitive equality, null protocol as ''."""
    return F.upper(F.coalesce(F.col("protocol"), F.lit(""))) == F.lit(value.upper())


def threat_type_is(value: str) -> Column:
    """Q3: exact equality, null threat type as ''."""
    return F.col("threat_type") == value if value else F.coalesce(F.col("threat_type"), F.lit("")) == ""


def ip_contains(term: str) -> Column:
    """Q4: the trimmed term as a substring of the source or destination."""
    t = F.lit(term.strip())
    return (F.coalesce(F.col("src_ip"), F.lit("")).contains(t)
            | F.coalesce(F.col("dst_ip"), F.lit("")).contains(t))


def search_alerts(alerts: DataFrame, severity: str = "", protocol: str = "",
                  threat_type: str = "", ip: str = "") -> DataFrame:
    """Q5: AND of Q1-Q4; an empty filter passes everything."""
    out = alerts
    for column, value, test in (("severity", severity, severity_is), ("protocol", protocol, protocol_is)):
        if value:
            stored = f"{column}_key"
            out = out.where(F.col(stored) == value.upper() if stored in alerts.columns else test(value))
    if threat_type:
        out = out.where(threat_type_is(threat_type))
    if ip:
        out = out.where(ip_contains(ip))
    return out


def distinct_protocols(alerts: DataFrame, protocol_dist: DataFrame | None = None) -> DataFrame:
    """Q6: distinct upper-case alert protocols, UNION the names in the run's
    protocol distribution (long form, column ``protocol``)."""
    p = F.upper(F.coalesce(F.col("protocol"), F.lit("")))
    out = alerts.select(p.alias("protocol")).where(F.col("protocol") != "")
    if protocol_dist is not None:
        out = out.union(protocol_dist.select(F.upper(F.col("protocol")).alias("protocol")))
    return out.distinct()


def distinct_threat_types(alerts: DataFrame) -> DataFrame:
    """Q7."""
    return (alerts.select("threat_type")
            .where(F.col("threat_type").isNotNull() & (F.col("threat_type") != "")).distinct())


def confidence_histogram(alerts: DataFrame, bins: int = 20) -> DataFrame:
    """Q8: bins of width 0.05 over the alerts' confidence (null as 0),
    ``min(floor(c / 0.05), 19)``, zero-filled."""
    width = 1.0 / bins
    c = F.coalesce(F.col("confidence"), F.lit(0.0))
    idx = F.least(F.floor(c / F.lit(width)).cast("int"), F.lit(bins - 1))
    return (binned_counts(alerts, idx, bins)
            .select("bin",
                    F.round(F.col("bin").cast("double") * F.lit(width), 2).alias("bin_start"),
                    F.round((F.col("bin") + 1).cast("double") * F.lit(width), 2).alias("bin_end"),
                    "count"))


def scaled_timeline(timeline: DataFrame, shown: int, total: int) -> DataFrame:
    """Q9: timeline counts scaled by the filtered share, rounded half up."""
    ratio = shown / total if total > 0 else 0.0
    return timeline.withColumn("threat_count",
                               F.floor(F.col("threat_count") * F.lit(ratio) + F.lit(0.5)).cast("long"))


def explode_dst_ips(alerts: DataFrame) -> DataFrame:
    """Q10: one row per listed destination (comma split, trimmed, empties dropped)."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col("dst_ip"), F.lit("")), ","), lambda x: F.trim(x)),
                     lambda x: x != "")
    return alerts.select("src_ip", "threat_type", F.posexplode(parts).alias("position", "destination"))


def dst_ip_preview(alerts: DataFrame, shown: int = 3) -> DataFrame:
    """Q11: the first three destinations and how many more there are."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col("dst_ip"), F.lit("")), ","), lambda x: F.trim(x)),
                     lambda x: x != "")
    return alerts.select("src_ip", "threat_type",
                         F.slice(parts, 1, shown).alias("preview"),
                         F.greatest(F.size(parts) - shown, F.lit(0)).alias("more"))


def protocol_split(stats: DataFrame) -> DataFrame:
    """Q12: the run record's protocol map as (name, value) rows."""
    return stats.select(F.explode("protocol_distribution").alias("name", "value"))


def filtered_count(filtered: DataFrame, alerts: DataFrame) -> DataFrame:
    """Q13: shown and total alert counts, one row."""
    a = filtered.agg(F.count(F.lit(1)).alias("shown"))
    b = alerts.agg(F.count(F.lit(1)).alias("total"))
    return a.unionByName(b, allowMissingColumns=True).agg(
        F.first("shown", ignorenulls=True).alias("shown"), F.first("total", ignorenulls=True).alias("total"))
