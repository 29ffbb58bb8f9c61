"""Per-flow features (P1-P9) as Column expressions.

All are narrow, JVM-side expressions: they stay inside whole-stage codegen and
never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COMMON_HIGH_PORTS, DEFAULT_CONFIG, FEATURE_COLUMNS, DetectionConfig


def _zero_if_missing(c: Column) -> Column:
    """NaN and null to 0.0."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def raw_duration() -> Column:
    return F.col("end_time") - F.col("start_time")


def flow_duration(cfg: DetectionConfig = DEFAULT_CONFIG) -> Column:
    raw = raw_duration()
    return F.when(raw <= 0, F.lit(cfg.min_duration)).otherwise(raw)


def bytes_per_packet() -> Column:
    denom = F.when(F.col("packets") == 0, F.lit(1.0)).otherwise(F.col("packets"))
    return _zero_if_missing(F.try_divide(F.col("bytes"), denom))


def packets_per_sec_raw(duration: Column) -> Column:
    return _zero_if_missing(F.try_divide(F.col("packets"), duration))


def is_udp(protocol: Column) -> Column:
    return (F.upper(protocol) == "UDP") | (protocol == "17")


def udp_ratio() -> Column:
    return F.when(is_udp(F.col("protocol")), F.lit(1.0)).otherwise(F.lit(0.0))


def dst_port_flag() -> Column:
    high = (F.col("dst_port") > 1024) & ~F.col("dst_port").isin(*[float(p) for p in COMMON_HIGH_PORTS])
    return F.when(high, F.lit(1.0)).otherwise(F.lit(0.0))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def with_features(flows: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG) -> DataFrame:
    """Adds raw_duration, flow_duration, bytes_per_packet, packets_per_sec_raw,
    udp_ratio, dst_port_flag and packets_per_sec (P1-P7)."""
    return (
        flows
        .withColumn("raw_duration", raw_duration())
        .withColumn("flow_duration", flow_duration(cfg))
        .withColumn("bytes_per_packet", bytes_per_packet())
        .withColumn("packets_per_sec_raw", packets_per_sec_raw(F.col("flow_duration")))
        .withColumn("udp_ratio", udp_ratio())
        .withColumn("dst_port_flag", dst_port_flag())
        .withColumn("packets_per_sec", clip(F.col("packets_per_sec_raw"), 0.0, cfg.pps_clip))
    )


def sanitize(c: Column, cfg: DetectionConfig = DEFAULT_CONFIG) -> Column:
    """null/NaN to 0, +inf to 1e9, -inf to -1e9."""
    return (F.when(c.isNull() | F.isnan(c), F.lit(0.0))
            .when(c == F.lit(float("inf")), F.lit(cfg.posinf))
            .when(c == F.lit(float("-inf")), F.lit(cfg.neginf))
            .otherwise(c))


def feature_vector(df: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG,
                   keep: tuple = ("row_id",)) -> DataFrame:
    """P8 + P9: the 8 model features, sanitised, in their fixed order."""
    return df.select(*keep, *[sanitize(F.col(c), cfg).alias(c) for c in FEATURE_COLUMNS])
