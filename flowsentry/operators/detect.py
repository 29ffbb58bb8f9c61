"""Alert-raising aggregations.

Every detector is a ``groupBy`` with partial (map-side) aggregation, so a hot
key is collapsed to one row per map task before the shuffle.  D2-D5 start from
one aggregate keyed by ``(src_ip, dst_ip)``, which ``analyze()`` writes once.
Destination lists (D3-D5) are collected only for sources that already passed
their count test, from the de-duplicated pairs, so the only per-group array is
the output itself.

"First" values follow file order.  The protocol of a group's first flow travels
as the 64-bit hash of its upper-case name (fixed width, so the aggregates stay
hash aggregates) and is looked up among the distinct names of the flows, a
handful of rows.  Distinct counts take a null as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import fixed1
from .arbitrate import evidence_text
from ..config import (BOTNET_EVIDENCE, BOTNET_TYPE, DEFAULT_CONFIG, HORIZONTAL_SCAN_EVIDENCE, HORIZONTAL_SCAN_TYPE,
                      ICMP_SWEEP_EVIDENCE, ICMP_SWEEP_TYPE, PORT_SCAN_EVIDENCE, PORT_SCAN_TYPE, DetectionConfig)

ALERT_COLUMNS = ("src_ip", "dst_ip", "threat_type", "severity", "protocol",
                 "flow_count", "confidence", "evidence")


def _upper_text(c: Column) -> Column:
    """``str(value).upper()``: null prints as NONE."""
    return F.coalesce(F.upper(c), F.lit("NONE"))


def _nulls_as_one(distinct_non_null: Column, any_null: Column) -> Column:
    return distinct_non_null + F.when(any_null, F.lit(1)).otherwise(F.lit(0))


def _py_float_text(c: Column) -> Column:
    """Python's ``str(float)`` for the common cases: whole values below 1e16
    print as ``<int>.0``; others use Spark's shortest repr."""
    whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e16))
    return F.when(whole, F.concat(c.cast("long").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def _group_facts() -> list[Column]:
    t = F.col("start_time")
    finite = F.when(~F.isnan(t) & (F.abs(t) != F.lit(float("inf"))), t)
    return [F.count(F.lit(1)).alias("flow_count"),
            F.max("confidence").alias("confidence"),
            F.min_by("ml_evidence_code", "row_id").alias("evidence_code"),
            F.min("start_time").alias("first_seen"),
            F.max("start_time").alias("last_seen"),
            F.min(finite).alias("first_finite"), F.max(finite).alias("last_finite")]


def threat_groups(threats: DataFrame) -> DataFrame:
    """The D1 aggregate, with each group's first and last start time so that
    D6 and the timeline's range can be rolled up from it instead of re-reading
    the threat flows."""
    return threats.groupBy("src_ip", "dst_ip", "threat_type", "severity", "protocol").agg(*_group_facts())


def flow_groups(arbitrated: DataFrame) -> DataFrame:
    """The D1 groups of the threat flows, and of all other flows one group per
    protocol (no source, destination, type or severity): one pass over the
    flows from which D1, D6, the run record and the timeline's range follow."""
    threat = F.col("threat_type").isNotNull()
    keys = [F.when(threat, F.col(c)).alias(c) for c in ("src_ip", "dst_ip", "threat_type", "severity")]
    return arbitrated.groupBy(*keys, "protocol").agg(*_group_facts())


def dedup_flow_alerts(threats: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Threat flows grouped by (src, dst, type, severity, protocol); the
    evidence of the group's first flow travels as its integer code."""
    groups = threat_groups(threats) if groups is None else groups
    return (groups.withColumn("evidence", evidence_text(F.col("evidence_code")))
            .select(*ALERT_COLUMNS))


def _protocol_code(name: Column) -> Column:
    return F.xxhash64(name)


def protocol_names(flows: DataFrame) -> DataFrame:
    """The distinct upper-case protocol names with their codes."""
    return (flows.select(_upper_text(F.col("protocol")).alias("protocol")).distinct()
            .withColumn("protocol_code", _protocol_code(F.col("protocol"))))


def with_protocol(rows: DataFrame, flows: DataFrame) -> DataFrame:
    """The eight alert columns of detector rows that carry ``protocol_code``."""
    return rows.join(protocol_names(flows), "protocol_code").select(*ALERT_COLUMNS)


def _is_icmp() -> Column:
    return F.upper(F.col("protocol")) == "ICMP"


def pair_summary(flows: DataFrame) -> DataFrame:
    """One row per (src_ip, dst_ip): the shared input of D2-D5."""
    icmp = _is_icmp()
    return (flows.groupBy("src_ip", "dst_ip")
            .agg(F.count(F.lit(1)).alias("pair_flows"),
                 F.count_distinct("dst_port").alias("ports_non_null"),
                 F.max(F.col("dst_port").isNull()).alias("port_null"),
                 F.avg("packets").alias("avg_packets"),
                 F.min("row_id").alias("first_row"),
                 F.min_by(_protocol_code(_upper_text(F.col("protocol"))), "row_id").alias("protocol_code"),
                 F.count_if(icmp).alias("icmp_flows"),
                 F.sum(F.when(icmp, F.col("packets"))).alias("icmp_packets")))


def port_scan_rows(pairs: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG) -> DataFrame:
    """D2 before the protocol lookup."""
    n = F.col("unique_ports")
    ports = _nulls_as_one(F.col("ports_non_null"), F.col("port_null"))
    return (pairs.withColumn("unique_ports", ports)
            .where((n >= cfg.port_scan_min_ports) & (F.col("avg_packets") < cfg.port_scan_max_avg_packets))
            .select("src_ip", "dst_ip",
                    F.lit(PORT_SCAN_TYPE).alias("threat_type"),
                    F.when(n > cfg.port_scan_high_ports, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
                    "protocol_code",
                    n.cast("long").alias("flow_count"),
                    F.least(F.lit(0.99), 0.5 + 0.01 * n).alias("confidence"),
                    F.format_string(PORT_SCAN_EVIDENCE, n.cast("string"),
                                    fixed1(F.col("avg_packets"), cfg.port_scan_max_avg_packets)).alias("evidence")))


def detect_port_scan(pairs: DataFrame, flows: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG) -> DataFrame:
    """>= 5 distinct destination ports and average packets < 5 per pair."""
    return with_protocol(port_scan_rows(pairs, cfg), flows)


def source_summary(pairs: DataFrame) -> DataFrame:
    """One row per src_ip from the pair rows: flows, distinct destinations
    (null counted once), the protocol of the source's first flow, and the
    same for its ICMP flows only."""
    icmp_pair = F.col("icmp_flows") > 0
    return (pairs.groupBy("src_ip")
            .agg(F.sum("pair_flows").alias("src_flows"),
                 F.count("dst_ip").alias("dst_non_null"),
                 F.max(F.col("dst_ip").isNull()).alias("dst_null"),
                 F.min_by("protocol_code", "first_row").alias("protocol_code"),
                 F.count_if(icmp_pair & F.col("dst_ip").isNotNull()).alias("icmp_dst_non_null"),
                 F.max(icmp_pair & F.col("dst_ip").isNull()).alias("icmp_dst_null"),
                 F.sum("icmp_packets").alias("icmp_packets"))
            .withColumn("unique_dsts", _nulls_as_one(F.col("dst_non_null"), F.col("dst_null")))
            .withColumn("icmp_unique_dsts", _nulls_as_one(F.col("icmp_dst_non_null"), F.col("icmp_dst_null"))))


def horizontal_threshold(n_rows: int, cfg: DetectionConfig = DEFAULT_CONFIG) -> int:
    return max(cfg.horizontal_min_dsts, int(n_rows * cfg.horizontal_share))


def _horizontal_hit(n_rows: int, cfg: DetectionConfig) -> Column:
    return F.col("unique_dsts") >= horizontal_threshold(n_rows, cfg)


def _botnet_hit(cfg: DetectionConfig) -> Column:
    return (F.col("src_flows") > cfg.botnet_min_flows) & (F.col("unique_dsts") > cfg.botnet_min_dsts)


def _icmp_hit(cfg: DetectionConfig) -> Column:
    return F.col("icmp_unique_dsts") >= cfg.icmp_min_dsts


_SOURCE_FACTS = ("src_flows", "unique_dsts", "icmp_unique_dsts", "icmp_packets", "protocol_code")


def flagged_sources(pairs: DataFrame, n_rows: int, cfg: DetectionConfig = DEFAULT_CONFIG) -> DataFrame:
    """Sources flagged by D3, D4 or D5 with their counts and their sorted,
    comma-joined destinations: all (``dst_list``) and those reached over ICMP
    (``icmp_dst_list``), put together from parts.  The flagged sources are joined to their own pair rows
    once; null is a source like any other and is left out of the lists."""
    hits = (source_summary(pairs).where(_horizontal_hit(n_rows, cfg) | _botnet_hit(cfg) | _icmp_hit(cfg))
            .select(F.col("src_ip").alias("__src"), *_SOURCE_FACTS))
    rows = pairs.select("src_ip", "dst_ip", "icmp_flows").join(hits, F.col("src_ip").eqNullSafe(F.col("__src")))
    return joined_lists(destination_parts(rows, _SOURCE_FACTS), _SOURCE_FACTS)


#: Destinations that share so many first characters are listed together.  An
#: IPv4 address has at most 15, so a part holds few thousand of these.
PART_PREFIX = 10


def destination_parts(rows: DataFrame, facts=()) -> DataFrame:
    """src_ip, facts, part, dst_list, icmp_dst_list: the destinations of each
    source in parts by their first characters, so that a source of any number
    of destinations is many groups' work.  Parts in order, and the texts in
    them, are in the order of the whole list, as equal beginnings sort together."""
    icmp_dst = F.when(F.col("icmp_flows") > 0, F.col("dst_ip"))
    # null where a part has none
    text = lambda c: F.when(F.size(F.collect_list(c)) > 0, F.array_join(F.array_sort(F.collect_list(c)), ", "))
    return (rows.groupBy("src_ip", *facts, F.substring("dst_ip", 1, PART_PREFIX).alias("part"))
            .agg(text(F.col("dst_ip")).alias("dst_list"), text(icmp_dst).alias("icmp_dst_list")))


def joined_lists(parts: DataFrame, facts=()) -> DataFrame:
    """One row per source: the parts' texts put together in order."""
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        F.col(c).isNotNull(), F.struct("part", F.col(c).alias("text"))))), lambda p: p.text), ", ").alias(c)
    return parts.groupBy("src_ip", *facts).agg(whole("dst_list"), whole("icmp_dst_list"))


def _alert(hit: Column, dst: str, kind: str, severity: Column, code: Column, count: Column,
           confidence: Column, evidence: Column) -> Column:
    """One alert as a struct, null where the source is not hit."""
    return F.when(hit, F.struct(F.col(dst).alias("dst_ip"), F.lit(kind).alias("threat_type"),
                                severity.alias("severity"), code.alias("protocol_code"),
                                count.cast("long").alias("flow_count"),
                                F.least(F.lit(0.99), confidence).alias("confidence"), evidence.alias("evidence")))


def _horizontal_scan(n_rows: int, cfg: DetectionConfig) -> Column:
    """D3: sources reaching >= max(15, int(0.05 * n)) distinct destinations."""
    n = F.col("unique_dsts")
    return _alert(_horizontal_hit(n_rows, cfg), "dst_list", HORIZONTAL_SCAN_TYPE,
                  F.when(n > cfg.horizontal_high_dsts, F.lit("high")).otherwise(F.lit("medium")),
                  F.col("protocol_code"), n, 0.5 + 0.001 * n,
                  F.format_string(HORIZONTAL_SCAN_EVIDENCE, n))


def _botnet(cfg: DetectionConfig) -> Column:
    """Sources with more than 50 flows and more than 30 distinct destinations."""
    flows, n = F.col("src_flows"), F.col("unique_dsts")
    return _alert(_botnet_hit(cfg), "dst_list", BOTNET_TYPE, F.lit("confirmed"), F.col("protocol_code"), flows,
                  0.70 + 0.01 * (flows / 10),
                  F.format_string(BOTNET_EVIDENCE, flows, n))


def _icmp_sweep(cfg: DetectionConfig) -> Column:
    """ICMP flows (any case) by source reaching >= 2 distinct destinations."""
    n = F.col("icmp_unique_dsts")
    total = F.coalesce(F.col("icmp_packets"), F.lit(0.0))
    return _alert(_icmp_hit(cfg), "icmp_dst_list", ICMP_SWEEP_TYPE, F.lit("confirmed"),
                  _protocol_code(F.lit("ICMP")), n, 0.70 + 0.01 * n,
                  F.format_string(ICMP_SWEEP_EVIDENCE, n.cast("string"), _py_float_text(total)))


def source_rows(flagged: DataFrame, n_rows: int, cfg: DetectionConfig = DEFAULT_CONFIG) -> DataFrame:
    """D3-D5 before the protocol lookup: each flagged source opens into its
    one to three alerts."""
    alerts = F.array(_horizontal_scan(n_rows, cfg), _botnet(cfg), _icmp_sweep(cfg))
    return (flagged.select("src_ip", F.filter(alerts, lambda a: a.isNotNull()).alias("alerts"))
            .select("src_ip", F.inline("alerts")))


def _source_alerts(flows: DataFrame, pairs: DataFrame | None, n_rows: int, cfg: DetectionConfig, kind: str) -> DataFrame:
    pairs = pair_summary(flows) if pairs is None else pairs
    rows = source_rows(flagged_sources(pairs, n_rows, cfg), n_rows, cfg)
    return with_protocol(rows.where(F.col("threat_type") == kind), flows)


def detect_horizontal_scan(flows: DataFrame, n_rows: int, cfg: DetectionConfig = DEFAULT_CONFIG,
                           pairs: DataFrame | None = None) -> DataFrame:
    """D3 alone."""
    return _source_alerts(flows, pairs, n_rows, cfg, HORIZONTAL_SCAN_TYPE)


def detect_botnet(flows: DataFrame, n_rows: int, cfg: DetectionConfig = DEFAULT_CONFIG,
                  pairs: DataFrame | None = None) -> DataFrame:
    """D4 alone."""
    return _source_alerts(flows, pairs, n_rows, cfg, BOTNET_TYPE)


def detect_icmp_sweep(flows: DataFrame, n_rows: int, cfg: DetectionConfig = DEFAULT_CONFIG,
                      pairs: DataFrame | None = None) -> DataFrame:
    """D5 alone."""
    return _source_alerts(flows, pairs, n_rows, cfg, ICMP_SWEEP_TYPE)


def temporal_correlation(threats: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG,
                         groups: DataFrame | None = None) -> DataFrame:
    """Per source over threat flows, whether (n >= 2 and span <= 60 s) or
    (n >= 3 and span <= 300 s).  Span is first-to-last over the whole input.
    A source whose times are all null is not correlated.  Given the D1
    ``groups``, it is rolled up from them (min of minima, max of maxima, sum
    of counts) instead of re-reading the threat flows."""
    if groups is None:
        per_src = (threats.groupBy("src_ip")
                   .agg(F.min("start_time").alias("first_seen"),
                        F.max("start_time").alias("last_seen"),
                        F.count(F.lit(1)).alias("threat_flow_count")))
    else:
        per_src = (groups.groupBy("src_ip")
                   .agg(F.min("first_seen").alias("first_seen"),
                        F.max("last_seen").alias("last_seen"),
                        F.sum("flow_count").alias("threat_flow_count")))
    span = F.col("last_seen") - F.col("first_seen")
    cond = F.lit(False)
    for min_flows, max_span in cfg.temporal_rules:
        cond = cond | ((F.col("threat_flow_count") >= min_flows) & (span <= max_span))
    return per_src.withColumn("temporal", F.coalesce(cond, F.lit(False)))


def union_alerts(flows: DataFrame, threats: DataFrame, n_rows: int, cfg: DetectionConfig = DEFAULT_CONFIG,
                 groups: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """UNION ALL of D1-D5 (8 alert columns, ``confidence`` unrounded).
    ``pairs``: the stored :func:`pair_summary`, read by D2 and by D3-D5."""
    pairs = pair_summary(flows) if pairs is None else pairs
    found = port_scan_rows(pairs, cfg).unionByName(source_rows(flagged_sources(pairs, n_rows, cfg), n_rows, cfg))
    return dedup_flow_alerts(threats, groups).unionByName(with_protocol(found, flows))
