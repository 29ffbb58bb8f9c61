"""Registered queries: one Spark plan per operator group, each over the whole
``flows`` fixture derived from ``events``, with its DuckDB oracle text.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame (the
adaptive thresholds are computed eagerly while it is built: four scalars).
Columns are aliased identically on both sides.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, FEATURE_COLUMNS, FLOW_COLUMNS
from ..functions.features import feature_vector as model_vector
from ..functions.features import with_features
from ..functions.rules import rule_hit_count, with_rule_scores
from ..operators import arbitrate as arb
from ..operators import calibrate as cal
from ..operators import detect
from ..operators.thresholds import adaptive_thresholds, thresholds_frame
from ..session import configure
from ..sources.fixture import labelled_flows, load_flows
from . import oracle as O
from ..operators import evaluate as ev
from ..operators import search as se
from ..operators import stats as st
from ..session import scratch_path
from ..sources import flowcsv
from ..sources.ledger import new_ledger
from ..operators import iforest
from .analyze import ScoredFlows, alerts_before_cut, run_file, score_flows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


# ---------------------------------------------------------------- helpers
def _flows(spark, sf_dir):
    configure(spark)
    return load_flows(spark, sf_dir)


def _injected_scores():
    """Synthetic model output for checking the Rule+ML branches."""
    return {"ml_score": (F.col("row_id") % 100) / 99.0,
            "ml_label": F.when(F.col("row_id") % 20 == 0, F.lit(1)).otherwise(F.lit(0))}


def _scored(spark, sf_dir, injected: bool = False) -> ScoredFlows:
    """Rule-scored flows, written once to the checkpoint folder (see
    ``score_flows(materialize=True)``); the model columns are absent (as
    shipped) or injected."""
    flows = _flows(spark, sf_dir)
    return score_flows(flows, DEFAULT_CONFIG, ml=None, inject=_injected_scores() if injected else None,
                       materialize=True)


def _alerts(spark, sf_dir):
    return alerts_before_cut(_scored(spark, sf_dir))


# ---------------------------------------------------------------- R / P / T
@register("threat_label_counts", O.with_ctes(O.FEAT, O.P95, O.THR, O.RULES) + """
select rule_threat_type as threat_label, count(*) as flows
from rules where rule_threat_type is not null group by rule_threat_type""")
def threat_label_counts(spark, sf_dir):
    """Flagship: how many flows carry each rule label."""
    feats = with_features(_flows(spark, sf_dir))
    scored = with_rule_scores(feats, adaptive_thresholds(feats))
    return (scored.where(F.col("rule_threat_type").isNotNull())
            .groupBy(F.col("rule_threat_type").alias("threat_label"))
            .agg(F.count(F.lit(1)).alias("flows")))


@register("flow_features", O.with_ctes(O.FEAT) + """
select row_id, raw_duration, flow_duration, bytes_per_packet, packets_per_sec_raw, udp_ratio,
       dst_port_flag, packets_per_sec from feat""")
def flow_features(spark, sf_dir):
    """P1-P7 per flow."""
    return with_features(_flows(spark, sf_dir)).select(
        "row_id", "raw_duration", "flow_duration", "bytes_per_packet", "packets_per_sec_raw",
        "udp_ratio", "dst_port_flag", "packets_per_sec")


@register("feature_vector", O.with_ctes(O.FEAT) + "select row_id, " + ", ".join(
    f"case when {c} is null or isnan({c}) then 0.0::DOUBLE when {c} = 'inf'::DOUBLE then 1e9::DOUBLE "
    f"when {c} = '-inf'::DOUBLE then -1e9::DOUBLE else {c} end as {c}" for c in FEATURE_COLUMNS) + " from feat")
def feature_vector(spark, sf_dir):
    """The 8 model features, sanitised."""
    return model_vector(with_features(_flows(spark, sf_dir)))


@register("adaptive_p95", O.with_ctes(O.FEAT, O.P95) + "select pkt_p95, byt_p95, bpp_p95, pps_p95 from p")
def adaptive_p95(spark, sf_dir):
    """Exact nearest-rank 95th percentiles."""
    thr = adaptive_thresholds(with_features(_flows(spark, sf_dir)))
    return thresholds_frame(spark, thr, "p95")


@register("rule_thresholds", O.with_ctes(O.FEAT, O.P95, O.THR) + "select * from thr")
def rule_thresholds(spark, sf_dir):
    """Per-rule cut-offs max(p95 * factor, floor)."""
    thr = adaptive_thresholds(with_features(_flows(spark, sf_dir)))
    return thresholds_frame(spark, thr, "rules")


_FLAG_COLS = ["flood_score", "suspicious_protocol_score", "ddos_score", "udp_flood_score", "exfil_score",
              "brute_score", "large_flow_score", "icmp_sweep_score", "total_rule_score",
              "rule_severity", "rule_threat_type", "rule_confidence"]


@register("rule_flags", O.with_ctes(O.FEAT, O.P95, O.THR, O.RULES)
          + "select row_id, " + ", ".join(_FLAG_COLS) + " from rules")
def rule_flags(spark, sf_dir):
    """R1-R13 per flow."""
    feats = with_features(_flows(spark, sf_dir))
    return with_rule_scores(feats, adaptive_thresholds(feats)).select("row_id", *_FLAG_COLS)


@register("rule_hit_count", O.with_ctes(O.FEAT, O.P95, O.THR, O.RULES)
          + "select count(*) filter (where rule_threat_type is not null) as rule_hits from rules")
def rule_hit_count_q(spark, sf_dir):
    """R14."""
    feats = with_features(_flows(spark, sf_dir))
    return rule_hit_count(with_rule_scores(feats, adaptive_thresholds(feats)))


# ---------------------------------------------------------------- B / M10-M11
_ARB_COLS = ["row_id", "ml_score", "ml_label", "ml_evidence", "ml_confidence", "threat_type", "severity",
             "confidence"]


@register("arbitrate_flows", O.with_ctes(*O.BASE_SHIPPED) + "select " + ", ".join(_ARB_COLS) + " from arb")
def arbitrate_flows(spark, sf_dir):
    """B1-B4 as shipped (no flow is a model outlier)."""
    return _scored(spark, sf_dir).flows.select(*_ARB_COLS)


@register("arbitrate_rule_ml", O.with_ctes(*O.BASE_INJECTED) + "select " + ", ".join(_ARB_COLS) + " from arb")
def arbitrate_rule_ml(spark, sf_dir):
    """B1-B4 with M10 evidence and M11 confidence on injected model output."""
    return _scored(spark, sf_dir, injected=True).flows.select(*_ARB_COLS)


@register("threat_flows", O.with_ctes(*O.BASE_SHIPPED)
          + "select row_id, src_ip, threat_type, severity, confidence from threats")
def threat_flows_q(spark, sf_dir):
    """B5."""
    return arb.threat_flows(_scored(spark, sf_dir).flows).select(
        "row_id", "src_ip", "threat_type", "severity", "confidence")


# ---------------------------------------------------------------- D
_ALERT_SEL = "select src_ip, dst_ip, threat_type, severity, protocol, flow_count, confidence, evidence from "


def _detector_inputs(spark, sf_dir, injected=False):
    sf = _scored(spark, sf_dir, injected)
    return sf, arb.threat_flows(sf.flows)


@register("dedup_flow_alerts", O.with_ctes(*O.BASE_SHIPPED, O.DETECT) + _ALERT_SEL + "d1")
def dedup_flow_alerts(spark, sf_dir):
    """D1."""
    _, threats = _detector_inputs(spark, sf_dir)
    return detect.dedup_flow_alerts(threats)


@register("dedup_flow_alerts_rule_ml", O.with_ctes(*O.BASE_INJECTED, O.DETECT) + _ALERT_SEL + "d1")
def dedup_flow_alerts_rule_ml(spark, sf_dir):
    """D1 on injected model output (ML-only and Rule+ML types, model evidence)."""
    _, threats = _detector_inputs(spark, sf_dir, injected=True)
    return detect.dedup_flow_alerts(threats)


@register("detect_port_scan", O.with_ctes(*O.BASE_SHIPPED, O.DETECT) + _ALERT_SEL + "d2")
def detect_port_scan(spark, sf_dir):
    """D2."""
    flows = _flows(spark, sf_dir)
    return detect.detect_port_scan(detect.pair_summary(flows), flows)


@register("detect_horizontal_scan", O.with_ctes(*O.BASE_SHIPPED, O.DETECT) + _ALERT_SEL + "d3")
def detect_horizontal_scan(spark, sf_dir):
    """D3 (threshold from the total row count)."""
    flows = _flows(spark, sf_dir)
    return detect.detect_horizontal_scan(flows, flows.count())


@register("detect_botnet", O.with_ctes(*O.BASE_SHIPPED, O.DETECT) + _ALERT_SEL + "d4")
def detect_botnet(spark, sf_dir):
    """D4."""
    flows = _flows(spark, sf_dir)
    return detect.detect_botnet(flows, flows.count())


@register("detect_icmp_sweep", O.with_ctes(*O.BASE_SHIPPED, O.DETECT) + _ALERT_SEL + "d5")
def detect_icmp_sweep(spark, sf_dir):
    """D5."""
    flows = _flows(spark, sf_dir)
    return detect.detect_icmp_sweep(flows, flows.count())


@register("temporal_correlation", O.with_ctes(*O.BASE_SHIPPED, O.DETECT)
          + "select src_ip, first_seen, last_seen, threat_flow_count, temporal from temporal")
def temporal_correlation(spark, sf_dir):
    """D6."""
    _, threats = _detector_inputs(spark, sf_dir)
    return detect.temporal_correlation(threats)


@register("union_alerts", O.with_ctes(*O.BASE_SHIPPED, O.DETECT) + _ALERT_SEL + "raw_alerts")
def union_alerts(spark, sf_dir):
    """Every raw alert of D1-D5."""
    sf, threats = _detector_inputs(spark, sf_dir)
    return detect.union_alerts(sf.flows, threats, sf.thresholds.n_rows)


# ---------------------------------------------------------------- K
@register("calibrate_alerts", O.with_ctes(*O.ALERTS_SHIPPED) + """
select src_ip, dst_ip, threat_type, protocol, flow_count, severity, confidence, confidence_raw, evidence,
       branch, temporal
from calibrated""")
def calibrate_alerts(spark, sf_dir):
    """K1-K3 (rounded and unrounded confidence, branch number, temporal flag)."""
    sf, threats = _detector_inputs(spark, sf_dir)
    raw = detect.union_alerts(sf.flows, threats, sf.thresholds.n_rows)
    return cal.calibrate(raw, detect.temporal_correlation(threats))


@register("escalate_cross_threat", O.with_ctes(*O.ALERTS_SHIPPED) + """
select src_ip, dst_ip, threat_type, protocol, flow_count, severity, confidence, confidence_raw, evidence, escalated
from escalated""")
def escalate_cross_threat(spark, sf_dir):
    """K4-K6 over all calibrated alerts."""
    return _alerts(spark, sf_dir).drop("branch")


@register("escalated_count", O.with_ctes(*O.ALERTS_SHIPPED)
          + "select count(*) filter (where escalated) as escalated_count from escalated")
def escalated_count(spark, sf_dir):
    """K7."""
    return cal.escalated_count(_alerts(spark, sf_dir))


@register("calibration_branch_counts", O.with_ctes(*O.ALERTS_SHIPPED)
          + "select branch, count(*) as alerts from calibrated group by branch")
def calibration_branch_counts(spark, sf_dir):
    """K2 coverage: alerts per calibration branch."""
    return _alerts(spark, sf_dir).groupBy("branch").agg(F.count(F.lit(1)).alias("alerts"))


@register("rank_alerts_top1000", O.with_ctes(*O.ALERTS_SHIPPED) + "select * from ranked")
def rank_alerts_top1000(spark, sf_dir):
    """K8, the ranking that ``analyze()`` ships."""
    return cal.rank_alerts(_alerts(spark, sf_dir)).select(*cal.FINAL_COLUMNS)


# ---------------------------------------------------------------- A


def _final(spark, sf_dir, sf: ScoredFlows | None = None) -> DataFrame:
    """Every escalated alert (of ``sf`` where a query already holds it)."""
    return alerts_before_cut(sf or _scored(spark, sf_dir)).select(*cal.FINAL_COLUMNS)


@register("threats_detected", O.with_ctes(*O.BASE_SHIPPED)
          + "select count(*) as total_flows, count(*) filter (where threat_type is not null) as threats_detected "
            "from arb")
def threats_detected(spark, sf_dir):
    """A1 + A2."""
    return st.threats_detected(_scored(spark, sf_dir).flows)


@register("protocol_counts", "with " + O.flows_cte_duckdb() + "\nselect protocol, count(*) as count from flows group by protocol")
def protocol_counts(spark, sf_dir):
    """A3."""
    return st.protocol_counts(_flows(spark, sf_dir))


@register("protocol_distribution", "with " + O.flows_cte_duckdb()
          + "\nselect coalesce(upper(protocol), 'NONE') as protocol, count(*) as count from flows group by 1")
def protocol_distribution(spark, sf_dir):
    """A4 (long form of the record's map)."""
    return st.protocol_distribution(_flows(spark, sf_dir))


_TOP = """
select {k} as {ok}, n as {oc} from (select {k}, count(*) as n from threats group by {k})
order by n desc, {k} limit 1"""


@register("top_attacker", O.with_ctes(*O.BASE_SHIPPED)
          + _TOP.format(k="src_ip", ok="top_attacker_ip", oc="top_attacker_count"))
def top_attacker(spark, sf_dir):
    """A5."""
    return st.top_attacker(arb.threat_flows(_scored(spark, sf_dir).flows))


@register("top_threat_type", O.with_ctes(*O.BASE_SHIPPED)
          + _TOP.format(k="threat_type", ok="top_threat_type", oc="top_threat_count"))
def top_threat_type(spark, sf_dir):
    """A6."""
    return st.top_threat_type(arb.threat_flows(_scored(spark, sf_dir).flows))


@register("run_stats", O.with_ctes(*O.BASE_SHIPPED) + """
select (select count(*) from arb) as total_flows, (select count(*) from threats) as threats_detected,
       coalesce(a.k, 'N/A') as top_attacker_ip, coalesce(a.n, 0) as top_attacker_count,
       coalesce(t.k, 'N/A') as top_threat_type, coalesce(t.n, 0) as top_threat_count
from (select 1 as one) o
left join (select src_ip as k, count(*) as n from threats group by 1 order by n desc, k limit 1) a on true
left join (select threat_type as k, count(*) as n from threats group by 1 order by n desc, k limit 1) t on true""")
def run_stats(spark, sf_dir):
    """A7 (the map column is checked in long form by protocol_distribution)."""
    return st.run_stats(_scored(spark, sf_dir).flows, with_map=False)


@register("score_histogram", O.with_ctes(*O.BASE_INJECTED) + f"""
select g.bin, round(g.bin::DOUBLE * 0.05::DOUBLE, 2) as bin_start,
       round(case when g.bin + 1 = 20 then 1.0::DOUBLE else (g.bin + 1)::DOUBLE * 0.05::DOUBLE end, 2) as bin_end,
       coalesce(c.n, 0) as count
from (select range::integer as bin from range(20)) g
left join (select {O.numpy_bin('ml_score')} as bin, count(*) as n from arb group by 1) c on g.bin = c.bin""")
def score_histogram(spark, sf_dir):
    """A8 on injected model scores."""
    return st.score_histogram(_scored(spark, sf_dir, injected=True).flows)


@register("threats_over_time", O.with_ctes(*O.BASE_SHIPPED, O.TIMELINE)
          + "select bin, time, threat_count from timeline")
def threats_over_time(spark, sf_dir):
    """A9 + A10."""
    return st.threats_over_time(arb.threat_flows(_scored(spark, sf_dir).flows))


@register("alerts_by_severity", O.with_ctes(*O.ALERTS_FINAL)
          + "select severity, count(*) as alerts from final group by severity")
def alerts_by_severity(spark, sf_dir):
    """A11."""
    return st.alerts_by_severity(_final(spark, sf_dir))


# ---------------------------------------------------------------- E
@register("detection_metrics", O.with_ctes(*O.ALERTS_FINAL) + """
select case when n > 0 then th::DOUBLE / n * 100 else 0.0::DOUBLE end as detection_rate_percent,
       th as threats_detected, n as total_flows, na as num_alerts,
       case when na > 0 then th::DOUBLE / na else 0.0::DOUBLE end as aggregation_ratio
from (select (select count(*) from arb) as n, (select count(*) from threats) as th,
             (select count(*) from final) as na)""")
def detection_metrics(spark, sf_dir):
    """E1 + E2 (unrounded)."""
    sf = _scored(spark, sf_dir)
    return ev.detection_metrics(st.run_stats(sf.flows, with_map=False), _final(spark, sf_dir, sf), rounded=False)


@register("severity_distribution", O.with_ctes(*O.ALERTS_FINAL) + """
select severity, count(*) as count, round(avg(confidence), 6) as avg_confidence,
       count(*) * 100.0::DOUBLE / (select count(*) from final) as percent
from final group by severity""")
def severity_distribution(spark, sf_dir):
    """E3 + E6 (mean confidence to 6 places: float sums depend on order)."""
    return (ev.severity_distribution(_final(spark, sf_dir), rounded=False)
            .withColumn("avg_confidence", F.round("avg_confidence", 6))
            .withColumn("percent", F.col("count") * 100.0 / F.sum("count").over(ev._everything())))


@register("threat_type_distribution", O.with_ctes(*O.ALERTS_FINAL)
          + "select threat_type, count(*) as count from final group by threat_type")
def threat_type_distribution(spark, sf_dir):
    """E4."""
    return ev.threat_type_distribution(_final(spark, sf_dir))


@register("top5_threat_types", O.with_ctes(*O.ALERTS_FINAL) + """
select threat_type, count(*) as count, count(*)::DOUBLE / (select count(*) from final) * 100 as percent
from final group by threat_type order by count desc, threat_type limit 5""")
def top5_threat_types(spark, sf_dir):
    """E7."""
    return ev.top_threat_types(_final(spark, sf_dir), 5)


@register("ground_truth_counts", "with " + O.flows_cte_duckdb() + """
select count(*) as total_ground_truth,
       count(*) filter (where contains(label, 'BENIGN')) as benign_count,
       count(*) filter (where not contains(label, 'BENIGN') or label is null) as threat_count from flows""")
def ground_truth_counts(spark, sf_dir):
    """E8 + E9."""
    configure(spark)
    return ev.ground_truth_counts(ev.label_ground_truth(labelled_flows(spark, sf_dir)))


@register("ip_outcomes", O.with_ctes(*O.ALERTS_FINAL, O.GROUND_TRUTH)
          + "select ground_truth, src_ip, outcome from outcomes")
def ip_outcomes(spark, sf_dir):
    """Per (class, source IP) outcome against the detected set."""
    truth = ev.label_ground_truth(labelled_flows(spark, sf_dir))
    return ev.ip_outcomes(truth, _final(spark, sf_dir))


_ACC_COLS = ["unique_threat_ips", "unique_benign_ips", "true_positives", "false_positives", "true_negatives",
             "false_negatives", "precision", "recall", "f1_score", "accuracy", "false_positive_rate",
             "false_negative_rate"]


@register("precision_recall_f1", O.with_ctes(*O.ALERTS_FINAL, O.GROUND_TRUTH)
          + "select " + ", ".join(_ACC_COLS) + " from acc")
def precision_recall_f1(spark, sf_dir):
    """E14 (unrounded)."""
    truth = ev.label_ground_truth(labelled_flows(spark, sf_dir))
    return ev.accuracy(truth, _final(spark, sf_dir), rounded=False).select(*_ACC_COLS)


@register("accuracy_gate", O.with_ctes(*O.ALERTS_FINAL, O.GROUND_TRUTH) + """
select precision, recall, f1_score, precision >= 0.75 and recall >= 0.60 and f1_score >= 0.65 as passed
from acc""")
def accuracy_gate(spark, sf_dir):
    """E15."""
    truth = ev.label_ground_truth(labelled_flows(spark, sf_dir))
    return ev.accuracy_gate(ev.accuracy(truth, _final(spark, sf_dir), rounded=False))


# ---------------------------------------------------------------- Q
_FINAL_COLS = "src_ip, dst_ip, threat_type, protocol, flow_count, confidence, severity, evidence"


@register("search_alerts", O.with_ctes(*O.ALERTS_FINAL) + f"""
select {_FINAL_COLS} from final
where upper(coalesce(severity, '')) = 'CONFIRMED' and upper(coalesce(protocol, '')) = 'TCP'
  and (contains(coalesce(src_ip, ''), '10.0') or contains(coalesce(dst_ip, ''), '10.0'))""")
def search_alerts(spark, sf_dir):
    """Q1, Q2, Q4, Q5: severity 'confirmed', protocol 'tcp', IP term ' 10.0 '."""
    return se.search_alerts(_final(spark, sf_dir), severity="confirmed", protocol="tcp", ip=" 10.0 ")


@register("search_threat_type", O.with_ctes(*O.ALERTS_FINAL)
          + f"select {_FINAL_COLS} from final where coalesce(threat_type, '') = 'Flood'")
def search_threat_type(spark, sf_dir):
    """Q3: exact type equality."""
    return se.search_alerts(_final(spark, sf_dir), threat_type="Flood")


@register("distinct_protocols", O.with_ctes(*O.ALERTS_FINAL) + """
select upper(coalesce(protocol, '')) as protocol from final where upper(coalesce(protocol, '')) <> ''
union select coalesce(upper(protocol), 'NONE') from flows""")
def distinct_protocols(spark, sf_dir):
    """Q6: alert protocols UNION the run's protocol names."""
    return se.distinct_protocols(_final(spark, sf_dir), st.protocol_distribution(_flows(spark, sf_dir)))


@register("distinct_threat_types", O.with_ctes(*O.ALERTS_FINAL)
          + "select distinct threat_type from final where threat_type is not null and threat_type <> ''")
def distinct_threat_types(spark, sf_dir):
    """Q7."""
    return se.distinct_threat_types(_final(spark, sf_dir))


@register("confidence_histogram", O.with_ctes(*O.ALERTS_FINAL) + """
select g.bin, round(g.bin::DOUBLE * 0.05::DOUBLE, 2) as bin_start, round((g.bin + 1)::DOUBLE * 0.05::DOUBLE, 2)
       as bin_end, coalesce(c.n, 0) as count
from (select range::integer as bin from range(20)) g
left join (select least(cast(floor(coalesce(confidence, 0.0::DOUBLE) / 0.05::DOUBLE) as integer), 19) as bin,
                  count(*) as n from final group by 1) c on g.bin = c.bin""")
def confidence_histogram(spark, sf_dir):
    """Q8 over all final alerts."""
    return se.confidence_histogram(_final(spark, sf_dir))


@register("scaled_timeline", O.with_ctes(*O.ALERTS_FINAL, O.TIMELINE) + """
select bin, time, cast(floor(threat_count * ((select count(*) from final where severity = 'CONFIRMED')::DOUBLE
                                             / (select count(*) from final)) + 0.5) as bigint) as threat_count
from timeline""")
def scaled_timeline(spark, sf_dir):
    """Q9: the timeline scaled by the share of CONFIRMED alerts."""
    sf = _scored(spark, sf_dir)
    final = _final(spark, sf_dir, sf)
    shown, total = final.agg(F.count_if(F.col("severity") == "CONFIRMED"), F.count(F.lit(1))).first()
    return se.scaled_timeline(st.threats_over_time(arb.threat_flows(sf.flows)), shown, total)


@register("explode_dst_ips", O.with_ctes(*O.ALERTS_FINAL) + """
select src_ip, threat_type, pos - 1 as position, destination
from (select src_ip, threat_type,
             unnest(list_filter(list_transform(string_split(coalesce(dst_ip, ''), ','), lambda x: trim(x)), lambda x: x <> ''))
               as destination,
             generate_subscripts(list_filter(list_transform(string_split(coalesce(dst_ip, ''), ','), lambda x: trim(x)),
                                             lambda x: x <> ''), 1) as pos
      from final)""")
def explode_dst_ips(spark, sf_dir):
    """Q10."""
    return se.explode_dst_ips(_final(spark, sf_dir))


@register("dst_ip_preview", O.with_ctes(*O.ALERTS_FINAL) + """
select src_ip, threat_type, array_to_string(l[1:3], ', ') as preview, greatest(len(l) - 3, 0) as more
from (select src_ip, threat_type,
             list_filter(list_transform(string_split(coalesce(dst_ip, ''), ','), lambda x: trim(x)), lambda x: x <> '') as l
      from final)""")
def dst_ip_preview(spark, sf_dir):
    """Q11 (preview as comma-joined text)."""
    return (se.dst_ip_preview(_final(spark, sf_dir))
            .withColumn("preview", F.array_join("preview", ", ")))


@register("protocol_split", "with " + O.flows_cte_duckdb()
          + "\nselect coalesce(upper(protocol), 'NONE') as name, count(*) as value from flows group by 1")
def protocol_split(spark, sf_dir):
    """Q12: the record's protocol map exploded to (name, value)."""
    return se.protocol_split(st.protocol_distribution_map(_flows(spark, sf_dir)))


@register("filtered_count", O.with_ctes(*O.ALERTS_FINAL) + """
select (select count(*) from final where upper(coalesce(protocol, '')) = 'UDP') as shown,
       (select count(*) from final) as total""")
def filtered_count(spark, sf_dir):
    """Q13 for the protocol filter 'udp'."""
    final = _final(spark, sf_dir)
    return se.filtered_count(se.search_alerts(final, protocol="udp"), final)


# ---------------------------------------------------------------- S / C

_FLOW_OUT = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes", "flows",
             "start_time", "end_time"]


def _write_csv(df: DataFrame, path: str, header: bool) -> None:
    (df.write.option("header", header).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


#: Rows sorted and written by one task where a CSV keeps an order.
ROWS_PER_FILE = 250_000


def _in_file_order(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in ranges of the keys, each sorted by its own task, so the files
    written from it are in order by name.  The ranges grow in number with the
    rows, not in size, up to the 100,000 that the names' five digits order."""
    n = min(max(1, -(-df.count() // ROWS_PER_FILE)), 100_000)
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


@register("scan_flow_csv", "with " + O.flows_cte_duckdb() + "\nselect " + ", ".join(_FLOW_OUT) + " from flows")
def scan_flow_csv(spark, sf_dir):
    """The flows written as a headered CSV (numbers in
    Spark's text form), then read back through header detection, trimming,
    validation and the whole-column casts."""
    path = scratch_path(spark, "flows-csv")
    _write_csv(_flows(spark, sf_dir).drop("row_id", "tos"), path, header=True)
    return flowcsv.read_flow_csv(spark, path).select(*_FLOW_OUT)


_TS = "strftime(make_timestamp(cast(floor({c} * 1000000) as bigint)), '%Y-%m-%d %H:%M:%S')"


@register("scan_flow_csv_headerless", "with " + O.flows_cte_duckdb() + """
select src_ip, dst_ip, src_port, dst_port, protocol, packets, bytes, flows,
       floor(start_time) as start_time, floor(end_time) as end_time, '0' as tos from flows""")
def scan_flow_csv_headerless(spark, sf_dir):
    """A headerless CSV with padded addresses and
    ``yyyy-MM-dd HH:mm:ss`` times; positional names, whitespace trimmed,
    times parsed to whole epoch seconds."""
    path = scratch_path(spark, "flows-csv-headerless")
    flows = _flows(spark, sf_dir)
    ts = lambda c: F.date_format(F.timestamp_seconds(F.col(c)), "yyyy-MM-dd HH:mm:ss")
    text = flows.select(F.concat(F.lit(" "), "src_ip", F.lit("\t")).alias("src_ip"), "dst_ip", "src_port",
                        "dst_port", "protocol", "tos", "packets", "bytes", "flows",
                        ts("start_time").alias("start_time"), ts("end_time").alias("end_time"))
    _write_csv(text, path, header=False)
    return flowcsv.read_flow_csv(spark, path).select(*_FLOW_OUT, "tos")


@register("select_input_files")
def select_input_files(spark, sf_dir):
    """Every .csv file in a folder of written flow CSVs, with its length
    (paths are fresh per run, so only the row count is comparable)."""
    path = scratch_path(spark, "flows-csv-files")
    _write_csv(_flows(spark, sf_dir).drop("row_id"), path, header=True)
    return flowcsv.select_input_files(spark, path)


@register("input_files_summary", "with " + O.flows_cte_duckdb() + """
select cast(row_id % 3 as varchar) as folder, 1 as files,
       cast(octet_length(encode('src_ip,dst_ip,bytes')) + 1 + sum(octet_length(encode(src_ip || ',' || dst_ip || ',' || cast(cast(bytes as bigint) as varchar))) + 1) as bigint) as bytes
from flows group by row_id % 3""")
def input_files_summary(spark, sf_dir):
    """S7 by value: a folder of three CSVs (and a file of another kind beside
    them), the files found and their lengths against the lines written."""
    path = scratch_path(spark, "flows-csv-sizes")
    flows = _flows(spark, sf_dir)
    lines = flows.select((F.col("row_id") % 3).cast("string").alias("folder"), "src_ip", "dst_ip", F.col("bytes").cast("long").alias("bytes"))
    # a folder at a time through one writer: one file each, as rows arrive, without a sort by folder
    for (k,) in lines.select("folder").distinct().collect():
        (lines.where(F.col("folder").eqNullSafe(k)).drop("folder").repartition(1)
         .write.option("header", True).csv(f"{path}/folder={'none' if k is None else k}"))
    flows.limit(1).select("src_ip").write.text(f"{path}/folder=0/notes")
    found = flowcsv.select_input_files(spark, path)
    return (found.groupBy(F.regexp_extract("path", "folder=([0-9]+)", 1).alias("folder"))
            .agg(F.count(F.lit(1)).cast("int").alias("files"), F.sum("length").alias("bytes")))


@register("ledger_search", O.with_ctes(*O.ALERTS_FINAL) + f"""
select {_FINAL_COLS} from final where upper(coalesce(severity, '')) = 'CONFIRMED' and upper(coalesce(protocol, '')) = 'TCP'""")
def ledger_search(spark, sf_dir):
    """Q1, Q2 and Q5 on stored alerts: equalities on the stored columns."""
    ledger = new_ledger(spark)
    sf = _scored(spark, sf_dir)
    ledger.store_run(st.run_stats(sf.flows), st.score_histogram(sf.flows), st.threats_over_time(arb.threat_flows(sf.flows)),
                     _final(spark, sf_dir, sf), "flows.csv")
    return ledger.search(severity="confirmed", protocol="tcp").select(*cal.FINAL_COLUMNS)


@register("ledger_recent_alerts", O.with_ctes(*O.ALERTS_FINAL) + f"""
select {_FINAL_COLS} from final order by confidence desc, src_ip, dst_ip, threat_type limit 15""")
def ledger_recent_alerts(spark, sf_dir):
    """S15 by contents: an older run's alerts, newer runs without any, then the
    newest with alerts."""
    ledger = new_ledger(spark)
    sf = _scored(spark, sf_dir)
    stats, final = st.run_stats(sf.flows), _final(spark, sf_dir, sf)
    charts = st.score_histogram(sf.flows), st.threats_over_time(arb.threat_flows(sf.flows))
    for name, alerts in (("old.csv", final.limit(0)), ("flows.csv", final), ("none.csv", final.limit(0))):
        ledger.store_run(stats, *charts, alerts, name)
    return ledger.recent_alerts(15).select(*cal.FINAL_COLUMNS)


@register("ledger_latest_alerts", O.with_ctes(*O.ALERTS_FINAL) + f"select {_FINAL_COLS} from final")
def ledger_latest_alerts(spark, sf_dir):
    """Two runs appended to a fresh ledger (an empty one first), then
    the alerts of the newest run read back through the run_id semi join."""
    ledger = new_ledger(spark)
    sf = _scored(spark, sf_dir)
    final = _final(spark, sf_dir, sf)
    stats = st.run_stats(sf.flows)
    hist = st.score_histogram(sf.flows)
    timeline = st.threats_over_time(arb.threat_flows(sf.flows))
    ledger.store_run(stats, hist, timeline, final.limit(0), "empty.csv")
    ledger.store_run(stats, hist, timeline, final, "flows.csv")
    return ledger.alerts_of_latest_run().select(*cal.FINAL_COLUMNS)


@register("ledger_empty_latest", O.with_ctes(*O.ALERTS_FINAL) + f"select {_FINAL_COLS} from final where false")
def ledger_empty_latest(spark, sf_dir):
    """S11, S12 on a store that holds a run and no alerts."""
    ledger = new_ledger(spark)
    sf = _scored(spark, sf_dir)
    ledger.write_run(st.run_stats(sf.flows), st.score_histogram(sf.flows),
                     st.threats_over_time(arb.threat_flows(sf.flows)), "empty.csv")
    return ledger.alerts_of_latest_run().select(*cal.FINAL_COLUMNS)


@register("ledger_reads", O.with_ctes(*O.ALERTS_FINAL) + """
select 2 as runs, 2 * (select count(*) from final) as alerts, 2 as recent_runs,
       least(20, 2 * (select count(*) from final)) as recent_alerts,
       least(10, 2 * (select count(*) from final where severity = 'CONFIRMED')) as confirmed,
       1 as found, (select count(*) from arb) as latest_flows, 2 as tables""")
def ledger_reads(spark, sf_dir):
    """Two stored runs, read through every store query."""
    ledger = new_ledger(spark)
    sf = _scored(spark, sf_dir)
    stats, final = st.run_stats(sf.flows), _final(spark, sf_dir, sf)
    hist, timeline = st.score_histogram(sf.flows), st.threats_over_time(arb.threat_flows(sf.flows))
    for name in ("a.csv", "b.csv"):
        run = ledger.store_run(stats, hist, timeline, final, name)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    latest = ledger.latest_or_default_stats().select(F.col("total_flows").alias("latest_flows"))
    out = ledger.counts()
    for part in (n(ledger.recent_runs(), "recent_runs"), n(ledger.recent_alerts(), "recent_alerts"),
                 n(ledger.alerts_by_severity("CONFIRMED"), "confirmed"), n(ledger.run_by_id(run), "found"), latest):
        out = out.unionByName(part, allowMissingColumns=True)
    out = out.agg(*[F.max(c).alias(c) for c in out.columns])
    return out.withColumn("tables", F.lit(len(ledger.register_views())))


def _without_some_sources(flows: DataFrame) -> DataFrame:
    return flows.withColumn("src_ip", F.when(~F.col("src_ip").endswith("7"), F.col("src_ip")))


@register("null_source_alerts", O.with_ctes(*O.ALERTS_FINAL).replace("flows as (", "base as (", 1).replace(
    "f0 as (", "flows as (select * replace (case when not ends_with(src_ip, '7') then src_ip end as src_ip) from base),\nf0 as (", 1)
    + f"select {_FINAL_COLS} from final")
def null_source_alerts(spark, sf_dir):
    """K1, K4-K6, D3-D5 where some flows have no source address: null is a
    source like any other."""
    sf = score_flows(_without_some_sources(_flows(spark, sf_dir)), DEFAULT_CONFIG, ml=None, materialize=True)
    return alerts_before_cut(sf).select(*cal.FINAL_COLUMNS)


@register("normalised_scores", "with " + O.flows_cte_duckdb() + """,
s as (select row_id, ((row_id * 7919) % 1000)::DOUBLE / 1000.0::DOUBLE as a from flows),
r as (select min(a) as lo, max(a) as hi, quantile_cont(a, 0.95) as cut from s)
select row_id, (a - lo) / (case when hi > lo then hi - lo else 1.0::DOUBLE end) as ml_score,
       case when a > cut then 1 else 0 end as ml_label from s, r""")
def normalised_scores(spark, sf_dir):
    """M6, M8, M9 on injected raw scores: contamination cut, min-max scaling,
    labels."""
    raw = _flows(spark, sf_dir).select("row_id", (F.pmod(F.col("row_id") * 7919, F.lit(1000)).cast("double") / 1000.0).alias("anomaly_score"))
    model = iforest.ForestModel({}, None, None, None, 0, 0)
    model.threshold = iforest.contamination_cut(raw.select(F.col("anomaly_score").alias("s")), raw.count())
    return iforest.normalise_scores(raw, model, "intent").select("row_id", "ml_score", "ml_label")


# ---------------------------------------------------------------- M

_SAN = {c: (f"case when {c} is null or isnan({c}) then 0.0::DOUBLE when {c} = 'inf'::DOUBLE then 1e9::DOUBLE "
            f"when {c} = '-inf'::DOUBLE then -1e9::DOUBLE else {c} end") for c in FEATURE_COLUMNS}
_VEC = "vec as (select row_id, " + ", ".join(f"{_SAN[c]} as {c}" for c in FEATURE_COLUMNS) + " from feat)"
_MOM = "mom8 as (select " + ", ".join(
    f"avg({c}) as m_{c}, stddev_pop({c}) + 1e-9 as s_{c}" for c in FEATURE_COLUMNS) + " from vec)"


@register("feature_moments", O.with_ctes(O.FEAT, _VEC, _MOM) + " union all ".join(
    f"select '{c}' as feature, round(m_{c}, 6) as mean, round(s_{c}, 6) as std from mom8" for c in FEATURE_COLUMNS))
def feature_moments(spark, sf_dir):
    """M2: mean and population std (+1e-9) over every row (rounded to 6 places,
    float sums depend on order)."""
    flows = _flows(spark, sf_dir)
    vec = model_vector(with_features(flows))
    mom = iforest.feature_moments(vec)
    rows = [(c, round(m, 6), round(s, 6)) for c, (m, s) in mom.items()]
    # tiny result frame; the rounding above is Python's, so round again in Spark
    return spark.createDataFrame(rows, "feature string, mean double, std double").select(
        "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("standard_scale", O.with_ctes(O.FEAT, _VEC, _MOM) + "select row_id, " + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) as {c}" for c in FEATURE_COLUMNS) + " from vec, mom8")
def standard_scale(spark, sf_dir):
    """M3: (x - mean) / std per feature (rounded to 6 places)."""
    flows = _flows(spark, sf_dir)
    vec = model_vector(with_features(flows))
    mom = iforest.feature_moments(vec)
    return iforest.standard_scale(vec, mom).select("row_id", *[F.round(c, 6).alias(c) for c in FEATURE_COLUMNS])


@register("isolation_forest_scores")
def isolation_forest_scores(spark, sf_dir):
    """M1, M4-M9 (intended polarity): raw anomaly score, min-max normalised
    score and the contamination label for every flow.  No SQL form: checked
    by the property tests."""
    sf = score_flows(_flows(spark, sf_dir), DEFAULT_CONFIG, ml="intent", materialize=True)
    return sf.flows.select("row_id", "anomaly_score", "ml_score", "ml_label", "threat_type", "severity")


#: Two small trees over the model's features, as heaps: (feature, value) of inner nodes, path of leaves.
_GIVEN_TREES = (
    {0: ("packets", 20.0), 1: ("bytes_per_packet", 300.0), 2: ("flow_duration", 5.0), 3: 2.0, 4: 3.5, 5: 4.0, 6: 2.25},
    {0: ("bytes", 5000.0), 1: 1.0, 2: ("packets_per_sec", 50.0), 5: 2.0, 6: ("udp_ratio", 0.5), 13: 3.0, 14: 5.25},
)


def _given_path(tree: dict, node: int = 0) -> str:
    """The path of a flow through a given tree as SQL."""
    at = tree[node]
    if not isinstance(at, tuple):
        return f"{at!r}::DOUBLE"
    return f"case when {at[0]} <= {at[1]!r}::DOUBLE then {_given_path(tree, 2 * node + 1)} else {_given_path(tree, 2 * node + 2)} end"


@register("given_forest_scores", O.with_ctes(O.FEAT, _VEC) + "select row_id, round(pow(2.0::DOUBLE, -(("
          + " + ".join(_given_path(t) for t in _GIVEN_TREES)
          + ") / 2.0::DOUBLE) / (2.0::DOUBLE * (ln(255.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * 255 / 256)), 9) as score from vec")
def given_forest_scores(spark, sf_dir):
    """M5 by value: every flow scored with two given trees of psi 256."""
    import numpy as np
    depth = 3
    shape = (len(_GIVEN_TREES), 2 ** (depth + 1) - 1)
    feature, value, path = np.full(shape, -1, "int32"), np.zeros(shape), np.zeros(shape)
    for k, tree in enumerate(_GIVEN_TREES):
        for node, at in tree.items():
            if isinstance(at, tuple):
                feature[k, node], value[k, node] = FEATURE_COLUMNS.index(at[0]), at[1]
            else:
                path[k, node] = at
    vec = model_vector(with_features(_flows(spark, sf_dir)))
    model = iforest.ForestModel({}, feature, value, path, 256, depth)
    return vec.select("row_id", F.round(iforest.raw_scores(model, vec), 9).alias("score"))


@register("ml_hit_count", O.with_ctes(*O.BASE_INJECTED) + """
select cast(sum(ml_label) as bigint) as ml_hits,
       coalesce(sum(ml_label)::DOUBLE * 100.0::DOUBLE / count(*)::DOUBLE, 0.0::DOUBLE) as ml_hit_percent from arb""")
def ml_hit_count(spark, sf_dir):
    """M7 on injected labels."""
    return iforest.ml_hit_count(_scored(spark, sf_dir, injected=True).flows)


@register("export_alerts_csv", O.with_ctes(*O.ALERTS_FINAL) + """
select coalesce(src_ip, '') as src_ip, coalesce(dst_ip, '') as dst_ip, coalesce(protocol, '') as protocol,
       coalesce(threat_type, '') as threat_type, cast(flow_count as varchar) as flows,
       cast(cast(floor(coalesce(confidence, 0.0::DOUBLE) * 100 + 0.5) as bigint) as varchar) || '%' as confidence,
       coalesce(severity, '') as severity, coalesce(evidence, '') as evidence from final""")
def export_alerts_csv_q(spark, sf_dir):
    """The final alerts exported as an all-quoted CSV and read back as text."""
    from ..sources.ledger import export_alerts_csv
    path = scratch_path(spark, "alerts-export")
    export_alerts_csv(_final(spark, sf_dir), path)
    return (spark.read.option("header", True).option("escape", '"').csv(path)
            .select("src_ip", "dst_ip", "protocol", "threat_type", "flows", "confidence", "severity", "evidence"))


@register("throughput", O.with_ctes(*O.ALERTS_FINAL) + """
select th as threats_detected, n as total_flows, na as num_alerts, 2.5::DOUBLE as processing_time_sec,
       round(n::DOUBLE / 2.5::DOUBLE, 2) as throughput_flows_per_sec
from (select (select count(*) from arb) as n, (select count(*) from threats) as th,
             (select count(*) from final) as na)""")
def throughput(spark, sf_dir):
    """E5 on a record with a processing time (2.5 s, so that both sides agree)."""
    sf = _scored(spark, sf_dir)
    stats = st.run_stats(sf.flows, processing_time_sec=2.5, with_map=False)
    return ev.detection_metrics(stats, _final(spark, sf_dir, sf)).select(
        "threats_detected", "total_flows", "num_alerts", "processing_time_sec", "throughput_flows_per_sec")


@register("run_file_roundtrip", O.with_ctes(*O.ALERTS_FINAL, O.TIMELINE) + f"""
select 'flows.csv' as filename, (select count(*) from arb) as total_flows,
       (select count(*) from threats) as threats_detected, true as timed, 20 as histogram_bins,
       (select count(*) from timeline) as timeline_bins, f.* from (select {_FINAL_COLS} from final) f""")
def run_file_roundtrip(spark, sf_dir):
    """S1-S12 composed: a flow CSV is ingested, analysed (with the forest) and
    stored by ``run_file``; the newest run's record and alerts are read back."""
    path = scratch_path(spark, "flows-csv")
    _write_csv(_flows(spark, sf_dir).orderBy("row_id").drop("row_id"), path, header=True)
    ledger = new_ledger(spark)
    reply = run_file(spark, path, ledger, filename="flows.csv")
    record = ledger.run_by_id(reply["run_id"]).select(
        "run_id", "filename", "stats.total_flows", "stats.threats_detected",
        (F.col("stats.processing_time_sec") > 0).alias("timed"),
        F.size("charts.histogram").alias("histogram_bins"), F.size("charts.threats_over_time").alias("timeline_bins"))
    return ledger.alerts_of_latest_run().join(F.broadcast(record), "run_id").drop("run_id")


@register("ground_truth_csv", "with " + O.flows_cte_duckdb() + """
select 'threat' as ground_truth, count(distinct src_ip) as sources, count(*) as flows from flows
where not contains(label, 'BENIGN') union all
select 'benign', count(distinct src_ip), count(*) from flows where contains(label, 'BENIGN')""")
def ground_truth_csv(spark, sf_dir):
    """Labelled flows written as a headered CSV, scanned and classed."""
    configure(spark)
    path = scratch_path(spark, "truth-csv")
    _write_csv(labelled_flows(spark, sf_dir).drop("row_id"), path, header=True)
    truth = ev.label_ground_truth(flowcsv.scan_ground_truth(spark, path))
    return truth.groupBy("ground_truth").agg(F.count_distinct("src_ip").alias("sources"), F.count(F.lit(1)).alias("flows"))


@register("csv_default_tos", "with " + O.flows_cte_duckdb() + """
select 0 as tos, protocol, count(*) as flows from flows group by protocol""")
def csv_default_tos(spark, sf_dir):
    """Headerless lines that end before the ``tos`` field get it as 0."""
    path = scratch_path(spark, "flows-csv-tos")
    _write_csv(_flows(spark, sf_dir).select(*FLOW_COLUMNS[:5]), path, header=False)
    return flowcsv.scan_flow_csv(spark, path, header=False).groupBy("tos", "protocol").agg(F.count(F.lit(1)).alias("flows"))


@register("csv_multi_file_order", "with " + O.flows_cte_duckdb() + """
select row_number() over (order by least(part, 2), row_id) - 1 as row_id, src_ip, dst_ip, start_time
from (select *, case when row_id % 100 = 7 then 0 when row_id % 3 > 0 then 1 else 2 end as part from flows)""")
def csv_multi_file_order(spark, sf_dir):
    """Row ids of a folder of files of unequal sizes follow the file names,
    then the lines: a small first file, a large second one, a middling third
    (each several files in order where it has many rows)."""
    path = scratch_path(spark, "flows-csv-folder")
    flows = _flows(spark, sf_dir)
    part = F.when(F.col("row_id") % 100 == 7, 0).when(F.col("row_id") % 3 > 0, 1).otherwise(2)
    (_in_file_order(flows.withColumn("part", part), "part", "row_id").drop("row_id")
     .write.partitionBy("part").option("header", True).csv(path))
    files = [f"{path}/part={k}" for k in range(3)]
    got = flowcsv.read_flow_csv(spark, files, header=True)
    return got.select("row_id", "src_ip", "dst_ip", "start_time")


_TIME_CASES = (("iso", "yyyy-MM-dd'T'HH:mm:ss", 1), ("space", "yyyy-MM-dd HH:mm:ss", 1), ("minutes", "MM/dd/yyyy HH:mm", 60),
               ("words", None, None))


@register("csv_time_formats", "with " + O.flows_cte_duckdb() + ",\n" + """
r as (select *, row_number() over (order by row_id) - 1 as i from flows)
select 'iso' as format, i as row_id, floor(start_time) as start_time from r
union all select 'space', i, floor(start_time) from r
union all select 'minutes', i, floor(start_time / 60) * 60 from r
union all select 'words', i, i::DOUBLE from r""")
def csv_time_formats(spark, sf_dir):
    """C2 and C3, one CSV per time format; texts that no format reads take the
    row's index (``12:30`` is no date)."""
    flows = _flows(spark, sf_dir)
    out = None
    for name, pattern, _ in _TIME_CASES:
        path = scratch_path(spark, f"flows-csv-{name}")
        text = (F.date_format(F.timestamp_seconds("start_time"), pattern) if pattern
                else F.date_format(F.timestamp_seconds("start_time"), "HH:mm"))
        _write_csv(_in_file_order(flows.withColumn("start_time", text), "row_id").drop("row_id"), path, header=True)
        got = flowcsv.read_flow_csv(spark, path).select(F.lit(name).alias("format"), "row_id", "start_time")
        out = got if out is None else out.unionByName(got)
    return out


@register("typed_source_casts", "with " + O.flows_cte_duckdb() + """
select row_id, cast(src_port as bigint)::DOUBLE as src_port, packets, floor(start_time) as start_time,
       floor(end_time) as end_time from flows""")
def typed_source_casts(spark, sf_dir):
    """Integer ports and counters, timestamp and whole-second times of
    a typed (parquet) source."""
    path = scratch_path(spark, "typed-flows")
    typed = _flows(spark, sf_dir).select(
        "row_id", "src_ip", "dst_ip", F.col("src_port").cast("int").alias("src_port"), "dst_port", "protocol",
        F.col("packets").cast("long").alias("packets"), "bytes", "flows",
        F.timestamp_seconds("start_time").alias("start_time"), F.floor("end_time").cast("long").alias("end_time"))
    typed.write.parquet(path)
    return (flowcsv.type_flow_columns(spark.read.parquet(path))
            .select("row_id", "src_port", "packets", "start_time", "end_time"))


@register("cached_latest_alerts", O.with_ctes(*O.ALERTS_FINAL)
          + "select severity, count(*) as alerts from final group by severity")
def cached_latest_alerts(spark, sf_dir):
    """The latest alerts, queried by name."""
    from ..sources.ledger import cache_latest
    cache_latest(_final(spark, sf_dir), "flowsentry_latest_alerts")
    return spark.sql("select severity, count(*) as alerts from flowsentry_latest_alerts group by severity")


@register("forest_samples", "with " + O.flows_cte_duckdb() + """
select tree, least(256, (select count(*) from flows)) as rows from (select unnest(range(100)) as tree)""")
def forest_samples(spark, sf_dir):
    """M1: every tree draws exactly 256 rows (all, if fewer) of the whole table."""
    model = iforest.fit(with_features(_flows(spark, sf_dir)), DEFAULT_CONFIG, with_threshold=False, with_moments=False)
    return spark.createDataFrame([(t, int(n)) for t, n in enumerate(model.used)], "tree int, rows long")


@register("forest_facts", "with " + O.flows_cte_duckdb() + """
select count(*) as scored, true as in_range, true as scaled, true as share from flows""")
def forest_facts(spark, sf_dir):
    """M4-M8 by what must hold of any forest: every flow scored in (0, 1],
    scaled scores filling [0, 1], at most the contamination share labelled."""
    sf = score_flows(_flows(spark, sf_dir), DEFAULT_CONFIG, ml="intent", materialize=True)
    raw, ml = F.col("anomaly_score"), F.col("ml_score")
    return sf.flows.agg(
        F.count(raw).alias("scored"), ((F.min(raw) > 0) & (F.max(raw) <= 1)).alias("in_range"),
        ((F.min(ml) == 0) & (F.max(ml) == 1)).alias("scaled"),
        ((F.sum("ml_label") <= 0.05 * F.count(raw) + 1) & (F.sum("ml_label") > 0)).alias("share"))
