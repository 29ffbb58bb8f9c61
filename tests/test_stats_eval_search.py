from pyspark.sql import functions as F

from flowsentry.operators import evaluate as ev
from flowsentry.operators import search as se
from flowsentry.operators import stats as st

ALERT_SCHEMA = ("src_ip string, dst_ip string, threat_type string, protocol string, flow_count long, "
                "confidence double, severity string, evidence string")


def test_protocol_distribution_folds_case(make_flows):
    df = make_flows([dict(protocol="tcp"), dict(protocol="TCP"), dict(protocol=None)])
    got = {r.protocol: r["count"] for r in st.protocol_distribution(df).collect()}
    assert got == {"TCP": 2, "NONE": 1}
    m = st.protocol_distribution_map(df).first().protocol_distribution
    assert m == {"TCP": 2, "NONE": 1}


def test_score_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (1.0,), (0.15,)], "ml_score double")
    got = {r.bin: r["count"] for r in st.score_histogram(df).collect() if r["count"]}
    # 0.15 sits below the generated edge 3 * 0.05 = 0.15000000000000002, so bin 2
    assert got == {0: 1, 1: 1, 19: 1, 2: 1}


def test_timeline_all_equal_and_empty(make_flows):
    same = make_flows([dict(start_time=100.0), dict(start_time=100.0)])
    rows = st.threats_over_time(same).collect()
    assert len(rows) == 30 and [r.threat_count for r in rows if r.bin == 0] == [2]
    assert rows[0].time == "T+0.0s"
    empty = st.threats_over_time(same.limit(0)).collect()
    assert [(r.time, r.threat_count) for r in empty] == [("N/A", 0)]


def test_run_stats_defaults(make_flows):
    from flowsentry.operators.arbitrate import arbitrate
    df = make_flows([dict()]).withColumn("rule_threat_type", F.lit(None).cast("string")) \
        .withColumn("rule_severity", F.lit(None).cast("string")).withColumn("rule_confidence", F.lit(0.0))
    r = st.run_stats(arbitrate(df)).first()
    assert (r.total_flows, r.threats_detected, r.top_attacker_ip, r.top_attacker_count,
            r.top_threat_type) == (1, 0, "N/A", 0, "N/A")


def test_accuracy_edge_cases(spark):
    truth = spark.createDataFrame([("1.1.1.1", "BENIGN"), ("1.1.1.1", "THREAT_X"), ("2.2.2.2", "BENIGN")],
                                  "src_ip string, label string")
    truth = ev.label_ground_truth(truth)
    alerts = spark.createDataFrame([("1.1.1.1", "d", "Flood", "TCP", 1, 0.5, "HIGH", "")], ALERT_SCHEMA)
    r = ev.accuracy(truth, alerts, rounded=False).first()
    # the address is in both classes: counted as a true positive and a false positive
    assert (r.true_positives, r.false_positives, r.true_negatives, r.false_negatives) == (1, 1, 1, 0)
    none = ev.accuracy(truth, alerts.limit(0), rounded=False).first()
    assert none.precision == 0.0 and none.recall == 0.0 and none.f1_score == 0.0
    only_threat = ev.label_ground_truth(spark.createDataFrame([("3.3.3.3", None)], "src_ip string, label string"))
    r = ev.accuracy(only_threat, alerts, rounded=False).first()
    assert r.false_positive_rate == 0.0 and r.threat_count if hasattr(r, "threat_count") else True
    gate = ev.accuracy_gate(ev.accuracy(truth, alerts)).first()
    assert gate.passed is False


def test_search_is_literal_and_case_insensitive(spark):
    a = spark.createDataFrame([("10.0.0.1", "172.16.0.1, 172.16.0.2", "Flood", "tcp", 1, 0.5, "Confirmed", ""),
                               ("10.9.9.9", "8.8.8.8", "Flood", None, 1, 0.5, "HIGH", "")], ALERT_SCHEMA)
    assert se.search_alerts(a, severity="CONFIRMED", protocol="TCP").count() == 1
    assert se.search_alerts(a, severity=".*").count() == 0
    assert se.search_alerts(a, ip=" 172.16 ").count() == 1
    assert se.search_alerts(a, protocol="udp").count() == 0
    ex = se.explode_dst_ips(a).orderBy("src_ip", "position").collect()
    assert [r.destination for r in ex] == ["172.16.0.1", "172.16.0.2", "8.8.8.8"]
    pv = {r.src_ip: (r.preview, r.more) for r in se.dst_ip_preview(a).collect()}
    assert pv["10.0.0.1"] == (["172.16.0.1", "172.16.0.2"], 0)
    hist = {r.bin: r["count"] for r in se.confidence_histogram(a).collect() if r["count"]}
    assert hist == {10: 2}
