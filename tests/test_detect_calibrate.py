from pyspark.sql import functions as F

from flowsentry.operators import calibrate as cal
from flowsentry.operators import detect


def _ports(n, avg_packets=1.0, null_port=False, src="10.0.0.9", dst="10.0.0.10"):
    rows = [dict(src_ip=src, dst_ip=dst, dst_port=float(1000 + i), packets=avg_packets) for i in range(n)]
    if null_port:
        rows.append(dict(src_ip=src, dst_ip=dst, dst_port=None, packets=avg_packets))
    return rows


def test_port_scan_boundaries(make_flows):
    assert _port_scan(make_flows(_ports(4))).count() == 0
    assert _port_scan(make_flows(_ports(5))).count() == 1
    # a null port counts as one distinct value
    assert _port_scan(make_flows(_ports(4, null_port=True))).count() == 1
    assert _port_scan(make_flows(_ports(6, avg_packets=4.9))).count() == 1
    assert _port_scan(make_flows(_ports(6, avg_packets=5.0))).count() == 0


def test_port_scan_evidence_rounds_like_python(make_flows):
    rows = _ports(4, avg_packets=2.0) + _ports(4, avg_packets=2.5)[:4]
    rows = [dict(r, dst_port=float(2000 + i)) for i, r in enumerate(rows)]
    ev = _port_scan(make_flows(rows)).first().evidence
    assert ev == "Scanning 8 unique destination ports with small average packet size (2.2)"  # 2.25 -> 2.2


def _flagged(flows):
    return flows, flows.count()


def _port_scan(flows):
    return detect.detect_port_scan(detect.pair_summary(flows), flows)


def _horizontal(n_dst, src="10.0.0.9"):
    return [dict(src_ip=src, dst_ip=f"172.16.0.{i}") for i in range(n_dst)]


def test_horizontal_scan_threshold(make_flows):
    for n, want in ((14, 0), (15, 1)):
        flows = make_flows(_horizontal(n))
        got = detect.detect_horizontal_scan(*_flagged(flows))
        assert got.count() == want
    flows = make_flows(_horizontal(15) + [dict(src_ip="10.1.1.1")] * 300)
    # int(0.05 * 315) = 15
    row = detect.detect_horizontal_scan(*_flagged(flows)).first()
    assert row.flow_count == 15 and row.dst_ip.startswith("172.16.0.0, 172.16.0.1, 172.16.0.10")


def test_botnet_needs_both(make_flows):
    def run(flows_n, dsts):
        rows = [dict(src_ip="10.0.0.9", dst_ip=f"172.16.1.{i % dsts}") for i in range(flows_n)]
        return detect.detect_botnet(*_flagged(make_flows(rows))).count()
    assert run(50, 31) == 0 and run(51, 30) == 0 and run(51, 31) == 1


def test_icmp_sweep(make_flows):
    one = make_flows([dict(protocol="icmp", dst_ip="1.1.1.1")] * 3)
    two = make_flows([dict(protocol="icmp", dst_ip="1.1.1.1"), dict(protocol="ICMP", dst_ip="1.1.1.2")])
    assert detect.detect_icmp_sweep(*_flagged(one)).count() == 0
    mixed = make_flows([dict(protocol="icmp", dst_ip="1.1.1.1"), dict(protocol="ICMP", dst_ip="1.1.1.2"),
                        dict(protocol="TCP", dst_ip="1.1.1.3")])
    r = detect.detect_icmp_sweep(*_flagged(mixed)).first()
    assert r.flow_count == 2 and r.protocol == "ICMP" and r.evidence.endswith("with 20.0 total packets")
    assert r.dst_ip == "1.1.1.1, 1.1.1.2"


def test_temporal_correlation(make_flows):
    rows = [dict(src_ip="a", start_time=0.0), dict(src_ip="a", start_time=60.0),
            dict(src_ip="b", start_time=0.0), dict(src_ip="b", start_time=61.0),
            dict(src_ip="c", start_time=0.0), dict(src_ip="c", start_time=100.0), dict(src_ip="c", start_time=300.0),
            dict(src_ip="d", start_time=0.0), dict(src_ip="d", start_time=100.0), dict(src_ip="d", start_time=301.0),
            dict(src_ip="e", start_time=None), dict(src_ip="e", start_time=None)]
    got = {r.src_ip: r.temporal for r in detect.temporal_correlation(make_flows(rows)).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": False}


ALERT_SCHEMA = ("src_ip string, dst_ip string, threat_type string, severity string, protocol string, "
                "flow_count long, confidence double, evidence string")


def _calibrate(spark, alerts, temporal=()):
    a = spark.createDataFrame(alerts, ALERT_SCHEMA)
    t = spark.createDataFrame(list(temporal) or [("zz", False)], "src_ip string, temporal boolean")
    return {(r.src_ip, r.threat_type): r for r in cal.calibrate(a, t).collect()}


def test_calibration_branches(spark):
    alerts = [
        ("s1", "d", "Port Scan (Aggregated)", "medium", "TCP", 9, 0.59, "x"),
        ("s2", "d", "Flood", "HIGH", "TCP", 1, 0.5, ""),
        ("s3", "d", "Flood", "CONFIRMED", "TCP", 3, 0.85, ""),
        ("s4", "d", "Flood", "CONFIRMED", "TCP", 2, 0.85, ""),
        ("s5", "d", "Flood", "CONFIRMED", "TCP", 3, 0.85, ""),
        ("s6", "d", "Flood", "HIGH", "TCP", 3, 0.5, ""),
        ("s7", "d", "Botnet Activity (High Flow Count)", "confirmed", "TCP", 60, 0.76, "b"),
    ]
    got = _calibrate(spark, alerts, [("s3", True)])
    assert [got[(s, t)].branch for (s, _, t, *_rest) in alerts] == [1, 2, 3, 4, 5, 6, 7]
    assert got[("s2", "Flood")].severity == "MONITOR"
    assert got[("s4", "Flood")].severity == "SUSPICIOUS"
    assert got[("s2", "Flood")].evidence == "Rule-based detection for Flood"


def test_monitor_confidence_steps(spark):
    alerts = [(f"s{i}", "d", "Flood", "HIGH", "TCP", 1, c, "") for i, c in enumerate([0.59, 0.60, 0.79, 0.80])]
    got = _calibrate(spark, alerts)
    raw = [got[(f"s{i}", "Flood")].confidence_raw for i in range(4)]
    want = [0.40 + 0.05 * (0.59 / 0.6), 0.45 + 0.10 * ((0.60 - 0.6) / 0.2),
            0.45 + 0.10 * ((0.79 - 0.6) / 0.2), 0.55 + 0.05 * ((0.80 - 0.8) / 0.2)]
    assert all(abs(a - b) < 1e-12 for a, b in zip(raw, want))


def test_escalation(spark):
    alerts = spark.createDataFrame([
        ("ip1", "d", "Flood", "HIGH", "TCP", 3, 0.5, ""),
        ("ip1", "d", "Brute Force", "CONFIRMED", "TCP", 3, 0.85, ""),
        ("ip2", "d", "Flood", "HIGH", "TCP", 3, 0.5, ""),
        ("ip2", "e", "Flood", "HIGH", "TCP", 3, 0.5, ""),
    ], ALERT_SCHEMA)
    t = spark.createDataFrame([("zz", False)], "src_ip string, temporal boolean")
    rows = {(r.src_ip, r.dst_ip, r.threat_type): r for r in cal.escalate(cal.calibrate(alerts, t)).collect()}
    up = rows[("ip1", "d", "Flood")]
    assert up.escalated and up.severity == "CONFIRMED"
    assert up.evidence.endswith(" (Escalated due to cross-threat pattern)")
    assert abs(up.confidence - min(0.99, round(0.55 + 0.20 * 0.5, 2) + 0.10)) < 1e-12
    assert not rows[("ip2", "d", "Flood")].escalated


def test_top_k_is_total(spark):
    rows = [(f"10.0.{i // 250}.{i % 250}", "d", "Flood", "HIGH", "TCP", 3, 0.5, "") for i in range(1001)]
    a = spark.createDataFrame(rows, ALERT_SCHEMA)
    t = spark.createDataFrame([("zz", False)], "src_ip string, temporal boolean")
    esc = cal.escalate(cal.calibrate(a, t))
    top = cal.rank_alerts(esc).collect()
    assert len(top) == 1000
    again = cal.rank_alerts(esc.repartition(7)).collect()
    assert [r.src_ip for r in top] == [r.src_ip for r in again]


def test_lists_of_a_source_of_many_destinations_come_from_small_parts(spark):
    from pyspark.sql import functions as F

    from flowsentry.operators import detect
    n = 200_000
    ip = F.concat_ws(".", F.lit("10"), *[F.shiftright("id", k).bitwiseAND(255).cast("string") for k in (16, 8, 0)])
    pairs = spark.range(n).select(F.lit("hot").alias("src_ip"), ip.alias("dst_ip"), F.when(F.col("id") % 2 == 0, 1).otherwise(0).alias("icmp_flows"))
    odd = spark.createDataFrame([("a", d, f) for d, f in (("2", 1), ("10.0.0.1", 1), (None, 1), ("", 0), ("10.0.0.10", 0), ("10.0.0.1 ", 1), ("10.0.0", 1))],
                                "src_ip string, dst_ip string, icmp_flows int")
    rows = pairs.unionByName(odd)
    parts = detect.destination_parts(rows)
    assert parts.agg(F.max(F.size(F.split("dst_list", ", ")))).first()[0] <= 3000
    got = {r.src_ip: r for r in detect.joined_lists(parts).collect()}
    whole = sorted(f"10.{k >> 16 & 255}.{k >> 8 & 255}.{k & 255}" for k in range(n))
    assert got["hot"].dst_list == ", ".join(whole)
    assert got["a"].icmp_dst_list == ", ".join(sorted(["2", "10.0.0.1", "10.0.0.1 ", "10.0.0"]))
    assert got["a"].dst_list == ", ".join(sorted(["2", "10.0.0.1", "", "10.0.0.10", "10.0.0.1 ", "10.0.0"]))
