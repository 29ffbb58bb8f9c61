import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.config import DetectionConfig
from flowsentry.functions.features import feature_vector, with_features
from flowsentry.functions.rules import with_rule_scores
from flowsentry.operators.thresholds import Thresholds, adaptive_thresholds, exact_nearest_quantiles


def test_durations_and_ratios(make_flows):
    df = make_flows([
        dict(start_time=10.0, end_time=10.0),            # end = start
        dict(start_time=10.0, end_time=5.0),             # end < start
        dict(start_time=10.0, end_time=None),            # null end
        dict(packets=0.0, bytes=500.0),                  # divide by 1
        dict(bytes=None),                                # null bytes
    ])
    rows = with_features(df).orderBy("row_id").collect()
    assert rows[0].flow_duration == 0.001 and rows[1].flow_duration == 0.001
    assert rows[2].flow_duration is None and rows[2].packets_per_sec == 0.0
    assert rows[3].bytes_per_packet == 500.0
    assert rows[4].bytes_per_packet == 0.0


def test_udp_and_port_flags(make_flows):
    df = make_flows([dict(protocol="udp"), dict(protocol="17"), dict(protocol=None),
                     dict(dst_port=1024.0), dict(dst_port=1025.0), dict(dst_port=8080.0),
                     dict(dst_port=5432.0), dict(dst_port=None)])
    rows = with_features(df).orderBy("row_id").collect()
    assert [r.udp_ratio for r in rows[:3]] == [1.0, 1.0, 0.0]
    assert [r.dst_port_flag for r in rows[3:]] == [0.0, 1.0, 0.0, 0.0, 0.0]


def test_pps_clip_and_sanitize(spark):
    df = spark.createDataFrame([(1, float("nan"), float("inf"), float("-inf"), None)],
                               "row_id long, a double, b double, c double, d double")
    from flowsentry.functions.features import sanitize
    r = df.select(*[sanitize(F.col(c)).alias(c) for c in "abcd"]).first()
    assert (r.a, r.b, r.c, r.d) == (0.0, 1e9, -1e9, 0.0)


@pytest.mark.parametrize("n", [1, 2, 3, 11, 12, 31, 50, 97])
def test_nearest_rank_p95(spark, n):
    vals = [float((i * 7919) % 1000) for i in range(n)] + [None, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got, rows = exact_nearest_quantiles(df, ["v"], 0.95)
    s = np.sort([v for v in vals if v is not None])
    assert rows == n + 2
    assert got["v"] == s[int(math.floor((n - 1) * 0.95 + 0.5))]


def test_bracketed_quantile_is_exact(spark):
    vals = [float((i * 104729) % 5003) for i in range(4000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(7)
    cfg = DetectionConfig(approx_accuracy=50)
    got, _ = exact_nearest_quantiles(df, ["v"], 0.95, cfg)
    s = np.sort(vals)
    assert got["v"] == s[int(math.floor((len(vals) - 1) * 0.95 + 0.5))]


@pytest.mark.parametrize("kind", ["two values", "one hot value", "heavy tail", "infinite", "nan"])
def test_quantile_narrowing_on_ties_and_skew(spark, kind):
    rng = np.random.default_rng(5)
    n = 3000
    vals = {"two values": rng.integers(0, 2, n).astype(float),
            "one hot value": np.where(rng.random(n) < 0.9, 7.0, rng.random(n) * 1000),
            "heavy tail": np.exp(rng.normal(0, 12, n)) * rng.choice([-1, 1], n),
            "infinite": np.where(rng.random(n) < 0.1, np.inf, rng.random(n)),
            "nan": np.where(rng.random(n) < 0.2, np.nan, rng.random(n))}[kind]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(5)
    for acc, q in ((20, 0.95), (10_000, 0.95), (50, 0.0), (50, 1.0)):
        got, _ = exact_nearest_quantiles(df, ["v"], q, DetectionConfig(approx_accuracy=acc))
        s = np.sort(vals[~np.isnan(vals)])
        assert got["v"] == s[int(math.floor((len(s) - 1) * q + 0.5))]


def test_rounding_by_exact_value(spark):
    from flowsentry.functions.rounding import fixed1, round2_sql
    xs = sorted({k / 1000 for k in range(1001)} | {0.955, 0.565, 0.125, 0.375, 0.625, 0.875, 0.99, 1.0}
                | {math.nextafter(k / 200, s) for k in range(201) for s in (0, 2)})
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for r in df.selectExpr("x", f"{round2_sql('x')} AS y").collect():
        assert r.y == round(r.x, 2)
    more = [x * 5 for x in xs] + [-0.3, -2.25, 2.25, 0.25, 4.95]
    df = spark.createDataFrame([(float(x),) for x in more], "x double")
    for r in df.select("x", fixed1(F.col("x"), 5.0).alias("y")).collect():
        assert r.y == "%.1f" % r.x


def test_all_null_column_raises(make_flows):
    df = with_features(make_flows([dict(packets=None), dict(packets=None)]))
    with pytest.raises(ValueError):
        adaptive_thresholds(df)


def test_empty_input_uses_constants(make_flows):
    df = with_features(make_flows([dict()]).limit(0))
    thr = adaptive_thresholds(df)
    assert (thr.pkt_p95, thr.byt_p95, thr.bpp_p95, thr.pps_p95, thr.n_rows) == (1000.0, 100000.0, 500.0, 500.0, 0)


def _label(make_flows, **flow):
    thr = Thresholds(1, 1e12, 1e12, 1e12, 1e12)
    return with_rule_scores(with_features(make_flows([flow])), thr).first()


def test_flood_boundary(make_flows):
    assert _label(make_flows, packets=500.0).flood_score == 0
    assert _label(make_flows, packets=501.0).flood_score == 1


def test_label_separators(make_flows, spark):
    flood, exfil, large, gre = (dict(packets=501.0), dict(bytes=1e6), dict(bytes=1e6), dict(protocol="gre"))
    cases = [(flood | exfil, dict(byt_p95=1e5, bpp_p95=1e2), "Flood;;Data Exfiltration"),
             (exfil | dict(packets=1.0), dict(byt_p95=1e5, bpp_p95=1e2), "Data Exfiltration"),
             (flood | large | dict(start_time=1.0, end_time=1.5), dict(byt_p95=1e5, bpp_p95=1e9), "Flood;;;Large Flow"),
             (flood | gre, dict(byt_p95=1e12, bpp_p95=1e12), "Flood;Suspicious Protocol")]
    for flow, cuts, want in cases:
        thr = Thresholds(1, 1e12, pps_p95=1e12, **cuts)
        row = with_rule_scores(with_features(make_flows([dict(dict(start_time=0.0, end_time=9.0), **flow)])), thr).first()
        assert row.rule_threat_type == want


def test_severity_and_confidence(make_flows):
    one = _label(make_flows, packets=600.0)
    two = _label(make_flows, packets=600.0, protocol="gre")
    none = _label(make_flows)
    assert (one.rule_severity, one.rule_confidence) == ("HIGH", 0.5)
    assert (two.rule_severity, two.rule_confidence, two.rule_threat_type) == \
        ("CONFIRMED", 0.85, "Flood;Suspicious Protocol")
    assert none.rule_threat_type is None and none.rule_confidence == 0.0
    assert two.rules_fired == ["Flood", "Suspicious Protocol"] and none.rules_fired == []


def test_feature_vector_order(make_flows):
    fv = feature_vector(with_features(make_flows([dict()])))
    assert fv.columns == ["row_id", "bytes_per_packet", "packets_per_sec", "flow_duration", "udp_ratio",
                          "dst_port_flag", "packets", "bytes", "flows"]
