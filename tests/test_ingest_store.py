import os
import tempfile

import pytest

from flowsentry.sources import flowcsv
from flowsentry.sources.ledger import RunLedger, export_alerts_csv

HEADER = "src_ip,dst_ip,src_port,dst_port,protocol,tos,packets,bytes,flows,start_time,end_time"


def _csv(text):
    d = tempfile.mkdtemp(prefix="flowsentry-test-")
    p = os.path.join(d, "f.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_store_without_alerts_and_export_of_none(spark, make_flows, tmp_path):
    from flowsentry.sources.ledger import ALERTS_SCHEMA, RunLedger, export_alerts_csv
    ledger = RunLedger(spark, str(tmp_path / "store"))
    assert ledger.alerts().count() == 0 and ledger.alerts_by_severity("HIGH").count() == 0
    none = spark.createDataFrame([], ALERTS_SCHEMA).drop("run_id")
    one = spark.createDataFrame([("a", "b", "Flood", "TCP", 1, 0.5, "HIGH", "x")], none.schema)
    path = str(tmp_path / "out.csv")
    export_alerts_csv(one, path)
    export_alerts_csv(none, path)
    assert spark.read.option("header", True).csv(path).count() == 0


def test_numbers_and_times_are_read_strictly(spark):
    from flowsentry.sources.flowcsv import _iso_time, _number
    text = spark.createDataFrame([(t,) for t in ("5d", "7f", "12", " -3.5e2", "2024", "12:30", "2024-01-02",
                                                 "2024-01-02 03:04:05", "2024-01-02T03:04:05.5Z")], "v string")
    rows = text.select(_number("v").alias("n"), F_unix(_iso_time("v")).alias("t")).collect()
    assert [r.n for r in rows] == [None, None, 12.0, -350.0, 2024.0, None, None, None, None]
    assert [r.t for r in rows] == [None] * 6 + [1704153600, 1704164645, 1704164645]


def F_unix(c):
    from pyspark.sql import functions as F
    return F.unix_seconds(c)


def test_header_detection_is_case_insensitive_but_validation_is_not(spark):
    p = _csv(HEADER.upper() + "\n1,2,3,4,TCP,0,5,6,7,8,9\n")
    assert flowcsv.detect_header(spark, p)
    with pytest.raises(ValueError):
        flowcsv.read_flow_csv(spark, p)


def test_headerless_ten_fields_misses_end_time(spark):
    p = _csv("1.1.1.1,2.2.2.2,3,4,TCP,5,6,7,8,9\n")
    with pytest.raises(ValueError, match="end_time"):
        flowcsv.read_flow_csv(spark, p)


def test_ragged_lines_and_bad_values(spark):
    p = _csv(HEADER + "\n"
             " 10.0.0.1 ,b,1,2,TCP,0,5,6,1,100,101,EXTRA\n"
             "10.0.0.2,b,1,2,TCP\n"
             "10.0.0.3,b,1,2,TCP,0,x5,6,1,100,101\n")
    rows = flowcsv.read_flow_csv(spark, p).orderBy("row_id").collect()
    assert rows[0].src_ip == "10.0.0.1" and rows[0].packets == 5.0
    assert rows[1].packets is None and rows[1].end_time is None
    assert rows[2].packets is None                                  # one bad value: that row only
    zero = flowcsv.read_flow_csv(spark, p, on_bad="zero_column").orderBy("row_id").collect()
    assert [r.packets for r in zero] == [0.0, 0.0, 0.0]             # compatibility: whole column 0.0
    assert [r.row_id for r in rows] == [0, 1, 2]


def test_time_formats(spark):
    iso = _csv(HEADER + "\na,b,1,2,TCP,0,1,1,1,2024-07-01 12:30:00.5,2024-07-01T12:30:05\n")
    r = flowcsv.read_flow_csv(spark, iso).first()
    assert r.start_time == 1719837000.0 and r.end_time == 1719837005.0
    us = _csv(HEADER + "\na,b,1,2,TCP,0,1,1,1,07/01/2024 12:30,07/01/2024 12:31\n")
    r = flowcsv.read_flow_csv(spark, us).first()
    assert r.start_time == 1719837000.0 and r.end_time == 1719837060.0
    bad = _csv(HEADER + "\na,b,1,2,TCP,0,1,1,1,2024-07-01 12:30:00,nope\n"
                        "a,b,1,2,TCP,0,1,1,1,2024-07-01 12:30:00,2024-07-01 12:30:00\n")
    rows = flowcsv.read_flow_csv(spark, bad).orderBy("row_id").collect()
    assert [r.end_time for r in rows] == [0.0, 1.0]                  # whole column falls to the row index


def test_select_input_files(spark):
    p = _csv(HEADER + "\n")
    d = os.path.dirname(p)
    open(os.path.join(d, "notes.txt"), "w").write("x")
    got = flowcsv.select_input_files(spark, d).collect()
    assert [os.path.basename(r.path) for r in got] == ["f.csv"]


def test_ledger_roundtrip_and_export(spark):
    base = tempfile.mkdtemp(prefix="flowsentry-ledger-")
    led = RunLedger(spark, base)
    assert led.latest_or_default_stats().first().top_attacker_ip == "N/A"
    stats = spark.createDataFrame([(10, 2, "1.1.1.1", 2, "Flood", 2)],
                                  "total_flows long, threats_detected long, top_attacker_ip string, "
                                  "top_attacker_count long, top_threat_type string, top_threat_count long")
    hist = spark.createDataFrame([(0, 0.0, 0.05, 3)], "bin int, bin_start double, bin_end double, count long")
    tl = spark.createDataFrame([(0, "N/A", 0)], "bin int, time string, threat_count long")
    alerts = spark.createDataFrame([("1.1.1.1", "2.2.2.2", "Flood", "TCP", 2, 0.55, "HIGH", 'say "hi", ok')],
                                   "src_ip string, dst_ip string, threat_type string, protocol string, "
                                   "flow_count long, confidence double, severity string, evidence string")
    r1 = led.store_run(stats, hist, tl, alerts, "a.csv")
    r2 = led.store_run(stats, hist, tl, alerts.limit(0), "b.csv")     # empty: nothing written
    assert led.latest_run().first().run_id == r2
    assert led.alerts_of_latest_run().count() == 0
    assert led.run_by_id(r1).first().filename == "a.csv"
    assert led.counts().first().asDict() == {"runs": 2, "alerts": 1}
    assert led.alerts_by_severity("HIGH").count() == 1
    assert led.recent_alerts().count() == 1 and led.recent_runs().count() == 2
    assert sorted(led.register_views()) == ["analysis_alerts", "analysis_runs"]
    out = os.path.join(base, "export")
    export_alerts_csv(alerts, out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert '"say ""hi"", ok"' in text and '"55%"' in text and '"flows"' in text


def test_typed_sources_cast(spark):
    import datetime
    df = spark.createDataFrame(
        [(0, "a", "b", 1, 2, "TCP", 3, 4, 5, datetime.datetime(2024, 7, 1, 12, 30), 1719837060)],
        "row_id long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, packets int, "
        "bytes int, flows int, start_time timestamp, end_time long")
    r = flowcsv.type_flow_columns(df).first()
    assert r.start_time == 1719837000.0 and r.end_time == 1719837060.0 and r.packets == 3.0


def _charts(spark):
    stats = spark.createDataFrame([(1, 1)], "total_flows long, threats_detected long")
    hist = spark.createDataFrame([(0, 0.0, 1.0, 1)], "bin int, bin_start double, bin_end double, count long")
    return stats, hist, spark.createDataFrame([(0, "N/A", 0)], "bin int, time string, threat_count long")


def _alerts(spark, *sources):
    return spark.createDataFrame([(s, "b", "Flood", "tcp", 1, 0.5, "High", "x") for s in sources],
                                 "src_ip string, dst_ip string, threat_type string, protocol string, flow_count long, "
                                 "confidence double, severity string, evidence string")


def test_a_run_that_fails_between_the_writes_is_seen_by_no_reader(spark, tmp_path):
    ledger = RunLedger(spark, str(tmp_path / "store"))
    ledger.write_alerts(_alerts(spark, "lost"), "first-try")            # no record follows
    assert ledger.alerts().count() == 0 and ledger.alerts_of_latest_run().count() == 0 and ledger.recent_alerts().count() == 0
    done = ledger.store_run(*_charts(spark), _alerts(spark, "old"), "a.csv")
    ledger.write_alerts(_alerts(spark, "new"), "failed")
    assert ledger.latest_run().first().run_id == done
    for rows in (ledger.alerts(), ledger.alerts_of_latest_run(), ledger.recent_alerts(), ledger.search(severity="high"),
                 ledger.alerts_by_severity("High")):
        assert [r.src_ip for r in rows.collect()] == ["old"]
    assert ledger.counts().first().alerts == 1


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_searches_reach_the_scan(spark, tmp_path):
    ledger = RunLedger(spark, str(tmp_path / "store"))
    run = ledger.store_run(*_charts(spark), _alerts(spark, "a"), "a.csv")
    plan = _plan(ledger.search("high", "TCP", "Flood"))
    for column, value in (("severity_key", "HIGH"), ("protocol_key", "TCP"), ("threat_type", "Flood")):
        assert f"EqualTo({column},{value})" in plan
    assert [r.src_ip for r in ledger.search("high", "TCP", "Flood", "a").collect()] == ["a"]
    assert run in _plan(ledger.recent_alerts()).split("PartitionFilters: [")[1].split("]")[0]


def test_recent_alerts_walk_past_runs_without_alerts(spark, tmp_path):
    ledger = RunLedger(spark, str(tmp_path / "store"))
    ledger.store_run(*_charts(spark), _alerts(spark, "a", "b"), "old.csv")
    for k in range(6):
        ledger.store_run(*_charts(spark), _alerts(spark, "c").limit(0), f"{k}.csv")
    assert [r.src_ip for r in ledger.recent_alerts(5).collect()] == ["a", "b"]


def test_csv_is_read_twice_and_formats_are_told_by_shape(spark, monkeypatch):
    import re

    from flowsentry.config import TIME_FORMATS
    shapes = [re.compile(flowcsv.format_shape(f)) for f in TIME_FORMATS]
    fits = lambda t: [k for k, s in enumerate(shapes) if s.match(t)]
    assert fits("2024-01-02 03:04:05") == [0, 2] and fits("2024-01-02T03:04:05.5") == [3]
    assert fits("01/02/2024 03:04") == [4] and fits("31/12/2024 03:04:05") == [5] and fits("12:30") == []
    reads = []
    real = flowcsv._fitting_formats
    monkeypatch.setattr(flowcsv, "_fitting_formats", lambda df, probe: reads.append(real(df, probe)) or reads[-1])
    line = "1.1.1.1,2.2.2.2,3,4,TCP,0,5,6,7,{},{}\n"
    for text, expected in (("1700000000", {}), ("2024-01-02 03:04:05", {}), ("12:30", {}),
                           ("31/12/2024 03:04:05", {"start_time": TIME_FORMATS[5], "end_time": TIME_FORMATS[5]})):
        written = []
        df = flowcsv.read_flow_csv(spark, _csv(HEADER + "\n" + line.format(text, text) * 3), written=written)
        assert reads[-1] == expected and len(written) == 1 and df.count() == 3
        assert [r.row_id for r in df.select("row_id").orderBy("row_id").collect()] == [0, 1, 2]


def _ordered_flows(monkeypatch, make_flows, tmp_path, n=1200):
    """The catalog on flows of its own, in files of about 100 rows under tmp_path."""
    from flowsentry.plans import catalog
    rows = [dict(row_id=i + i // 5, src_ip=f"10.0.0.{i}", dst_ip=f"10.1.0.{i}", start_time=1.7e9 + 61.0 * i, end_time=1.7e9 + 62.0 * i)
            for i in range(n)]
    flows = make_flows([rows[i * 7 % n] for i in range(n)]).repartition(5)
    monkeypatch.setattr(catalog, "_flows", lambda spark, sf_dir: flows)
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(catalog, "ROWS_PER_FILE", 100, raising=False)
    return catalog.queries(), rows


def _rows_per_file(folder):
    return [len(p.read_text().splitlines()) - 1 for p in sorted(folder.rglob("*.csv"))]


def test_time_format_files_are_ordered_parts(spark, make_flows, monkeypatch, tmp_path):
    queries, rows = _ordered_flows(monkeypatch, make_flows, tmp_path)
    got = queries["csv_time_formats"](spark, "").collect()
    step = {"iso": 1, "space": 1, "minutes": 60}
    assert len(got) == 4 * len(rows)
    for name in (*step, "words"):
        times = [r.start_time for r in sorted((r for r in got if r.format == name), key=lambda r: r.row_id)]
        assert times == [r["start_time"] // step[name] * step[name] if name in step else i for i, r in enumerate(rows)]
        sizes = _rows_per_file(tmp_path / f"flows-csv-{name}")
        assert sum(sizes) == len(rows) and max(sizes) < 250      # no task sorts the whole table


def test_files_of_a_folder_are_ordered_parts(spark, make_flows, monkeypatch, tmp_path):
    queries, rows = _ordered_flows(monkeypatch, make_flows, tmp_path)
    got = queries["csv_multi_file_order"](spark, "").orderBy("row_id").collect()
    part = lambda k: 0 if k % 100 == 7 else 1 if k % 3 > 0 else 2
    want = sorted(rows, key=lambda r: (part(r["row_id"]), r["row_id"]))
    assert [tuple(r) for r in got] == [(i, r["src_ip"], r["dst_ip"], r["start_time"]) for i, r in enumerate(want)]
    for k in range(3):
        sizes = _rows_per_file(tmp_path / "flows-csv-folder" / f"part={k}")
        assert sum(sizes) == sum(part(r["row_id"]) == k for r in rows) and max(sizes, default=0) < 250


def test_summed_files_are_written_without_a_sort(spark, make_flows, monkeypatch, tmp_path):
    from pyspark.sql.readwriter import DataFrameWriter
    queries, rows = _ordered_flows(monkeypatch, make_flows, tmp_path)
    partitioned = []
    real = DataFrameWriter.partitionBy
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *c: partitioned.append(c) or real(self, *c))
    got = {r.folder: (r.files, r.bytes) for r in queries["input_files_summary"](spark, "").collect()}
    lines = {str(k): [f"{r['src_ip']},{r['dst_ip']},1000\n" for r in rows if r["row_id"] % 3 == k] for k in range(3)}
    assert got == {k: (1, len("src_ip,dst_ip,bytes\n") + sum(map(len, v))) for k, v in lines.items()}
    assert not partitioned      # such a write sorts a task's rows by folder first
