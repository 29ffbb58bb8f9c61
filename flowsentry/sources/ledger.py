"""Run and alert store on parquet.

Two tables under one base folder: ``runs`` (one row per analysis: run_id,
timestamp, filename, stats struct, charts struct) and ``alerts`` (the final
alerts plus ``run_id``, partitioned by ``run_id`` so reading one run prunes
every other partition).  Both are append-only; reads pick the newest run.

A run's alerts are written first and its record last: the record is the commit
mark.  Alerts whose run has no record (their writer failed, or is not done) are
seen by no reader.  The alerts are stored with the upper-case severity and
protocol that searches compare, so these filters reach the parquet scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import search_alerts

RUNS = "runs"
ALERTS = "alerts"
ALERT_COLUMNS = ("src_ip", "dst_ip", "threat_type", "protocol", "flow_count", "confidence", "severity", "evidence")
ALERTS_SCHEMA = ("src_ip string, dst_ip string, threat_type string, protocol string, flow_count bigint, "
                 "confidence double, severity string, evidence string, run_id string")
#: As stored: with the texts that searches compare (null as '').
STORED_SCHEMA = ALERTS_SCHEMA.replace("run_id string", "severity_key string, protocol_key string, run_id string")


class RunLedger:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    @property
    def runs_path(self) -> str:
        return f"{self.base}/{RUNS}"

    @property
    def alerts_path(self) -> str:
        return f"{self.base}/{ALERTS}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(p)

    # ------------------------------------------------------------ S9, S10
    def write_run(self, stats: DataFrame, histogram: DataFrame, timeline: DataFrame,
                  filename: str, run_id: str | None = None) -> str:
        """Append the run record.  ``stats`` is the one-row record; the two
        chart tables (20 and 30 rows) are folded into arrays of structs."""
        run_id = run_id or uuid.uuid4().hex
        hist = histogram.agg(F.array_sort(F.collect_list(
            F.struct("bin", "bin_start", "bin_end", "count"))).alias("histogram"))
        tl = timeline.agg(F.array_sort(F.collect_list(F.struct("bin", "time", "threat_count")))
                          .alias("threats_over_time"))
        parts = stats.select(F.struct(*stats.columns).alias("stats")) \
            .unionByName(hist, allowMissingColumns=True).unionByName(tl, allowMissingColumns=True)
        row = parts.agg(F.first("stats", ignorenulls=True).alias("stats"),
                        F.first("histogram", ignorenulls=True).alias("histogram"),
                        F.first("threats_over_time", ignorenulls=True).alias("threats_over_time"))
        record = row.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("timestamp"),
                            F.lit(filename).alias("filename"), "stats",
                            F.struct("histogram", "threats_over_time").alias("charts"))
        record.write.mode("append").parquet(self.runs_path)
        return run_id

    def write_alerts(self, alerts: DataFrame, run_id: str) -> None:
        """Append the alerts with ``run_id`` (a run without alerts adds no
        partition).  They are seen once the run's record is there."""
        key = lambda c: F.upper(F.coalesce(F.col(c), F.lit(""))).alias(f"{c}_key")
        tagged = alerts.select(*ALERT_COLUMNS, key("severity"), key("protocol")).withColumn("run_id", F.lit(run_id))
        tagged.write.mode("append").partitionBy("run_id").parquet(self.alerts_path)

    def store_run(self, stats: DataFrame, histogram: DataFrame, timeline: DataFrame, alerts: DataFrame,
                  filename: str, run_id: str | None = None) -> str:
        """S9 + S10: the alerts, then the record that makes them seen."""
        run_id = run_id or uuid.uuid4().hex
        self.write_alerts(alerts, run_id)
        return self.write_run(stats, histogram, timeline, filename, run_id)

    # ------------------------------------------------------------ reads
    def runs(self) -> DataFrame:
        return self.spark.read.parquet(self.runs_path)

    def _stored(self) -> DataFrame:
        """The alerts table as written, runs without a record too."""
        if not self._exists(self.alerts_path):
            return self.spark.createDataFrame([], STORED_SCHEMA)
        return self.spark.read.schema(STORED_SCHEMA).parquet(self.alerts_path)

    def _committed(self, stored: DataFrame) -> DataFrame:
        if not self._exists(self.runs_path):
            return stored.where(F.lit(False))
        return stored.join(self.runs().select("run_id"), "run_id", "left_semi")

    def _as_alerts(self, stored: DataFrame) -> DataFrame:
        return stored.select(*ALERT_COLUMNS, "run_id")

    def alerts(self) -> DataFrame:
        """Every alert of a run with a record; none if no run has written any."""
        return self._as_alerts(self._committed(self._stored()))

    def search(self, severity: str = "", protocol: str = "", threat_type: str = "", ip: str = "") -> DataFrame:
        """Q5 over the stored alerts; Q1-Q3 are equalities on stored columns."""
        return self._as_alerts(self._committed(search_alerts(self._stored(), severity, protocol, threat_type, ip)))

    def latest_run(self) -> DataFrame:
        """The newest run (one row; TakeOrderedAndProject)."""
        return self.runs().orderBy(F.desc("timestamp"), F.desc("run_id")).limit(1)

    def alerts_of_latest_run(self) -> DataFrame:
        """The newest run's id is one value, fetched first, so the filter on
        ``run_id`` is a literal and only that run's partition is read."""
        newest = self.latest_run().select("run_id").first() if self._exists(self.runs_path) else None
        return self._as_alerts(self._stored().where(F.col("run_id") == (newest.run_id if newest else "")))

    def latest_or_default_stats(self) -> DataFrame:
        """The newest run's stats, or the empty-store default record
        (which has no top_threat_* fields)."""
        default = self.spark.createDataFrame(
            [(0, 0, "N/A", 0, 0.0)],
            "total_flows bigint, threats_detected bigint, top_attacker_ip string, "
            "top_attacker_count bigint, processing_time_sec double")
        if not self._exists(self.runs_path):
            return default.withColumn("protocol_distribution", F.create_map().cast("map<string,bigint>"))
        return self.latest_run().select("stats.*")

    def recent_runs(self, n: int = 5) -> DataFrame:
        """S14."""
        return self.runs().orderBy(F.desc("timestamp"), F.desc("run_id")).limit(n)

    def recent_alerts(self, n: int = 20) -> DataFrame:
        """Alerts carry no timestamp, so order by their run's.  The newest
        runs are walked, twice as many each time, until ``n`` alerts are found
        or no run is left, and only their partitions are read."""
        take, ids, stored = 4, [], self._stored()
        while self._exists(self.runs_path):
            newest = self.runs().orderBy(F.desc("timestamp"), F.desc("run_id")).select("run_id").limit(take).collect()
            ids = [r.run_id for r in newest]
            # ids by the count of alerts wanted, not by the runs stored, bound this list
            if len(ids) < take or stored.where(F.col("run_id").isin(ids)).limit(n).count() >= n:
                break
            take *= 2
        if not ids:
            return self._as_alerts(stored).withColumn("timestamp", F.current_timestamp()).limit(0)
        times = self.runs().where(F.col("run_id").isin(ids)).select("run_id", "timestamp")
        return (self._as_alerts(stored.where(F.col("run_id").isin(ids))).join(times, "run_id")
                .orderBy(F.desc("timestamp"), F.desc("confidence"), "src_ip", "dst_ip", "threat_type")
                .limit(n))

    def counts(self) -> DataFrame:
        """Stored runs and alerts."""
        a = self.runs().agg(F.count(F.lit(1)).alias("runs"))
        b = self.alerts().agg(F.count(F.lit(1)).alias("alerts"))
        return a.unionByName(b, allowMissingColumns=True).agg(
            F.first("runs", ignorenulls=True).alias("runs"), F.first("alerts", ignorenulls=True).alias("alerts"))

    def alerts_by_severity(self, severity: str, n: int = 10) -> DataFrame:
        """Equality filter (pushed to the scan), the n most confident."""
        return (self._as_alerts(self._committed(self._stored().where(F.col("severity") == severity)))
                .orderBy(F.desc("confidence"), "src_ip", "dst_ip", "threat_type", "run_id").limit(n))

    def run_by_id(self, run_id: str) -> DataFrame:
        """Point lookup (parquet predicate pushdown)."""
        return self.runs().where(F.col("run_id") == run_id)

    def register_views(self) -> list[str]:
        """Expose both tables to SQL and list them."""
        names = []
        for name, path, rows in ((f"analysis_{RUNS}", self.runs_path, self.runs), (f"analysis_{ALERTS}", self.alerts_path, self.alerts)):
            if self._exists(path):
                rows().createOrReplaceTempView(name)
                names.append(name)
        return [t.name for t in self.spark.catalog.listTables() if t.name in names]


def export_alerts_csv(alerts: DataFrame, path: str) -> None:
    """8 columns, ``flow_count`` named ``flows``, confidence as a whole
    percentage, every value quoted with doubled quotes; without alerts the
    file holds the header line alone, and an earlier export is replaced."""
    out = alerts.select(
        F.coalesce(F.col("src_ip"), F.lit("")).alias("src_ip"),
        F.coalesce(F.col("dst_ip"), F.lit("")).alias("dst_ip"),
        F.coalesce(F.col("protocol"), F.lit("")).alias("protocol"),
        F.coalesce(F.col("threat_type"), F.lit("")).alias("threat_type"),
        F.coalesce(F.col("flow_count").cast("string"), F.lit("")).alias("flows"),
        F.concat(F.floor(F.coalesce(F.col("confidence"), F.lit(0.0)) * 100 + 0.5).cast("long").cast("string"),
                 F.lit("%")).alias("confidence"),
        F.coalesce(F.col("severity"), F.lit("")).alias("severity"),
        F.coalesce(F.col("evidence"), F.lit("")).alias("evidence"))
    (out.write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').csv(path))


def cache_latest(alerts: DataFrame, view: str = "latest_alerts") -> DataFrame:
    """Keep the latest result in memory and queryable by name; the result
    kept under that name before is let go."""
    spark = alerts.sparkSession
    if spark.catalog.tableExists(view):
        spark.table(view).unpersist()
    cached = alerts.persist()
    cached.createOrReplaceTempView(view)
    return cached


def new_ledger(spark: SparkSession, name: str = "ledger") -> RunLedger:
    """A ledger in a fresh folder under the session's checkpoint directory."""
    from ..session import scratch_path
    return RunLedger(spark, scratch_path(spark, name))

