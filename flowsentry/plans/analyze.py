"""End-to-end analysis of one flow table.

``read -> features -> thresholds (4 scalars) -> rule flags -> [forest scores]
-> write the per-flow verdict table -> arbitrate`` and then the detectors,
calibration, escalation and top-k as one lazy plan, with statistics and chart
tables beside it.  The driver only ever receives scalars (row count,
percentiles, score range, time range) and the final bounded outputs.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, DetectionConfig
from ..functions.features import with_features
from ..functions.rules import with_rule_scores
from ..operators import arbitrate as arb
from ..operators import calibrate as cal
from ..operators import detect
from ..operators import iforest
from ..operators import stats as st
from ..operators.thresholds import P95_COLUMNS, Thresholds, adaptive_thresholds, first_round
from ..session import configure, delete_scratch, scratch_path
from ..sources.flowcsv import read_flow_csv
from ..sources.ledger import RunLedger

# columns the thresholds, rules, forest, detectors, statistics and charts read
FEATURE_TABLE_COLUMNS = ("row_id", "src_ip", "dst_ip", "dst_port", "protocol", "packets", "bytes", "flows",
                         "bytes_per_packet", "packets_per_sec", "flow_duration", "udp_ratio", "dst_port_flag",
                         "start_time")


@dataclass
class ScoredFlows:
    flows: DataFrame            # features + rules + model columns + arbitration
    thresholds: Thresholds
    model: object = None        # forest model when the forest ran
    persisted: list = field(default_factory=list)
    path: str | None = None     # where the feature table was written
    scores: DataFrame | None = None   # ``ml_score`` per flow, for the histogram
    pairs: DataFrame | None = None    # the stored (src, dst) summary
    written: list = field(default_factory=list)   # scratch folders of this run
    groups: DataFrame | None = None   # the stored D1 groups (``detect.flow_groups``)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` to a scratch folder of this run and read it back."""
        out, path = _write_read(df, name)
        self.written.append(path)
        return out

    def flow_groups(self) -> DataFrame:
        """One pass over the flows for D1, D6, the run record and the range of
        the timeline; written once where the run writes its features."""
        if self.groups is None:
            self.groups = detect.flow_groups(self.flows)
            if self.path is not None:
                self.groups = self.store(self.groups, "flow-groups")
        return self.groups

    def release(self):
        """Drop the caches and the scratch tables; the frames built on them end
        here."""
        for df in self.persisted:
            df.unpersist()
        self.persisted.clear()
        for path in self.written:
            delete_scratch(self.flows.sparkSession, path)
        self.written.clear()


def run_concurrently(*tasks):
    """Run independent driver-side steps (each builds a plan and runs its
    jobs) from separate threads, so Spark schedules their stages side by
    side instead of one job after another.  Results keep the task order."""
    if len(tasks) == 1:
        return [tasks[0]()]
    with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
        futures = [pool.submit(t) for t in tasks]
        return [f.result() for f in futures]


def _write_read(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path), path


def score_flows(flows: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG,
                ml: str | None = "as_shipped", scores: DataFrame | None = None,
                inject: dict | None = None, persist: bool = True, materialize: bool = False,
                timings: dict | None = None, with_pairs: bool = False) -> ScoredFlows:
    """Per-flow part of the analysis.

    ``ml``: ``None`` skips the forest (score 0, label 0); ``"as_shipped"`` runs
    it for the score histogram but, like the shipped code, labels nothing;
    ``"intent"`` labels the top ``contamination`` share as outliers.
    ``scores``: optional ``(row_id, ml_score, ml_label)`` frame used instead of
    the forest (joined on ``row_id``); ``inject``: the same as Column
    expressions over the flow row.  Model evidence (M10) then uses the moments
    of all rows.

    ``materialize``: first write the narrow feature table as parquet under the
    session's checkpoint directory and read it back.  Thresholds, the forest
    and every later branch scan that table (in parallel, with column pruning)
    instead of re-deriving features from the source; lineage is cut, so a
    lost executor only costs tasks of the current stage; plans stay small.
    Without it, ``persist`` caches the scored frame instead.

    ``with_pairs``: also write the (src, dst) summary that D2-D5 read, beside
    the threshold job (neither needs the other).
    """
    timings = {} if timings is None else timings
    clock = [time.time()]

    def mark(name):
        now = time.time()
        timings[name] = round(now - clock[0], 3)
        clock[0] = now

    configure(flows.sparkSession)
    feats = with_features(flows, cfg)
    path, written, first = None, [], None
    if materialize:
        seen = Observation()
        feats, path = _write_read(feats.select(*FEATURE_TABLE_COLUMNS).observe(seen, *first_round(P95_COLUMNS, cfg.quantile, cfg)),
                                  "flow-features")
        first = seen.get
        written.append(path)
        mark("features_write")
    model, moments, persisted, hist_scores = None, None, [], None
    side = [lambda: _write_read(detect.pair_summary(feats), "flow-pairs")] if with_pairs else []
    supplied = scores is not None or inject is not None
    if not supplied and ml is not None:
        # the forest does not depend on the thresholds: fit it alongside them
        n_rows = feats.count() if first is None else first["rows"]
        def fit():   # the label cut is taken later, from the stored scores
            return iforest.fit(feats, cfg, n_rows=n_rows, with_threshold=False, with_moments=ml == "intent")

        thr, model, *stored = run_concurrently(lambda: adaptive_thresholds(feats, cfg, first),
                                               (fit if n_rows > 0 else (lambda: None)), *side)
        mark("thresholds_and_forest_fit")
    else:
        thr, *stored = run_concurrently(lambda: adaptive_thresholds(feats, cfg, first), *side)
        mark("thresholds")
    pairs = None
    if stored:
        pairs, pairs_path = stored[0]
        written.append(pairs_path)
    scored = with_rule_scores(feats, thr)
    if scores is not None:
        scored = scored.join(scores.select("row_id", "ml_score", "ml_label"), "row_id", "left")
    for name, col in (inject or {}).items():
        scored = scored.withColumn(name, col)
    if supplied and thr.n_rows > 0:
        vec = iforest.feature_vector(feats, cfg)
        moments = iforest.feature_moments(vec)
    run_forest = not supplied and ml is not None and thr.n_rows > 0
    if run_forest and ml == "intent":
        # labels feed every branch: score once into the verdict table
        moments = model.moments
        scored = iforest.with_raw_scores(scored, model, cfg)
        if materialize:
            scored, scored_path = _write_read(scored, "scored-flows")
            written.append(scored_path)
        else:
            scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
            persisted.append(scored)
        model.threshold = iforest.contamination_cut(scored.select(F.col("anomaly_score").alias("s")), thr.n_rows, cfg)
        scored = iforest.normalise_scores(scored, model, "intent")
        mark("score_and_range")
    elif run_forest:
        # as shipped nothing is labelled, so only the histogram reads scores:
        # a one-column frame, cached for the range pass and the histogram
        raw = feats.select(iforest.anomaly_score(model, feats.sparkSession, cfg).alias("anomaly_score")) \
                   .persist(StorageLevel.MEMORY_AND_DISK)
        persisted.append(raw)
        hist_scores = iforest.normalise_scores(raw, model, "as_shipped")
        scored = scored.withColumn("ml_score", F.lit(0.0)).withColumn("ml_label", F.lit(0))
        mark("score_range")
    elif not materialize and persist:
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
        persisted.append(scored)
    out = arb.arbitrate(scored, cfg, moments=moments)
    return ScoredFlows(out, thr, model, persisted, path, hist_scores if hist_scores is not None else out,
                       pairs, written)


def alerts_before_cut(sf: ScoredFlows, cfg: DetectionConfig = DEFAULT_CONFIG) -> DataFrame:
    """Every calibrated and escalated alert.  The pair summary
    and the calibrated alerts are read by several branches, so a run that
    writes its features writes them too, once each."""
    threats = arb.threat_flows(sf.flows)
    groups = sf.flow_groups().where(F.col("threat_type").isNotNull())
    if sf.path is not None and sf.pairs is None:
        sf.pairs = sf.store(detect.pair_summary(sf.flows), "flow-pairs")
    raw = detect.union_alerts(sf.flows, threats, sf.thresholds.n_rows, cfg, groups, sf.pairs)
    temporal = detect.temporal_correlation(threats, cfg, groups)
    calibrated = cal.calibrate(raw, temporal)
    if sf.path is not None:
        calibrated = sf.store(calibrated, "calibrated-alerts")
    return cal.escalate(calibrated)


def final_alerts(sf: ScoredFlows, cfg: DetectionConfig = DEFAULT_CONFIG) -> DataFrame:
    """K8 on top of :func:`alerts_before_cut`."""
    return cal.rank_alerts(alerts_before_cut(sf, cfg), cfg)


@dataclass
class AnalysisResult:
    stats: DataFrame              # one row (A7)
    alerts: DataFrame             # every final alert, 8 columns
    histogram: DataFrame          # A8
    threats_over_time: DataFrame  # A9/A10
    scored: ScoredFlows
    ranked: DataFrame = None      # the first max_alerts by rank (K8), 8 columns

    def release(self):
        self.scored.release()


def analyze_and_collect(flows: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG, ml: str | None = "as_shipped",
                        materialize: bool = True, timings: dict | None = None):
    """:func:`analyze`, then the four outputs built and collected
    concurrently (each is small: the K8 view of 1000 alerts, one record, 20 + 30 bins;
    all alerts stay a table, ``result.alerts``).
    As shipped, no flow is labelled, so only the histogram depends on the
    forest: fitting and scoring then run alongside the alert job instead of
    before it.  Returns ``(result, {"ranked": rows, "stats": rows,
    "histogram": rows, "threats_over_time": rows})``."""
    timings = {} if timings is None else timings
    overlap = ml == "as_shipped" and materialize
    sf = score_flows(flows, cfg, ml=None if overlap else ml, materialize=materialize, timings=timings,
                     with_pairs=materialize)
    t = time.time()
    threats = arb.threat_flows(sf.flows)
    built, lock = {}, Lock()

    def groups():
        """Written by the first that needs them; the histogram does not wait."""
        with lock:
            return sf.flow_groups()

    def alerts():
        groups()
        every = alerts_before_cut(sf, cfg)
        built["alerts"] = every.select(*cal.FINAL_COLUMNS)
        built["ranked"] = cal.rank_alerts(every, cfg).select(*cal.FINAL_COLUMNS)
        return built["ranked"].collect()

    def stats():
        built["stats"] = st.run_stats(sf.flows, groups=groups())
        return built["stats"].collect()

    def histogram():
        scores = sf.scores
        if overlap and sf.thresholds.n_rows > 0:
            feats = sf.flows.sparkSession.read.parquet(sf.path)
            model = iforest.fit(feats, cfg, n_rows=sf.thresholds.n_rows, with_threshold=False, with_moments=False)
            raw = feats.select(iforest.anomaly_score(model, feats.sparkSession, cfg).alias("anomaly_score")) \
                       .persist(StorageLevel.MEMORY_AND_DISK)
            sf.persisted.append(raw)
            sf.model = model
            scores = iforest.normalise_scores(raw, model, "as_shipped")
            sf.scores = scores
        built["histogram"] = st.score_histogram(scores, "ml_score", cfg.histogram_bins)
        return built["histogram"].collect()

    def timeline():
        built["threats_over_time"] = st.threats_over_time(threats, cfg, st.grouped_time_range(groups()))
        return built["threats_over_time"].collect()

    names = ("ranked", "stats", "histogram", "threats_over_time")
    rows = dict(zip(names, run_concurrently(alerts, stats, histogram, timeline)))
    timings["outputs"] = round(time.time() - t, 3)
    # the record's processing time (A7), known only once everything is collected
    elapsed = round(sum(v for k, v in timings.items() if isinstance(v, (int, float))), 3)
    rows["stats"] = [dict(r.asDict(), processing_time_sec=elapsed) for r in rows["stats"]]
    res = AnalysisResult(built["stats"], built["alerts"], built["histogram"], built["threats_over_time"],
                         sf, built["ranked"])
    return res, rows


def analyze(flows: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG, ml: str | None = "as_shipped",
            materialize: bool = True, timings: dict | None = None) -> AnalysisResult:
    """The whole run on one flow table; outputs are lazy frames."""
    timings = {} if timings is None else timings
    sf = score_flows(flows, cfg, ml=ml, materialize=materialize, timings=timings, with_pairs=materialize)
    t = time.time()
    every = alerts_before_cut(sf, cfg)
    alerts = every.select(*cal.FINAL_COLUMNS)
    ranked = cal.rank_alerts(every, cfg).select(*cal.FINAL_COLUMNS)
    threats = arb.threat_flows(sf.flows)
    stats = st.run_stats(sf.flows, groups=sf.flow_groups())
    hist = st.score_histogram(sf.scores, "ml_score", cfg.histogram_bins)
    timeline = st.threats_over_time(threats, cfg, st.grouped_time_range(sf.flow_groups()))
    timings["plan_outputs"] = round(time.time() - t, 3)
    return AnalysisResult(stats, alerts, hist, timeline, sf, ranked)


def run_file(spark: SparkSession, path: str, ledger: RunLedger, cfg: DetectionConfig = DEFAULT_CONFIG,
             ml: str | None = "as_shipped", filename: str | None = None) -> dict:
    """From a flow CSV (file or folder) to a stored run: ingest, analysis, run
    record with its processing time, alerts.  Returns the run id and the
    record's ``total_flows``, ``threats_detected`` and ``processing_time_sec``.
    The record and both charts are small collected tables; the alerts go from
    their table to the store without passing the driver."""
    t = time.time()
    written: list = []
    res, rows = analyze_and_collect(read_flow_csv(spark, path, written=written), cfg, ml)
    res.scored.written += written
    seconds = round(time.time() - t, 3)
    names = res.stats.columns
    stats = spark.createDataFrame([tuple(r[c] for c in names) for r in rows["stats"]], res.stats.schema)
    stats = stats.withColumn("processing_time_sec", F.lit(seconds))
    charts = [spark.createDataFrame(rows[k], df.schema)
              for k, df in (("histogram", res.histogram), ("threats_over_time", res.threats_over_time))]
    run_id = ledger.store_run(stats, *charts, res.alerts, filename or path.rstrip("/").rsplit("/", 1)[-1])
    res.release()
    record = rows["stats"][0]
    return {"run_id": run_id, "total_flows": record["total_flows"],
            "threats_detected": record["threats_detected"], "processing_time_sec": seconds}
