"""Distributed isolation forest (M1-M9, M6 threshold).

* M1 training rows: all.  Each tree draws its own small subsample from the
  whole table by hash (a per-row predicate: no global sort, the same rows for
  any partitioning).
* M2-M3 moments and standard scaling: one aggregate over all rows, computed
  only where model evidence needs it.  Trees split on uniform thresholds
  between a node's min and max, so they are unchanged by per-feature affine
  scaling; fitting and scoring use the sanitised features directly.
* M4 fit, in one job over the table: one hash a row picks the rows that any
  tree may draw, about ``trees`` times a tree's share of them; only these, a number that
  does not grow with the table, get a hash ``u(row, tree)`` for each tree and go
  to the trees where it is small.  Each tree keeps its ``psi`` smallest-``u`` rows, so its
  subsample is exactly the psi picked rows of smallest hash.
  ``groupBy(tree_id).applyInPandas`` grows the trees, one group per tree of
  about ``2 psi`` rows.
* M5 score: the node table (``n_trees x (2^(depth+1)-1)`` entries, a size fixed
  by the parameters, never by the data) is broadcast to a vectorised Arrow UDF.
* M8 min-max normalisation from a global min/max.
All randomness derives from the seed, the row id and the tree id, never from
partition order, so results do not change with the cluster layout.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import DEFAULT_CONFIG, FEATURE_COLUMNS, DetectionConfig
from ..functions.features import feature_vector
from .thresholds import exact_nearest_quantiles

_EULER = 0.5772156649015329


def average_path_length(n):
    """c(n): mean unsuccessful-search path length of a binary search tree."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    out = np.where(n == 2, 1.0, out)
    big = n > 2
    out = np.where(big, 2.0 * (np.log(np.maximum(n - 1, 1)) + _EULER) - 2.0 * (n - 1) / np.maximum(n, 1), out)
    return out


def _unit_hash(seed: int, *cols) -> F.Column:
    """Uniform [0, 1) from a 64-bit hash."""
    h = F.xxhash64(*cols, F.lit(seed))
    return (h.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).cast("double")) / F.lit(float(2 ** 63))


def feature_moments(vec: DataFrame) -> dict:
    """M2: mean and population std (+1e-9) per feature."""
    aggs = []
    for c in FEATURE_COLUMNS:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = vec.agg(*aggs).first()
    return {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0) + 1e-9) for c in FEATURE_COLUMNS}


def standard_scale(vec: DataFrame, moments: dict) -> DataFrame:
    """M3."""
    return vec.select("row_id", *[((F.col(c) - F.lit(moments[c][0])) / F.lit(moments[c][1])).alias(c)
                                  for c in FEATURE_COLUMNS])


def _tree_schema() -> str:
    return "tree_id int, node int, feature int, value double, path double, used int"


def _grow(psi: int, depth: int, seed: int):
    n_nodes = 2 ** (depth + 1) - 1

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        pdf = pdf.sort_values(["__u", "row_id"]).head(psi)
        x = pdf[list(FEATURE_COLUMNS)].to_numpy(dtype="float64")
        rng = np.random.default_rng([seed, tree])
        feature = np.full(n_nodes, -1, dtype="int32")
        value = np.zeros(n_nodes)
        path = np.zeros(n_nodes)
        stack = [(0, np.arange(len(x)), 0)]
        while stack:
            node, idx, d = stack.pop()
            if d >= depth or len(idx) <= 1:
                path[node] = d + float(average_path_length(len(idx)))
                continue
            sub = x[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            varying = np.flatnonzero(hi > lo)
            if varying.size == 0:
                path[node] = d + float(average_path_length(len(idx)))
                continue
            f = int(rng.choice(varying))
            thr = float(rng.uniform(lo[f], hi[f]))
            feature[node], value[node] = f, thr
            go_left = sub[:, f] <= thr
            stack.append((2 * node + 1, idx[go_left], d + 1))
            stack.append((2 * node + 2, idx[~go_left], d + 1))
        used = np.full(n_nodes, len(x), dtype="int32")
        return pd.DataFrame({"tree_id": np.full(n_nodes, tree, dtype="int32"),
                             "node": np.arange(n_nodes, dtype="int32"),
                             "feature": feature, "value": value, "path": path, "used": used})
    return grow


@dataclass
class ForestModel:
    moments: dict
    feature: np.ndarray      # (trees, nodes) split feature, -1 at leaves
    value: np.ndarray        # (trees, nodes) split value
    path: np.ndarray         # (trees, nodes) depth + c(size) at leaves
    psi: int
    depth: int
    threshold: float = float("nan")   # raw-score cut for the contamination share
    score_min: float = float("nan")
    score_max: float = float("nan")
    used: np.ndarray = None  # (trees,) rows drawn per tree


def fit_trees(vec: DataFrame, n: int, cfg: DetectionConfig = DEFAULT_CONFIG):
    """M4 over all ``n`` rows: returns (feature, value, path, psi, depth, rows
    drawn per tree) arrays.  A tree that drew fewer than psi rows makes the draw wider, step
    by step."""
    psi = min(cfg.max_samples, n)
    depth = max(1, int(math.ceil(math.log2(max(psi, 2)))))
    trees = cfg.n_trees

    def attempt(p: float) -> pd.DataFrame:
        # one hash a row picks the rows that any tree may draw; only these get a
        # hash per tree, whose share makes p of all rows for each tree
        some = min(1.0, trees * p)
        routed = (vec.select("row_id", *FEATURE_COLUMNS)
                  .where(_unit_hash(cfg.seed, F.col("row_id"), F.lit(trees)) < F.lit(some))
                  .select("row_id", *FEATURE_COLUMNS, F.explode_outer(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree_id"))
                  .withColumn("__u", _unit_hash(cfg.seed, F.col("row_id"), F.col("tree_id"))).where(F.col("__u") < F.lit(p / some)))
        nodes = (routed.groupBy("tree_id")
                 .applyInPandas(_grow(psi, depth, cfg.seed), _tree_schema()))
        return nodes.toPandas()   # bounded: trees x (2^(depth+1)-1) rows

    p = min(1.0, (2.0 * psi + 64.0) / n) if n > 4 * psi else 1.0
    nodes = attempt(p)
    while p < 1.0 and ((nodes.groupby("tree_id")["used"].max() < psi).any() or nodes["tree_id"].nunique() < trees):
        p = min(1.0, 2.0 * p)
        nodes = attempt(p)
    nodes = nodes.sort_values(["tree_id", "node"])
    n_nodes = 2 ** (depth + 1) - 1
    shape = (trees, n_nodes)
    return (nodes["feature"].to_numpy().reshape(shape), nodes["value"].to_numpy().reshape(shape),
            nodes["path"].to_numpy().reshape(shape), psi, depth, nodes["used"].to_numpy().reshape(shape)[:, 0])


def _score_udf(bc, depth: int, psi: int):
    cpsi = float(average_path_length(psi)) or 1.0

    @F.pandas_udf(DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        feature, value, path = bc.value
        x = np.column_stack([c.to_numpy(dtype="float64") for c in cols])
        n, trees = x.shape[0], feature.shape[0]
        tix = np.arange(trees)[None, :]
        node = np.zeros((n, trees), dtype=np.int64)
        rows = np.arange(n)[:, None]
        for _ in range(depth):
            f = feature[tix, node]
            internal = f >= 0
            xv = x[rows, np.where(internal, f, 0)]
            right = xv > value[tix, node]
            node = np.where(internal, 2 * node + 1 + right, node)
        h = path[tix, node].mean(axis=1)
        return pd.Series(np.power(2.0, -h / cpsi))
    return score


def raw_scores(model: ForestModel, vec: DataFrame, spark=None) -> F.Column:
    """M5 as a Column over a frame holding the scaled features."""
    spark = spark or vec.sparkSession
    bc = spark.sparkContext.broadcast((model.feature, model.value, model.path))
    return _score_udf(bc, model.depth, model.psi)(*[F.col(c) for c in FEATURE_COLUMNS])


def fit(features: DataFrame, cfg: DetectionConfig = DEFAULT_CONFIG, n_rows: int | None = None,
        with_threshold: bool = True, with_moments: bool = True) -> ForestModel:
    """M1-M6 on a frame carrying ``row_id`` and the P-features.
    ``with_threshold`` computes the M6 cut (only needed when labelling);
    ``with_moments`` the M2 moments (only needed for model evidence)."""
    vec = feature_vector(features, cfg)
    if n_rows is None:
        n_rows = features.count()
    moments = feature_moments(vec) if with_moments else {}
    feature, value, path, psi, depth, used = fit_trees(vec, n_rows, cfg)
    model = ForestModel(moments, feature, value, path, psi, depth, used=used)
    if with_threshold:
        model.threshold = contamination_cut(vec.select(raw_scores(model, vec).alias("s")), n_rows, cfg)
    return model


def contamination_cut(scores: DataFrame, n: int, cfg: DetectionConfig = DEFAULT_CONFIG) -> float:
    """M6: the score that the contamination share of all rows exceeds, with
    linear interpolation between the two neighbouring ranks."""
    at = (n - 1) * (1.0 - cfg.contamination)
    low = int(math.floor(at))
    ranks = {"a": low, "b": min(low + 1, n - 1)}
    got, _ = exact_nearest_quantiles(scores.select(*[F.col("s").alias(c) for c in ranks]), list(ranks),
                                     {c: k / max(n - 1, 1) for c, k in ranks.items()}, cfg)
    return got["a"] + (got["b"] - got["a"]) * (at - low)


def anomaly_score(model: ForestModel, spark, cfg: DetectionConfig = DEFAULT_CONFIG) -> F.Column:
    """M5 as a Column over the raw flow features (sanitised inline)."""
    from ..functions.features import sanitize
    bc = spark.sparkContext.broadcast((model.feature, model.value, model.path))
    udf = _score_udf(bc, model.depth, model.psi)
    return udf(*[sanitize(F.col(c), cfg) for c in FEATURE_COLUMNS])


def with_raw_scores(scored: DataFrame, model: ForestModel, cfg: DetectionConfig = DEFAULT_CONFIG) -> DataFrame:
    """M5: adds ``anomaly_score`` (high = anomalous)."""
    return scored.withColumn("anomaly_score", anomaly_score(model, scored.sparkSession, cfg))


def normalise_scores(scored: DataFrame, model: ForestModel, polarity: str = "as_shipped") -> DataFrame:
    """M8, M9, M6 on a frame that already holds ``anomaly_score`` (written or
    cached, so the UDF does not run again): one min/max pass, then
    ``ml_score`` and ``ml_label`` as plain columns.

    ``polarity="intent"``: high score = anomalous, label 1 above the
    contamination cut.  ``polarity="as_shipped"``: the shipped code negates a
    score that is already high-for-anomalous and tests for a label value the
    model never emits, so ``ml_score`` is mirrored and nothing is labelled."""
    lo, hi = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    model.score_min, model.score_max = float(lo), float(hi)
    rng = (hi - lo) if hi > lo else 1.0
    s = F.col("anomaly_score")
    if polarity == "intent":
        return scored.withColumn("ml_score", (s - F.lit(lo)) / F.lit(rng)) \
                     .withColumn("ml_label", F.when(s > F.lit(model.threshold), 1).otherwise(0))
    return scored.withColumn("ml_score", (F.lit(hi) - s) / F.lit(rng)).withColumn("ml_label", F.lit(0))


def ml_hit_count(scored: DataFrame) -> DataFrame:
    """M7: flows labelled anomalous, and their share of all flows in percent."""
    return scored.agg(F.sum("ml_label").cast("long").alias("ml_hits"),
                      (F.coalesce(F.try_divide(F.sum("ml_label").cast("double") * 100.0,
                                               F.count(F.lit(1)).cast("double")), F.lit(0.0))).alias("ml_hit_percent"))
