"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is built by splitting a bounded sample again and again into
``branch`` clusters until a cluster holds few vectors.  Every vector is then
put into the leaf of the nearest centre at each level.  A query walks the tree
best-bin-first: a priority queue holds the branches not taken, ordered by
their centre's inner product with the query, and the best is opened next
until the allowed number of leaves is reached.

How many leaves that is, is calibrated: a sample of queries is answered by
brute force over all rows, in Spark, and the number of leaves is widened until
the true neighbours lie in the visited leaves as often as ``recall`` asks.

Neighbouring leaves are put together to cells of at most ``block_rows`` rows,
and searching is a join of queries and cells: a query reaches a cell once, with
the numbers of the leaves it visits there.  A larger leaf - even one vector
copied without end - is a cell of several blocks, and queries reach every block
of it; a cell that very many queries visit is met by them in parts of about
``part_queries`` each.  Block results are the exact inner products in double
precision; the best of each block meet in one small aggregation per query.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do null ids.  Repeated rows are
candidates as often as they come; ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage_table, unit_hash


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, vec (array of double) of the rows that take part."""
    v = F.col("vec")
    sound = F.col("vec").isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull()).where(sound)
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    return rows.where(F.size("vec") == (sizes.dim if sizes else -1))


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    """Centres of spherical k-means; fewer if some have no members."""
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centre.T - 0.5 * (centre ** 2).sum(axis=1), axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        centre = total[n > 0] / n[n > 0][:, None]
        k = len(centre)
    return centre


class KMeansTree:
    """``children[n]`` are a node's children (None: a leaf), ``centres[n]``
    their centres; ``leaf[n]`` numbers the leaves."""

    def __init__(self, sample: np.ndarray, branch: int = 16, leaf_rows: int = 40, seed: int = 11):
        self.children, self.centres, self.leaf = [], [], []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        todo = [(self._node(), sample, 0)]
        while todo:
            node, x, depth = todo.pop()
            distinct = np.unique(x, axis=0) if len(x) > leaf_rows else x
            if len(x) <= leaf_rows or len(distinct) < 2 or depth >= 12:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            centre = _kmeans(distinct, min(branch, len(distinct), -(-len(x) // leaf_rows)), rng)
            own = self._nearest(x, centre)
            if len(centre) < 2 or len(set(own.tolist())) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            self.centres[node] = centre
            self.children[node] = [self._node() for _ in centre]
            todo += [(c, x[own == k], depth + 1) for k, c in enumerate(self.children[node])]

    def _node(self) -> int:
        self.children.append(None)
        self.centres.append(None)
        self.leaf.append(-1)
        return len(self.children) - 1

    @staticmethod
    def _nearest(x, centre):
        return np.argmax(x @ centre.T - 0.5 * (centre ** 2).sum(axis=1), axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None:
                out[rows] = self.leaf[node]
                continue
            own = self._nearest(x[rows], self.centres[node])
            todo += [(c, rows[own == k]) for k, c in enumerate(self.children[node]) if (own == k).any()]
        return out

    def visit(self, q: np.ndarray, leaves: int) -> list[int]:
        """Best-bin-first: the leaves in the order the queue gives them."""
        out, queue, count = [], [(-np.inf, 0, 0)], 0
        while queue and len(out) < leaves:
            _, _, node = heapq.heappop(queue)
            while self.children[node] is not None:
                score = self.centres[node] @ q
                best = int(np.argmax(score))
                for k, child in enumerate(self.children[node]):
                    if k != best:
                        count += 1
                        heapq.heappush(queue, (-score[k], count, child))
                node = self.children[node][best]
            out.append(self.leaf[node])
        return out


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _to_leaves(shared):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column("vec"))
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(x)), batch.column("vec_id"), batch.column("vec")],
                                                 names=["leaf", "vec_id", "vec"])
    return run


def cells_of(sizes: np.ndarray, block_rows: int) -> np.ndarray:
    """The cell of each leaf: leaves that follow each other in the tree, with at
    most ``block_rows`` rows together; a larger leaf is alone."""
    cells, cell, room = np.zeros(len(sizes), np.int32), -1, -1
    for leaf, n in enumerate(sizes.tolist()):
        if cell < 0 or n > room:
            cell, room = cell + 1, block_rows
        cells[leaf] = cell
        room -= n
    return cells


VISITS = "query_id long, query array<double>, floor double, cells array<struct<cell:int,leaves:array<int>>>"


def kth_best(query: int, q: np.ndarray, leaves: np.ndarray, known, k: int) -> float:
    """A score that k rows in these leaves reach without the query's id, as the
    known rows (ids, vectors, leaves) tell; minus infinity if they are fewer."""
    ids, x, leaf = known
    some = np.isin(leaf, leaves) & (ids != query)
    if some.sum() < k:
        return -np.inf
    # sums in another order differ in their last digits
    least = np.partition((x @ q)[some], -k)[-k] - 1e-9 * np.abs(q).sum() * np.abs(x).max()
    return least if np.isfinite(least) else -np.inf


def _to_visits(shared, leaves, k):
    """Each query with the cells it visits, the leaves in each, and the score
    that its results reach."""
    def run(batches):
        tree, cells, known = shared.value
        for batch in batches:
            visits, floors, ids = [], [], batch.column("vec_id").to_pylist()
            for query, q in zip(ids, _vectors(batch.column("vec"))):
                found = np.sort(np.array(tree.visit(q, leaves), np.int32))        # leaves of a cell follow each other
                edge = np.flatnonzero(np.diff(cells[found])) + 1
                visits.append([{"cell": cells[x[0]], "leaves": x} for x in np.split(found, edge)])
                floors.append(kth_best(query, q, found, known, k))
            kind = pa.list_(pa.struct([("cell", pa.int32()), ("leaves", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(floors, pa.float64()), pa.array(visits, kind)],
                                             names=["query_id", "query", "floor", "cells"])
    return run


def best_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
        return at[np.lexsort((ids[at], -score[at]))][:k]
    return np.lexsort((ids, -score))


def inner_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Double-precision inner products, each summed in the same order whatever
    the block it is worked out in."""
    return np.einsum("ij,j->i", x, q)


BEST = "query_id long, vec_id long, score double"


def _search(k):
    def run(key, rows, visits):
        import pandas as pd
        out = []
        if len(rows) and len(visits):
            rows = rows.sort_values("leaf", kind="stable")
            x, ids, leaf = np.stack(rows["vec"].to_numpy()), rows["vec_id"].to_numpy(), rows["leaf"].to_numpy()
            held = np.unique(leaf)
            for query, q, least, leaves in zip(visits["query_id"], visits["query"], visits["floor"], visits["leaves"]):
                seen = ids != query
                if len(leaves) < len(held) or not np.isin(held, leaves).all():
                    seen &= np.isin(leaf, leaves)
                other = np.flatnonzero(seen)
                score = inner_products(x[other], q)
                other, score = other[score >= least], score[score >= least]
                at = best_rows(score, ids[other], k)
                out.append((np.full(len(at), query, np.int64), ids[other[at]], score[at]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))
    return run


def top_k(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, as (query_id, rank, vec_id, score)."""
    # per query a sorted array of what its blocks found, at most blocks x k entries
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _brute(shared, k):
    """The k best rows of each batch for a bounded set of queries."""
    def run(batches):
        ids, q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _vectors(batch.column("vec")), batch.column("vec_id").to_numpy()
            score = x @ q.T
            rows = []
            for j, i in enumerate(ids):
                other = np.flatnonzero(own != i)
                at = other[best_rows(score[other, j], own[other], k)]
                rows.append((np.full(len(at), i), own[at], score[at, j], batch.column("leaf").to_numpy()[at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)],
                                             names=["query_id", "vec_id", "score", "leaf"])
    return run


def calibrate(tree: KMeansTree, rows: DataFrame, queries: DataFrame, k: int, recall: float, sample: int = 64) -> int:
    """The least number of leaves at which the visited leaves hold ``recall``
    of the true neighbours of a sample of at most ``sample`` queries."""
    spark = rows.sparkSession
    chosen = queries.orderBy(unit_hash("vec_id", seed=5), "vec_id").limit(sample).collect()
    if not chosen:
        return 1
    ids, q = [r.vec_id for r in chosen], np.array([r.vec for r in chosen])
    shared = spark.sparkContext.broadcast((ids, q))
    partial = rows.mapInArrow(_brute(shared, k), "query_id long, vec_id long, score double, leaf int")
    truth = partial.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("minus"), "vec_id", "leaf"))), 1, k).alias("best")).collect()
    vector = dict(zip(ids, q))
    needed = []
    for r in truth:
        place = {leaf: p for p, leaf in enumerate(tree.visit(vector[r.query_id], tree.leaves), 1)}
        needed += [place[b.leaf] for b in r.best]
    if not needed:
        return 1
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]


def search(table: DataFrame, is_query, k: int = 20, recall: float = 0.96, fit_rows: int = 20_000, branch: int = 16,
           leaf_rows: int = 40, block_rows: int = 2000, part_queries: int = 5000) -> DataFrame:
    """Nearest rows of ``table`` (vec_id, embedding) for its rows that satisfy
    ``is_query``: query_id, rank, vec_id, score."""
    spark = prepare(table.sparkSession)
    rows = stage_table(usable(table), "ann-vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.where(unit_hash("vec_id", seed=9) < fit_rows / n).limit(2 * fit_rows).toPandas()
    ids = sample["vec_id"].to_numpy(np.int64)
    sample = np.stack(sample["vec"].to_numpy()) if len(sample) else np.array([rows.first().vec])
    tree = KMeansTree(sample, branch, leaf_rows)
    shared = spark.sparkContext.broadcast(tree)
    placed = stage_table(rows.mapInArrow(_to_leaves(shared), "leaf int, vec_id long, vec array<double>"), "ann-leaves")
    queries = rows.where(is_query)
    leaves = calibrate(tree, placed, queries, k, recall)

    # on the driver: one number per leaf of the bounded tree, one per cell
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():
        sizes[r.leaf] = r["count"]
    cells = cells_of(sizes, block_rows)
    known = ids, sample[:len(ids)], tree.assign(sample[:len(ids)])      # the bounded sample
    walk = spark.sparkContext.broadcast((tree, cells, known))
    visits = stage_table(queries.mapInArrow(_to_visits(walk, leaves, k), VISITS), "ann-visits")
    asked = dict(visits.select(F.explode("cells.cell").alias("cell")).groupBy("cell").count().collect())
    deal = spark.createDataFrame(
        [(leaf, int(c), max(1, -(-int(n) // block_rows)), max(1, -(-asked.get(c, 0) // part_queries)))
         for leaf, (c, n) in enumerate(zip(cells.tolist(), sizes))], "leaf int, cell int, blocks int, parts int")
    # a cell of several leaves is one block
    own = F.broadcast(deal.groupBy("cell").agg(F.max("blocks").alias("blocks"), F.max("parts").alias("parts")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocked = placed.join(F.broadcast(deal), "leaf").withColumn(
        "block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("blocks")).cast("int")).withColumn(
        "part", every("parts")).select("cell", "block", "part", "leaf", "vec_id", "vec")
    met = (visits.select("query_id", "query", "floor", F.explode("cells").alias("at"))
           .select("query_id", "query", "floor", F.col("at.cell").alias("cell"), F.col("at.leaves").alias("leaves")).join(own, "cell")
           .withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
           .withColumn("block", every("blocks")).select("cell", "block", "part", "query_id", "query", "floor", "leaves"))
    found = blocked.groupBy("cell", "block", "part").cogroup(met.groupBy("cell", "block", "part")).applyInPandas(_search(k), BEST)
    return top_k(found, k)
