"""Ranked lexical search by norm buckets (after LEMP).

Every document is a sparse vector of impacts over the items' terms, and every
item a vector of how often it holds each term; a document's score is their
inner product.  The impact of term t in document d is the integer
``w(t) * ((10^9 tf) div (1000 tf + 12 m(d)))``.

1. One pass over the texts keeps, per document, its length and the frequencies
   of the terms that any item of the block holds, written as a table.
2. N, L and the document frequencies are sums over that table; they fix the
   weights, so the next pass turns frequencies into impacts and their length
   (Euclidean norm).  Vectors are ordered by length: longest first, in range
   partitions, and in each by blocks of ``bucket_rows`` vectors (a bucket).
3. The partition of the longest vectors is searched first.  What it finds gives
   every item a score that its results must reach, and all other partitions
   are searched with these.  For a bucket and an item, the product of the item's
   norm and the bucket's largest one bounds all scores (Cauchy-Schwarz); where
   it falls short, the bucket is skipped, and with it all shorter vectors of
   the partition.  Inside a bucket the item's heaviest coordinates are summed
   first; the norms of what is left of the item and of each vector bound the
   rest, and vectors that cannot reach the score go.
4. Survivors are scored exactly, in 64-bit integers.  Each task returns no more
   than ``k`` rows per item, which meet in one ranking.

The items are taken in blocks whose terms fill at most ``block_terms`` entries,
each block with a pass of its own, so what goes to all tasks is bounded.

Null text has no terms.  Rows that share an item id are one item holding all
their terms; repeated documents and document ids are each ranked by themselves.
Null ids take part, and among equal scores they come last.  Items without a
term that some document holds, and empty tables, give no rows.  Columns other
than the ids and texts are ignored.

Terms are told apart by 64-bit hashes of their bytes and their lengths.
"""

from __future__ import annotations

from collections import Counter
from math import floor, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, prepare, stage_table
from .wordtable import NOT_ALNUM, HashTable, Words, span_hashes

VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
IMPACTS = "doc_id long, norm double, terms array<int>, impacts array<long>"
HITS = "item int, doc_id long, score long"
#: Only A-Z change.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


class Vocabulary:
    """Numbers of the terms of a block of items."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b" ".join(terms) + b" ", np.uint8)
        ends = np.flatnonzero(data == 32)
        starts = np.r_[0, ends[:-1] + 1][:len(ends)]
        self.size = (ends - starts).astype(np.int64)
        self.table = HashTable()
        if len(terms):
            self.table.add(span_hashes(data, starts, ends))

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word, -1 if no item holds it."""
        number = self.table.find(words.hash)
        known = np.flatnonzero(number >= 0)
        wrong = (words.ends - words.starts)[known] != self.size[number[known]]
        number[known[wrong]] = -1
        return number


def _to_vectors(shared):
    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            texts = [(t or b"").translate(_LOWER) for t in texts]
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= 4_000_000):
                    size += len(texts[stop])
                    stop += 1
                words = Words(texts[start:stop], NOT_ALNUM)
                number = vocabulary.numbers(words)
                hit = np.flatnonzero(number >= 0)
                owner = words.owner()[hit].astype(np.int64)
                key, tf = np.unique(owner << 32 | number[hit], return_counts=True)
                offsets = np.searchsorted(key >> 32, np.arange(stop - start + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (key & 0xFFFFFFFF, tf)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(np.diff(words.first).astype(np.int64)), *lists],
                    names=["doc_id", "n", "terms", "tfs"])
                start = stop
    return run


def _flat(column, kind):
    """The values of a list column and the row of each."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return values.astype(kind), np.repeat(np.arange(len(column)), np.diff(offsets))


def _to_impacts(shared):
    def run(batches):
        n_docs, length, weight = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy().astype(np.int64)
            m = 75 + (25 * n * n_docs) // length
            terms, row = _flat(batch.column("terms"), np.int32)
            tf, _ = _flat(batch.column("tfs"), np.int64)
            impact = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
            norm = np.sqrt(np.bincount(row, impact.astype(np.float64) ** 2, minlength=len(n)))
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(n)))].astype(np.int32)), pa.array(v))
                     for v in (terms, impact)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(norm), *lists], names=["doc_id", "norm", "terms", "impacts"])
    return run


class Bucket:
    """Vectors of similar length, by coordinate."""

    def __init__(self, ids, null, norm, terms, row, impact):
        self.ids, self.null, self.norm, self.rows = ids, null, norm, len(ids)
        order = np.argsort(terms, kind="stable")
        self.row, self.impact = row[order], impact[order]
        self.terms, self.start = np.unique(terms[order], return_index=True)
        self.stop = np.r_[self.start[1:], len(order)].astype(np.int64)

    def coordinate(self, term: int):
        k = int(np.searchsorted(self.terms, term))
        if k == len(self.terms) or self.terms[k] != term:
            return None
        return slice(self.start[k], self.stop[k])

    def search(self, terms, counts, norm: float, least: int, focus: int):
        """Rows and exact scores of the vectors that may reach ``least`` (and
        have a score above 0).  ``terms`` come heaviest first."""
        score = np.zeros(self.rows, np.int64)
        squares = np.zeros(self.rows)
        left = norm * norm
        for t, c in zip(terms[:focus], counts[:focus]):
            left -= float(c) * c
            at = self.coordinate(t)
            if at is not None:
                score[self.row[at]] += c * self.impact[at]
                squares[self.row[at]] += self.impact[at].astype(np.float64) ** 2
        # the little more makes up for rounding: a bound may only be too large
        bound = score + sqrt(max(left, 0.0)) * np.sqrt(np.maximum(self.norm ** 2 * (1 + 1e-9) - squares, 0.0)) * (1 + 1e-9)
        alive = bound >= least
        if not alive.any():
            return None
        for t, c in zip(terms[focus:], counts[focus:]):
            at = self.coordinate(t)
            if at is not None:
                rows = self.row[at]
                keep = alive[rows]
                score[rows[keep]] += c * self.impact[at][keep]
        found = np.flatnonzero(alive & (score >= max(least, 1)))
        return found, score[found]


class Best:
    """The k best (score, id) of one item so far."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.ids, self.null, self.score = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, ids, null, score) -> None:
        ids, null, score = np.r_[self.ids, ids], np.r_[self.null, null], np.r_[self.score, score]
        if len(ids) > self.k:
            at = np.lexsort((ids, null, -score))[:self.k]
            ids, null, score = ids[at], null[at], score[at]
        self.ids, self.null, self.score = ids, null, score
        if len(ids) == self.k:
            self.least = max(self.least, int(score.min()))


def _search(shared, least, k: int, bucket_rows: int, focus: int):
    """The k best rows of a partition for each item; vectors come longest first."""
    def run(batches):
        items = shared.value                      # (terms, counts, norm) of each
        floors = least.value if least is not None else [0] * len(items)
        best = [Best(k, f) for f in floors]
        norms = np.array([x[2] for x in items])
        for batch in batches:
            for start in range(0, batch.num_rows, bucket_rows):
                part = batch.slice(start, bucket_rows)
                norm = part.column("norm").to_numpy()
                reach = norms * norm.max() * (1 + 1e-9)
                live = [q for q in np.flatnonzero(reach > 0) if reach[q] >= best[q].least]
                if not live:
                    continue
                ids = part.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                terms, row = _flat(part.column("terms"), np.int32)
                bucket = Bucket(ids, null, norm, terms, row, _flat(part.column("impacts"), np.int64)[0])
                for q in live:
                    found = bucket.search(*items[q], best[q].least, focus)
                    if found is not None and len(found[0]):
                        best[q].add(ids[found[0]], null[found[0]], found[1])
        sizes = [len(b.ids) for b in best]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(best)), sizes).astype(np.int32)),
            pa.array(np.concatenate([b.ids for b in best]), mask=np.concatenate([b.null for b in best])),
            pa.array(np.concatenate([b.score for b in best]))], names=["item", "doc_id", "score"])
    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    line = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def item_blocks(items: DataFrame, block_terms: int):
    """Lists of (item id, Counter of terms) in order of ids, of about
    ``block_terms`` entries each."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    block: list = []
    size = 0
    for r in rows.orderBy(F.asc_nulls_last("item_id"), "text").toLocalIterator():
        words = Words([_bytes(r.text)], NOT_ALNUM)
        terms = Counter(words.word(k) for k in range(len(words.hash)))
        if block and block[-1][0] == r.item_id:
            block[-1][1].update(terms)
        else:
            if size >= block_terms:
                yield block
                block, size = [], 0
            block.append((r.item_id, terms))
        size += len(terms)
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, bucket_rows: int = 2048, focus: int = 8,
                   block_terms: int = 2_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above
    0 for each row of ``items`` (item_id, text) among ``docs`` (doc_id, text)."""
    spark = prepare(docs.sparkSession)
    found = None
    for block in item_blocks(items, block_terms):
        part = _rank_block(docs, block, k, bucket_rows, focus)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def _rank_block(docs: DataFrame, block: list, k: int, bucket_rows: int, focus: int) -> DataFrame:
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    names = sorted({t for _, terms in block for t in terms})
    number = {t: i for i, t in enumerate(names)}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = stage_table(texts.mapInArrow(_to_vectors(share(Vocabulary(names))), VECTORS), "lexical-vectors")

    total = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    # one row per term of the block
    holding = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = np.array([floor(1000 * log((2 * total.docs + 2) / (2 * holding.get(i, 0) + 1))) for i in range(len(names))] or [0], np.int64)

    ordered = (vectors.where(F.size("terms") > 0).mapInArrow(_to_impacts(share((total.docs, max(total.length, 1), weight))), IMPACTS)
               .withColumn("salt", F.xxhash64("doc_id", F.monotonically_increasing_id())))
    parts = parallelism(spark)
    ordered = stage_table(ordered.repartitionByRange(parts, F.desc("norm"), "salt").sortWithinPartitions(F.desc("norm"))
                          .withColumn("part", F.spark_partition_id()).drop("salt"), "lexical-buckets")

    vector = []
    for _, terms in block:
        known = sorted(((number[t], c) for t, c in terms.items()), key=lambda x: (-int(weight[x[0]]) * x[1], x[0]))
        known = [(t, c) for t, c in known if weight[t] > 0]
        vector.append(([t for t, _ in known], [c for _, c in known], sqrt(sum(c * c for _, c in known))))
    queries = share(vector)
    rows = lambda where: ordered.where(where).select("doc_id", "norm", "terms", "impacts")
    longest = stage_table(rows("part = 0").mapInArrow(_search(queries, None, k, bucket_rows, focus), HITS), "lexical-longest")
    # one row per item of the block
    least = {r.item: r.least for r in _ranked(longest, k).where(F.col("rank") == k).select("item", F.col("score").alias("least")).collect()}
    floors = share([least.get(i, 0) for i in range(len(block))])
    others = rows("part > 0").mapInArrow(_search(queries, floors, k, bucket_rows, focus), HITS)
    # an item's task results: at most k rows a partition, fewer the higher its floor
    ranked = _ranked(longest.unionByName(others), k)
    ids = spark.createDataFrame([(i, x[0]) for i, x in enumerate(block)], "item int, item_id long")
    return ranked.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
