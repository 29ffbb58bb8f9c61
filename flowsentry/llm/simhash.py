"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints are made in tasks from word shingles.  The distinct ones are
sorted by Gray rank (neighbours in that order share most bits) and cut into
groups, where the leading bits change and at a greatest size.  Each group is described by the bits all its members
share: a mask and a value.  Those patterns are the index's lower upper-level
nodes; blocks of them share bits again, and so on to the root.  A search
walks down from the root: at each node the differing bits under the node's
mask are a lower bound of the distance to everything below, so a node over
the bound is left out with its whole subtree.  The walk sends a fingerprint
to the groups it may have partners in, where the same index over single
fingerprints finds the exact pairs.

The groups' patterns are the only thing sent to all tasks.  Their number is
bounded by ``max_groups``: the group size grows with the data instead.  Pairs
are reduced to spanning links inside a task before they are written, and
components are found by distributed star contraction, so dense groups of
near copies cost neither all pairs nor one large task.

Texts with fewer words than a shingle use the whole word sequence; no words
or null text gives fingerprint zero, linked like any other.  The graph's nodes
are fingerprints, so rows that share an id, or have none, are told apart by
their texts; a component is named by the smallest id in it, and by null where
it has none.  Repeated rows share their fingerprint; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, parallelism, prepare, stage_table
from .components import connected_components

FANOUT = 64


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    total, n = np.zeros(64, np.int64), len(hashes)
    for k in range(0, n, 65_536):
        bits = np.unpackbits(np.array(hashes[k:k + 65_536], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _fingerprints(shingle), "doc_id long, fp long")


def gray_rank(fp):
    """Place of a bit pattern in the Gray-code order, shifted so that signed
    longs sort like it."""
    r = fp
    for s in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, s))
    return r.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


# ---------------------------------------------------------------- the index
def shared_pattern(codes: np.ndarray, starts: np.ndarray):
    """Mask and value of the bits shared by each run of ``codes``."""
    low, high = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    mask = ~(low ^ high)
    return mask, low & mask


class GrayIndex:
    """Hierarchy over nodes in Gray order: each node has a mask and a value
    (a single fingerprint has a full mask), each block of ``FANOUT`` nodes a
    parent with the bits they all share."""

    def __init__(self, mask: np.ndarray, value: np.ndarray):
        self.levels = [(mask, value)]
        while len(mask) > FANOUT:
            starts = np.arange(0, len(mask), FANOUT)
            # shared by all children: kept by every mask and equal in every value
            same = np.bitwise_and.reduceat(mask, starts)
            low, high = np.bitwise_and.reduceat(value, starts), np.bitwise_or.reduceat(value, starts)
            mask = same & ~(low ^ high)
            value = low & mask
            self.levels.append((mask, value))

    def search(self, queries: np.ndarray, bound: int):
        """Yields (query positions, node positions) of the lowest level whose
        difference under the mask is at most ``bound``, block by block."""
        top = len(self.levels[-1][0])
        step = max(1, 2_000_000 // max(top, 1))
        for a in range(0, len(queries), step):
            n = min(step, len(queries) - a)
            q, node = np.repeat(np.arange(a, a + n), top), np.tile(np.arange(top), n)
            yield from self._down(queries, q, node, len(self.levels) - 1, bound)

    def _down(self, queries, q, node, level, bound):
        mask, value = self.levels[level]
        near = np.bitwise_count((queries[q] ^ value[node]) & mask[node]) <= bound
        q, node = q[near], node[near]
        if level == 0:
            if len(q):
                yield q, node
            return
        width = len(self.levels[level - 1][0])
        for a in range(0, len(q), 32_768):
            below = node[a:a + 32_768, None] * FANOUT + np.arange(FANOUT)
            inside = below < width
            yield from self._down(queries, np.repeat(q[a:a + 32_768], inside.sum(axis=1)), below[inside], level - 1, bound)


def local_components(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable position of each of ``n`` nodes."""
    label = np.arange(n) if label is None else label
    while True:
        least = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, before[u], least)
        np.minimum.at(label, before[v], least)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(label, before):
            return label


def _gray_cells(fp: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of the Gray rank."""
    r = fp.view(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return (r >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(r), np.int64)


def _number_groups(size: int, bits: int):
    """Members of a sorted partition in groups: a new one where the leading
    bits change, so its members share them, and after ``size`` members."""
    def run(batches):
        from pyspark import TaskContext
        group, cell, held = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            cells = _gray_cells(batch.column("fp").to_numpy(), bits)
            cuts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            out = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cells)]):
                if b > a and cells[a] != cell:
                    group, cell, held = group + 1, cells[a], 0
                place = held + np.arange(b - a)
                out.append(group + place // size)
                if b > a:
                    group, held = int(out[-1][-1]), int(place[-1]) % size + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)), batch.column("fp"), batch.column("rep")],
                names=["grp", "fp", "rep"])
    return run


def _route(groups, bound: int):
    """Send each fingerprint to the groups it may have partners in; a pair of
    groups is searched from the earlier one's members only."""
    def run(batches):
        ids, mask, value = groups.value
        index = GrayIndex(mask.view(np.uint64), value.view(np.uint64))
        for batch in batches:
            own, fp, rep = (batch.column(c).to_numpy() for c in ("grp", "fp", "rep"))
            for q, node in index.search(fp.view(np.uint64), bound):
                later = ids[node] > own[q]
                q, node = q[later], node[later]
                yield pa.RecordBatch.from_arrays([pa.array(ids[node]), pa.array(fp[q]), pa.array(rep[q])],
                                                 names=["grp", "fp", "rep"])
    return run


class _Group:
    """One group while its visitors stream by."""

    def __init__(self, fp: np.ndarray, rep: np.ndarray, bound: int):
        self.rep, self.bound = rep, bound
        self.codes = fp.view(np.uint64)
        self.index = GrayIndex(np.full(len(fp), ~np.uint64(0)), self.codes)
        self.label = np.arange(len(fp))

    def own_links(self):
        for q, m in self.index.search(self.codes, self.bound):
            self.label = local_components(len(self.codes), q, m, self.label)
        u = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.rep[u], self.rep[self.label[u]]

    def visitors(self, fp: np.ndarray, rep: np.ndarray):
        """One link from a visitor to each local component it is near to."""
        for q, m in self.index.search(fp.view(np.uint64), self.bound):
            pairs = np.unique(q.astype(np.int64) * len(self.label) + self.label[m])
            yield rep[pairs // len(self.label)], self.rep[pairs % len(self.label)]


def _link(bound: int):
    """Streams over rows sorted by group, members first."""
    def run(batches):
        group, now, held = None, None, []
        out = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        def close():
            made = _Group(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), bound)
            return made, made.own_links()

        for batch in batches:
            grp, visit, fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "visit", "fp", "rep"))
            cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (visit[1:] != visit[:-1])) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(grp)]):
                if a == b:
                    continue
                if grp[a] != now:
                    if held:
                        yield out(*close()[1])
                    now, group, held = grp[a], None, []
                if not visit[a]:
                    held.append((fp[a:b], rep[a:b]))
                    continue
                if group is None:
                    group, links = close()
                    held = []
                    yield out(*links)
                for u, v in group.visitors(fp[a:b], rep[a:b]):
                    yield out(u, v)
        if held:
            yield out(*close()[1])
    return run


def near_links(codes: DataFrame, bound: int = 2, group_size: int = 2048, max_groups: int = 65_536) -> DataFrame:
    """Links (u, v) that connect every two fingerprints of ``codes`` (fp, rep;
    each fp once) at most ``bound`` bits apart; all pairs' components, not all
    pairs."""
    spark = prepare(codes.sparkSession)
    n = codes.count()
    size = max(group_size, -(-4 * n // max_groups))
    bits = int(np.ceil(np.log2(max(1, n / size))))
    parts = max(1, min(parallelism(spark), n // size))
    ordered = codes.repartitionByRange(parts, gray_rank(F.col("fp"))).sortWithinPartitions(gray_rank(F.col("fp")))
    members = stage_table(ordered.mapInArrow(_number_groups(2 * size, bits), "grp long, fp long, rep long"), "simhash-groups")
    low, high = F.expr("bit_and(fp)"), F.expr("bit_or(fp)")
    patterns = (members.groupBy("grp").agg(low.alias("low"), high.alias("high"))
                .select("grp", F.bitwise_not(F.col("low").bitwiseXOR(F.col("high"))).alias("mask"), "low")
                .select("grp", "mask", F.col("low").bitwiseAND(F.col("mask")).alias("value"))
                .orderBy("grp").collect())          # at most max_groups + partitions rows: 2^bits cells, each cut at twice the size
    nodes = spark.sparkContext.broadcast(tuple(np.array([r[k] for r in patterns], np.int64) for k in range(3)))
    visits = members.mapInArrow(_route(nodes, bound), "grp long, fp long, rep long")
    both = members.withColumn("visit", F.lit(False)).unionByName(visits.withColumn("visit", F.lit(True)))
    spread = both.repartition(max(1, min(parallelism(spark), len(patterns))), "grp").sortWithinPartitions("grp", "visit")
    return spread.mapInArrow(_link(bound), "u long, v long")


def _classes(docs: DataFrame, shingle: int, bound: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, node, component_id) of every
    fingerprint; ``node`` is a fingerprint that names the component."""
    marked = stage_table(fingerprints(docs, shingle), "simhash-fingerprints")
    codes = stage_table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-codes")
    found = connected_components(near_links(codes.select("fp", F.col("fp").alias("rep")), bound))
    nodes = codes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("node"))
    named = nodes.groupBy("node").agg(F.min("least").alias("component_id"))
    return marked, nodes.select("fp", "node").join(named, "node")


def near_duplicates(docs: DataFrame, shingle: int = 3, bound: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at
    most ``bound`` differing bits."""
    marked, classes = _classes(docs, shingle, bound)
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = 3, bound: int = 2) -> DataFrame:
    """One row of each component, all columns: that of the smallest id (a null
    id is larger than any), then of the smallest hash of its text, then of the
    smallest hash of all its columns."""
    row = fresh(docs, "row")
    numbered = stage_table(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    own = [F.col(f"`{c}`") for c in docs.columns]
    keys = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"),
                           F.xxhash64(*[c.cast("string") for c in own]).alias("all_hash"))
    # fingerprints are made of (id, text); here the row's number stands for the id
    marked, classes = _classes(numbered.select(F.col(row).alias("doc_id"), "text"), shingle, bound)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "all_hash", "row")
    first = (marked.join(classes, "fp").select(F.col("doc_id").alias("row"), "node").join(keys, "row")
             .groupBy("node").agg(F.min(order).alias("first")).select(F.col("first.row").alias(row)))
    return numbered.join(first, row, "left_semi").select(*own)
