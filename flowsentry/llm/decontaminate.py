"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of tokens: some positions count, the
others are ignored, so a substituted token at an ignored position does not
hide a passage.  The hashes of all masked windows of the benchmark make an
index; the windows of every document are hashed with the same masks and
joined to it.  Around each hit the document is aligned with the item, and the
pair is kept if some stretch of ``overlap`` tokens (the whole item, if
shorter) agrees in at least ``agreement`` of its tokens.

The masks miss no such stretch (:func:`covering_masks`); items shorter than
``overlap`` have masks of their own by size.  Masks given by the caller take
the place of those for whole stretches and find what they hit.

The index sent to all tasks holds at most ``block_tokens`` benchmark tokens; a
larger benchmark is taken in blocks, each against all documents.  A window
holding a token no item has cannot hit and is not hashed.

Tokens are lower-cased runs of letters and digits, and the single characters
of scripts without spaces.  An item of fewer than
``least`` tokens, or a null one, has nothing to match.  Null and empty
documents have no hits.  Repeated rows are answered row by row; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_blocks
from .wordtable import NOT_ALNUM, HashTable, Words, spread, word_bytes

#: At most so many masks for one size of stretch.
MOST_MASKS = 6
#: Hits looked up, and item tokens compared, at a time.
HITS = 1 << 18
TOKENS = 1 << 20
PAIRS = "doc_id long, item_id long, matched int, aligned int, item_tokens int"


def _offsets(mask: str) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(mask.encode(), np.uint8) == ord("1"))


def needed(width: int, agreement: float) -> int:
    """Tokens of a stretch that must agree."""
    return min(width, max(1, math.ceil(agreement * width - 1e-9)))


def covering_masks(width: int, changes: int) -> tuple[str, ...]:
    """Masks of which one fits in every stretch of ``width`` tokens with up to
    ``changes`` of them substituted.  Of n equal blocks of the stretch, at
    least n - changes hold no substitution; there is a mask for every way in
    which so many blocks can lie apart.  n is chosen for the most counted
    positions, then for the fewest masks, with ``MOST_MASKS`` at most."""
    best = None
    for n in range(changes + 1, width + 1):
        size, free = width // n, n - changes
        count = math.comb(n - 1, free - 1)
        if count <= MOST_MASKS and (best is None or (size * free, -count) > best[0]):
            best = (size * free, -count), n, size, free
    _, n, size, free = best
    return tuple("".join(("1" if b in (0, *rest) else "0") * size for b in range(max((0, *rest)) + 1))
                 for rest in combinations(range(1, n), free - 1))


def _keys(ids: np.ndarray, at: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the counted tokens of the windows that start at ``at``."""
    key = np.full(len(at), np.uint64((salt * 2 + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)))
    for o in offsets.tolist():
        key = (key ^ (ids[at + o] + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return np.maximum(key, np.uint64(1))


class SeedIndex:
    """Masked windows of a bounded set of items."""

    def __init__(self, items, masks=None, overlap: int = 13, agreement: float = 0.8, least: int = 5):
        self.overlap, self.agreement = overlap, agreement
        words = Words([word_bytes(t) for _, t in items], NOT_ALNUM)
        self.vocabulary = HashTable()
        self.vocabulary.add(np.unique(words.hash))
        self.ids = self.vocabulary.find(words.hash).astype(np.int64)
        self.item_ids = [i for i, _ in items]
        self.first = words.first
        sizes = np.diff(self.first)
        self.kinds = []
        keys, item, place = [], [], []
        for n in np.unique(np.minimum(sizes[sizes >= least], overlap)).tolist():
            whole = n == overlap
            for mask in masks if masks and whole else covering_masks(n, n - needed(n, agreement)):
                offsets, salt = _offsets(mask), len(self.kinds)
                windows = np.where(sizes >= overlap if whole else sizes == n, np.maximum(sizes - len(mask) + 1, 0), 0)
                run, at = spread(windows)
                self.kinds.append((offsets, len(mask), salt))
                keys.append(_keys(self.ids, self.first[run] + at, offsets, salt))
                item.append(run)
                place.append(at)
        keys, item, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (item, np.int64), (place, np.int64)))
        order = np.argsort(keys, kind="stable")
        found, start = np.unique(keys[order], return_index=True)
        self.table = HashTable()
        if len(found):
            self.table.add(found)
        self.start = np.r_[start, len(order)]
        self.item, self.place = item[order], place[order]

    def hits(self, ids: np.ndarray, last: np.ndarray):
        """(token, item, place in the item) of all windows of a block that hit,
        about ``HITS`` at a time; ``last``: for each token, the end of its
        document."""
        near = ids >= 0
        for offsets, width, salt in self.kinds:
            n = len(ids) - width + 1
            if n <= 0:
                continue
            ok = np.arange(n) + width <= last[:n]
            for o in offsets.tolist():
                ok &= near[o:o + n]
            at = np.flatnonzero(ok)
            seed = self.table.find(_keys(ids, at, offsets, salt))
            at, seed = at[seed >= 0], seed[seed >= 0]
            count = self.start[seed + 1] - self.start[seed]
            part = np.cumsum(count) // HITS
            for a, b in zip(np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else [],
                            np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1):
                run, k = spread(count[a:b])
                where = self.start[seed[a:b]][run] + k
                yield at[a:b][run], self.item[where], self.place[where]

    def _verified(self, ids, first, text, item, diagonal):
        """(text, item, matched, aligned) of the lines that agree enough."""
        size = self.first[item + 1] - self.first[item]
        width = np.minimum(self.overlap, size)
        a, b = np.maximum(diagonal, first[text]), np.minimum(diagonal + size, first[text + 1])
        fits = b - a >= width
        text, item, diagonal, width, a, b = (x[fits] for x in (text, item, diagonal, width, a, b))
        run, k = spread(b - a)
        here = a[run] + k
        total = np.r_[0, np.cumsum(ids[here] == self.ids[self.first[item][run] + here - diagonal[run]])]
        start = np.cumsum(b - a) - (b - a)
        stretches = b - a - width + 1
        run, k = spread(stretches)
        same = total[start[run] + k + width[run]] - total[start[run] + k]
        good = np.zeros(len(text), bool)
        good[run[same >= self.agreement * width[run] - 1e-9]] = True
        matched = total[start + b - a] - total[start]
        return np.stack([text, item, matched, b - a])[:, good]

    def pairs(self, texts: list[bytes]):
        """(text, item, matched tokens, aligned tokens) of verified overlaps."""
        words = Words(texts, NOT_ALNUM)
        ids = self.vocabulary.find(words.hash).astype(np.int64)
        owner = words.owner()
        last = words.first[1:][owner] if len(owner) else owner
        found = np.zeros((4, 0), np.int64)
        for at, item, place in self.hits(ids, last):
            line = np.unique(np.stack([owner[at], item, at - place]), axis=1)
            part = np.cumsum(self.first[line[1] + 1] - self.first[line[1]]) // TOKENS
            for some in np.split(line, np.flatnonzero(part[1:] != part[:-1]) + 1, axis=1):
                found = np.concatenate([found, self._verified(ids, words.first, *some)], axis=1)
            found = found[:, np.lexsort(found[::-1])]
            last_of = np.r_[(found[:2, 1:] != found[:2, :-1]).any(axis=0), True][:found.shape[1]]
            found = found[:, last_of]
        return list(zip(*found.tolist()))


def _blocks(benchmark: DataFrame, block_tokens: int):
    """The benchmark in blocks of a bounded number of tokens (taken as four
    bytes each, an item longer than that alone)."""
    rows, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
            "text IS NOT NULL AND item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        n = len(word_bytes(r.text)) // 4 + 1
        if rows and held + n > block_tokens:
            yield rows
            rows, held = [], 0
        rows.append((r.item_id, r.text))
        held += n
    if rows:
        yield rows


def _find(index):
    def run(batches):
        seeds = index.value
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), [word_bytes(t) for t in batch.column("text").to_pylist()]
            out = []
            for a, b in text_blocks(texts, 1_000_000):
                for text, item, matched, aligned in seeds.pairs(texts[a:b]):
                    out.append((docs[a + text], seeds.item_ids[item], matched, aligned,
                                int(seeds.first[item + 1] - seeds.first[item])))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                names=["doc_id", "item_id", "matched", "aligned", "item_tokens"])
    return run


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, masks=None, overlap: int = 13, agreement: float = 0.8,
                       block_tokens: int = 500_000) -> DataFrame:
    """doc_id, item_id, matched (agreeing tokens on the best alignment),
    aligned (tokens of the item that lie beside the document), item_tokens."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for items in _blocks(benchmark, block_tokens):
        index = spark.sparkContext.broadcast(SeedIndex(items, masks, overlap, agreement))
        part = rows.mapInArrow(_find(index), PAIRS)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], PAIRS)


def _keep(index):
    def run(batches):
        seeds = index.value
        for batch in batches:
            texts = [word_bytes(t) for t in batch.column("text").to_pylist()]
            keep = np.ones(len(texts), bool)
            for a, b in text_blocks(texts, 1_000_000):
                for text, *_ in seeds.pairs(texts[a:b]):
                    keep[a + text] = False
            yield batch.filter(pa.array(keep))
    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, masks=None, overlap: int = 13, agreement: float = 0.8,
                    block_tokens: int = 500_000) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of the benchmark."""
    spark = prepare(docs.sparkSession)
    for items in _blocks(benchmark, block_tokens):
        index = spark.sparkContext.broadcast(SeedIndex(items, masks, overlap, agreement))
        docs = docs.mapInArrow(_keep(index), docs.schema)
    return docs
