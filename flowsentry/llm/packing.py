"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

1. Every text is tokenised in tasks and cut into pieces of at most
   ``capacity`` tokens (only longer documents are cut).
2. Pieces are dealt at random into shards of about ``shard_items`` pieces;
   bins never cross shards, so the work is linear and every task is bounded.
3. In each shard, islands each evolve a small population of packings.  An
   individual assigns pieces to bins.  Crossover injects whole well-filled
   bins of one parent into the other, removes the other's bins that hold any
   injected piece (so no piece is there twice) and puts the displaced pieces
   back best-fit, longest first.  Mutation empties the worst bins the same way.
4. After an epoch each island's elite migrates to the next island of its
   shard, by a join between the written populations.
5. The best individual of a shard becomes its sequences.

All randomness is seeded by shard, island and epoch, so a recomputed task
gives the same packing.  Null text is an empty document (its end token only);
repeated rows are packed as often as they come; other columns are ignored.

Tokenising remembers words (see :class:`WordTokenizer`): the tokenizer merges
inside the words of its split pattern only, so a text's ids are its words' ids
in order.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage_table, text_blocks
from .wordtable import Words, WordValues

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_LATIN = [chr(c) for c in range(0x250)]
_LETTERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
#: Not in the plain range (no composition, no context-dependent lower case), or
#: a control character.
_NOT_PLAIN = re.compile("[^\t\n\r -~\xa0-\u024f]")
#: The tokenizer's own split pattern, its two classes spelt out for that range.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+|\n")


class WordTokenizer:
    """Ids of whole texts from the ids of their words, each learnt once.

    A text of Latin letters is lower-cased and cut at white space; a word not
    met before is split by the tokenizer's pattern, and its parts go through
    the merges many at once (the last id of each part carries the end-of-word
    mark).  A text with any other character, or with the start of a special
    string, is left whole to the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.whole.model.end_of_word_suffix
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith(suffix)
        self.words = WordValues(self._learn, "<u4")

    def _learn(self, words: list[bytes]):
        found = _PARTS.findall(b"\n".join(words).decode() + "\n")
        stops = np.flatnonzero(np.fromiter((f == "\n" for f in found), bool, len(found)))
        per_word = np.diff(np.r_[-1, stops]) - 1
        parts = [f for f in found if f != "\n"]
        distinct = {f: k for k, f in enumerate(dict.fromkeys(parts))}
        names, ids = list(distinct), []
        for k in range(0, len(names), 200):
            ids.append(np.array(self.merges.encode(" ".join(names[k:k + 200]), add_special_tokens=False).ids, "<u4"))
        ids = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        stop = np.flatnonzero(self.ends[ids]) + 1
        assert len(stop) == len(names)
        start = np.r_[0, stop[:-1]]
        part = np.fromiter(map(distinct.__getitem__, parts), np.int64, len(parts))
        size = (stop - start)[part]
        before = np.cumsum(size) - size
        values = ids[np.repeat(start[part] - before, size) + np.arange(int(size.sum()))]
        total = np.r_[0, np.cumsum(size)]
        edges = np.r_[0, np.cumsum(per_word)]
        return values, total[edges[1:]] - total[edges[:-1]]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        plain = [not (_NOT_PLAIN.search(t) or "<|" in t) for t in texts]
        words = Words([t.lower().encode() if p else b"" for t, p in zip(texts, plain)])
        ids, size = self.words.rows(self.words.numbers(words))
        edge = np.r_[0, np.cumsum(size)][words.first]
        return [ids[a:b] if p else np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4")
                for t, p, a, b in zip(texts, plain, edge, edge[1:])]


_tokenizers: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    """This worker process's tokenizer; its words stay known from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut(ids: np.ndarray, capacity: int):
    """(piece, start, length, crc32) of a document's ids."""
    for piece, start in enumerate(range(0, len(ids), capacity)):
        part = ids[start:start + capacity]
        yield piece, start, len(part), zlib.crc32(part.tobytes())


def _tokenise(path: str, end_id: int, capacity: int):
    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, end = worker_tokenizer(path), np.array([end_id], "<u4")
        for batch in batches:
            docs, texts, rows = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), []
            for a, b in text_blocks(texts, 2_000_000):
                for doc, ids in zip(docs[a:b], tokenizer.ids(texts[a:b])):
                    rows += [(doc, *p) for p in cut(np.concatenate([ids, end]), capacity)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def document_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .mapInArrow(_tokenise(tokenizer_path, end_id, capacity), PIECES)


# ---------------------------------------------------------------- the genetic algorithm
def best_fit(items, lengths, assign, room: list, next_bin: int, capacity: int) -> int:
    """Put ``items`` (in the given order) each into the fullest bin with room.
    ``room`` is a sorted list of (free tokens, bin); returns the next unused
    bin number."""
    for i in items:
        n = int(lengths[i])
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b = capacity, next_bin
            next_bin += 1
        assign[i] = b
        if free > n:
            insort(room, (free - n, b))
    return next_bin


def _compact(assign: np.ndarray) -> np.ndarray:
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def _fills(assign, lengths) -> np.ndarray:
    return np.bincount(assign, weights=lengths)


def fitness(assign, lengths, capacity: int) -> tuple:
    """Fewer bins first; then fuller bins (mean squared fill)."""
    fill = _fills(assign, lengths)
    return -len(fill), float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def _refill(child, keep_bins, fill, displaced, lengths, capacity):
    """Best-fit the displaced pieces, longest first, beside the kept bins."""
    room = sorted((int(capacity - fill[b]), int(b)) for b in np.flatnonzero(keep_bins) if fill[b] < capacity)
    order = displaced[np.argsort(-lengths[displaced], kind="stable")]
    best_fit(order, lengths, child, room, len(fill), capacity)
    return _compact(child)


def crossover(a, b, lengths, capacity: int, rng) -> np.ndarray:
    """Inject a share of ``b``'s best-filled bins into ``a``."""
    fill_b = _fills(b, lengths)
    good = np.flatnonzero(fill_b >= np.quantile(fill_b, 0.5))
    chosen = np.zeros(len(fill_b), bool)
    chosen[rng.choice(good, max(1, len(good) // 3), replace=False)] = True
    injected = chosen[b]
    n_a = int(a.max()) + 1
    hit = np.zeros(n_a, bool)
    hit[a[injected]] = True                       # these bins of a hold injected pieces: they go
    displaced = np.flatnonzero(hit[a] & ~injected)
    child = a.copy()
    child[injected] = n_a + b[injected]           # whole bins, under new numbers
    child = _compact_with(child, displaced)
    fill = np.bincount(child[child >= 0], weights=lengths[child >= 0])
    return _refill(child, np.ones(len(fill), bool), fill, displaced, lengths, capacity)


def _compact_with(child, displaced):
    child[displaced] = -1
    placed = child >= 0
    child[placed] = _compact(child[placed])
    return child


def mutate(a, lengths, capacity: int, rng) -> np.ndarray:
    """Empty the worst bins and a few others, and pack their pieces again."""
    fill = _fills(a, lengths)
    out = np.zeros(len(fill), bool)
    out[np.argsort(fill, kind="stable")[:max(2, len(fill) // 50)]] = True
    out[rng.integers(0, len(fill), max(1, len(fill) // 50))] = True
    displaced = np.flatnonzero(out[a])
    child = _compact_with(a.copy(), displaced)
    placed = child >= 0
    fill = np.bincount(child[placed], weights=lengths[placed])
    return _refill(child, np.ones(len(fill), bool), fill, displaced, lengths, capacity)


def first_population(lengths, capacity: int, size: int, rng) -> list:
    """Best-fit in decreasing order, then in orders that are only roughly so."""
    out = []
    for k in range(size):
        noise = rng.random(len(lengths)) * 0.1 * k * capacity
        assign = np.zeros(len(lengths), np.int32)
        best_fit(np.argsort(-(lengths + noise), kind="stable"), lengths, assign, [], 0, capacity)
        out.append(_compact(assign))
    return out


def evolve(population: list, lengths, capacity: int, generations: int, size: int, rng) -> list:
    """A few generations; returns the best ``size`` individuals, best first.
    Stops at the bound that no packing can beat."""
    bound = -(-int(lengths.sum()) // capacity)
    score = lambda x: fitness(x, lengths, capacity)
    ranked = sorted(((score(x), k, x) for k, x in enumerate(population)), key=lambda y: (y[0], -y[1]), reverse=True)
    for _ in range(generations):
        if -ranked[0][0][0] <= bound:
            break
        i, j = rng.integers(0, len(ranked), 2)
        child = crossover(ranked[min(i, j)][2], ranked[max(i, j)][2], lengths, capacity, rng)
        pair = [child, mutate(child, lengths, capacity, rng)]
        ranked += [(score(x), len(ranked) + k, x) for k, x in enumerate(pair)]
        ranked.sort(key=lambda y: (y[0], -y[1]), reverse=True)
        ranked = [(s, k, x) for k, (s, _, x) in enumerate(ranked[:size])]
    return [x for _, _, x in ranked[:size]]


STATE = "shard long, island int, lengths array<int>, population array<binary>, bins int, fill double"


def _epoch(capacity: int, size: int, generations: int, epoch: int):
    def run(frames):
        import pandas as pd
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                lengths = np.array(r.lengths, np.int64)
                rng = np.random.default_rng([int(r.shard) & 0x7FFFFFFF, int(r.island), epoch])
                population = [np.frombuffer(x, np.int32) for x in r.population]
                if not population:
                    population = first_population(lengths, capacity, size, rng)
                population = evolve(population, lengths, capacity, generations, size, rng)
                bins, fill = fitness(population[0], lengths, capacity)
                out.append((r.shard, r.island, r.lengths, [x.astype(np.int32).tobytes() for x in population], -bins, fill))
            yield pd.DataFrame(out, columns=["shard", "island", "lengths", "population", "bins", "fill"])
    return run


def pack(items: DataFrame, capacity: int = 4096, shard_items: int = 4096, islands: int = 2, size: int = 4,
         generations: int = 6, epochs: int = 2) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``items`` (any columns, with
    ``length`` of 1 to ``capacity``)."""
    spark = prepare(items.sparkSession)
    numbered = stage_table(items.withColumn("_item", F.monotonically_increasing_id()), "packing-items")
    shards = max(1, -(-numbered.count() // shard_items))
    # whole sequences need no search, all others are dealt by a hash of their number
    shard = F.pmod(F.xxhash64("_item"), F.lit(shards))
    dealt = numbered.where(F.col("length") < capacity).select(
        shard.alias("shard"), "_item", F.col("length").cast("int").alias("length"))
    grouped = stage_table(
        dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("_item", "length"))).alias("rows")),
        "packing-shards")

    state = grouped.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.col("rows.length").alias("lengths"), F.array().cast("array<binary>").alias("population"))
    for epoch in range(epochs):
        if epoch:
            elites = state.select("shard", ((F.col("island") + 1) % islands).alias("island"),
                                  F.slice("population", 1, 1).alias("elite"))
            state = state.join(elites, ["shard", "island"]).select(
                "shard", "island", "lengths", F.concat("population", "elite").alias("population"))
        # one shard of one island is minutes of work for thousands of rows: spread the few rows wide
        spread = state.select("shard", "island", "lengths", "population").repartition(
            min(max(shards * islands, 1), 4096), "shard", "island")
        state = stage_table(spread.mapInPandas(_epoch(capacity, size, generations, epoch), STATE), "packing-state")

    best = state.groupBy("shard").agg(
        F.max_by(F.element_at("population", 1), F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("best"))
    placed = (grouped.join(best, "shard").select("shard", "rows", "best")
              .mapInPandas(_place(shards), "_item long, sequence_id long, offset long"))
    whole = numbered.where(F.col("length") >= capacity).select(
        "_item", (-1 - F.col("_item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.join(placed.unionByName(whole), "_item").drop("_item")


def _place(shards: int):
    def run(frames):
        import pandas as pd
        for frame in frames:
            for shard, rows, best in zip(frame["shard"], frame["rows"], frame["best"]):
                item = np.array([r["_item"] for r in rows], np.int64)
                length = np.array([r["length"] for r in rows], np.int64)
                bins = np.frombuffer(best, np.int32).astype(np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(length[order]) - length[order]
                first = np.r_[True, bins[order][1:] != bins[order][:-1]]
                offset = before - np.maximum.accumulate(np.where(first, before, 0))
                yield pd.DataFrame({"_item": item[order], "sequence_id": bins[order] * shards + shard, "offset": offset})
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, **genetic) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset."""
    return pack(document_pieces(docs, tokenizer_path, capacity, end_id), capacity, **genetic).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
