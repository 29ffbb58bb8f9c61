"""Alignment of two tokenizers over the same text.

Both tokenizers say where their tokens lie: ``tokenizers`` by character
offsets, sentencepiece by the byte spans of its proto (the installed release
offers ``proto`` in the place of the older immutable proto).  Where every
character is one byte these are the tokens' exact ends.  Where a token may end
inside a character (a multibyte character that the byte-level tokenizer splits,
or the byte pieces of one that the piece model doesn't know) all its parts
claim the whole character, so the ends are refined by the tokens' decoded bytes,
whose running lengths tell the parts apart.  Ends that both sides have in
common are cuts.

What lies between two cuts is a group: some tokens of A and some of B that
stand for the same bytes.  All pairs of a group are links.  How many documents
hold a pair linked is counted over the corpus, and every document learns how
many of its links are their A id's most frequent.

Neither tokenizer joins what stands on the two sides of a lone space, or of a
newline, before a character that is no white space (for the piece model it is
checked when the model is loaded that no piece continues past its space mark
and none holds a newline), so the groups of
a text are those of its segments in order.  Segments repeat, so each is aligned
once per worker and remembered in a table of bounded size; texts cost array
work only.  For the same reason new segments are encoded side by side as one text.  Pairs of a group are kept as distinct ids with multiplicities.

1. Each document's numbers, digest, distinct pairs and multiplicities are
   written as a table.
2. The pairs' documents are counted: one row per distinct pair, at most the
   product of the two vocabularies' sizes, whatever the corpus.
3. These counts are dealt into ranges of A ids with at most ``block_pairs``
   pairs each (a single A id has at most B's vocabulary), and each range meets
   all documents' pairs in a pass of its own, as a sorted array per task.

A text that is null or empty, or whose tokens don't spell a space and the text,
has no tokens.  Rows are answered one by one, repeated ones too; a count is
over rows.  Null ids stay null.  Columns other than ``doc_id`` and ``text`` are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage_table
from .wordtable import HashTable, span_hashes

SPACE = "▁"
FACTS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "pairs array<long>, times array<long>")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level
    vocabularies: itself where printable, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Groups of a piece of text that begins with a space."""

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        alphabet = byte_alphabet()
        self.a_bytes = {}
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.b_bytes.append(piece.replace(SPACE, " ").encode())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.by_segment = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.by_line = SPACE in pieces and not any("\n" in p for p in pieces)

    def runs(self, numbers: list[int], pieces: list[str], longest: int = 8192) -> list[list[int]]:
        """Pieces that may stand side by side in one text and still be encoded
        as if each were alone; those of one byte a character apart from others."""
        out, opened = [], {}
        for k in numbers:
            p = pieces[k]
            kind = p.isascii()
            run, room = opened.get(kind, (None, 0))
            # as segment_starts cuts: no white space after the mark, no space before it
            if run is None or room < len(p) or not (len(p) > 1 and p[1] < "\u1000" and not p[1].isspace()):
                run, room = [], longest
                out.append(run)
            run.append(k)
            opened[kind] = (run, room - len(p) if p[-1] != " " else 0)
        return out

    def align(self, pieces: list[str]) -> "Aligned":
        """The groups of each piece of text, which begins with a space or, where
        ``by_line``, a newline (to which the piece model then adds a space of
        its own that joins nothing).  Pieces are encoded in runs; a run that
        doesn't spell its text, or isn't cut between its pieces, is encoded
        again piece by piece."""
        out = Aligned(len(pieces))
        everything = list(range(len(pieces)))
        runs = self.runs(everything, pieces) if self.by_segment and self.by_line else [[k] for k in everything]
        while runs:
            runs = self._align_runs(runs, pieces, out)
        return out

    def _align_runs(self, runs: list[list[int]], pieces: list[str], out: "Aligned") -> list[list[int]]:
        texts = ["".join([pieces[k] for k in run]) for run in runs]
        own = self.a.encode_batch(texts, add_special_tokens=False)
        other = [x.pieces for x in self.b.encode([t if t[0] == "\n" else t[1:] for t in texts], return_type="proto", num_threads=1)]
        kept, sizes, ids, ends, base, again = [], [], ([], []), ([], []), 0, []
        of_a, of_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for run, text, e, x in zip(runs, texts, own, other):
            space = text[0] != "\n"
            if not space:
                x = x[1:]
            raw, a, b = text.encode(), e.ids, [t.id for t in x]
            bytes_a, bytes_b = list(map(of_a, a)), list(map(of_b, b))
            spells = b"".join(bytes_a) == raw and b"".join(bytes_b) == raw
            exact = len(raw) == len(text)
            if spells:
                if exact:
                    # all characters are bytes: offsets and spans (after the space) are exact
                    found = [end for _, end in e.offsets], [t.end + space for t in x]
                else:
                    # tokens may end inside characters, where only their bytes tell
                    found = list(accumulate(map(len, bytes_a))), list(accumulate(map(len, bytes_b)))
                found = [np.array(f, np.int64) for f in found]
                size = np.fromiter((len(pieces[k]) if exact else len(pieces[k].encode()) for k in run), np.int64, len(run))
                stop = np.cumsum(size)
                spells = len(run) == 1 or all((f[np.searchsorted(f, stop)] == stop).all() for f in found)
            if not spells:
                if len(run) > 1:
                    again += [[k] for k in run]
                continue
            kept += run
            sizes.append(size)
            for side, values, stops in zip((0, 1), (a, b), found):
                ids[side].extend(values)
                ends[side].append(stops + base)
            base += len(raw)
        if kept:
            out.cut(kept, np.concatenate(sizes), *ids, *map(np.concatenate, ends))
        return again


class Aligned:
    """What is known of each of ``n`` pieces of text: numbers (n_a, n_b,
    n_groups, n_links, and where its pairs begin and how many they are),
    spelling (None: no tokens), and the distinct pairs of all with their times."""

    def __init__(self, n: int):
        self.facts = np.zeros((n, 6), np.int64)
        self.spelt: list[bytes | None] = [None] * n
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cut(self, pieces, sizes, a_flat, b_flat, a_at, b_at) -> None:
        """Many pieces at once, as if they were one text, from the exact ends of
        their tokens: ends in common cut both sides alike."""
        stop = np.cumsum(sizes)
        n_a, n_b = (np.diff(np.r_[0, np.searchsorted(at, stop, "right")]) for at in (a_at, b_at))
        cuts = np.intersect1d(a_at, b_at, assume_unique=True)
        a_stop, b_stop = np.searchsorted(a_at, cuts, "right"), np.searchsorted(b_at, cuts, "right")
        in_a, in_b = np.diff(np.r_[0, a_stop]), np.diff(np.r_[0, b_stop])
        piece = np.searchsorted(stop, cuts, "left")
        groups = np.bincount(piece, minlength=len(pieces))
        links = np.bincount(piece, in_a * in_b, minlength=len(pieces)).astype(np.int64)

        names_a, names_b = list(map(str, a_flat)), list(map(str, b_flat))
        spelt = [names_a[i1 - 1] + "|" + names_b[j1 - 1] if i == j == 1 else ",".join(names_a[i1 - i:i1]) + "|" + ",".join(names_b[j1 - j:j1])
                 for i, i1, j, j1 in zip(in_a.tolist(), a_stop.tolist(), in_b.tolist(), b_stop.tolist())]
        # groups of many tokens on both sides are counted by themselves: their links are no rows
        wide = in_a * in_b > 4096
        some = ~wide
        first_a, first_b, of = (a_stop - in_a)[some], (b_stop - in_b)[some], piece[some]
        size = (in_a * in_b)[some]
        group = np.repeat(np.arange(len(size)), size)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        a, b = np.array(a_flat, np.int64), np.array(b_flat, np.int64)
        wb = in_b[some][group]
        key = a[first_a[group] + place // wb] << 32 | b[first_b[group] + place % wb]
        owner, times = of[group], np.ones(len(key), np.int64)
        for g in np.flatnonzero(wide):
            more, much = pair_counts(a[a_stop[g] - in_a[g]:a_stop[g]], b[b_stop[g] - in_b[g]:b_stop[g]])
            key, times, owner = np.r_[key, more], np.r_[times, much], np.r_[owner, np.full(len(more), piece[g])]
        order = np.lexsort((key, owner))
        key, owner, times = key[order], owner[order], times[order]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        key, owner, times = key[new], owner[new], np.add.reduceat(times, new)
        edge = np.searchsorted(owner, np.arange(len(pieces) + 1))
        self.facts[pieces] = np.stack([n_a, n_b, groups, links, edge[:-1] + len(self.pairs), np.diff(edge)], axis=1)
        self.pairs, self.times = np.r_[self.pairs, key], np.r_[self.times, times]
        begin = 0
        for p, end in zip(pieces, np.cumsum(groups).tolist()):
            self.spelt[p] = ";".join(spelt[begin:end]).encode()
            begin = end


#: Bytes that may follow a space at which segments are cut: no white space, and
#: no lead byte of white space beyond ASCII but C2 (told apart by the next byte).
_GO = np.ones(256, bool)
_GO[[*range(9, 14), 32, 0x85, 0xA0, 0xE1, 0xE2, 0xE3, *range(28, 32)]] = False


def segment_starts(data: np.ndarray, by_line: bool) -> np.ndarray:
    """Where segments begin in the bytes of texts, each with a space before it:
    at a space, and with ``by_line`` a newline, that comes after no space and
    stands before a character that is no white space."""
    mark = (data == 32) | (data == 10) if by_line else data == 32
    inside = mark[1:-2] & (data[:-3] != 32) & _GO[data[2:-1]] & ~((data[2:-1] == 0xC2) & np.isin(data[3:], (0x85, 0xA0)))
    return np.flatnonzero(inside) + 1


class Segments:
    """What is known per distinct segment: its numbers, spelling and pairs."""

    def __init__(self, aligner: Aligner, limit: int = 500_000):
        self.aligner, self.limit = aligner, limit
        self.clear()

    def clear(self) -> None:
        self.table = HashTable()
        self.spelt: list[bytes | None] = []
        self.facts = np.zeros((1 << 12, 6), np.int64)               # n_a, n_b, n_groups, n_links, first pair, pairs
        self.pairs, self.times, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _learn(self, texts: list[str]) -> None:
        for k in range(0, len(texts), 20_000):
            self._add(self.aligner.align(texts[k:k + 20_000]))

    def _add(self, found: Aligned) -> None:
        n, size, more = len(self.spelt), len(found.spelt), len(found.pairs)
        while n + size > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        while self.used + more > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
            self.times = np.concatenate([self.times, np.zeros_like(self.times)])
        self.pairs[self.used:self.used + more] = found.pairs
        self.times[self.used:self.used + more] = found.times
        found.facts[:, 4] += self.used
        self.facts[n:n + size] = found.facts
        self.used += more
        self.spelt += found.spelt

    def numbers(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every segment, learning what is new."""
        h = span_hashes(data, starts, ends)
        number = self.table.find(h)
        if len(number) and number.min() < 0:
            if self.table.n > self.limit:
                self.clear()
                number[:] = -1
            new = np.flatnonzero(number < 0)
            fresh, first = np.unique(h[new], return_index=True)
            try:
                self.table.add(fresh)
                self._learn([raw[starts[k]:ends[k]].decode() for k in new[first]])
            except BaseException:
                self.clear()                                        # no half-known segments for the worker's next task
                raise
            number = self.table.find(h)
        return number


def pair_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (A id << 32 | B id) of a group, and how often each is linked."""
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    return (ua[:, None] << 32 | ub[None, :]).ravel(), (na[:, None] * nb[None, :]).ravel()


def sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values[order], first)


def _rows_of(texts: list[bytes | None], segments: Segments):
    """Per text: n_a, n_b, n_groups, n_links, digest, pairs, times."""
    empty = np.zeros(0, np.int64)
    whole = [i for i, t in enumerate(texts) if t]
    out = [(0, 0, 0, 0, "", empty, empty)] * len(texts)
    if not whole:
        return out
    raw = b" " + b"\n ".join(texts[i] for i in whole) + b"\n\n\n"        # the newlines between stand before spaces
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(texts[i]) + 2 for i in whole])
    text_starts = np.r_[0, np.cumsum(sizes)]
    cuts = segment_starts(data, segments.aligner.by_line) if segments.aligner.by_segment else empty
    starts = np.sort(np.r_[text_starts[:-1], cuts], kind="stable")
    starts = starts[np.r_[True, starts[1:] != starts[:-1]]]
    starts = starts[starts < text_starts[-1] - 1]
    first = np.searchsorted(starts, text_starts)
    ends = np.r_[starts[1:], text_starts[-1]]
    ends[first[1:] - 1] = text_starts[1:] - 1                       # without the newline between texts
    number = segments.numbers(data, raw, starts, ends)
    facts, spelt = segments.facts[number], segments.spelt
    totals = np.add.reduceat(facts[:, :4], first[:-1], axis=0)
    for k, i in enumerate(whole):
        own = number[first[k]:first[k + 1]]
        parts = [spelt[n] for n in own.tolist()]
        if None in parts:
            continue
        seen, repeats = np.unique(own, return_counts=True)
        begin, size = segments.facts[seen, 4], segments.facts[seen, 5]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        pairs, times = sum_by(segments.pairs[at], segments.times[at] * np.repeat(repeats, size))
        out[i] = (*totals[k].tolist(), hashlib.sha256(b";".join(parts)).hexdigest(), pairs, times)
    return out


@lru_cache(maxsize=1)
def worker_segments(byte_path: str, piece_path: str) -> Segments:
    """What this worker knows, kept from task to task."""
    return Segments(Aligner(byte_path, piece_path))


def _align(byte_path: str, piece_path: str):
    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        segments = worker_segments(byte_path, piece_path)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or b"") <= 2_000_000):
                    size += len(texts[stop] or b"")
                    stop += 1
                rows = _rows_of(texts[start:stop], segments)
                columns = list(zip(*rows))
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in c])].astype(np.int32)), pa.array(np.concatenate(c)))
                         for c in columns[5:]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()), *lists],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                start = stop
    return run


def _look_up(shared):
    def run(batches):
        keys, counts, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            offsets = pairs.offsets.to_numpy()
            flat = pairs.values.to_numpy()[offsets[0]:offsets[-1]]
            times = times.values.to_numpy()[times.offsets[0].as_py():times.offsets[-1].as_py()]
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            held = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            total = lambda v: np.r_[0, np.cumsum(v)][offsets - offsets[0]]
            some = [pa.array(np.diff(total(v))) for v in (np.where(held, times * best[at], 0), np.where(held, times * counts[at], 0))] if len(row) else [
                pa.array(np.zeros(batch.num_rows, np.int64))] * 2
            yield pa.RecordBatch.from_arrays([batch.column("row"), *some], names=["row", "n_best", "count_sum"])
    return run


def pair_table(facts: DataFrame) -> DataFrame:
    """a_id, b_id, n_docs, best: in how many rows each pair is linked, and
    whether no pair of its A id is in more."""
    counts = facts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = counts.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "n_docs")
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a_id").select("a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _ranges(table: DataFrame, block_pairs: int) -> list[tuple[int, int]]:
    """Ranges of A ids with at most ``block_pairs`` pairs, or one id, each."""
    sizes = sorted((r.a_id, r["count"]) for r in table.groupBy("a_id").count().collect())   # at most A's vocabulary
    out: list[list[int]] = []
    total = 0
    for a, n in sizes:
        if not out or total + n > block_pairs:
            out.append([a, a])
            total = 0
        out[-1][1] = a
        total += n
    return [(a, b) for a, b in out]


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, block_pairs: int = 4_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256
    for every row of ``docs`` (doc_id, text)."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = stage_table(texts.mapInArrow(_align(byte_path, piece_path), FACTS).withColumn("row", F.monotonically_increasing_id()), "alignment-facts")
    table = stage_table(pair_table(facts), "alignment-pairs")
    sums = None
    for low, high in _ranges(table, block_pairs):
        # at most block_pairs rows, or B's vocabulary
        part = table.where(F.col("a_id").between(low, high)).select(
            (F.shiftleft("a_id", 32) + F.col("b_id")).alias("pair"), "n_docs", F.col("best").cast("long").alias("best")).toArrow()
        keys, counts, best = (part.column(c).to_numpy() for c in ("pair", "n_docs", "best"))
        order = np.argsort(keys)
        shared = spark.sparkContext.broadcast((keys[order], counts[order], best[order]))
        found = facts.select("row", "pairs", "times").mapInArrow(_look_up(shared), "row long, n_best long, count_sum long")
        sums = found if sums is None else sums.unionByName(found)
    if sums is None:
        sums = spark.createDataFrame([], "row long, n_best long, count_sum long")
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return facts.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
