"""Language identification by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary; each language has its own piece
probabilities.  A word's probability in a language is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product
over its words, and with the languages' priors the posterior decides.

The probabilities are learnt by expectation-maximisation from labelled texts:
the expected use of each piece over all segmentations of the counted words,
worked out by Spark over the word table and summed per language and piece.
Only those sums (at most vocabulary x languages numbers) reach the driver.
The fit uses about ``fit_rows`` labelled documents per language, chosen by a
hash of the id; labels decide nothing else.

Words are whole lower-cased runs of letters and digits after the vocabulary's
word mark.  Those of up to ``SHORT`` characters are worked out many at once;
longer ones, of any length, one by one in logarithms, in blocks of positions
with the sums of the last places carried on.  A character no piece covers costs
the same in every language.  Null text and text without a letter
are ``und`` with score 0; without any label all texts are.  Ties go to the
language that sorts first.  Documents are scored row by row.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from math import exp, inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, prepare, stage_table, text_blocks, unit_hash
from .wordtable import NOT_ALNUM, HashTable, Words, WordValues, plain_bytes, span_hashes, sum_runs

MARK = "▁"
#: Up to this many characters a product of probabilities stays within doubles.
SHORT = 32
UNKNOWN = 1e-6


def _spells(piece: str) -> bool:
    """Whether a piece is letters, digits and their marks after word marks."""
    rest = piece.strip(MARK)
    return bool(rest) and all(unicodedata.category(c)[0] in "LNM" for c in rest)


def vocabulary(path: str) -> list[str]:
    """The pieces of letters, digits and their marks, as they are lower-cased;
    the word mark stays."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i)}
    return sorted(p for p in pieces if p == p.lower() and _spells(p)) + [MARK]


class Lattice:
    """All pieces inside a list of words: arrays of edges by end position and
    length, so the forward and backward sums run over all words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        self.table = HashTable()
        h = span_hashes(data, ends - sizes, ends)
        self.table.add(h)

    def edges(self, words: list[str]):
        """(number of positions of each word, {(end, length): (words, pieces)});
        piece -1 is a single character no piece covers."""
        raw = [(MARK + w).encode("utf-8", "surrogatepass") for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        char = np.flatnonzero((data & 0xC0) != 0x80)              # where characters begin
        word = np.repeat(np.arange(len(raw)), sizes)[char]
        n = np.bincount(word, minlength=len(raw))
        first = np.cumsum(n) - n
        place = np.arange(len(char)) - first[word]
        edge = np.r_[char, len(data)]
        found = {}
        for length in range(1, min(self.longest, int(n.max(initial=0))) + 1):
            start = np.flatnonzero(place + length <= n[word])
            piece = self.table.find(span_hashes(data, edge[start], edge[start + length]))
            keep = (piece >= 0) | (length == 1)
            start, piece = start[keep], piece[keep]
            end = place[start] + length
            order = np.argsort(end, kind="stable")
            cuts = np.searchsorted(end[order], np.arange(1, int(n.max(initial=0)) + 2))
            for k in range(len(cuts) - 1):
                some = order[cuts[k]:cuts[k + 1]]
                if len(some):
                    found[k + 1, length] = (word[start[some]], piece[some])
        return n, found

    def places(self, word: str, block: int = 65_536):
        """The characters' number, and by blocks of starting places the piece of
        each length (-1: none) as a list of rows, through ``rows(first place)``."""
        raw = (MARK + word).encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        edge = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        n = len(edge) - 1

        def rows(at: int) -> list:
            stop = min(at + block, n)
            table = np.full((stop - at, self.longest), -1, np.int32)
            for length in range(1, self.longest + 1):
                start = np.arange(at, min(stop, n - length + 1))
                if len(start):
                    table[:len(start), length - 1] = self.table.find(span_hashes(data, edge[start], edge[start + length]))
            return [[(k + 1, piece) for k, piece in enumerate(row) if piece >= 0 or k == 0] for row in table.tolist()]

        return n, range(0, n, block), rows

    def log_sum(self, word: str, logs: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of a word of any length, per
        column of ``logs`` (log probabilities of the pieces)."""
        n, blocks, rows = self.places(word)
        ring = np.full((self.longest + 1, logs.shape[1]), -inf)
        ring[0] = 0.0
        for at in blocks:
            for start, row in enumerate(rows(at), at):
                here = ring[start % len(ring)].copy()
                ring[start % len(ring)] = -inf
                for length, piece in row:
                    to = (start + length) % len(ring)
                    ring[to] = np.logaddexp(ring[to], here + logs[piece])
        return ring[n % len(ring)]

    def log_uses(self, word: str, logs: np.ndarray):
        """(piece, expected uses) over the segmentations of a word of any
        length, for one language's log probabilities."""
        n, blocks, rows = self.places(word)
        logs = logs.tolist()
        alpha = np.full(n + 1, -inf)
        alpha[0] = 0.0
        for at in blocks:
            for start, row in enumerate(rows(at), at):
                for length, piece in row:
                    alpha[start + length] = np.logaddexp(alpha[start + length], alpha[start] + logs[piece])
        beta = np.full(n + 1, -inf)
        beta[n] = 0.0
        for at in reversed(blocks):
            table = rows(at)
            for start in range(at + len(table) - 1, at - 1, -1):
                for length, piece in table[start - at]:
                    step = logs[piece] + beta[start + length]
                    beta[start] = np.logaddexp(beta[start], step)
                    yield piece, exp(min(alpha[start] + step - alpha[n], 0.0))


def forward(n, edges, p, own=None):
    """Sums over segmentations of the words' beginnings; ``p`` is one row of
    probabilities per piece (the last row for unknown characters).  With
    ``own``, each word's sums are for its own language only."""
    alpha = np.zeros((int(n.max(initial=0)) + 1, len(n), p.shape[1] if own is None else 1))
    alpha[0] = 1.0
    for (end, length), (word, piece) in sorted(edges.items()):
        alpha[end, word] += alpha[end - length, word] * (p[piece] if own is None else p[piece, own[word]][:, None])
    return alpha


def backward(n, edges, p, own):
    """Sums over segmentations of what follows each place."""
    beta = np.zeros((int(n.max(initial=0)) + 1, len(n), 1))
    beta[n, np.arange(len(n))] = 1.0
    for (end, length), (word, piece) in sorted(edges.items(), reverse=True):
        beta[end - length, word] += beta[end, word] * p[piece, own[word]][:, None]
    return beta


@dataclass
class LanguageModel:
    languages: list
    prior: np.ndarray            # log
    pieces: list
    p: np.ndarray                # piece x language, a last row for unknown characters

    def scorer(self):
        """Log probabilities of whole texts, words remembered by this worker."""
        lattice, width = Lattice(self.pieces), len(self.languages)

        logp = np.log(self.p)

        def learn(words: list[bytes]):
            names = [w.decode("utf-8", "replace") for w in words]
            logs = np.zeros((len(names), width))
            short = [k for k, w in enumerate(names) if len(w) <= SHORT]
            for b in range(0, len(short), 20_000):
                some = short[b:b + 20_000]
                n, edges = lattice.edges([names[k] for k in some])
                alpha = forward(n, edges, self.p)
                logs[some] = np.log(np.maximum(alpha[n, np.arange(len(n))], 1e-300))
            for k, w in enumerate(names):
                if len(w) > SHORT:
                    logs[k] = lattice.log_sum(w, logp)
            return logs.astype(np.float32).ravel(), np.full(len(words), width)

        return WordValues(learn, np.float32)

    def log_scores(self, values: WordValues, texts: list[bytes]) -> np.ndarray:
        words = Words(texts, NOT_ALNUM)
        rows, _ = values.rows(values.numbers(words))
        return sum_runs(rows.reshape(-1, len(self.languages)), words.first) + self.prior


# ---------------------------------------------------------------- learning
def _count_words(batches):
    for batch in batches:
        lang, texts = batch.column("lang").to_pylist(), [plain_bytes(t) for t in batch.column("text").to_pylist()]
        names = sorted(set(lang))
        for a, b in text_blocks(texts, 2_000_000):
            words = Words(texts[a:b], NOT_ALNUM)
            code = np.array([names.index(x) for x in lang[a:b]], np.uint64)[words.owner()]
            key, first, count = np.unique(words.hash * np.uint64(64) ^ code, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({
                "lang": [names[c] for c in code[first].tolist()], "word": [words.word(k).decode("utf-8", "replace") for k in first],
                "n": count.astype(np.int64)}), preserve_index=False)


def _expected(shared):
    """E-step: expected uses of each piece, per batch and language."""
    def run(batches):
        pieces, languages, p = shared.value
        lattice, code = Lattice(pieces), {x: k for k, x in enumerate(languages)}
        for batch in batches:
            total = np.zeros(p.shape)
            lang, words, times = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
            flat = [(code[x], w, c) for x, w, c in zip(lang, words, times) if len(w) <= SHORT]
            logs = np.log(p)
            for x, w, c in zip(lang, words, times):
                if len(w) > SHORT:
                    for piece, use in lattice.log_uses(w, logs[:, code[x]]):
                        total[piece, code[x]] += use * c
            for k in range(0, len(flat), 20_000):
                block = flat[k:k + 20_000]
                own = np.array([x[0] for x in block])
                weight = np.array([x[2] for x in block], float)
                n, edges = lattice.edges([x[1] for x in block])
                alpha, beta = forward(n, edges, p, own), backward(n, edges, p, own)
                z = np.maximum(alpha[n, np.arange(len(n)), 0], 1e-300)
                for (end, length), (word, piece) in edges.items():
                    use = alpha[end - length, word, 0] * p[piece, own[word]] * beta[end, word, 0] / z[word] * weight[word]
                    np.add.at(total, (piece, own[word]), use)
            at = np.nonzero(total[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])],
                names=["piece", "lang", "uses"])
    return run


def learn(docs: DataFrame, pieces: list[str], fit_rows: int = 800, rounds: int = 3, floor: float = 0.02) -> LanguageModel | None:
    """Fit on the labelled rows that are not held out; None without any."""
    spark = prepare(docs.sparkSession)
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        "text IS NOT NULL AND lang IS NOT NULL").where(F.coalesce(fold() != 1, F.lit(True)))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, fit_rows / counts[k])])
    sample = usable.where(unit_hash("doc_id", seed=4) < share[F.col("lang")])
    words = stage_table(sample.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    p = np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces))
    p[-1] = UNKNOWN
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, languages, p))
        sums = words.mapInArrow(_expected(shared), "piece int, lang int, uses double").groupBy("piece", "lang").agg(
            F.sum("uses").alias("uses")).toPandas()
        uses = np.full((len(pieces), len(languages)), floor)
        uses[sums["piece"], sums["lang"]] += sums["uses"]
        p = np.vstack([uses / uses.sum(axis=0), np.full(len(languages), UNKNOWN)])
        shared.unpersist()
    total = sum(counts.values())
    return LanguageModel(languages, np.log([counts[k] / total for k in languages]), pieces, p)


# ---------------------------------------------------------------- scoring
def _predict(shared):
    def run(batches):
        model = shared.value
        values = model.scorer()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            raw = [plain_bytes(t) for t in texts]
            logs = [model.log_scores(values, raw[a:b]) for a, b in text_blocks(raw, 1_000_000)]
            logs = np.concatenate(logs) if logs else np.zeros((0, len(model.languages)))
            odds = np.exp(logs - logs.max(axis=1, keepdims=True, initial=-np.inf))
            best = odds.argmax(axis=1) if len(logs) else np.zeros(0, int)
            score = (odds / odds.sum(axis=1, keepdims=True))[np.arange(len(best)), best]
            letter = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([model.languages[k] if ok else "und" for k, ok in zip(best, letter)], pa.string()),
                 pa.array(np.where(letter, score, 0.0))], names=["doc_id", "lang_pred", "score"])
    return run


def predict_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of that language)."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", held_out().alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
