"""Toxicity by multiple-instance learning.

Words are lower-cased runs of letters and digits, and the single characters of
scripts without spaces.  Only documents carry labels.  A sentence's score is a
logistic function of its words; a document's is the noisy-or of its sentences:
it is toxic unless every sentence is clean.  The weights are fitted to the document labels through that
combination, so the sentences that make a document toxic get the credit, and
:func:`offending_sentences` can point to them.

Learning: Spark counts, over a sample of at most ``fit_rows`` labelled
documents of each class, in how many documents of either class each word
occurs; the words that toxic documents hold most out of proportion
(log-likelihood ratio, and at least ``least_lift`` times as often) are the
model's vocabulary, all words that tell the classes apart.  The sample's sentences,
reduced to those words, are what the driver fits the weights on.  A sentence
without any such word scores zero, so length alone never adds up to toxicity.

Labels must be 0 or 1; other values, null ids and held-out ids (crc32 of the
id modulo 3 is 1) are not learnt from.  With labels of one class only, or
none, the score is the labelled rate (0 without labels).  Null and empty texts
get the score of no evidence.  Repeated rows are scored row by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, prepare, stage_table, text_blocks, unit_hash
from .wordtable import NOT_ALNUM, LINES, STOPS, HashTable, Words, word_bytes

_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".!?\n"]] = 1
_SENTENCE_END = re.compile(f"[.!?\n{STOPS}{LINES}]")


@dataclass
class ToxicityModel:
    """Word hashes with their weights; ``rate`` is the score without evidence."""
    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    rate: float

    def table(self) -> HashTable:
        if not hasattr(self, "_table"):
            self._table = HashTable()
            self._table.add(self.hashes)
        return self._table

    def sentences(self, texts: list[bytes]):
        """The words, and of each sentence with evidence its text, number in
        the block and score."""
        words = Words(texts, NOT_ALNUM)
        feature = self.table().find(words.hash)
        at = np.flatnonzero(feature >= 0)
        sentence = np.cumsum(_STOP[words.data])[words.starts[at]] if len(at) else at
        number, run = np.unique(sentence, return_inverse=True)
        z = self.bias + np.bincount(run, weights=self.weights[feature[at]], minlength=len(number))
        first = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
        text = words.owner()[at[first]]
        return words, text, number, 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        _, text, _, p = self.sentences(texts)
        clean = np.bincount(text, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts))
        return 1 - (1 - self.rate) * np.exp(clean)


# ---------------------------------------------------------------- learning
def _document_counts(batches):
    """Per batch: each word, with the number of toxic and of clean documents
    that hold it."""
    for batch in batches:
        texts, toxic = [word_bytes(t) for t in batch.column("text").to_pylist()], batch.column("toxic").to_numpy()
        for a, b in text_blocks(texts, 2_000_000):
            words = Words(texts[a:b], NOT_ALNUM)
            pair = np.unique(np.stack([words.hash, words.owner().astype(np.uint64)]), axis=1)
            h, run = np.unique(pair[0], return_inverse=True)
            y = toxic[a:b][pair[1].astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(np.bincount(run, weights=y, minlength=len(h)).astype(np.int64)),
                 pa.array(np.bincount(run, weights=1 - y, minlength=len(h)).astype(np.int64))],
                names=["word", "toxic", "clean"])


def _reduce(hashes: np.ndarray):
    """Documents as (bag, toxic, sentence, feature, count) of vocabulary words."""
    def run(batches):
        table = HashTable()
        table.add(hashes)
        for batch in batches:
            docs, toxic = batch.column("bag").to_pylist(), batch.column("toxic").to_pylist()
            texts = [word_bytes(t) for t in batch.column("text").to_pylist()]
            for a, b in text_blocks(texts, 2_000_000):
                words = Words(texts[a:b], NOT_ALNUM)
                feature = table.find(words.hash)
                at = np.flatnonzero(feature >= 0)
                sentence = np.cumsum(_STOP[words.data])[words.starts[at]] if len(at) else at
                owner = words.owner()[at]
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "bag": np.array(docs[a:b], np.int64)[owner], "sentence": sentence.astype(np.int64),
                    "feature": feature[at].astype(np.int32)}), preserve_index=False)
    return run


def fit_noisy_or(doc, sentence, feature, y, n_features: int, rounds: int = 400, decay: float = 1e-4):
    """Weights and bias by gradient descent on the documents' log-likelihood.
    ``doc`` of each sentence, ``sentence`` and ``feature`` of each occurrence."""
    w, bias, rate = np.zeros(n_features), -2.0, 0.01
    class_weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    m = np.zeros(n_features + 1)
    v = np.zeros(n_features + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sentence, weights=w[feature], minlength=len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + np.log1p(-rate)
        stay = np.exp(clean)
        per_doc = class_weight * np.where(y == 1, -stay / np.maximum(1 - stay, 1e-6), 1.0)
        g_z = per_doc[doc] * p
        g = np.r_[np.bincount(feature, weights=g_z[sentence], minlength=n_features) + decay * w, g_z.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias), rate


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = 6000,
          least_gain: float = 20.0, least_lift: float = 4.0) -> ToxicityModel:
    """Fit on at most about ``fit_rows`` labelled documents of each class, on
    all their words that tell the classes apart by ``least_gain`` and are
    ``least_lift`` times as frequent in toxic documents."""
    spark = prepare(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold() != 1)
    sizes = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0,
                          float(bool(sizes.get(1))) if len(sizes) == 1 else 0.0)
    if len(sizes) < 2:
        return empty
    share = F.when(F.col("toxic") == 1, fit_rows / sizes[1]).otherwise(fit_rows / sizes[0])
    chosen = usable.where(unit_hash("doc_id", seed=7) < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most about 2 * fit_rows ids: small enough to send to every task
    sample = stage_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                         .join(F.broadcast(chosen), "doc_id").withColumn("bag", F.monotonically_increasing_id()), "toxicity-sample")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return empty

    words = sample.select("text", "toxic").mapInArrow(_document_counts, "word long, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b"))

    def part(count, of, expected):
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    a, b, n1, n0 = F.col("a"), F.col("b"), float(n[1]), float(n[0])
    rate = (a + b) / (n1 + n0)
    gain = 2 * (part(a, n1, n1 * rate) + part(b, n0, n0 * rate)
                + part(n1 - a, n1, n1 * (1 - rate)) + part(n0 - b, n0, n0 * (1 - rate)))
    best = words.withColumn("gain", gain).where((F.col("gain") >= least_gain) & (a / n1 >= least_lift * b / n0)).orderBy(F.desc("gain"), "word")
    hashes = np.array([r.word for r in best.select("word").collect()], np.int64).view(np.uint64)
    if not len(hashes):
        return ToxicityModel(hashes, np.zeros(0), 0.0, n1 / (n1 + n0))

    bags = sample.select("bag", "toxic").toPandas()
    seen = sample.select("bag", "toxic", "text").mapInArrow(
        _reduce(hashes), "bag long, sentence long, feature int").orderBy("bag", "sentence", "feature").toPandas()
    bags = bags.sort_values("bag").reset_index(drop=True)
    y = bags["toxic"].to_numpy(np.float64)
    key, run = np.unique(np.stack([seen["bag"], seen["sentence"]]), axis=1, return_inverse=True)
    doc = np.searchsorted(bags["bag"].to_numpy(), key[0])
    w, bias, rate0 = fit_noisy_or(doc, run.ravel(), seen["feature"].to_numpy(), y, len(hashes))
    return ToxicityModel(hashes, w, bias, rate0)


# ---------------------------------------------------------------- scoring
def _score(model):
    def run(batches):
        for batch in batches:
            texts = [word_bytes(t) for t in batch.column("text").to_pylist()]
            out = [model.value.scores(texts[a:b]) for a, b in text_blocks(texts, 1_000_000)]
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])
    return run


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_score(shared), "doc_id long, score double")
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def _keep(model, threshold):
    def run(batches):
        for batch in batches:
            texts = [word_bytes(t) for t in batch.column("text").to_pylist()]
            out = [model.value.scores(texts[a:b]) for a, b in text_blocks(texts, 1_000_000)]
            yield batch.filter(pa.array((np.concatenate(out) if out else np.zeros(0)) < threshold))
    return run


def clean_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score under the threshold."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, threshold), docs.schema)


def _locate(model, threshold):
    def run(batches):
        for batch in batches:
            docs, plain = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            texts = [word_bytes(t) for t in plain]
            rows = []
            for a, b in text_blocks(texts, 1_000_000):
                words, text, number, p = model.value.sentences(texts[a:b])
                before = np.r_[0, np.cumsum(_STOP[words.data])][words.text_starts]
                number, known = number - before[text], -1
                for t, s, score in zip(text.tolist(), number.tolist(), p.tolist()):
                    if score >= threshold:
                        if t != known:
                            known, lower = t, plain[a + t].lower()
                            ends = [0, *(m.end() for m in _SENTENCE_END.finditer(lower)), len(lower)]
                        rows.append((docs[a + t], len(lower[:ends[s]].encode("utf-8", "surrogatepass")), score,
                                     lower[ends[s]:ends[s + 1]].strip()))
            yield pd.DataFrame(rows, columns=["doc_id", "start_byte", "score", "sentence"])
    return lambda batches: (pa.RecordBatch.from_pandas(f, pa.schema([
        ("doc_id", pa.int64()), ("start_byte", pa.int64()), ("score", pa.float64()), ("sentence", pa.string())]),
        preserve_index=False) for f in run(batches))


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, start_byte (in the lower-cased UTF-8 text), score and the
    lower-cased sentence, for each sentence at or over the threshold."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _locate(shared, threshold), "doc_id long, start_byte long, score double, sentence string")
