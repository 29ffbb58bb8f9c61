"""Token counts through a digest cache.

A text is known by two digests: one of its normalised content and one of the
tokenizer file.  Texts whose pair is stored in the cache are not encoded
again; the distinct misses are encoded once, whatever the number of copies,
and appended to the cache table, from which all documents are then answered.

Normalisation here is what the tokenizer itself does before it counts: none
for the piece model (its file says identity), so the content digest is over
the text's UTF-8 bytes.

Encoding inside a task uses that no piece of the model continues past a space
(checked when the model is loaded): the count of a text is the sum over its
space-separated segments, and segments repeat.  A text that already holds the
model's space mark is encoded whole, as is every text if the check fails.

Null text counts as empty (0 tokens); repeated documents and repeated ids are
answered row by row; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

CACHE_SCHEMA = "tokenizer string, content string, n_tokens long"
SPACE = "▁"
_SEGMENT = re.compile(" +[^ ]*")


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer file: a new version of it never meets counts of
    an older one."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class PieceCounter:
    """Counts tokens of whole texts; remembers the counts of short segments in
    a table of at most ``limit`` entries per worker."""

    def __init__(self, path: str, limit: int = 400_000):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.by_segment = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.limit = limit
        # a last space alone: the empty segment, which by itself would encode to nothing
        self.space = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.known: dict[str, int] = {"": self.space}

    def _lengths(self, segments: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(segments, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        split, out = [], []
        fresh: dict[str, int] = {}
        for text in texts:
            if not self.by_segment or SPACE in text:
                split.append(None)
                continue
            if "  " in text or text[:1] == " " or text[-1:] == " ":
                # the model puts one space before a text: leave it out of each segment
                segments = [s[1:] for s in _SEGMENT.findall(" " + text)] if text else []
            else:
                segments = text.split(" ") if text else []
            split.append(segments)
            known = self.known
            for s in segments:
                if s not in known:
                    fresh[s] = 0
        if fresh:
            names = list(fresh)
            fresh = dict(zip(names, self._lengths(names)))
            if len(self.known) + len(fresh) > self.limit:
                keep = {s for segments in split if segments for s in segments}
                self.known = {s: n for s, n in self.known.items() if s in keep or not s}
            self.known.update(fresh)
        get = self.known.__getitem__
        for text, segments in zip(texts, split):
            out.append(self._lengths([text])[0] if segments is None else sum(map(get, segments)))
        return out


def _encode_misses(path: str):
    def run(batches):
        from .common import text_blocks
        counter = PieceCounter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts: list[int] = []
            for a, b in text_blocks(texts, 2_000_000):
                counts += counter.count(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())],
                                             names=["content", "n_tokens"])
    return run


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """The stored counts of one tokenizer version, one row per content.  A
    cache folder that does not exist yet is an empty cache."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], "content string, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may append the same text


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``; the
    cache at ``cache_path`` is extended by the texts it did not hold."""
    spark = prepare(docs.sparkSession)
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("content"))

    known = read_cache(spark, cache_path, version)
    misses = (keyed.select("content", "text").join(known.select("content"), "content", "left_anti")
              .dropDuplicates(["content"]))
    (misses.mapInArrow(_encode_misses(tokenizer_path), "content string, n_tokens long")
     .select(F.lit(version).alias("tokenizer"), "content", "n_tokens")
     .write.mode("append").parquet(cache_path))

    counts = read_cache(spark, cache_path, version)
    return (keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
            .join(counts, "content")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
