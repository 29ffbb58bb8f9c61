"""A training corpus from the ``documents`` table, in five stages.

Toxic documents go; of each group of near duplicates one stays; byte strings
that documents share are cut from all but the first; documents holding
benchmark passages go; what is left is tokenised and packed into sequences.

Each stage works on all rows its predecessor kept, is written as Parquet and
read again by the next.  All but the last return the columns of
``documents``.  SQL cannot express the stages (a trained score, components of
a similarity graph, byte strings, a tokenizer), so there is no oracle text;
``tests/llm`` compares every stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm import decontaminate, packing, simhash, suffix_dedup, toxicity
from flowsentry.llm.common import fresh, read_table, stage_table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.7 with a model learnt from this stage's input."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model, threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group."""
    return simhash.representatives(docs, shingle=3, bound=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that an earlier document holds.  A
    character cut in two is dropped, and so is a document of which nothing is
    left; ``n_chars`` follows the text where it changed."""
    null = fresh(docs, "null_text")
    cut = suffix_dedup.remove_repeats(docs.withColumn(null, F.col("text").isNull()), length=50, whole_characters=True)
    valid = F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(F.col(null), None).otherwise(valid)
    left = cut.where((F.col("n_removed") == 0) | (F.octet_length("kept") > 0)).withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of ``benchmark``."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their sequences."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stage_table(docs, f"pipeline-{name}")
    return docs
