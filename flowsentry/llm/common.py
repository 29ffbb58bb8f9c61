"""Small helpers the operators share: table access, stage tables in the shared
folder, the learn/held-out split, and batching of texts inside tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder under the shared checkpoint directory and
    read it back: cuts the lineage with files that outlive any executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable by the Python workers."""
    ship_package(spark)
    return spark


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the fold is 1; a null id is never held out (and no labels
    join to it)."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit_hash(*cols, seed: int = 0) -> Column:
    """A uniform number in [0, 1) fixed by the values of ``cols``."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.pmod(h, F.lit(1 << 30)) / float(1 << 30)


def text_blocks(texts, limit: int = 8_000_000):
    """Split a list of texts into ranges of about ``limit`` characters, so the
    arrays built for a range stay small whatever the batch holds.  A text
    longer than the limit is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
