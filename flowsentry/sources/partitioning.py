"""Input parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame


def ensure_parallelism(df: DataFrame, key: str | None = "row_id") -> DataFrame:
    """Spread an input that arrives in fewer splits than the cluster has
    cores (a single-row-group parquet file, one small CSV) over
    ``defaultParallelism`` partitions, hashed on a unique key so the layout is
    deterministic and balanced.  An input that already has enough splits -
    any large table - is returned untouched, so no shuffle is added at scale.
    Never hash on a grouping key here: one hot source would land in one task.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    if have >= want:
        return df
    if key and key in df.columns:
        return df.repartition(want, key)
    return df.repartition(want)
