"""Flow CSV ingest (S1-S8) and column typing.

Files are scanned with every column as text; typing decisions that depend on
a whole column (all-or-nothing casts, the first time format that fits every
value) are taken from one probe over all columns at once, an aggregate per
split that counts its rows for the row index as well.  So the input is read
twice, for the probe and for the data, and a third time only where a time
column holds neither numbers nor ISO times and some format has the right shape.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import (FLOW_COLUMNS, HEADER_HINT_COLUMNS, NUMERIC_COLUMNS,
                      REQUIRED_COLUMNS, TIME_COLUMNS, TIME_FORMATS)
from ..session import scratch_path
from .partitioning import ensure_parallelism


# ---------------------------------------------------------------- S7
def select_input_files(spark: SparkSession, directory: str, max_bytes: int | None = None) -> DataFrame:
    """Every ``.csv`` file under ``directory`` (path, length).  Only file
    metadata is read; the content column is never selected.  With ``max_bytes``
    a larger file is an error, never left out silently."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
             .option("recursiveFileLookup", "true").load(directory).select("path", "length"))
    if max_bytes is not None:
        large = files.where(F.col("length") > max_bytes).first()
        if large:
            raise ValueError(f"{large.path} has {large.length} bytes; the limit is {max_bytes}")
    return files


# ---------------------------------------------------------------- S2
def detect_header(spark: SparkSession, path: str) -> bool:
    """The first line is a header iff one of its lower-cased fields is a
    known flow column name."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return False
    fields = [f.strip().strip('"').lower() for f in first[0][0].split(",")]
    return bool(set(fields) & set(HEADER_HINT_COLUMNS))


_FILE, _BLOCK = "__file", "__block"   # where a scanned row came from, dropped by with_row_index


def _read_text_csv(spark: SparkSession, path: str, header: bool) -> DataFrame:
    return (spark.read.option("header", header).option("mode", "PERMISSIVE")
            .option("inferSchema", False).csv(path)
            .select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK)))


# ---------------------------------------------------------------- S1, S3, S4, S6, S8
def trim_strings(df: DataFrame) -> DataFrame:
    """Strip leading and trailing whitespace (tabs and newlines too) from
    every string column."""
    return df.select(*[
        F.regexp_replace(F.col(f.name), r"^\s+|\s+$", "").alias(f.name)
        if isinstance(f.dataType, T.StringType) and f.name != _FILE else F.col(f.name)
        for f in df.schema.fields])


def scan_flow_csv(spark: SparkSession, path: str, header: bool | None = None) -> DataFrame:
    """S1-S4 + S6 (see :func:`_scan`)."""
    return _scan(spark, path, header).drop(_FILE, _BLOCK)


def _scan(spark: SparkSession, path: str, header: bool | None) -> DataFrame:
    """S1-S4 + S6: text columns named from the header, or by position for a
    headerless file (first ``min(ncols, 11)`` columns; ``tos`` = 0 added
    when absent).  Extra fields are dropped, short lines padded with null."""
    if header is None:
        header = detect_header(spark, path)
    df = _read_text_csv(spark, path, header)
    if not header:
        fields = [c for c in df.columns if c not in (_FILE, _BLOCK)]
        n = min(len(fields), len(FLOW_COLUMNS))
        df = df.select(*[F.col(c).alias(FLOW_COLUMNS[i]) if i < n else F.col(c)
                         for i, c in enumerate(fields)], _FILE, _BLOCK)
        if "tos" not in df.columns:
            df = df.withColumn("tos", F.lit(0))
    return trim_strings(df)


def scan_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A headered flow CSV with a ``label`` column."""
    return scan_flow_csv(spark, path, header=True)


# ---------------------------------------------------------------- S5
def validate_required_columns(df: DataFrame) -> DataFrame:
    """The 10 required names, case-sensitive."""
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(
            f"flow input lacks {', '.join(missing)}; without a header line the fields are taken by position as "
            + ", ".join(FLOW_COLUMNS))
    return df


# ---------------------------------------------------------------- row order
#: Above this many splits the table of their offsets is no longer broadcast.
BROADCAST_SPLITS = 100_000


def _tagged(df: DataFrame) -> DataFrame:
    """Rows with the split they came from and a number rising inside it; a
    frame that does not come from files counts by partition."""
    if _FILE not in df.columns:
        pid = F.shiftright(F.monotonically_increasing_id(), 33)
        df = df.withColumn(_FILE, F.lit("")).withColumn(_BLOCK, pid)
    return df.withColumn("__mid", F.monotonically_increasing_id())


def _stored_splits(tagged: DataFrame, probes: list[Column], written: list | None) -> tuple[DataFrame, dict, int]:
    """One read of the rows: how many each split has, written as a table of one
    row per split, the sums of the probes, and the number of splits."""
    spark = tagged.sparkSession
    path = scratch_path(spark, "csv-splits")
    counted = tagged.groupBy(_FILE, _BLOCK).agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"), *probes)
    counted.write.parquet(path)
    if written is not None:
        written.append(path)
    splits = spark.read.schema(counted.schema).parquet(path)
    names = [c for c in counted.columns if c not in (_FILE, _BLOCK, "__n", "__first")]
    sums = splits.agg(F.count(F.lit(1)).alias("__splits"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first().asDict()
    return splits.select(_FILE, _BLOCK, "__n", "__first"), sums, sums.pop("__splits")


def _indexed(tagged: DataFrame, splits: DataFrame, n_splits: int, name: str) -> DataFrame:
    before = Window.orderBy(_FILE, _BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(F.col(_FILE).alias("__f"), F.col(_BLOCK).alias("__b"), "__first",
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (tagged.join(F.broadcast(offsets) if n_splits <= BROADCAST_SPLITS else offsets,
                        (F.col(_FILE) == F.col("__f")) & (F.col(_BLOCK) == F.col("__b")))
            .withColumn(name, F.col("__off") + F.col("__mid") - F.col("__first"))
            .drop("__mid", "__first", "__off", "__f", "__b", _FILE, _BLOCK))


def with_row_index(df: DataFrame, name: str = "row_id", written: list | None = None) -> DataFrame:
    """Contiguous 0..n-1 in the order of file path, place in the file and line,
    without funnelling rows through one task.  A split's rows are read in
    order, so a row's index is the number of rows in earlier splits plus its
    place in its own.  The counts, one row per split, are summed up by a window
    over that small table, which is joined back."""
    tagged = _tagged(df)
    splits, _, n = _stored_splits(tagged, [], written)
    return _indexed(tagged, splits, n, name)


# ---------------------------------------------------------------- C1-C6
#: Plain decimal numbers: the cast alone would also take type suffixes ("5d").
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI]nf(inity)?|INF(INITY)?)$|^[nN]a[nN]$"
#: A whole ISO date, with or without a time: the cast alone would also take
#: years and times of day (as of today).
_ISO = (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
        r"([T ][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}([.][0-9]*)?)?)? ?(Z|UTC|[+-][0-9]{1,2}:?[0-9]{2})?$")


def _number(c: str) -> Column:
    return F.when(F.trim(F.col(c)).rlike(_NUMBER), F.expr(f"try_cast(`{c}` as double)"))


def _iso_time(c: str) -> Column:
    return F.when(F.trim(F.col(c)).rlike(_ISO), F.expr(f"try_cast(`{c}` as timestamp)"))


_FIELD = {"yyyy": r"[0-9]{4}", "MM": r"[0-9]{2}", "dd": r"[0-9]{2}", "HH": r"[0-9]{2}", "mm": r"[0-9]{2}", "ss": r"[0-9]{2}"}


def format_shape(fmt: str) -> str:
    """A pattern that every text in a time format matches: digits for fields,
    quoted and other signs as they are, bracketed parts left out or there."""
    parts = re.findall(r"'[^']*'|\[|\]|[A-Za-z]+|.", fmt)
    out = []
    for p in parts:
        if p in "[]":
            out.append("(?:" if p == "[" else ")?")
        elif p[0] == "'":
            out.append(re.escape(p[1:-1]))
        elif p.isalpha():
            out.append(_FIELD.get(p) or f"[0-9]{{{len(p)}}}")
        else:
            out.append(re.escape(p))
    return "^" + "".join(out) + "$"


def _text_columns(df: DataFrame) -> list[str]:
    return [c for c in TIME_COLUMNS + NUMERIC_COLUMNS if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]


def _probe_exprs(df: DataFrame) -> list[Column]:
    """Per text column how many values are no numbers; per time column also how
    many are no ISO times, and how many of these lack each format's shape
    (looked at only where a value is neither)."""
    exprs = []
    for c in _text_columns(df):
        col = F.col(c)
        no_number = col.isNotNull() & _number(c).isNull()
        exprs.append(F.count_if(no_number).alias(f"{c}__num"))
        if c in TIME_COLUMNS:
            exprs.append(F.count_if(col.isNotNull() & _iso_time(c).isNull()).alias(f"{c}__auto"))
            exprs += [F.count_if(no_number & _iso_time(c).isNull() & ~col.rlike(format_shape(fmt))).alias(f"{c}__shape{i}")
                      for i, fmt in enumerate(TIME_FORMATS)]
    return exprs


def _fitting_formats(df: DataFrame, probe: dict) -> dict[str, str]:
    """The first format that parses every value of each time column that needs
    one.  Only formats whose shape no value lacks are tried, in one read; none
    is made where there are none."""
    open_ = {c: [fmt for i, fmt in enumerate(TIME_FORMATS) if not probe[f"{c}__shape{i}"]] for c in TIME_COLUMNS
             if probe.get(f"{c}__num") and probe.get(f"{c}__auto")}
    tries = [F.count_if(F.col(c).isNotNull() & F.try_to_timestamp(F.col(c), F.lit(fmt)).isNull()).alias(f"{c}__{k}")
             for c, fmts in open_.items() for k, fmt in enumerate(fmts)]
    if not tries:
        return {}
    failed = df.agg(*tries).first()
    return {c: fmts[fits[0]] for c, fmts in open_.items() if (fits := [k for k in range(len(fmts)) if not failed[f"{c}__{k}"]])}


def type_flow_columns(df: DataFrame, on_bad: str = "null_value", probe: dict | None = None) -> DataFrame:
    """C1-C6 on the scanned text columns (or typed columns of a parquet source).

    Times: numeric text -> double (C1); else the first of automatic ISO
    parsing and the six formats that parses *every* value -> whole epoch
    seconds (C2); else the row index (C3).  Integer columns -> double (C4);
    timestamps/dates -> epoch seconds (C5).  Counters and ports: numeric text
    -> double; a column with a non-numeric value becomes all 0.0 with
    ``on_bad="zero_column"`` (the reference's behaviour) or null in that row
    only with ``on_bad="null_value"`` (C6).  ``probe``: the counts of
    :func:`_probe_exprs` over the same rows, if they are known."""
    if probe is None:
        exprs = _probe_exprs(df)
        probe = df.agg(*exprs).first().asDict() if exprs else {}
    formats = _fitting_formats(df, probe)
    out = []
    for f in df.schema.fields:
        c, dt = f.name, f.dataType
        col = F.col(c)
        if c in TIME_COLUMNS:
            if isinstance(dt, T.StringType):
                if probe[f"{c}__num"] == 0:
                    out.append(_number(c).alias(c))
                elif probe[f"{c}__auto"] == 0:
                    out.append(F.unix_seconds(_iso_time(c)).cast("double").alias(c))
                else:
                    fmt = formats.get(c)
                    if fmt is not None:
                        out.append(F.unix_seconds(F.try_to_timestamp(col, F.lit(fmt))).cast("double").alias(c))
                    else:
                        out.append(F.col("row_id").cast("double").alias(c))
            elif isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                out.append(F.unix_seconds(col.cast("timestamp")).cast("double").alias(c))
            else:
                out.append(col.cast("double").alias(c))
        elif c in NUMERIC_COLUMNS:
            if isinstance(dt, T.StringType):
                num = _number(c)
                if probe[f"{c}__num"] and on_bad == "zero_column":
                    out.append(F.lit(0.0).alias(c))
                else:
                    out.append(num.alias(c))
            else:
                out.append(col.cast("double").alias(c))
        else:
            out.append(col)
    return df.select(*out)


def read_flow_csv(spark: SparkSession, path: str, header: bool | None = None,
                  on_bad: str = "null_value", written: list | None = None) -> DataFrame:
    """S1-S6 + C1-C6: a typed flow table with a contiguous ``row_id``.
    ``written`` collects the scratch folder that the frame reads, for the
    caller to delete when done with it."""
    tagged = _tagged(validate_required_columns(_scan(spark, path, header)))
    splits, probe, n = _stored_splits(tagged, _probe_exprs(tagged), written)
    df = _indexed(tagged, splits, n, "row_id")
    return ensure_parallelism(type_flow_columns(df, on_bad, probe))
