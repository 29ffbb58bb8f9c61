"""Session helpers: the few settings the library relies on, and the shared
scratch location used to cut lineage or stage files."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "flowsentry", extra: dict | None = None) -> SparkSession:
    """Session for tests and local runs.  On a cluster use the cluster's own
    session and call :func:`configure` on it instead."""
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Settings every entry point needs: UTC wall clock for time labels, AQE
    for runtime re-planning, and a checkpoint directory if the cluster has not
    named one (tests only; a cluster names a shared folder)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_PKG_ZIP = "flowsentry-pkg.zip"


def ship_package(spark: SparkSession) -> None:
    """Make the package importable by executor Python workers (the forest's
    grouped-map and scoring functions): a zip of
    ``flowsentry/`` added once per SparkContext with ``addPyFile``, as
    ``--py-files`` would.  The zip is only a source for Spark's own file
    distribution."""
    sc = spark.sparkContext
    if _PKG_ZIP in (getattr(sc, "_python_includes", None) or []):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="flowsentry-pyfiles-"), _PKG_ZIP)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Only when a local
    session names none (tests) is a fresh local folder set; on a cluster that
    is an error, as executors don't share the driver's disk."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="flowsentry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`scratch_path`, and no other."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    base = checkpoint_dir(spark).removeprefix("file:").rstrip("/")
    if os.path.dirname(path) != base:
        raise ValueError(f"{path} is not a scratch folder of this session")
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint directory."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")
