"""Shared scratch space: tables that cut a lineage and survive the loss of an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting (tests, a laptop) gets a temporary folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = java.get() if java.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read again: (table, path)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _held(spark).add(path)
    return spark.read.schema(df.schema).parquet(path), path


def _held(spark: SparkSession) -> set[str]:
    """Tables of ``written`` that are still there; the last of them go when the program ends."""
    sc = spark.sparkContext
    if not hasattr(sc, "_textloom_tables"):
        sc._textloom_tables = set()

        def at_end() -> None:
            with suppress(Exception):  # the JVM may be gone by then
                if sc._jsc:
                    released(spark)

        atexit.register(at_end)
    return sc._textloom_tables


def released(spark: SparkSession) -> int:
    """Remove all tables of ``written``; for when no result of this session will be read again. How many there were."""
    paths = sorted(_held(spark))
    dropped(spark, *paths)
    return len(paths)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        _held(spark).discard(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def width(spark: SparkSession) -> int:
    """Number of partitions of an explicit exchange; it follows the session's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session, once.

    Nothing is sent where the workers find it on their path already.
    """
    import io
    import os
    import zipfile

    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_textloom_shipped", False):
        return
    sc._textloom_shipped = True
    if os.path.dirname(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith((".py", ".json")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = f"{shared_dir(spark)}/textloom.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(target)
