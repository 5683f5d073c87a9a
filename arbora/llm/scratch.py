"""Tables that cut lineage, kept in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one of our own only where none is set and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="arbora-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later jobs neither recompute it nor depend on executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/arbora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[tuple[SparkSession, str]]:
    """Every table that is still there."""
    return list(_written)


def release(tables: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete tables, all of them without an argument. Only for callers that have stored what they derived from them."""
    for spark, path in written() if tables is None else tables:
        if (spark, path) in _written:
            _written.remove((spark, path))
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        except Exception:  # the session may have ended; its folder goes with it
            continue


atexit.register(release)


def parts_for(total_bytes: int, each: int, least: int = 1) -> int:
    """Partitions that hold about `each` bytes."""
    return max(least, -(-int(total_bytes) // each))
