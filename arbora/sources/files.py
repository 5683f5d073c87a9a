"""Reading declared tables, and what to do with results."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ddl import Table

TIMESTAMP = "yyyy-MM-dd HH:mm:ss[.SSS]"


def rebase(path: str, folder: str | None) -> str:
    """The file of the same name under another folder."""
    return path if folder is None else f"{folder.rstrip('/')}/{os.path.basename(path)}"


def scan(spark: SparkSession, table: Table, folder: str | None = None) -> DataFrame:
    """A declared table's rows: Parquet, or delimited text. Properties: path, format (from the name if missing), delimiter, header."""
    if not table.path:
        raise ValueError(f"table {table.name} has no path")
    path = rebase(table.path, folder)
    kind = table.properties.get("format") or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if kind == "parquet":
        df = spark.read.parquet(path)
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema))
    options = {"sep": table.properties.get("delimiter", ","), "header": table.properties.get("header", "false"), "timestampNTZFormat": TIMESTAMP}
    return spark.read.schema(table.schema).options(**options).csv(path)


def formatted(df: DataFrame) -> DataFrame:
    """Every column as text; timestamps to the millisecond, always with three digits of it."""

    def text(f: T.StructField):
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            return F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSS").alias(f.name)
        return F.col(f.name).cast("string").alias(f.name)

    return df.select(*(text(f) for f in df.schema))


def show(df: DataFrame, rows: int = 20) -> list[str]:
    """The first rows, comma-separated, printed and returned."""
    lines = [",".join("null" if v is None else v for v in r) for r in formatted(df).limit(rows).collect()]
    for line in lines:
        print(line)
    return lines


def timed_count(df: DataFrame) -> tuple[int, float]:
    """(rows, seconds) of a count."""
    began = time.perf_counter()
    return df.count(), time.perf_counter() - began


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def script(sql: str, ddl: str, strategy: str = "auto") -> str:
    """A stand-alone PySpark program that runs a query over declared tables."""
    return f'''"""Generated program: declares the tables, plans the query, prints the first rows."""

from pyspark.sql import SparkSession

from arbora.engine import Engine
from arbora.sources import files

DDL = {ddl!r}
SQL = {sql!r}

if __name__ == "__main__":
    engine = Engine(SparkSession.builder.getOrCreate())
    engine.declare(DDL)
    files.show(engine.sql(SQL, strategy={strategy!r}))
'''
