"""Sharding along a Hilbert curve, with DataFrame operations only.

Metadata dimensions are quantised to 16 levels each. Rows are sorted by the index of their cell on a Hilbert curve through all
dimensions, so that neighbours are alike in every one of them, and the order is cut into runs of equal length. A file's range in
each dimension is then narrow, and filters on any of them prune files. The order is Spark's own range sort over (curve,
text checksum, id), which splits a cell that holds a large part of the rows; ranks are a partition's offset plus the place in
it, so nothing is numbered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

BITS = 4
LEVELS = 1 << BITS
SHARDS = 24


def with_curve(df: DataFrame, axes: list[str]) -> DataFrame:
    """df with `curve`, the index on the Hilbert curve of the cell that the axes' levels make, worked out row by row.

    Skilling's transform: undo the excess work bit by bit, Gray-encode, then interleave the axes' bits. BITS times the number of
    axes can be 62 at most.
    """
    n, top = len(axes), LEVELS >> 1
    start = "array(" + ", ".join(f"int({a})" for a in axes) + ")"
    steps = "array(" + ", ".join(f"struct({q} AS q, {i} AS i)" for q in (top >> s for s in range(BITS - 1)) for i in range(n)) + ")"
    turned = f"""aggregate({steps}, {start}, (x, s) -> if((x[s.i] & s.q) <> 0,
        transform(x, (v, k) -> if(k = 0, v ^ (s.q - 1), v)),
        transform(x, (v, k) -> if(k = 0 OR k = s.i, v ^ if(s.i = 0, 0, (x[0] ^ x[s.i]) & (s.q - 1)), v))))"""
    gray = f"transform(sequence(0, {n - 1}), k -> aggregate(slice(h, 1, k + 1), 0, (a, v) -> a ^ v))"
    flip = " ^ ".join(f"if((h[{n - 1}] & {top >> s}) <> 0, {(top >> s) - 1}, 0)" for s in range(BITS - 1))
    index = " + ".join(f"bigint(shiftright(h[{k}], {b}) & 1) * {1 << (b * n + n - 1 - k)}" for b in range(BITS) for k in range(n))
    return df.withColumn("h", F.expr(turned)).withColumn("h", F.expr(gray)).withColumn("h", F.expr(f"transform(h, v -> v ^ ({flip}))")).withColumn("curve", F.expr(index)).drop("h")


def level(value: Column, low: Column, high: Column) -> Column:
    """value's level between low and high; 0 for null."""
    share = (value.cast("double") - low) / F.greatest(high.cast("double") - low, F.lit(1.0))
    return F.coalesce(F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.floor(share * LEVELS).cast("int"))), F.lit(0))


def name_level(value: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), F.lit(LEVELS)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, *, names: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions' levels, curve, shard and slot (from 0, without gaps) of each row.

    Dimensions: the id's place between the least and greatest id, the size's magnitude, and the named columns that exist.
    The shards' row counts differ by one at most. A null text has size 8 and the checksum of no bytes; null metadata is a
    level like any other. Repeated rows are rows, and a text of any length is one. Columns of docs that have the results' names are
    not read, but for the named ones. An empty table gives no rows.
    """
    names = [c for c in names if c in docs.columns]
    bounds = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (F.lit(0 if b is None else b).cast("double") for b in bounds)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    text_crc32 = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    levels = {"id_level": level(F.col("doc_id"), low, high), "size_level": level(F.log2(size.cast("double")), F.lit(3.0), F.lit(27.0))}
    levels |= {f"{c}_level": name_level(F.col(c)) for c in names}
    rows = docs.select("doc_id", size.alias("size"), text_crc32.alias("text_crc32"), *(v.alias(k) for k, v in levels.items()))
    keyed = with_curve(rows, list(levels))
    key = ["curve", "text_crc32", "doc_id", "size"]
    ordered = keyed.repartitionByRange(*key).sortWithinPartitions(*key)
    place = F.monotonically_increasing_id()
    ordered = materialise(ordered.withColumn("part", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND((1 << 33) - 1)))
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # one row a partition
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    ranked = ordered.join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("place"))
    ranked = ranked.withColumn("shard", F.expr(f"CAST(rank * {shards} DIV {max(1, total)} AS INT)"))
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    return ranked.withColumn("slot", F.col("rank") - first).drop("part", "place", "offset", "rank")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, *, file_rows: int = 1_000_000, **options) -> None:
    """docs as Parquet, a folder for each shard and in it a file for each run of `file_rows` along the curve; docs need a unique
    doc_id. Files are narrow in every dimension, however many rows a shard has."""
    placed = hilbert_shards(docs, shards, **options).select(F.col("doc_id").alias("placed_id"), F.col("shard").alias("placed_shard"), F.col("slot").alias("placed_slot"))
    rows = docs.drop("shard").join(placed, F.col("doc_id").eqNullSafe(F.col("placed_id"))).drop("placed_id").withColumnRenamed("placed_shard", "shard")
    rows = rows.withColumn("placed_run", F.expr(f"placed_slot DIV {file_rows}")).repartition("shard", "placed_run").sortWithinPartitions("shard", "placed_slot")
    rows.drop("placed_slot", "placed_run").write.partitionBy("shard").option("maxRecordsPerFile", file_rows).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    found = hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
