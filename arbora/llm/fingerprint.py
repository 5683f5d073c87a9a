"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes marks where a chunk may end; normalised chunking asks for six zero bits up to the normal
size and for four beyond it, between a least and a largest size. Since marks depend on nearby bytes alone, an edit or shift
changes the chunks around it and no others. The fingerprint is the set of chunk digests, each with its length: seven bytes
a chunk, in order, in hex. The containment of one in the other is the shared chunks' length over its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .scratch import parts_for

LEAST, NORMAL, MOST = 16, 32, 128
HARD, EASY = 26, 28  # shifts that leave six and four bits
BLOCK = 8 << 20
MOST_BLOCKS = 10_000
ROWS = 256
NULL_ID = -(1 << 63)

GEAR = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 32, 256, dtype=np.uint32)

PRINTED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Sum of GEAR[data[i - j]] << j for j < 16, by doubling. Its first 15 values lack some terms."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cuts(n: int, hard: list[int], easy: list[int]) -> list[int]:
    """Chunk ends of a text of n bytes; hard and easy: where its chunks may end, ascending."""
    out, s = [], 0
    while n - s > LEAST:
        k = bisect_left(hard, s + LEAST)
        e = hard[k] if k < len(hard) else n
        if e > s + NORMAL:
            k = bisect_left(easy, s + NORMAL)
            e = min(easy[k] if k < len(easy) else n, s + MOST)
        s = min(e, n)
        out.append(s)
    if s < n:
        out.append(n)
    return out


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct chunks, ascending: 44 bits of digest, 12 of length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for i, j in A.row_pieces(offsets):
        low = offsets[i]
        run = data[low : offsets[j]]
        h = gear_hashes(run)
        may = np.flatnonzero(h >> np.uint32(EASY) == 0) + 1
        strict = may[h[may - 1] >> np.uint32(HARD) == 0]
        ends, first = [], [0]
        for k in range(i, j):
            s, e = int(offsets[k] - low), int(offsets[k + 1] - low)
            m = may[np.searchsorted(may, s, "right") : np.searchsorted(may, e, "right")] - s
            t = strict[np.searchsorted(strict, s, "right") : np.searchsorted(strict, e, "right")] - s
            own = cuts(e - s, t.tolist(), m.tolist())
            ends += [s + c for c in own]
            first.append(len(ends))
        end = np.array(ends, np.int64)
        start = np.concatenate([[0], end[:-1]]) if len(end) else end
        value = np.zeros(0, np.uint64)
        if len(end):
            value = A.mix(A.span_hashes(A.prefix_hashes(run), start, end)) & ~A.U(0xFFF) | (end - start).astype(np.uint64)
            value &= A.U((1 << 56) - 1)
        out += [np.unique(value[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def text_of(chunks: np.ndarray) -> str:
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex() if len(chunks) else ""


def containment(own: np.ndarray, other: np.ndarray) -> float:
    """Length of own chunks that other has too, over the length of all; 1 if both are empty, 0 if one is."""
    if not len(own) or not len(other):
        return float(len(own) == len(other))
    weight = lambda x: int((x & A.U(0xFFF)).sum())
    return weight(np.intersect1d(own, other, assume_unique=True)) / weight(own)


def _compare(rows: list[tuple], last: tuple | None) -> pa.RecordBatch:
    """rows: consecutive documents (id, text); last: the one after them."""
    after = [*rows[1:], last]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for (_, t), (_, n) in zip(rows, after, strict=True)]
    codes = [t.encode() for t in edited]
    own = chunk_sets([t.encode() for _, t in [*rows, last]])
    new = chunk_sets(codes)
    columns = [
        [i for i, _ in rows],
        [len(t) for _, t in rows],
        [hashlib.sha256(c).hexdigest() for c in codes],
        [text_of(x) for x in own[:-1]],
        [text_of(x) for x in new],
        [containment(a, b) for a, b in zip(own[:-1], new, strict=True)],
        [containment(a, b) for a, b in zip(own[:-1], own[1:], strict=True)],
    ]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], PRINTED.names)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, text) by block and order; a block's last row is the next block's first document."""
    held: list[tuple] = []
    block, size = None, 0
    for b in batches:
        for blk, doc, text in zip(b.column("block").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if blk != block or len(held) > ROWS or size > A.PIECE:
                if blk == block:
                    yield _compare(held, (doc, text))
                elif len(held) > 1:
                    yield _compare(held[:-1], held[-1])
                held, size, block = [], 0, blk
            held.append((doc, text))
            size += len(text)
    if len(held) > 1:
        yield _compare(held[:-1], held[-1])


def fingerprints(docs: DataFrame, *, text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """PRINTED for each row of docs: its fingerprint, that of its text with the last quarter replaced by the next document's
    beginning, and how much of it the edited text and the next document contain.

    The order is that of doc_id; null comes first, rows with equal ids follow by a hash of the text. The last row's next is the
    first, a single row's next is itself. A null text is empty. An empty table gives no rows.
    """
    from pyspark.ml.feature import Bucketizer

    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("place", F.col("doc_id").cast("double"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = min(MOST_BLOCKS, parts_for(total, block_bytes))
    splits = own.agg(F.percentile_approx("place", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    splits = sorted(set(splits or []))
    if splits:
        own = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="place", outputCol="b").transform(own).withColumn("block", F.col("b").cast("long"))
    else:
        own = own.withColumn("block", F.lit(0).cast("long"))
    # the first document of each block also ends the block before it; one row a block
    firsts = own.groupBy("block").agg(F.min("doc_id").alias("doc_id")).collect()
    order = sorted((r.block, r.doc_id) for r in firsts)
    before = {first: order[k - 1][0] for k, (_, first) in enumerate(order)}
    spark = docs.sparkSession
    ends = spark.createDataFrame(list(before.items()) or [(0, 0)], "doc_id long, ends long")
    rows = own.join(F.broadcast(ends), "doc_id", "left")
    rows = rows.select("doc_id", "text", F.explode(F.expr("if(ends IS NULL, array(struct(block AS block, 0 AS tail)), array(struct(block AS block, 0 AS tail), struct(ends AS block, 1 AS tail)))")).alias("to"))
    rows = rows.select(F.col("to.block").alias("block"), F.col("to.tail").alias("tail"), "doc_id", "text", F.xxhash64("text").alias("h"))
    # of repeated first ids only the first row ends a block
    dealt = rows.repartition(n, "block").sortWithinPartitions("block", "tail", "doc_id", "h")
    found = dealt.select("block", "tail", "doc_id", "text").mapInArrow(_first_tails, PRINTED)
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def _first_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def once() -> Iterator[pa.RecordBatch]:
        done = None
        for b in batches:
            keep = []
            for block, tail in zip(b.column("block").to_pylist(), b.column("tail").to_pylist(), strict=True):
                keep.append(not tail or block != done)
                if tail:
                    done = block
            yield b.filter(pa.array(keep, pa.bool_()))

    return _walk(once())


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
