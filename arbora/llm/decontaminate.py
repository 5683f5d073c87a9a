"""Benchmark decontamination on a positional inverted index.

The training side is a document-partitioned index: every shard stores the positions of each benchmark term in its own
documents. A benchmark window (13 words, or a shorter item's whole text) is answered from its rarest term in that shard:
that term's positions, less the term's offset, are the candidate starts, and the other terms' offset-adjusted lists
are intersected with them, rarest first. What is left is compared word by word with the text. No document text is
shuffled. The benchmark is sent out in blocks of at most `block_bytes`, one pass a block, so that what is broadcast is
bounded however large the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .scratch import materialise, parts_for

WINDOW = 13
SHARD = 4 << 20
FOUND = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
)


class Windows:
    """The distinct windows of a block of items, by length, with the items that hold them; all in arrays, some 80 bytes a word."""

    def __init__(self, items: list[str | None], texts: pa.Array, window: int = WINDOW):
        data, offsets = A.text_bytes(texts)
        w = A.Words(data, offsets, A.ALNUM)
        self.items = items
        self.vocabulary, first, term = np.unique(w.hash, return_index=True, return_inverse=True)
        self.lowered, self.start, self.end = A.ALNUM[data], w.start[first], w.end[first]
        term = term.astype(np.int32)
        size = np.minimum(w.count, window)
        #: length -> (distinct windows' terms, and per window a stretch of owners)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == n)
            each = w.count[rows] - n + 1
            owner = np.repeat(rows, each).astype(np.int32)
            start = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(w.first[rows], each)
            terms = term[start[:, None] + np.arange(n)]
            order = np.lexsort((owner, *terms.T[::-1]))
            terms, owner = terms[order], owner[order]
            new = np.append(True, (terms[1:] != terms[:-1]).any(axis=1))
            self.by_length[n] = terms[new], np.append(np.flatnonzero(new), len(owner)), owner
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.vocabulary >> A.U(44)] = True

    def word(self, term: int) -> bytes:
        return self.lowered[self.start[term] : self.end[term]].tobytes()


class Shard:
    """Positional postings of the vocabulary's terms in a run of documents."""

    def __init__(self, words: A.Words, windows: Windows):
        self.words, self.n = words, len(words.hash)
        maybe = np.flatnonzero(windows.sieve[words.hash >> A.U(44)])
        h = words.hash[maybe]
        at = np.minimum(np.searchsorted(windows.vocabulary, h), max(0, len(windows.vocabulary) - 1))
        ok = windows.vocabulary[at] == h if len(windows.vocabulary) else np.zeros(len(h), bool)
        term, position = at[ok], maybe[ok]
        self.count = np.bincount(term, minlength=len(windows.vocabulary))
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        order = np.argsort(term, kind="stable")
        self.position = position[order]
        self.key = term[order] * (self.n + 1) + self.position

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the term's list has the position."""
        key = np.multiply(term, self.n + 1, dtype=np.int64) + position  # windows' terms are 32-bit
        at = np.searchsorted(self.key, key)
        return self.key[np.minimum(at, len(self.key) - 1)] == key

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start word) of every occurrence of the windows (rows of terms) within one document."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.key):
            return none
        live = np.flatnonzero((self.count[terms] > 0).all(axis=1))
        if not len(live):
            return none
        t = terms[live]
        by_rarity = np.argsort(self.count[t], axis=1, kind="stable")
        lead = np.take_along_axis(t, by_rarity[:, :1], 1)[:, 0]
        size = self.count[lead]
        which = np.repeat(np.arange(len(live)), size)
        within = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        start = self.position[self.first[lead[which]] + within] - by_rarity[which, 0]
        n = terms.shape[1]
        ok = (start >= 0) & (start + n <= self.n)
        which, start = which[ok], start[ok]
        ok = self.words.row[start] == self.words.row[start + n - 1]
        which, start = which[ok], start[ok]
        for k in range(1, n):
            if not len(start):
                return none
            o = by_rarity[which, k]
            ok = self.has(t[which, o], start + o)
            which, start = which[ok], start[ok]
        return live[which], start

    def near(self, terms: list[int], slop: int) -> np.ndarray:
        """Rows in which all the terms stand within `slop` consecutive words, in any order (proximity match)."""
        terms = sorted(set(terms), key=lambda t: self.count[t])
        if not terms or any(self.count[t] == 0 for t in terms):
            return np.zeros(0, np.int64)
        lists = [self.position[self.first[t] : self.first[t + 1]] for t in terms]
        rows: list[int] = []
        ends = np.concatenate(lists)
        ends.sort()
        ok = np.ones(len(ends), bool)  # does a stretch of slop words that ends here hold every term?
        for x in lists:
            at = np.searchsorted(x, ends, "right") - 1
            p = x[np.maximum(at, 0)]
            ok &= (at >= 0) & (ends - p < slop) & (self.words.row[p] == self.words.row[ends])
        rows.extend(self.words.row[ends[ok]].tolist())
        return np.unique(np.array(rows, np.int64))


def _annotate(texts: pa.Array, windows: Windows) -> tuple[np.ndarray, list, list]:
    """Word count, sorted hit word numbers and items of every row."""
    data, offsets = A.text_bytes(texts)
    rows = len(texts)
    counts, hits, items = np.zeros(rows, np.int64), [[] for _ in range(rows)], [[] for _ in range(rows)]
    for i, j in A.row_pieces(offsets, SHARD):
        run = data[offsets[i] : offsets[j]]
        w = A.Words(run, offsets[i : j + 1], A.ALNUM)
        counts[i:j] = w.count
        shard = Shard(w, windows)
        marks, held = np.zeros(shard.n + 1, np.int64), set()
        for n, (terms, cut, owner) in windows.by_length.items():
            for k, s in zip(*(x.tolist() for x in shard.phrases(terms)), strict=True):
                text = [A.ALNUM[run[a:b]].tobytes() for a, b in zip(w.start[s : s + n].tolist(), w.end[s : s + n].tolist(), strict=True)]
                if text == [windows.word(t) for t in terms[k].tolist()]:  # hashes only propose
                    marks[s] += 1
                    marks[s + n] -= 1
                    held.update((int(w.row[s]), o) for o in owner[cut[k] : cut[k + 1]].tolist())
        hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        for r in np.unique(w.row[hit]).tolist():
            a, b = np.searchsorted(hit, [w.first[r], w.first[r + 1]])
            hits[i + r] = (hit[a:b] - w.first[r]).tolist()
        for r, o in held:
            if windows.items[o] is not None:
                items[i + r].append(windows.items[o])
    return counts, hits, items


def _pass(df: DataFrame, windows, text: str) -> DataFrame:
    """One block's pass: keeps every column and merges what it finds into those of FOUND."""
    kept = [f for f in df.schema.fields if f.name not in FOUND.names]
    before = len(kept) < len(df.schema.fields)
    schema = T.StructType(kept + FOUND.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = windows.value
        for b in batches:
            counts, hits, items = _annotate(b.column(text), own)
            if before:
                for k, (h, x) in enumerate(zip(b.column("hit_words").to_pylist(), b.column("items").to_pylist(), strict=True)):
                    hits[k], items[k] = sorted({*h, *hits[k]}), [*x, *items[k]]
            items = [sorted(set(x)) for x in items]
            new = [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + new, [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def blocks(benchmark: DataFrame, block_bytes: int, window: int) -> Iterator[Windows]:
    """The benchmark's windows in blocks of about block_bytes of text each."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t IS NOT NULL")
    n = parts_for(rows.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0], block_bytes)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        table = part.toArrow()
        yield Windows(table["i"].to_pylist(), table["t"], window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, block_bytes: int = 8 << 20) -> DataFrame:
    """docs with n_words, hit_words (numbers of the words inside any benchmark window, ascending) and items (their ids, as
    sorted strings).

    Null and empty texts have no words. A null benchmark text has no windows; an item without an id hits like any other, but
    `items` leaves it out. An empty benchmark hits nothing; an empty docs gives no rows. Repeated rows are each judged alone.
    A text of any length is one document: its words are indexed together, about 60 bytes of memory each. docs' own
    columns of these three names are replaced.
    """
    spark = docs.sparkSession
    out = docs.drop(*FOUND.names)
    for k, w in enumerate(blocks(benchmark, block_bytes, window)):
        out = _pass(materialise(out) if k else out, spark.sparkContext.broadcast(w), text)
    return out


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A twentieth of the words hit, at least one."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs in which no benchmark window occurs; columns as they were, whatever their names.

    Any hit counts, however long the document is: its text would take the passage along. Null and empty texts stay, as do all
    with an empty benchmark. An empty table gives none. Repeated rows go or stay together.
    """
    found = decontaminate(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), benchmark, **options)
    return found.where(F.size("hit_words") == 0).select("row.*")


def proximity(docs: DataFrame, phrase: str, slop: int) -> DataFrame:
    """docs in which all the phrase's words stand within slop consecutive words, in any order."""
    windows = docs.sparkSession.sparkContext.broadcast(Windows([""], pa.array([phrase]), 1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = windows.value
        for b in batches:
            data, offsets = A.text_bytes(b.column("text"))
            keep = np.zeros(b.num_rows, bool)
            for i, j in A.row_pieces(offsets, SHARD):
                w = A.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1], A.ALNUM)
                keep[i + Shard(w, own).near(list(range(len(own.vocabulary))), slop)] = True
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    ).withColumn("contaminated", contaminated())
