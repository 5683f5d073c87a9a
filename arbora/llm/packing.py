"""Packing token streams into windows by minimum bin slack.

Every task tokenises and packs the documents of its own input partition, group by group of about `group_tokens` tokens,
so nothing is shuffled and memory is bounded. A document's whole windows become full sequences at once; what remains of
it is one piece. For each further sequence a subset-sum bitset (a Python integer, bit s set if the lengths picked so far
can sum to s) runs over the multiset of remaining lengths, largest first, until the capacity's bit is set; backtracking
through the saved bitsets gives how many pieces of each length to take. Pieces that are left at a task's end are cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import string
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CAPACITY = 4096
END = 2
GROUP_TOKENS = 2 << 20
#: Bytes of text parts and their ids that are remembered, and the longest part that is.
CACHE, LONGEST = 96 << 20, 64
PUNCTUATION = string.punctuation
PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


class Ids(dict):
    """Token ids, as little-endian 32-bit bytes, of the parts of a text between plain spaces and line feeds.

    The tokenizer drops white space before it merges anything and treats each part alone, so a text's ids are its parts'
    ids in order. Parts repeat; each is encoded once while it stays in this bounded cache. Words of Latin-1 letters go to the
    tokenizer's merge model directly (normalisation is then only lower-casing, and they are one pre-token). ASCII
    punctuation behind such a word is the next pre-token, so it's looked up by itself; all else takes the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(chr(c)): level.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256)}
        size = max(self.whole.get_vocab(with_added_tokens=True).values()) + 1
        self.one = [i.to_bytes(4, "little") for i in range(size)]
        self.held = 0
        self[""] = b""

    def __missing__(self, part: str) -> bytes:
        body = part.rstrip(PUNCTUATION)
        if body.isalpha() and _latin(body):
            word = body.lower()
            if word != part:
                ids = self[word] if len(body) == len(part) else self[word] + self[part[len(body) :]]
            else:
                mapped = word if word.isascii() else word.translate(self.letters)
                one = self.one
                ids = b"".join([one[t.id] for t in self.model.tokenize(mapped)])
        else:
            ids = np.array(self.whole.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        if len(part) <= LONGEST:  # a longer one hardly comes again
            self.held += _entry(part, ids)
            if self.held > CACHE:
                self.clear()
                self[""] = b""
                self.held = _entry(part, ids)
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _entry(part: str, ids: bytes) -> int:
    """Bytes that a remembered part takes, with its place in the table."""
    return part.__sizeof__() + ids.__sizeof__() + 100


def _latin(word: str) -> bool:
    if word.isascii():
        return True
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One cache for each Python worker, which serves many tasks."""
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


class Remaining:
    """Pieces by length: a multiset whose distinct lengths stay sorted."""

    def __init__(self):
        self.by: dict[int, list] = {}
        self.lengths: list[int] = []
        self.total = 0

    def add(self, length: int, piece) -> None:
        if length not in self.by:
            self.by[length] = []
            insort(self.lengths, length)
        self.by[length].append(piece)
        self.total += length

    def take(self, length: int):
        own = self.by[length]
        piece = own.pop()
        if not own:
            del self.by[length]
            self.lengths.pop(bisect_right(self.lengths, length) - 1)
        self.total -= length
        return piece

    def fullest(self, capacity: int) -> list[int]:
        """Lengths of a sub-multiset with the largest sum up to capacity; it has the largest length in it."""
        first = self.lengths[-1]
        room, mask = capacity - first, (1 << (capacity - first + 1)) - 1
        sums, steps = 1, []  # steps: (length, pieces of it, bitset before)
        goal = 1 << room
        for k in range(bisect_right(self.lengths, room) - 1, -1, -1):
            if sums & goal:
                break
            n = self.lengths[k]
            left, share = min(len(self.by[n]) - (n == first), room // n), 1
            while left > 0 and not sums & goal:  # counts by doubling shares
                share = min(share, left)
                steps.append((n, share, sums))
                sums |= (sums << (n * share)) & mask
                left -= share
                share *= 2
        at, picked = sums.bit_length() - 1, [first]
        for n, share, before in reversed(steps):
            if not before >> at & 1:
                picked += [n] * share
                at -= n * share
        return picked


class Packer:
    """Collects documents' ids and emits rows of PIECES."""

    def __init__(self, part: int, capacity: int):
        self.capacity, self.sequence = capacity, part << 40
        self.left, self.held, self.rows = Remaining(), 0, []

    def emit(self, pieces: list[tuple]) -> None:
        """pieces: (doc_id, start, ids, doc_tokens) of one sequence."""
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.sequence, at))
            at += n
        self.sequence += 1

    def add(self, doc, ids: bytes) -> None:
        n, c = len(ids) // 4, self.capacity
        whole = n // c * c
        for s in range(0, whole, c):
            self.emit([(doc, s, ids[4 * s : 4 * (s + c)], n)])
        if n > whole:
            self.left.add(n - whole, (doc, whole, ids[4 * whole :], n))

    def pack(self, down_to: int) -> None:
        while self.left.total > max(down_to, self.capacity):
            self.emit([self.left.take(n) for n in self.left.fullest(self.capacity)])

    def finish(self) -> None:
        self.pack(0)
        rest = [self.left.take(self.left.lengths[-1]) for _ in range(sum(map(len, self.left.by.values())))]
        total = sum(len(p[2]) // 4 for p in rest)
        rest.reverse()
        while total:
            size = min(self.capacity, 1 << (total.bit_length() - 1))
            total -= size
            pieces = []
            while size:
                doc, start, ids, n = rest.pop()
                cut = min(size, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * cut], n))
                if 4 * cut < len(ids):
                    rest.append((doc, start + cut, ids[4 * cut :], n))
                size -= cut
            self.emit(pieces)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(PIECES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], PIECES.names)


def pack(docs: DataFrame, tokenizer: str | None = None, *, text: str = "text", capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row of PIECES for each piece of each document. tokenizer: path of a tokenizer file, the same on every machine.

    A null or empty text is the end id alone. A null doc_id is kept as null. Repeated rows are packed each. An empty
    table gives no rows. A text of any length is tokenised whole, its ids (four bytes each) held while it is cut up; a part
    without white space takes some hundred bytes of memory a character. Other columns, whatever their names, are not read.
    Sequence ids are unique and ascend within a partition; they have gaps between partitions.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, context = ids_of(tokenizer), TaskContext.get()
        packer = Packer(context.partitionId() if context else 0, capacity)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                for doc, t in zip(b.column(0).to_pylist(), pc.fill_null(b.column(1), "").to_pylist(), strict=True):
                    packer.add(doc, ids.encode(t) + end)
                if packer.left.total > 2 * group_tokens:
                    packer.pack(group_tokens)
                if len(packer.rows) > 20_000:
                    yield _batch(packer.rows)
                    packer.rows = []
        packer.finish()
        yield _batch(packer.rows)

    return docs.select("doc_id", text).mapInArrow(run, PIECES)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
