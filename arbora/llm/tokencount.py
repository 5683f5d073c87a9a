"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text longer than `chunk` characters is encoded as overlapping chunks, with the character offset of every token. Two
neighbouring encodings are spliced at a place in the overlap where both have a token boundary and which is proven stable:
a space starts there after a character that isn't a space, and no piece of the vocabulary has a space after another
character, so no merge ever crosses it, whatever stands on either side. If an overlap has no such place, it is doubled
until it has one or the chunk reaches the text's end. Tokens left of the splice come from the earlier chunk, the rest from
the later. Chunks, and texts that are no longer, are encoded with a bounded memo of the parts between stable boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 32_768
OVERLAP = 256
LIMIT = 4096
#: Bytes of text parts that are remembered, and the longest part that is.
CACHE, LONGEST = 64 << 20, 64
SPACE = "▁"


class Counter(dict):
    """Tokens of one part of a text, by the library, remembered; a part is a stretch without spaces, preceded by one."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Characters of the text that a piece stands for; of a byte piece, one for each lead byte.
        self.width = np.array([int(p[3:5], 16) & 0xC0 != 0x80 if self.model.is_byte(i) else len(p) for i, p in enumerate(pieces)], np.int64)
        #: No piece runs from another character into a space, so boundaries before spaces are never merged over.
        self.stable = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.held = 0

    def __missing__(self, part: str) -> int:
        n = len(self.model.encode(part))
        if len(part) <= LONGEST:  # a longer one hardly comes again
            self.held += part.__sizeof__() + 120  # the entry, and its place in the table
            if self.held > CACHE:
                self.clear()
                self.held = part.__sizeof__() + 120
            self[part] = n
        return n

    def chunk(self, text: str) -> int:
        """Tokens of a text of moderate length, encoded as a whole."""
        if not self.stable or "  " in text or text[:1] == " " or text[-1:] == " " or SPACE in text:
            return len(self.model.encode(text))
        return sum(map(self.__getitem__, text.split(" "))) if text else 0

    def offsets(self, text: str) -> np.ndarray | None:
        """Offsets in text at which the tokens of an encoded chunk end; None if they can't be told from the tokens."""
        ends = np.cumsum(self.width[np.array(self.model.encode(text), np.int64)]) - 1  # the model puts a space in front
        return ends if len(ends) and ends[-1] == len(text) else None

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) <= chunk or not self.stable or SPACE in text:
            return self.chunk(text)
        return self.spliced(text, chunk, overlap)

    def spliced(self, text: str, chunk: int, overlap: int) -> int:
        n, total, base = len(text), 0, -1  # base: tokens that end up to here are counted
        begin, end = 0, min(chunk, n)
        ends = self.offsets(text[:end])
        while ends is not None and end < n:
            width, found = overlap, None
            while found is None and width < 2 * (end - base):
                found = self.resynchronise(text, begin + ends, max(base + 1, end - width), end, chunk)
                width *= 2  # alignment failed: widen the overlap
            if found is None:  # nowhere stable since the last splice: a longer chunk
                end = min(n, end + max(chunk, end - begin))
                ends = self.offsets(text[begin:end])
                continue
            splice, later, start = found
            total += int(((begin + ends > base) & (begin + ends <= splice)).sum())
            base, begin, end, ends = splice, start, min(n, start + chunk), later
        return len(self.model.encode(text)) if ends is None else total + int((begin + ends > base).sum())

    def resynchronise(self, text: str, earlier: np.ndarray, low: int, end: int, chunk: int) -> tuple[int, np.ndarray, int] | None:
        """(splice, offsets of the chunk after, its start) with the splice in [low, end), or None."""
        at = next((i for i in range(low, end) if _boundary(text, i)), None)
        if at is None:
            return None
        start = at + 1  # the model supplies the space before it
        later = self.offsets(text[start : start + chunk])
        if later is None:
            return None
        common = np.intersect1d(earlier[(earlier >= at) & (earlier < end)], np.append(start + later, at))
        for p in common[::-1].tolist():
            if _boundary(text, p):
                return p, later, start
        return None


def _boundary(text: str, at: int) -> bool:
    """A lone space starts at `at`, between two characters that aren't spaces."""
    return 0 < at < len(text) - 1 and text[at] == " " and text[at - 1] != " " and text[at + 1] != " "


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, model: str | None = None, *, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with n_tokens (long). model: path of a sentencepiece model, the same on every machine.

    Null and empty texts have no tokens. Repeated rows are each counted; an empty table gives no rows. A text of any length is
    counted whole: beyond `chunk` characters piece by piece, or, where it has no lone space, in one growing piece, at some hundred
    bytes of memory a character. What is remembered between texts is bounded in bytes. An own column n_tokens is replaced.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.drop("n_tokens")
    schema = T.StructType(docs.schema.fields + [T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                counts = [own.count(t, chunk, overlap) for t in pc.fill_null(b.column(text), "").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = token_counts(docs)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
