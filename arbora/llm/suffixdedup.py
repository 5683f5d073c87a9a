"""Removal of byte strings that an earlier document already has, on a sparse, hash-compared suffix array.

A byte is removed if a string of SPAN bytes that covers it also starts in a document with a smaller id. The suffixes that
have to be sorted are few: every SPAN-byte window has an anchor, the K-byte string of least hash in it, chosen by the
window's content alone, so equal windows have equal anchors at equal offsets. Anchors whose string stands in one document
only are dropped first, by exchanging hashes. Of the rest, each distinct context (the anchor and up to SPAN - K bytes on
either side) is sent once a block, with the smallest document that has it there. Contexts with one anchor string meet in one
bucket. There their suffixes, and their reversed prefixes, are sorted by mergesort: prefix polynomial hashes and a binary search
give the common extension of two, so a comparison takes a logarithm of their length, and neighbours' extensions are verified
on the bytes. Two contexts share a window exactly if they fall into one run of both orders at that window's thresholds; the
smallest document of a run decides. The blocks get back, for each context, which windows are covered.

Texts are dealt to blocks by document once; that one exchange serves all three passes. An anchor string in more than
`hot_blocks` blocks is not gathered: its windows are sent in four ranges of offsets, each under the hash of the 43 or 44 bytes
that all windows of the range have in common. In more than `VERY_HOT` times as many blocks, they are sent one by one under their
own hashes, at most one a block.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .scratch import parts_for

SPAN, K = 50, 20
SIDE = SPAN - K
WIDTH = K + 2 * SIDE
BLOCK = 4 << 20
HOT_BLOCKS = 512
VERY_HOT = 64
#: Offsets of the windows that a hot context sends together, and those that a very hot one does.
RANGES = [(0, 7), (8, 15), (16, 23), (24, SIDE)]
SINGLE = [(a, a) for a in range(SIDE + 1)]
NONE = 255
NULL_ID = -(1 << 63)

KEYS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("block", T.LongType()), T.StructField("body", T.BinaryType())])


def _sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    p = 1
    while 2 * p <= width:
        x = f(x[:-p], x[p:])
        p *= 2
    return f(x[: -(width - p)], x[width - p :]) if width > p else x


def _segment_anchors(data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all windows that lie within one row; rows are [starts, ends)."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = A.prefix_hashes(data)
    h = A.mix((p[K:] - p[:-K]) * A.powers(n + 1)[1][: n - K + 1]) | A.U(1)
    least = _sliding(np.minimum, h, SIDE + 1)
    across = np.zeros(n + 1, np.int32)
    np.add.at(across, np.maximum(ends - SPAN + 1, starts), 1)
    np.add.at(across, ends, -1)
    least[np.cumsum(across)[: len(least)] > 0] = 0
    pad = np.zeros(SIDE, np.uint64)
    most = _sliding(np.maximum, np.concatenate([pad, least, pad]), SIDE + 1)
    at = np.flatnonzero(h == most)
    return at, h[at]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the rows' anchors, ascending; a row of any length is worked through in segments."""
    found = []
    for i, j in A.row_pieces(offsets):
        low, high = int(offsets[i]), int(offsets[j])
        if j == i + 1:
            for s in range(low, high, A.PIECE):
                e = min(high, s + A.PIECE + SPAN - 1)
                at, h = _segment_anchors(data[s:e], np.array([e - s]), np.array([0]))
                found.append((at + s, h))
        else:
            at, h = _segment_anchors(data[low:high], offsets[i + 1 : j + 1] - low, offsets[i:j] - low)
            found.append((at + low, h))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.concatenate([[True], at[1:] != at[:-1]])  # segments overlap
    return at[new], h[new]


_WORDS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, WIDTH // 8 + 1, dtype=np.uint64)


def context_hashes(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    words = rows.view(np.uint64)
    h = A.mix(left.astype(np.uint64) * A.U(64) + right.astype(np.uint64) + _WORDS[-1])
    for k in range(words.shape[1]):
        h += A.mix(words[:, k] + _WORDS[k])
    return A.mix(h)


def contexts(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, left, right): the WIDTH bytes around each anchor, zero outside its row, and how many each side has."""
    left = np.minimum(SIDE, at - low).astype(np.uint8)
    right = np.minimum(SIDE, high - at - K).astype(np.uint8)
    column, last = np.arange(WIDTH, dtype=np.int64), max(0, len(data) - 1)
    rows = np.empty((len(at), WIDTH), np.uint8)
    for s in range(0, len(at), 16_384):  # the index matrix is eight times the rows
        e = s + 16_384
        part = data[np.clip(at[s:e, None] + (column - SIDE), 0, last)]
        outside = (column < SIDE - left[s:e, None].astype(np.int64)) | (column >= SIDE + K + right[s:e, None].astype(np.int64))
        part[outside] = 0
        rows[s:e] = part
    return rows, left, right


# ---------------------------------------------------------------- suffix order


class Order:
    """Strings sorted within their groups by mergesort, compared through prefix hashes, and neighbours' common lengths.

    strings: (n, L) bytes, zero beyond lengths; group: ascending group numbers.
    """

    def __init__(self, group: np.ndarray, strings: np.ndarray, lengths: np.ndarray):
        self.strings, self.lengths = strings, lengths.astype(np.int64)
        n, width = strings.shape
        self.prefix = np.zeros((n, width + 1), np.uint64)
        np.cumsum(A.BYTE[strings] * A.powers(width + 1)[0][:width], axis=1, out=self.prefix[:, 1:])
        new = np.concatenate([[True], group[1:] != group[:-1]])
        start = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        self.first = start[which]
        self.size = np.diff(np.append(start, n))[which]
        self.new = new
        self.order = self._sort(n)
        self.common = self._neighbours()

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix length of strings i and j, by binary search over prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.lengths[i], self.lengths[j])
        for _ in range(int(self.strings.shape[1]).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.prefix[i, mid] == self.prefix[j, mid]
            low = np.where(same, mid, low)
            high = np.where(same, high, np.maximum(low, mid - 1))
        return low

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether string i sorts before j, or with it where or_equal."""
        k = self.extension(i, j)
        over_i, over_j = k >= self.lengths[i], k >= self.lengths[j]
        last = self.strings.shape[1] - 1
        a, b = self.strings[i, np.minimum(k, last)], self.strings[j, np.minimum(k, last)]
        return np.where(over_i & over_j, or_equal, np.where(over_i, True, np.where(over_j, False, a < b)))

    def _sort(self, n: int) -> np.ndarray:
        order, width = np.arange(n), 1
        slot = np.flatnonzero(self.size > 1)
        while len(slot):
            first, size = self.first[slot], self.size[slot]
            rel = slot - first
            run = rel // width
            other = (run ^ 1) * width
            has = other < size
            low, high = np.where(has, other, 0), np.where(has, np.minimum(other + width, size), 0)
            own, right = order[slot], (run & 1).astype(bool)
            ahead = low.copy()
            todo = np.flatnonzero(low < high)
            while len(todo):  # rank in the other run
                mid = (ahead[todo] + high[todo]) >> 1
                go = self.before(order[first[todo] + mid], own[todo], right[todo])
                ahead[todo] = np.where(go, mid + 1, ahead[todo])
                high[todo] = np.where(go, high[todo], mid)
                todo = todo[ahead[todo] < high[todo]]
            to = np.where(has, (run & ~1) * width + (rel - run * width) + (ahead - low), rel)
            order[first + to] = own
            width *= 2
            slot = slot[size > width]
        return order

    def _neighbours(self) -> np.ndarray:
        """Common length with the string before, 0 at a group's first; verified on the bytes."""
        n = len(self.order)
        common = np.zeros(n, np.int64)
        at = np.flatnonzero(~self.new)
        i, j = self.order[at - 1], self.order[at]
        common[at] = self.extension(i, j)
        cap = np.minimum(self.lengths[i], self.lengths[j])
        differ = self.strings[i] != self.strings[j]
        true = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1]), cap)
        if (true != common[at]).any():  # two strings collided: sort by the bytes themselves
            group = np.repeat(np.cumsum(self.new)[self.new], np.diff(np.append(np.flatnonzero(self.new), n)))
            self.order = np.lexsort((self.lengths, *self.strings.T[::-1], group))
            i, j = self.order[at - 1], self.order[at]
            differ = self.strings[i] != self.strings[j]
            common[at] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1]), np.minimum(self.lengths[i], self.lengths[j]))
        return common

    def runs(self, least: int) -> np.ndarray:
        """For each string the number of its run: neighbours that share at least so many bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.new | (self.common < least))
        return out


def covered(group: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) offset of the windows, before the anchor, that a smaller document has as well; NONE if there's none.

    Distinct contexts, ascending by group (anchor string); a window at offset a starts a bytes before the anchor.
    """
    forward = Order(group, np.ascontiguousarray(rows[:, SIDE:]), right.astype(np.int64) + K)
    backward = Order(group, np.ascontiguousarray(rows[:, SIDE - 1 :: -1]), left)
    least, most = np.full(len(doc), NONE, np.uint8), np.full(len(doc), NONE, np.uint8)
    for a in range(SIDE + 1):
        ok = np.flatnonzero((left >= a) & (right >= SIDE - a))
        if not len(ok):
            continue
        key = forward.runs(SPAN - a)[ok] * (len(doc) + 1) + backward.runs(a)[ok]
        by = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[by][1:] != key[by][:-1]])
        smallest = np.minimum.reduceat(doc[ok][by], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = ok[by][smallest < doc[ok][by]]
        most[hit] = a
        least[hit] = np.where(least[hit] == NONE, a, least[hit])
    return least, most


# ---------------------------------------------------------------- blocks


class Block:
    """A block's anchors, and, once it's known which are shared, its distinct contexts."""

    def __init__(self, table: pa.Table, buckets: int):
        self.doc = pc.fill_null(table["doc_id"].combine_chunks(), NULL_ID).to_numpy(zero_copy_only=False)
        self.data, self.offsets = A.text_bytes(table["text"])
        self.at, self.hash = anchors(self.data, self.offsets)
        self.row = np.searchsorted(self.offsets, self.at, "right") - 1
        by = np.lexsort((self.doc[self.row], self.hash))
        h, d = self.hash[by], self.doc[self.row][by]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        distinct = h[new]
        first = np.flatnonzero(new)
        many = d[first] != d[np.append(first[1:], len(h)) - 1] if len(h) else np.zeros(0, bool)
        number = np.empty(len(h), np.int64)
        number[by] = np.cumsum(new) - 1
        bucket = _bucket(distinct, buckets)
        order = np.argsort(bucket, kind="stable")  # by bucket, then hash
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.distinct, self.bucket, self.many, self.number = distinct[order], bucket[order], many[order], place[number]
        self.buckets = buckets

    def keys(self, block: int) -> pa.Table:
        """48 bits of the distinct hashes, by bucket."""
        body = np.ascontiguousarray((self.distinct >> A.U(16))[:, None].view(np.uint8).reshape(-1, 8)[:, :6])
        some, start = np.unique(self.bucket, return_index=True)
        return _table(KEYS, [some, np.full(len(some), block), _bodies(body, np.append(start, len(body)))])

    def entries(self, replies: dict[int, bytes]) -> None:
        """Distinct contexts of shared anchors; replies: by bucket, a byte for each of its keys (0, shared, hot, very hot)."""
        marks = [np.frombuffer(replies.get(b, b""), np.uint8) for b in np.unique(self.bucket).tolist()]
        marks = np.concatenate([np.zeros(0, np.uint8), *marks])
        if len(marks) != len(self.distinct):
            raise RuntimeError("a block's replies don't match its anchors")
        shared = (marks > 0) | self.many
        self.use = np.flatnonzero(shared[self.number])
        at, row = self.at[self.use], self.row[self.use]
        rows, left, right = contexts(self.data, at, self.offsets[row], self.offsets[row + 1])
        h, g, d = context_hashes(rows, left, right), self.hash[self.use], self.doc[row]
        self.which, first, least = _distinct(g, h, rows, d)  # context number of each anchor
        self.g, self.rows, self.left, self.right, self.least = g[first], rows[first], left[first], right[first], least
        heat = marks[self.number[self.use][first]]
        self._pieces(heat)
        keep = np.flatnonzero(heat < 2)
        self.sent_context = keep
        g = np.concatenate([self.g[keep], self.wg])
        self.sent = (
            np.concatenate([self.rows[keep], self.wrows]),
            np.concatenate([self.left[keep], self.wleft]),
            np.concatenate([self.right[keep], self.wright]),
            np.concatenate([self.least[keep], self.wleast]),
            g,
        )
        self.sent_bucket = _bucket(g, self.buckets)
        self.sent_order = np.argsort(self.sent_bucket, kind="stable")

    def _pieces(self, heat: np.ndarray) -> None:
        """The hot contexts' windows, by range of offsets: contexts of their own, cut to what the range's windows cover."""
        context, left, right, body, core = [], [], [], [], []
        column = np.arange(WIDTH)
        for ranges, hot in ((RANGES, np.flatnonzero(heat == 2)), (SINGLE, np.flatnonzero(heat == 3))):
            for low, high in ranges if len(hot) else ():
                ok = hot[(self.left[hot] >= low) & (self.right[hot] >= SIDE - high)]
                x, y = np.minimum(self.left[ok], high), np.minimum(self.right[ok], SIDE - low)
                rows = self.rows[ok]
                rows[(column < SIDE - x[:, None].astype(np.int64)) | (column >= SIDE + K + y[:, None].astype(np.int64))] = 0
                common = np.zeros_like(rows)
                common[:, SIDE - low : SIDE + K + SIDE - high] = rows[:, SIDE - low : SIDE + K + SIDE - high]
                size = len(ok)
                core.append(context_hashes(common, np.full(size, low, np.uint8), np.full(size, SIDE - high, np.uint8)))
                for to, what in ((context, ok), (left, x), (right, y), (body, rows)):
                    to.append(what)
        join = lambda x, kind, *shape: np.concatenate([np.zeros((0, *shape), kind), *x])
        self.wcontext, self.wlow, self.whigh = join(context, np.int64), SIDE - join(right, np.uint8).astype(np.int64), join(left, np.uint8).astype(np.int64)
        body, left, right, core = join(body, np.uint8, WIDTH), join(left, np.uint8), join(right, np.uint8), join(core, np.uint64)
        self.wwhich, first, self.wleast = _distinct(core, context_hashes(body, left, right), body, self.least[self.wcontext])
        self.wg, self.wrows, self.wleft, self.wright = core[first], body[first], left[first], right[first]

    def contexts(self, block: int) -> pa.Table:
        o = self.sent_order
        rows, left, right, doc, g = (x[o] for x in self.sent)
        packed = np.concatenate([g[:, None].view(np.uint8).reshape(-1, 8), doc[:, None].view(np.uint8).reshape(-1, 8), left[:, None], right[:, None], rows], axis=1)
        some, start = np.unique(self.sent_bucket[o], return_index=True)
        cut = np.append(start, len(o)).tolist()
        return _table(KEYS, [some, np.full(len(some), block), [_pack(packed[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]])

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which bytes go; answers: by bucket, least and most covered offset of each context sent."""
        o = self.sent_order
        got = np.frombuffer(b"".join(answers.get(b, b"") for b in np.unique(self.sent_bucket).tolist()), np.uint8).reshape(-1, 2)
        if len(got) != len(o):
            raise RuntimeError("a block's answers don't match its contexts")
        answer = np.empty((len(o), 2), np.uint8)
        answer[o] = got
        n = len(self.sent_context)
        low, high = np.full(len(self.g), NONE, np.int64), np.full(len(self.g), -1, np.int64)
        own = answer[:n].astype(np.int64)
        some = own[:, 0] != NONE
        low[self.sent_context[some]], high[self.sent_context[some]] = own[some, 0], own[some, 1]
        if len(self.wg):
            own, whole = answer[n:][self.wwhich].astype(np.int64), self.wleast[self.wwhich] < self.least[self.wcontext]
            hit = whole | (own[:, 0] != NONE)
            np.minimum.at(low, self.wcontext[hit], np.where(whole, self.wlow, own[:, 0])[hit])
            np.maximum.at(high, self.wcontext[hit], np.where(whole, self.whigh, own[:, 1])[hit])
        at, later = self.at[self.use], self.doc[self.row[self.use]] > self.least[self.which]
        left, right = self.left[self.which].astype(np.int64), self.right[self.which].astype(np.int64)
        low, high = np.where(later, SIDE - right, low[self.which]), np.where(later, left, high[self.which])
        ok = low <= high
        marks = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(marks, at[ok] - high[ok], 1)
        np.add.at(marks, at[ok] - low[ok] + SPAN, -1)
        return np.cumsum(marks[:-1], dtype=np.int32) > 0


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> A.U(1)) % A.U(buckets)).astype(np.int64)


def _distinct(g: np.ndarray, h: np.ndarray, rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each row's class, a row of each class, the class's smallest doc); classes ascend by (g, h)."""
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.lexsort((h, g))
    new = np.concatenate([[True], (g[by][1:] != g[by][:-1]) | (h[by][1:] != h[by][:-1])])
    first = by[np.flatnonzero(new)]
    number = np.empty(len(g), np.int64)
    number[by] = np.cumsum(new) - 1
    if (rows[first][number] != rows).any():  # hashes only propose equality: two collided, so order by the bytes themselves
        by = np.lexsort((*rows.T[::-1], h, g))
        change = (g[by][1:] != g[by][:-1]) | (h[by][1:] != h[by][:-1]) | (rows[by][1:] != rows[by][:-1]).any(axis=1)
        new = np.concatenate([[True], change])
        first = by[np.flatnonzero(new)]
        number[by] = np.cumsum(new) - 1
    return number, first, np.minimum.reduceat(doc[by], np.flatnonzero(new))


def _table(schema: T.StructType, columns: list) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "bigint": pa.int64()}
    return pa.table({f.name: pa.array(c, kinds[f.dataType.simpleString()]) for f, c in zip(schema.fields, columns, strict=True)})


def _bodies(data: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Binary values: the rows of data between one cut and the next."""
    at = (cut * (data.shape[1] if data.ndim > 1 else 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data).ravel())])


@functools.cache
def _zstd() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(rows: np.ndarray) -> bytes:
    return _zstd()[0].compress(rows.tobytes())


def _unpack(body: bytes, width: int) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(body), np.uint8).reshape(-1, width)


# ---------------------------------------------------------------- buckets


def _share(hot_blocks: int):
    """One bucket's keys of all blocks -> for each block a byte a key: 0, 1 (in other blocks too), 2 (in many), 3 (in very many)."""

    def run(table: pa.Table) -> pa.Table:
        data, cut = A.text_bytes(table["body"])
        wide = np.zeros((len(data) // 6, 8), np.uint8)
        wide[:, :6] = data.reshape(-1, 6)
        _, inverse, count = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        mark = np.where(count > VERY_HOT * hot_blocks, 3, np.where(count > hot_blocks, 2, np.where(count > 1, 1, 0))).astype(np.uint8)[inverse]
        return _table(KEYS, [table["bucket"].combine_chunks(), table["block"].combine_chunks(), _bodies(mark, cut // 6)])

    return run


def _decide(table: pa.Table) -> pa.Table:
    """One bucket's contexts of all blocks -> for each block the least and most covered offset of each context."""
    bodies = [_unpack(x.as_buffer(), 18 + WIDTH) for x in table["body"]]
    cut = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    packed = np.concatenate(bodies)
    g = np.ascontiguousarray(packed[:, :8]).view(np.uint64).ravel()
    doc = np.ascontiguousarray(packed[:, 8:16]).view(np.int64).ravel()
    left, right, rows = packed[:, 16], packed[:, 17], np.ascontiguousarray(packed[:, 18:])
    number, first, least = _distinct(g, context_hashes(rows, left, right), rows, doc)
    later = doc > least[number]
    low, high = np.full(len(first), NONE, np.uint8), np.full(len(first), NONE, np.uint8)
    group = g[first]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    edge = np.append(np.flatnonzero(new), len(group))
    many = np.repeat(np.diff(edge) > 1, np.diff(edge))
    some = np.flatnonzero(many)
    lo = 0
    while lo < len(some):  # whole groups, about 20,000 contexts at a time
        hi = min(len(some), lo + 20_000)
        while hi < len(some) and group[some[hi]] == group[some[hi - 1]]:
            hi += 1
        s = some[lo:hi]
        f = first[s]
        low[s], high[s] = covered(group[s], rows[f], left[f], right[f], least[s])
        lo = hi
    l8, r8 = left.astype(np.int16), right.astype(np.int16)
    whole = later & (SIDE - r8 <= l8)
    out = np.stack([np.where(whole, SIDE - r8, np.where(later, NONE, low[number])), np.where(whole, l8, np.where(later, NONE, high[number]))], axis=1).astype(np.uint8)
    return _table(KEYS, [table["bucket"].combine_chunks(), table["block"].combine_chunks(), _bodies(out, cut)])


def _marks(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table["bucket"].to_pylist(), table["body"].to_pylist(), strict=True))


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone without characters of which only some bytes go."""
    if not len(data):
        return gone
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    return np.repeat(np.minimum.reduceat(gone, lead), np.diff(np.append(lead, len(data))))


REST = "rest"


def suffix_dedup(docs: DataFrame, *, text: str = "text", block_bytes: int = BLOCK, hot_blocks: int = HOT_BLOCKS, as_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, spans (starts and ends of what goes, in turn), kept (bytes).

    Texts are UTF-8 bytes; null is empty. Matches never cross documents and are judged on the input. A null doc_id is
    smaller than any other; rows with one doc_id never shorten each other. An empty table gives no rows. as_text: only whole
    characters go, and kept is a string. If docs has a struct column `rest`, it's passed on.
    """
    extra = [c for c in docs.columns if c == REST]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), *extra)
    n = parts_for(own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], block_bytes)
    buckets = max(1, n // 2)
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(n)).cast("long")).repartition(n, "block")
    out_schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
        + [f for f in own.schema.fields if f.name == REST]
    )

    def ask(table: pa.Table) -> pa.Table:
        A.release()
        return Block(table, buckets).keys(table["block"][0].as_py())

    def send(table: pa.Table, shared: pa.Table) -> pa.Table:
        A.release()
        block = Block(table, buckets)
        marks = _marks(shared)
        block.entries(marks)
        sent = block.contexts(table["block"][0].as_py())
        # the marks travel along, so that the last pass needs no second look at the first exchange
        return pa.concat_tables([sent, _table(KEYS, [[-1 - b for b in marks], [table["block"][0].as_py()] * len(marks), list(marks.values())])])

    def decide(table: pa.Table) -> pa.Table:
        A.release()
        return table.select(KEYS.names) if table["bucket"][0].as_py() < 0 else _decide(table)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        A.release()
        block = Block(table, buckets)
        got = _marks(answers)
        block.entries({-1 - b: x for b, x in got.items() if b < 0})
        gone = block.removed({b: x for b, x in got.items() if b >= 0})
        if as_text:
            gone = _whole_characters(block.data, gone)
        counts, removed, spans, kept = [], [], [], []
        for s, e in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
            g = gone[s:e]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
            counts.append(e - s)
            removed.append(int(g.sum()))
            spans.append(edge)
            body = block.data[s:e][~g].tobytes() if len(edge) else block.data[s:e].tobytes()
            kept.append(body.decode() if as_text else body)
        columns = {
            "doc_id": table["doc_id"],
            "n_bytes": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array([len(x) // 2 for x in spans], pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.int64())),
            "kept": pa.array(kept, pa.string() if as_text else pa.binary()),
        }
        return pa.table(columns | {c: table[c] for c in extra})

    shared = dealt.groupBy("block").applyInArrow(ask, KEYS).groupBy("bucket").applyInArrow(_share(hot_blocks), KEYS)
    sent = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, KEYS)
    answers = sent.withColumn("lane", F.expr("if(bucket < 0, -1 - block, bucket)")).groupBy("lane").applyInArrow(decide, KEYS)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, out_schema)


def cut_texts(docs: DataFrame, **options) -> DataFrame:
    """docs with what earlier documents have cut out of their texts, whole characters at a time; a document of which nothing
    is left is dropped, one that had no text stays as it is. Columns as they were; n_chars, where there is one, follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    flag = "__no_text"  # of the text itself only this is passed on beside it
    rest = F.struct(*others, F.col("text").isNull().alias(flag))
    found = suffix_dedup(docs.select(rest.alias(REST), F.col("doc_id"), F.col("text")), as_text=True, **options).where("n_removed < n_bytes OR n_bytes = 0")
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.expr(f"if({REST}.{flag}, NULL, kept)")}
    if "n_chars" in others:
        made["n_chars"] = F.expr(f"if(n_removed = 0, {REST}.n_chars, length(kept))").cast(docs.schema["n_chars"].dataType)
    return found.select(*(made[c].alias(c) if c in made else F.col(f"{REST}.`{c}`").alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
