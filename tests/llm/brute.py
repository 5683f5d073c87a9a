"""Plain Python versions of the operators, and documents with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANKS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, kept string, n_words int, component_id string, rest string"


def documents(seed: int = 4, n: int = 120) -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, a very long one, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(1, 6)))
    prose = lambda k: " ".join(rng.choice([word(), word().capitalize() + "."]) for _ in range(k))
    passage, other = prose(60), prose(25)
    rows: list[tuple] = []
    for i in range(n):
        kind = rng.random()
        text = prose(rng.randrange(1, 80))
        if kind < 0.15 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.35 and rows:
            words = (rng.choice(rows)[1] or "x").split(" ")
            words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        elif kind < 0.5:
            text = text + "\n" + passage + "\n" + prose(5)
        elif kind < 0.6:
            text = other + text
        rows.append((i * 3, text))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "one two"), (1005, prose(4000) + passage), (1006, passage), (1007, "x" * 3000), (1008, "x" * 3000), (1009, "A\u00a0b \x00c D")]
    rows += [rows[5], rows[5]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows: list[tuple]):
    """The rows with more columns, whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "k", 1, "c", "r") for i, t in rows], SCHEMA)


def suffix_dedup(rows: list[tuple]) -> dict:
    texts = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    first: dict = {}
    for i, t in texts:
        for p in range(len(t) - 49):
            g = t[p : p + 50]
            first[g] = min(first.get(g, i), i)
    out = defaultdict(list)
    for (i, _), (own, t) in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < own:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i].append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(x) for i, x in out.items()}


def shingles(text: str | None, size: int = 5) -> set:
    w = BLANKS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_duplicates(rows: list[tuple]) -> dict:
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                r, s = sorted((root(i), root(j)))
                up[s] = r
    return {i: (len(x), root(i), root(i) == i) for i, x in sets}


def decontaminate(rows: list[tuple], items: list[tuple], window: int = 13) -> dict:
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])] |= {str(i)} - {"None"}
    lengths = {len(k) for k in windows}
    out = {}
    for i, t in rows:
        w, hit, held = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    held |= windows[g]
        out[i] = (len(w), sorted(hit), sorted(held))
    return out
