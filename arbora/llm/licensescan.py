"""Licence scanning: a trained paragraph classifier whose predictions templates confirm, with DataFrame operations only.

Training (on the driver, from the texts in `licences`) is a softmax regression over the presence of words and word pairs, with a
class for paragraphs that grant nothing. A lasso penalty makes it sparse; a temperature fitted on held-out paragraphs calibrates its
probabilities, so that an unfamiliar paragraph falls to `unknown`. A family counts only if one of its own templates (its
names, and paragraphs of its text) shares CONFIRMED of its n-grams with the paragraph. The main path is native: texts are looked
through for key words, without which too few n-grams of every template are left; paragraphs that have them are reduced to
distinct ones, their n-grams joined with the sparse weights, and the scores summed per class.
"""

from __future__ import annotations

import functools
import json
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import lookup
from .licences import FOREIGN, GRANTS, HELD_GRANTS, HELD_MENTIONS, MENTIONS, NAMES, OTHERS, TEXTS
from .scratch import materialise

UNKNOWN = "unknown"
CERTAIN = 0.5
CONFIRMED = 0.8
SPLIT = "[^a-z0-9]+"
#: Between paragraphs: lines without a letter or digit.
BLANK = r"\n[^\p{L}\p{N}]*\n"


def words(text: str) -> list[str]:
    """Lower-cased, and in one spelling of `license`."""
    return [w for w in re.split(SPLIT, text.lower().replace("licence", "license")) if w]


def grams(text: str) -> frozenset[str]:
    w = words(text)
    return frozenset({*w, *(f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True))})


def spdx(family: str) -> str:
    return f"SPDX-License-Identifier: {family}"


@functools.cache
def templates() -> dict[str, list[frozenset[str]]]:
    """Family -> the n-grams of each of its names and texts."""
    return {f: [grams(t) for t in (*names, spdx(f), *TEXTS.get(f, ()))] for f, names in NAMES.items()}


def needed(own: frozenset[str]) -> int:
    """N-grams that confirm a template with these."""
    return math.ceil(CONFIRMED * len(own))


@functools.cache
def key_words() -> tuple[tuple[str, ...], ...]:
    """Groups of words, the longest first in each. A text that confirms a template has all words of some group.

    Words without any of which a template can't be confirmed are a group together. A template that can spare any one word
    can't spare all of some words, each of which is a group.
    """
    keys: set[tuple[str, ...]] = set()
    for own in sorted({o for v in templates().values() for o in v}, key=lambda o: (len(o), sorted(o))):
        every = sorted({w for g in own for w in g.split()}, key=lambda w: (-len(w), w))
        left = lambda gone: sum(not gone & set(g.split()) for g in own)  # noqa: E731, B023
        single = [w for w in every if left({w}) < needed(own)]
        if single:
            keys.add(tuple(single))
            continue
        gone: set[str] = set()
        for w in sorted(every, key=lambda w: ((w,) not in keys, -len(w), w)):  # noqa: B023
            if left(gone) >= needed(own):
                gone.add(w)
        for w in sorted(gone, key=lambda w: (len(w), w)):
            if left(gone - {w}) < needed(own):
                gone.remove(w)
        keys |= {(w,) for w in gone}
    return tuple(sorted(k for k in keys if not any({*o} <= {*k} for o in keys - {k})))


@functools.cache
def key_strings() -> tuple[tuple[str, ...], ...]:
    """The same as strings within lower-cased text, in either spelling of `license`: a first, cheap look."""
    stem = lambda w: w[: w.index("licens") + 5] if "licens" in w else w
    keys = {tuple(sorted({stem(w) for w in k}, key=lambda w: (-len(w), w))) for k in key_words()}
    return tuple(sorted(k for k in keys if not any(all(any(p in q for q in k) for p in o) for o in keys - {k})))


def examples(rng: np.random.Generator) -> tuple[list, list]:
    """(paragraphs, held-out paragraphs) as (n-grams, family). Held-out ones have sentences and wordings of their own."""
    filler = sorted({w for t in OTHERS for w in words(t)})

    def vary(text: str, drop: float) -> frozenset[str]:
        """With words dropped, and foreign ones around."""
        w = [x for x in words(text) if rng.random() > drop]
        around = [str(x) for x in rng.choice(filler, int(rng.integers(0, 9)))]
        cut = int(rng.integers(0, len(around) + 1))
        return grams(" ".join(around[:cut] + w + around[cut:]))

    shown, held = [], []
    for family, names in NAMES.items():
        for text in [g.format(n) for g in GRANTS for n in names] + [spdx(family)]:
            shown += [(grams(text), family), (vary(text, 0.03), family)]
        for text in TEXTS.get(family, ()):
            shown += [(grams(text), family)] * 2 + [(vary(text, 0.08), family) for _ in range(8)]
            held += [(vary(text, 0.12), family) for _ in range(2)]
        held += [(vary(g.format(n), 0), family) for g in HELD_GRANTS for n in names] + [(vary(spdx(family), 0), family)]
        shown += [(vary(m.format(n), 0.05), UNKNOWN) for m in MENTIONS for n in names]
        shown += [(vary(f"{rng.choice(filler)} {rng.choice(filler)} {n} {rng.choice(filler)}", 0), UNKNOWN) for n in names for _ in range(5)]
        held += [(vary(m.format(n), 0), UNKNOWN) for m in HELD_MENTIONS for n in names]
    for k, name in enumerate(FOREIGN):
        to = held if k % 4 == 0 else shown
        to += [(vary(g.format(name), 0), UNKNOWN) for g in GRANTS for _ in range(2)]
    for k in range(300):  # licences that nobody knows
        name = f"{rng.choice(filler)} {rng.choice(('Public', 'Software', 'General Public', 'Source', 'Font', 'Documentation'))} License {rng.choice(('', '1.0', '1.1', '2', '2.0', 'version 3', '4.0'))}"
        (held if k % 6 == 0 else shown).append((vary(str(rng.choice(GRANTS)).format(name), 0), UNKNOWN))
    for text in OTHERS:
        shown += [(grams(text), UNKNOWN), *((vary(text, 0.1), UNKNOWN) for _ in range(6))]
        held.append((vary(text, 0.2), UNKNOWN))
    pool = [w for names in NAMES.values() for w in words(names[0])] + filler
    for k in range(400):  # the same words out of order
        (held if k % 8 == 0 else shown).append((grams(" ".join(str(x) for x in rng.choice(pool, int(rng.integers(3, 20))))), UNKNOWN))
    return shown, held


def train(seed: int = 1) -> dict:
    """Classes, n-grams, weights (n-grams and a last row of intercepts, classes), and the accuracy and confusions (right family,
    found family, number) of what is confirmed on held-out paragraphs."""
    classes = [UNKNOWN, *NAMES]
    shown, held = examples(np.random.default_rng(seed))
    count: dict[str, int] = {}
    for own, _ in shown:
        for g in own:
            count[g] = count.get(g, 0) + 1
    names = sorted(g for g, n in count.items() if n >= 4)
    at = {g: i for i, g in enumerate(names)}

    def matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(names) + 1), np.float32)
        x[:, -1] = 1
        for i, (own, _) in enumerate(rows):
            x[i, [at[g] for g in own if g in at]] = 1
        return x, np.array([classes.index(f) for _, f in rows])

    x, y = matrix(shown)
    w = _softmax_fit(x, np.eye(len(classes), dtype=np.float32)[y])
    x, y = matrix(held)
    heat = min(np.linspace(0.5, 4, 36), key=lambda t: -np.log(_softmax(x @ w / t)[np.arange(len(y)), y] + 1e-12).sum())
    p = _softmax(x @ w / heat)
    best = np.array([k if confirmed(classes[k], own, q) else 0 for (own, _), k, q in zip(held, p.argmax(1).tolist(), p.max(1).tolist(), strict=True)])
    wrong: dict[tuple[str, str], int] = {}
    for a, b in zip(y[y != best].tolist(), best[y != best].tolist(), strict=True):
        wrong[classes[a], classes[b]] = wrong.get((classes[a], classes[b]), 0) + 1
    weights = np.round(w.astype(np.float64) / heat, 4)
    some = (weights != 0).any(axis=1)
    some[-1] = True
    return {"classes": classes, "grams": [g for g, k in zip(names, some, strict=False) if k], "weights": weights[some], "accuracy": float((best == y).mean()), "confusions": sorted((a, b, n) for (a, b), n in wrong.items())}


def confirmed(family: str, own: frozenset[str], probability: float) -> bool:
    return family != UNKNOWN and probability >= CERTAIN and any(len(own & t) >= needed(t) for t in templates()[family])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _softmax_fit(x: np.ndarray, y: np.ndarray, steps: int = 250, lasso: float = 1e-4) -> np.ndarray:
    """Accelerated proximal gradient on the likelihood: after each step weights but the intercepts shrink by the lasso penalty, most
    to zero. The step is the inverse of the gradient's Lipschitz constant, by power iteration."""
    u = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        u = x.T @ (x @ u)
        size = np.linalg.norm(u)
        u /= size
    step = len(x) / (0.5 * size)
    w = before = np.zeros((x.shape[1], y.shape[1]), np.float32)
    for t in range(steps):
        ahead = w + t / (t + 3) * (w - before)
        before, w = w, ahead - step * (x.T @ (_softmax(x @ ahead) - y) / len(x))
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step * lasso, 0)
    return w


@functools.cache
def model() -> dict:
    """Trained once a process."""
    return train()


def _rows(spark, rows: list, kind: str) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def _bound(value, then):
    """then(value), where the value is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def gram_array(text):
    """Distinct words and word pairs of a column."""

    def both(w):
        pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.concat(w, F.slice(pairs, 1, F.greatest(F.size(w) - 1, F.lit(0)))))

    return _bound(F.filter(F.split(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), SPLIT), lambda t: t != ""), both)


def _any(conditions: list):
    return functools.reduce(lambda a, b: a | b, conditions)


def _has_group(text, groups):
    """Whether text contains all strings of some group. Strings that start a group are looked for first."""
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for first, *more in groups:
        by_first.setdefault(first, []).append(tuple(more))

    def found(t):
        out = []
        for first, rests in by_first.items():
            some = [functools.reduce(lambda a, b: a & b, [t.contains(w) for w in r]) for r in rests if r]
            out.append(t.contains(first) & _any(some) if len(some) == len(rests) else t.contains(first))
        return _any(out)

    return _bound(text, found)


def has_key(text):
    """Whether a column has a key string; false only where nothing can be confirmed."""
    return _has_group(F.lower(text), key_strings())


def has_key_words(text):
    """Whether a column has a group of key words, as words; false only where nothing can be confirmed."""
    spelled = F.regexp_replace(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), SPLIT, " ")
    return _has_group(F.concat(F.lit(" "), spelled, F.lit(" ")), [tuple(f" {w} " for w in k) for k in key_words()])


def classify(paragraphs: DataFrame) -> DataFrame:
    """id, paragraph, family and probability of each distinct row of (id, paragraph) that has a confirmed family.

    Only ids travel with the n-grams, so a paragraph of megabytes isn't copied for each of its own.
    """
    spark, m = paragraphs.sparkSession, model()
    n = len(m["classes"])
    weights = _rows(spark, [{"gram": g, "w": m["weights"][i].tolist()} for i, g in enumerate(m["grams"])], "gram string, w array<double>")
    known = _rows(spark, [{"family": k, "own": sorted(o), "needed": needed(o)} for k, v in templates().items() for o in v], "family string, own array<string>, needed int")
    one = materialise(paragraphs.dropDuplicates(["id"]))
    held = one.select("id", F.explode(gram_array(F.col("paragraph"))).alias("gram")).join(F.broadcast(weights), "gram")  # some thousand n-grams
    start = m["weights"][-1].tolist()
    scored = held.groupBy("id").agg(*(F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(n)))
    scores = F.array(*(F.round(F.col(f"s{k}") + start[k], 6) for k in range(n)))
    named = F.array(*(F.lit(c) for c in m["classes"]))
    top = scored.select("id", scores.alias("z")).withColumn("best", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("best")))
    top = top.select("id", F.get(named, F.array_position("z", F.col("best")).cast("int") - 1).alias("family"), F.round(1 / total, 6).alias("probability"))
    likely = one.join(top.where((F.col("family") != UNKNOWN) & (F.col("probability") >= CERTAIN)), "id")
    # one set of n-grams a paragraph, against all templates of its family
    own = known.groupBy("family").agg(F.collect_list(F.struct("own", "needed")).alias("templates"))
    fits = _bound(gram_array(F.col("paragraph")), lambda g: F.exists("templates", lambda t: F.size(F.array_intersect(t["own"], g)) >= t["needed"]))
    return likely.join(F.broadcast(own), "family").where(fits).select("id", "paragraph", "family", "probability")


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, families (sorted, comma-joined; empty if there are none), n_paragraphs (confirmed) and least_probability.

    Paragraphs are what blank lines (or lines without a letter or digit) separate, so that wrapped lines are one, and single
    lines. A paragraph of several lines isn't counted where one of its lines names the same family. Null and empty
    texts have none. Rows that repeat a doc_id are one document; null ids are one, too. A text of any length is read whole;
    paragraphs have no greatest length. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    own = docs.select("doc_id", F.col(text).alias("text"))
    some = own.where(has_key(F.col("text")))
    several = F.filter(F.split("text", BLANK), lambda b: b.contains("\n"))
    parts = some.select("doc_id", F.explode(F.concat(F.split("text", "\n"), several)).alias("paragraph"))
    parts = parts.where(has_key(F.col("paragraph"))).where(has_key_words(F.col("paragraph")))
    parts = materialise(parts.withColumn("id", F.md5("paragraph")))
    named = materialise(classify(parts.select("id", "paragraph")))
    lines = named.where(F.col("paragraph").contains("\n")).select("id", "family", F.explode(F.split("paragraph", "\n")).alias("line"))
    again = lines.select("id", "family", F.md5("line").alias("line")).join(named.select(F.col("id").alias("line"), "family"), ["line", "family"]).select("id").distinct()
    counted = named.select("id", "family", "probability").join(again, "id", "left_anti")
    # a licence's lines repeat in very many documents: those rows stay where they are
    found = lookup(parts.select("doc_id", "id"), "id", counted).where("family IS NOT NULL").groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count("*").alias("n_paragraphs"), F.min("probability").alias("least_probability")
    )
    ids = own.select(F.col("doc_id").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("doc_id")), "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), "least_probability")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
