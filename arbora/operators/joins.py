"""Join and reduction operators on DataFrames.

on: pairs of equal columns (left, right); null_safe: nulls equal each other. None of these changes how often a left row counts, but for inner().
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
Pairs = list[tuple[Column, Column]]


def ids(attributes) -> set[int]:
    """Expression ids of a JVM attribute set."""
    seq = attributes.toSeq()
    return {seq.apply(i).exprId().id() for i in range(seq.size())}


def _all(conditions: list[Column]) -> Column:
    return reduce(operator.and_, conditions) if conditions else F.lit(True)


def connected_order(parts: list[tuple[str, frozenset]]) -> list[str]:
    """Names in an order in which each shares a variable with one before, as far as there is such an order."""
    left, out, seen = list(parts), [], frozenset()
    while left:
        k = next((i for i, (_, v) in enumerate(left) if not out or v & seen), 0)
        name, variables = left.pop(k)
        out.append(name)
        seen |= variables
    return out


def _equal(on: Pairs, null_safe: bool) -> list[Column]:
    return [x.eqNullSafe(y) if null_safe else x == y for x, y in on]


def inner(a: DataFrame, b: DataFrame, on: Pairs, extra: list[Column] = (), null_safe: bool = False) -> DataFrame:
    """Inner join; without pairs a product, as the query asks for one."""
    if not on and not extra:
        return a.crossJoin(b)
    return a.join(b, _all(_equal(on, null_safe) + list(extra)), "inner")


def semi(a: DataFrame, b: DataFrame, on: Pairs, extra: list[Column] = (), null_safe: bool = False, unique: bool = False) -> DataFrame:
    """Rows of a with a partner in b. Without extra conditions b's keys are made distinct first, so a hot key is one row;
    unique: b has each key once as it is."""
    if not on and not extra:
        return a.join(b.limit(1), F.lit(True), "left_semi")
    if not extra:
        b = b.select(*(y for _, y in on))
        b = b if unique else b.distinct()
    return a.join(b, _all(_equal(on, null_safe) + list(extra)), "left_semi")


def extreme(a: DataFrame, b: DataFrame, on: Pairs, value: Column, least: bool, name: str, null_safe: bool = False, unique: bool = False) -> DataFrame:
    """a with a column of the least (or greatest) value of b's matching rows; rows without a match, or only null values, go.
    unique: b has each key once, so its value is joined as it is."""
    best = (F.min if least else F.max)(value).alias(name)
    if on and unique:
        small = b.select(*(y for _, y in on), value.alias(name))
    else:
        small = b.groupBy(*(y for _, y in on)).agg(best) if on else b.agg(best)
    small = small.where(F.col(name).isNotNull())
    joined = a.join(small, _all(_equal(on, null_safe)), "inner") if on else a.crossJoin(small)  # one row
    return joined.select(*a.columns, name)


def best_below(a: DataFrame, b: DataFrame, on: Pairs, value: Column, name: str) -> DataFrame:
    """Rows of a with a partner in b, with the greatest value among the partners; null if they have none."""
    best = F.max(value).alias(name)
    small = b.groupBy(*(y for _, y in on)).agg(best) if on else b.agg(best, F.count("*").alias("partners")).where("partners > 0")
    return inner(a, small, on).select(*a.columns, name)


def at_least_kth(a: DataFrame, bound: Column, k: int) -> DataFrame:
    """Rows of a whose bound is no smaller than the k-th greatest (but for rounding), with that as column `kth`; it's null, and all
    rows stay, where fewer than k bounds are known."""
    greatest = a.select(bound.alias("bound")).orderBy(F.col("bound").desc_nulls_last()).limit(k)
    kth = greatest.agg(F.when(F.count("bound") == k, F.min("bound")).alias("kth"))  # one row
    return above_kth(a.crossJoin(F.broadcast(kth)), bound)


def above_kth(a: DataFrame, bound: Column) -> DataFrame:
    return a.where(F.col("kth").isNull() | (bound >= F.col("kth") - F.abs("kth") * 1e-9))


def staircase(b: DataFrame, keys: list[Column], first: tuple[Column, bool], second: tuple[Column, bool]) -> DataFrame:
    """Columns k0.., first, second: per key the pairs of values that no other pair beats in both. (value, whether smaller is better)

    That is all a pair of order comparisons on the two values can need: every other row has one at least as good in both.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = b.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), first[0].alias("first"), second[0].alias("second")).where("first IS NOT NULL AND second IS NOT NULL")
    best = F.min if second[1] else F.max
    rows = rows.groupBy(*names, "first").agg(best("second").alias("second"))  # on the map side already
    order = F.col("first").asc() if first[1] else F.col("first").desc()
    ahead = best("second").over(Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    better = F.col("second") < F.col("ahead") if second[1] else F.col("second") > F.col("ahead")
    return rows.withColumn("ahead", ahead).where(F.col("ahead").isNull() | better).drop("ahead")


def semi_two(a: DataFrame, b: DataFrame, on: Pairs, first: tuple, second: tuple, null_safe: bool = False) -> DataFrame:
    """Rows of a with a row of b that has the same keys and fulfils two order comparisons: (b's value, operator, a's value) each.
    Only b's staircase takes part, so on a hot key a row meets a few pairs instead of all of b's rows."""
    down = lambda c: c[1] in ("<", "<=")
    stairs = staircase(b, [y for _, y in on], (first[0], down(first)), (second[0], down(second)))
    stairs = stairs.select(*(F.col(c).alias(f"s_{c}") for c in stairs.columns))
    pairs = [(x, F.col(f"s_k{i}")) for i, (x, _) in enumerate(on)]
    extra = [COMPARE[first[1]](F.col("s_first"), first[2]), COMPARE[second[1]](F.col("s_second"), second[2])]
    return a.join(stairs, _all(_equal(pairs, null_safe) + extra), "left_semi")


def inner_band(a: DataFrame, b: DataFrame, on: Pairs, low: Column, at: Column, width: int | float, moment: bool) -> DataFrame:
    """Inner join of pairs with equal keys where a's `low` and b's `at` lie in one bucket or in neighbouring ones.

    For conditions low <= at <= low + width, which the caller still applies. Values are cut into buckets of that width; a row of
    a meets two of them, so a hot key is spread over its buckets, and a row meets only what may be in its band. moment: values
    are timestamps and the width is in microseconds.
    """
    number = (lambda c: F.unix_micros(c.cast("timestamp"))) if moment else (lambda c: c)
    bucket = lambda c: F.floor(number(c) / F.lit(width))
    left = a.withColumn("band_a", F.explode(F.array(bucket(low), bucket(low) + 1)))
    return inner(left, b.withColumn("band_b", bucket(at)), [*on, (F.col("band_a"), F.col("band_b"))]).drop("band_a", "band_b")


def triangle(r: DataFrame, s: DataFrame, t: DataFrame, rs: Pairs, st: Pairs, tr: Pairs) -> DataFrame:
    """r, s and t joined where rs, st and tr hold, each a list of pairs of equal columns; columns have different names.

    Every row of r is extended through the one of s and t in which its key is rarer, and closed with the other. Over all rows
    the smaller of two degrees adds up to no more than the root of the product of the three sizes, the worst-case-optimal
    bound, however hot some keys are. Rows keep their number.
    """
    degree = lambda df, keys, n: df.groupBy(*(k.alias(f"{n}{i}") for i, k in enumerate(keys))).agg(F.count("*").alias(n))
    in_s, in_t = degree(s, [y for _, y in rs], "ds"), degree(t, [x for x, _ in tr], "dt")
    counted = inner(r, in_s, [(x, F.col(f"ds{i}")) for i, (x, _) in enumerate(rs)])
    counted = inner(counted, in_t, [(y, F.col(f"dt{i}")) for i, (_, y) in enumerate(tr)])
    kept = [*r.columns, *s.columns, *t.columns]
    by_s = inner(inner(counted.where("ds <= dt"), s, rs), t, [*st, *tr]).select(*kept)
    turned = [(y, x) for x, y in tr]
    by_t = inner(inner(counted.where("ds > dt"), t, turned), s, [*((y, x) for x, y in st), *rs]).select(*kept)
    return by_s.union(by_t)


def band(a: DataFrame, b: DataFrame, keys: list[str], at: str, other: str, width: int, unit: str = "days") -> DataFrame:
    """Pairs with equal keys and b.other within [a.at, a.at + width], in timestamps; b's columns get the prefix r_.

    Times are cut into buckets of the band's width; a row of a meets two buckets, so the join stays an equality join
    even on one hot key, and the bucket spreads that key.
    """
    seconds = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[unit] * width
    epoch = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    left = a.withColumn("__b", F.explode(F.array(epoch(at), epoch(at) + 1)))
    right = b.select(*(F.col(c).alias(f"r_{c}") for c in b.columns)).withColumn("__rb", epoch(f"r_{other}"))
    on = [F.col(k) == F.col(f"r_{k}") for k in keys] + [F.col("__b") == F.col("__rb")]
    inside = (F.col(f"r_{other}") >= F.col(at)) & (F.col(f"r_{other}") <= F.col(at) + F.expr(f"INTERVAL {seconds} SECONDS"))
    return left.join(right, _all(on) & inside, "inner").drop("__b", "__rb")


def triangles(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Distinct directed triangles x -> y -> z -> x of the distinct edges, in each of their rotations, as (x, y, z).

    Each triangle is found from its vertex of least degree (ties by number): pairs of that vertex's edges are closed by the
    third. Of neighbours that rank higher a vertex has at most a root of twice the edges, however hot it is, so the
    pairs stay within the worst-case-optimal number.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().distinct()
    degree = e.select(F.col("a").alias("v")).union(e.select("b")).groupBy("v").agg(F.count("*").alias("d"))
    ranked = e.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    low, high = F.struct(F.col("da").alias("d"), F.col("a").alias("v")), F.struct(F.col("db").alias("d"), F.col("b").alias("v"))
    out = ranked.where(low <= high).select(F.col("a").alias("x"), F.col("b").alias("y"))
    back = ranked.where(high <= low).select(F.col("b").alias("x"), F.col("a").alias("z"))
    found = out.join(back, "x").join(e.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"]).select("x", "y", "z")
    turns = [F.struct(F.col(p).alias("x"), F.col(q).alias("y"), F.col(r).alias("z")) for p, q, r in ("xyz", "yzx", "zxy")]
    return found.select(F.explode(F.array(*turns)).alias("t")).select("t.*").distinct()
