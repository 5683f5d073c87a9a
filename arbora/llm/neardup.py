"""Near-duplicate groups with an LSH forest over min-hash signatures and confirmation on full shingle sets.

1. One pass turns each text into its set of distinct word shingles, the set's digest, and min-hash signatures. Equal sets
   are one class from here on, represented by the smallest document.
2. Every tree has a sequence of min-hashes of its own, and all classes are sorted by it: one range sort over all trees, which a
   region of any size is spread over. In that order a class's neighbours are those with the longest common prefix. A
   region is a run that shares the first three; a pair at similarity 0.75 misses all 24 trees' regions with a
   probability of 2e-6. A region of up to `small` classes is a candidate as a whole, and regions that share classes
   are merged. A larger one is cut at the depth at which its parts are small enough, each part a candidate on its own, and
   each class keeps its deepest parts.
3. A candidate's full sets meet in one task, where an inverted index over its shingles counts all intersections, so
   every link inside it is confirmed exactly. Merged regions of more than `tile` shingles are cut into tiles, and each pair of
   tiles is a task of its own. Tasks return spanning edges, not pairs.
4. Cutting may lose links, so regions that were cut are completed exactly. Those whose classes are all connected by now are
   done. The classes of the others are joined by prefix filter: two sets at the wanted similarity share a shingle among the first
   n - ceil(similarity * n) + 1 of either, in any one order of all shingles; here the rarest come first, by a count sketch of bounded
   size. Classes that share such a shingle, and aren't all connected, meet in tiles, but for pairs within the
   largest component. Families that share only boilerplate part at this step without a comparison.
5. Components of those edges are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .graphs import Forest, components, lookup
from .scratch import materialise, parts_for

WORDS = 5
PERCENT = 75
TREES = 24
#: Min-hashes of a tree that make a region, and those that order it further.
DEPTH, DEEPER = 3, 2
SMALL = 64
TILE = 250_000
SKETCH = 1 << 18
#: Bytes of text whose shingles one task counts: it hands on up to SKETCH counts however little it has read.
COUNTED_BYTES = 1 << 24
NULL_ID = -(1 << 63)

_draw = np.random.Generator(np.random.PCG64(7))
_HASHES = TREES * (DEPTH + DEEPER)
_LOW = _draw.integers(0, 1 << 31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_HIGH = _draw.integers(0, 1 << 31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MARK = _draw.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * A.U(2) + A.U(1)

SCANNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("d1", T.LongType()),
        T.StructField("d2", T.LongType()),
        T.StructField("prefixes", T.ArrayType(T.LongType())),
        T.StructField("deeper", T.ArrayType(T.LongType())),
    ]
)


def signatures(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Min-hashes, one row for each nonempty set."""
    low, high = flat.astype(np.uint32), (flat >> A.U(32)).astype(np.uint32)
    first = at[:-1][np.diff(at) > 0]
    out = np.empty((len(first), len(_LOW)), np.uint32)
    for k in range(len(_LOW)):
        h = low * _LOW[k]
        h += high * _HIGH[k]
        h ^= h >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(h, first)
    return out


def prefixes(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per tree a hash of its first three min-hashes, tree number included, and the next two side by side."""
    h = (sig[:, : TREES * DEPTH].astype(np.uint64) + A.U(1)) * _MARK
    more = sig[:, TREES * DEPTH :].astype(np.uint64)
    return A.mix(h.reshape(len(sig), TREES, DEPTH).sum(axis=2)), more[:, 0::2] << A.U(32) | more[:, 1::2]


def _scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = A.text_bytes(b.column(1))
            for i, j in A.row_pieces(offsets):
                flat, at = A.shingle_sets(A.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1], A.BLANKS), WORDS)
                n = np.diff(at)
                some = n > 0
                d = np.zeros((2, j - i), np.uint64)
                keys, more = (np.zeros((int(some.sum()), TREES), np.uint64) for _ in range(2))
                if some.any():
                    d[0][some] = np.add.reduceat(flat, at[:-1][some])
                    d[1][some] = np.add.reduceat(A.mix(flat * A.U(3)), at[:-1][some])
                    keys, more = prefixes(signatures(flat, at))
                cut = np.concatenate([[0], np.cumsum(some * TREES)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.view(np.int64).ravel())) for x in (keys, more)]
                ids = b.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), *lists], SCANNED.names)

    return docs.mapInArrow(run, SCANNED)


# ---------------------------------------------------------------- the forest

#: A class's place in a tree. depth 0: its region is small, and `region` is the region's smallest class. Else the region was
#: cut (or lies across partitions), and `part` is the piece of common prefix length `depth` that the class fell into, if not alone.
PLACES = T.StructType([T.StructField("rep", T.LongType()), T.StructField("region", T.LongType()), T.StructField("part", T.LongType()), T.StructField("depth", T.IntegerType())])


def parts(deeper: np.ndarray, small: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, depth) of a sorted region's parts of at most `small` classes, cut where the common prefix is shortest."""

    def cut(low: int, high: int, depth: int) -> Iterator[tuple[int, int, int]]:
        if high - low <= small:
            yield low, high, depth
        elif depth == DEPTH + DEEPER:  # all alike: neighbours, the last of each part in the next one, too
            for k in range(low, high - 1, small - 1):
                yield k, min(k + small, high), depth
        else:
            own = deeper[low:high] >> A.U(32 * (DEPTH + DEEPER - depth - 1))
            edge = [low, *(np.flatnonzero(own[1:] != own[:-1]) + 1 + low).tolist(), high]
            for k in range(len(edge) - 1):
                yield from cut(edge[k], edge[k + 1], depth + 1)

    yield from cut(0, len(deeper), DEPTH)


def _places(small: int):
    """Rows (region, deeper, rep) of a sorted partition -> PLACES. Its first and last regions may go on in other partitions."""

    def whole(region: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        """Small regions that lie in here: a row for each class of those with several."""
        start = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        size = np.diff(np.append(start, len(region)))
        least = np.repeat(np.minimum.reduceat(rep, start), size)
        some = np.repeat(size, size) > 1
        n = int(some.sum())
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(least[some]), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32))], PLACES.names)

    def dense(region: np.ndarray, deeper: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        at, part, depth = [], [], []
        for s, e, d in parts(deeper, small):
            name = int(A.mix(np.array([region[0] ^ (int(rep[s]) * 31 + d)], np.int64).view(np.uint64)).view(np.int64)[0])
            at.append(np.arange(s, e))
            part += [name if e - s > 1 else None] * (e - s)
            depth += [d] * (e - s)
        at = np.concatenate(at)
        return pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(region[at]), pa.array(part, pa.int64()), pa.array(depth, pa.int32())], PLACES.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last region so far
        first = True
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(n).to_numpy() for n in ("region", "deeper", "rep")]
            new[1] = new[1].view(np.uint64)
            if held and new[0][0] == held[0][0][0] == new[0][-1]:
                held.append(new)
                continue
            region, deeper, rep = (np.concatenate(x) for x in zip(*held, new, strict=True))
            edge = [0, *(np.flatnonzero(region[1:] != region[:-1]) + 1).tolist()]
            size = np.diff(edge)
            big = {k for k in np.flatnonzero(size > small).tolist()} | ({0} if first and len(size) else set())
            for k in sorted(big):
                yield dense(*(x[edge[k] : edge[k + 1]] for x in (region, deeper, rep)))
            keep = np.repeat(~np.isin(np.arange(len(size)), list(big)), size)
            if keep.any():
                yield whole(region[: edge[-1]][keep], rep[: edge[-1]][keep])
            first = first and not len(size)
            held = [[x[edge[-1] :] for x in (region, deeper, rep)]]
        if held:
            yield dense(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _forest(classes: DataFrame, small: int) -> DataFrame:
    """PLACES of all classes that have company in a tree: every tree's order, neighbours with a common prefix, adaptive depth.

    Trees are kept apart by their numbers in the regions' hashes, so one sort serves all.
    """
    rows = classes.select("rep", F.explode(F.arrays_zip("prefixes", "deeper")).alias("t")).select(F.col("t.prefixes").alias("region"), F.col("t.deeper").alias("deeper"), "rep")
    key = [F.col("region"), F.shiftrightunsigned("deeper", 1), "deeper", "rep"]  # the second orders as unsigned numbers do
    return rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_places(small), PLACES)


# ---------------------------------------------------------------- exact confirmation


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """The root of every set among these, where sets of at least `percent` similarity are linked."""
    m, size = len(sets), np.array([len(x) for x in sets], np.int64)
    forest = Forest()
    if m > 1:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
        order = np.argsort(flat, kind="stable")
        sorted_, owners = flat[order], owner[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(flat)))
        posting = np.empty(len(flat), np.int64)
        posting[order] = np.cumsum(new) - 1
        at = np.concatenate([[0], np.cumsum(size)])
        for i in range(m - 1):
            p = posting[at[i] : at[i + 1]]
            p = p[count[p] > 1]
            if not len(p):
                continue
            # 8 M postings at a time
            common = np.zeros(m, np.int64)
            for part in np.split(p, np.flatnonzero(np.diff(np.cumsum(count[p]) // 8_000_000)) + 1):
                c = count[part]
                common += np.bincount(owners[np.repeat(start[part] - (np.cumsum(c) - c), c) + np.arange(c.sum())], minlength=m)
            near = np.flatnonzero(100 * common[i + 1 :] >= percent * (size[i] + size[i + 1 :] - common[i + 1 :])) + i + 1
            for j in near.tolist():
                forest.union(i, j)
    return [forest.root(i) for i in range(m)]


SETS = T.StructType([T.StructField(n, T.LongType()) for n in ("bin", "i", "j", "region", "rep")] + [T.StructField("shingles", T.BinaryType())])


def _sets(rows: DataFrame) -> DataFrame:
    """A row for each task that needs the class's set. rows: rep, text, region, tile, meets (tiles from 0 up to there, 0: shares a task), bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = A.text_bytes(b.column("text"))
            region, rep, meets, tile, bin_ = (b.column(n).to_pylist() for n in ("region", "rep", "meets", "tile", "bin"))
            for i, j in A.row_pieces(offsets):
                flat, at = A.shingle_sets(A.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1], A.BLANKS), WORDS)
                out: list[tuple] = []
                for k in range(i, j):
                    own = flat[at[k - i] : at[k - i + 1]].tobytes()
                    if meets[k] == 0:
                        out.append((bin_[k], -1, -1, region[k], rep[k], own))
                    else:
                        out += [(region[k], min(tile[k], x), max(tile[k], x), region[k], rep[k], own) for x in range(meets[k])]
                    if len(out) > 500:
                        yield pa.RecordBatch.from_pylist([dict(zip(SETS.names, x, strict=True)) for x in out], _ARROW)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(SETS.names, x, strict=True)) for x in out], _ARROW)

    return rows.mapInArrow(run, SETS)


_ARROW = pa.schema([(n, pa.int64()) for n in SETS.names[:-1]] + [("shingles", pa.binary())])


def _confirm(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.select(["region", "rep", "shingles"]).combine_chunks().sort_by([("region", "ascending"), ("rep", "ascending")])
        region, rep = table["region"].to_numpy(), table["rep"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(region)) + 1, [len(region)]]).tolist()
        a, b = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"].slice(s, e - s)]
            for k, r in enumerate(linked(sets, percent)):
                if rep[s + k] != rep[s + r]:
                    a.append(rep[s + k])
                    b.append(rep[s + r])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _unsettled(large: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """Tiles for the pairs of regions that are not both in the region's largest component: the other classes' tiles
    come first and meet every tile, those of the largest component meet the other classes' only."""
    placed = materialise(large.join(groups.toDF("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    main = placed.groupBy("region", "component").agg(F.sum("n_shingles").alias("size")).groupBy("region").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    placed = lookup(placed, "region", main).withColumn("rest", F.col("component") != F.col("main"))
    share = lambda rest: F.ceil(F.sum(F.when(rest, F.col("n_shingles")).otherwise(0)) / tile).cast("long")
    counts = placed.groupBy("region").agg(share(F.col("rest")).alias("first"), share(~F.col("rest")).alias("more")).where("first > 0")
    dealt = lookup(placed, "region", counts).where("first > 0")
    return dealt.selectExpr("doc_id", "region", "if(rest, pmod(xxhash64(doc_id), first), first + pmod(xxhash64(doc_id), more)) AS tile", "if(rest, first + more, first) AS meets")


_COUNTED = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())])
_SHARED = T.StructType([T.StructField(n, T.LongType()) for n in ("shingle", "rep", "component")])


def _each_set(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of a batch's texts."""
    data, offsets = A.text_bytes(b.column("text"))
    for i, j in A.row_pieces(offsets):
        flat, at = A.shingle_sets(A.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1], A.BLANKS), WORDS)
        for k in range(i, j):
            yield k, flat[at[k - i] : at[k - i + 1]]


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> A.U(20)).astype(np.int64) & (SKETCH - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(SKETCH, np.int64)
    for b in batches:
        for _, own in _each_set(b):
            count += np.bincount(_slot(own), minlength=SKETCH) if len(own) > SKETCH // 8 else 0
            if len(own) <= SKETCH // 8:
                np.add.at(count, _slot(own), 1)
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at])], _COUNTED.names)


def rarest(own: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, by count and then value: as many as any set of that similarity has to share one of."""
    most = len(own) - -(-percent * len(own) // 100) + 1
    return own[np.lexsort((own, count[_slot(own)]))[:most]]


def _rest(own: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """(doc_id, region): the classes of `left` (rep, component) that may have links between components, by prefix filter."""
    texts = materialise(own.join(left.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), "doc_id"))
    count = np.zeros(SKETCH, np.int64)
    few = texts.coalesce(parts_for(texts.agg(F.sum(F.octet_length("text"))).first()[0], COUNTED_BYTES))
    sketch = few.mapInArrow(_count, _COUNTED).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SKETCH rows at most
    count[sketch["slot"].to_numpy()] = sketch["n"].to_numpy()
    sent = own.sparkSession.sparkContext.broadcast(count)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, component = b.column("doc_id").to_numpy(), b.column("component").to_numpy()
            for k, own in _each_set(b):
                s = rarest(own, sent.value, percent).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), rep[k])), pa.array(np.full(len(s), component[k]))], _SHARED.names)

    shared = materialise(texts.mapInArrow(first, _SHARED))
    open_ = shared.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("rep").alias("least")).where("low <> high").select("shingle", "least")
    stars = lookup(shared.select("shingle", "rep"), "shingle", open_).where("least IS NOT NULL").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    return components(stars).toDF("doc_id", "region")


def near_duplicates(docs: DataFrame, *, text: str = "text", percent: int = PERCENT, small: int = SMALL, tile: int = TILE) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Texts are split at ASCII blanks, A-Z lower-cased; a text of fewer than five words is one shingle. Null, empty and
    blank texts have no shingles and stand alone. A null doc_id is smaller than any other. Rows that repeat a doc_id are
    one document. A text of any length is one set, of eight bytes a shingle in the tasks that confirm it. Other columns, whatever
    their names, are not read. An empty table gives no rows.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text"))
    scanned = materialise(_scan(own))
    classes = materialise(
        scanned.where("n_shingles > 0")
        .groupBy("d1", "d2")
        .agg(F.min(F.struct("doc_id", "n_shingles", "prefixes", "deeper")).alias("s"))
        .select("d1", "d2", F.col("s.doc_id").alias("rep"), "s.n_shingles", "s.prefixes", "s.deeper")
    )
    sizes = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.sum("n_shingles").alias("n_shingles"))
    places = materialise(_forest(classes, small))

    # small regions, merged where they share classes
    regions = components(places.where("depth = 0").select(F.col("rep").alias("a"), F.col("region").alias("b"))).toDF("doc_id", "region")
    sized = regions.join(sizes, "doc_id")
    total = sized.groupBy("region").agg(F.sum("n_shingles").alias("total"))
    tiles = F.ceil(F.col("total") / tile).cast("long")
    members = lookup(sized, "region", total).select("doc_id", "region", "n_shingles", F.pmod(F.xxhash64("doc_id"), tiles).alias("tile"), F.when(tiles == 1, 0).otherwise(tiles).alias("meets"))
    # regions that were cut: each class's two deepest parts; of equal ones those that most of its like choose, too
    dense = places.where("depth > 0")
    crowded = dense.groupBy("region").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("region", F.lit(True).alias("crowded"))
    dense = materialise(lookup(dense, "region", crowded).where("crowded").drop("crowded"))
    chosen = dense.where("part IS NOT NULL").groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("depth")).alias("d"), "region", "part"))), 1, 2).alias("best"))
    homes = chosen.select(F.col("rep").alias("doc_id"), F.explode("best.part").alias("region")).join(sizes, "doc_id")
    candidates = materialise(members.unionByName(homes.selectExpr("doc_id", "region", "n_shingles", "0L AS tile", "0L AS meets")))
    bins = parts_for(candidates.where("meets = 0").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0], tile)

    def links(part: DataFrame) -> DataFrame:
        rows = own.join(part.select("doc_id", "region", "tile", "meets").hint("shuffle_hash"), "doc_id")
        rows = rows.select(F.col("doc_id").alias("rep"), "text", "region", "tile", "meets", F.pmod(F.xxhash64("region", F.lit(1)), F.lit(bins)).alias("bin"))
        return _sets(rows).groupBy("bin", "i", "j").applyInArrow(_confirm(percent), "a long, b long")

    edges = links(candidates)
    if not dense.isEmpty():
        edges = materialise(edges)
        groups = components(edges)
        placed = materialise(dense.select("region", "rep").distinct().join(groups.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
        mixed = placed.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("region", F.lit(True).alias("mixed"))
        left = materialise(lookup(placed, "region", mixed).where("mixed").select("rep", "component").distinct())
        if not left.isEmpty():
            rest = materialise(_rest(own, left, percent).join(sizes, "doc_id"))
            edges = edges.union(links(_unsettled(rest, groups, tile)))
    groups = components(edges)
    named = classes.select("d1", "d2", "rep").join(groups.toDF("rep", "component"), "rep", "left").select("d1", F.struct("d2", F.coalesce("component", "rep").alias("component")).alias("named"))
    return _named(scanned.select("doc_id", "n_shingles", "d1", "d2"), named)


def _named(scanned: DataFrame, named: DataFrame) -> DataFrame:
    """The documents' components, from their classes'. Texts without shingles need no look, and hot classes don't travel."""
    empty = scanned.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # two classes may have one half of the digest: both are listed under it
    listed = named.groupBy("d1").agg(F.collect_list("named").alias("named"))
    some = lookup(scanned.where("n_shingles > 0"), "d1", listed)
    some = some.select("doc_id", "n_shingles", F.expr("filter(named, x -> x.d2 = d2)[0].component").alias("component_id"))
    back = lambda c: F.nullif(F.col(c), F.lit(NULL_ID)).alias(c)
    return some.union(empty).select(back("doc_id"), "n_shingles", back("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one_each(docs: DataFrame, **options) -> DataFrame:
    """docs with the smallest document of every group; columns as they were, whatever their names. Null, empty and blank
    texts stay. Rows that repeat a kept doc_id all stay. An empty table gives none."""
    kept = materialise(near_duplicates(docs.select("doc_id", "text"), **options).where("kept").select(F.col("doc_id").alias("kept_id")).distinct())
    return docs.join(kept.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]), "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
