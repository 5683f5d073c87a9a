"""Suffix dedup and near duplicates against brute force."""

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from arbora.llm import neardup, suffixdedup
from arbora.llm.graphs import components, hot_keys, lookup


@pytest.mark.parametrize("options", [{}, {"block_bytes": 4000}, {"block_bytes": 4000, "hot_blocks": 1}])
def test_suffix_dedup(docs, rows, options):
    found = {}
    for r in suffixdedup.suffix_dedup(docs.drop("rest"), **options).collect():
        spans = [(r.spans[k], r.spans[k + 1]) for k in range(0, len(r.spans), 2)]
        assert sum(e - s for s, e in spans) == r.n_removed
        found.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()))
    assert {i: sorted(x) for i, x in found.items()} == brute.suffix_dedup(rows)


def test_suffix_dedup_of_very_hot_strings(docs, rows):
    """Without a single gathered string, all windows go one by one."""
    found = suffixdedup.suffix_dedup(docs.drop("rest"), block_bytes=4000, hot_blocks=0).select("doc_id", "n_removed", "n_spans").collect()
    expected = {i: sorted(x[1:3] for x in v) for i, v in brute.suffix_dedup(rows).items()}
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.n_removed, r.n_spans))
    assert {i: sorted(x) for i, x in got.items()} == expected


def test_hot_strings_are_sent_in_few_pieces():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(400)) for _ in range(20)]
    block = suffixdedup.Block(pa.table({"doc_id": pa.array(range(20), pa.int64()), "text": texts}), 3)
    marks = {b: bytes([2] * int((block.bucket == b).sum())) for b in range(3)}
    block.entries(marks)
    assert len(block.g) > 100 and len(block.wcontext) <= 4 * len(block.g)
    offsets = {}
    for c, a, z in zip(block.wcontext.tolist(), block.wlow.tolist(), block.whigh.tolist(), strict=True):
        offsets.setdefault(c, set()).update(range(a, z + 1))
    for c, (x, y) in enumerate(zip(block.left.tolist(), block.right.tolist(), strict=True)):  # every window is in a piece
        assert offsets.get(c, set()) == set(range(suffixdedup.SIDE - y, x + 1))


def test_suffix_query(spark, sf_dir, real_rows):
    found = {r.doc_id: [tuple(r)[1:]] for r in suffixdedup.query(spark, sf_dir).collect()}
    assert found == brute.suffix_dedup(real_rows)


def test_suffix_odd_tables(spark, empty):
    assert suffixdedup.suffix_dedup(empty.drop("rest")).collect() == []
    text = "ab" * 40
    odd = spark.createDataFrame([(None, text), (3, text), (3, text), (4, "z" + text[:49])], "doc_id long, text string")
    found = sorted((r.doc_id or -1, r.n_removed) for r in suffixdedup.suffix_dedup(odd).collect())
    assert found == [(-1, 0), (3, 80), (3, 80), (4, 0)]


def test_cut_texts_keeps_characters_and_columns(spark):
    shared = "é" * 40  # 80 bytes: an odd cut would split a character
    rows = [(1, "a" + shared, 41), (2, "bb" + shared + "c", 43), (3, shared, 40), (4, None, None), (5, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = {r.doc_id: r for r in suffixdedup.cut_texts(df).collect()}
    assert found[1].text == "a" + shared and found[2].text == "bbc" and found[2].n_chars == 3
    assert 3 not in found and found[4].text is None and found[5].text == ""
    assert suffixdedup.cut_texts(df).schema == df.schema


def test_mergesort_orders_suffixes():
    rng = np.random.default_rng(0)
    strings = rng.integers(97, 99, (300, 12)).astype(np.uint8)
    lengths = rng.integers(0, 13, 300)
    strings[np.arange(12) >= lengths[:, None]] = 0
    group = np.sort(rng.integers(0, 9, 300))
    o = suffixdedup.Order(group, strings, lengths)
    text = lambda i: bytes(strings[i, : lengths[i]])
    expected = sorted(range(300), key=lambda i: (group[i], text(i)))
    assert [(group[i], text(i)) for i in o.order] == [(group[i], text(i)) for i in expected]
    for k in range(1, 300):
        a, b = text(o.order[k - 1]), text(o.order[k])
        common = next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))
        assert o.common[k] == (common if group[o.order[k]] == group[o.order[k - 1]] else 0)


@pytest.mark.parametrize("options", [{}, {"tile": 50}, {"small": 2}, {"small": 3, "tile": 300}])
def test_near_duplicates(docs, rows, options):
    found = neardup.near_duplicates(docs, **options).collect()
    assert len(found) == len(rows)
    expected = brute.near_duplicates(rows)
    assert [r for r in found if (r.n_shingles, r.component_id, r.kept) != expected[r.doc_id]] == []


@pytest.mark.parametrize("options", [{"small": 8}, {"small": 2, "tile": 50}, {"small": 4, "tile": 300}, {"tile": 300}])
def test_near_duplicates_of_dense_regions_are_whole(spark, options):
    rng = random.Random(11)
    template = [f"w{k}" for k in range(44)]
    rows = []
    for i in range(150):  # one family: copies with up to two words changed, on both sides of 0.75
        words = list(template)
        for k in rng.sample(range(44), rng.randrange(3)):
            words[k] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    for i in range(80):  # pairs at exactly 0.75: 30 of 40 shingles shared
        words = [f"{i}w{k}" for k in range(39)]
        rows += [(1000 + 2 * i, " ".join(words)), (1001 + 2 * i, " ".join([*words[:20], "other", *words[21:]]))]
    for i in range(60):  # boilerplate with an own half: alike, but not enough
        rows.append((2000 + i, " ".join([*template[:30], *(f"o{i}x{k}" for k in range(20))])))
    expected = brute.near_duplicates(rows)
    assert all(expected[1001 + 2 * i][1] == 1000 + 2 * i for i in range(80)) and all(expected[2000 + i][2] for i in range(60))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == expected


def test_parts_follow_the_longest_common_prefix():
    deeper = np.sort(np.array([(1 << 32) + k // 3 for k in range(9)] + [(2 << 32) + 5] * 10 + [3 << 32, 4 << 32], np.uint64))
    found = list(neardup.parts(deeper, 4))
    assert found[:3] == [(0, 3, 5), (3, 6, 5), (6, 9, 5)] and found[-2:] == [(19, 20, 4), (20, 21, 4)]
    middle = found[3:-2]
    assert middle[0][0] == 9 and middle[-1][1] == 19 and all(e - s <= 4 and d == 5 for s, e, d in middle)
    assert all(a[1] - 1 == b[0] for a, b in zip(middle, middle[1:], strict=False))  # neighbours overlap
    assert list(neardup.parts(deeper, 64)) == [(0, 21, 3)]


def test_prefix_filter_never_parts_similar_sets():
    rng = np.random.default_rng(3)
    count = rng.integers(0, 50, neardup.SKETCH)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 60), dtype=np.uint64))
        keep = a[rng.random(len(a)) < rng.uniform(0.7, 1)]
        b = np.unique(np.append(keep, rng.integers(0, 1 << 62, rng.integers(0, 9), dtype=np.uint64)))
        shared = len(np.intersect1d(a, b))
        if shared and 100 * shared >= 75 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(neardup.rarest(a, count, 75), neardup.rarest(b, count, 75)))


def test_frequent_shingles_are_counted_once_not_in_every_task(spark, tmp_path, monkeypatch):
    """The sketch's rows are its slots, however many files the texts lie in."""
    line = " ".join(f"w{k}" for k in range(200))
    texts = [(i, f"{line} own {i} and {7 * i} words") for i in range(60)]
    slots = np.unique(np.concatenate([neardup._slot(own) for _, own in neardup._each_set(pa.RecordBatch.from_pydict({"text": [t for _, t in texts]}))]))
    original = neardup._count

    def noted(batches):
        for b in original(batches):
            with (tmp_path / "rows").open("a") as f:
                f.write(f"{b.num_rows}\n")
            yield b

    monkeypatch.setattr(neardup, "_count", noted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.createDataFrame([(i, i) for i, _ in texts], "rep long, component long")
        found = dict(neardup._rest(spark.createDataFrame(texts, "doc_id long, text string"), left, 75).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == dict.fromkeys(range(60), 0)
    assert sum(map(int, (tmp_path / "rows").read_text().split())) == len(slots)


def test_near_duplicate_query(spark, sf_dir, real_rows):
    found = {r.doc_id: tuple(r)[1:] for r in neardup.query(spark, sf_dir).collect()}
    assert found == brute.near_duplicates(real_rows)


def test_near_duplicate_odd_tables(spark, empty):
    assert neardup.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "A b c d e f"), (3, None), (None, None), (4, "x")], "doc_id long, text string")
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect()}
    assert found == {(None, 2): (None, True), (2, 2): (None, False), (3, 0): (3, True), (None, 0): (None, True), (4, 1): (4, True)}
    assert sorted(r.doc_id or 0 for r in neardup.keep_one_each(odd).collect()) == [0, 0, 3, 4]


def test_links_in_one_task():
    a = np.arange(100, dtype=np.uint64)
    assert neardup.linked([a, a[:75], a[:74], a + np.uint64(1000)]) == [0, 0, 0, 3]
    assert neardup.linked([a, a[:70]]) == [0, 1] and neardup.linked([a]) == [0]


@pytest.mark.parametrize("finish", [0, 5, 1000])
def test_components(spark, finish):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(i, 500) for i in range(200, 260)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long"), finish).collect())
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in [*range(200, 260), 500]}
    assert components(spark.createDataFrame([], "a long, b long"), finish).collect() == []


def test_lookup_of_hot_keys(spark):
    rows = [(5, i) for i in range(300)] + [(i, i) for i in range(90)] + [(None, 1)]
    table = spark.createDataFrame([(i, f"v{i}") for i in range(80)], "k long, v string")
    df = spark.createDataFrame(rows, "k long, x long")
    assert 5 in hot_keys(df, "k")
    assert sorted(map(tuple, lookup(df, "k", table).collect()), key=repr) == sorted(map(tuple, df.join(table, "k", "left").collect()), key=repr)


def test_colliding_contexts_are_told_apart(monkeypatch, spark):
    """Whatever the hashes of contexts are, results are the same."""
    rows = np.array([[1] * 8, [2] * 8, [1] * 8], np.uint8)
    number, first, least = suffixdedup._distinct(np.zeros(3, np.uint64), np.zeros(3, np.uint64), rows, np.array([7, 5, 3]))
    assert number.tolist() == [0, 1, 0] and least.tolist() == [3, 5] and (rows[first][number] == rows).all()
