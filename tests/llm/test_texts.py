"""Decontamination, fingerprints, token counts, packing."""

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest

from arbora.llm import decontaminate, fingerprint, packing, tokencount

ITEMS = [(1, "One two"), (2, None), (None, "lost"), (3, " . "), (3, "one two")]


@pytest.fixture(scope="module")
def items(rows):
    long = max((t for _, t in rows if t and len(t) < 5000), key=len)
    return [*ITEMS, (None, long[500:620]), (10, long[:400]), (2, long[100:300].upper()), (11, "x" * 3000)]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 60}])
def test_decontaminate(spark, docs, rows, items, options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.hit_words, r.items) for r in decontaminate.decontaminate(docs, bench, **options).collect()}
    assert found == brute.decontaminate(rows, items) and any(h for _, h, _ in found.values())


def test_decontaminate_query(spark, sf_dir, real_rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for r in decontaminate.query(spark, sf_dir).collect():
        n, hit, held = brute.decontaminate([x for x in real_rows if x[0] == r.doc_id], items)[r.doc_id] if r.doc_id % 7 == 0 else (None, None, None)
        if n is not None:
            assert (r.n_words, r.n_hit, r.n_items) == (n, len(hit), len(held)) and r.items_sha256 == hashlib.sha256(",".join(held).encode()).hexdigest()
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)


def test_decontaminate_odd_tables(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.decontaminate(empty, bench).collect() == []
    assert {tuple(r.items) for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {()}
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.schema == docs.schema and {1003, 1004} & {r.doc_id for r in left.collect()} == set()
    odd = spark.createDataFrame([(1, "one two " + "x " * 500, ["r"]), (2, "x " * 500, ["r"]), (2, None, None), (None, "", None)], "doc_id long, text string, hit_words array<string>")
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.schema == odd.schema and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 2]
    lost = spark.createDataFrame([(1, "it is lost")], "doc_id long, text string")
    assert [(r.hit_words, r.items) for r in decontaminate.decontaminate(lost, bench).collect()] == [([2], [])]


def test_decontaminate_large_vocabulary():
    """Terms times words of a run are beyond 32 bits."""
    import pyarrow as pa

    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(30_000):x}" for _ in range(n))
    items = [(i, text(rng.randrange(5, 40))) for i in range(1500)]
    rows = [(i, f"{text(700)} {items[i * 7][1]} {text(300)}") for i in range(200)]
    windows = decontaminate.Windows([str(i) for i, _ in items], pa.array([t for _, t in items]))
    counts, hits, held = decontaminate._annotate(pa.array([t for _, t in rows]), windows)
    assert len(windows.vocabulary) * int(counts.sum()) > 1 << 31
    assert {i: (int(counts[i]), hits[i], sorted(held[i])) for i, _ in rows} == brute.decontaminate(rows, items)


def test_windows_hold_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    texts = pa.array([" ".join(f"w{rng.randrange(50_000)}" for _ in range(40)) for _ in range(15_000)])
    tracemalloc.start()
    windows = decontaminate.Windows([str(i) for i in range(15_000)], texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(x) for x, _, _ in windows.by_length.values()) == 28 * 15_000 and peak < 70 * texts.nbytes


def test_proximity(spark):
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, "fox a b c d e quick"), (3, "quick"), (4, None), (5, "Fox, QUICK")], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.proximity(df, "quick fox", 3).collect()) == [1, 5]
    assert sorted(r.doc_id for r in decontaminate.proximity(df, "quick fox", 7).collect()) == [1, 2, 5]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2000}])
def test_fingerprints(docs, rows, options):
    found = fingerprint.fingerprints(docs, **options).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in rows)
    by_id, ids = dict(rows), sorted({i for i, _ in rows})
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    seen: dict = {}
    for r in found:
        text = by_id[r.doc_id] or ""
        assert r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        if sum(i == r.doc_id for i, _ in rows) == 1:
            q = len(text) // 4
            edited = text[: len(text) - q] + (by_id[after[r.doc_id]] or "")[:q]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.edited_fingerprint == fingerprint.text_of(fingerprint.chunk_sets([edited.encode()])[0])


def chunks_by_hand(text: bytes) -> dict[bytes, int]:
    """Distinct chunks with their lengths, byte by byte."""
    gear = fingerprint.GEAR.tolist()
    out, start = {}, 0
    for i in range(len(text)):
        n = i + 1 - start
        h = sum(gear[text[i - j]] << j for j in range(min(16, i + 1))) & 0xFFFFFFFF
        bits = 6 if n < fingerprint.NORMAL else 4
        if n == fingerprint.MOST or n >= fingerprint.LEAST and i >= 15 and h >> (32 - bits) == 0:
            out[text[start : i + 1]] = n
            start = i + 1
    return out | ({text[start:]: len(text) - start} if start < len(text) else {})


def likeness(a: dict, b: dict) -> float:
    return float(len(a) == len(b)) if not a or not b else sum(n for c, n in a.items() if c in b) / sum(a.values())


def test_likeness_by_hand(spark, real, real_rows):
    some = sorted(real_rows)[:40]
    found = {r.doc_id: r for r in fingerprint.fingerprints(real.where(real.doc_id <= some[-1][0])).collect()}
    texts = [(t or "")[:] for _, t in some]
    for k, (i, _) in enumerate(some):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        q = len(text) // 4
        own, new, nxt = (chunks_by_hand(t.encode()) for t in (text, text[: len(text) - q] + after[:q], after))
        r = found[i]
        lengths = sorted(int(r.fingerprint[s : s + 14], 16) & 0xFFF for s in range(0, len(r.fingerprint), 14))
        assert lengths == sorted(own.values()) and len({r.fingerprint[s : s + 14] for s in range(0, len(r.fingerprint), 14)}) == len(own)
        assert r.near_edited == pytest.approx(likeness(own, new)) and r.near_next == pytest.approx(likeness(own, nxt))


def test_texts_of_megabytes(spark):
    """A million characters without a blank, and as many with: counts and ids are the libraries'; memory stays bounded."""
    from arbora.llm import suffixdedup, toxicity

    rng = random.Random(8)
    solid, spaced = "".join(rng.choice("日本語文字列") for _ in range(300_000)), " ".join(rng.choice(["alpha", "beta", "gamma", "x1"]) for _ in range(200_000))
    df = spark.createDataFrame([(1, solid, 1), (2, spaced, 2), (3, spaced + " end", 3)], "doc_id long, text string, n_tokens int")
    c = tokencount.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    texts = {1: solid, 2: spaced, 3: spaced + " end"}
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(df).collect()} == {i: len(c.model.encode(t)) for i, t in texts.items()}
    packed = {}
    for r in packing.pack(df).collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == {i: len(ids.whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert {r.doc_id: r.n_words for r in decontaminate.decontaminate(df, df.limit(0).selectExpr("doc_id item_id", "text")).collect()} == {1: 1, 2: 200_000, 3: 200_001}
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixdedup.suffix_dedup(df.select("doc_id", "text")).collect()}
    assert removed[1][1] == removed[2][1] == 0 and removed[3] == (len(spaced) + 4, len(spaced))
    assert fingerprint.fingerprints(df).count() == 3 and toxicity.score(df, toxicity.train(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 2)), np.zeros(0), ("a", "b"))).count() == 3


def test_caches_are_bounded_in_bytes():
    c = tokencount.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    long = "日" * 20_000
    c.count(f"a {long} b"), ids.encode(f"a {long} b")
    assert long not in c and long not in ids and c.held < 1000 and ids.held < 1000


def test_fingerprints_find_likeness(spark, sf_dir, real_rows):
    found = fingerprint.query(spark, sf_dir).collect()
    assert len(found) == len(real_rows)
    long = [r for r in found if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > 0.65 and np.mean([r.near_next for r in long]) < 0.1


def test_chunks_resist_shifts():
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 123) for _ in range(20_000))
    a, b = fingerprint.chunk_sets([text, b"shifted " + text])
    assert fingerprint.containment(a, b) > 0.98
    own = fingerprint.chunk_sets([b"x" * 100, b"", text[:3], text])
    assert [len(x) > 0 for x in own] == [True, False, True, True] and np.array_equal(own[-1], a)
    assert fingerprint.containment(own[1], own[1]) == 1 and fingerprint.containment(own[1], a) == 0
    for n in (0, 1, 16, 17, 129, 5000):
        ends = fingerprint.cuts(n, [], [])
        assert (ends == [] if n == 0 else ends[-1] == n) and all(e - s <= fingerprint.MOST for s, e in zip([0, *ends], ends, strict=False))


def test_fingerprints_odd_tables(spark, empty):
    assert fingerprint.fingerprints(empty).collect() == []
    (r,) = fingerprint.fingerprints(spark.createDataFrame([(None, "abcd")], "doc_id long, text string")).collect()
    assert r.doc_id is None and r.edited_sha256 == hashlib.sha256(b"abca").hexdigest() and r.near_next == 1


def odd_texts(seed: int, pieces: list[str], n: int, most: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(most))) for _ in range(n)]


TEXTS = odd_texts(1, ["a", "the", " ", "  ", "\n", "é", "日本", "😀", ".", " the", " and", "\t", "x" * 30, "<s>", "▁", "\r\n", "\u00a0"], 600, 80)


@pytest.mark.parametrize("chunk, overlap", [(32_768, 256), (20, 4), (11, 2)])
def test_token_counts(chunk, overlap):
    c = tokencount.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert c.stable
    for t in [*TEXTS, "y" * 500 + " " + "word " * 100, ""]:
        assert c.count(t, chunk, overlap) == len(c.model.encode(t))


def test_token_count_operator(docs, rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {i: len(sp.encode(t or "")) for i, t in rows}
    found = tokencount.token_counts(docs, chunk=500, overlap=20).collect()
    assert {r.doc_id: r.n_tokens for r in found} == expected and len(found) == len(rows)
    assert tokencount.token_counts(empty).collect() == []


def test_token_count_query(spark, sf_dir, real_rows):
    for r in tokencount.query(spark, sf_dir).collect():
        assert r.n_bytes == len(dict(real_rows)[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 4096)


WORDS = ["a", "The", " ", "  ", "\n", "É", "日本", "😀", ".", " the.", " And,", "\t", "x" * 30, "<|endoftext|>", "it's ", "'S", "ﬁ", "ß", "İ", "Σας", "é", "e\u0301", "µ", "ª", "½", "1234", "\x1c", "\x85", "\u00a0", "-", "×"]


def test_ids_are_the_librarys():
    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    for t in odd_texts(3, WORDS, 800, 60):
        assert ids.encode(t) == np.array(ids.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("options", [{}, {"capacity": 64, "group_tokens": 500}])
def test_packing(docs, rows, empty, options):
    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    capacity = options.get("capacity", 4096)
    expected = {i: [*np.frombuffer(ids.encode(t or ""), "<u4").tolist(), 2] for i, t in rows}
    repeated = {i for i, _ in rows if sum(i == j for j, _ in rows) > 1}
    pieces, sequences = {}, {}
    for r in packing.pack(docs, **options).collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        part = expected[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(expected[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, x in pieces.items():
        covered = sum(n for _, n in x)
        assert covered == len(expected[i]) * (3 if i in repeated else 1)
    padding = 0
    for x in sequences.values():
        x.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and x[0][0] == 0
        size = x[-1][0] + x[-1][1]
        assert size <= capacity
        padding += 0 if size & (size - 1) == 0 else capacity - size
    assert set(pieces) == set(expected) and padding <= 0.02 * sum(map(len, expected.values()))
    assert packing.pack(empty).collect() == []


def test_fullest_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        left, lengths = packing.Remaining(), [rng.randrange(1, 30) for _ in range(rng.randrange(1, 10))]
        for n in lengths:
            left.add(n, n)
        picked = left.fullest(30)
        sums = {0}
        rest = sorted(lengths)[:-1]
        for n in rest:
            sums |= {s + n for s in sums}
        assert sum(picked) == max(lengths) + max(s for s in sums if s + max(lengths) <= 30)
        for n in picked:
            assert left.take(n) == n


def test_punctuation_behind_words_needs_no_whole_tokenizer():
    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    whole, asked = ids.whole, []

    class Watched:
        def encode(self, part, **options):
            asked.append(part)
            return whole.encode(part, **options)

    ids.whole = Watched()
    plain = "Straße&&& Straße... straße&&& été), ÉTÉ&&&"
    odd = "don't it's, 'tis x' ''s a&'s &'re, 12.5, ,, . naïve— é́, İ. ª; <|endoftext|>, a<|endoftext|> endoftext|> x\t,"
    for text, times in ((plain, {"&&&", "...", "),"}), (odd, None)):
        assert ids.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert times is None or (set(asked) == times and len(asked) == len(times))
