"""URL filter, licence scan, toxicity, sharding, the pipeline, and how it all hangs together."""

import os
import random
import re
import subprocess
import sys
import textwrap
import zlib
from collections import Counter

import brute
import numpy as np
import oracle
import pytest

from arbora.llm import licensescan, queries, sharding, toxicity, urlfilter
from arbora.llm.licences import GRANTS, NAMES, TEXTS


def test_url_query(spark, sf_dir):
    assert oracle.spark_rows(urlfilter.query(spark, sf_dir)) == oracle.duck_rows(oracle.connect(sf_dir), urlfilter.ORACLE_SQL)


def test_url_cases(spark):
    cases = [
        (1, "http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        (3, "https://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
        (4, "x://notexample.net/es/1", "notexample.net", "/es/1", "net/es/", "block"),
        (5, "http://example.com", "example.com", "", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "example.com/en/", "", "", None, "allow"),
        (8, "a://b://c.com/", "b:", "//c.com/", None, "allow"),
        (9, "http://site.org/login.php", "site.org", "/login.php", None, "block"),
        (10, "http://host.com:80/fr/", "host.com:80", "/fr/", None, "allow"),
        (11, "http://host?x=/en/", "host", "", None, "allow"),
        (11, "http://host?x=/en/", "host", "", None, "allow"),
        (12, "", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u, *_ in cases], "page_id long, url string, host string, rule string")
    found = sorted(map(tuple, urlfilter.judge(pages, urlfilter.rules_of(spark)).collect()), key=repr)
    assert found == sorted(((i, *x) for i, _, *x in cases), key=repr)
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_of(spark)).collect() == []
    with pytest.raises(ValueError):
        urlfilter.judge(pages, urlfilter.rule_table(spark, [urlfilter.pattern_rule("bare", ".", (), "block")]))


def test_licence_classifier_on_held_out_paragraphs():
    m = licensescan.model()
    assert m["accuracy"] > 0.85 and (m["weights"] != 0).mean() < 0.3
    shown, held = licensescan.examples(np.random.default_rng(1))
    sure = [(f, found) for own, f in held if f != licensescan.UNKNOWN and (found := decide(m, own))]
    assert len(sure) > 0.8 * sum(f != licensescan.UNKNOWN for _, f in held)
    assert sum(f == found for f, found in sure) > 0.97 * len(sure)  # families are hardly ever confused
    foreign = [decide(m, licensescan.grams(g.format(n))) for n in ("Affero Highway License", "Quokka Public License 3", "General Motors License 2.0", "Public Software Foundation License 1.0") for g in GRANTS]
    assert sum(map(bool, foreign)) <= 0.1 * len(foreign)


def decide(m, own) -> str | None:
    """By the weights, without the operator's SQL."""
    at = {g: i for i, g in enumerate(m["grams"])}
    z = m["weights"][-1] + sum(m["weights"][at[g]] for g in own if g in at)
    p = np.exp(z - z.max())
    family, share = m["classes"][int(np.argmax(p))], p.max() / p.sum()
    sure = [t for t in ([*NAMES[family], licensescan.spdx(family), *TEXTS.get(family, ())] if family in NAMES else []) if len(own & licensescan.grams(t)) >= 0.8 * len(licensescan.grams(t)) - 1e-9]
    return family if share >= 0.5 and sure else None


def families(m, text: str | None) -> tuple[str, int]:
    """(families, paragraphs) of a document, by hand."""
    found = []
    for block in re.split(r"\n(?:[^\w\n]*\n)+", text or ""):
        own = [f for f in (decide(m, licensescan.grams(line)) for line in block.split("\n")) if f]
        f = decide(m, licensescan.grams(block)) if "\n" in block else None
        found += own + ([f] if f and f not in own else [])
    return ",".join(sorted(set(found))), len(found)


def test_licence_query(spark, sf_dir, real_rows):
    m = licensescan.model()
    expected = {i: families(m, t)[0] for i, t in real_rows if "licen" in (t or "").lower()}
    found = {r.doc_id: r.families for r in licensescan.query(spark, sf_dir).collect()}
    assert {i: f for i, f in found.items() if f} == {i: f for i, f in expected.items() if f} and any(found.values())


def test_licences_odd_tables(spark, docs, rows, empty):
    assert licensescan.scan(empty).collect() == []
    assert {r.families for r in licensescan.scan(docs).collect()} == {""} and licensescan.scan(docs).count() == len({i for i, _ in rows})
    odd = spark.createDataFrame([(None, "Released under the MIT License.", 1), (1, None, 2), (1, "a\n\nlicensed under cc by-nc 4.0\nReleased under the MIT License.", 3)], "doc_id long, text string, families int")
    assert {r.doc_id: (r.families, r.n_paragraphs) for r in licensescan.scan(odd).collect()} == {None: ("mit", 1), 1: ("cc-by-nc-4.0,mit", 2)}
    long = spark.createDataFrame([(1, "word " * 400_000 + "\nReleased under the MIT Licence.\n" + "word\n" * 200_000)], "doc_id long, text string")
    assert [r.families for r in licensescan.scan(long).collect()] == ["mit"]


def test_licence_cases(spark):
    m = licensescan.model()
    wrapped = "Copyright (c) 2020 A. Author\n\n" + "\n".join(textwrap.wrap(TEXTS["mit"][0], 60)) + "\n\n" + TEXTS["mit"][1]
    comment = "/*\n * Words.\n *\n" + "\n".join(f" * {x}" for x in textwrap.wrap(TEXTS["gpl-3.0"][0], 50)) + "\n *\n */\nint x;"
    cases = {
        "Distributed under the terms of the GNU GPL, version 3.": "gpl-3.0",
        "Released under CC BY 4.0.": "cc-by-4.0",
        "This project is distributed under Apache 2.0.": "apache-2.0",
        "This file is licensed under the ISC license.": "isc",
        "Licensed under the GNU Affero General Public License, version 3.": "agpl-3.0",
        "SPDX-License-Identifier: MIT": "mit",
        TEXTS["mit"][2]: "mit",
        wrapped: "mit",
        comment: "gpl-3.0",
        "She drove to the coast.": "",
        "Licensed under the Quokka Public License 3.": "",
        "He lost his driving licence in the spring.": "",
        "Released under the MIT License.\nand more of it": "mit",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id: (r.families, r.n_paragraphs) for r in licensescan.scan(df).collect()}
    assert {i: f for i, (f, _) in found.items()} == dict(enumerate(cases.values()))
    assert found == {i: families(m, t) for i, t in enumerate(cases)}


def test_key_words_exclude_nothing_confirmable():
    keys, strings, rng = licensescan.key_words(), licensescan.key_strings(), random.Random(5)
    for t in (t for f in NAMES for t in [*NAMES[f], licensescan.spdx(f), *TEXTS.get(f, ())]):
        own = licensescan.grams(t)
        for _ in range(300):
            text = " ".join(w for w in licensescan.words(t) if rng.random() < 0.9)
            short = len(own & licensescan.grams(text)) < licensescan.needed(own)
            assert short or any({*k} <= {*text.split()} for k in keys) and all(any(all(w in t for w in k) for k in strings) for t in (text, text.replace("license", "licence")))
    assert not any(all(w in "she drove to the coast and came by again" for w in k) for k in strings)


def test_toxicity_scores_by_hand(spark, docs, rows, sf_dir):
    """Probabilities recomputed word by word from the chain's coefficients."""
    from arbora.llm import arrays

    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = toxicity.fit(real, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    number = lambda w: int(arrays.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), arrays.ALNUM).hash[0])
    found = toxicity.score(docs.withColumn("flagged", docs.text), chain).collect()
    assert len(found) == len(rows)
    for r in found:
        own, odds = {number(w) for w in brute.ALNUM.findall((r.text or "").translate(brute.LOWER))}, []
        for link in chain.links:
            n = len(link.words)
            z = sum(c for w, c in zip(link.words.tolist(), link.coefficients[:n], strict=True) if w in own) + sum(a * b for a, b in zip(odds, link.coefficients[n:-1], strict=True)) + link.coefficients[-1]
            odds.append(min(30, max(-30, z)))
        p = [1 / (1 + np.exp(-z)) for z in odds]
        assert np.allclose([r.p_quality, r.p_toxic], p) and r.flagged == bool(own and p[-1] >= chain.threshold)


def test_conflicting_labels_have_a_rule(spark, real):
    ids = [r.doc_id for r in real.select("doc_id").limit(60).collect()]
    labels = [(i, 1, k % 2) for k, i in enumerate(ids)]
    a = toxicity.fit(real, spark.createDataFrame(labels + [(ids[0], 0, 1)], "doc_id long, quality int, toxic int"))
    b = toxicity.fit(real, spark.createDataFrame([(ids[0], 0, 1), *labels][::-1], "doc_id long, quality int, toxic int"))
    c = toxicity.fit(real, spark.createDataFrame([(ids[0], 1, 1), *labels[1:]], "doc_id long, quality int, toxic int"))
    assert all(np.array_equal(x.coefficients, y.coefficients) and np.array_equal(x.coefficients, z.coefficients) for x, y, z in zip(a.links, b.links, c.links, strict=True))


def test_toxicity_on_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    chain = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"), sample=1000)
    held = toxicity.score(docs.where("doc_id % 4 = 0").select("doc_id", "text"), chain).join(labels, "doc_id").select("toxic", "flagged").toPandas()
    hit = ((held.toxic == 1) & held.flagged).sum()
    assert hit / (held.toxic == 1).sum() > 0.85 and hit / held.flagged.sum() > 0.85
    assert chain.categories == ("quality", "toxic") and len(chain.links[1].coefficients) == len(chain.links[1].words) + 2


def test_toxicity_odd_tables(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, none)
    found = toxicity.score(docs, chain).collect()
    assert len(found) == len(rows) and not any(r.flagged for r in found)
    one = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (3, 1, 0), (None, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int")
    assert not any(r.flagged for r in toxicity.score(docs, toxicity.fit(docs, one)).collect())
    assert toxicity.score(empty, chain).collect() == [] and toxicity.fit(empty, one).threshold > 1
    assert toxicity.drop_toxic(docs, one).schema == docs.schema and toxicity.drop_toxic(docs, one).count() == len(rows)


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(1)
    n = 400
    first = rng.integers(0, 2, n)
    noise = rng.random(n) < 0.1
    word = np.array([10, 20, 30], np.uint64)
    doc, words = [], []
    for i in range(n):
        doc.append(i)
        words.append(word[first[i]])
        if noise[i]:
            doc.append(i)
            words.append(word[2])
    labels = np.stack([first, first ^ noise], axis=1)
    chain = toxicity.train(np.array(words, np.uint64), np.array(doc), labels, np.ones(n), ("a", "b"))
    assert ((chain.out_of_fold["a"] > 0.5) == first).mean() > 0.99
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.1]), np.array([1, 1, 0]), np.ones(3)) == pytest.approx(0.45)


def test_hilbert_curve_is_continuous(spark):
    for n in (2, 3):
        cells = spark.range(16**n).selectExpr("id", *(f"shiftright(id, {4 * k}) & 15 AS a{k}" for k in range(n)))
        found = [r.id for r in sharding.with_curve(cells, [f"a{k}" for k in range(n)]).orderBy("curve").collect()]
        assert sorted(found) == list(range(16**n))
        assert all(sum(abs((a >> 4 * k & 15) - (b >> 4 * k & 15)) for k in range(n)) == 1 for a, b in zip(found, found[1:], strict=False))


def test_shards(spark, docs, rows, empty, sf_dir, real_rows):
    found = sharding.hilbert_shards(docs, 7).collect()
    count = Counter(r.shard for r in found)
    assert len(found) == len(rows) and set(count) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(count[s]))
    by_id = dict(rows)
    assert all(r["size"] == len((by_id[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((by_id[r.doc_id] or "").encode()) for r in found)
    assert sharding.hilbert_shards(empty).collect() == []
    assert sharding.hilbert_shards(spark.createDataFrame([(None, None)], "doc_id long, text string")).first().slot == 0
    many = sharding.query(spark, sf_dir).collect()
    assert len(many) == len(real_rows) and {r.law for r in many} == {"rows"} and all(r.grown_shard is None for r in many)


def test_shards_follow_the_curve(spark, real, real_rows):
    """Levels, order, shards and slots, by hand; the curve's own order is tested above."""
    found = sharding.hilbert_shards(real.withColumn("shard", real.doc_id).withColumn("size", real.doc_id), 7).toPandas()
    meta = {r.doc_id: (r.text, r.lang, r.source) for r in real.select("doc_id", "text", "lang", "source").collect()}
    low, high = min(meta), max(meta)
    names = lambda v: zlib.crc32((v or "").encode()) % 16
    for r in found.itertuples():
        text, lang, source = meta[r.doc_id]
        assert r.id_level == min(15, int((r.doc_id - low) / (high - low) * 16)) and (r.lang_level, r.source_level) == (names(lang), names(source))
        assert r.size_level == min(15, max(0, int((np.log2(len((text or "").encode()) + 8) - 3) / 24 * 16)))
    ordered = found.sort_values(["curve", "text_crc32", "doc_id"])
    n = len(ordered)
    assert [r.shard for r in ordered.itertuples()] == [k * 7 // n for k in range(n)]
    assert [r.slot for r in ordered.itertuples()] == [k - -(-(k * 7 // n) * n // 7) for k in range(n)]


def test_written_shards_prune(spark, tmp_path, real):
    import pyarrow.parquet as pq

    sharding.write_shards(real, str(tmp_path / "s"), 4, file_rows=20)
    assert spark.read.parquet(str(tmp_path / "s")).drop("shard").exceptAll(real).isEmpty()
    groups = [g for f in (tmp_path / "s").rglob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in [m.row_group(k) for k in range(m.num_row_groups)]]
    at = pq.ParquetFile(next((tmp_path / "s").rglob("*.parquet"))).schema_arrow.get_field_index("doc_id")
    top = real.agg({"doc_id": "max"}).first()[0]
    read = sum(g.column(at).statistics.min <= top // 4 for g in groups)
    assert len(groups) >= 8 and read <= 0.75 * len(groups)  # a filter on a quarter of the ids skips files


def test_pipeline(spark, sf_dir, real, real_rows):
    import corpus_pipeline as p

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, kept = real, {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema == real.schema
        docs = spark.createDataFrame(out.toPandas(), real.schema)  # stored, as the driver does
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    texts = dict(real_rows)
    flagged = {r.doc_id for r in toxicity.score(real, toxicity.fit(real, labels)).where("flagged").collect()}
    assert set(kept["toxicity"]) == set(texts) - flagged and flagged
    groups = brute.near_duplicates(sorted(kept["toxicity"].items()))
    assert set(kept["near_duplicates"]) == {i for i, g in groups.items() if g[2]}
    cut = brute.suffix_dedup(sorted(kept["near_duplicates"].items()))
    for i, t in kept["suffix_dedup"].items():
        (n, removed, *_), = cut[i]
        assert n - removed <= len(t.encode()) <= n - removed + 8 * cut[i][0][2]  # whole characters stay
    assert {i for i, x in cut.items() if x[0][0] > x[0][1]} >= set(kept["suffix_dedup"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = brute.decontaminate(sorted(kept["suffix_dedup"].items()), items)
    assert set(kept["decontamination"]) == {i for i, (_, hit, _) in judged.items() if not hit}
    packed = p.run(spark, sf_dir)
    assert len(kept["decontamination"]) < len(kept["suffix_dedup"])
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["decontamination"])


def test_pipeline_stages_on_odd_tables(spark, sf_dir, docs, rows):
    """Every stage keeps clashing columns, nulls and empty texts, and takes an empty table."""
    import corpus_pipeline as p

    odd = docs.withColumn("flagged", docs.doc_id).withColumn("hit_words", docs.text).withColumn("row", docs.text).withColumn("kept_id", docs.doc_id)
    for name, stage in p.STAGES:
        out = stage(spark, odd, sf_dir)
        kept, schema = {r.doc_id for r in out.collect()}, out.schema  # read before the next stage begins
        none = stage(spark, odd.limit(0), sf_dir)
        assert none.schema == schema and none.collect() == []
        if name != "packing":
            assert schema == odd.schema and {1000, 1001} <= kept, name
        else:
            assert kept == {i for i, _ in rows}


def test_names():
    names = [n.split("_")[0] for n in queries.queries()]
    assert names == [f"op{i}" for i in range(1, 11)] and set(queries.oracle_sql()) <= set(queries.queries())


def test_entry_works_without_the_subpackage(tmp_path):
    """The rest imports and registers its queries where this subpackage and the pipeline are gone."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "arbora", tmp_path / "arbora", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'graph_q1' in q and not any(n.startswith('op1') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op4_decontaminate", "op6_minhash_neardup"])
def test_oracles(spark, sf_dir, name):
    assert oracle.spark_rows(queries.queries()[name](spark, sf_dir)) == oracle.duck_rows(oracle.connect(sf_dir), queries.oracle_sql()[name])
