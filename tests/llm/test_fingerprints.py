import hashlib

import numpy as np
from pyspark.sql import functions as F

from confab.llm import fingerprint, queries

from .helpers import WORD, docs, jaccard


def edited(text, after):
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def test_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op10_fingerprints(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    off = {"near_edited": [], "near_next": []}
    prints = {}
    for k, i in enumerate(order):
        after = texts[order[(k + 1) % len(order)]]
        e = edited(texts[i], after)
        assert got[i].n_chars == len(texts[i])
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        off["near_edited"].append(got[i].near_edited - jaccard(texts[i], e))
        off["near_next"].append(got[i].near_next - jaccard(texts[i], after))
        assert prints.setdefault(texts[i], got[i].fingerprint) == got[i].fingerprint
    for v in off.values():
        assert abs(np.mean(v)) < 0.02 and np.mean(np.abs(v)) < 0.05
    assert len(set(prints.values())) > 0.99 * len(prints)


def test_plan_is_native(spark, sf_dir):
    text = queries.op10_fingerprints(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def test_terms_and_weights(spark):
    df = spark.createDataFrame([("b a  b\tab a b",), ("",), (" \n ",), ("aa a aa aaa",)], "t string")
    got = [{x.t: x.w for x in r.x} for r in df.select(fingerprint.terms(F.col("t")).alias("x")).collect()]
    assert got == [{"a": 2, "ab": 1, "b": 3}, {}, {}, {"a": 1, "aa": 2, "aaa": 1}]


def test_collisions_estimate_weighted_similarity(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        for _ in range(20):
            n = int(rng.integers(100, 600))
            a = [f"w{rng.zipf(1.3) % 4000}" for _ in range(n)]
            b = [w if rng.random() < share else f"x{rng.zipf(1.3) % 4000}" for w in a]
            pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    near = [r.x for r in df.select(fingerprint.likeness(fingerprint.signature(F.col("a")), fingerprint.signature(F.col("b"))).alias("x")).collect()]
    off = np.array(near) - np.array([jaccard(a, b) for a, b in pairs])
    assert abs(off.mean()) < 0.02 and np.abs(off).max() < 0.2


def test_edge_cases(spark):
    rows = [(9, None), (8, ""), (7, "  "), (6, "a"), (5, "😀😀é x y z"), (4, "same text here"), (4, "same text here"), (None, "null id"), (1, "word " * 30000), (3, "only only only")]
    df = docs(spark, rows).withColumnRenamed("lang", "sig").withColumnRenamed("n_chars", "k")
    got = fingerprint.edited_fingerprints(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[9].fingerprint == by[8].fingerprint == by[7].fingerprint == "" and by[9].near_next == 1.0 and by[7].near_next == 0.0
    assert by[5].edited_sha256 == hashlib.sha256(edited(rows[4][1], rows[5][1]).encode()).hexdigest() and by[5].n_chars == 9
    assert by[None].edited_sha256 == hashlib.sha256(edited("null id", "").encode()).hexdigest()
    assert by[1].edited_sha256 == hashlib.sha256(edited("word " * 30000, "null id").encode()).hexdigest()
    assert len({r.fingerprint for r in got if r.doc_id == 4}) == 1
    alone = fingerprint.edited_fingerprints(docs(spark, [(3, "one two three four five six")])).first()
    assert alone.near_next == 1.0
    assert fingerprint.edited_fingerprints(df.limit(0)).collect() == []


def test_ranges_do_not_change_neighbours(spark):
    df = docs(spark, [((k * 7919) % 1000, f"text {k}") for k in range(300)])
    a, b = (sorted((r.doc_id, r.text, r.next_text) for r in fingerprint.neighbours(df, ranges=n).select("doc_id", "text", "next_text").collect()) for n in (2, 64))
    assert a == b and len(a) == 300
    order = sorted(((k * 7919) % 1000, f"text {k}") for k in range(300))[::-1]
    assert {(i, t): n for i, t, n in a} == {x: order[(k + 1) % 300][1] for k, x in enumerate(order)}


def test_rows_of_one_id_are_parted(spark):
    """A third of the rows share an id and a third have none; the ranges follow the hash of their texts."""
    df = docs(spark, [(None if k % 3 == 0 else 500 if k % 3 == 1 else k, f"text {k}") for k in range(900)])
    rows = df.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"), "text")
    order = sorted(rows.collect(), key=lambda r: (-r.d, r.h))
    got = {r.text: r.next_text for r in fingerprint.neighbours(df, ranges=30).select("text", "next_text").collect()}
    assert got == {r.text: order[(k + 1) % 900].text for k, r in enumerate(order)}
    bounds, number = fingerprint._bounds(rows.select("d"), 30)
    most = rows.groupBy(fingerprint._range(bounds, F.col("d"), F.col("h")).alias("k")).count().agg(F.max("count")).first()[0]
    assert number == 900 and most < 120


def test_words_of_any_script():
    assert WORD.findall("a\x0bb\x85c\u00a0d") == ["a", "b\x85c\u00a0d"]
