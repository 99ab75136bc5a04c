import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from confab.llm import quality
from confab.llm.common import bounded_sample, stored
from pyspark.sql import functions as F

from .helpers import SCHEMA, WORD, components, docs, repeats


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage over the table of a thousand documents."""
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = [df.collect()]
    for _, stage in corpus_pipeline.STAGES:
        df = stored(stage(spark, df, sf))
        out.append(df.collect())
    return out


def test_quality_stage(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    forest = quality.train(df, labels)
    want = {r.doc_id for r in stages[0] if forest.score(__import__("numpy").array([quality.statistics(r.text)]))[0] >= 0.5}
    assert {r.doc_id for r in stages[1]} == want and 0.7 * len(stages[0]) < len(want) < len(stages[0])


def test_near_dedup_stage(stages):
    want = components({r.doc_id: r.text for r in stages[1]}, 5)
    assert {r.doc_id for r in stages[2]} == set(want.values()) and len(stages[2]) < len(stages[1])


def test_suffix_stage(stages):
    texts = {r.doc_id: r.text for r in stages[2]}
    gone = {}
    for i, s, e, first, _ in repeats(texts):
        if not first:
            gone.setdefault(i, set()).update(range(s, e))
    want = {i: [w for k, w in enumerate(WORD.findall(t)) if k not in gone.get(i, ())] for i, t in texts.items()}
    assert {r.doc_id: WORD.findall(r.text) for r in stages[3]} == {i: w for i, w in want.items() if w}
    assert all(r.n_chars == len(r.text) for r in stages[3])
    assert not repeats({r.doc_id: r.text for r in stages[3]}) or gone


def test_mixing_stage(stages):
    size = lambda r: len(WORD.findall(r.text))
    before, after = Counter(), Counter()
    for r in stages[3]:
        before[r.source] += size(r)
    for r in stages[4]:
        after[r.source] += size(r)
    assert max(Counter(r.doc_id for r in stages[4]).values()) <= 3
    assert abs(sum(after.values()) - sum(before.values())) < 0.02 * sum(before.values())


def test_last_stage(stages):
    texts = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[4])
    assert Counter((r.doc_id, r.decoded_sha256) for r in stages[5]) == texts
    assert all(len(r.ids) == r.n_tokens for r in stages[5])


def test_columns(stages):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(s[0].asDict()) == names for s in stages[:5])


def test_empty_and_odd_documents(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "no id here"), (3, "a b c d e f g " * 20), (3, "a b c d e f g " * 20), (3, "another text of this id " * 20), (4, "long text " * 30000), (5, " " * 1_200_000 + "end"), (6, " \n")]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for k, data in enumerate((rows, [])):
        df = docs(spark, data, schema=SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            df = stored(stage(spark, df, str(tmp_path)))
        assert df.count() == (0 if k else df.where("n_tokens > 0").count())


def test_extra_columns_with_clashing_names(spark, tmp_path):
    spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = docs(spark, [(k, f"good words number {k} here and there " * 9 if k % 2 else "bad!! " * 40) for k in range(60)])
    for name in ("i", "t", "y", "size", "u", "q", "copies", "target", "share", "sig", "kept", "key", "rep", "comp", "start", "first", "text_hash", "l_id", "whole_row"):
        df = df.withColumn(name, F.lit("x"))
    columns = df.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stored(stage(spark, df, str(tmp_path)))
        assert df.columns == columns or k == 4
    assert df.count() > 0


def test_samples_keep_their_bound(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7 + 1).alias("w"), (F.col("id") % 2).alias("g"))
    got = bounded_sample(df, F.col("id"), F.col("w"), 900, by="g").groupBy("g").agg(F.sum("w").alias("s")).collect()
    assert len(got) == 2 and all(700 < r.s <= 900 for r in got)
    assert bounded_sample(df, F.col("id"), F.col("w"), 10**9).count() == 5000
    assert bounded_sample(df.where("id < 1"), F.col("id"), F.lit(10), 5).count() == 0


def test_bounded_samples_are_full_at_every_size(spark):
    # no bucket of the first level is within the bound: about 98, 49 and 49 rows each
    df = spark.range(400_000).withColumn("g", F.col("id") % 2)
    assert 47 <= bounded_sample(df, F.col("id"), F.lit(1), 50).count() <= 50
    got = [r["count"] for r in bounded_sample(df, F.col("id"), F.lit(1), 20, by="g").groupBy("g").count().collect()]
    assert len(got) == 2 and all(19 <= n <= 20 for n in got)
    # copies of one key that exceed the bound and come first are passed over
    h = F.shiftrightunsigned(F.xxhash64("id"), 1)
    first = spark.range(1000).orderBy(h).first().id
    hot = spark.range(1000).union(spark.range(3000).select(F.lit(first)))
    assert 30 <= bounded_sample(hot, F.col("id"), F.lit(1), 50).count() <= 50
    copies = spark.range(400_000).withColumn("id", F.lit(3))
    assert bounded_sample(copies, F.col("id"), F.lit(1), 50).count() == 0
