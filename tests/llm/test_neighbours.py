import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from confab.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def brute(rows, k=20, asks=lambda i: i % 20 == 0):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, v in rows:
        if asks(i):
            near = sorted((-float(sum(a * b for a, b in zip(v, w, strict=True))), j) for j, w in rows if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_recall_over_the_table(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_nearest(spark, sf).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and (np.diff(own.score) <= 0).all() and ids[q] not in own.vec_id.tolist()
        assert np.allclose(own.score, x[[np.flatnonzero(ids == j)[0] for j in own.vec_id]] @ x[q], atol=1e-12)
        hit += len(set(ids[np.argsort(-s)[:20]]) & set(own.vec_id))
    assert hit / (20 * (ids % 20 == 0).sum()) >= 0.95


@pytest.mark.parametrize("norms", [False, True])
def test_blocks_and_norms(spark, norms, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 100)
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    monkeypatch.setattr(neighbours, "BATCH", 16)
    monkeypatch.setattr(neighbours, "FIT_ROWS", 500)
    monkeypatch.setattr(neighbours, "LEAST_PIVOTS", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    v = centres[rng.integers(0, 8, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    v = v / np.linalg.norm(v, axis=1)[:, None] * (rng.lognormal(0, 0.4, 1500)[:, None] if norms else 1)
    rows = list(enumerate(v.tolist()))
    got = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).toPandas()
    want = brute(rows)
    hit = np.mean([len({j for j, _ in want[i]} & set(g.vec_id)) / 20 for i, g in got.groupby("query_id")])
    assert set(got.query_id) == set(want) and hit >= 0.9


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (20, [0, 1]), (3, [1, 0]), (2, [1, 0]), (5, [1, 1]), (6, None), (7, []), (8, [0, 0]), (9, [nan, 1]), (10, [inf, 1]), (11, [None, 1]), (12, [1, 2, 3]), (None, [1, 1]), (40, [0, 0]), (5, [1, 1])]
    df = frame(spark, rows).withColumnRenamed("label", "rank")
    got = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 5, 1.0), (0, 4, 20, 0.0), (20, 1, 5, 1.0), (20, 2, 0, 0.0), (20, 3, 2, 0.0), (20, 4, 3, 0.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert neighbours.nearest(df, F.col("vec_id") == 999).collect() == []


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(5)
    one = rng.normal(size=8)
    rows = [(k, one if k % 3 else rng.normal(size=8)) for k in range(900)]
    got = neighbours.nearest(frame(spark, rows), F.col("vec_id") == 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [j for j, _ in brute(rows, asks=lambda i: i == 20)[20]]


def test_agreement_gives_the_footrule_of_prefixes():
    rng = np.random.default_rng(6)
    width, order = 5, np.array([rng.permutation(12) for _ in range(40)])
    prefix = order[:, :width]
    got = neighbours.agreements(neighbours.Files(prefix[:7], 12), neighbours.Files(prefix, 12))
    place = lambda o, p: min(list(o).index(p), width)
    for q in range(7):
        want = [sum(abs(place(order[q], p) - place(o, p)) for p in range(12)) for o in order]
        assert (width * (width + 1) - 2 * got[q]).tolist() == want


def test_cells_are_packed_into_bounded_buckets():
    rng = np.random.default_rng(8)
    counts = {c: int(rng.integers(0, 40)) for c in range(50)} | {7: 950, 8: 0, 30: 101, 49: 100}
    first, parts = neighbours.packed(counts, 50, 100)
    held = {}
    for c in range(50):
        assert parts[c] == max(1, -(-counts[c] // 100))
        for b in range(first[c], first[c] + parts[c]):
            held.setdefault(b, []).append((c, counts[c] / parts[c]))
    assert all(sum(n for _, n in v) <= 100 for v in held.values()) and len(held) < 40
    assert all(len(v) == 1 for v in held.values() if any(parts[c] > 1 for c, _ in v))


def test_structure_keeps_queries_to_few_cells():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 32))
    v = centres[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 32))
    pivots = neighbours.Pivots(neighbours.chosen_pivots(v, 256, 7), float((v * v).sum(axis=1).max()))
    loose = rng.normal(size=(4000, 32))
    other = neighbours.Pivots(neighbours.chosen_pivots(loose, 256, 7), float((loose * loose).sum(axis=1).max()))
    a, b = neighbours.fitted(pivots, v, 10**6, 20, 7), neighbours.fitted(other, loose, 10**6, 20, 7)
    assert a.opened < b.opened / 5 and a.share < b.share


def test_pivots_are_apart():
    rng = np.random.default_rng(7)
    one = rng.normal(size=8)
    sample = np.concatenate([one + 0.01 * rng.normal(size=(300, 8)), rng.normal(size=(100, 8))])
    got = neighbours.chosen_pivots(sample, 64, 1)
    ways = got / np.linalg.norm(got, axis=1)[:, None]
    assert 20 < len(got) <= 64 and (ways @ ways.T - 2 * np.eye(len(got))).max() < 0.9


def recall(spark, v):
    """Of every 200th row's 20 nearest, the share found with the parameters as they are."""
    v = v.astype(np.float32).astype(float)
    rows = pa.table({"vec_id": pa.array(range(len(v)), pa.int64()), "embedding": pa.array(list(v), pa.list_(pa.float64()))})
    got = neighbours.nearest(spark.createDataFrame(rows), F.col("vec_id") % 200 == 0).toPandas()
    found = []
    for i, g in got.groupby("query_id"):
        s = v @ v[i]
        s[i] = -np.inf
        found.append(len(set(np.argsort(-s)[:20]) & set(g.vec_id)) / 20)
    assert len(found) == -(-len(v) // 200)
    return np.mean(found)


@pytest.mark.parametrize("sigma", [0.3, 0.5, 1.0])
def test_recall_with_unequal_norms(spark, sigma):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(8192, 64))
    v *= (rng.lognormal(0, sigma, 8192) / np.linalg.norm(v, axis=1))[:, None]
    assert recall(spark, v) >= 0.95


def test_recall_on_fifty_thousand_vectors(spark):
    rng = np.random.default_rng(14)
    v = rng.normal(size=(50_000, 64)) + 0.5 * rng.normal(size=(10, 64))[rng.integers(0, 10, 50_000)]
    assert recall(spark, v / np.linalg.norm(v, axis=1)[:, None]) >= 0.9


@pytest.mark.parametrize("strength", [3.5, 5, 20])
def test_recall_with_a_common_mean(spark, strength):
    rng = np.random.default_rng(12)
    mean = rng.normal(size=64)
    v = rng.normal(size=(8192, 64)) + strength * 8 * mean / np.linalg.norm(mean)
    assert len(neighbours.chosen_pivots(v[:1024], 256, 7)) == 256
    assert recall(spark, v) >= 0.95


def test_pivots_fill_up_with_different_vectors_only():
    one = np.random.default_rng(13).normal(size=8)
    scaled = np.array([one * (1 + k % 50) for k in range(200)])
    got = neighbours.chosen_pivots(scaled, 64, 1)
    assert len(got) == 50 and len(np.unique(got, axis=0)) == 50
    assert len(neighbours.chosen_pivots(np.array([one] * 9), 64, 1)) == 1
