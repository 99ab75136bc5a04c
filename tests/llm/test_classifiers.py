import random
import zlib

import numpy as np
import pytest

from confab.llm import boosting, queries, quality, toxicity

from .helpers import docs


def test_forest_learns_and_flat_walk_equals_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    forest = boosting.fit(x[:2000], y[:2000])
    s = forest.score(x[2000:])
    assert ((s >= 0.5) == y[2000:]).mean() > 0.9

    def walk(row, node):
        while forest.left[node] != node:
            node = forest.left[node] + (row[forest.feature[node]] > forest.threshold[node])
        return forest.value[node]

    slow = [forest.base + sum(walk(r, k) for k in forest.roots) for r in x[2000:2050]]
    assert np.allclose(forest.raw(x[2000:2050]), slow)


def plain_forest(x, y, trees, depth, rate, bins, least, ridge):
    """Log odds of the rows by Newton boosting: each node tries all features and cuts, one after the other."""
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))) for c in x.T]
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    raw = np.full(len(y), np.log(p0 / (1 - p0)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
        grown = raw.copy()

        def grow(rows, level):
            best = (1e-6, None)
            for f in range(x.shape[1]) if level < depth else ():
                for cut in cuts[f]:
                    a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if len(a) >= least and len(b) >= least and score(a) + score(b) - score(rows) > best[0] + 1e-12:
                        best = (score(a) + score(b) - score(rows), (a, b))
            if best[1] is None:
                grown[rows] += -rate * g[rows].sum() / (h[rows].sum() + ridge)
            else:
                grow(best[1][0], level + 1)
                grow(best[1][1], level + 1)

        grow(np.arange(len(y)), 0)
        raw = grown
    return raw


def test_forest_equals_a_plain_one():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(240, 3)), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=240) > 0.4).astype(float)
    shape = dict(trees=6, depth=3, rate=0.3, bins=12, least=8, ridge=1.0)
    assert np.allclose(boosting.fit(x, y, **shape).raw(x), plain_forest(x, y, **shape), atol=1e-9)


def test_forest_without_classes():
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert boosting.fit(np.ones((4, 3)), np.ones(4)).score(np.zeros((1, 3)))[0] > 0.8


def test_statistics_of_odd_texts():
    for t in (None, "", " \n", "a", "\n\n\nx", "é" * 10, "word " * 50000, "🙂 " * 3):
        s = quality.statistics(t)
        assert len(s) == len(quality.FEATURES) and np.isfinite(s).all()


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


@pytest.mark.parametrize(("query", "label", "least"), [("op1_quality", "quality", 0.97), ("op2_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()[query](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index]).all()
    assert (got.predicted == (got.score >= (0.5 if label == "quality" else 0.7))).all()
    known = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    held = got[got.held_out].join(known, how="inner")
    assert auc(held.score.to_numpy(), held[label].to_numpy()) > least
    again = queries.queries()[query](spark, sf).toPandas().set_index("doc_id")
    assert (again.score.sort_index() == got.score.sort_index()).all()


def test_held_out_labels_are_never_read(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "down"]) for _ in range(30)) if i % 2 else "!!! $$$ " * 12) for i in range(240)]
    df = docs(spark, rows)
    labels = [(i, i % 2, 1 - i % 2) for i in range(240)]
    wrong = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    for op in (quality.classify, toxicity.classify):
        a, b = ({r.doc_id: r.score for r in op(df, spark.createDataFrame(x, schema)).collect()} for x in (labels, wrong))
        assert a == b


@pytest.mark.parametrize("op", [quality.classify, toxicity.classify])
def test_edge_cases(spark, op):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)] + [(0, 0, 0), (1, None, None), (2, 7, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(k, "good words here " * 9 if k % 2 else "bad " * 40) for k in range(40)] + [(50, None), (51, ""), (None, "x"), (52, "same"), (52, "same"), (53, "long " * 60000)]
    df = docs(spark, rows).withColumnRenamed("lang", "score").withColumnRenamed("n_chars", "y")
    got = op(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    assert op(df.limit(0), labels).collect() == []
    assert {r.score for r in op(df, labels.limit(0)).collect()} == {0.5}


def test_keep_good_passes_rows_through(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    df = docs(spark, [(k, "good words here and there " * 9 if k % 2 else "bad!! " * 40) for k in range(60)])
    kept = quality.keep_good(df, quality.train(df, labels))
    assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == set(range(1, 60, 2))


def test_models_share_their_backoff():
    from collections import Counter

    words = (Counter({"^table$": 50, "^chair$": 30}), Counter({"^table$": 50, "^chair$": 30, "^awful$": 20}))
    r = toxicity.WordRatios(toxicity.count_models(words))
    assert abs(r["table"]) < 0.5 and r["awful"] > 2 and r["awfully"] > 1 and r["zzz"] == pytest.approx(r["zzz"])
    assert r["Awful!"] == pytest.approx(r["awful"])
    assert r["..."] == 0.0 and r[""] == 0.0


def test_ratios_equal_plain_kneser_ney():
    """The formulas, sequence by sequence: class counts over a shared distribution of continuations."""
    from collections import Counter

    rng = random.Random(5)
    words = tuple(Counter({"^" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) + "$": rng.randrange(1, 6) for _ in range(60)}) for _ in (0, 1))
    order, d, dc = toxicity.ORDER, toxicity.DISCOUNT, toxicity.CLASS_DISCOUNT
    counts = [Counter(), Counter()]
    for c in (0, 1):
        for w, n in words[c].items():
            for i in range(1, len(w)):
                counts[c][w[max(0, i - order) : i + 1]] += n
    seen = {g for g in counts[0] | counts[1] if counts[0][g] + counts[1][g] >= toxicity.LEAST}
    every = {g[k:] for g in seen for k in range(len(g))}
    neighbours = lambda g: len({h[0] for h in every if h[1:] == g})

    def shared(g):
        if not g:
            return 1 / 256
        ends = [h for h in every if h[:-1] == g[:-1] and neighbours(h)]
        total = sum(map(neighbours, ends))
        return (max(neighbours(g) - d, 0) + d * len(ends) * shared(g[1:])) / total if total else shared(g[1:])

    def likelihood(c, g):
        ends = [h for h in seen if h[:-1] == g[:-1] and counts[c][h]]
        total = sum(counts[c][h] for h in ends)
        below = shared(g[1:])
        return (max(counts[c][g] - dc, 0) + sum(min(counts[c][h], dc) for h in ends) * below) / total if total else below

    got = toxicity.count_models(words)
    assert set(got) == seen
    for g in rng.sample(sorted(seen), 40):
        assert got[g] == pytest.approx(np.log(likelihood(1, g) / likelihood(0, g))), g


def test_samples_are_bounded_where_rows_share_an_id(spark, monkeypatch):
    rows = [(k % 6, f"text {k} " * (k % 7 + 1)) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(6)], "doc_id long, quality int, toxic int")
    sizes = []
    fit, count = boosting.fit, toxicity.fit
    monkeypatch.setattr(boosting, "fit", lambda x, y: sizes.append((len(x), y.sum())) or fit(x, y))
    monkeypatch.setattr(toxicity, "fit", lambda r: sizes.append((len(r), sum(c for _, _, c in r))) or count(r))
    quality.train(docs(spark, rows), labels, most=20)
    toxicity.train(docs(spark, rows), labels, size=20 * (toxicity.ROW_BYTES + 60))
    assert all(20 < n <= 60 and 0 < ones < n for n, ones in sizes) and sizes[0][0] <= 40


def test_equal_classes_have_no_ratio():
    from collections import Counter

    words = (Counter({"^abc$": 5, "^abd$": 4, "^b$": 3}), Counter({"^abc$": 2, "^ae$": 6}))
    assert all(np.isfinite(list(toxicity.count_models(words).values())))
    assert max(map(abs, toxicity.count_models((words[0], words[0])).values())) < 1e-12


def test_long_words_are_read_whole():
    rng = random.Random(3)
    step = toxicity.PIECE - toxicity.ORDER
    for n in (64, 65, 66, 81, 82, 83, 1000):
        w = "".join(rng.choice("abcdefgh") for _ in range(n))
        got = toxicity.words_of(f"x {w} y")[1:-1]
        assert got == [w] if n <= toxicity.LONG else w == got[0] + "".join(p[toxicity.ORDER :] for p in got[1:]) and len(got) == -(-(n - toxicity.ORDER) // step)
    signs = [chr(0x4E00 + k) for k in range(300)]
    plain = lambda n: "".join(rng.choices(signs, k=n))
    bad = "笨蛋快滚开去死吧"
    text = lambda toxic: plain(rng.randint(70, 250)) + (bad * 2 if toxic else plain(16)) + plain(60)
    model = toxicity.fit([(k, text(k // 2 % 2), k // 2 % 2) for k in range(200)])
    ratios = toxicity.WordRatios(model.by_gram)

    def scored(t):
        x = (np.array(toxicity.features(t, ratios)) - model.mean) / model.scale
        return 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1])))

    hit, false = ([scored(text(toxic)) > 0.7 for _ in range(100)] for toxic in (True, False))
    assert np.mean(hit) >= 0.6 and np.mean(false) <= 0.2
