import pytest
from pyspark.sql import functions as F

from confab.llm import mixing, queries

from .helpers import WORD, docs


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target}: share by weight, cap, share the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def check(rows, texts):
    sizes, taken, longest = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    goal = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source])
    return sizes, taken, goal, longest


def test_mix_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_mixing(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.size for r in rows} == {i: len(WORD.findall(t)) for i, t in texts.items()}
    sizes, taken, goal, _ = check(rows, texts)
    assert all(abs(taken[s] - goal[s]) <= max(0.01 * goal[s], 20) for s in goal)
    again = queries.op9_mixing(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_plan_is_native(spark, sf_dir):
    text = queries.op9_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def test_small_sources_stop_at_three_times(spark):
    df = docs(spark, ["w " * 10] * 2 + ["w " * 300] * 40, source=lambda k: "a" if k < 2 else "b")
    rows = mixing.mix(df).collect()
    _, taken, goal, _ = check(rows, None)
    assert goal["a"] == 60 and taken["a"] == 60 and abs(taken["b"] - goal["b"]) <= 150


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b c"), (4, "d e"), (4, "d e"), (5, "x " * 50000), (6, "p q r s")]
    df = docs(spark, rows, source=lambda k: None if k % 2 else "s").withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "target")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    check(got, None)
    a, b = (r.taken for r in got if r.doc_id == 4 and r.source == "s" or r.doc_id == 4)
    assert {r.taken for r in got if r.size == 0} == {0}
    assert mixing.mix(df.limit(0)).collect() == []
    nothing = mixing.mix(docs(spark, [None, "", " "])).collect()
    assert {(r.size, r.target, r.taken) for r in nothing} == {(0, 0.0, 0)}


def test_repeated_rows_are_taken_alike(spark):
    df = docs(spark, [(k // 3, f"{k // 3} " * (1 + k // 3 % 17)) for k in range(300)], source=lambda k: "ab"[k % 2 if k < 0 else 0])
    seen = {}
    for r in mixing.mix(df).collect():
        seen.setdefault(r.doc_id, set()).add(r.taken)
    assert all(len(v) == 1 for v in seen.values())


def test_one_source_and_many(spark):
    for n in (1, 40):
        df = docs(spark, [f"w{k} " * (1 + k % 30) for k in range(400)], source=lambda k, n=n: f"s{k % n:02d}")
        _, taken, goal, longest = check(mixing.mix(df).collect(), None)
        assert all(abs(taken[s] - goal[s]) <= max(longest[s], 0.02 * goal[s]) for s in goal)


def plain_scale(sizes, room, power):
    """The scale of the inclusions min(1, scale * size ** power) whose expected words are the room, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(1.0, mid * s**power) * s for s in sizes) < room else (lo, mid)
    return (lo + hi) / 2


def plain_mix(rows, weights=(5, 2, 1), most=3, power=None, passes=None):
    """{row: copies} from (source, size, u), as the docstring of plan() has it."""
    power, passes = mixing.POWER if power is None else power, passes or mixing.PASSES
    by = {}
    for k, (source, _, _) in enumerate(rows):
        by.setdefault(source, []).append(k)
    sizes = {s: sum(rows[k][1] for k in ks) for s, ks in by.items()}
    goal, out = plain_targets(sizes, weights, most), dict.fromkeys(range(len(rows)), 0)
    for source, ks in by.items():
        rate = min(goal[source] / sizes[source], most) if sizes[source] else 0
        whole = int(rate + 1e-12)
        room = goal[source] - whole * sizes[source]
        for k in ks:
            out[k] = whole
        if room <= 1e-12 * max(sizes[source], 1):
            continue
        scale = plain_scale([rows[k][1] for k in ks], room, power)
        q = {}
        for k in ks:
            p, u = scale * rows[k][1] ** power, rows[k][2]
            q[k] = 0.0 if p >= 1 - 1e-12 else (u / (1 - u)) / (p / (1 - p)) if p else float("inf")
        left, after = [k for k in ks if rows[k][1]], -1.0
        for turn in range(passes):
            last = turn == passes - 1
            longest = float("inf") if not turn else room * (2 if last else 1)
            ties = {}
            for k in left:
                if q[k] > after and rows[k][1] <= longest:
                    ties.setdefault(q[k], []).append(k)
            for at in sorted(ties):
                words = sum(rows[k][1] for k in ties[at])
                if words / (2 if last else 1) > room:
                    break
                room, after = max(room - words, 0), at
                for k in ties[at]:
                    out[k] += 1
                if room == 0 and not last:
                    break
    return out


@pytest.mark.parametrize("kinds", [1, 3, 20])
def test_taken_equals_a_plain_mix(spark, kinds):
    import random

    rng = random.Random(kinds)
    texts = [f"{k} " + "w " * int(rng.lognormvariate(2.5, 1.2)) for k in range(600)] + [None, "", "x " * 900]
    df = docs(spark, texts, source=lambda k: f"s{k % kinds}" if k % 11 else None)
    rows = mixing.sized(df, 42).collect()
    want = plain_mix([(r.source, r.size, r.u) for r in rows])
    got = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    assert got == {r.doc_id: min(want[k], 3) for k, r in enumerate(rows)}


def test_inclusion_goes_with_size(spark):
    """Over seeds, documents of one source are taken as often as their own inclusion probability says."""
    sizes = [4, 16, 64] * 80
    df = docs(spark, [f"{k} " + "a " * (sizes[k] - 1) for k in range(240)] + ["b " * 50] * 12, source=lambda k: "a" if k < 240 else "b").cache()
    hits, seeds = dict.fromkeys(sizes, 0), 5
    for seed in range(seeds):
        got = mixing.mix(df, weights=(1, 5), seed=seed).where("source = 'a'").collect()
        whole = int(got[0].target / got[0].source_size)
        for r in got:
            hits[r.size] += r.copies - whole
    room = got[0].target - whole * got[0].source_size
    scale = plain_scale(sizes, room, mixing.POWER)
    want = {s: min(1, scale * s**mixing.POWER) for s in hits}
    assert want[4] < want[16] < want[64]
    for s in hits:
        assert abs(hits[s] / (80 * seeds) - want[s]) < 0.1


def test_documents_are_repeated(spark):
    df = docs(spark, [f"w{k} " * (3 + k % 9) for k in range(120)], source=lambda k: f"s{k % 4}")
    want = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.schema.names == df.schema.names
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").agg(F.count("*").alias("count")).collect()}
    assert got == {k: v for k, v in want.items() if v}
