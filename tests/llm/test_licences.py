import math
import random
from collections import Counter

from confab.llm import license_scan, queries

from .helpers import docs


def test_cosine_equals_plain_vectors():
    m = license_scan.Matcher()
    text = "Licensed under the Apache License, version 2"
    best = (0, "")
    for name, ts in license_scan.TEMPLATES.items():
        for t in ts:
            a, b = Counter(license_scan._terms(text)), Counter(license_scan._terms(t))
            w = lambda c: {x: (1 + math.log(n)) * m.idf.get(x, m.unknown) for x, n in c.items()}
            a, b = w(a), w(b)
            cos = sum(v * b.get(x, 0) for x, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            best = max(best, (cos, name))
    got = m.best(text)
    assert got[1] == best[1] == "Apache-2.0" and abs(got[0] - best[0]) < 1e-8


def test_templates_find_themselves():
    m = license_scan.Matcher()
    for name, ts in license_scan.TEMPLATES.items():
        for t in ts:
            assert m.best(t)[1] == name and m.best(t)[0] > 0.999
            assert license_scan._SIGN.search(t)


def test_notices_over_lines():
    m = license_scan.Matcher()
    wrapped = "# code\nThis program is free software: you can redistribute it and/or modify it under\nthe terms of the GNU General Public License as published by the Free Software Foundation,\neither version 3 of the License, or (at your option) any later version.\n\nmore"
    assert license_scan.notices(wrapped, m)[0][1] == "GPL-3.0"
    for t in (None, "", "no notice", "a licence to fish in these waters was granted to the duke by the king", "x " * 50000):
        assert license_scan.notices(t, m) == []


def test_inheritance(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        (1, mit, "LICENSE"), (2, "code", "a.py"), (3, "code", "src/b.py"), (4, apache, "src/lib/LICENSE"), (5, "code", "src/lib/c.py"), (6, "code", "src/lib/deep/er/d.py"),
        (7, apache + "\n" + "code words " * 20, "src/e.py"), (8, "code", "src/f.py"), (9, None, "src/lib/g"), (10, "", None), (None, "x", "src/lib/h"), (11, "code", "src/library/i"),
        (12, mit, "tie/L2"), (13, apache, "tie/L1"), (14, "code", "tie/x"), (15, "long " * 50000, "y"), (15, "long " * 50000, "y"),
    ]
    df = spark.createDataFrame([(i, t, p, 0) for i, t, p in files], "doc_id long, text string, path string, score int")
    rows = license_scan.scan(df).collect()
    got = {(r.doc_id, r.path): (r.licence, r.from_dir) for r in rows}
    assert len(rows) == len(files)
    assert got[2, "a.py"] == ("MIT", "") and got[3, "src/b.py"] == ("MIT", "") and got[8, "src/f.py"] == ("MIT", "")
    assert got[5, "src/lib/c.py"] == got[6, "src/lib/deep/er/d.py"] == got[9, "src/lib/g"] == got[None, "src/lib/h"] == ("Apache-2.0", "src/lib")
    assert got[7, "src/e.py"] == ("Apache-2.0", None) and got[11, "src/library/i"] == ("MIT", "") and got[10, None] == (None, None)
    assert got[14, "tie/x"] == ("MIT", "tie") and got[15, "y"] == ("MIT", "")
    assert license_scan.scan(df.limit(0)).collect() == []


def test_over_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = {i: {n for x, n in lines.items() if x in t.split("\n")} for i, t in texts.items()}
    got = {r.doc_id: r.own_licence for r in queries.op7_license_scan(spark, sf_dir).collect()}
    assert all((got[i] in w) if w else got[i] is None for i, w in want.items()) and any(want.values())
    none = docs(spark, ["x"])
    assert license_scan.scan(none.withColumnRenamed("source", "path")).first().licence is None


def test_full_texts_are_licence_files(spark):
    full = license_scan.full_texts()
    assert len(full) >= 30 and set(full) <= set(license_scan.TEMPLATES)
    files, want = [], {}
    for k, (name, (t,)) in enumerate(full.items()):
        # as it is, on one line, and under a head of its own
        for j, text in enumerate([t, " ".join(t.split()), f"{name} licence\n\nCopyright (c) 2021 Some Person and others\n\n{t}"]):
            files += [(2 * (3 * k + j), text, f"p{k}_{j}/LICENSE"), (2 * (3 * k + j) + 1, "code", f"p{k}_{j}/src/a.py")]
            want[2 * (3 * k + j)] = want[2 * (3 * k + j) + 1] = name
    rows = license_scan.scan(spark.createDataFrame(files, "doc_id long, text string, path string")).collect()
    assert {r.doc_id: r.licence for r in rows} == want
    code = "int main(void) { return 0; }\n" * 200
    got = license_scan.scan(spark.createDataFrame([(1, full["MIT"][0] + code, "main.c"), (2, "x", "a")], "doc_id long, text string, path string")).collect()
    assert {r.doc_id: r.licence for r in got} == {1: "MIT", 2: None}


def test_named_files_hold_for_their_directory(spark):
    notice = "Released under the MIT License.\n\n" + "much more text that is no notice at all " * 30
    files = [(1, notice, "a/COPYING"), (2, "x", "a/b/c"), (3, notice, "d/code.py"), (4, "x", "d/e"), (5, "nothing here", "f/LICENSE.txt"), (6, "x", "f/g"), (7, notice, "h/licence-MIT.md"), (8, "x", "h/i"), (9, notice, "j/licensed.py"), (10, "x", "j/k")]
    rows = license_scan.scan(spark.createDataFrame(files, "doc_id long, text string, path string")).collect()
    assert {r.doc_id: r.licence for r in rows} == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: "MIT", 8: "MIT", 9: "MIT", 10: None}


def test_all_columns_equal_a_plain_scan(spark, sf_dir):
    """Over the table with paths, beside full texts and headers: own columns by the functions, directories by a loop."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).collect()]
    texts += [t for ts in license_scan.full_texts().values() for t in ts] + ["Licensed under the ISC License.", None, ""]
    rng = random.Random(4)
    files = [(k, t, "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 5))) + f"/f{k}") for k, t in enumerate(texts)]
    files = [(k, t, p.lstrip("/")) for k, t, p in files]
    got = {r.doc_id: tuple(r)[2:] for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, text string, path string")).collect()}
    m, full = license_scan.Matcher(), license_scan.Matcher(license_scan.full_texts())
    own, held = {}, {}
    for k, t, p in files:
        found = license_scan.notices(t, m)
        score, name = license_scan.whole(t, full)
        is_file = bool(name)
        if not name and found:
            score, name = max((s, n) for s, n, _ in found)[0], max(found, key=lambda x: x[0])[1]
            is_file = sum(n for _, _, n in found) >= 0.5 * len(t.split())
        own[k] = (name or None, score if name else 0.0, len(found))
        if is_file:
            above = p.rpartition("/")[0]
            held[above] = min(held.get(above, (1, 0, "")), (-score, k, name))
    for k, t, p in files:
        licence, from_dir = own[k][0], None
        above = p.rpartition("/")[0]
        while licence is None:
            if above in held:
                licence, from_dir = held[above][2], above
            elif not above:
                break
            above = above.rpartition("/")[0]
        assert got[k] == (*own[k], licence, from_dir), p


def test_notices_amid_words():
    m = license_scan.Matcher()
    for name, ts in license_scan.TEMPLATES.items():
        for t in ts:
            text = f"some quite ordinary words before {t.rstrip('.')} and many more ordinary words after it follow on one line"
            assert [(n, round(s, 3)) for s, n, _ in license_scan.notices(text, m)] == [(name, 1.0)], t
    both = " ".join(["word"] * 30 + ["Released under the MIT License."] + ["word"] * 30 + ["Licensed under the Apache License, Version 2.0."] + ["word"] * 30)
    assert [(n, k) for _, n, k in license_scan.notices(both, m)] == [("MIT", 5), ("Apache-2.0", 7)]
