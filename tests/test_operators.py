import pytest
from pyspark.sql import functions as F

from confab.operators import admission, attachments, choice, messages, records, routes, tools, usage, validation


def test_text_of_parts(spark):
    schema = "id string, parts array<struct<type:string,text:string>>"
    rows = [("a", [("text", "x"), ("tool", "no"), ("text", None), ("text", "y")]), ("b", []), ("c", None), ("d", [("tool", "z")])]
    df = spark.createDataFrame(rows, schema)
    assert {r.id: r.t for r in df.select("id", messages.text_of(F.col("parts")).alias("t")).collect()} == {"a": "xy", "b": "", "c": None, "d": ""}
    assert [(r.key, r.text) for r in messages.flatten_parts(df).orderBy("key").collect()] == [("a-0", "x"), ("a-2", None), ("a-3", "y")]


def test_transcripts_keep_order(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "", f"m{k}") for k in reversed(range(12))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = messages.transcripts(df).first().markdown
    assert got.split("\n\n") == [f"**{'User' if k % 2 == 0 else ''}:** m{k}" for k in range(12)]
    own = messages.transcripts(df, formatter=lambda role, text, k: F.concat(k.cast("string"), text)).first().markdown
    assert own.startswith("0m0\n\n1m1")


def test_last(spark):
    df = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (2, 0, "user")], "conv_id long, turn long, role string")
    assert {(r.conv_id, r.turn, r.role) for r in messages.last_message(df).collect()} == {(1, 1, "assistant"), (2, 0, "user")}
    flags = {(r.conv_id, r.turn): (r.is_last, r.is_last_answer, r.cache_mark) for r in messages.last_flags(df).collect()}
    assert flags == {(1, 0): (False, False, None), (1, 1): (True, True, "ephemeral"), (2, 0): (True, False, "ephemeral")}


def test_branches_wrap(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "g long, b long")
    got = {r.g: tuple(r)[1:] for r in messages.branches(df, "g", "b", F.lit(0)).collect()}
    assert got == {1: (3, 0, 2, 1, "1 of 3"), 2: (1, 0, 0, 0, None)}


def test_costs(spark):
    rows = [("claude-sonnet-4-6", 1000, 200, 400), ("claude-haiku-4-5-20251001", None, None, None), ("other", 1, 1, 1), ("claude-sonnet-4-6", 10, 0, 30)]
    df = spark.createDataFrame(rows, "model string, input_tokens long, output_tokens long, cached_tokens long")
    prices = usage.price_table(spark)
    got = sorted(r.cost for r in usage.costs(df, prices).collect())
    assert got == pytest.approx([(-20 * 3 + 30 * 3 * 0.1) / 1e6, 0.0, 0.00492])
    assert [tuple(r) for r in usage.unpriced(df, prices).collect()] == [("other", 1)]
    assert usage.suspicious(df).count() == 1
    lines = {r.line for r in usage.log_lines(usage.costs(df, prices)).collect()}
    assert "[claude-sonnet-4-6] in=1000 (cached 400) out=200 → $0.004920" in lines


def batch(spark, files, accept, size, limit, held):
    df = spark.createDataFrame([(1, k, t, s) for k, (t, s) in enumerate(files)], "b long, ord long, media_type string, size long")
    out = admission.admit(df, "b", "ord", F.lit(accept), F.lit(size).cast("long"), F.lit(limit).cast("int"), F.lit(held)).orderBy("ord").collect()
    assert len({r.code for r in out}) == 1 and {r.message for r in out} == {admission.MESSAGES.get(out[0].code)}
    return [r.admitted for r in out], out[0].code


def test_admission(spark):
    files = [("image/png", 5), ("text/x", 5), ("image/gif", 50), ("image/png", 7)]
    assert batch(spark, files, "audio/*", 10, 9, 0) == ([False] * 4, "accept")
    assert batch(spark, files, "image/*", 1, 9, 0) == ([False] * 4, "max_file_size")
    assert batch(spark, files, " image/* , text/y", 10, 1, 0) == ([True, False, False, False], "max_files")
    assert batch(spark, files, "image/png", None, None, 0) == ([True, False, False, True], None)
    assert batch(spark, files, " ", 0, 4, 0) == ([True] * 4, None)
    assert batch(spark, files, None, None, 3, 5) == ([False] * 4, "max_files")
    assert batch(spark, [("imagex/png", 1), (None, 1)], "image/*", None, None, 0) == ([False, False], "accept")


def test_records(spark):
    df = spark.createDataFrame([(1, "a", "u"), (2, "b", "v")], "id long, title string, owner string")
    changes = spark.createDataFrame([(1, None, "x"), (9, "z", "u")], "id long, title string, owner string")
    assert {tuple(r) for r in records.update(df, changes, "id", ["title"]).collect()} == {(1, None, "u"), (2, "b", "v")}
    assert {tuple(r) for r in records.update(df, changes, "id", ["title"], owner="owner").collect()} == {(1, "a", "u"), (2, "b", "v")}
    gone = changes.select("id", "owner")
    assert {r.id for r in records.delete(df, gone, "id").collect()} == {2}
    assert {r.id for r in records.delete(df, gone, "id", owner="owner").collect()} == {1, 2}
    both = records.delete(records.update(df, changes, "id", ["title"]), gone, "id")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, records.delete(df, gone, "id").collect()))
    assert {r.id for r in records.owned_by(df, "owner", F.lit("u")).collect()} == {1}
    with pytest.raises(Exception, match="Unauthorized"):
        records.owned_by(df, "owner", F.lit(None).cast("string")).collect()
    twice = records.insert(df, df.limit(1))
    assert [r.n for r in records.unique(twice, "id").collect()] == [2]


def test_backfill_and_require(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, owner string")
    with pytest.raises(Exception, match="holds nulls"):
        records.require(df, "owner").collect()
    filled, count = records.backfill(df, "owner", "o")
    assert count.first()["count"] == 1
    again, none = records.backfill(filled, "owner", "p")
    assert none.first()["count"] == 0
    assert sorted(map(tuple, records.require(again, "owner").collect())) == [(1, "o"), (2, "x")]


def test_dedupe_keeps_first_place_and_last_value(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, o long, v string")
    got = records.dedupe_last(df, ["k"], ["o"], "v").orderBy("first_o").collect()
    assert [(r.k, r.v, r.first_o) for r in got] == [("a", "z", 1), ("b", "y", 2)]


def test_validation(spark):
    rows = [("  t ", "c"), (" ", "c"), ("x" * 101, ""), ("😀" * 51, " "), (None, None), (" " + "y" * 100, "d")]
    got = validation.validate(spark.createDataFrame(rows, "title string, content string"), "title", "content").collect()
    assert [r.success for r in got] == [True, False, False, False, False, True]
    assert got[0].valid_title == "t" and got[1].valid_title is None
    assert got[2].errors == {"title": [validation.TITLE_LONG], "content": [validation.CONTENT_REQUIRED]}
    assert got[3].errors["title"] == [validation.TITLE_LONG]


def test_shown_errors(spark):
    rows = [(None,), ([],), (["a", "a"],), (["a", "", "b", "a"],)]
    got = spark.createDataFrame(rows, "m array<string>").select(validation.shown(F.col("m")).alias("s")).collect()
    assert [r.s for r in got] == [None, None, "a", "- a\n- b"]


def test_routes(spark):
    rows = [("/", True), ("/", False), ("/signin", True), ("/signin/x", False), ("/signupX", False), ("/chat", True), ("/chat", False), ("/_next/x", True), ("/a.json", False), ("/a.js", False), ("/api/a.js", False), ("/__clerk/a.js", False), ("/__clerk/a.js", True)]
    got = spark.createDataFrame(rows, "path string, signed_in boolean").select(routes.decision(F.col("path"), F.col("signed_in")).alias("d")).collect()
    assert [r.d for r in got] == ["redirect:/chat", "protect", "redirect:/chat", "pass", "pass", "pass", "protect", None, "protect", None, "protect", "protect", "pass"]


def test_stamps_and_guards(spark):
    now = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    given = spark.createDataFrame([(1, None), (2, "2020-01-01 00:00:00")], "id long, c string").select("id", F.col("c").cast("timestamp_ntz").alias("created_at"))
    got = {r.id: (str(r.created_at), str(r.updated_at)) for r in records.stamped(given, now).collect()}
    assert got == {1: ("2024-05-01 00:00:00",) * 2, 2: ("2020-01-01 00:00:00", "2024-05-01 00:00:00")}
    later = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    changes = spark.createDataFrame([(2,), (2,), (9,)], "id long")
    got = {r.id: str(r.updated_at) for r in records.touched(records.stamped(given, now), changes, "id", later).collect()}
    assert got == {1: "2024-05-01 00:00:00", 2: "2024-06-01 00:00:00"}
    done = F.struct(F.lit(True).alias("success"), F.lit("ok").alias("message"))
    out = spark.createDataFrame([(True,), (False,)], "a boolean").select(records.guarded(F.col("a"), done).alias("r")).collect()
    assert [tuple(r.r) for r in out] == [(True, "ok"), (False, "Unauthorized")]


def test_picked_branch(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 3, "c")], "g long, o long, t string")
    assert {(r.g, r.t) for r in messages.picked_branch(df, "g", "o", F.lit(1)).collect()} == {(1, "b")}


def test_lookup_and_registry(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    assert [r.t for r in choice.lookup(df, "id", F.lit(2)).collect()] == ["b"] and choice.lookup(df, "id", F.lit(3)).collect() == []
    assert set(tools.register(spark)) == {"calc", "weather"}
    assert spark.sql("SELECT calc('2 ^ 5') AS x, calc('nothing') AS y").first() == (32.0, None)


def test_choice(spark):
    df = spark.createDataFrame([("g", "a-Haiku", 0), ("g", "b-haiku", 1), ("g", "c-haiku", 2), ("h", "x", 0)], "g string, id string, o long")
    assert {(r.g, r.match) for r in choice.first_match(df, ["g"], "id", "haiku", "o", "id").collect()} == {("g", "b-haiku"), ("h", None)}
    pages = spark.createDataFrame([([("m", 1)], True), ([("n", 2)], False)], "data array<struct<id:string,n:long>>, has_more boolean")
    assert [r.id for r in choice.pages_of(pages).orderBy("id").collect()] == ["m", "n"]


def test_calc(spark):
    assert tools.calculate("(5 + 3) / 2") == 4 and tools.calculate("sqrt(16)") == 4 and tools.calculate("2^10") == 1024 and tools.calculate("1/0") == float("inf")
    for bad in ("", None, "2 +* 3", "__import__('os')", "a.b", "(" * 2000, "1)", "(1", "[1]", "True", "2 ** 3", "1_000", "1 2", "sqrt(-1)", "(-8)^0.5", "log(-1)", "sin", "sin()", "sin(1, 2)", "(1, 2)", "log(1, 2, 3)", "1 +", ","):
        assert tools.calculate(bad) is None, bad
    inf = float("inf")
    for text, want in (("0^-1", inf), ("log(8, 1)", inf), ("log(8,2)", 3), ("log(0)", -inf), ("log10(0)", -inf), ("-5 % 3", 1), ("5 % -3", -1), ("5 % 0", 5), ("-2^2", -4), ("2^-1", 0.5), ("2^3^2", 512), ("9^99999", inf), ("(-9)^99999", -inf), ("-1/0", -inf), ("+-+2", -2), ("exp(1) - e", 0), ("1e3 + .5", 1000.5), ("2 - 3 - 4", -5), ("abs(-(1 - 3)) * floor(2.7)", 4)):
        assert tools.calculate(text) == pytest.approx(want), text
    assert tools.calculate("1+" * 20_000 + "1") == 20_001 and tools.calculate("(" * 20_000 + "7" + ")" * 20_000) == 7
    assert str(tools.calculate("0/0")) == "nan"
    got = tools.calculated(spark.createDataFrame([("1+1",), ("1+",), (None,)], "expression string")).collect()
    assert got[0].result == 2 and got[0].error is None
    assert got[1].result is None and got[1].error == 'Couldn\'t evaluate "1+". Is it valid math?'
    assert got[2].error is not None


def test_enrich(spark):
    asked = spark.createDataFrame([("Rome",), ("Oslo",), ("Nowhere",)], "location string")
    places = spark.createDataFrame([("Rome", "US", 2, 7), ("Rome", "IT", 1, 5), ("Oslo", "NO", 1, 6)], "name string, country string, rank int, place_id long")
    weather = spark.createDataFrame([(5, 21.5, 0)], "place_id long, temperature double, code long")
    got = {r.location: r for r in tools.enriched(asked, places, weather).collect()}
    assert (got["Rome"].place, got["Rome"].temperature, got["Rome"].error) == ("Rome, IT", 21.5, None)
    assert got["Oslo"].error == "Weather service is unavailable right now."
    assert got["Nowhere"].error == 'Couldn\'t find "Nowhere". Check the spelling?'


def test_steps_are_bounded(spark):
    start = spark.createDataFrame([(0,)], "n int")
    assert tools.bounded_steps(start, lambda s, k: s.select((F.col("n") + 1).alias("n"))).first().n == 5
    assert tools.bounded_steps(start, lambda s, k: None if k == 2 else s.select((F.col("n") + 1).alias("n"))).first().n == 2


def test_attachments(spark):
    df = spark.createDataFrame([([("1", "a"), ("2", "b")], None, bytearray(b"hi"))], "h array<struct<id:string,n:string>>, e array<struct<id:string,n:string>>, c binary")
    pick = lambda c: df.select(c.alias("x")).first().x
    assert [x.id for x in pick(attachments.remove(F.col("h"), F.lit("1")))] == ["2"]
    assert [x.id for x in pick(attachments.append(F.col("e"), F.col("h")))] == ["1", "2"]
    assert pick(attachments.clear(F.col("h"))) == []
    assert [x.id for x in pick(attachments.pop_last(F.col("h"), F.lit("")))] == ["1"]
    assert len(pick(attachments.pop_last(F.col("h"), F.lit("t")))) == 2
    assert pick(attachments.pop_last(attachments.clear(F.col("h")), F.lit(""))) == []
    assert pick(attachments.data_url(F.col("c"), F.lit("text/plain"))) == "data:text/plain;base64,aGk="
    assert pick(attachments.without_ids(F.col("h")))[0].asDict() == {"n": "a"}


def test_partitioning_does_not_change_results(spark):
    df = spark.createDataFrame([(k % 5, k, "user", f"t{k}") for k in range(60)], "conv_id long, turn long, role string, text string")
    a = messages.transcripts(df.coalesce(1)).orderBy("conv_id").collect()
    assert a == messages.transcripts(df.repartition(9)).orderBy("conv_id").collect()


def test_route_maps(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(routes.route_map("title", "url")) == {"Sign In": "/signin", "Sign Up": "/signup", "Chat": "/chat"}
    twice = [("a", "T", "/1", True), ("b", "T", "/2", True)]
    assert one(routes.route_map("title", "url", twice)) == {"T": "/2"}
    assert one(routes.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))) == {"a": 1, "b": 3}
    assert one(routes.landing(F.lit("/"))) == "/signin" and one(routes.landing(F.lit("/x"))) == "/x"


def test_closed_sets_and_pastes(spark):
    df = spark.createDataFrame([("user",), ("bot",), (None,)], "r string")
    assert [r.x for r in df.select(validation.one_of(F.col("r"), validation.ROLES).alias("x")).collect()] == [True, False, False]
    items = spark.createDataFrame([([("file", "a"), ("string", "b")],)], "i array<struct<kind:string,name:string>>")
    got = items.select(attachments.with_ids(attachments.pasted(F.col("i"))).alias("x")).first().x
    assert [x.name for x in got] == ["a"] and len(got[0].id) == 36


def test_cache_writes_are_not_costed(spark):
    df = spark.createDataFrame([(7,), (None,)], "cache_write_tokens long")
    assert [r.cache_line for r in usage.cache_writes(df).collect()] == ["cache write: 7", "cache write: 0"]
