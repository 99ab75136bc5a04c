import json

import pytest
from pyspark.sql import functions as F

from confab.plans import catalog
from confab.sources import tables
from confab.streaming import chunks


def test_requests(spark):
    sound = json.dumps({"messages": [{"id": "1", "role": "user", "parts": [{"type": "text", "text": "hi"}]}], "model": "m"})
    bodies = [sound, sound + "]", "{", None, '{"messages":[]}', '{"messages":[],"model":null}', '{"messages":[],"model":3}', '{"messages":{},"model":"m"}', '{"messages":[],"model":"m"}', "", '{"model":"m"},{}']
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = df.select(tables.decoded_request(F.col("b")).alias("d")).select("d.error", "d.request").collect()
    assert [r.error for r in got] == [None, "malformed", "malformed", "malformed", "model", "model", "model", "messages", None, "malformed", "malformed"]
    assert got[0].request.messages[0].parts[0].text == "hi" and got[8].request.messages == []
    with pytest.raises(Exception, match="invalid request: model"):
        df.where("b LIKE '%null%'").select(tables.strict_request(F.col("b"))).collect()


def test_responses(spark):
    rows = [(200, '{"k": 1}'), (404, '{"why": "gone"}'), (500, "<html>"), (299, "{"), (503, None), (199, "{}")]
    got = tables.fetched(spark.createDataFrame(rows, "status int, body string"), "k long").collect()
    assert [r.data and r.data.k for r in got] == [1, None, None, None, None, None]
    assert [r.error and (r.error.message, r.error.status, r.error.body) for r in got] == [
        None, ("API error 404", 404, '{"why": "gone"}'), ("API error 500", 500, None), None, ("API error 503", 503, None), ("API error 199", 199, "{}"),
    ]


def test_prompt_text(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), (None, None)], "p string, f string")
    assert [r.x for r in df.select(tables.prompt_text(F.col("p"), F.col("f")).alias("x")).collect()] == ["a", "b", ""]


def test_files(spark, tmp_path):
    (tmp_path / "models.json").write_text(json.dumps({"data": [{"id": "a", "max_tokens": 5}], "has_more": False}) + "\n")
    got = tables.json_snapshot(spark, str(tmp_path / "models.json")).first()
    assert got.data[0].id == "a" and got.has_more is False
    (tmp_path / "bad.json").write_text("{\n")
    with pytest.raises(Exception):
        tables.json_snapshot(spark, str(tmp_path / "bad.json")).collect()
    tables.write_transcripts(spark.createDataFrame([("x\n\ny",)], "markdown string"), str(tmp_path / "md"))
    assert "x\n\ny" in spark.read.text(str(tmp_path / "md"), wholetext=True).first().value
    df = spark.range(3)
    tables.write_snapshot(df, str(tmp_path / "s"))
    assert tables.parquet(spark, str(tmp_path), "s") if (tmp_path / "s.parquet").exists() else spark.read.parquet(str(tmp_path / "s")).count() == 3
    with pytest.raises(Exception):
        tables.write_snapshot(df, str(tmp_path / "s"))


def rows():
    return [("a", 1, "text", "lo", None), ("a", 0, "text", "hel", None), ("a", 2, "tool", "no", None), ("a", 3, "finish", None, "stop"), ("b", 0, "text", "x", None), ("c", 0, "finish", None, "error")]


SCHEMA = "message_id string, seq int, type string, text string, finish_reason string"


def test_fold(spark):
    got = {r.message_id: (r.text, r.finish_reason) for r in chunks.fold(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got == {"a": ("hello", "stop"), "b": ("x", None), "c": ("", "error")}
    marked = chunks.finish_metadata(spark.createDataFrame(rows(), SCHEMA)).where("metadata IS NOT NULL").collect()
    assert {r.metadata.finishReason for r in marked} == {"stop", "error"}


def test_stream(spark, tmp_path):
    seen = []
    out, at = str(tmp_path / "out"), str(tmp_path / "at")

    def arrive(some):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        read = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        chunks.write_finished(read, out, at, lambda b, i: seen.append(i)).awaitTermination()
        return sorted((r.message_id, r.text, r.finish_reason) for r in spark.read.parquet(out).collect())

    # the finish of d comes before one of its texts
    first = [*rows()[:3], ("d", 1, "text", "ve", None), ("d", 2, "finish", None, "length")]
    assert arrive(first) == []
    done = [("a", "hello", "stop"), ("c", "", "error"), ("d", "five", "length")]
    assert arrive([*rows()[3:], ("d", 0, "text", "fi", None)]) == done
    # b is still open
    assert arrive([("e", 0, "finish", None, "stop")]) == [*done, ("e", "", "stop")]
    kept = {r.message_id: r.text for r in chunks.latest_version(spark.read.parquet(out), "message_id", "version").collect()}
    assert kept == {"a": "hello", "c": "", "d": "five", "e": ""} and len(seen) == 3


def test_chunks_round_trip(spark, sf_dir):
    df = tables.parquet(spark, sf_dir, "conversations").withColumn("message_id", F.concat_ws(".", "conv_id", "turn"))
    got = chunks.fold(catalog.as_chunks(df, 7)).select("message_id", "text")
    assert got.exceptAll(df.select("message_id", "text")).isEmpty()


def test_usage_log_is_exact(spark, sf_dir):
    from decimal import ROUND_HALF_UP, Decimal

    costs = {(r.conv_id, r.turn): r.cost for r in catalog.usage_cost(spark, sf_dir).collect()}
    for r in catalog.usage_log(spark, sf_dir).collect():
        want = Decimal(costs[r.conv_id, r.turn]).quantize(Decimal("0.000001"), ROUND_HALF_UP)
        assert r.line.endswith(f"→ ${want}")


def test_jdbc(spark):
    """The embedded database that comes with Spark."""
    url = "jdbc:derby:memory:confab;create=true"
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").write.format("jdbc").options(url=url, dbtable="notes").save()
    read = tables.jdbc(spark, url, "notes")
    assert {r.t for r in read.where("id = 2").collect()} == {"b"}
    assert "*EqualTo(" in read.where("id = 2")._jdf.queryExecution().executedPlan().toString()
