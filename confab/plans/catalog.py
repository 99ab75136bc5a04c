"""Queries over the tables, by name, each with the SQL that gives the same rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.functions import text as T
from confab.operators import admission, attachments, choice, messages, records, routes, tools, usage, validation
from confab.sources import tables
from confab.streaming import chunks

_ORACLE: dict[str, str] = {}
_QUERIES: dict = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


@_query("""
SELECT conv_id, string_agg('**' || upper(substr(role, 1, 1)) || substr(role, 2) || ':** ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown
FROM conversations GROUP BY conv_id
""")
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.transcripts(tables.parquet(spark, sf_dir, "conversations"))


@_query("""
SELECT conv_id, string_agg(n || '. ' || role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id
""")
def markdown_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts by a formatter that uses the position."""
    numbered = lambda role, text, k: F.concat((k + 1).cast("string"), F.lit(". "), role, F.lit(": "), text)
    return messages.transcripts(tables.parquet(spark, sf_dir, "conversations"), formatter=numbered)


@_query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.last_message(tables.parquet(spark, sf_dir, "conversations"))


@_query("""
SELECT conv_id, turn, turn = max(turn) OVER w AS is_last, turn = max(turn) OVER w AND role = 'assistant' AS is_last_answer,
       CASE WHEN turn = max(turn) OVER w THEN 'ephemeral' END AS cache_mark
FROM conversations WINDOW w AS (PARTITION BY conv_id)
""")
def last_turn_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return messages.last_flags(rows).drop("role")


def _as_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of parts: the text, a tool part, and every other turn the role as a second text."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.col("text")), part("tool-calc", F.lit(None).cast("string")))
    more = F.when(F.col("turn") % 2 == 0, F.array(part("text", F.col("role")))).otherwise(F.slice(parts, 1, 0))
    rows = tables.parquet(spark, sf_dir, "conversations")
    return rows.select(F.concat_ws(".", "conv_id", "turn").alias("id"), F.concat(parts, more).alias("parts"))


@_query("""
SELECT conv_id || '.' || turn AS id, text || CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS text FROM conversations
""")
def message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_parts(spark, sf_dir).select("id", messages.text_of(F.col("parts")).alias("text"))


@_query("""
SELECT conv_id || '.' || turn AS id, conv_id || '.' || turn || '-0' AS key, 0 AS position, text FROM conversations
UNION ALL
SELECT conv_id || '.' || turn, conv_id || '.' || turn || '-2', 2, role FROM conversations WHERE turn % 2 = 0
""")
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.flatten_parts(_as_parts(spark, sf_dir))


_MODEL_SQL = "CASE conv_id % 4 WHEN 0 THEN 'claude-haiku-4-5-20251001' WHEN 1 THEN 'claude-sonnet-4-6' WHEN 2 THEN 'claude-opus-4-8' ELSE 'unlisted' END"
_USAGE_SQL = f"""
SELECT conv_id, turn, {_MODEL_SQL} AS model, CASE WHEN turn % 5 <> 4 THEN length(text) END AS input_tokens,
       CASE WHEN turn % 3 <> 2 THEN length(text) // 2 END AS output_tokens, CASE WHEN turn % 2 = 0 THEN length(text) // 3 END AS cached_tokens
FROM conversations
"""


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage derived from message lengths, with nulls and a model that has no price."""
    n, names = F.length("text").cast("long"), [m for m, _, _ in usage.PRICES] + ["unlisted"]
    model = F.element_at(F.array(*map(F.lit, names)), (F.col("conv_id") % 4 + 1).cast("int"))
    return tables.parquet(spark, sf_dir, "conversations").select(
        "conv_id", "turn", model.alias("model"), F.when(F.col("turn") % 5 != 4, n).alias("input_tokens"),
        F.when(F.col("turn") % 3 != 2, F.floor(n / 2)).alias("output_tokens"), F.when(F.col("turn") % 2 == 0, F.floor(n / 3)).alias("cached_tokens"),
    )


@_query(f"""
WITH u AS ({_USAGE_SQL}), p(model, rate_in, rate_out) AS (VALUES ('claude-haiku-4-5-20251001', 1.0::DOUBLE, 5.0::DOUBLE), ('claude-sonnet-4-6', 3.0, 15.0), ('claude-opus-4-8', 5.0, 25.0)),
c AS (SELECT conv_id, turn, model, coalesce(input_tokens, 0) AS i, coalesce(output_tokens, 0) AS o, coalesce(cached_tokens, 0) AS c, rate_in, rate_out FROM u JOIN p USING (model))
SELECT conv_id, turn, model, ((i - c) * rate_in + c * rate_in * 0.1::DOUBLE) / 1000000::DOUBLE + (o * rate_out) / 1000000::DOUBLE AS cost FROM c
""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.costs(_usage(spark, sf_dir), usage.price_table(spark)).select("conv_id", "turn", "model", "cost")


@_query(f"SELECT model, count(*) AS n FROM ({_USAGE_SQL}) WHERE model = 'unlisted' GROUP BY model")
def usage_unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.unpriced(_usage(spark, sf_dir), usage.price_table(spark))


@_query(f"SELECT conv_id, turn FROM ({_USAGE_SQL}) WHERE coalesce(cached_tokens, 0) > coalesce(input_tokens, 0)")
def usage_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.suspicious(_usage(spark, sf_dir)).select("conv_id", "turn")


@_query(f"""
WITH u AS ({_USAGE_SQL}), p(model, rate_in, rate_out) AS (VALUES ('claude-haiku-4-5-20251001', 1.0::DOUBLE, 5.0::DOUBLE), ('claude-sonnet-4-6', 3.0, 15.0), ('claude-opus-4-8', 5.0, 25.0)),
c AS (SELECT conv_id, turn, model, coalesce(input_tokens, 0) AS i, coalesce(output_tokens, 0) AS o, coalesce(cached_tokens, 0) AS c, rate_in, rate_out FROM u JOIN p USING (model))
SELECT conv_id, turn, printf('[%s] in=%d (cached %d) out=%d → $%.6f', model, i, c, o, ((i - c) * rate_in + c * rate_in * 0.1::DOUBLE) / 1000000::DOUBLE + (o * rate_out) / 1000000::DOUBLE) AS line FROM c
""")
def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six decimals of the exact binary value. The SQL would round ties to the even digit, of which these tables have
    none; tests compare with exact decimals."""
    return usage.log_lines(usage.costs(_usage(spark, sf_dir), usage.price_table(spark))).select("conv_id", "turn", "line")


@_query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS position, event_id, event_type FROM events")
def owner_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return records.owner_list(rows, "user_id", "ts", "event_id").select("user_id", "position", "event_id", "event_type")


_TITLE_SQL = "CASE WHEN turn % 7 = 3 THEN chr(9) || '  ' ELSE '  ' || left(text, 150 - CAST(turn AS INTEGER) * 20) || chr(10) END"


@_query(f"""
WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace({_TITLE_SQL}, '^\\s+', ''), '\\s+$', '') AS title, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS content FROM conversations),
e AS (SELECT *, CASE WHEN length(title) < 1 THEN 'Title is required' WHEN length(title) > 100 THEN 'Title could not be longer than 100 symbols' END AS title_error,
             CASE WHEN content = ' ' THEN 'Message content is required' END AS content_error FROM t)
SELECT conv_id, turn, title_error, content_error, title_error IS NULL AND content_error IS NULL AS success,
       CASE WHEN title_error IS NULL AND content_error IS NULL THEN title END AS valid_title FROM e
""")
def validate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "conversations")
    long = F.concat(F.lit("  "), F.substr("text", F.lit(1), (F.lit(150) - F.col("turn") * 20).cast("int")), F.lit("\n"))
    rows = rows.withColumn("title", F.when(F.col("turn") % 7 == 3, F.lit("\t  ")).otherwise(long)).withColumn("content", F.when(F.col("turn") % 5 == 4, F.lit(" ")).otherwise(F.col("text")))
    out = validation.validate(rows, "title", "content")
    first = lambda f: F.try_element_at("errors", F.lit(f))[0]
    return out.select("conv_id", "turn", first("title").alias("title_error"), first("content").alias("content_error"), "success", "valid_title")


@_query("""
WITH f AS (SELECT doc_id, doc_id // 10 AS batch, 'text/' || lang AS media_type, n_chars AS size,
                  CASE (doc_id // 10) % 4 WHEN 0 THEN ' text/en , application/* ' WHEN 1 THEN 'text/*' WHEN 2 THEN ' ' ELSE 'image/*' END AS accept,
                  CASE WHEN (doc_id // 10) % 3 = 0 THEN 0 ELSE 600 END AS max_size, CASE WHEN (doc_id // 10) % 5 <> 4 THEN 4 END AS max_files, (doc_id // 10) % 6 AS held FROM documents),
t AS (SELECT *, CASE WHEN accept LIKE '%en%' THEN media_type = 'text/en' WHEN accept = 'image/*' THEN false ELSE true END AS fits_type FROM f),
s AS (SELECT *, fits_type AND (max_size = 0 OR size <= max_size) AS fits_size, greatest(0, max_files - held) AS room FROM t),
w AS (SELECT *, sum(fits_size::INT) OVER (PARTITION BY batch ORDER BY doc_id) AS place, sum(fits_type::INT) OVER (PARTITION BY batch) AS n_type, sum(fits_size::INT) OVER (PARTITION BY batch) AS n_size FROM s)
SELECT batch, doc_id, fits_type, fits_size, fits_size AND coalesce(place <= CASE WHEN max_files IS NOT NULL THEN room END, true) AS admitted,
       CASE WHEN n_type = 0 THEN 'accept' WHEN n_size = 0 THEN 'max_file_size' WHEN max_files IS NOT NULL AND n_size > room THEN 'max_files' END AS code,
       CASE WHEN n_type = 0 THEN 'No files match the accepted types.' WHEN n_size = 0 THEN 'All files exceed the maximum size.'
            WHEN max_files IS NOT NULL AND n_size > room THEN 'Too many files. Some were not added.' END AS message FROM w
""")
def admission_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = F.floor(F.col("doc_id") / 10)
    rows = tables.parquet(spark, sf_dir, "documents").select("doc_id", batch.alias("batch"), F.concat(F.lit("text/"), "lang").alias("media_type"), F.col("n_chars").alias("size"))
    b = F.col("batch")
    accept = F.when(b % 4 == 0, " text/en , application/* ").when(b % 4 == 1, "text/*").when(b % 4 == 2, " ").otherwise("image/*")
    limit, files = F.when(b % 3 == 0, 0).otherwise(600), F.when(b % 5 != 4, F.lit(4))
    out = admission.admit(rows, "batch", "doc_id", accept, limit, files, b % 6)
    return out.select("batch", "doc_id", "fits_type", "fits_size", "admitted", "code", "message")


@_query("""
SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS first_event_id
FROM events GROUP BY user_id, event_type
""")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return records.dedupe_last(rows, ["user_id", "event_type"], ["ts", "event_id"], "value")


_REQUEST_SQL = """
SELECT page_id, page_id % 2 = 0 AS signed_in, CASE page_id % 10 WHEN 0 THEN '/' WHEN 1 THEN '/signin' WHEN 2 THEN '/signup/x' WHEN 3 THEN '/chat' WHEN 4 THEN '/_next/a' WHEN 5 THEN '/a.css'
       WHEN 6 THEN '/api/a.json' WHEN 7 THEN '/__clerk/a.js' ELSE regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '') END AS path FROM pages
"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", "")
    path = own
    for k, p in enumerate(("/", "/signin", "/signup/x", "/chat", "/_next/a", "/a.css", "/api/a.json", "/__clerk/a.js")):
        path = F.when(F.col("page_id") % 10 == k, p).otherwise(path)
    return tables.parquet(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 2 == 0).alias("signed_in"), path.alias("path"))


@_query(f"""
WITH r AS ({_REQUEST_SQL}),
k AS (SELECT *, (starts_with(path, '/_next') OR regexp_matches(path, '\\.(html?|css|js($|[^o])|jso($|[^n])|jpe?g|webp|png|gif|svg|ttf|woff2?|ico|csv|docx?|xlsx?|zip|webmanifest)')) AND NOT starts_with(path, '/api') AND NOT starts_with(path, '/__clerk/') AS skipped,
             starts_with(path, '/signin') OR starts_with(path, '/signup') AS open FROM r)
SELECT page_id, path, signed_in, CASE WHEN skipped OR path = '' THEN NULL WHEN signed_in AND (open OR path = '/') THEN 'redirect:/chat' WHEN NOT open AND NOT signed_in THEN 'protect' ELSE 'pass' END AS decision FROM k
""")
def route_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).withColumn("decision", routes.decision(F.col("path"), F.col("signed_in")))


@_query(f"SELECT page_id, path, CASE path WHEN '/signin' THEN 'Sign In' WHEN '/signup' THEN 'Sign Up' WHEN '/chat' THEN 'Chat' END AS title FROM ({_REQUEST_SQL})")
def route_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.titles(_requests(spark, sf_dir), routes.route_table(spark)).select("page_id", "path", "title")


@_query(f"""
SELECT page_id, entry, url, url = path AS active FROM ({_REQUEST_SQL}) r
JOIN (VALUES ('Sign In', '/signin', true), ('Sign Up', '/signup', true), ('Chat', '/chat', false)) m(entry, url, open) ON open <> signed_in
""")
def route_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.menu(_requests(spark, sf_dir), routes.route_table(spark)).select("page_id", "entry", "url", "active")


@_query(f"""
SELECT page_id, CASE WHEN path = '/' THEN '/signin' ELSE path END AS landing, CASE CASE WHEN path = '/' THEN '/signin' ELSE path END WHEN '/signin' THEN 'Sign In' WHEN '/signup' THEN 'Sign Up' WHEN '/chat' THEN 'Chat' END AS title,
       CASE CASE WHEN path = '/' THEN '/signin' ELSE path END WHEN '/signin' THEN '/signin' WHEN '/signup' THEN '/signup' WHEN '/chat' THEN '/chat' END AS back FROM ({_REQUEST_SQL})
""")
def route_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by path and paths by title, through maps."""
    landing = routes.landing(F.col("path"))
    title = F.try_element_at(routes.route_map("url", "title"), landing)
    return _requests(spark, sf_dir).select("page_id", landing.alias("landing"), title.alias("title"), F.try_element_at(routes.route_map("title", "url"), title).alias("back"))


@_query("SELECT conv_id, count(*) FILTER (WHERE role IN ('user', 'assistant', 'system')) AS known, count(*) FILTER (WHERE length(trim(text)) = 0) AS blank FROM conversations GROUP BY conv_id")
def message_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.count_if(validation.one_of(F.col("role"), validation.ROLES)).alias("known"), F.count_if(validation.blank(F.col("text"))).alias("blank"))


@_query("""
WITH base AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS content, c_nationkey AS owner FROM customer
              UNION ALL SELECT -n_nationkey - 1, n_name, '', n_nationkey FROM nation),
up AS (SELECT b.id, CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_name ELSE b.title END AS title, CASE WHEN s.s_suppkey IS NOT NULL THEN NULL ELSE b.content END AS content, b.owner
       FROM base b LEFT JOIN supplier s ON b.id = s.s_suppkey)
SELECT id, title, content, owner FROM up WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 10)
""")
def record_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of customers after inserts (nations), updates (suppliers) and deletes (small parts)."""
    read = lambda n: tables.parquet(spark, sf_dir, n)
    held = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("content"), F.col("c_nationkey").alias("owner"))
    new = read("nation").select((-F.col("n_nationkey").cast("long") - 1).alias("id"), F.col("n_name").alias("title"), F.lit("").alias("content"), F.col("n_nationkey").alias("owner"))
    changes = read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("content"))
    gone = read("part").where("p_size <= 10").select(F.col("p_partkey").alias("id"))
    return records.delete(records.update(records.insert(held, new), changes, "id", ["title", "content"]), gone, "id")


@_query("""
WITH base AS (SELECT c_custkey AS id, c_name AS title, c_nationkey AS owner FROM customer)
SELECT b.id, coalesce(s.s_name, b.title) AS title, b.owner FROM base b LEFT JOIN supplier s ON b.id = s.s_suppkey AND b.owner = s.s_nationkey
""")
def record_store_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that hold only for the owner of a record."""
    read = lambda n: tables.parquet(spark, sf_dir, n)
    held = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("owner"))
    changes = read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("owner"))
    return records.update(held, changes, "id", ["title"], owner="owner")


@_query("SELECT event_id, coalesce(nullif(event_type, 'click'), 'unknown') AS owner FROM events")
def null_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("owner"))
    filled, _ = records.backfill(rows, "owner", "unknown")
    return records.require(filled, "owner")


@_query("SELECT count(*) AS count FROM events WHERE event_type = 'click'")
def null_backfill_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("click")).alias("owner"))
    return records.backfill(rows, "owner", "unknown")[1]


@_query("SELECT p_brand, p_size, min(p_partkey) FILTER (WHERE contains(p_name, 'ring')) AS match FROM part GROUP BY p_brand, p_size")
def model_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "part").select("p_brand", "p_size", "p_name", "p_partkey", F.col("p_partkey").alias("place"))
    return choice.first_match(rows, ["p_brand", "p_size"], "p_name", "ring", "place", "p_partkey")


@_query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN (o_totalprice + o_custkey) / 2 - 3.0::DOUBLE * power(2, 2) + sqrt(16) END AS result,
       CASE WHEN o_orderkey % 5 = 4 THEN 'Couldn''t evaluate "2 +* ' || o_custkey || '". Is it valid math?' END AS error FROM orders
""")
def tool_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.concat(F.lit("("), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" + "), F.col("o_custkey").cast("string"), F.lit(") / 2 - 3 * 2 ^ 2 + sqrt(16)"))
    bad = F.concat(F.lit("2 +* "), F.col("o_custkey").cast("string"))
    rows = tables.parquet(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 4, bad).otherwise(good).alias("expression"))
    return tools.calculated(rows).select("o_orderkey", "result", "error")


@_query("""
WITH q AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN upper(n_name) || '?' ELSE n_name END AS location FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT n_name, n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT n_nationkey, n_nationkey * 1.5::DOUBLE - 10 AS temperature, n_nationkey % 4 AS code FROM nation WHERE n_nationkey % 6 <> 5)
SELECT s_suppkey, CASE WHEN w.n_nationkey IS NOT NULL THEN n_name || ', ' || r_name END AS place, temperature, CASE WHEN w.n_nationkey IS NOT NULL THEN '°C' END AS unit, code AS weather_code,
       CASE WHEN p.n_nationkey IS NULL THEN 'Couldn''t find "' || location || '". Check the spelling?' WHEN w.n_nationkey IS NULL THEN 'Weather service is unavailable right now.' END AS error
FROM q LEFT JOIN p ON location = n_name LEFT JOIN w ON p.n_nationkey = w.n_nationkey
""")
def tool_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: tables.parquet(spark, sf_dir, n)
    nation = read("nation")
    odd = F.when(F.col("s_suppkey") % 4 == 3, F.concat(F.upper("n_name"), F.lit("?"))).otherwise(F.col("n_name"))
    asked = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", odd.alias("location"))
    places = nation.join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("country"), F.lit(1).alias("rank"), F.col("n_nationkey").alias("place_id"))
    weather = nation.where("n_nationkey % 6 <> 5").select(F.col("n_nationkey").alias("place_id"), (F.col("n_nationkey") * F.lit(1.5) - 10).alias("temperature"), (F.col("n_nationkey") % 4).alias("code"))
    return tools.enriched(asked, places, weather).select("s_suppkey", "place", "temperature", "unit", "weather_code", "error")


@_query("""
WITH b AS (SELECT conv_id, count(*) AS n, conv_id % count(*) AS current FROM conversations GROUP BY conv_id)
SELECT conv_id, n, current, (current - 1 + n) % n AS previous, (current + 1) % n AS next, CASE WHEN n > 1 THEN (current + 1) || ' of ' || n END AS label FROM b
""")
def branch_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "conversations").select("conv_id", "turn")
    return messages.branches(rows, "conv_id", "turn", F.col("conv_id") % F.col("n"))


@_query("""
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE k = conv_id % 3
""")
def branch_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.picked_branch(tables.parquet(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("conv_id") % 3)


@_query("""
SELECT conv_id, turn, CASE conv_id % 5 WHEN 1 THEN 'malformed' WHEN 2 THEN 'model' WHEN 3 THEN 'model' WHEN 4 THEN 'messages' END AS error,
       CASE WHEN conv_id % 5 = 0 THEN 'm' END AS model, CASE WHEN conv_id % 5 = 0 THEN text END AS text FROM conversations
""")
def request_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    listed = F.array(F.struct(F.col("conv_id").cast("string").alias("id"), "role", part.alias("parts")))
    whole, bare = F.to_json(F.struct(listed.alias("messages"), F.lit("m").alias("model"))), F.to_json(F.struct(listed.alias("messages")))
    k = F.col("conv_id") % 5
    body = F.when(k == 0, whole).when(k == 1, F.concat(whole, F.lit("]"))).when(k == 2, bare).when(k == 3, F.concat(F.expr("left(j, length(j) - 1)"), F.lit(',"model":null}'))).otherwise(F.lit('{"model":"m"}'))
    rows = tables.parquet(spark, sf_dir, "conversations").withColumn("j", bare)
    out = rows.select("conv_id", "turn", tables.decoded_request(body).alias("d"))
    return out.select("conv_id", "turn", "d.error", "d.request.model", F.col("d.request.messages")[0]["parts"][0]["text"].alias("text"))


@_query("SELECT conv_id || '.' || turn AS message_id, text, CASE WHEN turn % 3 <> 2 THEN CASE WHEN turn % 2 = 0 THEN 'stop' ELSE 'length' END END AS finish_reason FROM conversations")
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "conversations").withColumn("message_id", F.concat_ws(".", "conv_id", "turn"))
    return chunks.fold(as_chunks(rows))


def as_chunks(rows: DataFrame, size: int = 40) -> DataFrame:
    """Messages (message_id, turn, text) as a stream would bring them: texts of ``size`` characters, then the finish
    of two in three."""
    n = F.ceil(F.length("text") / size).cast("int")
    cut = rows.select("message_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.substr("text", k * size + 1, F.lit(size)))).alias("seq", "text"))
    cut = cut.select("message_id", "seq", F.lit("text").alias("type"), "text", F.lit(None).cast("string").alias("finish_reason"))
    ends = rows.where("turn % 3 <> 2").select("message_id", n.alias("seq"), F.lit("finish").alias("type"), F.lit(None).cast("string").alias("text"), F.when(F.col("turn") % 2 == 0, "stop").otherwise("length").alias("finish_reason"))
    return cut.unionByName(ends)


@_query("""
SELECT event_id, strftime(ts, '%m/%d/%Y, %I:%M %p') AS shown, replace(replace(strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', ':', '-'), '.', '-') AS stamp,
       upper(event_type[1]) || event_type[2:] AS label, floor(value - 50 + 0.5)::BIGINT AS rounded, replace(replace(event_type || ' & ' || user_id, '&', '%26'), ' ', '%20') AS encoded,
       CASE event_type WHEN 'error' THEN 'Error' WHEN 'view' THEN 'Submit' ELSE 'Stop' END AS status FROM events
""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "view", "ready").when(kind == "click", "submitted").otherwise("streaming")
    return tables.parquet(spark, sf_dir, "events").select(
        "event_id", T.display_time(F.col("ts")).alias("shown"), T.file_stamp(F.col("ts")).alias("stamp"), T.role_label(kind).alias("label"),
        T.round_half_up(F.col("value") - 50).alias("rounded"), T.encode_component(F.concat(kind, F.lit(" & "), F.col("user_id").cast("string"))).alias("encoded"), messages.status_label(status).alias("status"),
    )


@_query("""
WITH t AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id)
SELECT user_id, len(ids) AS held, len(list_filter(ids, lambda x: x <> ids[1])) AS after_remove, CASE WHEN user_id % 2 = 0 THEN ids[-2] ELSE ids[-1] END AS last_after_backspace FROM t
""")
def attachment_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), "event_type"))).alias("held"))
    half = lambda p: F.filter("held", lambda x, i: (i < F.size("held") / 2) if p else (i >= F.size("held") / 2))
    held = attachments.append(half(True), half(False))
    typed = F.when(F.col("user_id") % 2 == 0, F.lit("")).otherwise(F.lit("x"))
    return rows.withColumn("all", held).select(
        "user_id", F.size("all").cast("long").alias("held"), F.size(attachments.remove(F.col("all"), F.col("all")[0]["id"])).cast("long").alias("after_remove"),
        F.try_element_at(attachments.pop_last(F.col("all"), typed), F.lit(-1))["id"].alias("last_after_backspace"),
    )


@_query("""
WITH m AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS kinds, count(*) AS n, min(o_orderpriority) AS one FROM orders GROUP BY o_custkey)
SELECT o_custkey, n, len(kinds) AS n_kinds, CASE WHEN len(kinds) = 1 THEN one ELSE 'list' END AS shown FROM m
""")
def field_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("all"))
    seen = validation.shown(F.col("all"))
    return rows.select("o_custkey", F.size("all").cast("long").alias("n"), F.size(F.array_distinct("all")).cast("long").alias("n_kinds"), F.when(F.startswith(seen, F.lit("- ")), "list").otherwise(seen).alias("shown"))


@_query("SELECT event_id, event_type, ts FROM events WHERE user_id = 7")
def owned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "events")
    return records.owned_by(rows, "user_id", F.lit(7)).select("event_id", "event_type", "ts")


@_query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.lookup(tables.parquet(spark, sf_dir, "part"), "p_partkey", F.lit(42)).select("p_partkey", "p_name", "p_size")


@_query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS kinds, 0::BIGINT AS cleared FROM events GROUP BY user_id")
def attachment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments as they are sent, without their ids, and the list after it was cleared."""
    rows = tables.parquet(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), "event_type"))).alias("held"))
    sent = attachments.without_ids(F.col("held"))
    return rows.select("user_id", F.array_join(F.transform(sent, lambda x: x["event_type"]), ",").alias("kinds"), F.size(attachments.clear(F.col("held"))).cast("long").alias("cleared"))


@_query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE 'Sign In' END AS first, 'Chat' AS second, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS third FROM supplier
""")
def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.map_filter(F.create_map(F.lit("/signin"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("own")), F.lit("/more"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name"))), lambda k, v: v.isNotNull())
    rows = tables.parquet(spark, sf_dir, "supplier").withColumn("m", routes.merged(routes.route_map("url", "title"), own))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return rows.select("s_suppkey", at("/signin").alias("first"), at("/chat").alias("second"), at("/more").alias("third"))


@_query("""
SELECT c_custkey, c_nationkey % 4 <> 0 AS success, CASE WHEN c_nationkey % 4 = 0 THEN 'Unauthorized' ELSE c_name END AS message FROM customer
""")
def guarded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "customer")
    done = F.struct(F.lit(True).alias("success"), F.col("c_name").alias("message"))
    return rows.select("c_custkey", records.guarded(F.col("c_nationkey") % 4 != 0, done).alias("r")).select("c_custkey", "r.success", "r.message")


@_query("SELECT n_nationkey AS id, n_name AS name, n_nationkey // 10 AS page FROM nation")
def paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a list that comes in pages of ten."""
    row = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.floor(F.col("n_nationkey") / 10).alias("page"))
    pages = tables.parquet(spark, sf_dir, "nation").groupBy(F.floor(F.col("n_nationkey") / 10).alias("p")).agg(F.collect_list(row).alias("data"))
    return choice.pages_of(pages.withColumn("has_more", F.col("p") < 2))


@_query("""
WITH RECURSIVE s AS (SELECT o_orderkey, o_custkey AS n, 0 AS steps FROM orders UNION ALL SELECT o_orderkey, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END, steps + 1 FROM s WHERE steps < 5 AND n <> 1)
SELECT o_orderkey, arg_max(n, steps) AS n, max(steps) AS steps FROM s GROUP BY o_orderkey
""")
def tool_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop of at most five steps, in which finished rows stay as they are."""
    live = F.col("n") != 1
    after = F.when(F.col("n") % 2 == 0, F.floor(F.col("n") / 2)).otherwise(3 * F.col("n") + 1)
    step = lambda s, k: s.select("o_orderkey", F.when(live, after).otherwise(F.col("n")).alias("n"), (F.col("steps") + live.cast("int")).alias("steps"))
    return tools.bounded_steps(tables.parquet(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("n"), F.lit(0).alias("steps")), step)


@_query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def regenerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user and kind the latest version, as an answer that is generated again replaces the one before."""
    rows = tables.parquet(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("k"), "event_id", "value")
    return chunks.latest_version(rows, "k", "event_id").select("k.user_id", "k.event_type", "event_id", "value")


@_query("SELECT l_orderkey, l_linenumber, (l_quantity + l_linenumber) % 7 AS result FROM lineitem")
def tool_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calculator as it is registered for SQL."""
    tools.register(spark)
    rows = tables.parquet(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.call_function("calc", F.format_string("(%s + %s) %% 7", F.col("l_quantity").cast("string"), F.col("l_linenumber").cast("string"))).alias("result"))


@_query("""
WITH r AS (SELECT event_id, [200, 404, 500, 204, 299][event_id % 5 + 1] AS status, CASE WHEN event_id % 5 = 2 THEN 'oops' ELSE props END AS body FROM events)
SELECT event_id, CASE WHEN status BETWEEN 200 AND 299 THEN CAST(json_extract_string(body, '$.k') AS BIGINT) END AS k,
       CASE WHEN status NOT BETWEEN 200 AND 299 THEN 'API error ' || status END AS message, CASE WHEN status = 404 THEN body END AS error_body FROM r
""")
def response_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    status = F.when(k == 0, 200).when(k == 1, 404).when(k == 2, 500).when(k == 3, 204).otherwise(299)
    rows = tables.parquet(spark, sf_dir, "events").select("event_id", status.alias("status"), F.when(k == 2, F.lit("oops")).otherwise(F.col("props")).alias("body"))
    return tables.fetched(rows, "k bigint").select("event_id", "data.k", "error.message", F.col("error.body").alias("error_body"))


@_query("""
WITH base AS (SELECT c_custkey AS id, c_name AS title, TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM customer
              UNION ALL SELECT -n_nationkey - 1, n_name, TIMESTAMP '2024-02-01 00:00:00', TIMESTAMP '2024-02-01 00:00:00' FROM nation)
SELECT b.id, coalesce(s.s_name, b.title) AS title, b.created_at, CASE WHEN s.s_suppkey IS NOT NULL THEN TIMESTAMP '2024-03-01 00:00:00' ELSE b.updated_at END AS updated_at
FROM base b LEFT JOIN supplier s ON b.id = s.s_suppkey
""")
def record_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creation and update times, given as a parameter on insert and update."""
    read = lambda n: tables.parquet(spark, sf_dir, n)
    at = lambda month: F.lit(f"2024-{month:02d}-01 00:00:00").cast("timestamp_ntz")
    held = records.stamped(read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), at(1))
    new = records.stamped(read("nation").select((-F.col("n_nationkey").cast("long") - 1).alias("id"), F.col("n_name").alias("title")), at(2))
    changes = read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    return records.touched(records.update(records.insert(held, new), changes, "id", ["title"]), changes, "id", at(3))
