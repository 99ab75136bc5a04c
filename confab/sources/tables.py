"""Reading and writing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST = "messages array<struct<id:string,role:string,parts:array<struct<type:string,text:string>>>>, model string"
MODEL_PAGE = "data array<struct<type:string,id:string,display_name:string,created_at:string,max_input_tokens:bigint,max_tokens:bigint,capabilities:map<string,string>>>, has_more boolean, first_id string, last_id string"
NOTE = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("title", T.StringType(), False), T.StructField("content", T.StringType(), False),
    T.StructField("createdAt", T.TimestampNTZType(), False), T.StructField("updatedAt", T.TimestampNTZType(), False), T.StructField("createdBy", T.StringType(), False),
])


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database. Filters and columns are pushed to it; split large tables with partitionColumn,
    lowerBound, upperBound and numPartitions. Needs the driver's jar on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def json_snapshot(spark: SparkSession, path: str, schema: str = MODEL_PAGE) -> DataFrame:
    """Captured responses, one JSON value a line; a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def fetched(rows: DataFrame, schema: str, status: str = "status", body: str = "body") -> DataFrame:
    """rows of captured responses with data, the decoded body of a response of 200 to 299, and for any other error, a
    struct<message, status, body>: the body where it is JSON, else null."""
    fine = F.col(status).between(200, 299)
    sound = F.when(F.try_parse_json(F.col(body)).isNotNull(), F.col(body))
    error = F.struct(F.concat(F.lit("API error "), F.col(status).cast("string")).alias("message"), F.col(status).alias("status"), sound.alias("body"))
    return rows.withColumn("data", F.when(fine, F.from_json(F.col(body), schema))).withColumn("error", F.when(~fine, error))


def decoded_request(body: Column, schema: str = REQUEST) -> Column:
    """struct<request, error>: a body of messages and a model, or what is wrong with it. Elements of messages are not
    checked."""
    got = F.from_json(body, schema)
    # The parser stops after the first value; as the first of exactly two elements nothing can follow the body unseen.
    sound = F.try_parse_json(F.concat(F.lit("["), body, F.lit(",0]")))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(sound, path, "variant"))
    error = (
        F.when(sound.isNull() | kind("$[1]").isNull() | kind("$[2]").isNotNull(), "malformed")
        .when(~F.coalesce(F.startswith(kind("$[0].messages"), F.lit("ARRAY")), F.lit(False)), "messages")
        .when(F.coalesce(kind("$[0].model"), F.lit("")) != "STRING", "model")
    )
    return F.struct(F.when(error.isNull(), got).alias("request"), error.alias("error"))


def strict_request(body: Column) -> Column:
    """The request; an invalid body fails the query."""
    d = decoded_request(body)
    return F.when(d["error"].isNotNull(), F.raise_error(F.concat(F.lit("invalid request: "), d["error"]))).otherwise(d["request"])


def prompt_text(provided: Column, form: Column) -> Column:
    return F.coalesce(provided, form, F.lit(""))


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    """Markdown as text files, one line break group a conversation; the order of conversations is not kept."""
    transcripts.select("markdown").write.mode("overwrite").text(path, lineSep="\n\n")


def write_snapshot(records: DataFrame, path: str) -> None:
    """A new snapshot beside the old one; Parquet has no update in place, so readers are pointed to it afterwards."""
    records.write.mode("errorifexists").parquet(path)
