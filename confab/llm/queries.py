"""The queries of this subpackage and, where SQL can express them, their SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, license_scan, mixing, near_dup, neighbours, quality, suffix_dedup, token_count, toxicity
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start_word", "end_word", "first", F.array_min("first_doc_ids").alias("first_doc_id"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: source and id are taken for one, with a hundred documents to a directory."""
    i = F.col("doc_id")
    path = F.concat_ws("/", "source", F.floor(i / 10_000).cast("string"), F.floor(i / 100).cast("string"), i.cast("string"))
    return license_scan.scan(table(spark, sf_dir, "documents").withColumn("path", path))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = [op1_quality, op2_toxicity, op3_nearest, op4_token_counts, op5_repeated_passages, op6_near_duplicates, op7_license_scan, op8_bpe_round_trip, op9_mixing, op10_fingerprints]
    return {f.__name__: f for f in own}


#: Windows of 50 words, and islands of those that stand in several documents.
OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT doc_id, k, md5(array_to_string(ws[k + 1 : k + 50], ' ')) AS h FROM w, unnest(range(0, greatest(len(ws) - 49, 0))) t(k)),
g AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
f AS (SELECT doc_id, k, lo, lo = doc_id AS first FROM win JOIN g USING (h)),
i AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id, first ORDER BY k) <= 50 THEN 0 ELSE 1 END AS fresh FROM f),
j AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, first ORDER BY k) AS island FROM i)
SELECT doc_id, CAST(min(k) AS INTEGER) AS start_word, CAST(max(k) + 50 AS INTEGER) AS end_word, first, min(lo) AS first_doc_id FROM j GROUP BY doc_id, first, island
"""

#: All pairs that share a shingle, and components by spreading the least id.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS sh FROM w, unnest(range(1, greatest(len(ws), 2))) t(i) WHERE len(ws) >= 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
r(doc_id, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.comp FROM r JOIN e ON e.x = r.doc_id WHERE r.comp < e.y),
c AS (SELECT doc_id, min(comp) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: models, an approximate index, tokenizers, hashes of the engine, cosines over lines. Tests
    hold them against brute force (the index by its recall), libraries or held-out labels."""
    return {"op5_repeated_passages": OP5_SQL, "op6_near_duplicates": OP6_SQL}
