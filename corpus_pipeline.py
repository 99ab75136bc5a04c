"""From raw documents to token ids: what is bad, near-equal or repeated goes, sources are mixed, texts encoded."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from confab.llm import bpe, mixing, near_dup, quality, suffix_dedup
from confab.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from labelled rows of these documents. Null text counts
    as empty; without usable labels all score 0.5 and stay. A row with a null id has no label and is scored like others;
    repeated rows have equal scores. All columns pass through, whatever their names. An empty table stays empty."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8: the one with the least id. Null,
    empty and wordless texts and rows with a null id link with nothing and stay; rows repeated in full stay once; rows
    that share an id with other texts are judged by their own text. Other columns pass through; an empty table stays
    empty."""
    return near_dup.one_of_each(docs, shingle=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the document of the least id that holds them and go from the others; n_chars
    follows, and a document of which nothing is left goes. Null, empty and shorter texts and rows with a null id stay as
    they are; rows that share an id do not repeat each other and are each cut by their own text. Other columns pass
    through; an empty table stays empty."""
    return suffix_dedup.drop_repeats(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, up to three times. Null, empty and wordless texts are no
    words of any target and go; a null source is a source, last in order; a null id is an id; rows repeated in full are
    taken alike. All columns pass through; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, n_tokens, decoded_sha256) of each row. Null text counts as empty: no ids. Null ids and
    sources stay null, repeated rows give repeated rows, other columns are not read; an empty table stays empty."""
    return bpe.encoded_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: SQL has no boosted trees, Pareto ranks by the engine's hash, or byte-level BPE; tests compare each stage with a
#: brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
