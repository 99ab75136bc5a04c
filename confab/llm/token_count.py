"""Token counts by a two-tier lookup: a broadcast table of frequent pre-tokens, worker caches for the rest."""
from __future__ import annotations

import functools
import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import pieces
from .common import bounded_sample, row_mapper, stored

#: Rows, and bytes of their texts, from which the frequent pre-tokens are counted. Only speed depends on it, no result.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 8 << 20
#: Entries of the broadcast table and the longest pre-token in it, which together bound its size.
FREQUENT, FREQUENT_CHARS = 40_000, 32
#: A worker's cache of other pre-tokens is emptied when it holds this many.
CACHE = 300_000
#: Ranges in which the classes of this regex library and of the tokenizer's may come from different
#: Unicode versions; a piece with such characters is encoded by the tokenizer itself.
_VERSIONED = re.compile("[԰-࿿⁰-₟Ꟁ-꯿힤-\U0010ffff]")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Lengths(dict):
    """Tokens of a pre-token. The frequent ones are there from the start; others are encoded when first met."""

    def __init__(self, tok: Tokenizer, frequent: dict[str, int], cache: int = CACHE):
        super().__init__(frequent)
        self.tok, self.frequent, self.cache = tok, frequent, cache

    def __missing__(self, token: str) -> int:
        n = len(self.tok.encode(token, add_special_tokens=False).ids)
        if len(self) >= len(self.frequent) + self.cache:
            self.clear()
            self.update(self.frequent)
        if len(token) <= 256:
            self[token] = n
        return n


def count_text(text: str, lengths: Lengths, split: regex.Pattern, specials: re.Pattern | None) -> int:
    """Tokens of a whole text; special strings in it count one each, as the library does by default."""
    segments = specials.split(text) if specials else [text]
    n = len(segments) - 1
    get = lengths.__getitem__
    for segment in segments:
        for piece in pieces(segment):
            if not piece:
                continue
            if not piece.isascii() and _VERSIONED.search(piece):
                n += len(lengths.tok.encode(piece, add_special_tokens=False).ids)
            else:
                n += sum(map(get, split.findall(piece)))
    return n


def specials_of(tok: Tokenizer) -> re.Pattern | None:
    found = [t.content for t in tok.get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, sorted(found, key=len, reverse=True)))) if found else None


def frequent_lengths(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a sample of at most SAMPLE_ROWS rows and SAMPLE_BYTES. Rows are chosen
    by id, so no text is read for that, and their texts are kept; the bound of bytes is then kept within these. Each
    task counts for itself and sends a bounded head of its counts; pre-tokens are not shuffled."""
    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    sample = stored(bounded_sample(source, F.col("i"), F.lit(1), SAMPLE_ROWS))
    sample = bounded_sample(sample, F.xxhash64("i", "t"), F.octet_length("t"), SAMPLE_BYTES)
    schema = pa.schema([("token", pa.string()), ("n", pa.int64())])

    def count(it):
        split, seen = regex.compile(pattern), Counter()
        for batch in it:
            for t in batch.column(0).to_pylist():
                for piece in pieces(t or ""):
                    seen.update(x for x in split.findall(piece) if len(x) <= FREQUENT_CHARS)
        head = seen.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in head], pa.string()), pa.array([v for _, v in head], pa.int64())], schema=schema)

    total: Counter = Counter()
    for r in sample.select("t").mapInArrow(count, "token string, n long").collect():
        total[r.token] += r.n
    tok = tokenizer(path)
    return {k: len(tok.encode(k, add_special_tokens=False).ids) for k, _ in total.most_common(FREQUENT)}


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row. Null text counts as empty: 0 bytes, 0 tokens. A null
    id stays null; repeated rows give repeated rows; other columns are not read."""
    source = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    known = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, pattern, id_col, text_col))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def make():
        tok = tokenizer(path)
        lengths, split, specials = Lengths(tok, known.value), regex.compile(pattern), specials_of(tok)

        def row(r):
            n = count_text(r[1], lengths, split, specials)
            return [(r[0], len(r[1].encode()), n, n > limit)]

        return row

    return source.mapInArrow(row_mapper(make, ("i", "t"), schema), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
