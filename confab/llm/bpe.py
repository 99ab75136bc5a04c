"""Byte-level BPE encoding and decoding through the tiktoken library and a local rank file."""
from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_mapper

#: Texts longer than this are cut at safe boundaries into pieces of about this many code points.
PIECE_CHARS = 1 << 16
#: A token of the split pattern never holds a non-space followed by white space, and the pattern
#: looks only forward, so between the two a text can be cut without changing any match.
_BOUNDARY = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \t\n\r\f\v])")
#: White space, as the split pattern's library has it; runs of so many are cut out before, as its stack grows with them.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 4096
_RUN = re.compile(f"[{_SPACES}]{{{LONG_RUN},}}")


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` cut at safe boundaries. A piece exceeds ``size`` only up to its next boundary."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        m = _BOUNDARY.search(text, start + size)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """Built once a Python worker. ``rank_file``: base64 token and rank on each line."""
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def long_runs(text: str) -> list[tuple[str, bool]]:
    """``text`` in parts, each with whether it is a long run of white space that is one match of the split pattern: all
    of a run at the end of the text, elsewhere all but its last character, which goes with what follows."""
    if len(text) < LONG_RUN:
        return [(text, False)]
    out, at = [], 0
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += [(text[at : m.start()], False), (text[m.start() : end], True)]
        at = end
    return [*out, (text[at:], False)]


def encode_text(enc: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """Ids of the whole text as little-endian unsigned 32-bit integers."""
    parts = []
    for part, run in long_runs(text or ""):
        if run:
            parts.append(np.asarray(enc._encode_single_piece(part), dtype="<u4"))
        else:
            parts += [np.asarray(enc.encode_ordinary(p), dtype="<u4") for p in pieces(part)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode_ids(enc: tiktoken.Encoding, ids) -> bytes:
    return enc.decode_bytes([int(i) for i in ids] if not isinstance(ids, np.ndarray) else ids.tolist())


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row. Null text counts as empty and gives an empty array; a null id
    stays null; repeated rows give repeated rows; other columns are not read. No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def make():
        enc = encoding(rank_file, pattern)
        return lambda r: [(r[0], encode_text(enc, r[1]).astype(np.int32))]

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(row_mapper(make, ("i", "t"), schema), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids): the exact bytes, also where ids cut a character. Null ids
    count as none."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def make():
        enc = encoding(rank_file, pattern)
        return lambda r: [(r[0], decode_ids(enc, r[1] or []))]

    source = encoded.select(F.col("doc_id").alias("i"), F.col("ids").alias("x"))
    return source.mapInArrow(row_mapper(make, ("i", "x"), schema), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256). Same rules as encode()."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def make():
        enc = encoding(rank_file, pattern)

        def row(r):
            ids = encode_text(enc, r[1])
            back = decode_ids(enc, ids)
            return [(r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest())]

        return row

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(row_mapper(make, ("i", "t"), schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, source, ids, n_tokens, decoded_sha256) for each row of docs, in one pass; same rules as encode()."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("decoded_sha256", pa.string())])

    def make():
        enc = encoding(rank_file, pattern)

        def row(r):
            ids = encode_text(enc, r[2])
            return [(r[0], r[1], ids.astype(np.int32), len(ids), hashlib.sha256(decode_ids(enc, ids)).hexdigest())]

        return row

    source = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("source").cast("string").alias("s"), F.col("text").cast("string").alias("t"))
    return source.mapInArrow(row_mapper(make, ("i", "s", "t"), schema), "doc_id long, source string, ids array<int>, n_tokens long, decoded_sha256 string")
