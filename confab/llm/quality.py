"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts."""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import bounded_sample, lean, row_mapper, rows_of, stored

#: Labelled rows of each class from which the trees are grown, at most. Documented bound of the training sample.
SAMPLE_ROWS = 8_000
#: Statistics of a text, in the order in which statistics() gives them.
FEATURES = ("log_chars", "log_words", "mean_word", "sd_word", "upper", "letters", "digits", "spaces", "marks", "symbols", "bangs", "pipes", "distinct_words", "top_word", "top5_words", "repeats", "distinct_pairs", "lines", "mean_line", "same_lines", "line_ends", "sentence_ends", "squeezed", "long_words", "one_char_words", "marked_words", "capital_words", "licence_like")
_UPPER, _LETTER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_]"), re.compile(r"\d")
_SYMBOL, _MARKED = re.compile(r"[#$%&*+/<=>@\\^_`{|}~\[\]]"), re.compile(r"[!#$%&*+=@^~]{2,}(?=\s|$)")
_NOTICE = re.compile(r"licen[cs]e|copyright|all rights reserved|cookie|subscribe|click here", re.I)
#: Texts are squeezed a block at a time.
_BLOCK = 1 << 20


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text, in any language. An empty or null text gives zeros."""
    text = text or ""
    n = len(text)
    words = text.split()
    if not n or not words:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    m = len(words)
    lengths = np.fromiter(map(len, words), np.float64, m)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(5)]
    pairs = len(set(zip(words, words[1:], strict=False))) if m > 1 else 1
    adjacent = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode()
    squeezed = sum(len(zlib.compress(raw[at : at + _BLOCK], 1)) for at in range(0, len(raw), _BLOCK))
    upper, letters, digits = len(_UPPER.findall(text)), len(_LETTER.findall(text)), len(_DIGIT.findall(text))
    ends = text.count(".") + text.count("!") + text.count("?")
    commas = text.count(",") + text.count(";") + text.count(":")
    symbols = len(_SYMBOL.findall(text))
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(lengths.mean()), float(lengths.std()), upper / max(letters, 1), letters / n, digits / n,
        (n - float(lengths.sum())) / n, (ends + commas) / m, symbols / n, text.count("!") / m, text.count("|") / m, len(counts) / m, top[0] / m, sum(top) / m,
        adjacent / m, pairs / max(m - 1, 1), len(lines) / m, m / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(len(lines), 1), ends / m, squeezed / len(raw), float((lengths > 20).mean()), float((lengths == 1).mean()),
        len(_MARKED.findall(text)) / m, sum(map(str.isupper, words)) / m, len(_NOTICE.findall(text)) / m,
    ]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1. Null ids are not held out; no label can belong to them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, most: int) -> DataFrame:
    """(doc_id, text, y) of the documents of at most ``most`` labelled ids a class, none of them held out. Labels of one
    id count once (the largest); labels other than 0 and 1 and null ids are left aside. The chosen labels are bounded, so
    they are broadcast, and no text is shuffled."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = bounded_sample(known, F.col("l_id"), F.lit(1), most, by="y")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = SAMPLE_ROWS) -> boosting.Forest:
    """Trees from at most ``most`` labelled rows a class, also where many rows share a labelled id. Statistics are made
    on the executors, all at once; only numbers travel."""
    rows = training_rows(docs, labels, label_col, most)
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])
    made = stored(rows.mapInArrow(row_mapper(lambda: lambda r: [(r[0], r[2], statistics(r[1]))], ("doc_id", "text", "y"), schema), "doc_id long, y int, x array<double>"))
    made = bounded_sample(made, F.hash("doc_id", "x"), F.lit(1), most, by="y")
    got = sorted(((r.doc_id, r.y, tuple(r.x)) for r in made.collect()))
    x = np.array([r[2] for r in got], float).reshape(len(got), len(FEATURES))
    return boosting.fit(x, np.array([r[1] for r in got], float))


def score(docs: DataFrame, forest: boosting.Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): likelihood of label 1, from the text alone. Null text counts as empty; a null id stays null;
    repeated rows give repeated rows; other columns are not read. No shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(forest)

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [(i, statistics(t)) for i, t in rows_of(batch, "i", "t")]
            if got:
                s = known.value.score(np.array([x for _, x in got]))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array(s)], ["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, forest: boosting.Forest, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores ``least`` or more, with all their columns, in one pass."""
    known = docs.sparkSession.sparkContext.broadcast(forest)

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                s = known.value.score(np.array([statistics(t) for (t,) in rows_of(batch, "text")]))
                yield batch.filter(pa.array(s >= least))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.5, most: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; see train() and score(). An empty table gives an
    empty result; without usable labels every score is 0.5."""
    out = score(docs, train(docs, labels, label_col, most))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
