"""Passages that repeat across documents, found by sorting sparse suffixes that are kept at minimiser positions."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, lean, row_mapper, rows_of, stored
from .words import Spans, WordHash, words_of

#: Words of the grams among which the minimiser of a window of ``least`` words is chosen.
GRAM = 16
#: Contexts of one gram that are sorted in one task. Grams that have more, such as those at the edges of a passage that
#: very many documents hold, are compared window by window in sums that combine before rows are exchanged.
SORTED = 4096
#: Suffixes that are sorted at once: those of whole grams, up to a gram more.
CHUNK = 16_384
#: Texts that a task remembers to have read.
SEEN = 100_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sparse_suffixes(words: list[bytes], least: int, gram: int, hashes: WordHash) -> tuple[np.ndarray, ...]:
    """The retained suffixes of a text: (gram, context, start, windows, left).

    Every window of ``least`` words picks the smallest hash among its grams (the leftmost of equals); windows in a row
    that pick the same gram belong to one suffix, which begins at that gram. ``gram`` is the picked hash, ``context``
    the hash of all words that these windows cover, ``start`` the first window, ``windows`` their number, ``left`` the
    words before the gram that they cover. What is picked depends on the window's words alone, so equal windows pick
    equal grams wherever they stand.
    """
    if len(words) < least:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    spans = Spans(words, hashes)
    at = np.arange(len(words) - gram + 1)
    grams = spans.of(at, at + gram)
    wide = least - gram + 1
    pick = np.empty(len(grams) - wide + 1, np.int64)
    for k in range(0, len(pick), 1 << 16):
        view = sliding_window_view(grams[k : k + (1 << 16) + wide - 1], wide)
        pick[k : k + len(view)] = view.argmin(axis=1) + np.arange(k, k + len(view))
    first = np.concatenate([[0], np.flatnonzero(np.diff(pick)) + 1])
    count = np.diff(np.concatenate([first, [len(pick)]]))
    return grams[pick[first]], spans.of(first, first + count - 1 + least), first, count, pick[first] - first


def _suffix_table(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(gram, context, doc_id, text_hash, starts, windows, left) of all documents, about two suffixes in
    (least - gram + 2) words. A text that repeats its words, as a line that stands in it again and again, has suffixes of
    one context at every repeat: they are one row, with all their starts in order."""
    fields = [("gram", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("starts", pa.list_(pa.int32())), ("windows", pa.int32()), ("left", pa.int32())]
    schema = pa.schema(fields)

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                part, made = batch.slice(at, 64), []
                for i, t, x in rows_of(part, "i", "t", "x"):
                    g, c, s, w, left = sparse_suffixes(words_of(t), least, gram, hashes)
                    made.append((np.full(len(g), len(made)), g.view(np.int64), c.view(np.int64), np.full(len(g), i, np.int64), np.full(len(g), x, np.int64), *(v.astype(np.int32) for v in (s, w, left))))
                columns = [np.concatenate(x) for x in zip(*made, strict=True)]
                order = np.lexsort(columns[2::-1])
                row, g, c, i, x, s, w, left = (v[order] for v in columns)
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1]) | (c[1:] != c[:-1])])[: len(row)])
                starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(s))
                yield pa.RecordBatch.from_arrays([*(pa.array(v[new]) for v in (g, c, i, x)), starts, *(pa.array(v[new]) for v in (w, left))], schema=schema)

    return docs.select("i", "t", "x").mapInArrow(run, "gram long, context long, doc_id long, text_hash long, starts array<int>, windows int, left int")


def _with_texts(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(i, x, t, at): texts with the contexts (gram, context, at, lo, hi) that are to be read from them."""
    each = F.struct("gram", "context", "lo", "hi", F.col("at.start").alias("start"), F.col("at.windows").alias("windows"), F.col("at.left").alias("left"))
    wanted = contexts.groupBy(F.col("at.doc_id").alias("i"), F.col("at.text_hash").alias("x")).agg(F.collect_list(each).alias("at"))
    return docs.join(wanted, ["i", "x"]).select("i", "x", "t", "at")


def _once(row):
    """row, but for rows (i, x, ...) that the task has just seen: what is repeated in full is read once a task."""
    seen: set[tuple[int, int]] = set()

    def first(r):
        if r[:2] in seen:
            return []
        if len(seen) >= SEEN:
            seen.clear()
        seen.add(r[:2])
        return row(*r[2:])

    return first


def _context_words(docs: DataFrame, contexts: DataFrame, least: int) -> DataFrame:
    """(gram, context, lo, hi, windows, left, words): the contexts with their words, from the documents' texts."""
    schema = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("windows", pa.int32()), ("left", pa.int32()), ("words", pa.binary())])

    def make():
        def row(text, contexts):
            words = words_of(text)
            for x in contexts:
                some = b" ".join(words[x["start"] : x["start"] + x["windows"] - 1 + least])
                yield x["gram"], x["context"], x["lo"], x["hi"], x["windows"], x["left"], some

        return _once(row)

    return _with_texts(docs, contexts).mapInArrow(row_mapper(make, ("i", "x", "t", "at"), schema), "gram long, context long, lo long, hi long, windows int, left int, words binary")


def _window_table(docs: DataFrame, contexts: DataFrame, least: int) -> DataFrame:
    """(gram, context, k, window, lo, hi): the hash of window k of each context, from the documents' texts."""
    schema = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("k", pa.int32()), ("window", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def make():
        hashes = WordHash()

        def row(text, contexts):
            spans = Spans(words_of(text), hashes)
            for x in contexts:
                start = np.arange(x["start"], x["start"] + x["windows"])
                for k, h in enumerate(spans.of(start, start + least).view(np.int64).tolist()):
                    yield x["gram"], x["context"], k, h, x["lo"], x["hi"]

        return _once(row)

    return _with_texts(docs, contexts).mapInArrow(row_mapper(make, ("i", "x", "t", "at"), schema), "gram long, context long, k int, window long, lo long, hi long")


def _order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows sorted by their words, one after the other, and the number of words that each shares with the row
    before it."""
    raw = np.ascontiguousarray(words.astype(">u4"))
    raw = [r.tobytes() for r in raw]
    order = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
    other = words[order[1:]] != words[order[:-1]]
    common = np.where(other.any(axis=1), other.argmax(axis=1), words.shape[1]) if words.shape[1] else np.zeros(len(order) - 1, np.int64)
    return order, np.concatenate([[0], common])


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row the number of the run of the sorted rows that share the first ``depth`` words."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def matched_windows(contexts: list[list[bytes]], left: np.ndarray, windows: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, k, first): windows of the contexts that stand in several documents, with the least that holds them.

    ``left`` words of a context stand before its gram. The suffixes, from the grams on, are sorted, and so are the words
    before them, read backwards; neighbours in the two orders are compared word by word. A window that begins ``a``
    words before the gram is extended to the left over a, and to the right over least - a words: it is shared by the
    rows that are in one run of neighbours with that many words in common in both orders.
    """
    n, ids = len(contexts), {}
    number = lambda w: ids.setdefault(w, len(ids) + 1)
    most = int(left.max(initial=0))
    right_of, left_of = np.zeros((n, least), np.uint32), np.zeros((n, most), np.uint32)
    for r, words in enumerate(contexts):
        own = list(map(number, words))
        m = int(left[r])
        right_of[r, : len(own) - m] = own[m : m + least]
        left_of[r, :m] = own[:m][::-1]
    by_right, by_left = _order(right_of), _order(left_of)
    for a in range(most + 1):
        rows = np.flatnonzero((a <= left) & (a > left - windows))
        if not len(rows):
            continue
        both = _classes(*by_right, least - a)[rows] * (n + 1) + _classes(*by_left, a)[rows]
        kinds, kind = np.unique(both, return_inverse=True)
        first, last = np.full(len(kinds), np.iinfo(np.int64).max), np.full(len(kinds), np.iinfo(np.int64).min)
        np.minimum.at(first, kind, lo[rows])
        np.maximum.at(last, kind, hi[rows])
        hit = (first < last)[kind]
        yield from zip(rows[hit].tolist(), (left[rows[hit]] - a).tolist(), first[kind[hit]].tolist(), strict=True)


def _sorted_matches(contexts: DataFrame, least: int) -> DataFrame:
    """(gram, context, part): the windows k of each context that repeat, part array<struct<k, first>>. Contexts come
    dealt out by gram, those of a gram one after the other; a task sorts CHUNK of them at a time."""
    schema = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("part", pa.list_(pa.struct([("k", pa.int32()), ("first", pa.int64())])))])
    names = ("gram", "context", "lo", "hi", "windows", "left", "words")

    def matched(held: list[tuple]) -> Iterator[tuple]:
        numbers = [np.array([r[k] for r in held], np.int64) for k in (5, 4, 2, 3)]
        found: dict[int, list[dict]] = {}
        for row, k, first in matched_windows([r[6].split(b" ") for r in held], *numbers, least):
            found.setdefault(row, []).append({"k": k, "first": first})
        for row, part in found.items():
            yield held[row][0], held[row][1], part

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in it:
            for r in rows_of(batch, *names):
                if held and r[:2] == held[-1][:2]:
                    continue
                if len(held) >= CHUNK and r[0] != held[-1][0]:
                    yield from batches(matched(held), schema)
                    held = []
                held.append(r)
        if held:
            yield from batches(matched(held), schema)

    dealt = contexts.repartition("gram").sortWithinPartitions("gram", "context")
    return dealt.select(*names).mapInArrow(run, "gram long, context long, part array<struct<k:int,first:bigint>>")


def repeated_windows(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc_id, text_hash, starts, windows, first, part): contexts of each document with windows of ``least`` words that
    stand in other documents too, from each start on: where part is null, all ``windows``, and ``first`` is the least
    document that holds them; else the windows k of part, array<struct<k, first>>.

    A suffix is kept where windows pick their minimiser, with the words that these windows cover for its context. Equal
    contexts are combined before rows are exchanged, so a passage in very many documents costs a row a task. A gram that
    only one document holds has no repeat, and where all suffixes of a gram have the same context, this repeats as a
    whole. The other contexts are read again from one text each, sorted and compared with their neighbours, and matches
    are extended left and right on their words (matched_windows). Grams of more than SORTED contexts have their windows
    compared by hash instead, with the same result: no group of occurrences is brought together. What is found meets one
    row of each document that holds the context, however often the document repeats it.
    """
    suffixes = stored(_suffix_table(docs, least, gram))
    place = F.min(F.struct("doc_id", "text_hash", F.col("starts")[0].alias("start"), "windows", "left")).alias("at")
    contexts = suffixes.groupBy("gram", "context").agg(place, F.max("doc_id").alias("hi"))
    contexts = contexts.select("gram", "context", "at", F.col("at.doc_id").alias("lo"), "hi")
    grams = contexts.groupBy("gram").agg(F.min("lo").alias("g_lo"), F.max("hi").alias("g_hi"), F.count("*").alias("kinds")).where("g_lo < g_hi").select("gram", "kinds")
    contexts = stored(contexts.join(grams, "gram"))

    array = "array<struct<k:int,first:bigint>>"
    whole = contexts.where("kinds = 1").select("gram", "context", F.lit(None).cast(array).alias("part"), F.col("lo").alias("first"))
    some = _sorted_matches(_context_words(docs, contexts.where(F.col("kinds").between(2, SORTED)), least), least)
    found = whole.unionByName(some.withColumn("first", F.lit(None).cast("long")))
    many = contexts.where(F.col("kinds") > SORTED)
    if not many.isEmpty():
        windows = stored(_window_table(docs, many, least))
        shared = windows.groupBy("gram", "window").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last").select("gram", "window", "first")
        part = windows.join(shared, ["gram", "window"]).groupBy("gram", "context").agg(F.collect_list(F.struct("k", "first")).alias("part"))
        found = found.unionByName(part.withColumn("first", F.lit(None).cast("long")))

    return suffixes.join(found, ["gram", "context"]).select("doc_id", "text_hash", "starts", "windows", "first", "part")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeated_passages(docs: DataFrame, least: int = 50, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, first, first_doc_ids, text_hash): maximal spans of words, extended left and right
    as far as windows of ``least`` words repeat in documents of other ids.

    ``first`` tells the document with the least id that holds the passage (its copy stays) from the others (theirs
    go). first_doc_ids: the least documents that hold the span's windows, for a first span the document itself. Words
    stand between ASCII white space and are compared byte by byte. A document that repeats itself does not count, nor
    do rows that share an id; where their texts differ, text_hash (Spark's xxhash64 of the text) tells them apart, and
    rows repeated in full have their spans once. Null, empty and shorter texts and rows with a null id have no spans. An
    empty table gives an empty result; other columns are not read.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    held = repeated_windows(source.withColumn("x", F.xxhash64("t")), least, gram)
    by_doc = held.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("starts", "windows", "first", "part")).alias("held"))
    schema = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("first", pa.bool_()), ("first_doc_ids", pa.list_(pa.int64())), ("text_hash", pa.int64())])

    def make():
        def row(r):
            spans = []
            for x in r[2]:
                each = [(0, x["windows"], x["first"])] if x["part"] is None else [(y["k"], 1, y["first"]) for y in x["part"]]
                spans += [(s + k, s + k + n - 1 + least, first_doc) for s in x["starts"] for k, n, first_doc in each]
            spans.sort()
            for first in (True, False):
                own = [x for x in spans if (x[2] == r[0]) == first]
                at = 0
                for s, e in _merged([x[:2] for x in own]):
                    ids = set()
                    while at < len(own) and own[at][0] < e:
                        ids.add(own[at][2])
                        at += 1
                    yield r[0], s, e, first, sorted(ids), r[1]

        return row

    return by_doc.mapInArrow(row_mapper(make, ("doc_id", "text_hash", "held"), schema), "doc_id long, start_word int, end_word int, first boolean, first_doc_ids array<long>, text_hash long")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans [start, end) and the white space after them."""
    raw, out, at = text.encode(), [], 0
    starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    for s, e in _merged(spans):
        out.append(raw[at : starts[s]])
        at = starts[e]
    out.append(raw[at:])
    return b"".join(out).decode()


def drop_repeats(docs: DataFrame, least: int = 50, gram: int = GRAM) -> DataFrame:
    """docs without the passages that an earlier document holds too; n_chars follows. A document of which nothing
    is left goes; one without repeats stays as it is, also with a null id or text. Rows repeated in full are cut alike,
    rows that share an id each by the spans of its own text."""
    gone = repeated_passages(docs, least, gram).where("NOT first")
    spans = F.collect_list(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("_confab_g_spans")
    gone = stored(gone.groupBy(F.col("doc_id").alias("_confab_g_id"), F.col("text_hash").alias("_confab_g_hash")).agg(spans))
    same = (F.col("doc_id") == F.col("_confab_g_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_confab_g_hash"))
    rows = docs.join(gone, same, "left").drop("_confab_g_id", "_confab_g_hash")

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            where = batch.schema.get_field_index("text")
            texts = batch.column(where).to_pylist()
            spans = batch.column(batch.schema.get_field_index("_confab_g_spans")).to_pylist()
            keep = []
            for k, (t, x) in enumerate(zip(texts, spans, strict=True)):
                if x and t:
                    texts[k] = cut_words(t, [(y["s"], y["e"]) for y in x])
                keep.append(not x or bool(texts[k] and texts[k].strip()))
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names if n != "_confab_g_spans"}
            columns["text"] = pa.array(texts, batch.schema.field(where).type)
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(t) if x and t else o for t, x, o in zip(texts, spans, old, strict=True)], pa.int64())
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(keep))

    return rows.mapInArrow(run, docs.schema)
