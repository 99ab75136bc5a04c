"""Document fingerprints by consistent weighted sampling, in DataFrame operations only."""
from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a fingerprint. Each weighted term falls in one bin; the bin keeps one consistent sample.
BINS = 128
#: A term's weight is cut into parts of at most this much, so that a heavy term does not weigh in one bin only.
PART = 2
#: Ranges of document ids between which whole texts are dealt out to find each one's neighbour: one for so many rows, at
#: least and at most so many, as their bounds are held by the driver. Beyond RANGE_ROWS * MOST_RANGES rows (131 million)
#: ranges grow with the table. Partitions hold about so many ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES, RANGES_A_PARTITION = 2000, 512, 1 << 16, 16
_SPACE = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """array<struct<t, w>>: the distinct words of a text and how often each occurs.

    The words are sorted, so equal ones stand together, and one expression with a back reference cuts the sorted
    line into runs; a run's weight is its length over that of its word.
    """
    line = F.array_join(F.sort_array(F.filter(F.split(text, _SPACE), lambda w: w != "")), " ")
    runs = F.regexp_extract_all(line, F.lit(r"([^ ]++)(?: \1(?![^ ]))*+"), F.lit(0))
    word = lambda r: F.substring_index(r, " ", 1)
    return F.transform(runs, lambda r: F.struct(word(r).alias("t"), ((F.length(r) + 1) / (F.length(word(r)) + 1)).alias("w")))


def parts(text: Column) -> Column:
    """array<struct<h, w>>: the terms with their weights cut into [0, 2), [2, 4), ... and a hash of term and part, so the
    samples are only ever drawn for weights of 1 and 2.

    Sums of smaller and of larger weights are the sums over the parts, so the generalised Jaccard similarity of
    the parts is that of the terms.
    """
    cut = lambda x: F.transform(
        F.sequence(F.lit(0), F.ceil(x["w"] / PART).cast("int") - 1),
        lambda j: F.struct(F.xxhash64(x["t"], j).alias("h"), F.least(F.lit(float(PART)), x["w"] - j * PART).alias("w")),
    )
    return F.flatten(F.transform(terms(text), cut))


def _uniform(h: Column, lane: int) -> Column:
    """In (0, 1), from a term's hash and a lane."""
    return (F.shiftrightunsigned(F.xxhash64(h, F.lit(lane)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def _sample(h: Column, w: Column) -> Column:
    """One long a term: bin, then the rank of its sample, then the sample's name.

    Consistent weighted sampling (Ioffe 2010): r and c are Gamma(2, 1) and b uniform, all drawn from the term alone;
    s = floor(ln w / r + b) quantises the weight, ln y = r (s - b), and the term with the least
    a = c / (y exp r) wins, under the name (term, s). Of two documents the same name wins a bin with a probability
    equal to the generalised Jaccard similarity of what falls in the bin.
    """
    gamma = lambda a: -F.ln(_uniform(h, a)) - F.ln(_uniform(h, a + 1))
    return F.transform(
        F.array(F.struct(gamma(1).alias("r"), gamma(3).alias("c"), _uniform(h, 5).alias("b"))),
        lambda g: _packed(h, F.floor(F.ln(w) / g["r"] + g["b"]), g),
    )[0]


def _packed(h: Column, s: Column, g: Column) -> Column:
    ln_a = F.ln(g["c"]) - g["r"] * (s - g["b"] + 1)
    rank = F.floor(F.least(F.greatest((ln_a + 96.0) / 128.0, F.lit(0.0)), F.lit(1 - 1e-9)) * F.lit(float(1 << 28)))
    name = F.shiftrightunsigned(F.xxhash64(h, s), 36)
    bin_ = F.pmod(F.shiftrightunsigned(h, 40), F.lit(BINS))
    return F.shiftleft(bin_.cast("long"), 56).bitwiseOR(F.shiftleft(rank.cast("long"), 28)).bitwiseOR(name)


def signature(text: Column) -> Column:
    """array<long>: for each bin that has terms, bin and name of the winner. Without words it is empty. Equal texts
    have equal signatures, and so have texts with the same words in another order."""
    packed = F.sort_array(F.transform(parts(text), lambda x: _sample(x["h"], x["w"])))
    held = F.transform(F.array(packed), lambda a: F.filter(a, lambda v, i: (i == 0) | (F.shiftright(v, 56) != F.shiftright(F.get(a, i - 1), 56))))[0]
    return F.transform(held, lambda v: F.shiftleft(F.shiftright(v, 56), 28).bitwiseOR(v.bitwiseAND(F.lit((1 << 28) - 1))))


def as_text(sig: Column) -> Column:
    """Nine hex digits a bin: two of the bin, seven of the sample's name."""
    return F.array_join(F.transform(sig, lambda v: F.lower(F.lpad(F.hex(v), 9, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins that either has in which both keep the same sample, 0 to 1. Two empty signatures: 1."""
    bins = lambda s: F.transform(s, lambda v: F.shiftright(v, 28))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, sig, fingerprint) for each row; null text counts as empty. No shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), signature(text).alias("sig"))
    return out.withColumn("fingerprint", as_text(F.col("sig")))


def _bounds(ids: DataFrame, ranges: int | None) -> tuple[list[int], int]:
    """Ids that cut the table into about equal ranges, in order, an id that fills several ranges several times; and the
    number of rows."""
    rows = ids.count()
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, rows // RANGE_ROWS))
    at = [k / ranges for k in range(1, ranges)]
    got = ids.agg(F.percentile_approx("d", at, max(10_000, 2 * ranges)).alias("p")).first().p or []
    return sorted(got), rows


def _range(bounds: list[int], d: Column, h: Column) -> Column:
    """Number of the range of an id, the largest ids in range 0. The place among the different bounds is found by
    bisection; the rows of an id that fills several ranges are dealt to these by the hash of their texts, in its order."""
    if not bounds:
        return F.lit(0)
    kinds = sorted(set(bounds))
    upto = [bisect_right(bounds, b) for b in kinds]
    of = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    cuts, counts, widths = of(kinds), of([0, *upto]), of([0, *(b - a for a, b in zip([0, *upto], upto, strict=False))])
    n = len(kinds)
    forward = lambda at, step: F.when((at + step <= n) & (F.get(cuts, at + step - 1) <= d), at + step).otherwise(at)
    place = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]), F.lit(0), forward)
    found = F.struct(place.alias("at"))
    at = F.transform(F.array(found), lambda x: F.struct(F.get(counts, x["at"]).alias("below"), F.get(widths, x["at"]).alias("width"), (F.get(cuts, x["at"] - 1) == d).alias("same")))[0]
    share = h.cast("double") / F.lit(2.0**64) + 0.5
    deep = F.transform(F.array(at), lambda x: F.lit(len(bounds)) - x["below"] + F.when(x["same"], F.least(F.floor(share * x["width"]), x["width"] - 1)).otherwise(0))[0]
    return deep.cast("int")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, text, sig, next_text, next_sig): with each row the text and signature of the next one by descending
    id, with the last those of the first. Signatures are made once, after the texts have been dealt out.

    Whole texts move once. Ids are cut into ranges of about equal numbers of rows; a range's first row goes along
    with the range before it as a guest, so every row finds its neighbour within its own range. Ties in id stand in
    the order of the hash of their texts; null ids come last. Rows that share an id are ranges of their own if they are
    many, cut by that hash. Only rows repeated in full are never parted.
    """
    spark = docs.sparkSession
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(d.alias("d"), F.col(id_col).alias("doc_id"), text.alias("text"))
    bounds, number = _bounds(rows.select("d"), ranges)
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("k", _range(bounds, F.col("d"), F.col("h")))
    # One row a range: its first.
    firsts = sorted((r.k, r.d, r.h) for r in rows.select("k", "d", "h").groupBy("k").agg(F.max(F.struct("d", F.negative(F.col("h").cast("decimal(20,0)")).alias("o"), "h")).alias("m")).select("k", "m.d", "m.h").collect())
    if not firsts:
        return rows.select("doc_id", "text", signature(F.col("text")).alias("sig"), F.lit("").alias("next_text"), signature(F.col("text")).alias("next_sig"))
    guests = [(firsts[i - 1][0], *firsts[i]) for i in range(len(firsts))]
    guest = spark.createDataFrame(guests, "to int, g_k int, g_d long, g_h long")
    copies = rows.join(F.broadcast(guest), (F.col("k") == F.col("g_k")) & (F.col("d") == F.col("g_d")) & (F.col("h") == F.col("g_h")))
    copies = copies.dropDuplicates(["g_k"]).select("d", "doc_id", "text", F.col("to").alias("k"), "h", F.lit(1).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(0)).unionByName(copies)
    parts = number // (RANGE_ROWS * RANGES_A_PARTITION)
    more = parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (dealt.repartition(parts, "k") if more else dealt.repartition("k")).withColumn("sig", signature(F.col("text")))
    order = Window.partitionBy("k").orderBy("guest", F.col("d").desc(), "h")
    near = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sig", F.lead("sig").over(order))
    return near.where("guest = 0").select("doc_id", "text", "sig", "next_text", "next_sig")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next document.

    The edited text: the last floor(n_chars / 3) code points replaced by as many (or all) of the first of the next
    document by descending id. Null text counts as empty; a table of one row is its own neighbour; an empty table
    gives an empty result; repeated rows follow each other; other columns are not read.
    """
    rows = neighbours(docs, id_col, text_col, ranges)
    n = F.length("text")
    part = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 3)))"), F.expr("substring(next_text, 1, int(floor(length(text) / 3)))"))
    rows = rows.withColumn("edited", F.when(part == 0, F.col("text")).otherwise(edited))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("sig").alias("s"), signature(F.col("edited")).alias("e"), F.col("next_sig").alias("x"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("s")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("x")).alias("near_next"))
