"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bins of the ranking variable in which each source's sizes are summed before any row is ranked, and how often the bin
#: in which the room ends is parted into so many again, so that the rows ranked one by one are few in a hot source too.
BINS, LEVELS = 1024, 2
#: Inclusion goes with this power of a document's size: longer documents are likelier to be taken, fewer are needed.
POWER = 0.5
#: Passes down the ranking; from the second on they fill what a document too long for the rest has left.
PASSES = 4
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_of(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the row's columns alone, so reruns agree."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, target) from one row a source (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``most`` times its source's size; the excess goes to the others by weight until none is above. Sorted by
    cap over weight, the capped sources are a prefix, so one running sum finds them. The windows here hold one
    row a source, never rows of documents: they are ranked in one task, as the turn of a weight is a place in the order
    of all sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = weighed.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    # The first source that is not capped has the level of all that are not; those after it find a lower one.
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * final).alias("target"))


def _cut(ranked: DataFrame, room: DataFrame, nearest: bool) -> DataFrame:
    """(source, cut, used): rows with q <= cut are taken. room: (source, room). Sums by bin first, then by the bins of
    the bin in which the room ends; only rows of the last of these are ranked one by one. nearest: the last row may go
    past the room by half."""
    edge = room.select("source", "room", F.lit(0.0).cast("double").alias("base"), F.lit(0).cast("long").alias("e_bin"), F.lit(None).cast("long").alias("whole"))
    at_edge = ranked
    for level in range(1, LEVELS + 1):
        # F.floor gives the same bin for the same q at each level, and bins of a level part those of the one above.
        fine = F.floor(F.col("q") * float(BINS**level))
        sums = at_edge.groupBy("source", fine.alias("bin")).agg(F.sum("size").alias("s")).withColumnRenamed("source", "s_source")
        sums = edge.join(sums, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
        to_here = Window.partitionBy("source").orderBy("bin")
        sums = sums.withColumn("upto", F.col("base") + F.sum("s").over(to_here))
        ends = F.min(F.when(F.col("upto") > F.col("room"), F.struct("bin", (F.col("upto") - F.col("s")).alias("base"))))
        found = sums.groupBy("source", "room").agg(ends.alias("e"), F.max("upto").alias("whole"))
        # A row a source; kept, so that no plan holds all levels and passes.
        edge = stored(found.select("source", "room", F.col("e.base").alias("base"), F.col("e.bin").alias("e_bin"), "whole"))
        if level == 1:
            over = edge
        inner = edge.where("e_bin IS NOT NULL").withColumnRenamed("source", "e_source").select("e_source", "e_bin")
        rows = at_edge.join(inner, F.col("source").eqNullSafe(F.col("e_source")) & (fine == F.col("e_bin")))
        at_edge = rows.select("source", "size", "q")
    edge = edge.where("e_bin IS NOT NULL")
    # Rows with the same q (repeated rows, and those that are certain) are taken together or not at all.
    tied = at_edge.groupBy("source", "q").agg(F.sum("size").alias("size")).withColumnRenamed("source", "t_source")
    tied = tied.join(edge, F.col("t_source").eqNullSafe(F.col("source"))).drop("t_source")
    upto = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("q"))
    fits = tied.withColumn("upto", upto).where((F.col("upto") - (F.col("size") / 2 if nearest else 0)) <= F.col("room"))
    last = fits.groupBy("source").agg(F.max("q").alias("l_q"), F.max("upto").alias("l_upto")).withColumnRenamed("source", "l_source")
    # Nothing fits in the bin: the cut is just below it. No bin goes past the room: all is taken.
    below = F.col("e_bin") / F.lit(float(BINS**LEVELS)) - F.lit(1e-15)
    ended = edge.join(last, F.col("source").eqNullSafe(F.col("l_source")), "left")
    ended = ended.select("source", F.coalesce("l_q", below).alias("cut"), F.coalesce("l_upto", "base").alias("used"))
    return ended.unionByName(over.where("e_bin IS NULL").select("source", F.lit(2.0).alias("cut"), F.col("whole").cast("double").alias("used")))


def inclusion(sizes: DataFrame, room: DataFrame) -> DataFrame:
    """(source, scale): a document of that source is included with the probability min(1, scale * size ** POWER), so
    that the expected words are the room. room: (source, room).

    From the largest size on, sizes that would get 1 or more are certain; the first that would not has the scale of all
    that are not. The window holds one row a source and distinct size, never rows of documents.
    """
    weight = F.pow(F.col("size").cast("double"), F.lit(POWER))
    kinds = sizes.where("size > 0").groupBy(F.col("source").alias("k_source"), "size").agg(F.sum("size").cast("double").alias("words"))
    kinds = kinds.join(room, F.col("k_source").eqNullSafe(F.col("source"))).drop("k_source").withColumn("weight", weight)
    largest = Window.partitionBy("source").orderBy(F.desc("size"))
    above = F.coalesce(F.sum("words").over(largest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("words") * F.col("weight")).over(largest.rowsBetween(0, Window.unboundedFollowing))
    open_ = kinds.withColumn("scale", (F.col("room") - above) / rest).where(F.col("scale") * F.col("weight") < 1)
    return open_.groupBy("source").agg(F.max_by(F.greatest("scale", F.lit(0.0)), "size").alias("scale"))


def plan(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row a source: (source, source_size, target, whole, scale, passes), from rows (source, size, u).

    A source with rate r = target / size gives floor(r) certain copies of each document. The rest of its target is a
    Pareto order sample of unequal probabilities: a document's inclusion p goes with a power of its size, such that the
    expected words are the rest (see inclusion()); with u uniform, documents are ranked by (u / (1 - u)) / (p / (1 - p))
    and taken in that order up to the rest, so the sample is of fixed size, in words. A long document at the cut would
    leave a gap: passes go on down the ranking with documents that fit what is left, and the last may go past it by
    half a document. passes: array<struct<after, upto, longest>>; a pass takes the documents ranked in (after, upto]
    that are no longer than longest.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(by_source, weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(rate + F.lit(1e-12)))
    room = F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    # Of a rate that is whole, rounding leaves nothing to take.
    goal = stored(goal.withColumn("room", F.when(room > F.col("source_size") * 1e-12, room).otherwise(F.lit(0.0))))
    scale = inclusion(sizes, goal.where("room > 0").select("source", "room")).withColumnRenamed("source", "i_source")
    goal = goal.join(scale, F.col("source").eqNullSafe(F.col("i_source")), "left").drop("i_source")
    # Without a scale no size is uncertain: all are included.
    goal = goal.withColumn("scale", F.when(F.col("room") > 0, F.coalesce("scale", F.lit(1.0))).otherwise(F.lit(0.0)))
    goal = stored(goal.withColumn("passes", F.lit(None).cast("array<struct<after:double,upto:double,longest:double>>")))
    for k in range(PASSES):
        last = k == PASSES - 1
        after = F.coalesce(F.get("passes", F.size("passes") - 1)["upto"], F.lit(-1.0))
        longest = F.lit(float("inf")) if k == 0 else F.col("room") * (2 if last else 1)
        now = goal.withColumn("after", after).withColumn("longest", longest)
        rows = _ranked(sizes, now.select("source", "scale", "after", "longest")).where("q > after AND size > 0 AND size <= longest")
        cut = _cut(rows.select("source", "size", "q"), goal.select("source", "room"), nearest=last)
        cut = cut.select(F.col("source").alias("c_source"), "cut", "used")
        now = now.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left")
        step = F.array(F.struct("after", F.coalesce("cut", "after").alias("upto"), "longest"))
        now = now.withColumn("passes", F.concat(F.coalesce("passes", F.filter(step, lambda x: F.lit(False))), step))
        room = F.greatest(F.col("room") - F.coalesce("used", F.lit(0)), F.lit(0.0))
        goal = stored(now.select("source", "source_size", "target", "whole", "scale", room.alias("room"), "passes"))
    return goal.drop("room")


def _ranked(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """rows with the columns of their source, and q in [0, 1), which orders as random odds over inclusion odds.
    Sources with nothing left to take have no rows here."""
    goal = goal.where(F.col("scale") > 0).withColumnRenamed("source", "g_source")
    out = rows.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    return out.withColumn("q", _q())


def _q() -> Column:
    """0 for a certain document, else a number in (0, 1) that grows with the ratio of odds."""
    p = F.col("scale") * F.pow(F.col("size").cast("double"), F.lit(POWER))
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, F.least(odds / (1 + odds), F.lit(1 - 1e-12))).otherwise(F.lit(1 - 1e-12))


def copies(rows: DataFrame, planned: DataFrame, most: int = 3) -> DataFrame:
    """rows (source, size, u, ...) with source_size, target and copies: how often the mix takes each row."""
    planned = planned.select(F.col("source").alias("p_source"), "source_size", "target", "whole", "scale", "passes")
    out = rows.join(planned, F.col("source").eqNullSafe(F.col("p_source")), "left").drop("p_source").withColumn("q", _q())
    taken = F.exists("passes", lambda p: (F.col("q") > p["after"]) & (F.col("q") <= p["upto"]) & (F.col("size") <= p["longest"]))
    extra = (F.col("scale") > 0) & F.coalesce(taken, F.lit(False))
    out = out.withColumn("copies", F.least(F.col("whole") + F.when(extra, 1).otherwise(0), F.lit(most)).cast("long"))
    return out.drop("whole", "scale", "passes", "q")


def sized(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, u) for each row. u also depends on the text, so rows that share an id differ in it."""
    i, t, s = F.col(id_col), F.col(text_col), F.col(source_col)
    return docs.select(i.alias("doc_id"), s.alias("source"), size_of(t).alias("size"), random_of(seed, i, t).alias("u"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) for each row; see plan().

    Null and wordless texts have size 0 and take 0 words; a null source is a source of its own, last in order;
    rows repeated in full are taken alike; a null id is an id like others; an empty table gives an empty result;
    other columns are not read.
    """
    sizes = stored(sized(docs, seed))
    out = copies(sizes, plan(sizes, weights, most), most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 42) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs. Texts are not shuffled: each
    row finds its copies by its source's cuts. Documents of size 0 are no words of any target and go."""
    names = docs.columns
    planned = plan(stored(sized(docs, seed)), weights, most)
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole_row")
    rows = docs.select(whole, F.col("source"), size_of(F.col("text")).alias("size"), random_of(seed, F.col("doc_id"), F.col("text")).alias("u"))
    out = copies(rows, planned, most).where((F.col("copies") > 0) & (F.col("size") > 0))
    return out.select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole_row.*")
