"""Messages and their parts."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.text import join_keeping, role_label


def text_of(parts: Column) -> Column:
    """Texts of the parts of type ``text``, joined; '' without any, null for null parts."""
    return join_keeping(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")


def flatten_parts(messages: DataFrame, id_col: str = "id", parts_col: str = "parts") -> DataFrame:
    """One row a part of type ``text`` with its key ``id-position``; positions count all parts from 0."""
    rows = messages.select(F.col(id_col), F.posexplode(parts_col).alias("position", "part"))
    return rows.where(F.col("part.type") == "text").select(id_col, F.concat_ws("-", id_col, "position").alias("key"), "position", F.col("part.text").alias("text"))


def default_format(role: Column, text: Column, position: Column) -> Column:
    return F.concat(F.lit("**"), role_label(role), F.lit(":** "), F.coalesce(text, F.lit("")))


def transcripts(messages: DataFrame, group: str = "conv_id", order: str = "turn", formatter: Callable[[Column, Column, Column], Column] = default_format) -> DataFrame:
    """(group, markdown): each conversation as one text, messages in order with a blank line between. A conversation
    is one value of the result, so its messages meet by nature; the order is a column, not arrival. The formatter gets
    role, text and the message's position, from 0."""
    held = F.array_sort(F.collect_list(F.struct(order, "role", "text")))
    lines = F.transform(held, lambda x, k: F.coalesce(formatter(x["role"], x["text"], k), F.lit("")))
    return messages.groupBy(group).agg(F.array_join(lines, "\n\n").alias("markdown"))


def last_message(messages: DataFrame, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """The message of the highest order of each group. One partial maximum a task, no sort."""
    rest = [c for c in messages.columns if c not in (group, order)]
    top = messages.groupBy(group).agg(F.max_by(F.struct(order, *rest), order).alias("m"))
    return top.select(group, *[F.col(f"m.{c}").alias(c) for c in (order, *rest)])


def last_flags(messages: DataFrame, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """messages with is_last, is_last_answer (last and from the assistant), and cache_mark: an option on the last
    message only."""
    at_end = F.col(order) == F.max(order).over(Window.partitionBy(group))
    out = messages.withColumn("is_last", at_end)
    out = out.withColumn("is_last_answer", F.col("is_last") & (F.col("role") == "assistant"))
    return out.withColumn("cache_mark", F.when(F.col("is_last"), F.lit("ephemeral")))


def branches(options: DataFrame, group: str, order: str, current: Column) -> DataFrame:
    """(group, n, current, previous, next, label): a cursor over each group's branches that wraps at both ends. An
    empty group has no row; label is null where there is nothing to choose."""
    n = options.groupBy(group).agg(F.count(order).alias("n")).withColumn("current", current)
    label = F.when(F.col("n") > 1, F.concat((F.col("current") + 1).cast("string"), F.lit(" of "), F.col("n").cast("string")))
    return n.select(group, "n", "current", F.pmod(F.col("current") - 1, F.col("n")).alias("previous"), F.pmod(F.col("current") + 1, F.col("n")).alias("next"), label.alias("label"))


def picked_branch(options: DataFrame, group: str, order: str, current: Column) -> DataFrame:
    """Of each group the option that is shown: the one at ``current``, from 0, in order; none where there is none."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return options.withColumn("_at", at).where(F.col("_at") == current).drop("_at")


def status_label(status: Column) -> Column:
    """Busy while submitted or streaming, then Error or Ready."""
    return F.when(status.isin("submitted", "streaming"), "Stop").when(status == "error", "Error").otherwise("Submit")
