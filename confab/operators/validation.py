"""Validation with messages by field."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions.text import length_utf16, trim

#: What a failing field tells. Fixed values.
TITLE_REQUIRED, TITLE_LONG, CONTENT_REQUIRED = "Title is required", "Title could not be longer than 100 symbols", "Message content is required"


#: Values of closed sets. Fixed values.
ROLES = ("user", "assistant", "system")
STATUSES = ("submitted", "streaming", "ready", "error")


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    """Null is not one of them."""
    return F.coalesce(value.isin(*allowed), F.lit(False))


def title_error(title: Column) -> Column:
    n = length_utf16(trim(title))
    return F.when(title.isNull() | (n < 1), TITLE_REQUIRED).when(n > 100, TITLE_LONG)


def content_error(content: Column) -> Column:
    return F.when(content.isNull() | (F.length(trim(content)) < 1), CONTENT_REQUIRED)


def error_map(errors: dict[str, Column]) -> Column:
    """map<field, array<message>> of the fields that fail."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.when(v.isNotNull(), F.array(v)).alias("value")) for k, v in errors.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def validate(rows: DataFrame, title: str, content: str) -> DataFrame:
    """rows with trimmed values (null where they fail: nothing invalid is written), errors and success."""
    found = {"title": title_error(F.col(title)), "content": content_error(F.col(content))}
    out = rows.withColumn("errors", error_map(found)).withColumn("success", F.size("errors") == 0)
    valid = lambda c: F.when(F.col("success"), trim(F.col(c)))
    return out.withColumn(f"valid_{title}", valid(title)).withColumn(f"valid_{content}", valid(content))


def shown(messages: Column) -> Column:
    """What a field shows of its messages: null without any, the message if only one differs, else a list without
    blank ones; each message once, at its first place."""
    once = F.array_distinct(messages)
    listed = F.filter(once, lambda m: F.coalesce(m, F.lit("")) != "")
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, None).when(F.size(once) == 1, once[0]).otherwise(F.concat(F.lit("- "), F.array_join(listed, "\n- ")))


def blank(text: Column) -> Column:
    """A prompt that is not sent."""
    return F.coalesce(F.length(trim(text)) == 0, F.lit(True))
