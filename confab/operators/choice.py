"""Choice of a model from a list."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rows: DataFrame, group: list[str], text: str, needle: str, order: str, key: str) -> DataFrame:
    """(group, match): the key of the first row, in order, whose text contains the needle (case counts), else null."""
    hit = F.when(F.contains(F.col(text), F.lit(needle)), F.struct(order, key))
    return rows.groupBy(*group).agg(F.min(hit)[key].alias("match"))


def lookup(rows: DataFrame, key: str, wanted: Column) -> DataFrame:
    """The rows of one key; none if there is none. The filter reaches the scan."""
    return rows.where(F.col(key) == wanted)


def pages_of(listed: DataFrame) -> DataFrame:
    """All rows of a paged list (data array, has_more, first_id, last_id)."""
    return listed.select(F.inline("data"))
