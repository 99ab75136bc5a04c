"""Admission of batches of files by type, size and capacity."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confab.functions.text import split_list, trim

#: What each code tells. Fixed values.
MESSAGES = {
    "accept": "No files match the accepted types.",
    "max_file_size": "All files exceed the maximum size.",
    "max_files": "Too many files. Some were not added.",
}


def matches(media_type: Column, accept: Column) -> Column:
    """Any pattern of the list matches: ``x/*`` by prefix, others exactly. A blank or null list takes all."""
    patterns = split_list(accept)
    one = lambda p: F.when(F.endswith(p, F.lit("/*")), F.startswith(media_type, F.substr(p, F.lit(1), F.length(p) - 1))).otherwise(media_type == p)
    return F.when(F.coalesce(trim(accept), F.lit("")) == "", F.lit(True)).otherwise(F.coalesce(F.exists(patterns, one), F.lit(False)))


def admit(files: DataFrame, batch: str, order: str, accept: Column, max_size: Column, max_files: Column, current: Column) -> DataFrame:
    """files (media_type, size) with fits_type, fits_size, admitted, and code and message of the batch's error, or null.

    Type first, then size, then as many as there is room for, in order. Nothing of the type: ``accept``. All of the
    type too large: ``max_file_size``. More than there is room for: ``max_files``, and those that have room are still
    admitted. Other rejections carry no code. A null or zero max_size and a null max_files set no limit.
    """
    ok = files.withColumn("fits_type", matches(F.col("media_type"), accept))
    free = max_size.isNull() | (max_size == 0)
    ok = ok.withColumn("fits_size", F.col("fits_type") & F.coalesce(free | (F.col("size") <= max_size), F.lit(False)))
    room = F.when(max_files.isNotNull(), F.greatest(F.lit(0), max_files - current))
    before = Window.partitionBy(batch).orderBy(order)
    whole = Window.partitionBy(batch)
    place = F.sum(F.col("fits_size").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    of_type, of_size = (F.sum(F.col(c).cast("int")).over(whole) for c in ("fits_type", "fits_size"))
    code = F.when(of_type == 0, "accept").when(of_size == 0, "max_file_size").when(of_size > room, "max_files")
    ok = ok.withColumn("admitted", F.col("fits_size") & F.coalesce(place <= room, F.lit(True))).withColumn("code", code)
    told = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return ok.withColumn("message", F.try_element_at(told, F.col("code")))
