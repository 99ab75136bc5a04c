"""A store of records kept as snapshots: reads and writes are frames, a write gives the next snapshot."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owner_list(records: DataFrame, owner: str, created: str, key: str) -> DataFrame:
    """records with their position in their owner's list: newest first, ties by key."""
    order = Window.partitionBy(owner).orderBy(F.col(created).desc(), F.col(key).asc())
    return records.withColumn("position", F.row_number().over(order).cast("long"))


def owned_by(records: DataFrame, owner_col: str, owner: Column) -> DataFrame:
    """Records of one owner; the filter reaches the scan. A null owner is nobody: the read fails, as a list must not be
    served without one."""
    return records.where(F.col(owner_col) == F.coalesce(owner, F.raise_error(F.lit("Unauthorized"))))


def insert(records: DataFrame, new: DataFrame) -> DataFrame:
    return records.unionByName(new)


def stamped(new: DataFrame, now: Column, created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """New records with their stamps: created when they say so, else now; updated now. The time is a parameter, so that
    a rerun gives the same records."""
    held = F.col(created) if created in new.columns else F.lit(None)
    return new.withColumn(created, F.coalesce(held, now)).withColumn(updated, now)


def touched(records: DataFrame, changes: DataFrame, key: str, now: Column, updated: str = "updated_at") -> DataFrame:
    """records with the stamp of now on those of the changes' keys; goes with update()."""
    marked = changes.select(F.col(key).alias("_key"), F.lit(True).alias("_changed")).distinct()
    rows = records.join(marked, F.col(key) == F.col("_key"), "left")
    return rows.withColumn(updated, F.when(F.col("_changed"), now).otherwise(F.col(updated))).select(*records.columns)


def update(records: DataFrame, changes: DataFrame, key: str, columns: list[str], owner: str | None = None) -> DataFrame:
    """records with ``columns`` taken from the changes of the same key, null included; other keys change nothing. With
    ``owner`` a change only holds where the owners agree too. Changes have one row a key."""
    mine = changes.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"), *([F.col(owner).alias("_owner")] if owner else []))
    on = F.col(key) == F.col("_key")
    if owner:
        on &= F.col(owner) == F.col("_owner")
    rows = records.join(mine, on, "left")
    return rows.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in records.columns])


def delete(records: DataFrame, gone: DataFrame, key: str, owner: str | None = None) -> DataFrame:
    """records without those keys; with ``owner``, only where the owners agree."""
    return records.join(gone.select(key, *([owner] if owner else [])), [key] + ([owner] if owner else []), "left_anti")


def guarded(allowed: Column, result: Column) -> Column:
    """The result, or for callers who are not signed in the record that says so."""
    return F.when(allowed, result).otherwise(F.struct(F.lit(False).alias("success"), F.lit("Unauthorized").alias("message")))


def backfill(records: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """records with a constant for null, and a frame of one row with the number filled. Doing it twice changes nothing."""
    count = records.agg(F.count_if(F.col(column).isNull()).alias("count"))
    return records.withColumn(column, F.coalesce(F.col(column), F.lit(value))), count


def require(records: DataFrame, column: str) -> DataFrame:
    """records; reading a row in which the column is null fails. With backfill() before it, the last step of making a
    column required."""
    checked = F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} holds nulls"))).otherwise(F.col(column))
    return records.withColumn(column, checked)


def unique(records: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number; none in a sound snapshot."""
    return records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dedupe_last(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, value, first_order...): of each key the last value at the place of the first, as a keyed map keeps them."""
    at = F.struct(*order)
    out = rows.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.min(at).alias("at"))
    return out.select(*keys, value, *[F.col(f"at.{c}").alias(f"first_{c}") for c in order])
