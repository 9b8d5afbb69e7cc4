"""Upserts without a table format that merges: whole new versions, joined on the key and written beside the old ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the last in that order: a delivery may bring a key more than once."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def merge(existing: DataFrame, incoming: DataFrame, keys: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """Existing rows with the incoming values of their key, and the new keys; one full join. update: how a column is formed from `old.<c>` and `new.<c>`."""
    columns, update = existing.columns, update or {}
    old, new = existing.select(*columns).withColumn("__old", F.lit(True)).alias("old"), incoming.select(*columns).withColumn("__new", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    joined = old.join(new, on, "full")
    both = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    picked = []
    for c in columns:
        fresh = F.when(F.col("__new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        picked.append((F.when(both, update[c]).otherwise(fresh) if c in update else fresh).alias(c))
    return joined.select(*picked)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet, each key once."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def revisions(existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, changes (field, before, after as text) of rows that are there and differ; null against a value is a difference."""
    old, new = existing.select(*keys, *[F.col(c).cast("string").alias(f"o_{c}") for c in fields]), incoming.select(*keys, *[F.col(c).cast("string").alias(f"n_{c}") for c in fields])
    change = [F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("before"), F.col(f"n_{c}").alias("after"))) for c in fields]
    return old.join(new, keys).select(*keys, F.array_compact(F.array(*change)).alias("changes")).where(F.size("changes") > 0)


def mark_collisions(rows: DataFrame, fingerprint: list[str], status: str = "duplicate_status") -> DataFrame:
    """POSSIBLE for every undecided row that shares its fingerprint with another one; nulls share nothing."""
    known = F.lit(True)
    for c in fingerprint:
        known = known & F.col(c).isNotNull()
    crowd = F.count("*").over(Window.partitionBy(*fingerprint)) > 1
    return rows.withColumn(status, F.when(known & crowd & (F.col(status) == "NONE"), "POSSIBLE").otherwise(F.col(status)))


def fingerprint(*columns: Column) -> Column:
    """Stable hash of canonical JSON of the named facts."""
    return F.sha2(F.to_json(F.struct(*[c.cast("string").alias(f"f{k:02d}") for k, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def soft_delete(rows: DataFrame, ids: DataFrame, key: str, at: Column) -> DataFrame:
    """Marked rows keep everything else; a row that was deleted keeps its time."""
    hit = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn("deleted_at", F.when(F.col("__hit"), F.coalesce(F.col("deleted_at"), at)).otherwise(F.col("deleted_at"))).drop("__hit")


def coverage_status(current: Column, earliest: Column, as_of: Column) -> Column:
    """After a whole import: history of 12 months or more is the provider's maximum, less is partial; what a user extended stays."""
    return F.when(current == "USER_EXTENDED_HISTORY", current).when(earliest <= F.add_months(as_of, -12), "PROVIDER_MAXIMUM_RETRIEVED").otherwise("PARTIAL")
