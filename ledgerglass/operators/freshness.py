"""History coverage and data freshness of accounts; "now" is always an argument."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ledger import Ledger


def history_coverage(led: Ledger) -> DataFrame:
    return led.account.where(F.col("deleted_at").isNull()).select(
        "workspace_id", F.col("id").alias("account_id"), "account_type", "currency", "earliest_date", "latest_date", "coverage_status",
        F.col("coverage_status").isin("UNKNOWN", "PARTIAL").alias("has_incomplete_history"), F.col("initial_import_completed_at").isNotNull().alias("initial_import_completed"),
    )


def freshness(led: Ledger, now: datetime | str) -> DataFrame:
    at = F.lit(str(now)).cast("timestamp")
    c = led.connection.where(F.col("deleted_at").isNull()).select("workspace_id", F.col("id").alias("connection_id"), "local_status", F.col("last_successful_sync_at").alias("connection_sync_at"))
    synced = F.greatest("connection_sync_at", "last_successful_sync_at")
    return led.account.where(F.col("deleted_at").isNull()).join(c, ["workspace_id", "connection_id"]).select(
        "workspace_id", F.col("id").alias("account_id"), "connection_id", F.col("local_status").alias("connection_status"), synced.alias("synced_at"),
        (F.unix_timestamp(at) - F.unix_timestamp(synced)).alias("age_seconds"),
        F.coalesce(synced < at - F.expr("interval 24 hours"), F.lit(True)).alias("is_stale"),
        (~F.col("local_status").isin("ACTIVE", "SYNCING")).alias("needs_attention"),
    )


def freshness_summary(led: Ledger, now: datetime | str) -> DataFrame:
    return freshness(led, now).groupBy("workspace_id").agg(
        F.max("synced_at").alias("last_successful_sync_at"), F.min("synced_at").alias("oldest_account_sync_at"), F.bool_or("is_stale").alias("is_stale"),
        F.count_if("is_stale").alias("stale_count"), F.count_if("needs_attention").alias("attention_count"),
    )


def history_summary(led: Ledger, start: date) -> DataFrame:
    """Accounts whose known history begins after the asked date, or is unknown."""
    short = history_coverage(led).where(F.col("earliest_date").isNull() | (F.col("earliest_date") > F.lit(start)))
    return short.groupBy("workspace_id").agg(
        F.count("*").alias("affected_account_count"), F.min("earliest_date").alias("earliest_known_date"), F.array_sort(F.collect_set("coverage_status")).alias("coverage_statuses")
    )


def coverage_for_range(led: Ledger, start: date, end: date) -> DataFrame:
    """Per account, how a range stands to what is known of it."""
    early, late = F.col("earliest_date").isNull() | (F.col("earliest_date") > F.lit(start)), F.col("latest_date").isNull() | (F.col("latest_date") < F.lit(end))
    warning = F.when(F.col("earliest_date").isNull(), "HISTORY_UNKNOWN").when(early, "STARTS_LATE").when(late, "ENDS_EARLY")
    return history_coverage(led).withColumn("warning", warning)
