"""Canonical views of transactions: what holds after the user's word, and what it does to spending and cash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.money import MONEY
from ..plans.ledger import Ledger


def effective(led: Ledger) -> DataFrame:
    """Transactions with the user's overrides. An enabled override counts even when it says null; exclusion is overridden by any value."""
    t = led.transaction
    u = led.user_state.withColumnRenamed("transaction_id", "id")
    joined = t.join(u, ["workspace_id", "id"], "left")
    word = {"category": ("category_override", "category_value", "category_id"), "merchant": ("merchant_override", "merchant_value", "merchant_id"), "role": ("role_override", "role_value", "role")}
    return joined.select(
        *t.columns,
        *[F.when(F.coalesce(F.col(flag), F.lit(False)), F.col(value)).otherwise(F.col(own)).alias(f"effective_{name}") for name, (flag, value, own) in word.items()],
        F.when(F.coalesce("category_override", F.lit(False)), "USER").otherwise(F.col("category_source")).alias("effective_source"),
        F.coalesce("excluded_value", "is_excluded").alias("effective_excluded"),
        F.col("account_currency").alias("currency"),
        policy.analytics_amount(F.col("account_amount"), F.col("provider_amount"), F.col("provider_currency"), F.col("account_currency")).alias("amount"),
        policy.unconverted(F.col("account_amount"), F.col("provider_currency"), F.col("account_currency")).alias("is_unconverted"),
        F.coalesce("review_status", F.lit("UNREVIEWED")).alias("review_status"),
        F.col("notes"),
        F.coalesce("version", F.lit(0)).alias("version"),
    )


def effects(led: Ledger, representation: Column | None = None) -> DataFrame:
    """Both effects in one pass: the account's type joins once, and spending and cash are two columns of the same row.

    Rows that are only evidence of a bill (representation BILL_PAYMENT_EVIDENCE or BILL_FINANCE_CHARGE_EVIDENCE) count nothing.
    """
    e = effective(led)
    types = led.account.select("workspace_id", F.col("id").alias("account_id"), "account_type")
    gone = policy.gone(F.col("deleted_at"), F.col("status"), F.col("duplicate_status"))
    if representation is not None:
        gone = gone | F.coalesce(representation.isin("BILL_FINANCE_CHARGE_EVIDENCE", "BILL_PAYMENT_EVIDENCE"), F.lit(False))
    return e.join(types, ["workspace_id", "account_id"]).select(
        *e.columns,
        "account_type",
        policy.spend_effect(gone, F.col("effective_excluded"), F.col("effective_role"), F.col("amount")).alias("spend"),
        policy.cash_effect(gone, F.col("account_type"), F.col("effective_role"), F.col("direction"), F.col("amount")).alias("cash"),
    )


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull() & (F.col("status") != "DELETED"))


def monthly_spend(led: Ledger, by: str) -> DataFrame:
    """Posted spending by month, currency and category or merchant; null is a group."""
    rows = effects(led).where((F.col("status") == "POSTED") & F.col("deleted_at").isNull())
    return rows.groupBy("workspace_id", F.trunc("local_date", "month").alias("month"), "currency", F.col(f"effective_{by}").alias(f"{by}_id")).agg(
        F.sum("spend").cast(MONEY).alias("spend_amount"), F.count("spend").alias("transaction_count"), F.count_if("is_unconverted").alias("unconverted_count")
    )


def needing_review(led: Ledger) -> DataFrame:
    odd = (F.col("review_status") == "NEEDS_REVIEW") | (F.col("duplicate_status") == "POSSIBLE") | F.col("effective_role").isin("UNKNOWN_CREDIT", "UNKNOWN") | F.col("effective_category").isNull() | F.col("is_unconverted")
    return live(effective(led)).where(odd)


def unclassified(led: Ledger) -> DataFrame:
    return live(effective(led)).where(F.col("effective_category").isNull())


def replacement_review(led: Ledger, links: DataFrame) -> DataFrame:
    """Open links of a transaction to the one that replaces it (columns id, workspace_id, predecessor_id, successor_id, status, confidence)."""
    e = effective(led).select("workspace_id", "id", "local_date")
    before, after = e.toDF("workspace_id", "predecessor_id", "predecessor_date"), e.toDF("workspace_id", "successor_id", "successor_date")
    return links.where(F.col("status") == "NEEDS_REVIEW").join(before, ["workspace_id", "predecessor_id"]).join(after, ["workspace_id", "successor_id"])
