"""Lists of accounts, cards, bills, sync runs, dead jobs, categories, merchants and rules: filtered, ordered and cut per workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ledger import Ledger

MOST = 500


def first(rows: DataFrame, order: list[Column], top: int, by: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """The first `top` rows of each workspace (and card, bill ...) with their place from 1."""
    if not 1 <= top <= MOST:
        raise ValueError(f"a list holds 1 to {MOST} rows")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("place") <= top)


def accounts(led: Ledger, cards_only: bool = False, top: int = 100) -> DataFrame:
    rows = led.account.where(F.col("deleted_at").isNull())
    if cards_only:
        return first(rows.where("account_type = 'CREDIT_CARD'"), [F.col("name"), F.col("id")], top)
    return first(rows, [F.col("account_type"), F.col("name"), F.col("id")], top)


def card_bills(led: Ledger, top: int = 100) -> DataFrame:
    """Bills of each live card, the latest due first."""
    cards = led.account.where("account_type = 'CREDIT_CARD' and deleted_at is null").select("workspace_id", F.col("id").alias("account_id"))
    return first(led.bill.join(cards, ["workspace_id", "account_id"], "left_semi"), [F.col("due_date").desc_nulls_last(), F.col("id").desc()], top, ("workspace_id", "account_id"))


def bill_payments(led: Ledger, top: int = 100) -> DataFrame:
    bills = card_bills(led, MOST).select("workspace_id", F.col("id").alias("bill_id"))
    return first(led.bill_payment.join(bills, ["workspace_id", "bill_id"], "left_semi"), [F.col("payment_date").desc(), F.col("id").desc()], top, ("workspace_id", "bill_id"))


def bill_charges(led: Ledger, top: int = 100) -> DataFrame:
    """With whether the charge is matched to a transaction."""
    bills = card_bills(led, MOST).select("workspace_id", F.col("id").alias("bill_id"))
    rows = led.bill_charge.join(bills, ["workspace_id", "bill_id"], "left_semi").withColumn("is_matched", F.col("matched_transaction_id").isNotNull())
    return first(rows, [F.col("charge_type"), F.col("id")], top, ("workspace_id", "bill_id"))


def sync_runs(runs: DataFrame, connections: DataFrame, top: int = 50) -> DataFrame:
    """The latest runs with their connection's status."""
    of = connections.select("workspace_id", F.col("id").alias("connection_id"), F.col("local_status").alias("connection_status"))
    return first(runs.join(of, ["workspace_id", "connection_id"]), [F.col("started_at").desc(), F.col("id").desc()], top)


def dead_letters(jobs: DataFrame, top: int = 50) -> DataFrame:
    return first(jobs.where("status = 'DEAD'"), [F.col("finished_at").desc(), F.col("id").desc()], top)


def categories(led: Ledger, inactive: bool = False) -> DataFrame:
    """Global categories and those of each workspace, by label; (workspace null: global)."""
    rows = led.category if inactive else led.category.where("is_active")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("workspace_id").orderBy("label", "id")))


def merchants(led: Ledger, aliases: DataFrame, top: int = 100) -> DataFrame:
    """Merchants with their active aliases as ordered JSON, confirmed ones first."""
    told = F.struct("alias", "match_type", F.col("confidence").cast("string").alias("confidence"))
    own = aliases.where("is_active").groupBy("workspace_id", F.col("merchant_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(told))).alias("aliases"))
    rank = F.when(F.col("review_status") == "CONFIRMED", 0).otherwise(1)
    ranked = first(led.merchant, [rank, F.col("label"), F.col("id")], top)
    return ranked.join(own, ["workspace_id", "id"], "left").withColumn("aliases", F.coalesce("aliases", F.lit("[]")))


def rules(rows: DataFrame, top: int = 100) -> DataFrame:
    """In the order in which they apply."""
    return first(rows, [F.col("priority").desc(), F.col("created_at"), F.col("id")], top)


def referencing(rows: DataFrame, kind: str, value: Column) -> DataFrame:
    """Rules whose actions hold one of that kind and value: containment in a JSON array, told by its elements."""
    return rows.where(F.exists("actions", lambda a: (a["type"] == kind) & (a["value"] == value)))
