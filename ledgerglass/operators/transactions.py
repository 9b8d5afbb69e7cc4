"""Transaction details and lists, account and card lists."""

from __future__ import annotations

import base64
import hashlib
import json
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import masked
from ..plans.ledger import Ledger
from .effects import effects, live
from .freshness import freshness


def detail(led: Ledger, now: str) -> DataFrame:
    """Every live transaction with labels, its account and bill, both effects and its warnings; dimensions join once each."""
    kinds = led.category.select(F.col("id").alias("__key"), F.col("workspace_id").alias("__of"), F.col("label").alias("category_label"))
    names = led.merchant.select("workspace_id", F.col("id").alias("effective_merchant"), F.col("label").alias("merchant_label"))
    accounts = led.account.select("workspace_id", F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    bills = led.bill.select("workspace_id", F.col("id").alias("bill_id"), F.col("status").alias("bill_status"))
    fresh = freshness(led, now).select("workspace_id", "account_id", "is_stale", "needs_attention")
    rows = live(effects(led))
    rows = rows.join(kinds, (rows["effective_category"] == kinds["__key"]) & (kinds["__of"].isNull() | (kinds["__of"] == rows["workspace_id"])), "left").drop("__key", "__of")
    rows = rows.join(names, ["workspace_id", "effective_merchant"], "left").join(accounts, ["workspace_id", "account_id"], "left").join(bills, ["workspace_id", "bill_id"], "left").join(fresh, ["workspace_id", "account_id"], "left")
    codes = [
        (F.col("is_unconverted"), "UNCONVERTED_CURRENCY"),
        (F.col("duplicate_status") == "POSSIBLE", "POSSIBLE_DUPLICATE"),
        (F.col("effective_category").isNull(), "UNCLASSIFIED"),
        (F.coalesce("is_stale", F.lit(True)), "STALE_DATA"),
        (F.coalesce("needs_attention", F.lit(False)), "CONNECTION_ATTENTION"),
    ]
    return rows.withColumns({"warnings": F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in codes])), "description": masked(F.col("description"))})


def listed(
    rows: DataFrame, tags: DataFrame, links: DataFrame, accounts: tuple[int, ...] = (), categories: tuple[int, ...] = (), merchants: tuple[int, ...] = (), roles: tuple[str, ...] = (),
    statuses: tuple[str, ...] = (), classified: bool | None = None, tag: str | None = None, words: str | None = None, start: date | None = None, end: date | None = None,
) -> DataFrame:
    """Details that meet all filters given, with tags (in order), replaces and replaced_by (of links not rejected).

    Tags and links are grouped before they join, so no filter or row is repeated by them.
    """
    for column, values in (("account_id", accounts), ("effective_category", categories), ("effective_merchant", merchants), ("effective_role", roles), ("status", statuses)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    if classified is not None:
        rows = rows.where(F.col("effective_category").isNotNull() == F.lit(classified))
    if words:
        rows = rows.where(F.contains(F.lower("description"), F.lit(words.lower())))
    if start is not None:
        rows = rows.where(F.col("local_date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("local_date") <= F.lit(end))
    own = tags.groupBy("workspace_id", F.col("transaction_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    open_ = links.where((F.col("status") != "REJECTED") & F.col("successor_id").isNotNull())
    before = open_.groupBy("workspace_id", F.col("successor_id").alias("id")).agg(F.max("predecessor_id").alias("replaces"))
    after = open_.groupBy("workspace_id", F.col("predecessor_id").alias("id")).agg(F.max("successor_id").alias("replaced_by"))
    for part in (own, before, after):
        rows = rows.join(part, ["workspace_id", "id"], "left")
    rows = rows.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return rows if tag is None else rows.where(F.array_contains("tags", tag))


def scope_warnings(led: Ledger, now: str, start: date) -> DataFrame:
    """What a list from `start` on should say of each live account: history that begins later, data that is old or of unknown age, a connection that needs its user."""
    fresh = freshness(led, now).select("workspace_id", "account_id", "is_stale", "needs_attention")
    rows = led.account.where(F.col("deleted_at").isNull()).withColumnRenamed("id", "account_id").join(fresh, ["workspace_id", "account_id"], "left")
    codes = [
        (F.col("earliest_date").isNull() | (F.col("earliest_date") > F.lit(start)), "INCOMPLETE_HISTORY"),
        (F.coalesce("is_stale", F.lit(True)), "STALE_DATA"),
        (F.coalesce("needs_attention", F.lit(False)), "CONNECTION_ATTENTION"),
    ]
    return rows.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in codes])))


def page(rows: DataFrame, size: int, after: tuple[date, int] | None = None) -> DataFrame:
    """Newest first, one page of each workspace; `after` is the last (date, id) of the page before."""
    if after is not None:
        rows = rows.where(F.struct("local_date", "id") < F.struct(F.lit(after[0]).alias("local_date"), F.lit(after[1]).cast("bigint").alias("id")))
    order = Window.partitionBy("workspace_id").orderBy(F.col("local_date").desc(), F.col("id").desc())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def cursor(filters: dict, last: tuple[date, int]) -> str:
    """An opaque place in a list that holds for the same filters only."""
    mark = hashlib.sha256(json.dumps(filters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps([mark, last[0].isoformat(), last[1]]).encode()).decode().rstrip("=")


def place(text: str, filters: dict) -> tuple[date, int]:
    try:
        mark, day, key = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        last = date.fromisoformat(day), int(key)
    except (ValueError, TypeError):
        raise ValueError("the cursor can't be read") from None
    if cursor(filters, last) != text or not mark:
        raise ValueError("the cursor belongs to other filters")
    return last


def accounts(led: Ledger, cards: bool | None = None) -> DataFrame:
    rows = led.account.where(F.col("deleted_at").isNull())
    if cards is not None:
        rows = rows.where((F.col("account_type") == "CREDIT_CARD") == F.lit(cards))
    return rows.select("workspace_id", F.col("id").alias("account_id"), "account_type", "currency", "name", "current_balance", "is_active")


def bills_with_children(led: Ledger) -> DataFrame:
    """Bills and how many payments and charges they have, what they amount to."""
    paid = led.bill_payment.groupBy("workspace_id", "bill_id").agg(F.count("*").alias("payments"), F.sum("amount").cast("decimal(20,6)").alias("paid"))
    charged = led.bill_charge.groupBy("workspace_id", "bill_id").agg(F.count("*").alias("charges"), F.sum("amount").cast("decimal(20,6)").alias("charged"))
    return led.bill.withColumnRenamed("id", "bill_id").join(paid, ["workspace_id", "bill_id"], "left").join(charged, ["workspace_id", "bill_id"], "left").na.fill(0, ["payments", "charges"])
