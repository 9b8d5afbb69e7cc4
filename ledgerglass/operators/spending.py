"""Spending and cash-flow totals, breakdowns, series, comparisons and their warnings."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import Period
from ..functions.money import MONEY, share, total
from ..plans.ledger import Ledger
from .bills import reconciliation
from .commitments import bounded
from .effects import effects

TOP, TOTALS_BOUND, SERIES_BOUND, DAYS_BOUND = 100, 200, 15_000, 366


@dataclass(frozen=True)
class Scope:
    """What a report covers; what is None filters nothing, so no filter enters the plan."""

    start: date
    end: date
    workspace: int | None = None
    account: int | None = None
    category: int | None = None
    merchant: int | None = None
    pending: bool = False

    def __post_init__(self):
        if not 0 <= (self.end - self.start).days < DAYS_BOUND:
            raise ValueError("the range must hold 1 to 366 days")


def eligible(led: Ledger, scope: Scope) -> DataFrame:
    rows = effects(led).where(F.col("local_date").between(F.lit(scope.start), F.lit(scope.end)))
    rows = rows.where(F.col("status").isin("POSTED", "PENDING") if scope.pending else F.col("status") == "POSTED")
    for column, value in (("workspace_id", scope.workspace), ("account_id", scope.account), ("effective_category", scope.category), ("effective_merchant", scope.merchant)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def spend_measures() -> list[Column]:
    return [
        total(F.greatest(F.col("spend"), F.lit(0))).alias("gross_spending"),
        total(F.greatest(-F.col("spend"), F.lit(0))).alias("refund_total"),
        total(F.col("spend")).alias("net_spending"),
        F.count_if(F.col("spend") != 0).alias("spend_count"),
    ]


def cash_measures() -> list[Column]:
    return [
        total(F.greatest(F.col("cash"), F.lit(0))).alias("inflow_total"),
        total(F.greatest(-F.col("cash"), F.lit(0))).alias("outflow_total"),
        total(F.col("cash")).alias("net_cashflow"),
        F.count_if(F.col("cash") != 0).alias("cashflow_count"),
    ]


def totals(led: Ledger, scope: Scope) -> DataFrame:
    return eligible(led, scope).groupBy("workspace_id", "currency", "status").agg(*spend_measures(), *cash_measures())


def labels(led: Ledger, by: str) -> DataFrame:
    """Small dimensions: the optimiser broadcasts them when their size allows."""
    if by == "category":
        return led.category.select(F.col("id").alias("key"), F.col("workspace_id").alias("of"), "label")
    return led.merchant.select(F.col("id").alias("key"), F.col("workspace_id").alias("of"), "label")


def breakdown(led: Ledger, scope: Scope, by: str, top: int = TOP) -> DataFrame:
    """The `top` largest categories or merchants of each workspace; one row more would show that it is cut, see truncated()."""
    rows = eligible(led, scope).where(F.col("spend") != 0).groupBy("workspace_id", "currency", "status", F.col(f"effective_{by}").alias("key")).agg(*spend_measures())
    known = labels(led, by)
    named = rows.join(known, (rows["key"] == known["key"]) & (known["of"].isNull() | (known["of"] == rows["workspace_id"])), "left").drop(known["key"], known["of"])
    order = Window.partitionBy("workspace_id").orderBy(F.abs("net_spending").desc(), "currency", "status", F.col("label").asc_nulls_last(), F.col("key").asc_nulls_last())
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top + 1)
    return ranked.withColumn("is_truncated", F.max("rank").over(Window.partitionBy("workspace_id")) > top).where(F.col("rank") <= top)


def series(led: Ledger, scope: Scope, grain: str = "month") -> DataFrame:
    """By day, week (from Monday) or month; rows without any effect do not count."""
    start = {"day": F.col("local_date"), "week": F.trunc("local_date", "week"), "month": F.trunc("local_date", "month")}[grain]
    rows = eligible(led, scope).where((F.col("spend") != 0) | (F.col("cash") != 0))
    return rows.groupBy("workspace_id", start.alias("period_start"), "currency", "status").agg(*spend_measures(), *cash_measures())


def report_totals(led: Ledger, scope: Scope) -> DataFrame:
    """Totals of one workspace's report, which may hold TOTALS_BOUND rows."""
    return bounded(totals(led, scope), TOTALS_BOUND, "totals")


def report_series(led: Ledger, scope: Scope, grain: str = "month") -> DataFrame:
    """A series of one workspace's report, which may hold SERIES_BOUND rows."""
    return bounded(series(led, scope, grain), SERIES_BOUND, "series")


def unconverted_count(led: Ledger, scope: Scope) -> DataFrame:
    return eligible(led, scope).groupBy("workspace_id").agg(F.count_if("is_unconverted").alias("unconverted_count"))


def unreconciled(led: Ledger, start: date, end: date, touching: bool = True) -> DataFrame:
    """Bills that are not reconciled and close or fall due in the range, or (touching) have a transaction or payment in it."""
    inside = lambda c: F.col(c).between(F.lit(start), F.lit(end))
    bills = reconciliation(led).where(F.col("reconciliation_status") != "RECONCILED")
    if not touching:
        return bills.where(inside("close_date") | inside("due_date")).groupBy("workspace_id").agg(F.count("*").alias("affected_bill_count"))
    active = led.transaction.where(inside("local_date")).select("workspace_id", "bill_id").union(led.bill_payment.where(inside("payment_date")).select("workspace_id", "bill_id")).distinct().withColumn("active", F.lit(True))
    joined = bills.join(active, ["workspace_id", "bill_id"], "left")
    return joined.where(inside("close_date") | inside("due_date") | F.coalesce("active", F.lit(False))).groupBy("workspace_id").agg(F.count("*").alias("affected_bill_count"))


def compare_rows(led: Ledger, current: Period, other: Period, scope: Scope | None = None) -> DataFrame:
    """Rows of both periods, one scan; `now` and `then` hold the effect in the period that a row falls in (or both)."""
    first, last = min(current.start, other.start), max(current.end, other.end)
    inside = lambda p: F.col("local_date").between(F.lit(p.start), F.lit(p.end))
    rows = effects(led).where(F.col("local_date").between(F.lit(first), F.lit(last)) & (inside(current) | inside(other)))
    rows = rows.where(F.col("status").isin("POSTED", "PENDING") if scope and scope.pending else F.col("status") == "POSTED")
    return rows.withColumns({"now": F.when(inside(current), F.col("spend")), "then": F.when(inside(other), F.col("spend"))})


def change_measures() -> list[Column]:
    now, then = total(F.col("now")), total(F.col("then"))
    return [now.alias("current_total"), then.alias("comparison_total"), (now - then).cast(MONEY).alias("absolute_difference"), share(now - then, then).alias("percentage_difference")]


def compare_totals(led: Ledger, current: Period, other: Period) -> DataFrame:
    return compare_rows(led, current, other).groupBy("workspace_id", "currency", "status").agg(*change_measures())


def compare_categories(led: Ledger, current: Period, other: Period, top: int = TOP) -> DataFrame:
    """A full join of both periods, done as one grouping with two conditional sums."""
    rows = compare_rows(led, current, other).where(F.col("spend") != 0).groupBy("workspace_id", "currency", "status", F.col("effective_category").alias("key")).agg(*change_measures())
    known = labels(led, "category")
    named = rows.join(known, (rows["key"] == known["key"]) & (known["of"].isNull() | (known["of"] == rows["workspace_id"])), "left").drop(known["key"], known["of"])
    order = Window.partitionBy("workspace_id").orderBy(F.abs("absolute_difference").desc(), "currency", "status", F.col("label").asc_nulls_last())
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def warnings(history: dict, unconverted: int, bills: int, stale: int, attention: int, truncated: list[str], start: date) -> list[dict]:
    """A report's warnings in their fixed order, from the counts of one workspace."""
    out: list[dict] = []
    if history.get("affected_account_count"):
        out.append({"code": "INCOMPLETE_HISTORY", "affected_account_count": history["affected_account_count"], "coverage_statuses": history["coverage_statuses"], "earliest_known_date": history["earliest_known_date"], "requested_from": start})
    for code, name, n in (("UNCONVERTED_CURRENCY", "excluded_transaction_count", unconverted), ("UNRECONCILED_BILL", "affected_bill_count", bills), ("STALE_DATA", "affected_account_count", stale), ("CONNECTION_ATTENTION", "affected_account_count", attention)):
        if n:
            out.append({"code": code, name: n})
    if truncated:
        out.append({"code": "BREAKDOWN_TRUNCATED", "dimensions": truncated, "limit": TOP})
    return out
