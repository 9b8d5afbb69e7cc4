"""Instalments and recurring expenses: what is committed, what is expected, and what looks like it recurs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, share
from ..plans.ledger import Ledger
from .effects import effective, effects
from .freshness import freshness

MONTHS_BOUND, SERIES_BOUND, LOOKBACK_DAYS, LEAST_SEEN = 1200, 100, 730, 3
#: Cadence: shortest and longest median interval, most deviation (fixed values).
CADENCES = (("WEEKLY", 6, 8, 3), ("MONTHLY", 26, 35, 6), ("QUARTERLY", 80, 100, 12), ("ANNUAL", 350, 380, 25))
#: What a month holds of a cadence's amount (fixed values); custom ones by their interval.
PER_MONTH = {"WEEKLY": "4.348214", "MONTHLY": "1"}


def instalment_commitments(led: Ledger) -> DataFrame:
    posted = effective(led).where(F.col("series_id").isNotNull() & (F.col("status") == "POSTED") & F.col("deleted_at").isNull())
    seen = posted.groupBy("workspace_id", F.col("series_id").alias("id")).agg(F.count("*").alias("n"), F.sum(F.abs("amount")).alias("a"), F.count_if("is_unconverted").alias("u"))
    left = F.greatest(F.col("total_instalments") - F.col("highest_confirmed"), F.lit(0))
    return led.instalment_series.join(seen, ["workspace_id", "id"], "left").select(
        "workspace_id", F.col("id").alias("series_id"), "account_id", "merchant_id", "currency", "total_instalments", "highest_confirmed", left.alias("remaining_instalments"), "estimated_amount", "original_total", "purchase_date", "status",
        F.coalesce("n", F.lit(0)).alias("posted_transaction_count"), F.coalesce("a", F.lit(0)).cast(MONEY).alias("posted_amount"), F.coalesce("u", F.lit(0)).alias("unconverted_transaction_count"), (left * F.col("estimated_amount")).cast(MONEY).alias("remaining_commitment"),
    )


def month_of(day: Column, months: Column) -> Column:
    return F.add_months(F.trunc(day, "month"), months)


def instalment_list(led: Ledger, review_states: bool = True, top: int = SERIES_BOUND) -> DataFrame:
    """Each workspace's series: confirmed first, then candidates, those to review, others; next month where one is left."""
    shown = ("CONFIRMED", "CANDIDATE", "NEEDS_REVIEW") if review_states else ("CONFIRMED",)
    rank = F.when(F.col("status") == "CONFIRMED", 0).when(F.col("status") == "CANDIDATE", 1).when(F.col("status") == "NEEDS_REVIEW", 2).otherwise(3)
    following = F.when(F.col("remaining_instalments") > 0, month_of(F.col("purchase_date"), F.col("highest_confirmed").cast("int")))
    rows = instalment_commitments(led).where(F.col("status").isin(*shown)).withColumn("next_month", following)
    order = Window.partitionBy("workspace_id").orderBy(rank, F.col("purchase_date").desc_nulls_last(), "series_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def instalment_months(led: Ledger, top: int = MONTHS_BOUND) -> DataFrame:
    """What confirmed series still cost in each month; the first `top` rows of each workspace, by month and currency."""
    open_ = instalment_commitments(led).where((F.col("status") == "CONFIRMED") & (F.col("remaining_instalments") > 0) & F.col("estimated_amount").isNotNull() & F.col("purchase_date").isNotNull())
    each = open_.select("workspace_id", "currency", "estimated_amount", "purchase_date", F.explode(F.sequence(F.col("highest_confirmed").cast("int"), (F.col("total_instalments") - 1).cast("int"))).alias("k"))
    rows = each.groupBy("workspace_id", month_of(F.col("purchase_date"), F.col("k")).alias("month"), "currency").agg(F.sum("estimated_amount").cast(MONEY).alias("estimated_amount"), F.count("*").alias("instalment_count"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("workspace_id").orderBy("month", "currency")))
    return ranked.where(F.col("rank") <= top).drop("rank")


def countable(led: Ledger) -> DataFrame:
    """Posted, live purchases with a known positive effect."""
    rows = effects(led).where((F.col("status") == "POSTED") & F.col("deleted_at").isNull() & (F.col("duplicate_status") != "CONFIRMED_DUPLICATE"))
    return rows.where((F.col("effective_role") == "PURCHASE") & (F.col("spend") > 0) & ~F.col("is_unconverted"))


def confirmed_merchants(led: Ledger) -> DataFrame:
    return led.merchant.where(F.col("review_status") == "CONFIRMED").select("workspace_id", F.col("id").alias("effective_merchant"), F.col("label").alias("merchant_label"))


def detect_recurring(led: Ledger, as_of: date) -> DataFrame:
    """New candidates: three or more purchases of one merchant and currency, near in amount, at near intervals of a known cadence."""
    key = ["workspace_id", "effective_merchant", "currency"]
    recent = countable(led).where(F.col("local_date") >= F.date_sub(F.lit(as_of), LOOKBACK_DAYS)).join(confirmed_merchants(led), key[:2])
    gap = F.datediff("local_date", F.lag("local_date").over(Window.partitionBy(*key).orderBy("local_date", "id")))
    seen = recent.select(*key, "effective_category", "local_date", "spend", gap.alias("gap"))
    grouped = seen.groupBy(*key).agg(
        F.count("*").alias("n"), F.percentile("gap", F.lit(0.5)).alias("median"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.min("spend").alias("amount_min"), F.max("spend").alias("amount_max"),
        (F.sum("spend").cast(MONEY) / F.count("*")).cast(MONEY).alias("amount_average"), F.max("local_date").alias("last_date"), F.when(F.countDistinct("effective_category") == 1, F.min("effective_category")).alias("category_id"),
    )
    # The largest distance from the median is that of the least or of the largest interval, so the rows are grouped once.
    deviation = F.greatest(F.col("median") - F.col("least"), F.col("most") - F.col("median"))
    cadence = F.coalesce(*[F.when(F.col("median").between(a, b) & (deviation <= d), name) for name, a, b, d in CADENCES])
    spread = (F.col("amount_max") - F.col("amount_min")).cast("double") / F.col("amount_average").cast("double")
    confidence = F.least(F.lit(0.99), F.greatest(F.lit(0.5), 1 - spread - deviation / F.greatest(F.col("median"), F.lit(1)) * 0.25))
    found = grouped.where((F.col("n") >= LEAST_SEEN) & (spread <= 0.20)).withColumn("cadence", cadence).where("cadence is not null")
    known = led.recurring_series.select("workspace_id", F.col("merchant_id").alias("effective_merchant"), "currency", "cadence")
    days = F.bround("median").cast("int")
    return found.join(known, [*key, "cadence"], "left_anti").select(
        "workspace_id", F.col("effective_merchant").alias("merchant_id"), "category_id", "cadence", days.alias("expected_interval_days"), "currency", "amount_min", "amount_max", "amount_average",
        F.col("last_date").alias("last_occurrence_date"), F.date_add("last_date", days).alias("next_expected_date"), F.round(confidence, 4).cast("decimal(5,4)").alias("confidence"),
    )


def recurring_list(led: Ledger, inactive: bool = False, top: int = SERIES_BOUND) -> DataFrame:
    """Series with how often they were seen and how the latest amount stands to the average."""
    rows = effects(led).where((F.col("status") == "POSTED") & F.col("deleted_at").isNull() & (F.col("duplicate_status") != "CONFIRMED_DUPLICATE") & (F.col("effective_role") == "PURCHASE") & (F.col("spend") > 0))
    seen = rows.groupBy("workspace_id", F.col("effective_merchant").alias("merchant_id"), "currency").agg(F.count("*").alias("n"), F.max_by("spend", F.struct("local_date", "id")).alias("latest"))
    labels = led.merchant.select("workspace_id", F.col("id").alias("merchant_id"), F.col("label").alias("merchant_label"))
    series = led.recurring_series if inactive else led.recurring_series.where(F.col("status").isin("CANDIDATE", "CONFIRMED"))
    rank = F.when(F.col("status") == "CONFIRMED", 0).when(F.col("status") == "CANDIDATE", 1).otherwise(2)
    order = Window.partitionBy("workspace_id").orderBy(rank, F.col("next_date").asc_nulls_last(), "id")
    out = series.join(labels, ["workspace_id", "merchant_id"]).join(seen, ["workspace_id", "merchant_id", "currency"], "left").select(
        *series.columns, "merchant_label", F.coalesce("n", F.lit(0)).alias("observation_count"), share(F.col("latest") - F.col("amount_average"), F.col("amount_average")).alias("price_change_percent")
    )
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def monthly_baseline(led: Ledger) -> DataFrame:
    """What confirmed series cost in an average month, by currency."""
    amount = F.col("amount_average")
    month = F.lit(None).cast("decimal(30,10)")
    for cadence, factor in PER_MONTH.items():
        month = F.when(F.col("cadence") == cadence, amount * F.lit(factor).cast("decimal(8,6)")).otherwise(month)
    month = F.when(F.col("cadence") == "QUARTERLY", amount / 3).when(F.col("cadence") == "ANNUAL", amount / 12).when(F.col("cadence") == "CUSTOM", amount * F.lit("30.4375").cast("decimal(6,4)") / F.col("interval_days")).otherwise(month)
    return led.recurring_series.where(F.col("status") == "CONFIRMED").groupBy("workspace_id", "currency").agg(F.sum(month.cast("decimal(24,8)")).cast(MONEY).alias("monthly_baseline"))


def resolve_recurring(series: DataFrame, which: int, confirm: bool) -> DataFrame:
    """A candidate's state after a decision; a second one changes nothing."""
    now = (F.col("id") == which) & (F.col("status") == "CANDIDATE")
    return series.withColumn("status", F.when(now, "CONFIRMED" if confirm else "REJECTED").otherwise(F.col("status")))


def resolve_all(series: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series after decisions (workspace_id, id, confirm), and an audit row for each that changed something."""
    key = ["workspace_id", "id"]
    rows = series.join(decisions.groupBy(*key).agg(F.max("confirm").alias("confirm")), key, "left")
    now = F.col("confirm").isNotNull() & (F.col("status") == "CANDIDATE")
    word = F.when(F.col("confirm"), "CONFIRMED").otherwise("REJECTED")
    audit = rows.where(now).select(*key, F.concat(F.lit("RECURRING_SERIES_"), word).alias("event_type"))
    return rows.withColumn("status", F.when(now, word).otherwise(F.col("status"))).select(*series.columns), audit


def instalment_warnings(led: Ledger, now: str, top: int = SERIES_BOUND) -> DataFrame:
    """Per workspace, what the instalment list leaves open: estimated or not, how many series have no month, how many transactions no amount, accounts that are stale or need attention, and whether the list is cut."""
    fresh = freshness(led, now).groupBy("workspace_id").agg(F.count_if("is_stale").alias("stale"), F.count_if("needs_attention").alias("attention"))
    rows = instalment_list(led, top=top + 1)
    shown = (F.col("rank") <= top) & (F.col("remaining_instalments") > 0) & (F.col("status") == "CONFIRMED")
    told = rows.groupBy("workspace_id").agg(
        F.coalesce(F.max(shown), F.lit(False)).alias("estimated"),
        F.count_if(shown & (F.col("estimated_amount").isNull() | F.col("purchase_date").isNull())).alias("unallocated"),
        F.sum(F.when(F.col("rank") <= top, F.col("unconverted_transaction_count")).otherwise(0)).alias("unconverted"),
        (F.max("rank") > top).alias("truncated"),
    )
    return fresh.join(told, "workspace_id", "left").na.fill(False, ["estimated", "truncated"]).na.fill(0, ["unallocated", "unconverted"])


def bounded(rows: DataFrame, most: int, what: str) -> DataFrame:
    """The rows, or an error if they are more than a report may hold; counts one row beyond the bound at most."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows
