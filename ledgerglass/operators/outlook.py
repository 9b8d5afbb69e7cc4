"""Anomaly candidates and the month's forecast, as of a date."""

from __future__ import annotations

import calendar
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import shift_months
from ..functions.money import MONEY, share, total
from ..plans.ledger import Ledger
from .commitments import confirmed_merchants, countable, instalment_commitments, month_of
from .effects import effects, monthly_spend

LOOKBACK_DAYS, TOP = 210, 100
COLUMNS = ("workspace_id", "rule", "observed_on", "currency", "observed_value", "baseline_value", "threshold_value", "deviation_percent", "merchant_label", "category_label")


def recent(led: Ledger, as_of: date) -> DataFrame:
    return countable(led).where(F.col("local_date").between(F.date_sub(F.lit(as_of), LOOKBACK_DAYS), F.lit(as_of)))


def finding(rule: str, on: Column, observed: Column, baseline: Column | None, threshold: Column | None, deviation: Column | None, merchant: Column | None, category: Column | None) -> list[Column]:
    def amount(c: Column | None) -> Column:
        return (F.lit(None) if c is None else c).cast(MONEY)

    return [
        F.col("workspace_id"), F.lit(rule).alias("rule"), on.alias("observed_on"), F.col("currency"), amount(observed).alias("observed_value"), amount(baseline).alias("baseline_value"), amount(threshold).alias("threshold_value"),
        amount(deviation).alias("deviation_percent"), (F.lit(None) if merchant is None else merchant).cast("string").alias("merchant_label"), (F.lit(None) if category is None else category).cast("string").alias("category_label"),
    ]


def amount_spikes(led: Ledger, as_of: date) -> DataFrame:
    """This month's purchases above 1.5 times the median of three or more earlier ones of the merchant."""
    key, first = ["workspace_id", "effective_merchant", "currency"], F.lit(as_of.replace(day=1))
    every = recent(led, as_of).join(confirmed_merchants(led), key[:2])
    columns = [*key, "local_date", "id", "spend", "merchant_label"]
    now = every.where(F.col("local_date") >= first).select(*columns, F.lit(1).cast("bigint").alias("times"))
    # Only merchants with a row this month, and of the time before only how often each amount was seen.
    then = every.where(F.col("local_date") < first).join(now.select(*key).distinct(), key, "left_semi")
    then = then.groupBy(*key, "spend").agg(F.min("merchant_label").alias("merchant_label"), F.count("*").alias("times"))
    then = then.select(*key, F.lit(None).cast("date").alias("local_date"), F.lit(None).cast("bigint").alias("id"), "spend", "merchant_label", "times")
    before = Window.partitionBy(*key).orderBy("local_date", "id").rowsBetween(Window.unboundedPreceding, -1)
    median = F.percentile(F.col("spend").cast("double"), F.lit(0.5), F.col("times")).over(before).cast(MONEY)
    rows = now.unionByName(then).withColumns({"seen": F.sum("times").over(before), "median": median})
    high = rows.where((F.col("local_date") >= F.lit(as_of.replace(day=1))) & (F.col("seen") >= 3) & (F.col("median") > 0) & (F.col("spend") * 2 > F.col("median") * 3))
    m = F.col("median")
    return high.select(*finding("MERCHANT_AMOUNT_SPIKE", F.col("local_date"), F.col("spend"), m, m * 3 / 2, share(F.col("spend") - m, m), F.col("merchant_label"), None))


def duplicate_like(led: Ledger, as_of: date) -> DataFrame:
    """This month's purchases of an amount that the merchant already took within two days; the row before in that order is the latest."""
    before = Window.partitionBy("workspace_id", "effective_merchant", "currency", "spend").orderBy("local_date", "id")
    rows = recent(led, as_of).where("effective_merchant is not null").withColumn("prior", F.lag("local_date").over(before))
    rows = rows.where((F.col("local_date") >= F.lit(as_of.replace(day=1))) & (F.datediff("local_date", "prior") <= 2))
    names = led.merchant.select("workspace_id", F.col("id").alias("effective_merchant"), F.col("label").alias("merchant_label"))
    return rows.join(names, ["workspace_id", "effective_merchant"], "left").select(*finding("DUPLICATE_LIKE_CHARGE", F.col("local_date"), F.col("spend"), F.col("spend"), F.col("spend"), F.lit(0), F.col("merchant_label"), None))


def trailing(led: Ledger, as_of: date) -> DataFrame:
    """Category months of the three months before."""
    first = as_of.replace(day=1)
    return monthly_spend(led, "category").where((F.col("month") >= F.lit(shift_months(first, -3))) & (F.col("month") < F.lit(first)))


def categories(led: Ledger) -> DataFrame:
    return led.category.select(F.col("id").alias("category_id"), F.col("workspace_id").alias("of"), F.col("label").alias("category_label"))


def visible() -> Column:
    return F.col("of").isNull() | (F.col("of") == F.col("workspace_id"))


def category_spikes(led: Ledger, as_of: date) -> DataFrame:
    """Categories above 1.5 times their trailing average, cut to the days of the month that have passed."""
    key = ["workspace_id", "category_id", "currency"]
    now = recent(led, as_of).where((F.col("local_date") >= F.lit(as_of.replace(day=1))) & F.col("effective_category").isNotNull())
    now = now.groupBy("workspace_id", F.col("effective_category").alias("category_id"), "currency").agg(F.sum("spend").cast(MONEY).alias("observed"))
    past = trailing(led, as_of).where("category_id is not null").groupBy(*key).agg(F.sum("spend_amount").cast(MONEY).alias("past"), F.count("*").alias("months")).where("months >= 2 and past > 0")
    days = 3 * calendar.monthrange(as_of.year, as_of.month)[1]
    base = F.col("past") * as_of.day / F.lit(days)
    rows = now.join(past, key).join(categories(led), "category_id").where(visible() & (F.col("observed") * 2 * days > F.col("past") * 3 * as_of.day))
    # In whole numbers until the last division: observed / base - 1 = (observed * days - past * day) / (past * day).
    scaled = F.col("past") * as_of.day
    deviation = F.round((F.col("observed") * days - scaled).cast("decimal(26,6)") / scaled.cast("decimal(26,6)") * 100, 6)
    return rows.select(*finding("CATEGORY_SPEND_SPIKE", F.lit(as_of), F.col("observed"), base, scaled * 3 / F.lit(2 * days), deviation, None, F.col("category_label")))


def labelled_series(led: Ledger) -> DataFrame:
    names = led.merchant.select("workspace_id", F.col("id").alias("merchant_id"), F.col("label").alias("merchant_label"))
    kinds = led.category.select(F.col("id").alias("category_id"), F.col("label").alias("category_label"))
    return led.recurring_series.join(names, ["workspace_id", "merchant_id"]).join(kinds, "category_id", "left")


def new_recurring(led: Ledger, as_of: date) -> DataFrame:
    rows = labelled_series(led).where((F.col("status") == "CANDIDATE") & F.col("created_at").cast("date").between(F.lit(as_of.replace(day=1)), F.lit(as_of)))
    return rows.select(*finding("NEW_RECURRING_MERCHANT", F.col("last_date"), F.col("amount_average"), None, None, None, F.col("merchant_label"), F.col("category_label")))


def recurring_increases(led: Ledger, as_of: date) -> DataFrame:
    """Confirmed series whose latest purchase, if of this month, is above 1.1 times their average."""
    latest = recent(led, as_of).groupBy("workspace_id", F.col("effective_merchant").alias("merchant_id"), "currency").agg(F.max_by(F.struct("local_date", "spend"), F.struct("local_date", "id")).alias("last"))
    rows = labelled_series(led).where(F.col("status") == "CONFIRMED").join(latest, ["workspace_id", "merchant_id", "currency"])
    average = F.col("amount_average")
    rows = rows.where((F.col("last.local_date") >= F.lit(as_of.replace(day=1))) & (average > 0) & (F.col("last.spend") * 10 > average * 11))
    return rows.select(*finding("RECURRING_AMOUNT_INCREASE", F.col("last.local_date"), F.col("last.spend"), average, average * 11 / 10, share(F.col("last.spend") - average, average), F.col("merchant_label"), F.col("category_label")))


RULES = (amount_spikes, duplicate_like, category_spikes, new_recurring, recurring_increases)


def anomalies(led: Ledger, as_of: date, top: int = TOP) -> DataFrame:
    """All rules' findings, each workspace's first ones in order of rule, date and labels."""
    found = None
    for priority, rule in enumerate(RULES, 1):
        rows = rule(led, as_of).withColumn("priority", F.lit(priority))
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("workspace_id").orderBy("priority", F.col("observed_on").desc(), F.col("merchant_label").asc_nulls_last(), F.col("category_label").asc_nulls_last(), "currency", "observed_value")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*COLUMNS)


def month_to_date(led: Ledger, as_of: date) -> DataFrame:
    rows = effects(led).where((F.col("status") == "POSTED") & F.col("deleted_at").isNull() & (F.col("duplicate_status") != "CONFIRMED_DUPLICATE") & ~F.col("is_unconverted"))
    return rows.where(F.col("local_date").between(F.lit(as_of.replace(day=1)), F.lit(as_of))).groupBy("workspace_id", "currency").agg(total(F.col("spend")).alias("amount"))


def recurring_due(led: Ledger, as_of: date) -> DataFrame:
    """Occurrences from the next one after the date to the month's end, in closed form."""
    end = F.lit(as_of.replace(day=calendar.monthrange(as_of.year, as_of.month)[1]))
    due = led.recurring_series.where((F.col("status") == "CONFIRMED") & (F.col("next_date") > F.lit(as_of)) & (F.col("next_date") <= end))
    times = F.floor(F.datediff(end, F.col("next_date")) / F.col("interval_days")) + 1
    return due.groupBy("workspace_id", "currency").agg(F.sum(F.col("amount_average") * times).cast(MONEY).alias("amount"))


def instalments_due(led: Ledger, as_of: date) -> DataFrame:
    open_ = instalment_commitments(led).where((F.col("status") == "CONFIRMED") & (F.col("remaining_instalments") > 0) & F.col("estimated_amount").isNotNull())
    due = open_.where(month_of(F.col("purchase_date"), F.col("highest_confirmed").cast("int")) == F.lit(as_of.replace(day=1)))
    return due.groupBy("workspace_id", "currency").agg(F.sum("estimated_amount").cast(MONEY).alias("amount"))


def trailing_average(led: Ledger, as_of: date) -> DataFrame:
    return trailing(led, as_of).groupBy("workspace_id", "currency").agg((F.sum("spend_amount").cast(MONEY) / 3).cast(MONEY).alias("amount"))


def forecast(led: Ledger, as_of: date) -> DataFrame:
    """The larger of the run rate and of what is spent and committed, never their sum. One grouping joins the four parts."""
    days = calendar.monthrange(as_of.year, as_of.month)[1]
    parts = {"actual": month_to_date, "recurring": recurring_due, "instalments": instalments_due, "average": trailing_average}
    rows = None
    for name, part in parts.items():
        own = part(led, as_of).withColumn("part", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    amounts = rows.groupBy("workspace_id", "currency").agg(*[total(F.when(F.col("part") == name, F.col("amount"))).alias(name) for name in parts])
    actual, known = F.col("actual"), F.col("recurring") + F.col("instalments")
    rate = lambda n: (actual * n / as_of.day).cast(MONEY)
    return amounts.select(
        "workspace_id", "currency", F.lit(as_of.day).alias("elapsed_days"), F.lit(days - as_of.day).alias("remaining_days"), actual.alias("actual_month_to_date"), rate(days - as_of.day).alias("run_rate_remaining"),
        rate(days).alias("run_rate_forecast"), F.col("recurring").alias("confirmed_recurring_remaining"), F.col("instalments").alias("confirmed_instalments_remaining"), known.cast(MONEY).alias("known_commitments_remaining"),
        (actual + known).cast(MONEY).alias("commitment_floor_forecast"), F.greatest(rate(days), (actual + known).cast(MONEY)).alias("forecast_total"), F.col("average").alias("trailing_three_month_average"),
    )
