"""All registered ledger queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import Period, bank_date, comparison
from ..functions.money import plain
from ..operators import bills, commitments, effects, freshness, outlook, quality, spending
from . import more, oracle, reviews, writes
from .ledger import AS_OF, NOW, Ledger, load

SCOPE = spending.Scope(bank_date(oracle.START), bank_date(oracle.END), pending=True)
CURRENT, OTHER = comparison(Period(bank_date(oracle.START), bank_date(oracle.END)), "PREVIOUS_MONTH")
TODAY: date = bank_date(AS_OF)
EFFECT_COLUMNS = ["workspace_id", "id", "effective_category", "effective_merchant", "effective_role", "effective_source", "effective_excluded", "currency", "amount", "is_unconverted", "review_status", "version"]
SPEND = ["gross_spending", "refund_total", "net_spending", "spend_count"]
Build = Callable[[Ledger], DataFrame]

BUILDS: dict[str, Build] = {
    "v1_effective_transactions": lambda led: effects.effective(led).select(*EFFECT_COLUMNS),
    "v2_spend_effect": lambda led: effects.effects(led).select("workspace_id", "id", "currency", "status", "spend"),
    "v3_cash_effect": lambda led: effects.effects(led).select("workspace_id", "id", "currency", "status", "account_type", "cash"),
    "v4_bill_reconciliation": bills.reconciliation,
    "v5_history_coverage": freshness.history_coverage,
    "v6_needing_review": lambda led: effects.needing_review(led).select("workspace_id", "id", "review_status", "duplicate_status", "effective_role", "effective_category", "is_unconverted"),
    "v8_monthly_by_category": lambda led: effects.monthly_spend(led, "category"),
    "v9_monthly_by_merchant": lambda led: effects.monthly_spend(led, "merchant"),
    "v10_instalment_commitments": lambda led: commitments.instalment_commitments(led).select("workspace_id", "series_id", "currency", "total_instalments", "highest_confirmed", "remaining_instalments", "estimated_amount", "status", "posted_transaction_count", "posted_amount", "unconverted_transaction_count", "remaining_commitment"),
    "v11_freshness": lambda led: freshness.freshness(led, NOW),
    "v12_unclassified": lambda led: effects.unclassified(led).select("workspace_id", "id", "account_id", "effective_source"),
    "a2_totals": lambda led: spending.totals(led, SCOPE),
    "a3_category_breakdown": lambda led: spending.breakdown(led, SCOPE, "category").select("workspace_id", "currency", "status", "label", *SPEND, "is_truncated"),
    "a4_merchant_breakdown": lambda led: spending.breakdown(led, SCOPE, "merchant").select("workspace_id", "currency", "status", "label", *SPEND, "is_truncated"),
    "a5_series_day": lambda led: spending.series(led, SCOPE, "day"),
    "a5_series_week": lambda led: spending.series(led, SCOPE, "week"),
    "a5_series_month": lambda led: spending.series(led, SCOPE, "month"),
    "a6_freshness_summary": lambda led: freshness.freshness_summary(led, NOW),
    "a7_history_summary": lambda led: freshness.history_summary(led, SCOPE.start).withColumn("coverage_statuses", F.array_join("coverage_statuses", ",")),
    "a8_unconverted": lambda led: spending.unconverted_count(led, SCOPE),
    "a9_unreconciled_bills": lambda led: spending.unreconciled(led, SCOPE.start, SCOPE.end),
    "c2_compare_totals": lambda led: spending.compare_totals(led, CURRENT, OTHER),
    "c3_compare_categories": lambda led: spending.compare_categories(led, CURRENT, OTHER).drop("key", "of", "rank"),
    "c4_unreconciled_bills": lambda led: spending.unreconciled(led, SCOPE.start, SCOPE.end, touching=False),
    "n2_amount_spikes": lambda led: outlook.amount_spikes(led, TODAY),
    "n3_duplicate_like": lambda led: outlook.duplicate_like(led, TODAY),
    "n4_category_spikes": lambda led: outlook.category_spikes(led, TODAY),
    "n5_new_recurring": lambda led: outlook.new_recurring(led, TODAY),
    "n6_recurring_increases": lambda led: outlook.recurring_increases(led, TODAY),
    "n7_anomalies": lambda led: outlook.anomalies(led, TODAY),
    "m5_forecast": lambda led: outlook.forecast(led, TODAY),
    "i1_instalment_list": lambda led: commitments.instalment_list(led).select("workspace_id", "series_id", "status", "next_month", "remaining_commitment"),
    "i2_instalment_months": commitments.instalment_months,
    "r1_detect_recurring": lambda led: commitments.detect_recurring(led, TODAY),
    "r2_recurring_list": lambda led: commitments.recurring_list(led).select("workspace_id", "id", "cadence", "currency", "status", "merchant_label", "observation_count", "price_change_percent"),
    "r3_monthly_baseline": commitments.monthly_baseline,
    "r10_bill_summary": bills.summary,
    "r11_payment_candidates": bills.payment_candidates,
    "q1_source_report": quality.source_report,
    "q2_unclassified_queue": lambda led: quality.queue(led).select("workspace_id", "id", "local_date", "has_next"),
}


def query(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(build(load(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query(build) for name, build in BUILDS.items()} | more.QUERIES | writes.QUERIES | reviews.QUERIES
ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL | more.ORACLE_SQL | writes.ORACLE_SQL | reviews.ORACLE_SQL
