"""Card bills: what is linked, paid and charged, whether it reconciles, and which bank transactions may have paid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, total
from ..functions.policy import DEPOSITS
from ..plans.ledger import Ledger
from .effects import effective, effects

ACTIVE, WINDOW_DAYS = ("AUTO_MATCHED", "USER_CONFIRMED"), 2


def is_live():
    return (F.col("status") != "DELETED") & F.col("deleted_at").isNull() & (F.col("duplicate_status") != "CONFIRMED_DUPLICATE")


def bank_payments(led: Ledger) -> DataFrame:
    """Live outflows of deposit accounts that pay a card bill, with a known amount."""
    accounts = led.account.where(F.col("account_type").isin(*DEPOSITS)).select("workspace_id", F.col("id").alias("account_id"), F.col("deleted_at").alias("account_deleted_at"))
    rows = effective(led).where((F.col("effective_role") == "CARD_BILL_PAYMENT") & (F.col("direction") == "OUTFLOW") & is_live() & F.col("amount").isNotNull())
    return rows.join(accounts, ["workspace_id", "account_id"]).select("workspace_id", F.col("id").alias("transaction_id"), "currency", F.abs("amount").alias("paid"), "local_date", F.col("status").alias("transaction_status"), F.col("bill_id").alias("transaction_bill_id"), "account_deleted_at")


def close_enough():
    return (F.abs(F.col("paid") - F.col("amount")) <= F.col("tolerance_amount")) & (F.abs(F.datediff("local_date", "payment_date")) <= WINDOW_DAYS)


def reconciliation(led: Ledger) -> DataFrame:
    """Every bill with four sums of the same currency, each grouped before it joins."""
    key = ["workspace_id", "bill_id", "currency"]
    linked = effective(led).where("bill_id is not null").groupBy(*key).agg(
        F.sum(F.when(is_live(), F.abs("amount"))).alias("linked"), F.count_if("is_unconverted").alias("unconverted_count")
    )
    paid = led.bill_payment.groupBy(*key).agg(F.sum("amount").alias("paid_total"), F.count("*").alias("payments"))
    charged = led.bill_charge.groupBy(*key).agg(F.sum("amount").alias("charged"), F.count("*").alias("charges"), F.count_if(F.col("matched_transaction_id").isNull()).alias("open_charges"))
    matches = led.reconciliation.where(F.col("match_status").isin(*ACTIVE)).select("workspace_id", "payment_id", "transaction_id")
    payments = led.bill_payment.withColumnRenamed("id", "payment_id").join(led.tolerance, "currency")
    sure = payments.join(matches, ["workspace_id", "payment_id"]).join(bank_payments(led), ["workspace_id", "transaction_id", "currency"]).where(close_enough())
    confirmed = sure.groupBy(*key).agg(F.sum("paid").alias("confirmed"), F.countDistinct("payment_id").alias("confirmed_payments"))
    rows = led.bill.withColumnRenamed("id", "bill_id")
    for part in (linked, paid, charged, confirmed):
        rows = rows.join(part, key, "left")
    rows = rows.join(led.tolerance, "currency", "left")

    def n(name: str):
        return F.coalesce(name, F.lit(0))

    open_items = n("open_charges") + F.greatest(n("payments") - n("confirmed_payments"), F.lit(0)) + n("unconverted_count")
    out = rows.select(
        "workspace_id", "bill_id", "account_id", F.col("status").alias("bill_status"), "due_date", "close_date", "currency", F.col("total_amount").alias("bill_total"),
        n("linked").cast(MONEY).alias("linked_transaction_total"), n("paid_total").cast(MONEY).alias("payment_total"), n("charged").cast(MONEY).alias("finance_charge_total"),
        n("confirmed").cast(MONEY).alias("confirmed_bank_payment_total"), n("payments").alias("payment_count"), n("charges").alias("finance_charge_count"), n("confirmed_payments").alias("confirmed_bank_payment_count"),
        n("unconverted_count").alias("unconverted_transaction_count"), open_items.alias("unresolved_item_count"), "tolerance_amount", (F.col("total_amount") - n("linked")).cast(MONEY).alias("difference_amount"),
    )
    status = (
        F.when(F.col("bill_total").isNull(), "UNKNOWN")
        .when(F.col("tolerance_amount").isNull(), "TOLERANCE_REQUIRED")
        .when(F.col("unresolved_item_count") > 0, "NEEDS_REVIEW")
        .when(F.abs("difference_amount") <= F.col("tolerance_amount"), "RECONCILED")
        .otherwise("NEEDS_REVIEW")
    )
    return out.withColumn("reconciliation_status", status)


def summary(led: Ledger) -> DataFrame:
    """Reconciliation with net posted spending and gross pending purchases of each bill."""
    counted = effects(led).where(F.col("bill_id").isNotNull() & is_live())
    spent = counted.groupBy("workspace_id", "bill_id").agg(
        total(F.when(F.col("status") == "POSTED", F.col("spend"))).alias("posted"), total(F.when(F.col("status") == "PENDING", F.greatest(F.col("spend"), F.lit(0)))).alias("pending")
    )
    return reconciliation(led).join(spent, ["workspace_id", "bill_id"], "left").select(
        "workspace_id", "bill_id", "reconciliation_status", "linked_transaction_total", "difference_amount", F.coalesce("posted", F.lit(0)).cast(MONEY).alias("posted_net_spending_total"), F.coalesce("pending", F.lit(0)).cast(MONEY).alias("pending_purchase_total")
    )


def payment_candidates(led: Ledger) -> DataFrame:
    """Posted bank transactions that may have paid a bill payment: a band join, made an equi-join by day.

    A payment stands on each of the days that it may have been paid on, so the pair meets on workspace, currency and date.
    """
    active = led.reconciliation.where(F.col("match_status").isin(*ACTIVE))
    free = led.bill_payment.withColumnRenamed("id", "payment_id").join(active.select("workspace_id", "payment_id"), ["workspace_id", "payment_id"], "left_anti").join(led.tolerance, "currency")
    days = free.withColumn("local_date", F.explode(F.sequence(F.date_sub("payment_date", WINDOW_DAYS), F.date_add("payment_date", WINDOW_DAYS))))
    bank = bank_payments(led).where((F.col("transaction_status") == "POSTED") & F.col("account_deleted_at").isNull()).join(active.select("workspace_id", "transaction_id"), ["workspace_id", "transaction_id"], "left_anti")
    pairs = days.join(bank, ["workspace_id", "currency", "local_date"]).where(close_enough() & (F.col("transaction_bill_id").isNull() | (F.col("transaction_bill_id") == F.col("bill_id"))))
    exact = (F.col("paid") == F.col("amount")) & (F.col("local_date") == F.col("payment_date"))
    return pairs.select("workspace_id", "payment_id", "transaction_id", F.lit("CANDIDATE").alias("match_status"), F.lit("AMOUNT_DATE_ROLE_V1").alias("match_method"), F.when(exact, 1).otherwise(0.95).cast("decimal(5,4)").alias("confidence"))


def resolve_candidate(candidates: DataFrame, payment: int, transaction: int, confirm: bool) -> DataFrame:
    """The candidates after a decision: confirming one rejects the other open ones of its payment and of its transaction."""
    this = (F.col("payment_id") == payment) & (F.col("transaction_id") == transaction)
    rival = ((F.col("payment_id") == payment) | (F.col("transaction_id") == transaction)) & (F.col("match_status") == "CANDIDATE") & F.lit(confirm)
    return candidates.withColumn("match_status", F.when(this, "USER_CONFIRMED" if confirm else "REJECTED").when(rival, "REJECTED").otherwise(F.col("match_status")))


def resolve_all(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """The candidates after decisions (workspace_id, payment_id, transaction_id, confirm): a confirmed one rejects the open others of its payment and of its transaction."""
    key = ["workspace_id", "payment_id", "transaction_id"]
    rows = candidates.join(decisions.select(*key, "confirm"), key, "left")
    won = decisions.where("confirm")
    for column in ("payment_id", "transaction_id"):
        taken = won.select("workspace_id", column).distinct().withColumn(f"taken_{column}", F.lit(True))
        rows = rows.join(taken, ["workspace_id", column], "left")
    rival = F.coalesce("taken_payment_id", "taken_transaction_id", F.lit(False)) & (F.col("match_status") == "CANDIDATE")
    status = F.when(F.col("confirm"), "USER_CONFIRMED").when(~F.col("confirm"), "REJECTED").when(rival, "REJECTED").otherwise(F.col("match_status"))
    return rows.withColumn("match_status", status).select(*candidates.columns)


def candidate_list(led: Ledger, candidates: DataFrame, top: int = 20) -> DataFrame:
    """The best `top` candidates of each bill: the surest first, then by payment and transaction."""
    of = led.bill_payment.select("workspace_id", F.col("id").alias("payment_id"), "bill_id")
    order = Window.partitionBy("workspace_id", "bill_id").orderBy(F.col("confidence").desc(), "payment_id", "transaction_id")
    return candidates.join(of, ["workspace_id", "payment_id"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
