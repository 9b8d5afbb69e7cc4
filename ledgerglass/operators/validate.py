"""Integrity rules that no table enforces here: each gives the rows that break it (rule, workspace_id, id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import DEPOSITS
from ..plans.ledger import Ledger
from .bills import ACTIVE, close_enough
from .effects import effective


def broken(rows: DataFrame, rule: str, key: str = "id") -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), "workspace_id", F.col(key).cast("bigint").alias("id"))


def repeated(rows: DataFrame, keys: list[str], rule: str, named: str) -> DataFrame:
    """Keys that more than one row has; null shares nothing."""
    known = rows.dropna(subset=keys)
    return broken(known.groupBy(*keys).count().where("count > 1"), rule, named)


def visible_category(rows: DataFrame, categories: DataFrame, column: str, rule: str) -> DataFrame:
    """References to a category that is neither global nor of the row's workspace; one equal join, the rest is counted per row."""
    known = categories.select(F.col("id").alias(column), F.col("workspace_id").alias("of"), F.lit(True).alias("found"))
    seen = F.max(F.coalesce(F.col("found") & (F.col("of").isNull() | (F.col("of") == F.col("workspace_id"))), F.lit(False)))
    joined = rows.select("workspace_id", F.col("id").alias("row_id"), column).where(F.col(column).isNotNull()).join(known, column, "left")
    return broken(joined.groupBy("workspace_id", "row_id").agg(seen.alias("seen")).where(~F.col("seen")), rule, "row_id")


def category_parents(categories: DataFrame) -> DataFrame:
    """Categories under a parent of another workspace, or global ones under a parent of one."""
    parents = categories.select(F.col("id").alias("parent_id"), F.col("workspace_id").alias("of"))
    found = categories.join(parents, "parent_id").where(F.col("of").isNotNull() & ~F.col("of").eqNullSafe(F.col("workspace_id")))
    return broken(found, "CATEGORY_PARENT")


def immutable_categories(before: DataFrame, after: DataFrame) -> DataFrame:
    """Categories whose workspace or code was changed."""
    old = before.select("id", F.col("workspace_id").alias("old_workspace"), F.col("code").alias("old_code"))
    same = F.col("old_workspace").eqNullSafe(F.col("workspace_id")) & F.col("old_code").eqNullSafe(F.col("code"))
    return broken(after.join(old, "id").where(~same), "CATEGORY_IMMUTABLE")


def bill_accounts(led: Ledger) -> DataFrame:
    cards = led.account.where("account_type = 'CREDIT_CARD'").select("workspace_id", F.col("id").alias("account_id"))
    return broken(led.bill.join(cards, ["workspace_id", "account_id"], "left_anti"), "BILL_ACCOUNT")


def transaction_bills(led: Ledger) -> DataFrame:
    own = led.bill.select("workspace_id", F.col("id").alias("bill_id"), "account_id")
    return broken(led.transaction.where("bill_id is not null").join(own, ["workspace_id", "bill_id", "account_id"], "left_anti"), "TRANSACTION_BILL")


def matched_accounts(children: DataFrame, led: Ledger, column: str, kinds: tuple[str, ...], rule: str) -> DataFrame:
    """Children matched to a transaction of an account of another kind."""
    kind = led.account.select("workspace_id", F.col("id").alias("account_id"), "account_type")
    of = led.transaction.select("workspace_id", F.col("id").alias(column), "account_id").join(kind, ["workspace_id", "account_id"])
    return broken(children.drop("account_id", "account_type").join(of, ["workspace_id", column]).where(~F.col("account_type").isin(*kinds)), rule)


def child_evidence(children: DataFrame, led: Ledger, column: str, rule: str) -> DataFrame:
    """Children in another currency than their bill, or matched to a transaction of another account, currency or bill."""
    bill = led.bill.select("workspace_id", F.col("id").alias("bill_id"), F.col("account_id").alias("bill_account"), F.col("currency").alias("bill_currency"))
    tx = effective(led).select("workspace_id", F.col("id").alias(column), F.col("account_id").alias("tx_account"), F.col("currency").alias("tx_currency"), F.col("bill_id").alias("tx_bill"))
    rows = children.join(bill, ["workspace_id", "bill_id"]).join(tx, ["workspace_id", column], "left")
    other = (F.col("tx_account") != F.col("bill_account")) | (F.col("tx_currency") != F.col("bill_currency")) | (F.col("tx_bill") != F.col("bill_id"))
    return broken(rows.where((F.col("currency") != F.col("bill_currency")) | F.coalesce(other, F.lit(False))), rule)


def active_matches(led: Ledger) -> DataFrame:
    """Active matches that are not a live deposit outflow of the payment's currency, amount and date, or confirmed by nobody."""
    paid = led.bill_payment.select("workspace_id", F.col("id").alias("payment_id"), "amount", "currency", "payment_date").join(led.tolerance, "currency", "left")
    kinds = led.account.select("workspace_id", F.col("id").alias("account_id"), "account_type")
    tx = effective(led).join(kinds, ["workspace_id", "account_id"]).select(
        "workspace_id", F.col("id").alias("transaction_id"), F.abs("amount").alias("paid"), F.col("currency").alias("tx_currency"), "local_date", "direction", "effective_role", F.col("status").alias("tx_status"), "deleted_at", "account_type"
    )
    rows = led.reconciliation.where(F.col("match_status").isin(*ACTIVE)).join(paid, ["workspace_id", "payment_id"], "left").join(tx, ["workspace_id", "transaction_id"], "left")
    live = (F.col("tx_status") != "DELETED") & F.col("deleted_at").isNull() & (F.col("direction") == "OUTFLOW") & (F.col("effective_role") == "CARD_BILL_PAYMENT")
    confirmed = (F.col("match_status") != "USER_CONFIRMED") | (F.trim("confirmed_by") != "") if "confirmed_by" in rows.columns else F.lit(True)
    sound = live & F.col("account_type").isin(*DEPOSITS) & (F.col("currency") == F.col("tx_currency")) & close_enough() & confirmed
    return broken(rows.where(~F.coalesce(sound, F.lit(False))), "ACTIVE_MATCH")


def rule_categories(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Rules (workspace_id, id, actions: array of type and value) that set a category which is not active and visible."""
    known = categories.where("is_active").select(F.col("id").cast("string").alias("value"), F.col("workspace_id").alias("of"), F.lit(True).alias("found"))
    each = rules.select("workspace_id", "id", F.explode(F.filter("actions", lambda a: a["type"] == "SET_CATEGORY")).alias("a")).select("workspace_id", "id", F.col("a.value").alias("value"))
    seen = F.max(F.coalesce(F.col("found") & (F.col("of").isNull() | (F.col("of") == F.col("workspace_id"))), F.lit(False)))
    return broken(each.join(known, "value", "left").groupBy("workspace_id", "id", "value").agg(seen.alias("seen")).where(~F.col("seen")), "RULE_CATEGORY").distinct()


def instalment_facts(rows: DataFrame) -> DataFrame:
    """Series whose progress is outside 0 to their total, or whose amounts are negative."""
    sound = (F.col("total_instalments") >= 1) & F.col("highest_confirmed").between(0, F.col("total_instalments")) & (F.coalesce("estimated_amount", F.lit(0)) >= 0) & (F.coalesce("original_total", F.lit(0)) >= 0)
    return broken(rows.where(~F.coalesce(sound, F.lit(False))), "INSTALMENT_FACTS")


def recurring_facts(rows: DataFrame) -> DataFrame:
    """Series whose average is not between least and largest amount."""
    return broken(rows.where(~F.coalesce(F.col("amount_average").between(F.col("amount_min"), F.col("amount_max")), F.lit(False))), "RECURRING_FACTS")


def every(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def sound(found: DataFrame) -> None:
    """Raises if any rule is broken; to be called before a version of the tables is published."""
    first = found.first()
    if first is not None:
        raise ValueError(f"{first['rule']} is broken by {first['id']} of workspace {first['workspace_id']}")
