"""Policies of single transactions as Columns: amounts, direction, role and effects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import zero

# Closed vocabularies (fixed values).
SPENDS, REFUNDS, DEPOSITS = ("PURCHASE", "FEE", "TAX"), ("REFUND", "CREDIT"), ("CHECKING", "SAVINGS")


def analytics_amount(account_amount: Column, provider_amount: Column, provider_currency: Column, account_currency: Column) -> Column:
    """The account's amount, else the provider's in the same currency, else null."""
    return F.coalesce(account_amount, F.when(provider_currency == account_currency, provider_amount))


def unconverted(account_amount: Column, provider_currency: Column, account_currency: Column) -> Column:
    return account_amount.isNull() & (provider_currency != account_currency)


def gone(deleted_at: Column, status: Column, duplicate: Column) -> Column:
    return deleted_at.isNotNull() | (status == "DELETED") | (duplicate == "CONFIRMED_DUPLICATE")


def spend_effect(is_gone: Column, excluded: Column, role: Column, amount: Column) -> Column:
    """0 for what does not count, even if its amount is unknown; null for an unknown amount that would count."""
    return F.when(is_gone | excluded, zero()).when(role.isin(*SPENDS), F.abs(amount)).when(role.isin(*REFUNDS), -F.abs(amount)).otherwise(zero()).cast("decimal(20,6)")


def cash_effect(is_gone: Column, account_type: Column, role: Column, direction: Column, amount: Column, internal: Column | None = None) -> Column:
    """Money that enters or leaves deposit accounts; exclusion from spending plays no part."""
    none = is_gone | ~account_type.isin(*DEPOSITS) | (role == "TRANSFER") | (F.lit(False) if internal is None else internal)
    return F.when(none, zero()).when(direction == "INFLOW", F.abs(amount)).when(direction == "OUTFLOW", -F.abs(amount)).otherwise(zero()).cast("decimal(20,6)")


def direction_of(account_type: Column, amount: Column, provider_type: Column) -> Column:
    """Cards by the amount's sign (positive is spending), deposits by the provider's word."""
    card = F.when(amount == 0, "NEUTRAL").when(amount < 0, "INFLOW").otherwise("OUTFLOW")
    deposit = F.when(provider_type == "DEBIT", "OUTFLOW").when(provider_type == "CREDIT", "INFLOW").otherwise("UNKNOWN")
    return F.when(account_type == "CREDIT_CARD", card).when(account_type.isin(*DEPOSITS), deposit).otherwise("UNKNOWN")


def role_of(account_type: Column, amount: Column, direction: Column, evidence: dict[str, Column]) -> Column:
    """The first evidence that holds decides, then the account's default. Evidence: payment, transfer, charge, tax, refund, withdrawal, income."""

    def has(name: str) -> Column:
        return F.coalesce(evidence.get(name, F.lit(False)), F.lit(False))

    card = F.when(amount < 0, "UNKNOWN_CREDIT").when(amount == 0, "UNKNOWN").otherwise("PURCHASE")
    deposit = F.when(direction == "OUTFLOW", "PURCHASE").when((direction == "INFLOW") & has("income"), "INCOME").when(direction == "INFLOW", "UNKNOWN_CREDIT").otherwise("UNKNOWN")
    return (
        F.when(has("payment"), "CARD_BILL_PAYMENT")
        .when(has("transfer"), "TRANSFER")
        .when(has("charge"), "FEE")
        .when(has("tax"), "TAX")
        .when(has("refund"), "REFUND")
        .when(has("withdrawal") & (direction == "OUTFLOW"), "CASH_WITHDRAWAL")
        .when(account_type == "CREDIT_CARD", card)
        .when(account_type.isin(*DEPOSITS), deposit)
        .otherwise("UNKNOWN")
    )


def effect_warnings(amount: Column, account_type: Column, role: Column, representation: Column, charge_matched: Column) -> Column:
    """Codes, in their order, of what a transaction's effects leave open."""
    evidence = representation.isin("BILL_FINANCE_CHARGE_EVIDENCE", "BILL_PAYMENT_EVIDENCE")
    codes = [
        (amount.isNull(), "UNCONVERTED_CURRENCY"),
        ((role == "UNKNOWN_CREDIT") & (account_type == "CREDIT_CARD"), "UNRESOLVED_CARD_CREDIT"),
        ((representation == "BILL_FINANCE_CHARGE_EVIDENCE") & ~F.coalesce(charge_matched, F.lit(False)), "UNRESOLVED_FINANCE_CHARGE"),
        (evidence, "BILL_EVIDENCE_NOT_COUNTED"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in codes]))


# Provider codes of a connection's life (fixed values).
REAUTH = ("ACCOUNT_CREDENTIALS_RESET", "INVALID_CREDENTIALS", "USER_AUTHORIZATION_REVOKED")
ACTION = ("USER_AUTHORIZATION_NOT_GRANTED", "USER_AUTHORIZATION_PENDING", "WAITING_USER_ACTION")
BUSY = (
    "ACCOUNTS_IN_PROGRESS", "CREATED", "CREDITCARDS_IN_PROGRESS", "IDENTITY_IN_PROGRESS", "INVESTMENT_TRANSACTIONS_IN_PROGRESS",
    "LOGIN_IN_PROGRESS", "LOGIN_MFA_IN_PROGRESS", "MERGING", "PAYMENT_DATA_IN_PROGRESS", "TRANSACTIONS_IN_PROGRESS",
)


def sync_status(event: Column, item: Column, execution: Column, error: Column) -> Column:
    """One connection status from what a provider says; the first rule that holds decides, and contradictions are errors."""

    def holds(*tests: Column) -> Column:
        return F.coalesce(F.greatest(*[F.coalesce(t, F.lit(False)) for t in (*tests, F.lit(False))]), F.lit(False))

    return (
        F.when(holds(event == "item/deleted"), "DELETED")
        .when(holds(item == "LOGIN_ERROR", execution.isin(*REAUTH), error.isin(*REAUTH)), "REAUTH_REQUIRED")
        .when(holds(item == "WAITING_USER_INPUT", execution == "WAITING_USER_INPUT", event == "item/waiting_user_input"), "USER_INPUT_REQUIRED")
        .when(holds(item == "WAITING_USER_ACTION", execution.isin(*ACTION), error.isin(*ACTION), event == "item/waiting_user_action"), "USER_ACTION_REQUIRED")
        .when(holds((item == "UPDATED") & execution.isin("SUCCESS", "PARTIAL_SUCCESS")), "ACTIVE")
        .when(holds(item == "UPDATING", execution.isin(*BUSY), event == "item/login_succeeded"), "SYNCING")
        .otherwise("PROVIDER_ERROR")
    )
