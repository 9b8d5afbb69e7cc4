"""Small ledgers with known results to the last decimal."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from ledgerglass.functions.dates import Period, comparison
from ledgerglass.operators import bills, commitments, outlook, spending
from ledgerglass.operators.freshness import freshness_summary, history_summary
from ledgerglass.plans.ledger import Ledger

M = "decimal(20,6)"
SCHEMAS = {
    "account": f"workspace_id long, id long, connection_id long, account_type string, currency string, name string, current_balance {M}, is_active boolean, last_successful_sync_at timestamp, earliest_date date, latest_date date, initial_import_completed_at timestamp, coverage_status string, deleted_at timestamp",
    "connection": "workspace_id long, id long, local_status string, last_attempt_at timestamp, last_successful_sync_at timestamp, deleted_at timestamp",
    "category": "id long, workspace_id long, label string, is_active boolean",
    "merchant": "workspace_id long, id long, label string, review_status string",
    "bill": f"workspace_id long, id long, account_id long, status string, currency string, due_date date, close_date date, total_amount {M}",
    "bill_payment": f"workspace_id long, id long, bill_id long, payment_date date, amount {M}, currency string",
    "bill_charge": f"workspace_id long, id long, bill_id long, charge_type string, amount {M}, currency string, matched_transaction_id long",
    "reconciliation": "workspace_id long, id long, payment_id long, bill_id long, transaction_id long, match_status string",
    "tolerance": f"currency string, tolerance_amount {M}",
    "transaction": f"workspace_id long, id long, account_id long, status string, provider_currency string, account_currency string, provider_amount {M}, account_amount {M}, direction string, role string, is_excluded boolean, local_date date, description string, category_id long, merchant_id long, category_source string, bill_id long, series_id long, duplicate_status string, deleted_at timestamp",
    "user_state": "workspace_id long, transaction_id long, category_override boolean, category_value long, merchant_override boolean, merchant_value long, role_override boolean, role_value string, excluded_value boolean, notes string, review_status string, version long",
    "instalment_series": f"workspace_id long, id long, account_id long, merchant_id long, currency string, total_instalments long, highest_confirmed long, estimated_amount {M}, original_total {M}, purchase_date date, status string",
    "recurring_series": f"workspace_id long, id long, merchant_id long, category_id long, cadence string, interval_days int, currency string, amount_min {M}, amount_max {M}, amount_average {M}, last_date date, next_date date, confidence decimal(5,4), status string, created_at timestamp",
}
D = Decimal


def make(spark, **tables):
    def rows(name):
        names = [x.strip().split()[0] for x in SCHEMAS[name].replace("decimal(20,6)", "m").replace("decimal(5,4)", "m").split(",")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in tables.get(name, [])], SCHEMAS[name])

    return Ledger(**{n: rows(n) for n in SCHEMAS})


def txn(id, account, day, amount, direction, role, status="POSTED", category=None, merchant=None, ws=1, **more):
    amount = D(amount)
    return {"workspace_id": ws, "id": id, "account_id": account, "status": status, "provider_currency": "BRL", "account_currency": "BRL", "provider_amount": amount, "account_amount": amount, "direction": direction, "role": role, "is_excluded": False, "local_date": date.fromisoformat(day), "category_id": category, "merchant_id": merchant, "category_source": "NONE", "duplicate_status": "NONE"} | more


def account(id, kind, **more):
    return {"workspace_id": 1, "id": id, "connection_id": 9, "account_type": kind, "currency": "BRL", "earliest_date": date(2026, 8, 10), "latest_date": date(2026, 8, 27), "coverage_status": "PARTIAL"} | more


@pytest.fixture(scope="module")
def august(spark):
    t = [
        txn(1, 1, "2026-08-05", "-100.000001", "OUTFLOW", "PURCHASE", category=1, merchant=5),
        txn(2, 2, "2026-08-06", "200.000002", "OUTFLOW", "PURCHASE", category=1, merchant=5, bill_id=3),
        txn(3, 2, "2026-08-07", "-20.000003", "INFLOW", "REFUND", category=1, merchant=5),
        txn(4, 1, "2026-08-08", "1000.000004", "INFLOW", "INCOME"),
        txn(5, 1, "2026-08-09", "-300.000005", "OUTFLOW", "TRANSFER"),
        txn(6, 1, "2026-08-10", "-200.000006", "OUTFLOW", "CARD_BILL_PAYMENT"),
        txn(7, 2, "2026-08-10", "-200.000006", "NEUTRAL", "CARD_BILL_PAYMENT", bill_id=3),
        txn(8, 2, "2026-08-11", "5.000007", "OUTFLOW", "FEE", category=1, bill_id=3),
        txn(9, 1, "2026-08-12", "-10.000008", "OUTFLOW", "PURCHASE", status="PENDING", category=1),
        txn(10, 1, "2026-08-13", "-99.000009", "OUTFLOW", "PURCHASE", category=1, duplicate_status="CONFIRMED_DUPLICATE"),
        txn(11, 1, "2026-08-14", "-50.000010", "OUTFLOW", "PURCHASE", category=1, is_excluded=True),
        txn(12, 1, "2026-08-15", "-12.000011", "OUTFLOW", "PURCHASE", category=1, provider_currency="USD", account_amount=None),
        txn(13, 1, "2026-07-05", "-95.000000", "OUTFLOW", "PURCHASE", category=1, merchant=5),
        txn(14, 7, "2026-08-05", "-999.000000", "OUTFLOW", "PURCHASE", ws=2),
    ]
    return make(
        spark,
        transaction=t,
        account=[account(1, "CHECKING"), account(2, "CREDIT_CARD"), account(7, "CHECKING", workspace_id=2)],
        connection=[{"workspace_id": 1, "id": 9, "local_status": "PROVIDER_ERROR", "last_successful_sync_at": datetime(2026, 8, 20, 12)}],
        category=[{"id": 1, "label": "A"}, {"id": 2, "label": "B"}],
        merchant=[{"workspace_id": 1, "id": 5, "label": "M", "review_status": "CONFIRMED"}],
        user_state=[{"workspace_id": 1, "transaction_id": 1, "category_override": True, "category_value": 2, "merchant_override": False, "role_override": False, "version": 1}],
        bill=[{"workspace_id": 1, "id": 3, "account_id": 2, "status": "OPEN", "currency": "BRL", "due_date": date(2026, 8, 30), "close_date": date(2026, 8, 20), "total_amount": D("390")}],
        bill_payment=[{"workspace_id": 1, "id": 4, "bill_id": 3, "payment_date": date(2026, 8, 10), "amount": D("200.000006"), "currency": "BRL"}],
        bill_charge=[{"workspace_id": 1, "id": 5, "bill_id": 3, "charge_type": "FEE", "amount": D("5.000007"), "currency": "BRL", "matched_transaction_id": 8}],
        reconciliation=[{"workspace_id": 1, "id": 6, "payment_id": 4, "bill_id": 3, "transaction_id": 6, "match_status": "USER_CONFIRMED"}],
        tolerance=[{"currency": "BRL", "tolerance_amount": D("0.01")}],
    )


SCOPE = spending.Scope(date(2026, 8, 1), date(2026, 8, 31), workspace=1, pending=True)


def test_totals(august):
    got = {r["status"]: r for r in spending.totals(august, SCOPE).collect()}
    p, q = got["POSTED"], got["PENDING"]
    assert (p["gross_spending"], p["refund_total"], p["net_spending"], p["spend_count"]) == (D("305.000010"), D("20.000003"), D("285.000007"), 4)
    assert (p["inflow_total"], p["outflow_total"], p["net_cashflow"], p["cashflow_count"]) == (D("1000.000004"), D("350.000017"), D("649.999987"), 4)
    assert (q["net_spending"], q["net_cashflow"]) == (D("10.000008"), D("-10.000008"))


def test_breakdown_uses_the_users_category(august):
    got = {(r["status"], r["label"]): r["net_spending"] for r in spending.breakdown(august, SCOPE, "category").collect()}
    assert got[("POSTED", "B")] == D("100.000001") and got[("POSTED", "A")] == D("185.000006")


def test_compare(august):
    now, then = comparison(Period(date(2026, 8, 1), date(2026, 8, 31)), "PREVIOUS_MONTH")
    r = spending.compare_totals(august, now, then).where("workspace_id = 1").first()
    assert (r["current_total"], r["comparison_total"], r["absolute_difference"], r["percentage_difference"]) == (D("285.000007"), D("95"), D("190.000007"), D("200.000007"))
    empty = spending.compare_totals(august, now, Period(date(2025, 1, 1), date(2025, 1, 31))).where("workspace_id = 1").first()
    assert empty["comparison_total"] == 0 and empty["percentage_difference"] is None


def test_warnings(august):
    h = history_summary(august, SCOPE.start).where("workspace_id = 1").first()
    f = freshness_summary(august, "2026-08-27 12:00:00").where("workspace_id = 1").first()
    u = spending.unconverted_count(august, SCOPE).first()[1]
    b = spending.unreconciled(august, SCOPE.start, SCOPE.end).where("workspace_id = 1").first()[1]
    assert (h["affected_account_count"], u, b, f["stale_count"], f["attention_count"]) == (2, 1, 1, 2, 2)
    codes = [w["code"] for w in spending.warnings(h.asDict(), u, b, f["stale_count"], f["attention_count"], [], SCOPE.start)]
    assert codes == ["INCOMPLETE_HISTORY", "UNCONVERTED_CURRENCY", "UNRECONCILED_BILL", "STALE_DATA", "CONNECTION_ATTENTION"]


@pytest.fixture(scope="module")
def outlook_ledger(spark):
    rows = [("S", "2026-05-01", 100), ("S", "2026-06-01", 100), ("S", "2026-07-01", 100), ("S", "2026-08-10", 200), ("S", "2026-08-20", 50), ("S", "2026-08-21", 50), ("R", "2026-06-05", 100), ("R", "2026-07-05", 100), ("R", "2026-08-05", 150)]
    ids = {"S": 1, "R": 2, "N": 3}
    series = {"workspace_id": 1, "cadence": "MONTHLY", "interval_days": 30, "currency": "BRL", "category_id": 1}
    return make(
        spark,
        transaction=[txn(k, 1, d, f"-{a}", "OUTFLOW", "PURCHASE", category=1, merchant=ids[m]) for k, (m, d, a) in enumerate(rows, 1)],
        account=[account(1, "CHECKING")],
        merchant=[{"workspace_id": 1, "id": v, "label": k, "review_status": "CONFIRMED"} for k, v in ids.items()],
        category=[{"id": 1, "label": "C"}],
        recurring_series=[
            series | {"id": 1, "merchant_id": 2, "amount_min": D(100), "amount_max": D(150), "amount_average": D(100), "last_date": date(2026, 8, 5), "next_date": date(2026, 8, 29), "status": "CONFIRMED", "created_at": datetime(2026, 8, 1)},
            series | {"id": 2, "merchant_id": 3, "amount_average": D(30), "last_date": date(2026, 8, 15), "next_date": date(2026, 9, 14), "status": "CANDIDATE", "created_at": datetime(2026, 8, 20)},
        ],
        instalment_series=[{"workspace_id": 1, "id": 1, "account_id": 1, "currency": "BRL", "total_instalments": 3, "highest_confirmed": 1, "estimated_amount": D(20), "purchase_date": date(2026, 7, 10), "status": "CONFIRMED"}],
    )


def test_forecast(outlook_ledger):
    r = outlook.forecast(outlook_ledger, date(2026, 8, 27)).first()
    assert [r[c] for c in ("actual_month_to_date", "run_rate_forecast", "confirmed_recurring_remaining", "confirmed_instalments_remaining", "commitment_floor_forecast", "forecast_total")] == [D("450"), D("516.666667"), D("100"), D("20"), D("570"), D("570")]


def test_all_anomaly_rules_fire(outlook_ledger):
    got = {r["rule"] for r in outlook.anomalies(outlook_ledger, date(2026, 8, 27)).collect()}
    assert got == {"MERCHANT_AMOUNT_SPIKE", "DUPLICATE_LIKE_CHARGE", "CATEGORY_SPEND_SPIKE", "NEW_RECURRING_MERCHANT", "RECURRING_AMOUNT_INCREASE"}


def test_recurring(spark):
    rows = [(1, "2026-06-01", 100), (1, "2026-07-01", 101), (1, "2026-08-01", 99), (2, "2026-06-01", 50), (2, "2026-06-10", 50), (2, "2026-08-25", 50)]
    led = make(spark, transaction=[txn(k, 1, d, f"-{a}", "OUTFLOW", "PURCHASE", merchant=m) for k, (m, d, a) in enumerate(rows, 1)], account=[account(1, "CHECKING")], merchant=[{"workspace_id": 1, "id": m, "label": str(m), "review_status": "CONFIRMED"} for m in (1, 2)])
    (r,) = commitments.detect_recurring(led, date(2026, 8, 27)).collect()
    assert (r["cadence"], r["expected_interval_days"], r["amount_average"]) == ("MONTHLY", 30, D(100))


def test_instalments(spark):
    base = {"workspace_id": 1, "account_id": 1}
    led = make(spark, instalment_series=[
        base | {"id": 1, "currency": "BRL", "total_instalments": 6, "highest_confirmed": 2, "estimated_amount": D("100.000001"), "original_total": D("600.000006"), "purchase_date": date(2026, 6, 10), "status": "CONFIRMED"},
        base | {"id": 2, "currency": "BRL", "total_instalments": 3, "highest_confirmed": 1, "estimated_amount": D(50), "purchase_date": date(2026, 7, 12), "status": "CANDIDATE"},
        base | {"id": 3, "currency": "USD", "total_instalments": 4, "highest_confirmed": 1, "status": "CONFIRMED"},
    ])
    got = [(str(r["month"]), r["estimated_amount"]) for r in commitments.instalment_months(led).orderBy("month").collect()]
    assert got == [(f"2026-{m:02d}-01", D("100.000001")) for m in (8, 9, 10, 11)]
    left = {r["series_id"]: r["remaining_commitment"] for r in commitments.instalment_commitments(led).collect()}
    assert left[1] == D("400.000004") and left[3] is None


def test_bill_candidates(spark):
    t = [
        txn(1, 2, "2026-08-10", "90", "OUTFLOW", "PURCHASE", bill_id=3),
        txn(2, 2, "2026-08-19", "10", "OUTFLOW", "PURCHASE", status="PENDING", bill_id=3),
        txn(3, 1, "2026-08-25", "-100.000000", "OUTFLOW", "CARD_BILL_PAYMENT"),
        txn(4, 1, "2026-08-26", "-100.005000", "OUTFLOW", "CARD_BILL_PAYMENT"),
    ]
    tables = {"transaction": t, "account": [account(1, "CHECKING"), account(2, "CREDIT_CARD")], "tolerance": [{"currency": "BRL", "tolerance_amount": D("0.01")}]}
    tables["bill"] = [{"workspace_id": 1, "id": 3, "account_id": 2, "status": "CLOSED", "currency": "BRL", "due_date": date(2026, 8, 25), "close_date": date(2026, 8, 20), "total_amount": D(100)}]
    tables["bill_payment"] = [{"workspace_id": 1, "id": 4, "bill_id": 3, "payment_date": date(2026, 8, 25), "amount": D(100), "currency": "BRL"}]
    led = make(spark, **tables)
    r = bills.summary(led).first()
    assert (r["linked_transaction_total"], r["posted_net_spending_total"], r["pending_purchase_total"], r["reconciliation_status"]) == (D(100), D(90), D(10), "NEEDS_REVIEW")
    assert [(x["transaction_id"], x["confidence"]) for x in bills.payment_candidates(led).orderBy("transaction_id").collect()] == [(3, D("1.0000")), (4, D("0.9500"))]
    done = make(spark, **tables, reconciliation=[{"workspace_id": 1, "id": 1, "payment_id": 4, "bill_id": 3, "transaction_id": 3, "match_status": "USER_CONFIRMED"}])
    assert bills.reconciliation(done).first()["reconciliation_status"] == "RECONCILED" and not bills.payment_candidates(done).count()
