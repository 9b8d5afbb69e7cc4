"""Ledger tables over the benchmark tables: one set of projections, rendered for Spark and for the checking engine.

Orders become transactions, customers accounts, nations merchants and categories; subscriptions, bill payments and
instalment plans are added by key arithmetic, so that detectors have something to find.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: A table that a SELECT reads.
SOURCE = re.compile(r"\b(from|join) (\w+)")
SOURCES = ("customer", "nation", "region", "orders")
#: Instants that stand for "now" in the registered queries (arguments of every operator).
AS_OF, NOW = "1998-08-20", "1998-08-20 12:00:00"


def plus_days(day: str, n: str, dialect: str) -> str:
    return f"date_add({day}, cast({n} as int))" if dialect == "spark" else f"cast({day} + cast({n} as integer) as date)"


def plus_hours(instant: str, n: str, dialect: str) -> str:
    return f"timestampadd(HOUR, -({n}), {instant})" if dialect == "spark" else f"({instant} - to_hours({n}))"


def month_number(day: str) -> str:
    return f"(year({day}) * 12 + month({day}))"


def tables(dialect: str) -> dict[str, str]:
    """Name to SELECT, in the order of their dependence; a SELECT may read the ones before it."""

    def days(day: str, n: str) -> str:
        return plus_days(day, n, dialect)

    def hours(instant: str, n: str) -> str:
        return plus_hours(instant, n, dialect)

    money = "cast({} as decimal(20,6))".format
    text = "cast({} as {})".format("{}", "string" if dialect == "spark" else "varchar").format
    when = f"timestamp '{NOW}'"
    return {
        "account": f"""
            select cast(n_regionkey as bigint) as workspace_id, c_custkey as id, n_regionkey * 100 + c_custkey % 20 as connection_id,
                case c_mktsegment when 'BUILDING' then 'CHECKING' when 'HOUSEHOLD' then 'SAVINGS' when 'AUTOMOBILE' then 'CREDIT_CARD' when 'MACHINERY' then 'INVESTMENT' else 'OTHER' end as account_type,
                case n_nationkey % 3 when 0 then 'BRL' when 1 then 'USD' else 'EUR' end as currency, c_name as name, {money("c_acctbal")} as current_balance,
                c_custkey % 29 <> 0 as is_active, case when c_custkey % 7 <> 0 then {hours(when, "c_custkey % 50")} end as last_successful_sync_at,
                case when c_custkey % 11 <> 0 then {days("date '1995-01-01'", "c_custkey % 1400")} end as earliest_date, date '1998-08-19' as latest_date,
                case when c_custkey % 13 <> 0 then {hours(when, "c_custkey % 90")} end as initial_import_completed_at,
                case c_custkey % 4 when 0 then 'PARTIAL' when 1 then 'PROVIDER_MAXIMUM_RETRIEVED' when 2 then 'UNKNOWN' else 'USER_EXTENDED_HISTORY' end as coverage_status,
                case when c_custkey % 53 = 0 then {when} end as deleted_at
            from customer join nation on c_nationkey = n_nationkey""",
        "connection": f"""
            select distinct workspace_id, connection_id as id,
                case connection_id % 6 when 0 then 'ACTIVE' when 1 then 'SYNCING' when 2 then 'ACTIVE' when 3 then 'ERROR' when 4 then 'ACTIVE' else 'NEEDS_REAUTH' end as local_status,
                {hours(when, "connection_id % 9")} as last_attempt_at, case when connection_id % 5 <> 0 then {hours(when, "connection_id % 40")} end as last_successful_sync_at,
                case when connection_id % 17 = 0 then {when} end as deleted_at
            from account""",
        "category": "select cast(n_nationkey as bigint) as id, cast(null as bigint) as workspace_id, concat('Category ', n_name) as label, n_nationkey <> 8 as is_active from nation where n_nationkey < 9",
        "merchant": f"""
            select cast(r_regionkey as bigint) as workspace_id, cast(r_regionkey * 100 + n_nationkey as bigint) as id, concat('Merchant ', n_name) as label,
                case when n_nationkey % 5 <> 0 then 'CONFIRMED' else 'PROVISIONAL' end as review_status from region cross join nation
            union all select workspace_id, id + 1000000 as id, concat('Plan ', {text("id")}) as label, 'CONFIRMED' as review_status from account where id % 5 = 0""",
        "order_row": f"""
            select a.workspace_id, o.o_orderkey as id, a.id as account_id, a.account_type, a.currency as account_currency,
                case when o.o_orderkey % 37 = 0 then 'DELETED' when o.o_orderstatus = 'O' then 'PENDING' else 'POSTED' end as status,
                case when o.o_orderkey % 13 = 0 then 'TRANSFER' when o.o_orderkey % 13 = 1 then 'INCOME' when o.o_orderkey % 13 = 2 then 'CARD_BILL_PAYMENT' when o.o_orderkey % 13 = 3 then 'REFUND'
                     when o.o_orderkey % 13 = 4 then 'FEE' when o.o_orderkey % 13 = 5 then 'TAX' when o.o_orderkey % 13 = 6 then 'CREDIT' when o.o_orderkey % 13 = 7 then 'UNKNOWN' else 'PURCHASE' end as role,
                {money("o.o_totalprice")} as amount, case when o.o_orderkey % 11 = 0 then 'GBP' else a.currency end as provider_currency, cast(o.o_orderdate as date) as local_date,
                case when o.o_orderkey % 9 <> 8 then cast(o.o_orderkey % 9 as bigint) end as category_id, a.workspace_id * 100 + o.o_custkey % 25 as merchant_id, o.o_orderpriority as priority, o.o_custkey as custkey
            from orders o join account a on a.id = o.o_custkey""",
        "transaction_base": f"""
            select workspace_id, id, account_id, status, provider_currency, account_currency,
                case when role in ('INCOME', 'REFUND', 'CREDIT') then amount else -amount end as provider_amount,
                case when id % 22 = 0 or (id % 11 = 0 and id % 3 = 0) then cast(null as decimal(20,6)) when role in ('INCOME', 'REFUND', 'CREDIT') then amount else -amount end as account_amount,
                case when role in ('INCOME', 'REFUND', 'CREDIT') then 'INFLOW' when role = 'UNKNOWN' then 'UNKNOWN' else 'OUTFLOW' end as direction, role, id % 43 = 0 as is_excluded, local_date,
                concat(case id % 4 when 0 then 'MP *' else '' end, 'Store ', priority, ' ', {text("custkey")}, case when id % 10 = 5 then ' PARC 02/10' else '' end) as description,
                category_id, merchant_id, case when id % 6 = 0 then 'RULE' when category_id is null then 'NONE' else 'PROVIDER' end as category_source,
                case when account_type = 'CREDIT_CARD' then account_id * 100000 + {month_number("local_date")} end as bill_id, case when custkey % 4 = 1 and id % 10 = 0 then custkey end as series_id,
                case when id % 41 = 0 then 'CONFIRMED_DUPLICATE' when id % 41 = 1 then 'POSSIBLE' else 'NONE' end as duplicate_status, case when id % 101 = 0 then {when} end as deleted_at
            from order_row""",
        "bill": f"""
            select workspace_id, bill_id as id, min(account_id) as account_id, case when bill_id % 3 = 0 then 'OPEN' else 'CLOSED' end as status, min(account_currency) as currency,
                {days("max(local_date)", "10")} as due_date, max(local_date) as close_date,
                case when bill_id % 31 = 0 then cast(null as decimal(20,6)) else cast(sum(abs(account_amount)) + bill_id % 2 as decimal(20,6)) end as total_amount
            from transaction_base where bill_id is not null and account_amount is not null group by workspace_id, bill_id""",
        "bill_payment": "select workspace_id, id * 10 + 1 as id, id as bill_id, due_date as payment_date, total_amount as amount, currency from bill where id % 4 <> 0 and total_amount is not null",
        "bill_charge": f"select workspace_id, id * 10 + 2 as id, id as bill_id, 'INTEREST' as charge_type, {money('id % 90 + 1')} as amount, currency, case when id % 10 = 0 then id end as matched_transaction_id from bill where id % 5 = 0",
        "reconciliation": "select workspace_id, id * 10 + 3 as id, id as payment_id, bill_id + 100000000000 as transaction_id, case bill_id % 9 when 0 then 'AUTO_MATCHED' when 3 then 'USER_CONFIRMED' else 'CANDIDATE' end as match_status from bill_payment where bill_id % 3 = 0",
        "tolerance": f"select 'BRL' as currency, {money('0.01')} as tolerance_amount union all select 'USD' as currency, {money('0.02')} as tolerance_amount",
        "deposit_account": "select workspace_id, currency, min(id) as account_id from account where account_type in ('CHECKING', 'SAVINGS') group by workspace_id, currency",
        "transaction": f"""
            select * from transaction_base
            union all select p.workspace_id, p.bill_id + 100000000000 as id, d.account_id, 'POSTED' as status, p.currency as provider_currency, p.currency as account_currency,
                -p.amount - {money('0.005')} * (p.bill_id % 2) as provider_amount, -p.amount - {money('0.005')} * (p.bill_id % 2) as account_amount, 'OUTFLOW' as direction, 'CARD_BILL_PAYMENT' as role, false as is_excluded,
                {days("p.payment_date", "p.bill_id % 5 - 1")} as local_date, 'Card payment' as description, cast(null as bigint) as category_id, cast(null as bigint) as merchant_id, 'NONE' as category_source,
                cast(null as bigint) as bill_id, cast(null as bigint) as series_id, 'NONE' as duplicate_status, cast(null as timestamp) as deleted_at
                from bill_payment p join deposit_account d on d.workspace_id = p.workspace_id and d.currency = p.currency
            union all select a.workspace_id, 200000000000 + a.id * 100 + k.n_nationkey as id, a.id as account_id, 'POSTED' as status, a.currency as provider_currency, a.currency as account_currency,
                -{money("20 + a.id % 7 + case when k.n_nationkey = 11 and a.id % 15 = 0 then 60 when k.n_nationkey = 12 and a.id % 25 = 0 then 0 else k.n_nationkey % 2 end")} as provider_amount,
                -{money("20 + a.id % 7 + case when k.n_nationkey = 11 and a.id % 15 = 0 then 60 when k.n_nationkey = 12 and a.id % 25 = 0 then 0 else k.n_nationkey % 2 end")} as account_amount,
                'OUTFLOW' as direction, 'PURCHASE' as role, false as is_excluded, {days("date '1997-09-10'", "case when k.n_nationkey = 12 then 331 when k.n_nationkey = 13 then 332 else 30 * k.n_nationkey end")} as local_date,
                'Subscription' as description, cast(a.id % 3 as bigint) as category_id, a.id + 1000000 as merchant_id, 'MERCHANT' as category_source, cast(null as bigint) as bill_id, cast(null as bigint) as series_id,
                'NONE' as duplicate_status, cast(null as timestamp) as deleted_at
                from account a cross join nation k where a.id % 5 = 0 and (k.n_nationkey < 12 or (k.n_nationkey = 12 and a.id % 25 = 0) or (k.n_nationkey = 13 and a.id % 20 = 0))""",
        "user_state": """
            select workspace_id, id as transaction_id, id % 2 = 0 as category_override, case when id % 34 <> 0 then cast(id % 5 as bigint) end as category_value, id % 3 = 0 as merchant_override,
                workspace_id * 100 + id % 7 as merchant_value, id % 51 = 0 as role_override, 'FEE' as role_value, case when id % 4 = 1 then true when id % 4 = 2 then false end as excluded_value,
                case when id % 5 = 0 then 'note' end as notes, case when id % 85 = 0 then 'NEEDS_REVIEW' else 'REVIEWED' end as review_status, cast(id % 9 + 1 as bigint) as version
            from order_row where id % 17 = 0""",
        "instalment_series": f"""
            select workspace_id, id, id as account_id, workspace_id * 100 + id % 25 as merchant_id, currency, id % 10 + 3 as total_instalments, id % 4 as highest_confirmed,
                case when id % 12 <> 1 then {money("id % 500 + 1")} end as estimated_amount, {money("(id % 500 + 1) * (id % 10 + 3)")} as original_total,
                case when id % 28 <> 1 then {days("date '1998-01-10'", "id % 220")} end as purchase_date,
                case id % 5 when 0 then 'CANDIDATE' when 1 then 'CONFIRMED' when 2 then 'CONFIRMED' when 3 then 'NEEDS_REVIEW' else 'COMPLETED' end as status
            from account where id % 4 = 1""",
        "recurring_series": f"""
            select workspace_id, id, id + 1000000 as merchant_id, cast(id % 3 as bigint) as category_id, case id % 4 when 0 then 'MONTHLY' when 1 then 'WEEKLY' when 2 then 'QUARTERLY' else 'CUSTOM' end as cadence,
                case id % 4 when 0 then 30 when 1 then 7 when 2 then 91 else 45 end as interval_days, currency, {money("20 + id % 7")} as amount_min, {money("22 + id % 7")} as amount_max, {money("21 + id % 7")} as amount_average,
                date '1998-07-07' as last_date, {days("date '1998-08-21'", "id % 20")} as next_date, cast(0.9 as decimal(5,4)) as confidence,
                case id % 3 when 0 then 'CONFIRMED' when 1 then 'CANDIDATE' else 'REJECTED' end as status, {hours(when, "24 * (id % 40)")} as created_at
            from account where id % 10 = 0""",
    }


@dataclass(frozen=True)
class Ledger:
    """The tables as DataFrames."""

    account: DataFrame
    connection: DataFrame
    category: DataFrame
    merchant: DataFrame
    bill: DataFrame
    bill_payment: DataFrame
    bill_charge: DataFrame
    reconciliation: DataFrame
    tolerance: DataFrame
    transaction: DataFrame
    user_state: DataFrame
    instalment_series: DataFrame
    recurring_series: DataFrame


#: Plans of the last folders read, by application: they hold no data, only save analysing the same text again.
PLANS: dict[tuple[str, str], Ledger] = {}


def load(spark: SparkSession, sf_dir: str) -> Ledger:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in PLANS:
        if len(PLANS) > 8:
            PLANS.clear()
        PLANS[key] = build(spark, sf_dir)
    return PLANS[key]


def build(spark: SparkSession, sf_dir: str) -> Ledger:
    known = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in SOURCES}
    for name, select in tables("spark").items():
        read = {m[1] for m in SOURCE.findall(select)}
        known[name] = spark.sql(SOURCE.sub(r"\1 {\2}", select), **{t: known[t] for t in read})
    return Ledger(**{f: known[f] for f in Ledger.__dataclass_fields__})


def cte() -> str:
    """The same tables for the checking engine, as the head of a query."""
    return "with " + ",\n".join(f"{name} as ({select})" for name, select in tables("duckdb").items()) + ",\n"
