"""Further made-up tables over the ledger, for operators that take deliveries, requests and decisions. One text serves both engines.

All rows of a table take part: arithmetic on the keys says what happens to a row, never whether it is there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import ledger
from .ledger import NOW, load

WHEN = f"timestamp '{NOW}'"

INPUTS: dict[str, str] = {
    "stored_transaction": f"""
        select workspace_id, cast(id as string) as provider_id, account_id, status, local_date, provider_amount as amount, description,
               cast(bill_id as string) as provider_bill_id, case when id % 2 = 0 then bill_id end as bill_id, direction, role,
               case id % 3 when 0 then 'HEURISTIC' when 1 then 'RULE' else 'NONE' end as role_source, duplicate_status,
               case when status = 'DELETED' then {WHEN} - interval '10' day end as deleted_at, id
        from transaction""",
    "landed_page": """
        select workspace_id, provider_id, account_id, case id % 16 when 0 then 'DELETED' when 1 then 'POSTED' else status end as status, local_date,
               cast(case when id % 5 = 0 then amount + 1 else amount end as decimal(20,6)) as amount, description, provider_bill_id,
               case id % 4 when 0 then 'CREDIT' when 1 then null else 'DEBIT' end as provider_type, case when id % 29 = 0 then 'LATE_FEE' end as fee_type, 1 as position
        from stored_transaction
        union all
        select workspace_id, provider_id, account_id, 'PENDING' as status, local_date, amount, 'an earlier state' as description, provider_bill_id,
               null as provider_type, null as fee_type, 0 as position
        from stored_transaction
        union all
        select workspace_id, concat('n', provider_id) as provider_id, account_id, case when id % 23 = 0 then 'DELETED' else 'POSTED' end as status, local_date,
               cast(case when id % 4 = 0 then amount else amount + 7 end as decimal(20,6)) as amount, description, provider_bill_id,
               'DEBIT' as provider_type, null as fee_type, 2 as position
        from stored_transaction""",
    "landed_bill": """
        select workspace_id, id, account_id, case when id % 2 = 0 then 'CLOSED' else status end as status, currency, due_date,
               cast(total_amount + id % 3 as decimal(20,6)) as total_amount from bill
        union all select workspace_id, id + 5000000000 as id, account_id, 'OPEN' as status, currency, due_date, total_amount from bill""",
    "landed_payment": """
        select workspace_id, id, bill_id, payment_date, cast(amount + id % 2 as decimal(20,6)) as amount, currency from bill_payment
        union all select workspace_id, id * 10 + 7 as id, id as bill_id, due_date as payment_date, cast(5 as decimal(20,6)) as amount, currency from bill""",
    "found_connection": """
        select workspace_id, cast(id as string) as external_id, case id % 5 when 0 then 'DELETED' when 1 then 'ACTIVE' when 2 then 'PROVIDER_ERROR' else 'SYNCING' end as local_status from connection
        union all select workspace_id, concat('new', cast(id as string)) as external_id, 'ACTIVE' as local_status from connection""",
    "stored_connection": f"""
        select workspace_id, id, cast(id as string) as external_id, case id % 7 when 0 then 'DISABLED' when 1 then 'DELETED' else local_status end as local_status,
               last_attempt_at, last_successful_sync_at, case when id % 7 = 1 then {WHEN} end as deleted_at from connection""",
    "snapshot": """
        select workspace_id, cast(id as string) as external_id,
               case id % 9 when 0 then 'REAUTH_REQUIRED' when 1 then 'ACTIVE' when 2 then 'PROVIDER_ERROR' when 3 then 'DELETED' when 4 then null else 'SYNCING' end as first_status,
               case id % 8 when 0 then null when 1 then 'USER_ACTION_REQUIRED' when 2 then 'SYNCING' else 'ACTIVE' end as settled_status from connection""",
    "sync_run": f"""
        select workspace_id, id * 10 + 1 as id, id * 10 + 1 as run_id, id as connection_id, case id % 4 when 0 then 'RUNNING' when 1 then 'FAILED' else 'SUCCEEDED' end as status,
               cast(id as string) as cursor, cast(null as string) as error_summary, {WHEN} - interval '30' day as started_at,
               case when id % 4 <> 0 then {WHEN} - interval '2' day end as finished_at from connection
        union all select workspace_id, id * 10 + 2 as id, id * 10 + 2 as run_id, id as connection_id, 'RUNNING' as status, cast(id as string) as cursor,
               cast(null as string) as error_summary, {WHEN} - interval '1' day as started_at, cast(null as timestamp) as finished_at from connection""",
    "job": f"""
        select user_id as workspace_id, event_id as id, case event_id % 5 when 0 then 'PENDING' when 1 then 'RETRY' when 2 then 'RUNNING' when 3 then 'DEAD' else 'SUCCEEDED' end as status,
               cast(event_id % 12 as int) as attempts, 10 as max_attempts, cast(event_id % 3 as int) as priority, concat('JOB:', cast(event_id % 40 as string)) as dedupe_key,
               case when event_id % 2 = 0 then {WHEN} - interval '1' hour else {WHEN} + interval '1' hour end as available_at, ts as created_at,
               case when event_id % 7 = 0 then {WHEN} - interval '1' hour else {WHEN} + interval '100' second end as lease_expires_at,
               case when event_id % 5 = 3 then ts end as finished_at from events""",
    "hook": """
        select user_id as workspace_id, event_id, cast(user_id % 150 + 1 as bigint) as connection_key, ts, case event_id % 10 when 0 then 'item/created' when 1 then 'item/updated' when 2 then 'item/deleted'
               when 3 then 'item/error' when 4 then 'transactions/created' when 5 then 'transactions/updated' when 6 then 'transactions/deleted' else 'item/login_succeeded' end as event,
               case event_id % 6 when 0 then 'PROCESSED' else 'RECEIVED' end as status, case event_id % 4 when 0 then 'ACTIVE' when 1 then 'USER_ACTION_REQUIRED' when 2 then null else 'SYNCING' end as snapshot_status
        from events""",
    "tag": """
        select workspace_id, id as transaction_id, case id % 3 when 0 then 'trip' when 1 then 'large' else 'home' end as tag from transaction where category_id = 3
        union all select workspace_id, id as transaction_id, 'extra' as tag from transaction where category_id = 3 and role = 'PURCHASE'""",
    "link": """
        select workspace_id, account_id, id as predecessor_id, lead(id) over (partition by workspace_id, account_id order by id) as successor_id,
               case id % 5 when 0 then 'NEEDS_REVIEW' when 1 then 'AUTO_CONFIRMED' when 2 then 'USER_CONFIRMED' when 3 then 'REJECTED' else 'NEEDS_REVIEW' end as status,
               cast(0.9 as decimal(5,4)) as score, case id % 7 when 0 then 'CONFIRM' when 1 then 'REJECT' end as decision from transaction""",
    "alias": """
        select workspace_id, id as merchant_id, lower(label) as alias, case id % 3 when 0 then 'EXACT' when 1 then 'PREFIX' else 'CONTAINS' end as match_type,
               cast(case id % 4 when 0 then 0.9 else 0.97 end as decimal(5,4)) as confidence, id % 11 <> 0 as is_active from merchant""",
    "rule_row": f"""
        select workspace_id, id, cast(id % 20 as int) as priority, case id % 3 when 0 then 'SYSTEM_SUGGESTION' else 'USER' end as source, id % 3 <> 0 and id % 4 <> 0 as is_active,
               {WHEN} - interval '5' day as created_at, {WHEN} - interval '5' day as updated_at, id % 30 as sets_category, id as sets_merchant from merchant""",
    "correction": """
        select workspace_id, id as transaction_id, case when id % 2 = 0 then id % 9 + 1 else 0 end as expected_version,
               case id % 4 when 0 then 'SET' when 1 then 'CLEAR' when 2 then 'INHERIT' end as category_mode, cast(6 as bigint) as category_value,
               case id % 5 when 0 then 'SET' when 1 then 'INHERIT' end as merchant_mode, merchant_id as merchant_value,
               case id % 6 when 0 then 'SET' when 1 then 'INHERIT' end as role_mode, 'FEE' as role_value,
               case id % 7 when 0 then 'SET' when 1 then 'INHERIT' end as exclusion_mode, id % 2 = 0 as excluded_value from transaction""",
}


def frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Those tables, and the tables they read."""
    led = load(spark, sf_dir)

    def known(name: str) -> DataFrame:
        if name in INPUTS:
            read = {m[1] for m in ledger.SOURCE.findall(INPUTS[name])}
            return spark.sql(ledger.SOURCE.sub(r"\1 {\2}", INPUTS[name]), **{t: known(t) for t in read})
        return getattr(led, name) if hasattr(led, name) else spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return [known(n) for n in names]


def ctes(*names: str) -> str:
    """The same as named parts, each behind those it reads, with a comma after each."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in INPUTS and name not in out:
            for m in ledger.SOURCE.findall(INPUTS[name]):
                add(m[1])
            out[name] = re.sub(r"\b(from|join) transaction\b", r'\1 "transaction"', INPUTS[name])

    for name in names:
        add(name)
    return "".join(f"{name} as ({select}),\n" for name, select in out.items())
