"""Queries of imports, deletions, syncs, the event inbox and the job queue, each beside its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import plain
from ..operators import imports
from ..sources import provider
from ..streaming import inbox
from . import oracle
from .inputs import WHEN, ctes, frames
from .ledger import NOW, load

M = oracle.m


def at() -> F.Column:
    return F.lit(NOW).cast("timestamp")


def imported(spark: SparkSession, sf_dir: str) -> imports.Imported:
    stored, page, account, bill = frames(spark, sf_dir, "stored_transaction", "landed_page", "account", "bill")
    return imports.import_transactions(stored, page, account, bill, at())


def snk2_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(imported(spark, sf_dir).transactions.drop("description", "account_id"))


def snk2_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imported(spark, sf_dir).revisions
    return found.select("workspace_id", "provider_id", "change_type", F.array_join(F.transform("changes", lambda c: c["field"]), ",").alias("fields"))


def snk2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(imported(spark, sf_dir).counts)


def snk2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(imported(spark, sf_dir).history)


IMPORT = f"""
p as (select l.*, a.account_type, b.id as bill_id from landed_page l join account a on a.workspace_id = l.workspace_id and a.id = l.account_id
  left join bill b on b.workspace_id = l.workspace_id and b.account_id = l.account_id and cast(b.id as varchar) = l.provider_bill_id
  qualify row_number() over (partition by l.workspace_id, l.provider_id order by position desc) = 1),
pd as (select *, case when account_type = 'CREDIT_CARD' then case when amount = 0 then 'NEUTRAL' when amount < 0 then 'INFLOW' else 'OUTFLOW' end
  when account_type in ('CHECKING', 'SAVINGS') then case provider_type when 'DEBIT' then 'OUTFLOW' when 'CREDIT' then 'INFLOW' else 'UNKNOWN' end else 'UNKNOWN' end as direction from p),
pr as (select *, case when fee_type is not null then 'FEE' when account_type = 'CREDIT_CARD' then case when amount < 0 then 'UNKNOWN_CREDIT' when amount = 0 then 'UNKNOWN' else 'PURCHASE' end
  when account_type in ('CHECKING', 'SAVINGS') then case direction when 'OUTFLOW' then 'PURCHASE' when 'INFLOW' then 'UNKNOWN_CREDIT' else 'UNKNOWN' end else 'UNKNOWN' end as role from pd),
im as (select coalesce(n.workspace_id, s.workspace_id) as workspace_id, coalesce(n.provider_id, s.provider_id) as provider_id, s.provider_id is not null as was, n.provider_id is not null as came,
    coalesce(n.account_id, s.account_id) as account_id, case when n.provider_id is null then s.status else n.status end as status, case when n.provider_id is null then s.local_date else n.local_date end as local_date,
    case when n.provider_id is null then s.amount else n.amount end as amount, case when n.provider_id is null then s.description else n.description end as description,
    case when n.provider_id is null then s.provider_bill_id else n.provider_bill_id end as provider_bill_id, case when n.provider_id is null then s.bill_id else n.bill_id end as bill_id,
    case when n.provider_id is null then s.direction else n.direction end as direction,
    case when n.provider_id is null or s.role_source = 'RULE' then s.role else n.role end as role, case when n.provider_id is null or s.role_source = 'RULE' then s.role_source else 'HEURISTIC' end as role_source,
    case when n.provider_id is null then s.deleted_at when n.status = 'DELETED' then coalesce(s.deleted_at, {WHEN}) end as deleted_at, coalesce(s.duplicate_status, 'NONE') as dup,
    s.status as o_status, s.amount as o_amount, s.bill_id as o_bill, s.direction as o_direction, s.role as o_role, s.deleted_at as o_deleted
  from pr n full join stored_transaction s on s.workspace_id = n.workspace_id and s.provider_id = n.provider_id),
ch as (select *, concat_ws(',', case when status is distinct from o_status then 'status' end, case when amount is distinct from o_amount then 'amount' end, case when bill_id is distinct from o_bill then 'bill_id' end,
    case when direction is distinct from o_direction then 'direction' end, case when role is distinct from o_role then 'role' end, case when deleted_at is distinct from o_deleted then 'deleted_at' end) as fields,
    was and status = 'DELETED' and o_status <> 'DELETED' as dies from im),
"""
SNK2 = f"""select workspace_id, provider_id, status, cast(local_date as varchar) as local_date, {M("amount")} as amount, provider_bill_id, bill_id, direction, role, cast(deleted_at as varchar) as deleted_at, role_source,
  case when dup = 'NONE' and count(*) over same > 1 and bool_or(not was) over same then 'POSSIBLE' else dup end as duplicate_status
  from im window same as (partition by workspace_id, account_id, amount, description, local_date)"""


def snk3_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of landed bills meet across accounts in larger tables, so the account is part of the key: no landed bill is lost."""
    stored, new = frames(spark, sf_dir, "bill", "landed_bill")
    return plain(imports.import_children(stored, new, ["workspace_id", "account_id", "id"], ["status", "currency", "due_date", "total_amount"])[0])


def snk3_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = frames(spark, sf_dir, "bill_payment", "landed_payment")
    found = imports.import_children(stored, new, ["workspace_id", "id"], ["bill_id", "payment_date", "amount", "currency"])[1]
    return plain(found.select("workspace_id", "id", F.array_join(F.transform("changes", lambda c: c["field"]), ",").alias("fields")))


def snk3_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, bill = frames(spark, sf_dir, "stored_transaction", "bill")
    return plain(imports.link_bills(stored, bill).select("workspace_id", "id", "bill_id"))


def snk4_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, found = frames(spark, sf_dir, "stored_connection", "found_connection")
    return plain(imports.assign_connections(stored.select("workspace_id", "external_id", "local_status", "deleted_at"), found, at()))


def snk1_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts told again: two of three differ in their balance."""
    account = load(spark, sf_dir).account
    payload = ["currency", "current_balance", "name"]
    stored = account.select("workspace_id", "id", imports.fingerprint(*[F.col(c) for c in payload]).alias("payload_hash"), F.lit(NOW).alias("observed_at"))
    again = account.select("workspace_id", "id", "currency", (F.col("current_balance") + F.col("id") % 3).cast("decimal(20,6)").alias("current_balance"), "name")
    return plain(imports.new_snapshots(stored, again, ["workspace_id", "id"], payload).select("workspace_id", "id", "current_balance"))


def dml4_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, page = frames(spark, sf_dir, "stored_transaction", "landed_page")
    ids = page.where("status = 'DELETED'")
    return plain(imports.delete_transactions(stored, ids, at())[0].select("workspace_id", "provider_id", "status", "deleted_at"))


def dml5_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    account, run = frames(spark, sf_dir, "account", "sync_run")
    done = account.join(run.where("status = 'SUCCEEDED'").select("workspace_id", "connection_id"), ["workspace_id", "connection_id"]).select("workspace_id", F.col("id").alias("account_id"))
    found = imports.complete_accounts(account, done, at())
    return plain(found.select("workspace_id", "id", "coverage_status", "initial_import_completed_at", "last_successful_sync_at"))


def dml5_closed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    (run,) = frames(spark, sf_dir, "sync_run")
    outcome = run.select("run_id", (F.col("run_id") % 3 != 0).alias("succeeded"))
    return plain(imports.close_runs(run, outcome, at()).select("workspace_id", "id", "status", "cursor", "error_summary", "finished_at"))


def st1_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered three times."""
    (hook,) = frames(spark, sf_dir, "hook")
    thrice = hook.union(hook).union(hook)
    return inbox.first_deliveries(thrice, ["workspace_id", "event_id"], "ts").select("workspace_id", "event_id", "event")


def st2_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hook, job = frames(spark, sf_dir, "hook", "job")
    active = job.withColumn("dedupe_key", F.concat_ws(":", F.when(F.col("id") % 2 == 0, "TRANSACTION_EVENT").otherwise("CONNECTION_EVENT"), "workspace_id", "id"))
    events = hook.withColumn("event_type", F.col("event"))
    return inbox.jobs_of(events, active).select("workspace_id", "job_type", "dedupe_key")


def st3_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    (job,) = frames(spark, sf_dir, "job")
    return plain(inbox.claimable(job, at()).select("id", "priority", "attempts"))


def st4_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    (job,) = frames(spark, sf_dir, "job")
    held = inbox.extend_lease(F.col("lease_expires_at"), at(), 90)
    return plain(job.select("id", (F.unix_timestamp(held) - F.unix_timestamp(at())).alias("seconds_left")))


def st5_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    (job,) = frames(spark, sf_dir, "job")
    outcome = job.select("id", (F.col("id") % 4 != 0).alias("succeeded"))
    done = inbox.finish(job, outcome, at())
    return plain(done.select("id", "status", (F.unix_timestamp("available_at") - F.unix_timestamp(at())).alias("wait_seconds")))


def st8_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hook, connection = frames(spark, sf_dir, "hook", "stored_connection")
    events = hook.select((F.col("workspace_id") % 5).alias("workspace_id"), "event_id", ((F.col("workspace_id") % 5) * 100 + F.col("event_id") % 24).cast("string").alias("external_id"), "event", "status", "snapshot_status")
    return plain(inbox.routes(events, connection).select("event_id", "connection_id", "route", "is_full_import"))


def st9_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    connection, snapshot = frames(spark, sf_dir, "stored_connection", "snapshot")
    return plain(inbox.reconcile(connection, snapshot, at()).select("workspace_id", "id", "local_status", "outcome", "asks_refresh", "last_attempt_at", "last_successful_sync_at", "deleted_at"))


def st10_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    (job,) = frames(spark, sf_dir, "job")
    done = inbox.retry_dead(job, job.select("id"), at())
    return plain(done.select("id", "status", "attempts", (F.unix_timestamp("available_at") - F.unix_timestamp(at())).alias("wait_seconds")))


def uuid(n: F.Column) -> F.Column:
    return F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(n.cast("string"), 12, "0"))


def src9_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with too many ids, wrong counts, unknown events and identifiers that are none."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    event = F.coalesce(*[F.when(k % 12 == i, name) for i, name in enumerate(provider.EVENTS)], F.lit("item/other"))
    n = F.when(k % 7 == 0, 401).otherwise(k % 5).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: uuid(i))).otherwise(F.array().cast("array<string>"))
    body = F.struct(
        event.alias("event"), F.when(k % 13 == 0, "x").otherwise(uuid(k)).alias("eventId"), uuid(k).alias("itemId"), uuid(k).alias("accountId"), ids.alias("transactionIds"),
        F.when(k % 11 == 0, 9).otherwise(n).alias("transactionsCount"), F.when(k % 3 != 0, "https://x/v2/transactions").alias("createdTransactionsLinkV2"),
        F.lit("2026-01-01T00:00:00Z").alias("transactionsCreatedAtFrom"), F.struct(F.when(k % 2 == 0, "E").alias("code")).alias("error"),
    )
    raw = e.select("event_id", F.to_json(body).alias("payload"))
    return provider.webhooks(raw).select("event_id", F.col("hook.event").alias("event"), "is_valid")


SRC9 = f"""select event_id, event, case when event = 'item/other' or event_id % 13 = 0 then false
    when event = 'transactions/created' then event_id % 3 <> 0 and told between 0 and 1000
    when event = 'transactions/updated' then n between 1 and 400 and told = n
    when event = 'transactions/deleted' then n between 1 and 1000 and told = n
    when event = 'item/error' then event_id % 2 = 0 else true end as is_valid
  from (select event_id, case when event_id % 12 < 10 then {json.dumps(list(provider.EVENTS)).replace('"', "'")}[event_id % 12 + 1] else 'item/other' end as event,
               case when event_id % 7 = 0 then 401 else event_id % 5 end as n, case when event_id % 11 = 0 then 9 when event_id % 7 = 0 then 401 else event_id % 5 end as told from events)"""


def src2_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as a provider lands them; their status follows from four facts."""
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    item = F.struct(
        k.cast("string").alias("id"), F.struct(F.lit("1").alias("id"), F.concat(F.lit("Bank "), k % 7).alias("name")).alias("connector"),
        F.when(k % 6 == 0, "LOGIN_ERROR").when(k % 6 == 1, "WAITING_USER_INPUT").when(k % 6 == 2, "UPDATING").when(k % 6 < 5, "UPDATED").otherwise("OUTDATED").alias("status"),
        F.when(k % 4 == 0, "SUCCESS").when(k % 4 == 1, "PARTIAL_SUCCESS").when(k % 4 == 2, "ERROR").alias("executionStatus"), F.lit("1998-08-01T00:00:00Z").alias("lastUpdatedAt"),
    )
    raw = n.select(F.inline(F.array(F.from_json(F.to_json(item), provider.ITEM, {"primitivesAsString": "true"}))))
    return plain(provider.connections(raw).select("connection_id", "institution_name", "local_status"))


SRC2 = """select cast(k as varchar) as connection_id, concat('Bank ', k % 7) as institution_name, case when k % 6 = 0 then 'REAUTH_REQUIRED' when k % 6 = 1 then 'USER_INPUT_REQUIRED'
    when k % 6 in (3, 4) and k % 4 in (0, 1) then 'ACTIVE' when k % 6 = 2 then 'SYNCING' else 'PROVIDER_ERROR' end as local_status from (select c_custkey as k from customer)"""


def src5_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    account = F.struct(
        k.cast("string").alias("id"), F.lit("7").alias("itemId"), F.when(k % 5 == 0, "CREDIT").when(k % 5 == 1, "INVESTMENT").otherwise("BANK").alias("type"),
        F.when(k % 5 == 2, "CHECKING_ACCOUNT").when(k % 5 == 3, "SAVINGS_ACCOUNT").alias("subtype"), F.concat(F.lit("00-"), F.lpad((k % 9999).cast("string"), 4, "0")).alias("number"),
        F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(20,6)").alias("balance"), F.lit("BRL").alias("currencyCode"),
    )
    raw = c.select(F.inline(F.array(F.from_json(F.to_json(account), provider.ACCOUNT, {"primitivesAsString": "true"}))))
    return plain(provider.accounts(raw).select("account_id", "account_type", "last_four", "current_balance"))


SRC5 = f"""select cast(c_custkey as varchar) as account_id, case c_custkey % 5 when 0 then 'CREDIT_CARD' when 1 then 'INVESTMENT' when 2 then 'CHECKING' when 3 then 'SAVINGS' else 'OTHER' end as account_type,
    lpad(cast(c_custkey % 9999 as varchar), 4, '0') as last_four, {M("c_acctbal")} as current_balance from customer"""


def src7_bill_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bills whose lines are charges nested in them."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("id"), F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("INTEREST").alias("type"), F.col("l_tax").cast("decimal(20,6)").cast("string").alias("amount"), F.lit("BRL").alias("currencyCode"),
    ).alias("c"))
    raw = items.groupBy("id").agg(F.collect_list("c").alias("financeCharges"))
    raw = raw.select(F.inline(F.array(F.from_json(F.to_json(F.struct("id", "financeCharges")), provider.BILL))))
    return plain(provider.bill_charges(raw))


SRC7 = f"select cast(l_orderkey as varchar) as bill_id, concat_ws('-', l_orderkey, l_linenumber) as charge_id, 'INTEREST' as charge_type, {M('l_tax')} as amount, 'BRL' as currency from lineitem"

QUERIES = {f.__name__: f for f in (
    snk1_snapshots, snk2_transactions, snk2_revisions, snk2_counts, snk2_history, snk3_bills, snk3_payments, snk3_linked, snk4_connections, dml4_deleted, dml5_completed, dml5_closed_runs,
    st1_first_deliveries, st2_jobs, st3_claimable, st4_leases, st5_finished, st8_routes, st9_reconciled, st10_retried, src2_connections, src5_accounts, src7_bill_charges, src9_webhooks,
)}


def sql(names: tuple[str, ...], body: str) -> str:
    """A body behind the ledger and those inputs."""
    return (oracle.cte() + ctes(*names)).rstrip().rstrip(",") + "\n" + body


def import_sql(body: str) -> str:
    return (oracle.cte() + ctes("landed_page") + IMPORT).rstrip().rstrip(",") + "\n" + body


ORACLE_SQL = {
    "snk1_snapshots": sql((), f"select workspace_id, id, {M('current_balance + id % 3')} as current_balance from account where id % 3 <> 0 and current_balance is not null"),
    "snk2_transactions": import_sql(SNK2),
    "snk2_revisions": import_sql("select workspace_id, provider_id, case when dies then 'DELETE' else 'PROVIDER_UPDATE' end as change_type, fields from ch where was and came and fields <> ''"),
    "snk2_counts": import_sql("select workspace_id, account_id, count(*) as seen, count(*) filter (where not was) as inserted, count(*) filter (where was and fields <> '' and not dies) as updated, count(*) filter (where dies or (not was and status = 'DELETED')) as deleted from ch where came group by 1, 2"),
    "snk2_history": import_sql("select a.workspace_id, a.id as account_id, cast(least(a.earliest_date, min(p.local_date)) as varchar) as earliest_date, cast(greatest(a.latest_date, max(p.local_date)) as varchar) as latest_date from account a join p on p.workspace_id = a.workspace_id and p.account_id = a.id group by a.workspace_id, a.id, a.earliest_date, a.latest_date"),
    "snk3_bills": sql(("landed_bill",), f"""select coalesce(n.workspace_id, b.workspace_id) as workspace_id, coalesce(n.id, b.id) as id, coalesce(n.account_id, b.account_id) as account_id, coalesce(n.status, b.status) as status,
        coalesce(n.currency, b.currency) as currency, cast(coalesce(n.due_date, b.due_date) as varchar) as due_date, {M("n.total_amount")} as total_amount from landed_bill n left join bill b on b.workspace_id = n.workspace_id and b.id = n.id"""),
    "snk3_payments": sql((), "select workspace_id, id, 'amount' as fields from bill_payment where id % 2 <> 0"),
    "snk3_linked": sql(("stored_transaction",), "select s.workspace_id, s.id, coalesce(s.bill_id, b.id) as bill_id from stored_transaction s left join bill b on b.workspace_id = s.workspace_id and b.account_id = s.account_id and cast(b.id as varchar) = s.provider_bill_id"),
    "snk4_connections": sql(("stored_connection", "found_connection"), f"""select coalesce(n.workspace_id, s.workspace_id) as workspace_id, coalesce(n.external_id, s.external_id) as external_id, case when s.local_status in ('DISABLED', 'DELETED') then s.local_status else n.local_status end as local_status,
        cast(case when n.local_status = 'DELETED' then {WHEN} end as varchar) as deleted_at from found_connection n left join stored_connection s on s.workspace_id = n.workspace_id and s.external_id = n.external_id"""),
    "dml4_deleted": sql(("landed_page",), f"""select s.workspace_id, s.provider_id, case when g.provider_id is not null then 'DELETED' else s.status end as status, cast(case when g.provider_id is not null and s.status <> 'DELETED' then {WHEN} else s.deleted_at end as varchar) as deleted_at
        from stored_transaction s left join (select distinct workspace_id, account_id, provider_id from landed_page where status = 'DELETED') g on g.workspace_id = s.workspace_id and g.account_id = s.account_id and g.provider_id = s.provider_id"""),
    "dml5_completed": sql(("sync_run",), f"""select a.workspace_id, a.id, case when r.connection_id is null or a.coverage_status = 'USER_EXTENDED_HISTORY' then a.coverage_status when a.earliest_date <= a.latest_date - interval 12 months then 'PROVIDER_MAXIMUM_RETRIEVED' else 'PARTIAL' end as coverage_status,
        cast(case when r.connection_id is not null then coalesce(a.initial_import_completed_at, {WHEN}) else a.initial_import_completed_at end as varchar) as initial_import_completed_at,
        cast(case when r.connection_id is not null then {WHEN} else a.last_successful_sync_at end as varchar) as last_successful_sync_at
        from account a left join (select distinct workspace_id, connection_id from sync_run where status = 'SUCCEEDED') r on r.workspace_id = a.workspace_id and r.connection_id = a.connection_id"""),
    "dml5_closed_runs": sql(("sync_run",), f"""select workspace_id, id, case when status = 'RUNNING' then case when id % 3 <> 0 then 'SUCCEEDED' else 'FAILED' end else status end as status, case when status = 'RUNNING' and id % 3 <> 0 then null else cursor end as cursor,
        case when status = 'RUNNING' and id % 3 = 0 then 'TRANSACTION_IMPORT_FAILED' end as error_summary, cast(case when status = 'RUNNING' then {WHEN} else finished_at end as varchar) as finished_at from sync_run"""),
    "st1_first_deliveries": sql(("hook",), "select workspace_id, event_id, event from hook"),
    "st2_jobs": sql(("hook", "job"), """select workspace_id, kind as job_type, concat_ws(':', kind, workspace_id, event_id) as dedupe_key from (select *, case when event like 'transactions/%' then 'TRANSACTION_EVENT' else 'CONNECTION_EVENT' end as kind from hook) h
        where not exists (select 1 from job j where j.id = h.event_id and j.status in ('PENDING', 'RETRY', 'RUNNING') and h.kind = case when j.id % 2 = 0 then 'TRANSACTION_EVENT' else 'CONNECTION_EVENT' end)"""),
    "st3_claimable": sql(("job",), f"select id, priority, attempts from job where status in ('PENDING', 'RETRY') and available_at <= {WHEN} and attempts < max_attempts"),
    "st4_leases": sql(("job",), f"select id, greatest(date_diff('second', {WHEN}, lease_expires_at), 90) as seconds_left from job"),
    "st5_finished": sql(("job",), f"""select id, case when status = 'RUNNING' then case when id % 4 <> 0 then 'SUCCEEDED' when attempts >= 10 then 'DEAD' else 'RETRY' end else status end as status,
        cast(case when status = 'RUNNING' and id % 4 = 0 then least(300, power(2, greatest(attempts - 1, 0))) else date_diff('second', {WHEN}, available_at) end as bigint) as wait_seconds from job"""),
    "st8_routes": sql(("hook", "stored_connection"), """select event_id, connection_id, route, coalesce(route in ('SYNC', 'APPLY_STATUS') and snapshot_status = 'ACTIVE', false) as is_full_import from (
        select h.event_id, c.id as connection_id, h.snapshot_status, case when h.status = 'PROCESSED' then 'NONE' when c.id is null then 'UNMAPPED'
          when h.event = 'transactions/created' then case when c.local_status in ('DISABLED', 'DELETED') then 'NONE' else 'IMPORT_CREATED' end
          when h.event = 'transactions/updated' then case when c.local_status in ('DISABLED', 'DELETED') then 'NONE' else 'IMPORT_IDS' end
          when h.event = 'transactions/deleted' then case when c.local_status in ('DISABLED', 'DELETED') then 'NONE' else 'DELETE_IDS' end
          when h.event = 'item/deleted' then 'MARK_DELETED' when c.local_status in ('DISABLED', 'DELETED') then 'NONE' when h.snapshot_status is null then 'MARK_DELETED'
          when h.event in ('item/created', 'item/updated', 'item/login_succeeded') then 'SYNC' else 'APPLY_STATUS' end as route
        from hook h left join stored_connection c on c.workspace_id = h.workspace_id % 5 and c.id = (h.workspace_id % 5) * 100 + h.event_id % 24)"""),
    "st9_reconciled": sql(("stored_connection", "snapshot"), f"""select workspace_id, id, case when outcome = 'SKIPPED' then local_status else coalesce(ended, 'DELETED') end as local_status, outcome, outcome <> 'SKIPPED' and coalesce(first_status in ('ACTIVE', 'PROVIDER_ERROR'), false) as asks_refresh,
        cast(case when outcome = 'SKIPPED' then last_attempt_at else {WHEN} end as varchar) as last_attempt_at, cast(case when outcome = 'RECONCILED' then {WHEN} else last_successful_sync_at end as varchar) as last_successful_sync_at,
        cast(case when outcome = 'DELETED' then coalesce(deleted_at, {WHEN}) else deleted_at end as varchar) as deleted_at
      from (select *, case when local_status in ('DISABLED', 'DELETED') then 'SKIPPED' when ended is null or ended = 'DELETED' then 'DELETED' when ended in ('REAUTH_REQUIRED', 'USER_ACTION_REQUIRED') then 'ACTION_REQUIRED' when ended = 'ACTIVE' then 'RECONCILED' else 'UNSETTLED' end as outcome
        from (select c.*, s.first_status, case when s.first_status in ('DELETED', 'REAUTH_REQUIRED') then s.first_status when s.first_status is not null then s.settled_status end as ended
              from stored_connection c left join snapshot s on s.workspace_id = c.workspace_id and s.external_id = c.external_id))"""),
    "st10_retried": sql(("job",), f"select id, case when status = 'DEAD' then 'PENDING' else status end as status, case when status = 'DEAD' then 0 else attempts end as attempts, case when status = 'DEAD' then 0 else date_diff('second', {WHEN}, available_at) end as wait_seconds from job"),
    "src2_connections": SRC2,
    "src5_accounts": SRC5,
    "src7_bill_charges": SRC7,
    "src9_webhooks": SRC9,
}
