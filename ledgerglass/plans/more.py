"""Queries of policies, text, rules, detectors, upserts, sources and the queue, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy, text
from ..functions.dates import bank_date
from ..functions.money import plain
from ..functions.rules import Rule, evaluate
from ..operators import classification, effects, freshness, matching, transactions, upsert
from ..sources import provider
from ..streaming import inbox
from . import ledger, oracle
from .ledger import NOW, load

#: Pairs for the detectors: amounts and texts are arithmetic on the keys, so that pairs exist.
FACT = """select workspace_id, id, {account} as account_id, account_type, case when id % 2 = 0 then 'OUTFLOW' else 'INFLOW' end as direction, account_currency as currency,
    cast(case when id % 6 < 2 then id % 5 else id % 3 end + 1 as decimal(20,6)) + cast(case when id % 7 = 0 then 0.005 else 0 end as decimal(20,6)) as amount, local_date,
    case id % 6 when 0 then 'pix enviado' when 1 then 'transferencia recebida' when 3 then concat('estorno loja ', cast(merchant_id % 7 as {text})) else concat('loja ', cast(merchant_id % 7 as {text})) end as text,
    case when id % 4 <> 0 then merchant_id end as merchant_id from order_row"""


def facts(spark: SparkSession, sf_dir: str, account: str = "account_id") -> DataFrame:
    known = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ledger.SOURCES}
    selects = ledger.tables("spark")
    for name in ("account", "order_row"):
        read = {m[1] for m in ledger.SOURCE.findall(selects[name])}
        known[name] = spark.sql(ledger.SOURCE.sub(r"\1 {\2}", selects[name]), **{t: known[t] for t in read})
    return spark.sql(FACT.format(account=account, text="string").replace("from order_row", "from {order_row}"), order_row=known["order_row"])


def fact_cte(account: str = "account_id") -> str:
    return oracle.cte() + f"fact as ({FACT.format(account=account, text='varchar')})\n"


def tolerance(spark: SparkSession) -> DataFrame:
    return spark.sql("select 'BRL' as currency, cast(0.01 as decimal(20,6)) as tolerance_amount union all select 'USD', cast(0.02 as decimal(20,6))")


def d3_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = load(spark, sf_dir)
    t = led.transaction.join(led.account.select("workspace_id", F.col("id").alias("account_id"), "account_type"), ["workspace_id", "account_id"])
    kind = F.when(F.col("id") % 5 == 0, "CREDIT").when(F.col("id") % 5 < 4, "DEBIT")
    direction = policy.direction_of(F.col("account_type"), F.col("provider_amount"), kind)
    evidence = {"payment": F.col("id") % 19 == 0, "transfer": F.col("id") % 23 == 0, "charge": F.col("id") % 29 == 0, "tax": F.col("id") % 31 == 0, "refund": F.col("id") % 37 == 0, "withdrawal": F.col("id") % 7 == 0, "income": F.col("id") % 2 == 0}
    return plain(t.select("workspace_id", "id", direction.alias("direction"), policy.role_of(F.col("account_type"), F.col("provider_amount"), direction, evidence).alias("role")))


D3 = """select workspace_id, id, d as direction, case when id % 19 = 0 then 'CARD_BILL_PAYMENT' when id % 23 = 0 then 'TRANSFER' when id % 29 = 0 then 'FEE' when id % 31 = 0 then 'TAX' when id % 37 = 0 then 'REFUND' when id % 7 = 0 and d = 'OUTFLOW' then 'CASH_WITHDRAWAL'
    when account_type = 'CREDIT_CARD' then case when a < 0 then 'UNKNOWN_CREDIT' when a = 0 then 'UNKNOWN' else 'PURCHASE' end
    when account_type in ('CHECKING', 'SAVINGS') then case when d = 'OUTFLOW' then 'PURCHASE' when d = 'INFLOW' and id % 2 = 0 then 'INCOME' when d = 'INFLOW' then 'UNKNOWN_CREDIT' else 'UNKNOWN' end else 'UNKNOWN' end as role
  from (select t.workspace_id, t.id, x.account_type, t.provider_amount as a, case when x.account_type = 'CREDIT_CARD' then case when t.provider_amount = 0 then 'NEUTRAL' when t.provider_amount < 0 then 'INFLOW' else 'OUTFLOW' end
      when x.account_type in ('CHECKING', 'SAVINGS') then case when t.id % 5 = 0 then 'CREDIT_IN' else 'X' end else 'UNKNOWN' end as d0, case when x.account_type = 'CREDIT_CARD' then d0 when d0 = 'UNKNOWN' then 'UNKNOWN' when t.id % 5 = 0 then 'INFLOW' when t.id % 5 < 4 then 'OUTFLOW' else 'UNKNOWN' end as d
    from "transaction" t join account x on x.workspace_id = t.workspace_id and x.id = t.account_id)"""


def d7_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(matching.transfers(facts(spark, sf_dir), tolerance(spark)))


D7 = """select workspace_id, currency, o as outflow_id, i as inflow_id, dd as date_distance_days, case when count(*) over (partition by workspace_id, o) = 1 and count(*) over (partition by workspace_id, i) = 1 then 'AUTO_CONFIRMED' else 'NEEDS_REVIEW' end as status
  from (select a.workspace_id, a.currency, a.id as o, b.id as i, abs(date_diff('day', a.local_date, b.local_date)) as dd from fact a join fact b on a.workspace_id = b.workspace_id and a.currency = b.currency and a.account_id <> b.account_id and abs(date_diff('day', a.local_date, b.local_date)) <= 2
    join tolerance tl on tl.currency = a.currency where a.direction = 'OUTFLOW' and b.direction = 'INFLOW' and abs(abs(a.amount) - abs(b.amount)) <= tl.tolerance_amount and a.account_type in ('CHECKING', 'SAVINGS') and b.account_type in ('CHECKING', 'SAVINGS')
      and regexp_matches(a.text, '(^| )(doc|pix|ted|transfer|transferencia|transferência)( |$)') and regexp_matches(b.text, '(^| )(doc|pix|ted|transfer|transferencia|transferência)( |$)'))"""


def d8_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(matching.refunds(facts(spark, sf_dir, "account_id % 60"), tolerance(spark)))


D8 = """select *, case when count(*) over (partition by workspace_id, refund_id) = 1 then 'AUTO_CONFIRMED' else 'NEEDS_REVIEW' end as status
  from (select a.workspace_id, a.account_id, a.currency, a.id as refund_id, b.id as purchase_id, date_diff('day', b.local_date, a.local_date) as date_distance_days from fact a join fact b on a.workspace_id = b.workspace_id and a.account_id = b.account_id and a.currency = b.currency join tolerance tl on tl.currency = a.currency
    where a.direction = 'INFLOW' and b.direction = 'OUTFLOW' and a.text like 'estorno %' and date_diff('day', b.local_date, a.local_date) between 0 and 120 and b.amount >= a.amount and b.amount - a.amount <= tl.tolerance_amount and (coalesce(a.merchant_id = b.merchant_id, false) or substr(a.text, 9) = b.text))"""


def d9_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the ledger marks as deleted against all that it does not; some know a card that differs."""
    f = facts(spark, sf_dir, "account_id % 10").join(load(spark, sf_dir).transaction.select("workspace_id", "id", "status", "deleted_at"), ["workspace_id", "id"])
    f = f.withColumn("card_last_four", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")))
    gone = (F.col("status") == "DELETED") | F.col("deleted_at").isNotNull()
    return plain(matching.replacements(f.where(gone).drop("status", "deleted_at"), f.where(~gone).drop("status", "deleted_at")).drop("amount"))


D9 = """, mk as (select f.*, t.status = 'DELETED' or t.deleted_at is not null as gone, case when f.id % 3 > 0 then f.id % 3 end as card from fact f join "transaction" t on t.workspace_id = f.workspace_id and t.id = f.id),
  pr as (select a.workspace_id, a.account_id, a.currency, a.id as predecessor_id, b.id as successor_id, abs(date_diff('day', a.local_date, b.local_date)) as dd, string_split(a.text, ' ') as ta, string_split(b.text, ' ') as tb
    from mk a join mk b on a.workspace_id = b.workspace_id and a.account_id = b.account_id and a.currency = b.currency and a.amount = b.amount and abs(date_diff('day', a.local_date, b.local_date)) <= 3 where a.gone and not b.gone and coalesce(a.card = b.card, true)),
  sc as (select *, cast(round(least(1.0, cast(0.4 as double) + (case dd when 0 then 0.2 when 1 then 0.175 when 2 then 0.15 else 0.125 end)::double + 0.25::double * len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) + 0.05::double + 0.1::double), 4) as decimal(5,4)) as score from pr),
  al as (select *, count(*) over (partition by workspace_id, predecessor_id) = 1 and count(*) over (partition by workspace_id, successor_id) = 1 and score >= 0.95 as sure from sc)
  select workspace_id, account_id, currency, predecessor_id, successor_id, dd as date_distance_days, cast(score as varchar) as score, case when sure then 'AUTO_CONFIRMED' else 'NEEDS_REVIEW' end as status from al"""


def k9_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir).transaction
    form = text.normal_form(F.col("description"))
    return plain(t.select("workspace_id", "id", *[form[c].alias(c) for c in ("normalized", "processor_prefix", "instalment_number", "instalment_total", "store_code")]))


K9 = """select workspace_id, id, trim(regexp_replace(p, '(^|[^a-z0-9])[0-9]{3,8}$', '')) as normalized, case when description like 'MP *%' then 'MP' end as processor_prefix, case when description like '% PARC 02/10' then 2 end as instalment_number, case when description like '% PARC 02/10' then 10 end as instalment_total,
    nullif(regexp_extract(p, '(^|[^a-z0-9])([0-9]{3,8})$', 2), '') as store_code
  from (select workspace_id, id, description, lower(trim(regexp_replace(regexp_replace(regexp_replace(description, '^MP \\*', ' '), ' PARC 02/10$', ' '), '[^A-Za-z0-9&+-]+', ' ', 'g'))) as p from "transaction")"""


def k10_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = load(spark, sf_dir)
    names = led.merchant.select("workspace_id", F.col("id").alias("merchant_id"), F.lower("label").alias("label"))
    pairs = led.transaction.join(names, ["workspace_id", "merchant_id"]).select("workspace_id", "id", "label", F.lower("description").alias("own"))
    return plain(pairs.select("workspace_id", "id", text.similarity(F.col("own"), F.col("label")).alias("score")))


K10 = """, pr as (select t.workspace_id, t.id, trim(regexp_replace(lower(t.description), '\\s+', ' ', 'g')) as a, lower(m.label) as b from "transaction" t join merchant m on m.workspace_id = t.workspace_id and m.id = t.merchant_id),
  st as (select *, list_distinct(string_split(a, ' ')) as wa, list_distinct(string_split(b, ' ')) as wb, list_distinct(list_transform(range(1, len(a)), lambda k: substr(a, k, 2))) as ga, list_distinct(list_transform(range(1, len(b)), lambda k: substr(b, k, 2))) as gb from pr)
  select workspace_id, id, cast(cast(round(greatest(len(list_intersect(wa, wb))::double / len(list_distinct(list_concat(wa, wb))), 2.0::double * len(list_intersect(ga, gb)) / (len(ga) + len(gb))), 4) as decimal(5,4)) as varchar) as score from st"""

RULES = [
    Rule("large", {"all": [{"field": "transaction.providerAmountSigned", "operator": "lt", "value": "-200000"}, {"field": "transaction.systemDirection", "operator": "eq", "value": "OUTFLOW"}]}, [{"type": "SET_CATEGORY", "value": 7}, {"type": "ADD_TAG", "value": "large"}], priority=10),
    Rule("urgent", {"any": [{"field": "transaction.descriptionNormalized", "operator": "contains", "value": "urgent"}, {"field": "transaction.descriptionNormalized", "operator": "regex_safe", "value": "^mp .store 2"}]}, [{"type": "SET_CATEGORY", "value": 3}, {"type": "SET_MERCHANT", "value": 11}], priority=5),
    Rule("stop", {"field": "transaction.transactionLocalDate", "operator": "between", "values": ["1998-01-01", "1998-12-31"]}, [{"type": "STOP_PROCESSING"}], priority=3),
    Rule("rest", {"field": "merchant.id", "operator": "neq", "value": 101}, [{"type": "SET_MERCHANT", "value": 12}, {"type": "REMOVE_TAG", "value": "large"}], priority=1),
]


def k5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir).transaction
    names = {"transaction.providerAmountSigned": "provider_amount", "transaction.systemDirection": "direction", "transaction.transactionLocalDate": "local_date", "merchant.id": "merchant_id"}
    known = {k: F.col(c) for k, c in names.items()} | {"transaction.descriptionNormalized": F.lower("description")}
    out = evaluate(t, RULES, known)
    return plain(out.select("workspace_id", "id", F.array_join("matched_rules", ",").alias("matched_rules"), "stopped_by", "set_category", "set_merchant", F.array_join("tags_added", ",").alias("tags_added"), F.array_join("tags_removed", ",").alias("tags_removed"), F.size("conflicts").alias("conflict_count")))


K5 = """select workspace_id, id, concat_ws(',', case when a then 'large' end, case when b then 'urgent' end, case when c then 'stop' end, case when d and not c then 'rest' end) as matched_rules, case when c then 'stop' end as stopped_by, case when a then '7' when b then '3' end as set_category, case when b then '11' when d and not c then '12' end as set_merchant,
    case when a then 'large' else '' end as tags_added, case when not a and d and not c then 'large' else '' end as tags_removed, cast((a and b)::int + (b and d and not c)::int + (a and d and not c)::int as bigint) as conflict_count
  from (select workspace_id, id, provider_amount < -200000 and direction = 'OUTFLOW' as a, contains(lower(description), 'urgent') or regexp_matches(lower(description), '^mp .store 2') as b, local_date between date '1998-01-01' and date '1998-12-31' as c, coalesce(merchant_id <> 101, false) as d from "transaction")"""


def dml1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir).account.select("workspace_id", "id", "name", "current_balance", "coverage_status")
    new = a.select("workspace_id", "id", F.concat("name", F.lit(" new")).alias("name"), (F.col("current_balance") + 1).cast("decimal(20,6)").alias("current_balance"), F.lit("PARTIAL").alias("coverage_status"))
    new = new.union(new.withColumn("id", F.col("id") + 10_000_000))
    kept = F.when(F.col("old.coverage_status") == "USER_EXTENDED_HISTORY", F.col("old.coverage_status")).otherwise(F.col("new.coverage_status"))
    return plain(upsert.merge(a, new, ["workspace_id", "id"], {"coverage_status": kept}))


DML1 = """, inc as (select workspace_id, id, concat(name, ' new') as name, cast(current_balance + 1 as decimal(20,6)) as b from account)
  select a.workspace_id, a.id, coalesce(i.name, a.name) as name, cast(coalesce(i.b, a.current_balance) as varchar) as current_balance, case when i.id is not null and a.coverage_status <> 'USER_EXTENDED_HISTORY' then 'PARTIAL' else a.coverage_status end as coverage_status from account a left join inc i on i.workspace_id = a.workspace_id and i.id = a.id
  union all select workspace_id, id + 10000000, name, cast(b as varchar), 'PARTIAL' from inc"""


def dml2_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir).transaction.select("workspace_id", "id", "status", "category_id", "account_amount")
    new = t.withColumns({"status": F.when(F.col("id") % 8 == 0, "POSTED").otherwise(F.col("status")), "category_id": F.when(F.col("id") % 3 == 0, F.lit(None).cast("bigint")).otherwise(F.col("category_id"))})
    found = upsert.revisions(t, new, ["workspace_id", "id"], ["status", "category_id", "account_amount"])
    return plain(found.select("workspace_id", "id", F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c["field"], F.coalesce(c["before"], F.lit("-")), F.coalesce(c["after"], F.lit("-")))), ",").alias("changes")))


DML2 = """select workspace_id, id, concat_ws(',', case when s then concat('status:', status, ':POSTED') end, case when c then concat('category_id:', cast(category_id as varchar), ':-') end) as changes
  from (select *, id % 8 = 0 and status <> 'POSTED' as s, id % 3 = 0 and category_id is not null as c from "transaction") where s or c"""


def dml2_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir).transaction
    return plain(upsert.mark_collisions(t, ["workspace_id", "account_id", "local_date"]).select("workspace_id", "id", "duplicate_status"))


DML2B = """select workspace_id, id, case when duplicate_status = 'NONE' and count(*) over (partition by workspace_id, account_id, local_date) > 1 then 'POSSIBLE' else duplicate_status end as duplicate_status from "transaction" """


def src10_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    card = F.struct((F.col("o_orderkey") % 5).cast("string").alias("installmentNumber"), F.lit("10").alias("totalInstallments"), F.concat(F.lit("**** "), F.lpad((F.col("o_orderkey") % 9999).cast("string"), 4, "0")).alias("cardNumber"))
    raw = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("accountId"), F.when(F.col("o_orderstatus") == "F", "POSTED").alias("status"), F.col("o_totalprice").cast("decimal(20,6)").alias("amount"), F.lit("BRL").alias("currencyCode"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T01:30:00Z")).alias("date"), F.col("o_orderpriority").alias("description"), card.alias("creditCardMetadata")))
    rows = provider.transactions(o.select(F.inline(F.array(F.from_json(raw, provider.TRANSACTION, {"primitivesAsString": "true"})))))
    return plain(rows.select("provider_transaction_id", "account_id", "status", "provider_amount", "local_date", "description", "instalment_number", "card_last_four"))


SRC10 = "select cast(o_orderkey as varchar) as provider_transaction_id, cast(o_custkey as varchar) as account_id, case when o_orderstatus = 'F' then 'POSTED' else 'UNKNOWN' end as status, cast(cast(o_totalprice as decimal(20,6)) as varchar) as provider_amount, cast(cast(o_orderdate as date) - 1 as varchar) as local_date, o_orderpriority as description, o_orderkey % 5 as instalment_number, lpad(cast(o_orderkey % 9999 as varchar), 4, '0') as card_last_four from orders"
SRC10 = SRC10.replace("cast(cast(o_orderdate as date) - 1 as varchar)", "cast(cast(cast(o_orderdate as date) - 1 as date) as varchar)")


def st1_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return plain(inbox.latest_state(e, ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id"))


ST1 = "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1"


def st6_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.lit(NOW).cast("timestamp")
    jobs = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "RUNNING").otherwise("PENDING").alias("status"), (F.col("event_id") % 12).cast("int").alias("attempts"), F.lit(10).alias("max_attempts"), at.alias("available_at"), F.when(F.col("event_id") % 2 == 0, at - F.expr("interval 1 minute")).otherwise(at + F.expr("interval 1 minute")).alias("lease_expires_at"))
    done = inbox.reclaim(jobs, at)
    return plain(done.select("id", "status", (F.unix_timestamp("available_at") - F.unix_timestamp(at)).alias("wait_seconds"), F.col("lease_expires_at").isNull().alias("is_free")))


ST6 = "select event_id as id, case when lost and event_id % 12 >= 10 then 'DEAD' when lost then 'RETRY' when event_id % 3 = 0 then 'RUNNING' else 'PENDING' end as status, cast(case when lost then least(300, power(2, greatest(event_id % 12 - 1, 0))) else 0 end as bigint) as wait_seconds, lost as is_free from (select event_id, event_id % 6 = 0 as lost from events)"


def t1_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transactions.detail(load(spark, sf_dir), NOW)
    return plain(rows.select("workspace_id", "id", "category_label", "merchant_label", "account_name", "bill_status", "spend", "cash", F.array_join("warnings", ",").alias("warnings")))


T1 = f"""select f.workspace_id, f.id, c.label as category_label, m.label as merchant_label, a.name as account_name, b.status as bill_status, {oracle.m("f.spend")} as spend, {oracle.m("f.cash")} as cash,
    concat_ws(',', case when f.unconv then 'UNCONVERTED_CURRENCY' end, case when f.duplicate_status = 'POSSIBLE' then 'POSSIBLE_DUPLICATE' end, case when f.eff_category is null then 'UNCLASSIFIED' end, case when coalesce(r.stale, true) then 'STALE_DATA' end, case when coalesce(r.attention, false) then 'CONNECTION_ATTENTION' end) as warnings
  from fx f left join category c on c.id = f.eff_category left join merchant m on m.workspace_id = f.workspace_id and m.id = f.eff_merchant left join account a on a.workspace_id = f.workspace_id and a.id = f.account_id left join bill b on b.workspace_id = f.workspace_id and b.id = f.bill_id
  left join frs r on r.workspace_id = f.workspace_id and r.account_id = f.account_id where f.deleted_at is null and f.status <> 'DELETED'"""


def b1_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(transactions.accounts(load(spark, sf_dir)))


def b1_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(transactions.bills_with_children(load(spark, sf_dir)).select("workspace_id", "bill_id", "status", "payments", "paid", "charges", "charged"))


def b2_coverage_for_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(freshness.coverage_for_range(load(spark, sf_dir), bank_date(oracle.START), bank_date(oracle.END)).select("workspace_id", "account_id", "warning"))


def v7_replacement_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = load(spark, sf_dir)
    links = led.transaction.select("workspace_id", F.col("id").alias("predecessor_id"), (F.col("id") + 1).alias("successor_id"), F.when(F.col("id") % 10 == 0, "NEEDS_REVIEW").otherwise("REJECTED").alias("status"))
    return plain(effects.replacement_review(led, links).select("workspace_id", "predecessor_id", "successor_id", "predecessor_date", "successor_date"))


def k13_merged_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = load(spark, sf_dir)
    merges = led.merchant.where("id % 5 = 0").select("workspace_id", F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"))
    return plain(classification.repoint(led.transaction.select("workspace_id", "id", "merchant_id"), ["merchant_id"], merges))


def k14_category_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = load(spark, sf_dir)
    tree = led.category.select("id", F.when(F.col("id") > 0, F.floor(F.col("id") / 2)).cast("bigint").alias("parent_id"))
    return plain(classification.ancestors(tree))


def k15_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = load(spark, sf_dir)
    mode = F.when(F.col("id") % 3 == 0, "SET").when(F.col("id") % 3 == 1, "CLEAR").otherwise("INHERIT")
    patches = led.transaction.select("workspace_id", F.col("id").alias("transaction_id"), F.when(F.col("id") % 2 == 0, F.col("id") % 9 + 1).otherwise(F.lit(0)).alias("expected_version"), mode.alias("category_mode"), F.lit(6).cast("bigint").alias("category_value"))
    fixed, _ = classification.correct(led.user_state, patches)
    return plain(fixed.select("workspace_id", "transaction_id", "category_override", "category_value", "version"))


QUERIES = {f.__name__: f for f in (d3_classify, d7_transfers, d8_refunds, d9_replacements, k5_rules, k9_descriptions, k10_similarity, dml1_merge, dml2_revisions, dml2_collisions, src10_transactions, st1_latest_state, st6_reclaim, t1_transactions, b1_accounts, b1_bills, b2_coverage_for_range, v7_replacement_review, k13_merged_merchants, k14_category_ancestors, k15_corrections)}


def tail(head: str, more: str) -> str:
    """`more` follows the last named part: a SELECT, or further parts after a comma."""
    return head.rstrip().rstrip(",") + "\n" + more


ORACLE_SQL = {
    "d3_classify": tail(oracle.cte(), D3),
    "d7_transfers": tail(fact_cte(), D7),
    "d8_refunds": tail(fact_cte("account_id % 60"), D8),
    "d9_replacements": tail(fact_cte("account_id % 10"), D9),
    "k5_rules": tail(oracle.cte(), K5),
    "k9_descriptions": tail(oracle.cte(), K9),
    "k10_similarity": tail(oracle.cte(), K10),
    "dml1_merge": tail(oracle.cte(), DML1),
    "dml2_revisions": tail(oracle.cte(), DML2),
    "dml2_collisions": tail(oracle.cte(), DML2B),
    "src10_transactions": SRC10,
    "st1_latest_state": ST1,
    "st6_reclaim": ST6,
    "t1_transactions": tail(oracle.cte() + oracle.EFFECTIVE + oracle.FRESH, T1),
    "b1_accounts": tail(oracle.cte(), "select workspace_id, id as account_id, account_type, currency, name, cast(current_balance as varchar) as current_balance, is_active from account where deleted_at is null"),
    "b1_bills": tail(oracle.cte(), f"select b.workspace_id, b.id as bill_id, b.status, (select count(*) from bill_payment p where p.workspace_id = b.workspace_id and p.bill_id = b.id) as payments, (select {oracle.m('sum(p.amount)')} from bill_payment p where p.workspace_id = b.workspace_id and p.bill_id = b.id) as paid, (select count(*) from bill_charge c where c.workspace_id = b.workspace_id and c.bill_id = b.id) as charges, (select {oracle.m('sum(c.amount)')} from bill_charge c where c.workspace_id = b.workspace_id and c.bill_id = b.id) as charged from bill b"),
    "b2_coverage_for_range": tail(oracle.cte(), f"select workspace_id, id as account_id, case when earliest_date is null then 'HISTORY_UNKNOWN' when earliest_date > date '{oracle.START}' then 'STARTS_LATE' when latest_date is null or latest_date < date '{oracle.END}' then 'ENDS_EARLY' end as warning from account where deleted_at is null"),
    "k13_merged_merchants": tail(oracle.cte(), 'select t.workspace_id, t.id, case when m.id is not null and m.id % 5 = 0 then m.id + 1 else t.merchant_id end as merchant_id from "transaction" t left join merchant m on m.workspace_id = t.workspace_id and m.id = t.merchant_id'),
    "k14_category_ancestors": "with recursive c as (select cast(n_nationkey as bigint) as id, case when n_nationkey > 0 then cast(n_nationkey // 2 as bigint) end as parent_id from nation where n_nationkey < 9), up as (select id, parent_id as ancestor, cast(1 as bigint) as depth from c where parent_id is not null union all select up.id, c.parent_id, up.depth + 1 from up join c on c.id = up.ancestor where c.parent_id is not null) select id, ancestor, depth from up",
    "k15_corrections": tail(oracle.cte(), "select t.workspace_id, t.id as transaction_id, case when f then t.id % 3 < 2 else category_override end as category_override, case when f then case when t.id % 3 = 0 then 6 end else category_value end as category_value, case when f then coalesce(version, 0) + 1 else version end as version from (select t.*, u.category_override, u.category_value, u.version, coalesce(u.version, 0) = case when t.id % 2 = 0 then t.id % 9 + 1 else 0 end as f from \"transaction\" t left join user_state u on u.workspace_id = t.workspace_id and u.transaction_id = t.id) t where version is not null or f"),
    "v7_replacement_review": tail(oracle.cte(), ", d as materialized (select workspace_id, id, local_date from \"transaction\") select workspace_id, id as predecessor_id, next_id as successor_id, cast(local_date as varchar) as predecessor_date, cast(next_date as varchar) as successor_date from (select *, lead(id) over ids as next_id, lead(local_date) over ids as next_date from d window ids as (partition by workspace_id order by id)) where next_id = id + 1 and id % 10 = 0"),
}
