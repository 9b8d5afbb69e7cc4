"""Queries of lists, filters, reviews, classification and integrity rules, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy, text
from ..functions.dates import bank_date
from ..functions.money import plain
from ..functions.rules import Rule
from ..operators import bills, classification, commitments, effects, lists, matching, quality, spending, transactions, validate
from . import more, oracle
from .inputs import WHEN, ctes, frames
from .ledger import NOW, load

M = oracle.m
START, END = bank_date(oracle.START), bank_date(oracle.END)
#: A report of one workspace, account, category and merchant, and the place behind which a second page begins.
WORKSPACE, CATEGORY, MERCHANT, AFTER = 1, 3, 107, ("1998-07-15", 30_000)
PLACE = (bank_date(AFTER[0]), AFTER[1])


def at() -> F.Column:
    return F.lit(NOW).cast("timestamp")


def f1_filtered_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = spending.Scope(bank_date("1997-09-01"), END, workspace=WORKSPACE, category=CATEGORY, pending=True)
    return plain(spending.totals(load(spark, sf_dir), scope))


def f1_merchant_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = spending.Scope(bank_date("1997-09-01"), END, workspace=WORKSPACE, merchant=MERCHANT, pending=True)
    return plain(spending.series(load(spark, sf_dir), scope))


def q2_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(quality.queue(load(spark, sf_dir), 50, PLACE).select("workspace_id", "id", "local_date", "has_next"))


def t1_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of purchases that have a category, with tags and what replaces or was replaced."""
    led = load(spark, sf_dir)
    tag, link = frames(spark, sf_dir, "tag", "link")
    rows = transactions.listed(transactions.detail(led, NOW), tag, link, roles=("PURCHASE",), classified=True, start=bank_date("1996-01-01"), end=END)
    return plain(transactions.page(rows, 50, PLACE).select("workspace_id", "id", "local_date", F.array_join("tags", ",").alias("tags"), "replaces", "replaced_by"))


def t2_scope_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transactions.scope_warnings(load(spark, sf_dir), NOW, START)
    return plain(found.select("workspace_id", "account_id", F.array_join("warnings", ",").alias("warnings")))


def b1_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(lists.accounts(load(spark, sf_dir), cards_only=True).select("workspace_id", "id", "name", "place"))


def b1_card_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(lists.card_bills(load(spark, sf_dir), 5).select("workspace_id", "account_id", "id", "due_date", "place"))


def b1_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(lists.bill_payments(load(spark, sf_dir)).select("workspace_id", "bill_id", "id", "amount", "place"))


def b1_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(lists.bill_charges(load(spark, sf_dir)).select("workspace_id", "bill_id", "id", "charge_type", "is_matched", "place"))


def o1_sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, connection = frames(spark, sf_dir, "sync_run", "stored_connection")
    return plain(lists.sync_runs(run, connection).select("workspace_id", "id", "status", "connection_status", "place"))


def o1_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    (job,) = frames(spark, sf_dir, "job")
    return plain(lists.dead_letters(job.withColumn("workspace_id", F.col("workspace_id") % 3), 20).select("workspace_id", "id", "place"))


def o2_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(lists.categories(load(spark, sf_dir)).select("id", "label", "place"))


def o2_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    (alias,) = frames(spark, sf_dir, "alias")
    return plain(lists.merchants(load(spark, sf_dir), alias).select("workspace_id", "id", "aliases", "place"))


def with_actions(rows: DataFrame) -> DataFrame:
    def action(kind: str, value: str) -> F.Column:
        return F.struct(F.lit(kind).alias("type"), F.col(value).cast("string").alias("value"))

    return rows.withColumn("actions", F.array(action("SET_CATEGORY", "sets_category"), action("SET_MERCHANT", "sets_merchant")))


def o2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rule,) = frames(spark, sf_dir, "rule_row")
    return plain(lists.rules(rule).select("workspace_id", "id", "priority", "place"))


def f8_rules_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule's category, the rules that set the category of the same number as their own merchant modulo 30."""
    (rule,) = frames(spark, sf_dir, "rule_row")
    return plain(lists.referencing(with_actions(rule), "SET_CATEGORY", (F.col("id") % 20).cast("string")).select("workspace_id", "id"))


def o3_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = load(spark, sf_dir)
    rule = Rule("big", {"all": [{"field": "transaction.providerAmountSigned", "operator": "lt", "value": "-1000"}, {"field": "transaction.descriptionNormalized", "operator": "starts_with", "value": "store"}]}, [{"type": "ADD_TAG", "value": "x"}])
    facts = {"transaction.providerAmountSigned": F.col("provider_amount"), "transaction.descriptionNormalized": F.lower("description")}
    return plain(classification.preview(led.transaction, rule, facts, END, 366, 100).select("workspace_id", "id", "rank", "is_truncated"))


def i3_instalment_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = commitments.instalment_warnings(load(spark, sf_dir), NOW, 60)
    return plain(found.select("workspace_id", "estimated", "unallocated", "unconverted", "stale", "attention", "truncated"))


def r4_resolved_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = load(spark, sf_dir).recurring_series
    asked = series.select("workspace_id", "id", (F.col("id") % 20 == 0).alias("confirm"))
    done, audit = commitments.resolve_all(series, asked)
    told = audit.select("workspace_id", "id", F.lit(True).alias("is_told"))
    return plain(done.join(told, ["workspace_id", "id"], "left").select("workspace_id", "id", "status", F.coalesce("is_told", F.lit(False)).alias("is_told")))


def r12_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = load(spark, sf_dir)
    return plain(bills.candidate_list(led, bills.payment_candidates(led)).select("workspace_id", "bill_id", "payment_id", "transaction_id", "place"))


def r12_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of every third payment is confirmed, that of every third one after it rejected."""
    led = load(spark, sf_dir)
    found = bills.payment_candidates(led)
    asked = found.groupBy("workspace_id", "payment_id").agg(F.min("transaction_id").alias("transaction_id")).withColumn("confirm", F.when(F.col("payment_id") % 3 == 0, True).when(F.col("payment_id") % 3 == 1, False))
    return plain(bills.resolve_all(found, asked).select("workspace_id", "payment_id", "transaction_id", "match_status"))


def d5_effect_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bill evidence counts nothing, and tells so."""
    led = load(spark, sf_dir)
    kind = F.when(F.col("id") % 10 == 0, "BILL_PAYMENT_EVIDENCE").when(F.col("id") % 10 == 1, "BILL_FINANCE_CHARGE_EVIDENCE").otherwise("TRANSACTION")
    rows = effects.effects(led, kind)
    codes = policy.effect_warnings(F.col("amount"), F.col("account_type"), F.col("effective_role"), kind, F.col("id") % 20 == 1)
    return plain(rows.select("workspace_id", "id", "spend", "cash", F.array_join(codes, ",").alias("warnings")))


def d6_bill_payment_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = load(spark, sf_dir)
    rows = led.transaction.join(led.account.select("workspace_id", F.col("id").alias("account_id"), "account_type"), ["workspace_id", "account_id"])
    card, bank = F.when(F.col("id") % 3 == 0, F.col("id") + 1), F.when(F.col("id") % 2 == 0, F.col("id") + 2)
    return plain(rows.select("workspace_id", "id", matching.bill_payment_role(F.col("account_type"), F.col("direction"), card, bank).alias("evidence")))


def p1_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bill evidence for the matches stored, two of them for some; what a user decided is left alone."""
    led = load(spark, sf_dir)
    facts = more.facts(spark, sf_dir, "account_id % 60").withColumn("is_settled", F.col("id") % 51 == 0)
    evidence = facts.select("workspace_id", "id", F.explode(F.when(F.col("id") % 100 == 0, F.array(F.lit(1), F.lit(2))).when(F.col("id") % 50 == 0, F.array(F.lit(1)))).alias("evidence"))
    _ = led
    return plain(matching.detect_roles(facts, more.tolerance(spark), evidence).select("workspace_id", "id", "role", "status"))


P1 = f""", open_fact as (select * from fact where id % 51 <> 0), tr as ({more.D7.replace("fact a", "open_fact a").replace("fact b", "open_fact b")}), rf as ({more.D8.replace("fact a", "open_fact a").replace("fact b", "open_fact b")}),
  every as (select workspace_id, id, 'CARD_BILL_PAYMENT' as role, case when id % 100 = 0 then 'NEEDS_REVIEW' else 'AUTO_CONFIRMED' end as status, 1 as k from open_fact where id % 50 = 0
    union all select workspace_id, outflow_id, 'TRANSFER', status, 2 from tr union all select workspace_id, inflow_id, 'TRANSFER', status, 2 from tr union all select workspace_id, refund_id, 'REFUND', status, 3 from rf)
  select workspace_id, id, arg_min(role, (k, status)) as role, arg_min(status, (k, status)) as status from every group by 1, 2"""


def p2_replacements_in_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted and created in the time of a successful sync of their connection."""
    run, account = frames(spark, sf_dir, "sync_run", "account")
    f = more.facts(spark, sf_dir, "account_id")
    of = account.select("workspace_id", F.col("id").alias("account_id"), "connection_id")
    day = lambda n: at() - F.make_dt_interval(days=n)
    rows = f.join(of, ["workspace_id", "account_id"]).withColumns({
        "status": F.when(F.col("id") % 2 == 0, "DELETED").otherwise("POSTED"), "deleted_at": F.when(F.col("id") % 2 == 0, day((F.col("id") % 40).cast("int"))), "created_at": day((F.col("id") % 37).cast("int")),
    }).withColumn("amount", (F.col("id") % 2 * 0 + 5).cast("decimal(20,6)")).withColumn("text", F.lit("loja"))
    user = f.select("workspace_id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("id")).dropna()
    return plain(matching.replacements_in(run, rows, user).drop("amount"))


P2 = f""", rw as (select f.*, a.connection_id, {WHEN} - to_days(cast(f.id % 40 as integer)) as del, {WHEN} - to_days(cast(f.id % 37 as integer)) as cre from fact f join account a on a.workspace_id = f.workspace_id and a.id = f.account_id),
  ok as (select * from sync_run where status = 'SUCCEEDED' and finished_at is not null),
  pr as (select a.workspace_id, a.account_id, a.currency, a.id as predecessor_id, b.id as successor_id, abs(date_diff('day', a.local_date, b.local_date)) as dd
    from rw a join ok r on r.workspace_id = a.workspace_id and r.connection_id = a.connection_id and a.del between r.started_at and r.finished_at and a.id % 2 = 0
    join rw b on b.workspace_id = a.workspace_id and b.account_id = a.account_id and b.currency = a.currency and b.id % 2 <> 0 and b.cre between r.started_at and r.finished_at and abs(date_diff('day', a.local_date, b.local_date)) <= 3),
  sc as (select *, cast(round(least(1.0, cast(0.4 as double) + (case dd when 0 then 0.2 when 1 then 0.175 when 2 then 0.15 else 0.125 end)::double + 0.25::double + 0.05::double + 0.1::double), 4) as decimal(5,4)) as score from pr)
  select workspace_id, account_id, currency, predecessor_id, successor_id, dd as date_distance_days, cast(score as varchar) as score,
    case when count(*) over (partition by workspace_id, predecessor_id) = 1 and count(*) over (partition by workspace_id, successor_id) = 1 and score >= 0.95 and successor_id % 3 <> 0 then 'AUTO_CONFIRMED' else 'NEEDS_REVIEW' end as status from sc"""


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    (link,) = frames(spark, sf_dir, "link")
    return link.where("successor_id is not null")


def p3_handed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User states after the confirmed links; those of every eleventh predecessor were handed over before."""
    led = load(spark, sf_dir)
    links = linked(spark, sf_dir).where(F.col("status").isin("AUTO_CONFIRMED", "USER_CONFIRMED")).select("workspace_id", "predecessor_id", "successor_id")
    done = links.withColumn("was", F.col("predecessor_id") % 11 == 0).where("was").drop("was")
    state, _, _ = classification.hand_over(led.user_state, links, frames(spark, sf_dir, "tag")[0], done)
    return plain(state.select("workspace_id", "transaction_id", "category_value", "version"))


def p3_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = load(spark, sf_dir)
    links = linked(spark, sf_dir).where(F.col("status").isin("AUTO_CONFIRMED", "USER_CONFIRMED")).select("workspace_id", "predecessor_id", "successor_id")
    return plain(classification.hand_over(led.user_state, links, frames(spark, sf_dir, "tag")[0])[2])


def p4_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = linked(spark, sf_dir)
    asked = links.select("workspace_id", "predecessor_id", "successor_id", "decision").dropna()
    return plain(classification.review(links.drop("decision"), asked).select("workspace_id", "predecessor_id", "successor_id", "status"))


def k7_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, facts = load(spark, sf_dir).transaction, rule_facts()
    done, _, _ = classification.apply_rules(rows, more.RULES, facts, nothing_made(spark))
    return plain(done.select("workspace_id", "id", "category_id", "merchant_id", "category_source"))


def k7_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New hits where the decisions on transactions of an even merchant were made before."""
    rows, facts = load(spark, sf_dir).transaction, rule_facts()
    made = classification.apply_rules(rows.where("merchant_id % 2 = 0"), more.RULES, facts, nothing_made(spark))[1]
    return plain(classification.apply_rules(rows, more.RULES, facts, made)[2])


def rule_facts() -> dict:
    names = {"transaction.providerAmountSigned": "provider_amount", "transaction.systemDirection": "direction", "transaction.transactionLocalDate": "local_date", "merchant.id": "merchant_id"}
    return {k: F.col(c) for k, c in names.items()} | {"transaction.descriptionNormalized": F.lower("description")}


def nothing_made(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "workspace_id bigint, transaction_id bigint, rule string, fingerprint string")


K7 = """, hit as (select t.*, provider_amount < -200000 and direction = 'OUTFLOW' as a, contains(lower(description), 'urgent') or regexp_matches(lower(description), '^mp .store 2') as b,
    local_date between date '1998-01-01' and date '1998-12-31' as c, coalesce(merchant_id <> 101, false) as d0 from "transaction" t), hits as (select *, d0 and not c as d from hit)"""


def k7_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir).transaction
    done, _, _ = classification.apply_rules(rows, more.RULES, rule_facts(), nothing_made(spark))
    return plain(classification.change_tags(frames(spark, sf_dir, "tag")[0], done.select("workspace_id", "id", "tags_added", "tags_removed")))


def k8_rule_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rule,) = frames(spark, sf_dir, "rule_row")
    asked = rule.select("id", F.when(F.col("id") % 2 == 0, "CONFIRM").otherwise("DEACTIVATE").alias("action"))
    return plain(classification.rule_states(rule, asked, at()).select("workspace_id", "id", "is_active", "updated_at"))


def k8_new_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that are there again, and as many new ones."""
    (rule,) = frames(spark, sf_dir, "rule_row")
    wanted = rule.union(rule.withColumn("id", F.col("id") + 9_000_000)).drop("is_active", "created_at", "updated_at")
    return plain(classification.new_rules(rule, wanted, at()).select("workspace_id", "id", "source", "is_active", "created_at"))


def k11_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder: descriptions cut to what they name, against labels, patterns inside words, hashes and near names."""
    led = load(spark, sf_dir)
    name = F.regexp_replace(F.lower("label"), "^merchant ", "")
    merchants = led.merchant.select("workspace_id", F.col("id").alias("merchant_id"), name.alias("key"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("h"), F.col("id") % 50)).alias("identity_hash"))
    aliases = merchants.where("merchant_id < 1000000").select("workspace_id", "merchant_id", F.substring("key", 1, 4).alias("alias"), F.when(F.col("merchant_id") % 3 == 0, "PREFIX").otherwise("CONTAINS").alias("match_type"), F.lit(0.97).cast("decimal(5,4)").alias("confidence"))
    label = F.regexp_replace(F.lower("label"), "^merchant ", "")
    shape = F.when(F.col("k") % 5 == 0, label).when(F.col("k") % 5 == 1, F.concat(F.lit("super"), label)).when(F.col("k") % 5 == 2, F.concat(F.substring(label, 1, 3), F.lit("zz"), F.substring(label, 4, 20))).when(F.col("k") % 5 == 3, F.concat(F.lit("qq"), "k")).otherwise(F.concat(F.lit("shop "), label))
    rows = led.transaction.join(led.merchant.select("workspace_id", F.col("id").alias("merchant_id"), "label"), ["workspace_id", "merchant_id"]).withColumn("k", F.col("id") % 7)
    rows = rows.select("workspace_id", "id", shape.alias("text"), F.when(F.col("k") == 3, F.concat(F.lit("h"), F.col("id") % 200)).alias("identity_hash"))
    found = matching.resolve_merchants(rows, aliases, merchants, text.similarity(F.col("text"), F.col("key")))
    return plain(found.select("workspace_id", "id", "merchant_id", "method", F.array_join("review", ",").alias("review")))


K11 = """, ms as (select workspace_id, id as merchant_id, regexp_replace(lower(label), '^merchant ', '') as key, case when id % 4 = 0 then concat('h', id % 50) end as ih from merchant),
  al as (select workspace_id, merchant_id, substr(key, 1, 4) as alias, case when merchant_id % 3 = 0 then 'PREFIX' else 'CONTAINS' end as mt from ms where merchant_id < 1000000),
  rw as (select t.workspace_id, t.id, case t.id % 7 % 5 when 0 then m.key when 1 then concat('super', m.key) when 2 then concat(substr(m.key, 1, 3), 'zz', substr(m.key, 4, 20)) when 3 then concat('qq', t.id % 7) else concat('shop ', m.key) end as text,
      case when t.id % 7 = 3 then concat('h', t.id % 200) end as ih from "transaction" t join ms m on m.workspace_id = t.workspace_id and m.merchant_id = t.merchant_id),
  tx as (select distinct workspace_id, text, ih from rw),
  ex as (select x.*, (select min(merchant_id) from al a where a.workspace_id = x.workspace_id and a.alias = x.text) as ba, (select min(merchant_id) from ms m where m.workspace_id = x.workspace_id and m.key = x.text) as bk,
      (select min(merchant_id) from ms m where m.workspace_id = x.workspace_id and m.ih = x.ih) as bh from tx x),
  pt as (select x.workspace_id, x.text, count(distinct a.merchant_id) as n, min(a.merchant_id) as bp from (select distinct workspace_id, text from ex where ba is null and bk is null and bh is null) x
      join al a on a.workspace_id = x.workspace_id and case a.mt when 'PREFIX' then starts_with(x.text, a.alias) else contains(x.text, a.alias) end group by 1, 2),
  lf as (select distinct x.workspace_id, x.text from ex x left join pt p on p.workspace_id = x.workspace_id and p.text = x.text and p.n = 1 where ba is null and bk is null and bh is null and p.text is null),
  st as (select l.workspace_id, l.text, m.merchant_id, list_distinct(string_split(l.text, ' ')) as wa, list_distinct(string_split(m.key, ' ')) as wb, list_distinct(list_transform(range(1, len(l.text)), lambda k: substr(l.text, k, 2))) as ga,
      list_distinct(list_transform(range(1, len(m.key)), lambda k: substr(m.key, k, 2))) as gb from lf l join ms m on m.workspace_id = l.workspace_id),
  sm as (select workspace_id, text, merchant_id, round(greatest(len(list_intersect(wa, wb))::double / len(list_distinct(list_concat(wa, wb))), 2.0::double * len(list_intersect(ga, gb)) / (len(ga) + len(gb))), 4) as s from st),
  fz as (select workspace_id, text, string_agg(cast(merchant_id as varchar), ',' order by s desc, merchant_id) as review from (select * from sm where s >= 0.5 qualify row_number() over (partition by workspace_id, text order by s desc, merchant_id) <= 5) group by 1, 2)
  select r.workspace_id, r.id, coalesce(x.ba, x.bk, x.bh, case when p.n = 1 then p.bp end) as merchant_id,
    case when x.ba is not null then 'EXACT_ALIAS' when x.bk is not null then 'EXACT_KEY' when x.bh is not null then 'PROVIDER_IDENTITY' when p.n = 1 then 'PATTERN_ALIAS' else 'PROVISIONAL' end as method, f.review
  from rw r join ex x on x.workspace_id = r.workspace_id and x.text = r.text and x.ih is not distinct from r.ih left join pt p on p.workspace_id = r.workspace_id and p.text = r.text left join fz f on f.workspace_id = r.workspace_id and f.text = r.text"""


def k12_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next merchant takes every alias over, in its own match type."""
    (alias,) = frames(spark, sf_dir, "alias")
    wanted = alias.select("workspace_id", (F.col("merchant_id") + F.col("merchant_id") % 2).alias("merchant_id"), "alias", "match_type")
    return plain(classification.confirm_aliases(alias, wanted))


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir).merchant.select("workspace_id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("source_id"), (F.col("id") + 1).alias("target_id")).dropna()


def merged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    led = load(spark, sf_dir)
    alias, rule = frames(spark, sf_dir, "alias", "rule_row")
    merchants = led.merchant.withColumn("identity_hash", F.when(F.col("id") % 2 == 0, F.col("id").cast("string")))
    tables = {"series": (led.recurring_series.select("workspace_id", "id", "merchant_id"), ["merchant_id"]), "state": (led.user_state.select("workspace_id", "transaction_id", "merchant_value"), ["merchant_value"])}
    return classification.merge_merchants(tables, merchants, alias, with_actions(rule), merges(spark, sf_dir))


def k13_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(merged(spark, sf_dir)["alias"])


def k13_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(merged(spark, sf_dir)["merchant"].select("workspace_id", "id", "identity_hash"))


def k13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(merged(spark, sf_dir)["rule"].select("workspace_id", "id", F.array_join(F.transform("actions", lambda a: F.concat_ws("=", a["type"], a["value"])), ",").alias("actions")))


def k13_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(merged(spark, sf_dir)["state"])


TO = "case when {c} % 5 = 0 and exists (select 1 from merchant m where m.workspace_id = x.workspace_id and m.id = {c}) then {c} + 1 else {c} end"


def k14_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category under every other number as its parent, still active or not."""
    led = load(spark, sf_dir)
    (rule,) = frames(spark, sf_dir, "rule_row")
    tree = led.category.select("id", F.when(F.col("id") > 0, F.floor(F.col("id") / 2)).cast("bigint").alias("parent_id"))
    asked = tree.select("id", F.when(F.col("id") % 3 == 0, F.col("id") * 2).when(F.col("id") % 3 == 1, F.col("id")).otherwise(F.col("id") - 1).alias("parent_id"), (F.col("id") % 4 != 0).alias("is_active"))
    return plain(classification.checked_categories(tree, asked, with_actions(rule)))


def k15_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, late = classification.correct(load(spark, sf_dir).user_state, frames(spark, sf_dir, "correction")[0])
    told = late.select("workspace_id", "transaction_id", F.lit(True).alias("is_late"))
    columns = ["workspace_id", "transaction_id", "category_override", "category_value", "merchant_override", "merchant_value", "role_override", "role_value", "excluded_value", "version"]
    return plain(state.join(told, ["workspace_id", "transaction_id"], "left").select(*columns, F.coalesce("is_late", F.lit(False)).alias("is_late")))


K15 = """select coalesce(u.workspace_id, c.workspace_id) as workspace_id, coalesce(u.transaction_id, c.transaction_id) as transaction_id,
    case when ok and category_mode is not null then category_mode <> 'INHERIT' else category_override end as category_override, case when ok and category_mode is not null then case category_mode when 'SET' then c.category_value end else u.category_value end as category_value,
    case when ok and merchant_mode is not null then merchant_mode <> 'INHERIT' else merchant_override end as merchant_override, case when ok and merchant_mode is not null then case merchant_mode when 'SET' then c.merchant_value end else u.merchant_value end as merchant_value,
    case when ok and role_mode is not null then role_mode <> 'INHERIT' else role_override end as role_override, case when ok and role_mode is not null then case role_mode when 'SET' then c.role_value end else u.role_value end as role_value,
    case when ok and exclusion_mode is not null then case exclusion_mode when 'SET' then c.excluded_value end else u.excluded_value end as excluded_value, case when ok then coalesce(version, 0) + 1 else version end as version, c.transaction_id is not null and not ok as is_late
  from (select c.*, c.expected_version = coalesce(u.version, 0) as ok from correction c left join user_state u on u.workspace_id = c.workspace_id and u.transaction_id = c.transaction_id) c
  full join user_state u on u.workspace_id = c.workspace_id and u.transaction_id = c.transaction_id where u.transaction_id is not null or ok"""


def k15_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag, asked = frames(spark, sf_dir, "tag", "correction")
    patches = asked.select("workspace_id", "transaction_id", "expected_version", F.when(F.col("transaction_id") % 3 == 0, F.array(F.lit("new"), F.lit("trip"))).when(F.col("transaction_id") % 3 == 1, F.array().cast("array<string>")).alias("tags"))
    return plain(classification.replace_tags(tag, patches, load(spark, sf_dir).user_state))


def k15_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir).transaction
    rows = t.select("workspace_id", F.col("id").alias("transaction_id"), F.when(F.col("id") % 2 == 0, "MERCHANT").otherwise("DESCRIPTION").alias("basis"), F.lower("description").alias("text"), "merchant_id", F.col("category_id").alias("category_value"))
    return plain(classification.suggestions(rows))


def val_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All integrity rules over the ledger, some broken on purpose."""
    led = load(spark, sf_dir)
    (rule,) = frames(spark, sf_dir, "rule_row")
    tree = led.category.withColumns({"workspace_id": F.when(F.col("id") % 2 == 1, F.col("id") % 3), "parent_id": F.when(F.col("id") > 0, F.floor(F.col("id") / 2)).cast("bigint"), "code": F.col("label")})
    after = tree.withColumns({"code": F.when(F.col("id") % 4 == 0, "changed").otherwise(F.col("code"))})
    state = led.user_state.select("workspace_id", F.col("transaction_id").alias("id"), "category_value")
    charges = led.bill_charge.withColumns({"currency": F.when(F.col("id") % 7 == 0, "GBP").otherwise(F.col("currency")), "matched_transaction_id": F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 100)).cast("bigint")})
    return validate.every(
        validate.repeated(led.transaction.withColumn("provider_id", F.col("id") - F.col("id") % 2), ["workspace_id", "provider_id"], "PROVIDER_ID", "provider_id"),
        validate.visible_category(state, tree, "category_value", "STATE_CATEGORY"),
        validate.category_parents(tree),
        validate.immutable_categories(tree, after),
        validate.bill_accounts(led),
        validate.transaction_bills(led),
        validate.matched_accounts(charges, led, "matched_transaction_id", ("CREDIT_CARD",), "CHARGE_ACCOUNT"),
        validate.child_evidence(charges, led, "matched_transaction_id", "CHARGE_EVIDENCE"),
        validate.active_matches(led),
        validate.rule_categories(with_actions(rule), tree),
        validate.instalment_facts(led.instalment_series.withColumn("highest_confirmed", F.col("highest_confirmed") * F.when(F.col("id") % 9 == 0, 100).otherwise(1))),
        validate.recurring_facts(led.recurring_series.withColumn("amount_average", (F.col("amount_average") + F.col("id") % 3).cast("decimal(20,6)"))),
    )


VALIDATORS = f"""
tree as (select id, case when id % 2 = 1 then id % 3 end as workspace_id, case when id > 0 then id // 2 end as parent_id, is_active from category),
chg as (select c.*, case when id % 7 = 0 then 'GBP' else currency end as cur, case when id % 3 = 0 then id // 100 end as mt from bill_charge c),
acc as (select t.workspace_id, t.id, t.account_id, t.bill_id, t.account_currency, a.account_type from "transaction" t join account a on a.workspace_id = t.workspace_id and a.id = t.account_id)
select 'PROVIDER_ID' as rule, workspace_id, id - id % 2 as id from "transaction" group by 2, 3 having count(*) > 1
union all select 'STATE_CATEGORY', workspace_id, transaction_id from user_state u where category_value is not null and not exists (select 1 from tree c where c.id = u.category_value and (c.workspace_id is null or c.workspace_id = u.workspace_id))
union all select 'CATEGORY_PARENT', c.workspace_id, c.id from tree c join tree p on p.id = c.parent_id where p.workspace_id is not null and p.workspace_id is distinct from c.workspace_id
union all select 'CATEGORY_IMMUTABLE', workspace_id, id from tree where id % 4 = 0
union all select 'BILL_ACCOUNT', workspace_id, id from bill b where not exists (select 1 from account a where a.workspace_id = b.workspace_id and a.id = b.account_id and a.account_type = 'CREDIT_CARD')
union all select 'TRANSACTION_BILL', workspace_id, id from "transaction" t where bill_id is not null and not exists (select 1 from bill b where b.workspace_id = t.workspace_id and b.id = t.bill_id and b.account_id = t.account_id)
union all select 'CHARGE_ACCOUNT', c.workspace_id, c.id from chg c join acc t on t.workspace_id = c.workspace_id and t.id = c.mt where t.account_type <> 'CREDIT_CARD'
union all select 'CHARGE_EVIDENCE', c.workspace_id, c.id from chg c join bill b on b.workspace_id = c.workspace_id and b.id = c.bill_id left join acc t on t.workspace_id = c.workspace_id and t.id = c.mt
  where c.cur <> b.currency or (t.id is not null and (t.account_id <> b.account_id or t.account_currency <> b.currency or coalesce(t.bill_id <> b.id, false)))
union all select 'ACTIVE_MATCH', r.workspace_id, r.id from reconciliation r where match_status in ('AUTO_MATCHED', 'USER_CONFIRMED') and not exists (select 1 from bill_payment p join tolerance tl on tl.currency = p.currency
  join eff e on e.workspace_id = p.workspace_id and e.ccy = p.currency and e.direction = 'OUTFLOW' and e.eff_role = 'CARD_BILL_PAYMENT' and e.status <> 'DELETED' and e.deleted_at is null and abs(abs(e.amt) - p.amount) <= tl.tolerance_amount and abs(date_diff('day', e.local_date, p.payment_date)) <= 2
  join account a on a.workspace_id = e.workspace_id and a.id = e.account_id and a.account_type in ('CHECKING', 'SAVINGS') where p.workspace_id = r.workspace_id and p.id = r.payment_id and e.id = r.transaction_id)
union all select 'RULE_CATEGORY', workspace_id, id from rule_row r where not exists (select 1 from tree c where c.is_active and c.id = r.sets_category and (c.workspace_id is null or c.workspace_id = r.workspace_id))
union all select 'INSTALMENT_FACTS', workspace_id, id from instalment_series where case when id % 9 = 0 then highest_confirmed * 100 else highest_confirmed end > total_instalments
union all select 'RECURRING_FACTS', workspace_id, id from recurring_series where amount_average + id % 3 not between amount_min and amount_max"""


def ag13_tags_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transaction's tags as an ordered JSON array."""
    (tag,) = frames(spark, sf_dir, "tag")
    return plain(tag.groupBy("workspace_id", "transaction_id").agg(F.to_json(F.array_sort(F.collect_set("tag"))).alias("tags")))


def fn_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorisation, document and NSU numbers taken out of descriptions."""
    t = load(spark, sf_dir).transaction
    line = F.concat_ws(" ", "description", F.when(F.col("id") % 4 == 0, F.concat(F.lit("AUT: a1b"), F.col("id") % 1000)).when(F.col("id") % 4 == 1, F.concat(F.lit("doc #"), F.col("id") % 1000 + 1000)).when(F.col("id") % 4 == 2, F.concat(F.lit("NSU-"), F.col("id") % 1000 + 5000)))
    found = text.normal_form(line)["references"]
    return plain(t.select("workspace_id", "id", *[F.element_at(found, k).alias(k.lower()) for k in text.REFERENCES]))


QUERIES = {f.__name__: f for f in (
    f1_filtered_totals, f1_merchant_series, q2_next_page, t1_next_page, t2_scope_warnings, b1_cards, b1_card_bills, b1_payments, b1_charges, o1_sync_runs, o1_dead_letters, o2_categories, o2_merchants, o2_rules, f8_rules_of_category, o3_preview,
    i3_instalment_warnings, r4_resolved_series, r12_candidates, r12_resolved, d5_effect_warnings, d6_bill_payment_roles, p1_roles, p2_replacements_in_sync, p3_handed_over, p3_tags, p4_reviewed, k7_applied, k7_hits, k7_tags,
    k8_rule_states, k8_new_rules, k11_resolved, k12_aliases, k13_aliases, k13_merchants, k13_rules, k13_states, k14_checked, k15_corrected, k15_tags, k15_suggestions, val_violations, ag13_tags_json, fn_references,
)}


def sql(body: str, *names: str, head: str = "") -> str:
    """A body behind the ledger, further named parts and those inputs."""
    return (oracle.cte() + head + ctes(*names)).rstrip().rstrip(",") + "\n" + body


PAGE = f"(local_date, id) < (date '{AFTER[0]}', {AFTER[1]})"
STATE = "select workspace_id, transaction_id from user_state union select workspace_id, transaction_id from tag"
CONFIRMED = "lk as (select * from link where successor_id is not null and status in ('AUTO_CONFIRMED', 'USER_CONFIRMED')), taken as (" + STATE + "),\n"
ORACLE_SQL = {
    "f1_filtered_totals": sql(f"select workspace_id, ccy as currency, status, {oracle.SPEND}, {oracle.CASH} from fx where local_date between date '1997-09-01' and date '{oracle.END}' and status in ('POSTED', 'PENDING') and workspace_id = {WORKSPACE} and eff_category = {CATEGORY} group by 1, 2, 3", head=oracle.EFFECTIVE),
    "f1_merchant_series": sql(oracle.series("month").replace(oracle.IN_RANGE, f"local_date between date '1997-09-01' and date '{oracle.END}' and status in ('POSTED', 'PENDING') and workspace_id = {WORKSPACE} and eff_merchant = {MERCHANT}"), head=oracle.EFFECTIVE),
    "q2_next_page": sql(f"select workspace_id, id, cast(local_date as varchar) as local_date, count(*) over (partition by workspace_id) > 50 as has_next from eff where deleted_at is null and status <> 'DELETED' and eff_category is null and {PAGE} qualify row_number() over (partition by workspace_id order by local_date desc, id desc) <= 50", head=oracle.EFFECTIVE),
    "t1_next_page": sql(f"""select f.workspace_id, f.id, cast(f.local_date as varchar) as local_date, coalesce((select string_agg(distinct tag, ',' order by tag) from tag g where g.workspace_id = f.workspace_id and g.transaction_id = f.id), '') as tags,
        (select max(predecessor_id) from link l where l.workspace_id = f.workspace_id and l.successor_id = f.id and l.status <> 'REJECTED') as replaces, (select max(successor_id) from link l where l.workspace_id = f.workspace_id and l.predecessor_id = f.id and l.status <> 'REJECTED') as replaced_by
        from fx f where f.deleted_at is null and f.status <> 'DELETED' and f.eff_role = 'PURCHASE' and f.eff_category is not null and f.local_date between date '1996-01-01' and date '{oracle.END}' and (f.local_date, f.id) < (date '{AFTER[0]}', {AFTER[1]})
        qualify row_number() over (partition by f.workspace_id order by f.local_date desc, f.id desc) <= 50""", "tag", "link", head=oracle.EFFECTIVE),
    "t2_scope_warnings": sql(f"""select a.workspace_id, a.id as account_id, concat_ws(',', case when a.earliest_date is null or a.earliest_date > date '{oracle.START}' then 'INCOMPLETE_HISTORY' end, case when coalesce(r.stale, true) then 'STALE_DATA' end, case when coalesce(r.attention, false) then 'CONNECTION_ATTENTION' end) as warnings
        from account a left join frs r on r.workspace_id = a.workspace_id and r.account_id = a.id where a.deleted_at is null""", head=oracle.FRESH),
    "b1_cards": sql("select workspace_id, id, name, row_number() over (partition by workspace_id order by name, id) as place from account where account_type = 'CREDIT_CARD' and deleted_at is null qualify place <= 100"),
    "b1_card_bills": sql("select b.workspace_id, b.account_id, b.id, cast(b.due_date as varchar) as due_date, row_number() over (partition by b.workspace_id, b.account_id order by b.due_date desc nulls last, b.id desc) as place from bill b join account a on a.workspace_id = b.workspace_id and a.id = b.account_id and a.account_type = 'CREDIT_CARD' and a.deleted_at is null qualify place <= 5"),
    "b1_payments": sql(f"select p.workspace_id, p.bill_id, p.id, {M('p.amount')} as amount, row_number() over (partition by p.workspace_id, p.bill_id order by payment_date desc, p.id desc) as place from bill_payment p join bill b on b.workspace_id = p.workspace_id and b.id = p.bill_id join account a on a.workspace_id = b.workspace_id and a.id = b.account_id and a.account_type = 'CREDIT_CARD' and a.deleted_at is null qualify place <= 100"),
    "b1_charges": sql("select p.workspace_id, p.bill_id, p.id, p.charge_type, p.matched_transaction_id is not null as is_matched, row_number() over (partition by p.workspace_id, p.bill_id order by p.charge_type, p.id) as place from bill_charge p join bill b on b.workspace_id = p.workspace_id and b.id = p.bill_id join account a on a.workspace_id = b.workspace_id and a.id = b.account_id and a.account_type = 'CREDIT_CARD' and a.deleted_at is null"),
    "o1_sync_runs": sql("select r.workspace_id, r.id, r.status, c.local_status as connection_status, row_number() over (partition by r.workspace_id order by r.started_at desc, r.id desc) as place from sync_run r join stored_connection c on c.workspace_id = r.workspace_id and c.id = r.connection_id qualify place <= 50", "sync_run", "stored_connection"),
    "o1_dead_letters": sql("select workspace_id % 3 as workspace_id, id, row_number() over (partition by workspace_id % 3 order by finished_at desc, id desc) as place from job where status = 'DEAD' qualify place <= 20", "job"),
    "o2_categories": sql("select id, label, row_number() over (order by label, id) as place from category where is_active"),
    "o2_merchants": sql("""select m.workspace_id, m.id, coalesce((select '[' || string_agg('{"alias":"' || alias || '","match_type":"' || match_type || '","confidence":"' || cast(confidence as varchar) || '"}', ',' order by alias, match_type, confidence) || ']' from alias a where a.workspace_id = m.workspace_id and a.merchant_id = m.id and a.is_active), '[]') as aliases,
        row_number() over (partition by m.workspace_id order by case when review_status = 'CONFIRMED' then 0 else 1 end, label, id) as place from merchant m qualify place <= 100""", "alias"),
    "o2_rules": sql("select workspace_id, id, priority, row_number() over (partition by workspace_id order by priority desc, created_at, id) as place from rule_row qualify place <= 100", "rule_row"),
    "f8_rules_of_category": sql("select workspace_id, id from rule_row where sets_category = id % 20", "rule_row"),
    "o3_preview": sql(f"""select workspace_id, id, rank, count(*) over (partition by workspace_id) > 100 as is_truncated from (select workspace_id, id, row_number() over (partition by workspace_id order by local_date desc, id desc) as rank from "transaction"
        where local_date between date '{oracle.END}' - 365 and date '{oracle.END}' and provider_amount < -1000 and lower(description) like 'store%' qualify rank <= 101) qualify rank <= 100"""),
    "i3_instalment_warnings": sql(f"""select w.workspace_id, coalesce(max(shown), 0) > 60 as truncated, coalesce(bool_or(s.status = 'CONFIRMED' and s.remaining > 0), false) as estimated, count(*) filter (where s.status = 'CONFIRMED' and s.remaining > 0 and (s.estimated_amount is null or s.purchase_date is null)) as unallocated,
        cast(coalesce(sum(s.u), 0) as bigint) as unconverted, max(w.stale) as stale, max(w.attention) as attention
      from (select workspace_id, count(*) filter (where stale) as stale, count(*) filter (where attention) as attention from frs group by 1) w left join (select *, count(*) over (partition by workspace_id) as shown,
        row_number() over (partition by workspace_id order by case status when 'CONFIRMED' then 0 when 'CANDIDATE' then 1 else 2 end, purchase_date desc nulls last, id) as rk from com where status in ('CONFIRMED', 'CANDIDATE', 'NEEDS_REVIEW') qualify rk <= 60) s on s.workspace_id = w.workspace_id group by w.workspace_id""", head=oracle.EFFECTIVE + oracle.COMMITMENTS + oracle.FRESH),
    "r4_resolved_series": sql("select workspace_id, id, case when status = 'CANDIDATE' then case when id % 20 = 0 then 'CONFIRMED' else 'REJECTED' end else status end as status, status = 'CANDIDATE' as is_told from recurring_series"),
    "r12_candidates": sql("select c.workspace_id, p.bill_id, c.payment_id, c.transaction_id, row_number() over (partition by c.workspace_id, p.bill_id order by c.confidence desc, c.payment_id, c.transaction_id) as place from (" + oracle.BODIES["r11_payment_candidates"][1] + ") c join bill_payment p on p.workspace_id = c.workspace_id and p.id = c.payment_id qualify place <= 20", head=oracle.EFFECTIVE),
    "r12_resolved": sql("""select workspace_id, payment_id, transaction_id, case when transaction_id = one and payment_id % 3 = 0 then 'USER_CONFIRMED' when transaction_id = one and payment_id % 3 = 1 then 'REJECTED' when payment_id % 3 = 0 or taken then 'REJECTED' else 'CANDIDATE' end as match_status
        from (select *, bool_or(transaction_id = one and payment_id % 3 = 0) over (partition by workspace_id, transaction_id) as taken from (select *, min(transaction_id) over (partition by workspace_id, payment_id) as one from (""" + oracle.BODIES["r11_payment_candidates"][1] + ")))", head=oracle.EFFECTIVE),
    "d5_effect_warnings": sql(f"""select workspace_id, id, {M("case when id % 10 < 2 then 0 else spend end")} as spend, {M("case when id % 10 < 2 then 0 else cash end")} as cash, concat_ws(',', case when amt is null then 'UNCONVERTED_CURRENCY' end, case when eff_role = 'UNKNOWN_CREDIT' and account_type = 'CREDIT_CARD' then 'UNRESOLVED_CARD_CREDIT' end,
        case when id % 10 = 1 and id % 20 <> 1 then 'UNRESOLVED_FINANCE_CHARGE' end, case when id % 10 < 2 then 'BILL_EVIDENCE_NOT_COUNTED' end) as warnings from fx""", head=oracle.EFFECTIVE),
    "d6_bill_payment_roles": sql('select t.workspace_id, t.id, case when a.account_type = \'CREDIT_CARD\' and t.id % 3 = 0 then t.id + 1 when a.account_type in (\'CHECKING\', \'SAVINGS\') and t.direction = \'OUTFLOW\' and t.id % 2 = 0 then t.id + 2 end as evidence from "transaction" t join account a on a.workspace_id = t.workspace_id and a.id = t.account_id'),
    "p1_roles": more.tail(more.fact_cte("account_id % 60"), P1),
    "p2_replacements_in_sync": more.tail((oracle.cte() + ctes("sync_run")).rstrip().rstrip(",") + f", fact as ({more.FACT.format(account='account_id', text='varchar')})\n", P2),
    "p3_handed_over": sql("""select workspace_id, transaction_id, category_value, version from user_state union all select s.workspace_id, l.successor_id, s.category_value, 1 from lk l join user_state s on s.workspace_id = l.workspace_id and s.transaction_id = l.predecessor_id
        where l.predecessor_id % 11 <> 0 and not exists (select 1 from taken t where t.workspace_id = l.workspace_id and t.transaction_id = l.successor_id)""".replace("select workspace_id, transaction_id, category_value, version from", "select workspace_id, transaction_id, category_value, version from", 1), "tag", "link").replace("\nselect workspace_id, transaction_id, category_value", ",\n" + CONFIRMED.rstrip().rstrip(",") + "\nselect workspace_id, transaction_id, category_value", 1),
    "p3_tags": sql("""select workspace_id, transaction_id, tag from tag union all select g.workspace_id, l.successor_id, g.tag from lk l join tag g on g.workspace_id = l.workspace_id and g.transaction_id = l.predecessor_id
        where not exists (select 1 from taken t where t.workspace_id = l.workspace_id and t.transaction_id = l.successor_id)""", "tag", "link").replace("\nselect workspace_id, transaction_id, tag from tag union", ",\n" + CONFIRMED.rstrip().rstrip(",") + "\nselect workspace_id, transaction_id, tag from tag union", 1),
    "p4_reviewed": sql("select workspace_id, predecessor_id, successor_id, case when decision = 'CONFIRM' and status <> 'REJECTED' then 'USER_CONFIRMED' when decision = 'REJECT' and status not in ('AUTO_CONFIRMED', 'USER_CONFIRMED') then 'REJECTED' else status end as status from link where successor_id is not null", "link"),
    "k7_applied": more.tail(oracle.cte(), K7 + " select workspace_id, id, case when a then 7 when b then 3 else category_id end as category_id, case when b then 11 when d then 12 else merchant_id end as merchant_id, case when a or b then 'RULE' else category_source end as category_source from hits"),
    "k7_hits": more.tail(oracle.cte(), K7 + " select workspace_id, rule, count(*) as new_hits from (select workspace_id, merchant_id, unnest(['large', 'urgent', 'stop', 'rest']) as rule, unnest([a, b, c, d]) as on_ from hits) where on_ and coalesce(merchant_id % 2, 1) <> 0 group by 1, 2"),
    "k7_tags": more.tail((oracle.cte() + ctes("tag")).rstrip().rstrip(",") + "\n", K7 + """ select g.workspace_id, g.transaction_id, g.tag from (select distinct workspace_id, transaction_id, tag from tag union select workspace_id, id, 'large' from hits where a) g join hits h on h.workspace_id = g.workspace_id and h.id = g.transaction_id where not (g.tag = 'large' and not h.a and h.d)"""),
    "k8_rule_states": sql(f"select workspace_id, id, case when id % 2 = 0 then is_active or source = 'SYSTEM_SUGGESTION' else false end as is_active, cast(case when (id % 2 = 0 and source = 'SYSTEM_SUGGESTION' and not is_active) or (id % 2 <> 0 and is_active) then {WHEN} else updated_at end as varchar) as updated_at from rule_row", "rule_row"),
    "k8_new_rules": sql(f"select workspace_id, id, source, is_active, cast(created_at as varchar) as created_at from rule_row union all select workspace_id, id + 9000000, source, source <> 'SYSTEM_SUGGESTION', cast({WHEN} as varchar) from rule_row", "rule_row"),
    "k11_resolved": more.tail(oracle.cte(), K11),
    "k12_aliases": sql("""select a.workspace_id, a.merchant_id, a.alias, a.match_type, cast(case when a.merchant_id % 2 = 0 then 1.0 else a.confidence end as decimal(5,4)) :: varchar as confidence, a.merchant_id % 2 = 0 as is_active from alias a
        union all select workspace_id, merchant_id + 1, alias, match_type, '1.0000', true from alias where merchant_id % 2 <> 0""", "alias"),
    "k13_aliases": sql(f"select workspace_id, merchant_id, alias, match_type, cast(max(confidence) as varchar) as confidence, bool_or(is_active) as is_active from (select x.workspace_id, {TO.format(c='x.merchant_id')} as merchant_id, alias, match_type, confidence, is_active from alias x) group by 1, 2, 3, 4", "alias"),
    "k13_merchants": sql("select m.workspace_id, m.id, case when m.id % 2 = 0 then cast(m.id as varchar) when s.id % 2 = 0 then cast(s.id as varchar) end as identity_hash from merchant m left join merchant s on s.workspace_id = m.workspace_id and s.id = m.id - 1 and s.id % 5 = 0 where m.id % 5 <> 0"),
    "k13_rules": sql(f"select workspace_id, id, concat('SET_CATEGORY=', sets_category, ',SET_MERCHANT=', {TO.format(c='x.sets_merchant')}) as actions from rule_row x", "rule_row"),
    "k13_states": sql(f"select workspace_id, transaction_id, {TO.format(c='x.merchant_value')} as merchant_value from user_state x"),
    "k14_checked": sql("""select id, case when parent = id then 'OWN_PARENT' when parent in (select id from up where up.ancestor = q.id) then 'CYCLE' when id % 4 = 0 and id in (select sets_category from rule_row where is_active) then 'IN_USE' end as error from (select id, case id % 3 when 0 then id * 2 when 1 then id else id - 1 end as parent from category) q""", "rule_row").replace("with ", "with recursive up as (select cast(n_nationkey as bigint) as id, cast(n_nationkey // 2 as bigint) as ancestor from nation where n_nationkey between 1 and 8 union all select up.id, up.ancestor // 2 from up where up.ancestor > 0),\n", 1),
    "k15_corrected": sql(K15, "correction"),
    "k15_tags": sql("""select g.workspace_id, g.transaction_id, g.tag from tag g left join held h on h.workspace_id = g.workspace_id and h.transaction_id = g.transaction_id where h.transaction_id is null
        union all select workspace_id, transaction_id, unnest(['new', 'trip']) from held where transaction_id % 3 = 0""", "tag", "correction").replace("\nselect g.workspace_id", ",\nheld as (select c.workspace_id, c.transaction_id from correction c left join user_state u on u.workspace_id = c.workspace_id and u.transaction_id = c.transaction_id where c.expected_version = coalesce(u.version, 0) and c.transaction_id % 3 < 2)\nselect g.workspace_id", 1),
    "k15_suggestions": sql("select workspace_id, id as transaction_id, case when id % 2 = 0 then 'merchant.id' else 'transaction.descriptionNormalized' end as field, 'eq' as operator, case when id % 2 = 0 then cast(merchant_id as varchar) else lower(description) end as value, category_id as set_category, 'SYSTEM_SUGGESTION' as source, false as is_active from \"transaction\" where category_id is not null and (id % 2 <> 0 or merchant_id is not null)"),
    "val_violations": (oracle.cte() + oracle.EFFECTIVE + ctes("rule_row")).rstrip() + VALIDATORS,
    "ag13_tags_json": sql("select workspace_id, transaction_id, '[' || string_agg('\"' || tag || '\"', ',' order by tag) || ']' as tags from (select distinct * from tag) group by 1, 2", "tag"),
    "fn_references": sql("select workspace_id, id, case when id % 4 = 0 then concat('A1B', id % 1000) end as authorization, case when id % 4 = 1 then cast(id % 1000 + 1000 as varchar) end as document, case when id % 4 = 2 then cast(id % 1000 + 5000 as varchar) end as nsu from \"transaction\""),
}
