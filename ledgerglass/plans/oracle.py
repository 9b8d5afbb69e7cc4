"""SQL that states each ledger query independently, for the checking engine."""

from __future__ import annotations

from .ledger import AS_OF, NOW, cte

START, END = "1998-08-01", "1998-08-31"
THEN_START, THEN_END = "1998-07-01", "1998-07-31"
MONTH, MONTH_END, DAY, DAYS = "date '1998-08-01'", "date '1998-08-31'", 20, 31
TODAY = f"date '{AS_OF}'"


def m(x: str) -> str:
    """An amount as text."""
    return f"cast(cast({x} as decimal(20,6)) as varchar)"


def pct(part: str, base: str) -> str:
    """part / base in percent as text: half up at six places, in whole millionths."""
    a, b = f"cast(({part}) * 1000000 as hugeint)", f"cast(({base}) * 1000000 as hugeint)"
    return f"case when {base} <> 0 then {m(f'cast(sign({a}) * sign({b}) as integer) * cast(((abs({a}) * 200000000 + abs({b})) // (2 * abs({b}))) as decimal(28,0)) * cast(0.000001 as decimal(7,6))')} end"


def div(x: str, n: str, places: int = 6) -> str:
    """x / n, half up at so many places, exactly."""
    u = f"cast(({x}) * 1{'0' * places} as hugeint)"
    return f"cast(cast(sign({u}) as integer) * cast((2 * abs({u}) + {n}) // (2 * {n}) as decimal(26,0)) * cast({10.0**-places:.{places}f} as decimal({places + 1},{places})) as decimal(24,{places}))"


EFFECTIVE = """
eff as (
  select t.*, case when u.category_override then u.category_value else t.category_id end as eff_category,
    case when u.merchant_override then u.merchant_value else t.merchant_id end as eff_merchant,
    case when u.role_override then u.role_value else t.role end as eff_role,
    case when u.category_override then 'USER' else t.category_source end as eff_source,
    coalesce(u.excluded_value, t.is_excluded) as eff_excluded, t.account_currency as ccy,
    case when t.account_amount is not null then t.account_amount when t.provider_currency = t.account_currency then t.provider_amount end as amt,
    t.account_amount is null and t.provider_currency <> t.account_currency as unconv,
    coalesce(u.review_status, 'UNREVIEWED') as review, coalesce(u.version, 0) as ver, u.notes as note,
    (t.deleted_at is null and t.status <> 'DELETED' and t.duplicate_status <> 'CONFIRMED_DUPLICATE') as alive
  from "transaction" t left join user_state u on u.workspace_id = t.workspace_id and u.transaction_id = t.id),
fx as (
  select e.*, a.account_type,
    case when not alive or eff_excluded then 0 when eff_role in ('PURCHASE', 'FEE', 'TAX') then abs(amt) when eff_role in ('REFUND', 'CREDIT') then -abs(amt) else 0 end as spend,
    case when not alive or account_type not in ('CHECKING', 'SAVINGS') or eff_role = 'TRANSFER' then 0 when direction = 'INFLOW' then abs(amt) when direction = 'OUTFLOW' then -abs(amt) else 0 end as cash
  from eff e join account a on a.workspace_id = e.workspace_id and a.id = e.account_id),
"""
BILLS = """
lt as (select workspace_id, bill_id, ccy, sum(abs(amt)) filter (where alive and amt is not null) as linked, count(*) filter (where unconv) as unconv from eff where bill_id is not null group by 1, 2, 3),
np as (select workspace_id, bill_id, currency, sum(amount) as paid, count(*) as n from bill_payment group by 1, 2, 3),
nc as (select workspace_id, bill_id, currency, sum(amount) as charged, count(*) as n, count(*) filter (where matched_transaction_id is null) as open_n from bill_charge group by 1, 2, 3),
cb as (select p.workspace_id, p.bill_id, p.currency, sum(abs(e.amt)) as confirmed, count(distinct p.id) as n
  from bill_payment p join reconciliation r on r.workspace_id = p.workspace_id and r.payment_id = p.id and r.match_status in ('AUTO_MATCHED', 'USER_CONFIRMED') join tolerance tl on tl.currency = p.currency
  join eff e on e.workspace_id = r.workspace_id and e.id = r.transaction_id and e.eff_role = 'CARD_BILL_PAYMENT' and e.direction = 'OUTFLOW' and e.alive and e.ccy = p.currency and e.amt is not null
    and abs(abs(e.amt) - p.amount) <= tl.tolerance_amount and abs(date_diff('day', e.local_date, p.payment_date)) <= 2
  join account a on a.workspace_id = e.workspace_id and a.id = e.account_id and a.account_type in ('CHECKING', 'SAVINGS') group by 1, 2, 3),
rec as (select b.workspace_id, b.id as bill_id, b.account_id, b.status as bill_status, b.due_date, b.close_date, b.currency, b.total_amount, coalesce(linked, 0) as linked, coalesce(paid, 0) as paid, coalesce(charged, 0) as charged,
    coalesce(confirmed, 0) as confirmed, coalesce(np.n, 0) as np_n, coalesce(nc.n, 0) as nc_n, coalesce(cb.n, 0) as cb_n, coalesce(lt.unconv, 0) as unconv_n,
    coalesce(open_n, 0) + greatest(coalesce(np.n, 0) - coalesce(cb.n, 0), 0) + coalesce(lt.unconv, 0) as open_items, tl.tolerance_amount, b.total_amount - coalesce(linked, 0) as difference
  from bill b left join lt on lt.workspace_id = b.workspace_id and lt.bill_id = b.id and lt.ccy = b.currency left join np on np.workspace_id = b.workspace_id and np.bill_id = b.id and np.currency = b.currency
  left join nc on nc.workspace_id = b.workspace_id and nc.bill_id = b.id and nc.currency = b.currency left join cb on cb.workspace_id = b.workspace_id and cb.bill_id = b.id and cb.currency = b.currency left join tolerance tl on tl.currency = b.currency),
recs as (select *, case when total_amount is null then 'UNKNOWN' when tolerance_amount is null then 'TOLERANCE_REQUIRED' when open_items > 0 then 'NEEDS_REVIEW' when abs(difference) <= tolerance_amount then 'RECONCILED' else 'NEEDS_REVIEW' end as rec_status from rec),
"""
FRESH = f"""
fr as (select a.workspace_id, a.id as account_id, a.connection_id, c.local_status, greatest(c.last_successful_sync_at, a.last_successful_sync_at) as synced
  from account a join connection c on c.workspace_id = a.workspace_id and c.id = a.connection_id where a.deleted_at is null and c.deleted_at is null),
frs as (select *, date_diff('second', synced, timestamp '{NOW}') as age, coalesce(synced < timestamp '{NOW}' - interval 24 hours, true) as stale, local_status not in ('ACTIVE', 'SYNCING') as attention from fr),
"""
SPEND = f"{m('coalesce(sum(greatest(spend, 0)), 0)')} as gross_spending, {m('coalesce(sum(greatest(-spend, 0)), 0)')} as refund_total, {m('coalesce(sum(spend), 0)')} as net_spending, count(*) filter (where spend <> 0) as spend_count"
CASH = f"{m('coalesce(sum(greatest(cash, 0)), 0)')} as inflow_total, {m('coalesce(sum(greatest(-cash, 0)), 0)')} as outflow_total, {m('coalesce(sum(cash), 0)')} as net_cashflow, count(*) filter (where cash <> 0) as cashflow_count"
IN_RANGE = f"local_date between date '{START}' and date '{END}' and status in ('POSTED', 'PENDING')"
COUNTABLE = "status = 'POSTED' and alive and eff_role = 'PURCHASE' and spend > 0 and not unconv"
COMMITMENTS = """
pi as (select workspace_id, series_id, count(*) as n, sum(abs(amt)) as a, count(*) filter (where unconv) as u from eff where series_id is not null and status = 'POSTED' and deleted_at is null group by 1, 2),
com as (select s.*, greatest(s.total_instalments - s.highest_confirmed, 0) as remaining, coalesce(n, 0) as n, coalesce(a, 0) as a, coalesce(u, 0) as u from instalment_series s left join pi on pi.workspace_id = s.workspace_id and pi.series_id = s.id),
"""
MONTHLY = """
mon as (select workspace_id, cast(date_trunc('month', local_date) as date) as month, ccy, eff_category, sum(spend) as spend_amount from fx where status = 'POSTED' and deleted_at is null group by 1, 2, 3, 4),
"""
RECENT = f"rc as (select * from fx where {COUNTABLE} and local_date between {TODAY} - 210 and {TODAY}),\n"


def monthly(by: str) -> str:
    return f"select workspace_id, cast(cast(date_trunc('month', local_date) as date) as varchar) as month, ccy as currency, eff_{by} as {by}_id, {m('sum(spend)')} as spend_amount, count(spend) as transaction_count, count(*) filter (where unconv) as unconverted_count from fx where status = 'POSTED' and deleted_at is null group by 1, 2, 3, 4"


def breakdown(by: str) -> str:
    return f"""select * exclude (k, net, rk), coalesce(max(rk) over (partition by workspace_id) > 100, false) as is_truncated from (
      select *, row_number() over (partition by workspace_id order by abs(net) desc, currency, status, label nulls last, k nulls last) as rk from (
        select f.workspace_id, f.ccy as currency, f.status, l.label, {SPEND}, sum(spend) as net, f.eff_{by} as k from fx f
        left join {by} l on l.id = f.eff_{by} and (l.workspace_id is null or l.workspace_id = f.workspace_id) where {IN_RANGE.replace("status", "f.status")} and spend <> 0 group by f.workspace_id, f.ccy, f.status, f.eff_{by}, l.label)) qualify rk <= 100"""


def series(grain: str) -> str:
    return f"select workspace_id, cast(cast(date_trunc('{grain}', local_date) as date) as varchar) as period_start, ccy as currency, status, {SPEND}, {CASH} from fx where {IN_RANGE} and (spend <> 0 or cash <> 0) group by 1, 2, 3, 4"


def change(label: bool) -> str:
    now = f"coalesce(sum(spend) filter (where local_date between date '{START}' and date '{END}'), 0)"
    then = f"coalesce(sum(spend) filter (where local_date between date '{THEN_START}' and date '{THEN_END}'), 0)"
    rows = f"select workspace_id, ccy as currency, status, {'eff_category as k, ' if label else ''}{now} as now_total, {then} as then_total from fx where status = 'POSTED' and local_date between date '{THEN_START}' and date '{END}' {'and spend <> 0' if label else ''} group by all"
    measures = f"{m('now_total')} as current_total, {m('then_total')} as comparison_total, {m('now_total - then_total')} as absolute_difference, {pct('now_total - then_total', 'then_total')} as percentage_difference"
    if not label:
        return f"select workspace_id, currency, status, {measures} from ({rows})"
    return f"""select x.workspace_id, currency, status, c.label, {measures} from ({rows}) x left join category c on c.id = x.k and (c.workspace_id is null or c.workspace_id = x.workspace_id)
      qualify row_number() over (partition by x.workspace_id order by abs(now_total - then_total) desc, currency, status, c.label nulls last) <= 100"""


UNRECONCILED = f"""select workspace_id, count(*) as affected_bill_count from recs r where rec_status <> 'RECONCILED' and (close_date between date '{START}' and date '{END}' or due_date between date '{START}' and date '{END}'
  or exists (select 1 from "transaction" t where t.workspace_id = r.workspace_id and t.bill_id = r.bill_id and t.local_date between date '{START}' and date '{END}')
  or exists (select 1 from bill_payment p where p.workspace_id = r.workspace_id and p.bill_id = r.bill_id and p.payment_date between date '{START}' and date '{END}')) group by 1"""

SPIKES = f"""
sp as (select c.workspace_id, c.local_date, c.ccy, c.spend, mm.label, (select cast(quantile_cont(cast(p.spend as double), 0.5) as decimal(20,6)) from rc p where p.workspace_id = c.workspace_id and p.eff_merchant = c.eff_merchant and p.ccy = c.ccy and (p.local_date < c.local_date or (p.local_date = c.local_date and p.id < c.id)) having count(*) >= 3) as med
  from rc c join merchant mm on mm.workspace_id = c.workspace_id and mm.id = c.eff_merchant and mm.review_status = 'CONFIRMED' where c.local_date >= {MONTH}),
n2 as (select 1 as pr, workspace_id, 'MERCHANT_AMOUNT_SPIKE' as rule, local_date as d, ccy, spend as o, med as b, {div("med * 3", "2")} as t2, {pct("spend - med", "med")} as dev, label as ml, cast(null as varchar) as cl from sp where med > 0 and spend * 2 > med * 3),
n3 as (select 2, c.workspace_id, 'DUPLICATE_LIKE_CHARGE', c.local_date, c.ccy, c.spend, c.spend, c.spend, '0.000000', mm.label, null
  from rc c left join merchant mm on mm.workspace_id = c.workspace_id and mm.id = c.eff_merchant
  where c.local_date >= {MONTH} and exists (select 1 from rc p where p.workspace_id = c.workspace_id and p.eff_merchant = c.eff_merchant and p.ccy = c.ccy and p.spend = c.spend and (p.local_date < c.local_date or (p.local_date = c.local_date and p.id < c.id)) and p.local_date >= c.local_date - 2)),
cc as (select workspace_id, eff_category, ccy, sum(spend) as o from rc where local_date >= {MONTH} and eff_category is not null group by 1, 2, 3),
tc as (select workspace_id, eff_category, ccy, sum(spend_amount) as p, count(*) as n from mon where month >= date '1998-05-01' and month < {MONTH} and eff_category is not null group by 1, 2, 3),
n4 as (select 3, cc.workspace_id, 'CATEGORY_SPEND_SPIKE', {TODAY}, cc.ccy, o, {div(f"p * {DAY}", str(3 * DAYS))}, {div(f"p * {DAY} * 3", str(2 * 3 * DAYS))}, {pct(f"o * {3 * DAYS} - p * {DAY}", f"(p * {DAY})")}, null, c.label
  from cc join tc on tc.workspace_id = cc.workspace_id and tc.eff_category = cc.eff_category and tc.ccy = cc.ccy join category c on c.id = cc.eff_category where n >= 2 and p > 0 and o * {2 * 3 * DAYS} > p * {3 * DAY}),
n5 as (select 4, s.workspace_id, 'NEW_RECURRING_MERCHANT', s.last_date, s.currency, s.amount_average, null, null, null, mm.label, c.label from recurring_series s join merchant mm on mm.workspace_id = s.workspace_id and mm.id = s.merchant_id left join category c on c.id = s.category_id
  where s.status = 'CANDIDATE' and cast(s.created_at as date) between {MONTH} and {TODAY}),
ls as (select workspace_id, eff_merchant, ccy, arg_max(spend, (local_date, id)) as spend, max(local_date) as d from rc group by 1, 2, 3),
n6 as (select 5, s.workspace_id, 'RECURRING_AMOUNT_INCREASE', ls.d, s.currency, ls.spend, s.amount_average, {div("s.amount_average * 11", "10")}, {pct("ls.spend - s.amount_average", "s.amount_average")}, mm.label, c.label
  from recurring_series s join ls on ls.workspace_id = s.workspace_id and ls.eff_merchant = s.merchant_id and ls.ccy = s.currency join merchant mm on mm.workspace_id = s.workspace_id and mm.id = s.merchant_id left join category c on c.id = s.category_id
  where s.status = 'CONFIRMED' and ls.d >= {MONTH} and s.amount_average > 0 and ls.spend * 10 > s.amount_average * 11),
allr as (select * from n2 union all select * from n3 union all select * from n4 union all select * from n5 union all select * from n6)
"""
ANOMALY_OUT = f"workspace_id, rule, cast(d as varchar) as observed_on, ccy as currency, {m('o')} as observed_value, {m('b')} as baseline_value, {m('t2')} as threshold_value, dev as deviation_percent, ml as merchant_label, cl as category_label"


def anomaly(which: str) -> str:
    keep = {"all": "true", **{f"n{k}": f"pr = {k - 1}" for k in range(2, 7)}}[which]
    return f"{SPIKES} select {ANOMALY_OUT} from allr where {keep} qualify row_number() over (partition by workspace_id order by pr, d desc, ml nulls last, cl nulls last, ccy, o) <= {100 if which == 'all' else 1000000000}"


RECURRING = f"""
ob as (select f.*, date_diff('day', lag(local_date) over (partition by f.workspace_id, eff_merchant, ccy order by local_date, f.id), local_date) as gap from fx f join merchant mm on mm.workspace_id = f.workspace_id and mm.id = f.eff_merchant and mm.review_status = 'CONFIRMED'
  where {COUNTABLE} and local_date >= {TODAY} - 730),
med as (select workspace_id, eff_merchant, ccy, quantile_cont(cast(gap as double), 0.5) as med from ob where gap is not null group by 1, 2, 3),
gr as (select o.workspace_id, o.eff_merchant, o.ccy, count(*) as n, case when count(distinct eff_category) = 1 then min(eff_category) end as cat, min(spend) as lo, max(spend) as hi, {div("sum(spend)", "count(*)")} as av, max(local_date) as last_d, any_value(med) as med, max(abs(gap - med)) as dev
  from ob o join med using (workspace_id, eff_merchant, ccy) group by 1, 2, 3 having count(*) >= 3),
cl as (select *, case when med between 6 and 8 and dev <= 3 then 'WEEKLY' when med between 26 and 35 and dev <= 6 then 'MONTHLY' when med between 80 and 100 and dev <= 12 then 'QUARTERLY' when med between 350 and 380 and dev <= 25 then 'ANNUAL' end as cadence,
  cast(hi - lo as double) / cast(av as double) as spread from gr where av > 0)
select workspace_id, eff_merchant as merchant_id, cat as category_id, cadence, cast(round_even(med, 0) as bigint) as expected_interval_days, ccy as currency, {m("lo")} as amount_min, {m("hi")} as amount_max, {m("av")} as amount_average,
  cast(last_d as varchar) as last_occurrence_date, cast(cast(last_d + cast(round_even(med, 0) as integer) as date) as varchar) as next_expected_date,
  cast(cast(round(least(0.99, greatest(0.5, 1 - spread - dev / greatest(med, 1) * 0.25)), 4) as decimal(5,4)) as varchar) as confidence
from cl where cadence is not null and spread <= 0.20 and not exists (select 1 from recurring_series s where s.workspace_id = cl.workspace_id and s.merchant_id = cl.eff_merchant and s.currency = cl.ccy and s.cadence = cl.cadence)"""

RECURRING_LIST = f"""
sn as (select workspace_id, eff_merchant, ccy, count(*) as n, arg_max(spend, (local_date, id)) as latest from fx where status = 'POSTED' and alive and eff_role = 'PURCHASE' and spend > 0 group by 1, 2, 3)
select s.workspace_id, s.id, s.cadence, s.currency, s.status, mm.label as merchant_label, coalesce(n, 0) as observation_count, {pct("latest - s.amount_average", "s.amount_average")} as price_change_percent
from recurring_series s join merchant mm on mm.workspace_id = s.workspace_id and mm.id = s.merchant_id left join sn on sn.workspace_id = s.workspace_id and sn.eff_merchant = s.merchant_id and sn.ccy = s.currency
where s.status in ('CANDIDATE', 'CONFIRMED') qualify row_number() over (partition by s.workspace_id order by case s.status when 'CONFIRMED' then 0 else 1 end, s.next_date nulls last, s.id) <= 100"""

FORECAST = f"""
f1 as (select workspace_id, ccy as currency, sum(spend) as a from fx where status = 'POSTED' and alive and not unconv and local_date between {MONTH} and {TODAY} group by 1, 2),
f2 as (select workspace_id, currency, sum(amount_average) as a from (select *, unnest(range(0, 40)) as k from recurring_series where status = 'CONFIRMED' and next_date > {TODAY} and next_date <= {MONTH_END}) where next_date + cast(k * interval_days as integer) <= {MONTH_END} group by 1, 2),
f3 as (select workspace_id, currency, sum(estimated_amount) as a from com where status = 'CONFIRMED' and remaining > 0 and estimated_amount is not null and purchase_date is not null
  and cast(date_trunc('month', purchase_date) + to_months(cast(highest_confirmed as integer)) as date) = {MONTH} group by 1, 2),
f4 as (select workspace_id, ccy as currency, {div("sum(spend_amount)", "3")} as a from mon where month >= date '1998-05-01' and month < {MONTH} group by 1, 2),
ks as (select workspace_id, currency from f1 union select workspace_id, currency from f2 union select workspace_id, currency from f3 union select workspace_id, currency from f4),
cp as (select ks.*, coalesce(f1.a, 0) as act, coalesce(f2.a, 0) as rcr, coalesce(f3.a, 0) as ins, coalesce(f4.a, 0) as avg3 from ks left join f1 using (workspace_id, currency) left join f2 using (workspace_id, currency) left join f3 using (workspace_id, currency) left join f4 using (workspace_id, currency))
select workspace_id, currency, cast({DAY} as bigint) as elapsed_days, cast({DAYS - DAY} as bigint) as remaining_days, {m("act")} as actual_month_to_date, {m(div(f"act * {DAYS - DAY}", str(DAY)))} as run_rate_remaining, {m(div(f"act * {DAYS}", str(DAY)))} as run_rate_forecast,
  {m("rcr")} as confirmed_recurring_remaining, {m("ins")} as confirmed_instalments_remaining, {m("rcr + ins")} as known_commitments_remaining, {m("act + rcr + ins")} as commitment_floor_forecast, {m(f"greatest({div(f'act * {DAYS}', str(DAY))}, act + rcr + ins)")} as forecast_total, {m("avg3")} as trailing_three_month_average from cp"""

QUALITY = """
el as (select workspace_id, case when eff_category is null then 'UNCLASSIFIED' when eff_source in ('USER', 'RULE', 'MERCHANT', 'HEURISTIC', 'PROVIDER', 'MODEL') then eff_source else 'UNATTRIBUTED' end as source from eff where deleted_at is null and status <> 'DELETED'),
tt as (select workspace_id, count(*) as n, count(*) filter (where source = 'UNCLASSIFIED') as u from el group by 1),
so as (select unnest(['USER', 'RULE', 'MERCHANT', 'HEURISTIC', 'PROVIDER', 'MODEL', 'UNATTRIBUTED', 'UNCLASSIFIED']) as source)
select tt.workspace_id, so.source, count(el.source) as count, cast(cast((2 * 1000000 * count(el.source) + n) // (2 * n) as decimal(18,0)) * cast(0.0001 as decimal(5,4)) as decimal(7,4)) :: varchar as percentage, n as total_count, n - u as classified_count, u as unclassified_count,
  cast(cast((2 * 1000000 * u + n) // (2 * n) as decimal(18,0)) * cast(0.0001 as decimal(5,4)) as decimal(7,4)) :: varchar as unclassified_percentage
from tt cross join so left join el on el.workspace_id = tt.workspace_id and el.source = so.source group by tt.workspace_id, so.source, n, u"""

BODIES: dict[str, tuple[str, str]] = {
    "v1_effective_transactions": (EFFECTIVE, f"select workspace_id, id, eff_category as effective_category, eff_merchant as effective_merchant, eff_role as effective_role, eff_source as effective_source, eff_excluded as effective_excluded, ccy as currency, {m('amt')} as amount, unconv as is_unconverted, review as review_status, ver as version from eff"),
    "v2_spend_effect": (EFFECTIVE, f"select workspace_id, id, ccy as currency, status, {m('spend')} as spend from fx"),
    "v3_cash_effect": (EFFECTIVE, f"select workspace_id, id, ccy as currency, status, account_type, {m('cash')} as cash from fx"),
    "v4_bill_reconciliation": (EFFECTIVE + BILLS, f"select workspace_id, bill_id, account_id, bill_status, cast(due_date as varchar) as due_date, cast(close_date as varchar) as close_date, currency, {m('total_amount')} as bill_total, {m('linked')} as linked_transaction_total, {m('paid')} as payment_total, {m('charged')} as finance_charge_total, {m('confirmed')} as confirmed_bank_payment_total, np_n as payment_count, nc_n as finance_charge_count, cb_n as confirmed_bank_payment_count, unconv_n as unconverted_transaction_count, open_items as unresolved_item_count, {m('tolerance_amount')} as tolerance_amount, {m('difference')} as difference_amount, rec_status as reconciliation_status from recs"),
    "v5_history_coverage": ("", "select workspace_id, id as account_id, account_type, currency, cast(earliest_date as varchar) as earliest_date, cast(latest_date as varchar) as latest_date, coverage_status, coverage_status in ('UNKNOWN', 'PARTIAL') as has_incomplete_history, initial_import_completed_at is not null as initial_import_completed from account where deleted_at is null"),
    "v6_needing_review": (EFFECTIVE, "select workspace_id, id, review as review_status, duplicate_status, eff_role as effective_role, eff_category as effective_category, unconv as is_unconverted from eff where deleted_at is null and status <> 'DELETED' and (review = 'NEEDS_REVIEW' or duplicate_status = 'POSSIBLE' or eff_role in ('UNKNOWN_CREDIT', 'UNKNOWN') or eff_category is null or unconv)"),
    "v8_monthly_by_category": (EFFECTIVE, monthly("category")),
    "v9_monthly_by_merchant": (EFFECTIVE, monthly("merchant")),
    "v10_instalment_commitments": (EFFECTIVE + COMMITMENTS, f"select workspace_id, id as series_id, currency, total_instalments, highest_confirmed, remaining as remaining_instalments, {m('estimated_amount')} as estimated_amount, status, n as posted_transaction_count, {m('a')} as posted_amount, u as unconverted_transaction_count, {m('remaining * estimated_amount')} as remaining_commitment from com"),
    "v11_freshness": (FRESH, "select workspace_id, account_id, connection_id, local_status as connection_status, cast(synced as varchar) as synced_at, age as age_seconds, stale as is_stale, attention as needs_attention from frs"),
    "v12_unclassified": (EFFECTIVE, "select workspace_id, id, account_id, eff_source as effective_source from eff where deleted_at is null and status <> 'DELETED' and eff_category is null"),
    "a2_totals": (EFFECTIVE, f"select workspace_id, ccy as currency, status, {SPEND}, {CASH} from fx where {IN_RANGE} group by 1, 2, 3"),
    "a3_category_breakdown": (EFFECTIVE, breakdown("category")),
    "a4_merchant_breakdown": (EFFECTIVE, breakdown("merchant")),
    "a5_series_day": (EFFECTIVE, series("day")),
    "a5_series_week": (EFFECTIVE, series("week")),
    "a5_series_month": (EFFECTIVE, series("month")),
    "a6_freshness_summary": (FRESH, "select workspace_id, cast(max(synced) as varchar) as last_successful_sync_at, cast(min(synced) as varchar) as oldest_account_sync_at, bool_or(stale) as is_stale, count(*) filter (where stale) as stale_count, count(*) filter (where attention) as attention_count from frs group by 1"),
    "a7_history_summary": ("", f"select workspace_id, count(*) as affected_account_count, cast(min(earliest_date) as varchar) as earliest_known_date, array_to_string(list_sort(list(distinct coverage_status)), ',') as coverage_statuses from account where deleted_at is null and (earliest_date is null or earliest_date > date '{START}') group by 1"),
    "a8_unconverted": (EFFECTIVE, f"select workspace_id, count(*) filter (where unconv) as unconverted_count from fx where {IN_RANGE} group by 1"),
    "a9_unreconciled_bills": (EFFECTIVE + BILLS, UNRECONCILED),
    "c2_compare_totals": (EFFECTIVE, change(False)),
    "c3_compare_categories": (EFFECTIVE, change(True)),
    "c4_unreconciled_bills": (EFFECTIVE + BILLS, f"select workspace_id, count(*) as affected_bill_count from recs where rec_status <> 'RECONCILED' and (close_date between date '{START}' and date '{END}' or due_date between date '{START}' and date '{END}') group by 1"),
    **{f"{k}": (EFFECTIVE + MONTHLY + RECENT, anomaly(k.split("_")[0])) for k in ("n2_amount_spikes", "n3_duplicate_like", "n4_category_spikes", "n5_new_recurring", "n6_recurring_increases")},
    "n7_anomalies": (EFFECTIVE + MONTHLY + RECENT, anomaly("all")),
    "m5_forecast": (EFFECTIVE + MONTHLY + COMMITMENTS, FORECAST),
    "i1_instalment_list": (EFFECTIVE + COMMITMENTS, f"select workspace_id, id as series_id, status, cast(case when remaining > 0 then cast(date_trunc('month', purchase_date) + to_months(cast(highest_confirmed as integer)) as date) end as varchar) as next_month, {m('remaining * estimated_amount')} as remaining_commitment from com where status in ('CONFIRMED', 'CANDIDATE', 'NEEDS_REVIEW') qualify row_number() over (partition by workspace_id order by case status when 'CONFIRMED' then 0 when 'CANDIDATE' then 1 else 2 end, purchase_date desc nulls last, id) <= 100"),
    "i2_instalment_months": (EFFECTIVE + COMMITMENTS, f"select workspace_id, cast(cast(date_trunc('month', purchase_date) + to_months(cast(k as integer)) as date) as varchar) as month, currency, {m('sum(estimated_amount)')} as estimated_amount, count(*) as instalment_count from (select *, unnest(range(highest_confirmed, total_instalments)) as k from com where status = 'CONFIRMED' and remaining > 0 and estimated_amount is not null and purchase_date is not null) group by 1, 2, 3"),
    "r1_detect_recurring": (EFFECTIVE, RECURRING),
    "r2_recurring_list": (EFFECTIVE, RECURRING_LIST),
    "r3_monthly_baseline": ("", f"select workspace_id, currency, {m('sum(x)')} as monthly_baseline from (select workspace_id, currency, case cadence when 'WEEKLY' then cast(amount_average * cast(4.348214 as decimal(8,6)) as decimal(24,8)) when 'MONTHLY' then cast(amount_average as decimal(24,8)) when 'QUARTERLY' then {div('amount_average', '3', 8)} when 'ANNUAL' then {div('amount_average', '12', 8)} else {div('cast(amount_average as decimal(14,6)) * cast(30.4375 as decimal(6,4))', 'interval_days', 8)} end as x from recurring_series where status = 'CONFIRMED') group by 1, 2"),
    "r10_bill_summary": (EFFECTIVE + BILLS, f"select r.workspace_id, r.bill_id, rec_status as reconciliation_status, {m('r.linked')} as linked_transaction_total, {m('r.difference')} as difference_amount, {m('coalesce(sum(f.spend) filter (where f.status = ' + chr(39) + 'POSTED' + chr(39) + '), 0)')} as posted_net_spending_total, {m('coalesce(sum(greatest(f.spend, 0)) filter (where f.status = ' + chr(39) + 'PENDING' + chr(39) + '), 0)')} as pending_purchase_total from recs r left join fx f on f.workspace_id = r.workspace_id and f.bill_id = r.bill_id and f.alive group by r.workspace_id, r.bill_id, rec_status, r.linked, r.difference"),
    "r11_payment_candidates": (EFFECTIVE, "select p.workspace_id, p.id as payment_id, e.id as transaction_id, 'CANDIDATE' as match_status, 'AMOUNT_DATE_ROLE_V1' as match_method, case when abs(e.amt) = p.amount and e.local_date = p.payment_date then '1.0000' else '0.9500' end as confidence from bill_payment p join tolerance tl on tl.currency = p.currency join eff e on e.workspace_id = p.workspace_id and e.status = 'POSTED' and e.alive and e.direction = 'OUTFLOW' and e.eff_role = 'CARD_BILL_PAYMENT' and e.ccy = p.currency and e.amt is not null and abs(abs(e.amt) - p.amount) <= tl.tolerance_amount and abs(date_diff('day', e.local_date, p.payment_date)) <= 2 and (e.bill_id is null or e.bill_id = p.bill_id) join account a on a.workspace_id = e.workspace_id and a.id = e.account_id and a.account_type in ('CHECKING', 'SAVINGS') and a.deleted_at is null where not exists (select 1 from reconciliation r where r.workspace_id = p.workspace_id and r.match_status in ('AUTO_MATCHED', 'USER_CONFIRMED') and (r.payment_id = p.id or r.transaction_id = e.id))"),
    "q1_source_report": (EFFECTIVE, QUALITY),
    "q2_unclassified_queue": (EFFECTIVE, "select workspace_id, id, cast(local_date as varchar) as local_date, count(*) over (partition by workspace_id) > 50 as has_next from eff where deleted_at is null and status <> 'DELETED' and eff_category is null qualify row_number() over (partition by workspace_id order by local_date desc, id desc) <= 50"),
}


def statement(head: str, body: str) -> str:
    """Bodies that go on with more named parts begin with one; others are the last SELECT."""
    text = cte() + head + body.strip()
    return text if not body.strip().lower().startswith("select") else (cte() + head).rstrip().rstrip(",") + "\n" + body


ORACLE_SQL = {name: statement(*parts) for name, parts in BODIES.items()}
