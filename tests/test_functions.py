from datetime import UTC, date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerglass.functions import policy, text
from ledgerglass.functions.dates import Period, bank_date, comparison, local_date, shift_months
from ledgerglass.functions.money import Money, decimal_text
from ledgerglass.functions.rules import Rule, RuleError, evaluate
from ledgerglass.operators import matching, upsert
from ledgerglass.operators.transactions import cursor, place
from ledgerglass.sources import provider
from ledgerglass.streaming import inbox


def test_money():
    assert Money("1.10", "BRL") + Money("2.2", "BRL") == Money("3.3", "BRL")
    with pytest.raises(ValueError):
        Money("1", "BRL") + Money("1", "USD")
    assert [decimal_text(x) for x in ("007.500000", "-0.0", "12")] == ["7.5", "0", "12"]
    with pytest.raises(ValueError):
        decimal_text("1.1234567")


def test_dates():
    assert shift_months(date(2026, 1, 31), 1) == date(2026, 2, 28) and bank_date("2024-02-29") == date(2024, 2, 29)
    for bad in ("2026-02-30", "2026-1-01", "20260101"):
        with pytest.raises(ValueError):
            bank_date(bad)
    at = datetime(2026, 8, 24, 2, 59, 59, tzinfo=UTC)
    assert (local_date(at), local_date(at, "Asia/Tokyo")) == (date(2026, 8, 23), date(2026, 8, 24))
    now, then = comparison(Period(date(2026, 3, 1), date(2026, 3, 31)), "PREVIOUS_MONTH", same_days=True)
    assert (now.days, then) == (28, Period(date(2026, 2, 1), date(2026, 2, 28)))
    assert comparison(Period(date(2026, 8, 10), date(2026, 8, 19)), "PREVIOUS_PERIOD")[1] == Period(date(2026, 7, 31), date(2026, 8, 9))


@pytest.mark.parametrize(
    ("original", "normalized", "store", "plan"),
    [
        ("MP *STBKS BRASIL 00392", "stbks brasil", "00392", None),
        ("ＣＡＦÉ SÃO\nPAULO", "café são paulo", None, None),
        ("H&M + Café-D'Avó", "h&m + café-d'avó", None, None),
        ("LOJA EXEMPLO PARC 02/10 NSU: A1B2C3", "loja exemplo", None, (2, 10)),
        ("LOJA EXEMPLO PARC 10/02", "loja exemplo parc 10 02", None, None),
        ("MP Serviços", "mp serviços", None, None),
        ("Canal 1000", "canal 1000", None, None),
        ("Mercado Central #0042", "mercado central", "0042", None),
        ("東京・市場", "東京 市場", None, None),
    ],
)
def test_descriptions(spark, original, normalized, store, plan):
    form = text.normal_form(F.col("t"))
    r = spark.createDataFrame([(original,)], "t string").select(*[c.alias(k) for k, c in form.items()]).first()
    assert (r["normalized"], r["store_code"]) == (normalized, store)
    assert ((r["instalment_number"], r["instalment_total"]) if r["instalment_number"] else None) == plan
    assert r["references"] == ({"NSU": "A1B2C3"} if "NSU" in original else {})


def test_similarity_and_masks(spark):
    df = spark.createDataFrame([("loja sol", "loja sol"), ("loja sol", "loja lua"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(text.similarity(F.col("a"), F.col("b"))).collect()] == [Decimal("1.0000"), Decimal("0.5714"), Decimal("0.0000")]
    masks = spark.createDataFrame([("card 4111 1111 1111 1234",), ("on 2024-01-15 at 1234",), ("id 12345",)], "t string").select(text.masked(F.col("t"))).collect()
    assert [m[0] for m in masks] == ["card ••••1234", "on 2024-01-15 at 1234", "id ••••2345"]


def test_policy(spark):
    df = spark.createDataFrame([("CREDIT_CARD", Decimal("-5"), None), ("CHECKING", Decimal("5"), "CREDIT"), ("OTHER", Decimal("5"), "DEBIT")], "k string, a decimal(20,6), p string")
    d = policy.direction_of(F.col("k"), F.col("a"), F.col("p"))
    got = df.select(d.alias("d"), policy.role_of(F.col("k"), F.col("a"), d, {"income": F.lit(True)}).alias("r")).collect()
    assert [tuple(r) for r in got] == [("INFLOW", "UNKNOWN_CREDIT"), ("INFLOW", "INCOME"), ("UNKNOWN", "UNKNOWN")]
    s = spark.createDataFrame([(None, "UPDATED", "SUCCESS", None), (None, "UPDATED", None, None), ("item/deleted", None, None, None), (None, "UPDATED", "SUCCESS", "INVALID_CREDENTIALS")], "e string, i string, x string, c string")
    assert [r[0] for r in s.select(policy.sync_status(F.col("e"), F.col("i"), F.col("x"), F.col("c"))).collect()] == ["ACTIVE", "PROVIDER_ERROR", "DELETED", "REAUTH_REQUIRED"]


def test_rules(spark):
    text_is = lambda v: {"field": "transaction.descriptionNormalized", "operator": "contains", "value": v}
    rules = [Rule("b", text_is("loja"), [{"type": "SET_CATEGORY", "value": 2}]), Rule("a", text_is("sol"), [{"type": "SET_CATEGORY", "value": 1}], priority=9), Rule("z", {"field": "merchant.id", "operator": "neq", "value": 5}, [{"type": "ADD_TAG", "value": "t"}], priority=-1)]
    rows = spark.createDataFrame([(1, "loja sol", None), (2, "loja", 4)], "id long, t string, m long")
    got = {r["id"]: r for r in evaluate(rows, rules, {"transaction.descriptionNormalized": F.col("t"), "merchant.id": F.col("m")}).collect()}
    assert got[1]["set_category"] == "1" and got[1]["conflicts"][0]["rule"] == "b" and got[1]["tags_added"] == []
    assert got[2]["set_category"] == "2" and got[2]["tags_added"] == ["t"]
    for bad in ("(a+)+", "(?=x)", "a**", "(", r"(a)\1"):
        with pytest.raises(RuleError):
            Rule("x", {"field": "transaction.descriptionNormalized", "operator": "regex_safe", "value": bad}, [{"type": "STOP_PROCESSING"}])


def test_merchants(spark):
    rows = spark.createDataFrame([(1, 1, "loja sol"), (1, 2, "padaria"), (1, 3, "uber trip 9"), (1, 4, "loja solar"), (1, 5, "nada")], "workspace_id long, id long, text string")
    aliases = spark.createDataFrame([(1, 10, "loja sol", "EXACT", Decimal("1")), (1, 12, "uber", "PREFIX", Decimal("0.97"))], "workspace_id long, merchant_id long, alias string, match_type string, confidence decimal(5,4)")
    keys = spark.createDataFrame([(1, 11, "padaria"), (1, 10, "loja sol")], "workspace_id long, merchant_id long, key string")
    got = {r["id"]: (r["merchant_id"], r["method"], r["review"]) for r in matching.resolve_merchants(rows, aliases, keys, text.similarity(F.col("text"), F.col("key"))).collect()}
    assert got == {1: (10, "EXACT_ALIAS", None), 2: (11, "EXACT_KEY", None), 3: (12, "PATTERN_ALIAS", None), 4: (None, "PROVISIONAL", [10]), 5: (None, "PROVISIONAL", None)}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "id long, v string")
    assert sorted(upsert.merge(old, new, ["id"]).collect()) == [(1, "a"), (2, "c"), (3, None)]
    assert [tuple(r["changes"][0]) for r in upsert.revisions(old, new, ["id"], ["v"]).collect()] == [("v", "b", "c")]
    assert [r["id"] for r in upsert.insert_missing(old, new.union(new), ["id"]).collect()] == [3]


def test_provider(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"id":"1","accountId":"a","amount":12.345678,"currencyCode":"USD","amountInAccountCurrency":6.7890123e1,"date":"2026-08-24T02:59:59.000Z","creditCardMetadata":{"installmentNumber":2,"totalInstallments":10,"cardNumber":"**** 1234"}}\n{"id":"2","accountId":"a","amount":0.000001}\n')
    got = provider.transactions(provider.read(spark, str(tmp_path / "t.json"), provider.TRANSACTION)).orderBy("provider_transaction_id").collect()
    assert (got[0]["provider_amount"], got[0]["account_amount"], got[0]["instalment_total"], got[0]["card_last_four"], got[0]["local_date"]) == (Decimal("12.345678"), Decimal("67.890123"), 10, "1234", date(2026, 8, 23))
    assert (got[1]["provider_amount"], got[1]["status"], got[1]["provider_type"]) == (Decimal("0.000001"), "UNKNOWN", None)
    (tmp_path / "p.json").write_text('{"results":[{"id":"x","payments":[{"id":"p","amount":1.5}],"financeCharges":[]}],"next":null}\n')
    bills = provider.pages(spark, str(tmp_path / "p.json"), provider.BILL)
    assert provider.bill_payments(bills).first()["amount"] == Decimal("1.5")


def test_inbox_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "e1"), (1, "e1"), (1, "e2")], "workspace_id long, event_id string")
    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):  # the second run delivers the same events again
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        inbox.run(spark, stream, str(tmp_path / "out"), ["workspace_id", "event_id"], str(tmp_path / f"ck{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_cursor():
    mark = cursor({"from": "2026-01-01"}, (date(2026, 1, 5), 7))
    assert place(mark, {"from": "2026-01-01"}) == (date(2026, 1, 5), 7)
    with pytest.raises(ValueError):
        place(mark, {"from": "2026-01-02"})


def test_corrections_and_hand_over(spark):
    from ledgerglass.operators import classification

    state = spark.createDataFrame([(1, 10, True, 3, 2), (1, 11, False, None, 1)], "workspace_id long, transaction_id long, category_override boolean, category_value long, version long")
    patches = spark.createDataFrame([(1, 10, 2, "INHERIT", None), (1, 11, 9, "SET", 4), (1, 12, 0, "SET", 5)], "workspace_id long, transaction_id long, expected_version long, category_mode string, category_value long")
    fixed, late = classification.correct(state, patches)
    assert sorted(tuple(r)[1:] for r in fixed.collect()) == [(10, False, None, 3), (11, False, None, 1), (12, True, 5, 1)]
    assert [r["transaction_id"] for r in late.collect()] == [11]
    links = spark.createDataFrame([(1, 10, 20), (1, 10, 11)], "workspace_id long, predecessor_id long, successor_id long")
    moved, conflict, _ = classification.hand_over(state, links)
    assert sorted(r["transaction_id"] for r in moved.collect()) == [10, 11, 20] and conflict.count() == 1
    cats = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent_id long")
    assert classification.would_cycle(cats, 1, 3) and not classification.would_cycle(cats, 3, 1)
