"""Sources, imports and reviews on small tables: bounds, idempotence, and what raises."""

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerglass.operators import classification, commitments, imports, lists, validate
from ledgerglass.plans import writes
from ledgerglass.sources import provider
from ledgerglass.streaming import inbox

AT = datetime(2026, 1, 2)
STORED = "workspace_id long, provider_id string, account_id long, status string, local_date date, amount decimal(20,6), description string, provider_bill_id string, bill_id long, direction string, role string, role_source string, duplicate_status string, deleted_at timestamp"
PAGE = "workspace_id long, provider_id string, account_id long, status string, local_date date, amount decimal(20,6), description string, provider_type string, provider_bill_id string, fee_type string, position int"


def test_cursors_and_hints():
    assert provider.page_query("a") == {"accountId": "a"}
    assert provider.page_query("a", "?accountId=a&after=x") == {"accountId": "a", "after": "x"}
    for cursor in ("accountId=a", "?accountId=b", "?accountId=a&accountId=a", "?accountId=a&limit=1", "?after=x"):
        with pytest.raises(ValueError):
            provider.page_query("a", cursor)
    assert provider.ids_cursor("a", ["x", "y"]) == "?accountId=a&ids=x%2Cy"
    for ids in ([], ["x", "x"], [str(k) for k in range(501)]):
        with pytest.raises(ValueError):
            provider.ids_cursor("a", ids)
    link = "https://p.example/v2/transactions?accountId=a&createdAtFrom=2026-01-01&after=q"
    assert provider.created_cursor("a", "2026-01-01", link, "https://p.example", True) == "?accountId=a&createdAtFrom=2026-01-01&after=q"
    assert provider.created_cursor("a", "2026-01-01", link.replace("after=q", "after={x}"), "https://p.example", True) == "?accountId=a&createdAtFrom=2026-01-01"
    for other in (link.replace("p.example", "q.example"), link.replace("accountId=a", "accountId=b"), link.replace("/v2/", "/v3/")):
        with pytest.raises(ValueError):
            provider.created_cursor("a", "2026-01-01", other, "https://p.example", True)


def test_retries():
    assert provider.retry_wait("PATCH", 503, 0) is None and provider.retry_wait("GET", 404, 0) is None and provider.retry_wait("GET", 503, 3) is None
    assert provider.retry_wait("GET", 429, 0, "2") == 2000 and provider.retry_wait("GET", 429, 0, "9999") == provider.MOST_WAIT
    assert provider.retry_wait("GET", 500, 2) == 4 * provider.LEAST_WAIT and provider.retry_wait("HEAD", 500, 1, "soon") == 2 * provider.LEAST_WAIT
    assert provider.retry_wait("GET", 503, 0, "Thu, 01 Jan 1970 00:00:10 GMT", now=4.0) == 6000
    assert provider.refresh_request("a/b") == {"method": "PATCH", "path": "/items/a%2Fb", "body": {}, "retries": 0}


def test_landed_source(spark, tmp_path):
    files = {
        "items": [{"id": "i", "status": "UPDATED", "executionStatus": "SUCCESS", "connector": {"id": 1, "name": "Bank"}}, {"id": "j", "status": "LOGIN_ERROR"}],
        "accounts": [{"id": "a", "itemId": "i", "type": "BANK", "subtype": "CHECKING_ACCOUNT", "balance": 1.5e2, "currencyCode": "BRL"}, {"id": "b", "itemId": "j", "type": "CREDIT"}],
        "transactions": [{"results": [{"id": "t", "accountId": "a", "amount": 1e-6, "date": "2026-01-01T01:00:00Z"}, {"id": "u", "accountId": "b"}], "next": None}],
        "bills": [{"id": "x", "dueDate": "2026-01-01", "totalAmount": 5, "payments": [{"id": "p", "amount": 2.5}], "financeCharges": [{"id": "c", "type": "IOF", "amount": 1}]}],
    }
    for name, rows in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(map(json.dumps, rows)))
    source = provider.Landed(spark, str(tmp_path))
    assert {r["connection_id"]: r["local_status"] for r in source.connections().collect()} == {"i": "ACTIVE", "j": "REAUTH_REQUIRED"}
    assert source.connection("i").count() == 1 and source.connection("z").count() == 0
    (account,) = source.accounts("i").collect()
    assert str(account["current_balance"]) == "150.000000" and source.accounts().count() == 2
    (t,) = source.transactions("a").collect()
    assert str(t["provider_amount"]) == "0.000001" and t["local_date"] == date(2025, 12, 31)
    assert [df.count() for df in source.bills()] == [1, 1, 1]


def test_import_twice_changes_nothing(spark):
    accounts = spark.createDataFrame([(1, 7, "CHECKING", None, None)], "workspace_id long, id long, account_type string, earliest_date date, latest_date date")
    bills = spark.createDataFrame([], "workspace_id long, account_id long, id long")
    day = date(2026, 1, 1)
    page = spark.createDataFrame([(1, "a", 7, "POSTED", day, None, "x", "DEBIT", None, None, 1), (1, "b", 7, "DELETED", day, None, "y", "CREDIT", None, None, 1), (1, "b", 7, "POSTED", day, None, "y", None, None, None, 0)], PAGE)
    nothing = spark.createDataFrame([], STORED)
    first = imports.import_transactions(nothing, page, accounts, bills, F.lit(AT))
    assert first.counts.first().asDict() == {"workspace_id": 1, "account_id": 7, "seen": 2, "inserted": 2, "updated": 0, "deleted": 1}
    stored = spark.createDataFrame(first.transactions.select(*nothing.columns).collect(), STORED)
    again = imports.import_transactions(stored, page, accounts, bills, F.lit(datetime(2026, 2, 2)))
    assert sorted(map(str, again.transactions.select(*nothing.columns).collect())) == sorted(map(str, stored.collect()))
    assert not again.revisions.count() and again.counts.first()["updated"] == 0
    back = imports.import_transactions(stored, page.withColumn("status", F.lit("POSTED")), accounts, bills, F.lit(AT))
    (b,) = back.transactions.where("provider_id = 'b'").collect()
    assert b["deleted_at"] is None and [r["change_type"] for r in back.revisions.collect()] == ["PROVIDER_UPDATE"]
    assert back.history.first()["earliest_date"] == day
    empty = imports.import_transactions(nothing, page.limit(0), accounts, bills, F.lit(AT))
    assert not empty.transactions.count() and not empty.counts.count()


def test_bills_of_two_accounts_may_share_an_id(spark, monkeypatch):
    day, schema = date(2026, 1, 1), "workspace_id long, id long, account_id long, status string, currency string, due_date date, total_amount decimal(20,6)"
    stored = spark.createDataFrame([(1, 5, 7, "OPEN", "BRL", day, Decimal(3))], schema)
    landed = spark.createDataFrame([(1, 5, 7, "CLOSED", "BRL", day, Decimal(4)), (1, 5, 8, "OPEN", "USD", day, Decimal(9))], schema)
    monkeypatch.setattr(writes, "frames", lambda *_: [stored, landed])
    found = writes.snk3_bills(spark, "").collect()
    assert sorted((r["id"], r["account_id"], r["status"], r["total_amount"]) for r in found) == [(5, 7, "CLOSED", "4.000000"), (5, 8, "OPEN", "9.000000")]


def test_bounds(spark):
    for ids in ([], ["a", "a"], [str(k) for k in range(1001)]):
        with pytest.raises(ValueError):
            imports.check_ids(ids)
    assert imports.check_ids(["a"]) == ["a"]
    rows = spark.range(5)
    assert commitments.bounded(rows, 5, "rows").count() == 5
    with pytest.raises(ValueError):
        commitments.bounded(rows, 4, "rows")
    with pytest.raises(ValueError):
        lists.first(rows, [F.col("id")], 501)
    broken = spark.createDataFrame([("X", 1, 2)], "rule string, workspace_id long, id long")
    validate.sound(broken.limit(0))
    with pytest.raises(ValueError, match="X is broken by 2"):
        validate.sound(broken)


def test_hand_over_refuses_what_is_taken(spark):
    state = spark.createDataFrame([(1, 10, "a", 4), (1, 21, "b", 1)], "workspace_id long, transaction_id long, notes string, version long")
    tags = spark.createDataFrame([(1, 10, "x"), (1, 31, "y")], "workspace_id long, transaction_id long, tag string")
    links = spark.createDataFrame([(1, 10, 11), (1, 20, 21), (1, 30, 31)], "workspace_id long, predecessor_id long, successor_id long")
    after, conflict, moved = classification.hand_over(state, links, tags)
    assert sorted(tuple(r)[1:] for r in after.collect()) == [(10, "a", 4), (11, "a", 1), (21, "b", 1)]
    assert sorted(r["successor_id"] for r in conflict.collect()) == [21, 31]
    assert sorted(tuple(r)[1:] for r in moved.collect()) == [(10, "x"), (11, "x"), (31, "y")]
    again, _, same = classification.hand_over(after, links, moved, links.where("predecessor_id = 10"))
    assert again.count() == 3 and same.count() == 3


def test_routed_batches(spark):
    connections = spark.createDataFrame([(1, 5, "c", "ACTIVE")], "workspace_id long, id long, external_id string, local_status string")
    events = spark.createDataFrame([(1, 1, "c", "item/updated", "RECEIVED", "ACTIVE"), (1, 2, "c", "transactions/deleted", "RECEIVED", "ACTIVE"), (1, 3, "z", "item/updated", "RECEIVED", "ACTIVE")], "workspace_id long, event_id long, external_id string, event string, status string, snapshot_status string")
    seen = {}
    inbox.route_batch(events, connections, {r: (lambda df, r=r: seen.update({r: [x["event_id"] for x in df.collect()]})) for r in ("SYNC", "DELETE_IDS", "UNMAPPED", "NONE")})
    assert seen == {"SYNC": [1], "DELETE_IDS": [2], "UNMAPPED": [3], "NONE": []}


def test_a_stream_forgets_nothing_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    frame = spark.createDataFrame([(1, "a", AT), (1, "a", AT), (2, "b", AT)], "id long, kind string, at timestamp")
    frame.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = inbox.first_deliveries(stream, ["id"], "at").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("firsts").count() == 2
