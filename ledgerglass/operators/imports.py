"""Imports of landed provider rows: whole next versions of the tables, and what changed. Running one again changes nothing.

A delivery may bring a key more than once (the last position holds), bring deleted rows back, or miss rows (they stay).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy
from .upsert import fingerprint, latest, merge, revisions

KEY = ["workspace_id", "provider_id"]
#: Fields of a transaction that a provider may change; a difference in any of them is a revision.
COMPARED = ("status", "local_date", "amount", "description", "provider_bill_id", "bill_id", "direction", "role", "deleted_at")
#: Sources of a role that an import may overwrite.
OPEN_SOURCES = ("NONE", "HEURISTIC")
MOST_IDS, FULL_HISTORY_MONTHS = 1000, 12


@dataclass(frozen=True)
class Imported:
    transactions: DataFrame
    revisions: DataFrame
    history: DataFrame
    counts: DataFrame


def classified(page: DataFrame, accounts: DataFrame, bills: DataFrame, at: Column) -> DataFrame:
    """The page's rows with direction, role, the bill they belong to, and when they were deleted."""
    kinds = accounts.select("workspace_id", F.col("id").alias("account_id"), "account_type")
    links = bills.select("workspace_id", "account_id", F.col("id").cast("string").alias("provider_bill_id"), F.col("id").alias("bill_id"))
    rows = latest(page, KEY, [F.col("position").desc()]).join(kinds, ["workspace_id", "account_id"])
    rows = rows.join(links, ["workspace_id", "account_id", "provider_bill_id"], "left")
    direction = policy.direction_of(F.col("account_type"), F.col("amount"), F.col("provider_type"))
    role = policy.role_of(F.col("account_type"), F.col("amount"), direction, {"charge": F.col("fee_type").isNotNull()})
    return rows.withColumns({"direction": direction, "role": role, "gone_at": F.when(F.col("status") == "DELETED", at)})


def import_transactions(stored: DataFrame, page: DataFrame, accounts: DataFrame, bills: DataFrame, at: Column) -> Imported:
    """stored: KEY, account_id, COMPARED, role_source, duplicate_status. One full join, one window over equal facts.

    A role that a rule or a user gave stays. A new transaction with the account, amount, text and date of another one
    makes both possible duplicates, unless something else was decided on them. A row that comes back is no longer deleted.
    """
    new = classified(page, accounts, bills, at)
    fields = ("account_id", *COMPARED)
    old = stored.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in (*fields, "role_source", "duplicate_status")], F.lit(True).alias("was"))
    inner = [c for c in fields if c != "deleted_at"]
    both = old.join(new.select(*KEY, *inner, "gone_at", F.lit(True).alias("came")), KEY, "full")
    was, came = F.col("was").isNotNull(), F.col("came").isNotNull()
    fixed = was & ~F.col("old_role_source").isin(*OPEN_SOURCES)
    value = {c: F.when(came, F.col(c)).otherwise(F.col(f"old_{c}")) for c in inner}
    value["role"] = F.when(came & ~fixed, F.col("role")).otherwise(F.col("old_role"))
    value["deleted_at"] = F.when(came, F.when(F.col("gone_at").isNotNull(), F.coalesce("old_deleted_at", "gone_at"))).otherwise(F.col("old_deleted_at"))
    value["role_source"] = F.when(came & ~fixed, "HEURISTIC").otherwise(F.col("old_role_source"))
    value["duplicate_status"] = F.coalesce("old_duplicate_status", F.lit("NONE"))
    rows = both.select(*KEY, *[v.alias(c) for c, v in value.items()], *[f"old_{c}" for c in COMPARED], was.alias("was"), came.alias("came"))
    alike = Window.partitionBy("workspace_id", "account_id", "amount", "description", "local_date")
    crowd = (F.count("*").over(alike) > 1) & F.max(~F.col("was")).over(alike)
    rows = rows.withColumn("duplicate_status", F.when(crowd & (F.col("duplicate_status") == "NONE"), "POSSIBLE").otherwise(F.col("duplicate_status")))
    differs = [~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in COMPARED]
    change = [F.when(d, F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").cast("string").alias("before"), F.col(c).cast("string").alias("after"))) for c, d in zip(COMPARED, differs, strict=True)]
    dies = (F.col("status") == "DELETED") & (F.col("old_status") != "DELETED")
    changed = rows.where("was and came").withColumn("changes", F.array_compact(F.array(*change))).where(F.size("changes") > 0)
    changed = changed.select(*KEY, F.when(dies, "DELETE").otherwise("PROVIDER_UPDATE").alias("change_type"), "changes")
    any_change = F.greatest(*differs)
    counts = rows.where("came").groupBy("workspace_id", "account_id").agg(
        F.count("*").alias("seen"),
        F.count_if(~F.col("was")).alias("inserted"),
        F.count_if(F.col("was") & any_change & ~dies).alias("updated"),
        F.count_if((F.col("was") & dies) | (~F.col("was") & (F.col("status") == "DELETED"))).alias("deleted"),
    )
    span = new.groupBy("workspace_id", F.col("account_id").alias("id")).agg(F.min("local_date").alias("first"), F.max("local_date").alias("last"))
    history = accounts.join(span, ["workspace_id", "id"]).select(
        "workspace_id", F.col("id").alias("account_id"), F.least("earliest_date", "first").alias("earliest_date"), F.greatest("latest_date", "last").alias("latest_date")
    )
    return Imported(rows.select(*KEY, *value), changed, history, counts)


def import_children(stored: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Bills, payments or charges after an import, and the revisions of those that differ."""
    incoming = incoming.dropDuplicates(keys)
    return merge(stored.select(*keys, *fields), incoming.select(*keys, *fields), keys), revisions(stored, incoming, keys, fields)


def link_bills(transactions: DataFrame, bills: DataFrame) -> DataFrame:
    """Transactions that name a bill of their account and have none yet belong to it from now on."""
    known = bills.select("workspace_id", "account_id", F.col("id").cast("string").alias("provider_bill_id"), F.col("id").alias("found_bill"))
    joined = transactions.join(known, ["workspace_id", "account_id", "provider_bill_id"], "left")
    return joined.withColumn("bill_id", F.coalesce("bill_id", "found_bill")).select(*transactions.columns)


def assign_connections(stored: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """Connections after a discovery: what was disabled or deleted here stays so, whatever the provider says."""
    keeps = F.col("old.local_status").isin("DISABLED", "DELETED")
    found = found.withColumn("deleted_at", F.when(F.col("local_status") == "DELETED", at))
    return merge(stored, found.select(*stored.columns), ["workspace_id", "external_id"], {"local_status": F.when(keeps, F.col("old.local_status")).otherwise(F.col("new.local_status"))})


def new_snapshots(stored: DataFrame, incoming: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Raw rows whose content differs from the latest snapshot of their key (stored: keys, payload_hash, observed_at)."""
    last = stored.groupBy(*keys).agg(F.max_by("payload_hash", "observed_at").alias("last_hash"))
    hashed = incoming.withColumn("payload_hash", fingerprint(*[F.col(c) for c in sorted(payload)]))
    return hashed.join(last, keys, "left").where(~F.col("payload_hash").eqNullSafe(F.col("last_hash"))).drop("last_hash")


def check_ids(ids: list[str]) -> list[str]:
    """A deletion names 1 to 1000 different ids."""
    if not 1 <= len(ids) <= MOST_IDS or len(set(ids)) < len(ids):
        raise ValueError("a deletion names 1 to 1000 different transactions")
    return ids


def delete_transactions(stored: DataFrame, ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Transactions after a provider's deletions (workspace_id, account_id, provider_id), and their revisions; a second one changes nothing."""
    hit = ids.select("workspace_id", "account_id", "provider_id").distinct().withColumn("named", F.lit(True))
    rows = stored.join(hit, ["workspace_id", "account_id", "provider_id"], "left").withColumn("dies", F.coalesce("named", F.lit(False)) & (F.col("status") != "DELETED"))
    next_ = rows.withColumns({"status": F.when(F.col("dies"), "DELETED").otherwise(F.col("status")), "deleted_at": F.when(F.col("dies"), at).otherwise(F.col("deleted_at"))})
    told = rows.where("dies").select(*KEY, F.lit("DELETE").alias("change_type"), F.col("status").alias("before"))
    return next_.select(*stored.columns), told


def complete_accounts(accounts: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """Accounts whose import is whole: a year of history is the provider's maximum, less is partial, what a user extended stays."""
    hit = done.select("workspace_id", F.col("account_id").alias("id")).distinct().withColumn("done", F.lit(True))
    rows = accounts.join(hit, ["workspace_id", "id"], "left")
    is_done, extended = F.coalesce("done", F.lit(False)), F.col("coverage_status") == "USER_EXTENDED_HISTORY"
    full = F.coalesce(F.col("earliest_date") <= F.add_months("latest_date", -FULL_HISTORY_MONTHS), F.lit(False))
    status = F.when(full, "PROVIDER_MAXIMUM_RETRIEVED").otherwise("PARTIAL")
    return rows.withColumns({
        "coverage_status": F.when(is_done & ~extended, status).otherwise(F.col("coverage_status")),
        "initial_import_completed_at": F.when(is_done, F.coalesce("initial_import_completed_at", at)).otherwise(F.col("initial_import_completed_at")),
        "last_successful_sync_at": F.when(is_done, at).otherwise(F.col("last_successful_sync_at")),
    }).select(*accounts.columns)


def close_runs(runs: DataFrame, outcome: DataFrame, at: Column) -> DataFrame:
    """Running syncs after their outcome (run_id, succeeded): succeeded without a cursor, or failed with a reason; others stay."""
    rows = runs.join(outcome.select("run_id", "succeeded"), "run_id", "left")
    ends = F.col("succeeded").isNotNull() & (F.col("status") == "RUNNING")
    return rows.withColumns({
        "status": F.when(ends, F.when(F.col("succeeded"), "SUCCEEDED").otherwise("FAILED")).otherwise(F.col("status")),
        "cursor": F.when(ends & F.col("succeeded"), F.lit(None)).otherwise(F.col("cursor")),
        "error_summary": F.when(ends & ~F.col("succeeded"), "TRANSACTION_IMPORT_FAILED").otherwise(F.col("error_summary")),
        "finished_at": F.when(ends, at).otherwise(F.col("finished_at")),
    }).select(*runs.columns)
