"""The inbox of provider events and the job queue, as batch transformations that a stream runs in foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.upsert import insert_missing

LEASE_SECONDS, LONGEST_LEASE, LONGEST_BACKOFF = 120, 900, 300


def first_deliveries(events: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Of a stream or a table, each event once; a stream forgets ids after `late`."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def jobs_of(events: DataFrame, active: DataFrame) -> DataFrame:
    """A job for every new event whose dedupe key has no active job (columns job_type, dedupe_key)."""
    kind = F.when(F.startswith("event_type", F.lit("transactions/")), "TRANSACTION_EVENT").otherwise("CONNECTION_EVENT")
    wanted = events.select("workspace_id", kind.alias("job_type"), F.concat_ws(":", kind, "workspace_id", "event_id").alias("dedupe_key"))
    return insert_missing(active.where(F.col("status").isin("PENDING", "RUNNING", "RETRY")), wanted, ["dedupe_key"])


def claimable(jobs: DataFrame, now: Column, most: int | None = None) -> DataFrame:
    """Jobs ready to run, by priority, age and id."""
    ready = jobs.where(F.col("status").isin("PENDING", "RETRY") & (F.col("available_at") <= now) & (F.col("attempts") < F.col("max_attempts")))
    ready = ready.orderBy(F.col("priority").desc(), "created_at", "id")
    return ready if most is None else ready.limit(most)


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(LONGEST_BACKOFF), F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0)))).cast("int")


def extend_lease(expires: Column, now: Column, seconds: int = LEASE_SECONDS) -> Column:
    """A heartbeat never shortens a lease."""
    if not 1 <= seconds <= LONGEST_LEASE:
        raise ValueError("a lease lasts 1 to 900 s")
    return F.greatest(expires, now + F.make_dt_interval(secs=F.lit(seconds)))


def finish(jobs: DataFrame, outcome: DataFrame, now: Column) -> DataFrame:
    """Running jobs after their outcomes (id, succeeded): done, to be tried again, or dead after the last attempt."""
    joined = jobs.join(outcome.select("id", "succeeded"), "id", "left")
    ran = F.col("succeeded").isNotNull() & (F.col("status") == "RUNNING")
    status = F.when(ran & F.col("succeeded"), "SUCCEEDED").when(ran & (F.col("attempts") >= F.col("max_attempts")), "DEAD").when(ran, "RETRY").otherwise(F.col("status"))
    again = F.when(ran & ~F.col("succeeded"), now + F.make_dt_interval(secs=backoff_seconds(F.col("attempts")))).otherwise(F.col("available_at"))
    return joined.withColumns({"status": status, "available_at": again}).drop("succeeded")


def reclaim(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease has ended go back to the queue, or die after the last attempt."""
    lost = (F.col("status") == "RUNNING") & (F.col("lease_expires_at") < now)
    return jobs.withColumns({
        "status": F.when(lost & (F.col("attempts") >= F.col("max_attempts")), "DEAD").when(lost, "RETRY").otherwise(F.col("status")),
        "available_at": F.when(lost, now + F.make_dt_interval(secs=backoff_seconds(F.col("attempts")))).otherwise(F.col("available_at")),
        "lease_expires_at": F.when(lost, F.lit(None)).otherwise(F.col("lease_expires_at")),
    })


def retry_dead(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    dead = F.coalesce("__hit", F.lit(False)) & (F.col("status") == "DEAD")
    joined = jobs.join(hit, "id", "left")
    return joined.withColumns({"status": F.when(dead, "PENDING").otherwise(F.col("status")), "attempts": F.when(dead, 0).otherwise(F.col("attempts")), "available_at": F.when(dead, now).otherwise(F.col("available_at"))}).drop("__hit")


#: Events after which a connection is synchronising again, and those that only tell its state (fixed values).
BEGINS = ("item/created", "item/updated", "item/login_succeeded")
ENDED = ("PROCESSED", "IGNORED", "UNMAPPED")


def routes(events: DataFrame, connections: DataFrame) -> DataFrame:
    """What is to be done for each open event: columns of events, connection_id, connection_status, route, is_full_import.

    events: workspace_id, event_id, external_id, event, status, snapshot_status (what the provider says now; null: gone).
    Nothing is done for events that ended, unknown connections, or what was disabled or deleted here, but a deletion is marked.
    """
    of = connections.select("workspace_id", "external_id", F.col("id").alias("connection_id"), F.col("local_status").alias("connection_status"))
    rows = events.join(of, ["workspace_id", "external_id"], "left")
    lost = F.col("connection_status").isin("DISABLED", "DELETED")
    item = F.when(F.col("event") == "item/deleted", "MARK_DELETED").when(lost, "NONE").when(F.col("snapshot_status").isNull(), "MARK_DELETED")
    item = item.when(F.col("event").isin(*BEGINS), "SYNC").otherwise("APPLY_STATUS")
    kind = {"transactions/created": "IMPORT_CREATED", "transactions/updated": "IMPORT_IDS", "transactions/deleted": "DELETE_IDS"}
    data = F.when(lost, "NONE")
    for event, route in kind.items():
        data = data.when(F.col("event") == event, route)
    known = F.when(F.startswith("event", F.lit("transactions/")), data).otherwise(item)
    route = F.when(F.col("status").isin(*ENDED), "NONE").when(F.col("connection_id").isNull(), "UNMAPPED").otherwise(known)
    full = route.isin("SYNC", "APPLY_STATUS") & (F.col("snapshot_status") == "ACTIVE")
    return rows.withColumns({"route": route, "is_full_import": F.coalesce(full, F.lit(False))})


def route_batch(batch: DataFrame, connections: DataFrame, handlers: dict[str, Callable[[DataFrame], None]]) -> None:
    """For foreachBatch: the rows of each route go to its handler; handlers must bear a batch that comes again."""
    found = routes(batch, connections)
    for route, handle in handlers.items():
        handle(found.where(F.col("route") == route))


def reconcile(connections: DataFrame, snapshots: DataFrame, at: Column) -> DataFrame:
    """Outcome of a scheduled reconciliation for every connection: columns of connections after it, outcome, asks_refresh.

    snapshots: workspace_id, external_id, first_status (before the refresh; null: gone), settled_status (after the polls). A
    connection that needs its user is told so and not refreshed; whole imports are made where the settled state is active.
    """
    rows = connections.join(snapshots, ["workspace_id", "external_id"], "left")
    off = F.col("local_status").isin("DISABLED", "DELETED")
    needs = ("REAUTH_REQUIRED", "USER_ACTION_REQUIRED", "USER_INPUT_REQUIRED")
    asks = ~off & F.coalesce(F.col("first_status").isin("ACTIVE", "PROVIDER_ERROR"), F.lit(False))
    ended = F.when(F.col("first_status").isin("DELETED", *needs), F.col("first_status")).otherwise(F.col("settled_status"))
    ended = F.when(F.col("first_status").isNull(), F.lit(None)).otherwise(ended)
    outcome = F.when(off, "SKIPPED").when(ended.isNull() | (ended == "DELETED"), "DELETED").when(ended.isin(*needs), "ACTION_REQUIRED")
    outcome = outcome.when(ended == "ACTIVE", "RECONCILED").otherwise("UNSETTLED")
    rows = rows.withColumns({"outcome": outcome, "asks_refresh": asks, "ended": ended})
    alive = F.col("outcome") != "SKIPPED"
    done = {
        "local_status": F.when(alive, F.coalesce("ended", F.lit("DELETED"))).otherwise(F.col("local_status")),
        "last_attempt_at": F.when(alive, at).otherwise(F.col("last_attempt_at")),
        "last_successful_sync_at": F.when(F.col("outcome") == "RECONCILED", at).otherwise(F.col("last_successful_sync_at")),
        "deleted_at": F.when(F.col("outcome") == "DELETED", F.coalesce("deleted_at", at)).otherwise(F.col("deleted_at")),
    }
    return rows.withColumns({k: v for k, v in done.items() if k in connections.columns}).select(*connections.columns, "outcome", "asks_refresh")


def run(spark: SparkSession, source: DataFrame, sink: str, keys: list[str], checkpoint: str, handle: Callable[[DataFrame], DataFrame] = lambda df: df):
    """A query that appends each event once to a Parquet inbox; batches that come again after a failure add nothing."""

    def each(batch: DataFrame, _: int) -> None:
        try:
            there = batch.sparkSession.read.parquet(sink)
        except Exception as e:  # noqa: BLE001  the first batch makes the table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            there = batch.limit(0)
        insert_missing(there, handle(batch), keys).write.mode("append").parquet(sink)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(events: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last event of every key."""
    order = Window.partitionBy(*key).orderBy(F.col(at).desc(), F.col("event_id").desc())
    return events.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
