"""How transactions are classified, and the queue of those that are not."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ledger import Ledger
from .effects import effective, live, unclassified

#: Sources in report order (fixed values).
SOURCES = ("USER", "RULE", "MERCHANT", "HEURISTIC", "PROVIDER", "MODEL", "UNATTRIBUTED", "UNCLASSIFIED")


def source_report(led: Ledger) -> DataFrame:
    """Every source of every workspace, also those without a row, in one pass over the transactions."""
    bucket = F.when(F.col("effective_category").isNull(), "UNCLASSIFIED").when(F.col("effective_source").isin(*SOURCES[:6]), F.col("effective_source")).otherwise("UNATTRIBUTED")
    counted = live(effective(led)).select("workspace_id", bucket.alias("source")).groupBy("workspace_id").agg(F.count("*").alias("total_count"), *[F.count_if(F.col("source") == s).alias(s) for s in SOURCES])

    def percent(n):
        return F.round(n.cast("decimal(18,0)") * 100 / F.col("total_count"), 4).cast("decimal(7,4)")

    each = counted.select("workspace_id", "total_count", F.col("UNCLASSIFIED").alias("unclassified_count"), F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("count")) for s in SOURCES])))
    return each.select("workspace_id", "source", "count", percent(F.col("count")).alias("percentage"), "total_count", (F.col("total_count") - F.col("unclassified_count")).alias("classified_count"), "unclassified_count", percent(F.col("unclassified_count")).alias("unclassified_percentage"))


def queue(led: Ledger, size: int = 50, after: tuple[date, int] | None = None) -> DataFrame:
    """A page of each workspace's unclassified transactions, newest first; `after` is the last row of the page before. One row more than `size` tells that there is a next page."""
    rows = unclassified(led)
    if after is not None:
        rows = rows.where(F.struct("local_date", "id") < F.struct(F.lit(after[0]).alias("local_date"), F.lit(after[1]).cast("bigint").alias("id")))
    order = Window.partitionBy("workspace_id").orderBy(F.col("local_date").desc(), F.col("id").desc())
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size + 1)
    return ranked.withColumn("has_next", F.max("rank").over(Window.partitionBy("workspace_id")) > size).where(F.col("rank") <= size)
