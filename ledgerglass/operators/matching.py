"""Detectors on pairs of transactions: own transfers, refunds, replacements. All pairs meet on keys, never crosswise.

Facts: workspace_id, id, account_id, account_type, direction, currency, amount (signed), local_date, text (normal form), merchant_id.
One deterministic pass: a match needs to be the only one on both sides; whatever is one of several is to be reviewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import DEPOSITS
from ..functions.text import REFUND_WORDS, TRANSFER_WORDS, has_word, word_similarity

TRANSFER_DAYS, REFUND_DAYS, REPLACEMENT_DAYS, LEAST_REFERENCE, AUTO = 2, 120, 3, 3, "0.9500"
#: What a date distance of 0, 1, 2, 3 days adds to a replacement's score (fixed values).
DATE_SCORES = ("0.2", "0.175", "0.15", "0.125")
#: Facts of which two known, different values rule a replacement out, in the order in which they are told.
OPTIONAL = ("instalment_number", "instalment_total", "bill_forecast_month", "provider_bill_id", "card_last_four", "payee_mcc")


def side(facts: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return facts.select(*[F.col(c).alias(c if c in keep else f"{prefix}_{c}") for c in facts.columns])


def bill_payment_role(account_type: Column, direction: Column, card_evidence: Column, bank_evidence: Column) -> Column:
    """The evidence that makes a transaction a bill payment, or null."""
    return F.when((account_type == "CREDIT_CARD") & card_evidence.isNotNull(), card_evidence).when(account_type.isin(*DEPOSITS) & (direction == "OUTFLOW") & bank_evidence.isNotNull(), bank_evidence)


def status_of(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """AUTO_CONFIRMED where a pair is alone on both sides, else NEEDS_REVIEW."""
    alone = (F.count("*").over(Window.partitionBy("workspace_id", left)) == 1) & (F.count("*").over(Window.partitionBy("workspace_id", right)) == 1)
    return pairs.withColumn("status", F.when(alone, "AUTO_CONFIRMED").otherwise("NEEDS_REVIEW"))


def buckets(amount: Column, tolerance: Column) -> Column:
    """Amounts within the tolerance share a bucket or lie in neighbouring ones."""
    return F.floor(F.abs(amount) / F.greatest(tolerance, F.lit(0.000001).cast("decimal(20,6)"))).cast("bigint")


def transfers(facts: DataFrame, tolerance: DataFrame) -> DataFrame:
    """An outflow and an inflow of two deposit accounts, both called a transfer, two days and the currency's tolerance apart at most.

    The outflow stands on each day and in each amount bucket it may meet, so the join is on equal keys.
    """
    t = facts.where(F.col("account_type").isin(*DEPOSITS) & has_word(F.col("text"), TRANSFER_WORDS)).join(tolerance, "currency")
    t = t.withColumn("bucket", buckets(F.col("amount"), F.col("tolerance_amount")))
    keep = ("workspace_id", "currency")
    out = side(t.where(F.col("direction") == "OUTFLOW"), "out", keep).withColumn("day", F.explode(F.sequence(F.date_sub("out_local_date", TRANSFER_DAYS), F.date_add("out_local_date", TRANSFER_DAYS))))
    out = out.withColumn("bucket", F.explode(F.sequence(F.col("out_bucket") - 1, F.col("out_bucket") + 1)))
    into = side(t.where(F.col("direction") == "INFLOW"), "in", keep).withColumns({"day": F.col("in_local_date"), "bucket": F.col("in_bucket")})
    near = F.abs(F.abs("out_amount") - F.abs("in_amount")) <= F.col("out_tolerance_amount")
    pairs = out.join(into, [*keep, "day", "bucket"]).where((F.col("out_account_id") != F.col("in_account_id")) & near)
    days = F.abs(F.datediff("out_local_date", "in_local_date"))
    return status_of(pairs.select("workspace_id", "currency", F.col("out_id").alias("outflow_id"), F.col("in_id").alias("inflow_id"), days.alias("date_distance_days")), "outflow_id", "inflow_id")


def refunds(facts: DataFrame, tolerance: DataFrame) -> DataFrame:
    """An inflow called a refund and a purchase of the account, up to 120 days before, of the same merchant or text and of no smaller amount within the tolerance.

    Time is cut into spans of 120 days; a refund stands in its own and the one before, so it never meets older purchases.
    """
    span = lambda c: F.floor(F.unix_date(c) / REFUND_DAYS).cast("bigint")
    t = facts.join(tolerance, "currency").withColumn("bucket", buckets(F.col("amount"), F.col("tolerance_amount")))
    keep = ("workspace_id", "account_id", "currency")
    back = side(t.where((F.col("direction") == "INFLOW") & has_word(F.col("text"), REFUND_WORDS)), "refund", keep).withColumn("bucket", F.explode(F.sequence(F.col("refund_bucket"), F.col("refund_bucket") + 1)))
    back = back.withColumn("span", F.explode(F.array(span(F.col("refund_local_date")), span(F.col("refund_local_date")) - 1)))
    reference = F.array_join(F.filter(F.split("refund_text", " "), lambda w: ~w.isin("", *REFUND_WORDS)), " ")
    back = back.withColumn("reference", reference)
    bought = side(t.where(F.col("direction") == "OUTFLOW"), "buy", keep).withColumns({"bucket": F.col("buy_bucket"), "span": span(F.col("buy_local_date"))})
    same = F.coalesce(F.col("refund_merchant_id") == F.col("buy_merchant_id"), F.lit(False)) | ((F.length("reference") >= LEAST_REFERENCE) & (F.col("reference") == F.col("buy_text")))
    difference = F.abs("buy_amount") - F.abs("refund_amount")
    pairs = back.join(bought, [*keep, "bucket", "span"]).where(F.datediff("refund_local_date", "buy_local_date").between(0, REFUND_DAYS) & (difference >= 0) & (difference <= F.col("refund_tolerance_amount")) & same)
    days = F.datediff("refund_local_date", "buy_local_date")
    one = F.count("*").over(Window.partitionBy("workspace_id", "refund_id")) == 1
    return pairs.select("workspace_id", "account_id", "currency", "refund_id", F.col("buy_id").alias("purchase_id"), days.alias("date_distance_days")).withColumn("status", F.when(one, "AUTO_CONFIRMED").otherwise("NEEDS_REVIEW"))


def replacement_score(days: Column, left_text: Column, right_text: Column, left_type: Column, right_type: Column, conflict: Column) -> Column:
    """0 to 1 at four places; 0 if a known fact differs."""
    dates = F.coalesce(*[F.when(days == k, F.lit(float(x))) for k, x in enumerate(DATE_SCORES)], F.lit(0.0))
    alike = F.when(left_text == right_text, 1.0).otherwise(word_similarity(left_text, right_text))
    kind = F.when(left_type.isNull() | right_type.isNull() | (left_type == right_type), 0.05).otherwise(0.0)
    score = F.least(F.lit(1.0), F.lit(0.4) + dates + alike * 0.25 + kind + 0.1)
    return F.when(conflict.isNotNull(), F.lit(0.0)).otherwise(F.round(score, 4)).cast("decimal(5,4)")


def conflict_of(optional: tuple[str, ...]) -> Column:
    """The first fact of which both sides know different values."""
    return F.coalesce(*[F.when(F.col(f"old_{c}") != F.col(f"new_{c}"), F.lit(c)) for c in optional], F.lit(None).cast("string"))


def replacements(gone: DataFrame, new: DataFrame) -> DataFrame:
    """Deleted transactions and new ones of the same account, currency and amount, three days apart at most, scored.

    AUTO_CONFIRMED: a score of 0.95, alone on both sides, and nothing of the user's on the new one (column has_user_data, if there).
    """
    keep = ("workspace_id", "account_id", "currency", "amount")
    optional = tuple(c for c in OPTIONAL if c in gone.columns and c in new.columns)
    old = side(gone, "old", keep).withColumn("day", F.explode(F.sequence(F.date_sub("old_local_date", REPLACEMENT_DAYS), F.date_add("old_local_date", REPLACEMENT_DAYS))))
    pairs = old.join(side(new, "new", keep).withColumn("day", F.col("new_local_date")), [*keep, "day"]).where(F.col("old_id") != F.col("new_id"))
    days = F.abs(F.datediff("old_local_date", "new_local_date"))
    kind = lambda p: F.col(f"{p}_provider_type") if "provider_type" in gone.columns else F.lit(None).cast("string")
    scored = pairs.select(*keep, F.col("old_id").alias("predecessor_id"), F.col("new_id").alias("successor_id"), days.alias("date_distance_days"), replacement_score(days, F.col("old_text"), F.col("new_text"), kind("old"), kind("new"), conflict_of(optional)).alias("score"), (F.col("new_has_user_data") if "has_user_data" in new.columns else F.lit(False)).alias("touched"))
    found = status_of(scored.where("score > 0"), "predecessor_id", "successor_id")
    sure = (F.col("status") == "AUTO_CONFIRMED") & (F.col("score") >= F.lit(AUTO).cast("decimal(5,4)")) & ~F.col("touched")
    return found.withColumn("status", F.when(sure, "AUTO_CONFIRMED").otherwise("NEEDS_REVIEW")).drop("touched")


def keep_settled(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Links of a new detection beside stored ones: what was confirmed or rejected stays as it is."""
    key = ["workspace_id", "predecessor_id", "successor_id"]
    settled = stored.where(F.col("status").isin("AUTO_CONFIRMED", "USER_CONFIRMED", "REJECTED"))
    rest = found.join(settled, key, "left_anti").select(*key, "status", "score")
    gone = stored.join(settled, key, "left_anti").join(found, key, "left_anti")
    return settled.select(*rest.columns).unionByName(rest).unionByName(gone.select(*rest.columns))


def replacements_in(runs: DataFrame, transactions: DataFrame, user_data: DataFrame) -> DataFrame:
    """Replacements within each successful sync: deleted in its time against created in its time, of the run's connection.

    transactions: facts with connection_id, status, deleted_at, created_at; user_data: workspace_id, id of what has a state or tags.
    """
    window = runs.where("status = 'SUCCEEDED' and finished_at is not null").select("workspace_id", "run_id", "connection_id", "started_at", "finished_at")
    here = transactions.join(window, ["workspace_id", "connection_id"])
    gone = here.where((F.col("status") == "DELETED") & F.col("deleted_at").between(F.col("started_at"), F.col("finished_at")))
    new = here.where((F.col("status") != "DELETED") & F.col("created_at").between(F.col("started_at"), F.col("finished_at")))
    touched = user_data.select("workspace_id", "id").distinct().withColumn("has_user_data", F.lit(True))
    new = new.join(touched, ["workspace_id", "id"], "left").na.fill(False, ["has_user_data"])
    drop = ["status", "deleted_at", "created_at", "started_at", "finished_at", "connection_id"]
    return replacements(gone.drop(*drop), new.drop(*drop))


def detect_roles(facts: DataFrame, tolerance: DataFrame, bill_evidence: DataFrame) -> DataFrame:
    """workspace_id, id, role, status, evidence: a bill payment if evidence says so, else a sure transfer, else a sure refund.

    Several pieces of bill evidence are to be reviewed. What has a role of a rule or of the user (column is_settled, if
    there) is not judged again.
    """
    if "is_settled" in facts.columns:
        bill_evidence = bill_evidence.join(facts.where("is_settled").select("workspace_id", "id"), ["workspace_id", "id"], "left_anti")
        facts = facts.where(~F.col("is_settled")).drop("is_settled")
    several = F.when(F.countDistinct("evidence") == 1, "AUTO_CONFIRMED").otherwise("NEEDS_REVIEW")
    paid = bill_evidence.groupBy("workspace_id", "id").agg(several.alias("status"), F.min(F.col("evidence").cast("string")).alias("evidence"))
    paid = paid.select("workspace_id", "id", F.lit("CARD_BILL_PAYMENT").alias("role"), "status", "evidence", F.lit(1).alias("rank"))
    moved = transfers(facts, tolerance)
    both = moved.select("workspace_id", F.inline(F.array(F.struct(F.col("outflow_id").alias("id"), F.col("inflow_id").alias("other")), F.struct(F.col("inflow_id").alias("id"), F.col("outflow_id").alias("other")))), "status")
    moved = both.select("workspace_id", "id", F.lit("TRANSFER").alias("role"), "status", F.col("other").cast("string").alias("evidence"), F.lit(2).alias("rank"))
    back = refunds(facts, tolerance).select("workspace_id", F.col("refund_id").alias("id"), F.lit("REFUND").alias("role"), "status", F.col("purchase_id").cast("string").alias("evidence"), F.lit(3).alias("rank"))
    every = paid.unionByName(moved).unionByName(back)
    first = F.min(F.struct("rank", "role", "status", "evidence")).alias("x")
    return every.groupBy("workspace_id", "id").agg(first).select("workspace_id", "id", "x.role", "x.status", "x.evidence")


#: Characters of the pieces on which texts and patterns meet.
PIECE = 3


def resolve_merchants(rows: DataFrame, aliases: DataFrame, merchants: DataFrame, similarity: Column, least: str = "0.5000", top: int = 5) -> DataFrame:
    """workspace_id, id, merchant_id, method, review (candidate ids) for rows of (workspace_id, id, text, identity_hash).

    The ladder: exact alias, exact key, identity hash, the one merchant whose prefix or contained patterns of confidence
    0.95 match, else a provisional merchant with up to `top` fuzzy candidates. aliases: workspace_id, merchant_id, alias,
    match_type, confidence; merchants: workspace_id, merchant_id, key, identity_hash. similarity: of columns text and key.

    Patterns meet a text on the pattern's first PIECE characters, which stand somewhere in any text that contains it, inside
    words too; shorter patterns meet on their whole. Fuzzy candidates meet on a shared pair of characters or word, without
    which no similarity is above 0.
    """
    def hashed(df: DataFrame) -> DataFrame:
        return df if "identity_hash" in df.columns else df.withColumn("identity_hash", F.lit(None).cast("string"))

    rows, merchants, columns = hashed(rows), hashed(merchants), rows.columns
    a = aliases.groupBy("workspace_id", F.col("alias").alias("text")).agg(F.min("merchant_id").alias("by_alias"))
    k = merchants.groupBy("workspace_id", F.col("key").alias("text")).agg(F.min("merchant_id").alias("by_key"))
    h = merchants.where("identity_hash is not null").groupBy("workspace_id", "identity_hash").agg(F.min("merchant_id").alias("by_hash"))
    asked = rows.select("workspace_id", "text", "identity_hash").distinct()
    exact = asked.join(a, ["workspace_id", "text"], "left").join(k, ["workspace_id", "text"], "left").join(h, ["workspace_id", "identity_hash"], "left")
    open_ = exact.where("by_alias is null and by_key is null and by_hash is null").select("workspace_id", "text").distinct()

    def short(text: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda k: F.substring(text, k, n))

    patterns = aliases.where(F.col("match_type").isin("PREFIX", "CONTAINS") & (F.col("confidence") >= 0.95) & (F.length("alias") > 0))
    patterns = patterns.select("workspace_id", "merchant_id", "alias", "match_type", F.substring("alias", 1, PIECE).alias("piece"))
    grams = open_.select("workspace_id", "text", F.explode(F.array_distinct(F.concat(*[short(F.col("text"), F.lit(n)) for n in range(1, PIECE + 1)]))).alias("piece"))
    hit = grams.join(patterns, ["workspace_id", "piece"]).where(F.when(F.col("match_type") == "PREFIX", F.startswith("text", "alias")).otherwise(F.contains("text", "alias")))
    unique = hit.groupBy("workspace_id", "text").agg(F.countDistinct("merchant_id").alias("n"), F.min("merchant_id").alias("by_pattern")).where("n = 1").drop("n")

    def marks(text: Column) -> Column:  # words are marked, as a pair of characters may be a word
        return F.array_distinct(F.concat(short(text, F.lit(2)), F.transform(F.split(text, " "), lambda w: F.concat(F.lit(" "), w))))

    left = open_.join(unique, ["workspace_id", "text"], "left_anti")
    keys = merchants.select("workspace_id", "merchant_id", "key", F.explode(marks(F.col("key"))).alias("mark"))
    pairs = left.select("workspace_id", "text", F.explode(marks(F.col("text"))).alias("mark")).join(keys, ["workspace_id", "mark"])
    pairs = pairs.select("workspace_id", "text", "merchant_id", "key").distinct().withColumn("score", similarity).where(F.col("score") >= F.lit(least).cast("decimal(5,4)"))
    order = Window.partitionBy("workspace_id", "text").orderBy(F.col("score").desc(), "merchant_id")
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    fuzzy = best.groupBy("workspace_id", "text").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "merchant_id"))), lambda x: x["merchant_id"]).alias("review"))
    known = exact.join(unique, ["workspace_id", "text"], "left").join(fuzzy, ["workspace_id", "text"], "left")
    method = F.when(F.col("by_alias").isNotNull(), "EXACT_ALIAS").when(F.col("by_key").isNotNull(), "EXACT_KEY").when(F.col("by_hash").isNotNull(), "PROVIDER_IDENTITY").when(F.col("by_pattern").isNotNull(), "PATTERN_ALIAS").otherwise("PROVISIONAL")
    known = known.select(F.col("workspace_id").alias("of"), F.col("text").alias("asked"), F.col("identity_hash").alias("asked_hash"), F.coalesce("by_alias", "by_key", "by_hash", "by_pattern").alias("merchant_id"), method.alias("method"), "review")
    same = (F.col("workspace_id") == F.col("of")) & (F.col("text") == F.col("asked")) & F.col("identity_hash").eqNullSafe(F.col("asked_hash"))
    return rows.join(known, same).select(*columns, "merchant_id", "method", "review")
