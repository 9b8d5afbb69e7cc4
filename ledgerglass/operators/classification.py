"""What classification writes: decisions of rules, corrections by the user, merged merchants, category trees."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import Rule, compile_condition, evaluate
from .upsert import fingerprint, insert_missing

PREVIEW, PREVIEW_DAYS, DEPTH = 500, 366, 32


def decisions(rows: DataFrame, rules: list[Rule], facts: dict[str, Column], made: DataFrame) -> DataFrame:
    """New decisions (workspace_id, transaction_id, rule, fingerprint): one for each matched rule and state of the facts; what was decided before is not again."""
    found = evaluate(rows, rules, facts).withColumn("fingerprint", fingerprint(*[facts[k] for k in sorted(facts)]))
    each = found.select("workspace_id", F.col("id").alias("transaction_id"), F.explode("matched_rules").alias("rule"), "fingerprint")
    return insert_missing(made, each, ["workspace_id", "transaction_id", "rule", "fingerprint"])


def preview(rows: DataFrame, rule: Rule, facts: dict[str, Column], until: date, days: int = PREVIEW_DAYS, top: int = PREVIEW) -> DataFrame:
    """Each workspace's newest matching transactions of the range; writes nothing."""
    if not 1 <= days <= PREVIEW_DAYS:
        raise ValueError("a preview covers 1 to 366 days")
    hit = rows.where(F.col("local_date").between(F.lit(until - timedelta(days=days - 1)), F.lit(until)) & compile_condition(rule.condition, facts))
    order = Window.partitionBy("workspace_id").orderBy(F.col("local_date").desc(), F.col("id").desc())
    ranked = hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top + 1)
    return ranked.withColumn("is_truncated", F.max("rank").over(Window.partitionBy("workspace_id")) > top).where(F.col("rank") <= top)


def ancestors(categories: DataFrame) -> DataFrame:
    """id, ancestor, depth of every category (columns id, parent_id), by recursion; a cycle shows as an id that is its own ancestor."""
    return categories.sparkSession.sql(
        f"""with recursive up(id, ancestor, depth) as (
              select id, parent_id, 1 from {{cats}} where parent_id is not null
              union all select up.id, c.parent_id, up.depth + 1 from up join {{cats}} c on c.id = up.ancestor where c.parent_id is not null and up.depth < {DEPTH} and up.ancestor <> up.id)
            select id, ancestor, depth from up""",
        cats=categories.select("id", "parent_id"),
    )


def would_cycle(categories: DataFrame, category: int, parent: int) -> bool:
    """Whether a new parent is the category itself or one below it."""
    return category == parent or bool(ancestors(categories).where((F.col("id") == parent) & (F.col("ancestor") == category)).limit(1).count())


def checked_categories(categories: DataFrame, changes: DataFrame, rules: DataFrame) -> DataFrame:
    """id, error (null: the change holds) of category changes (id, parent_id, is_active).

    A parent must not be the category or one below it, and a category that an active rule sets must stay active.
    """
    below = ancestors(categories).select(F.col("id").alias("parent_id"), F.col("ancestor").alias("id"), F.lit(True).alias("cycles"))
    set_by = rules.where("is_active").select(F.explode(F.filter("actions", lambda a: a["type"] == "SET_CATEGORY")).alias("a")).select(F.col("a.value").cast("bigint").alias("id")).distinct().withColumn("in_use", F.lit(True))
    rows = changes.join(below.distinct(), ["id", "parent_id"], "left").join(set_by, "id", "left")
    error = F.when(F.col("parent_id") == F.col("id"), "OWN_PARENT").when(F.col("cycles"), "CYCLE").when(~F.col("is_active") & F.coalesce("in_use", F.lit(False)), "IN_USE")
    return rows.select("id", error.alias("error"))


def apply_rules(rows: DataFrame, rules: list[Rule], facts: dict[str, Column], made: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transactions after the rules, their new decisions, and how often each rule newly hit.

    What the rules set (category, merchant, role, exclusion) has source RULE; the fingerprint leaves out merchant and role, as a
    rule's own result must not make its next run look new. Decisions that were made before are not made or counted again.
    """
    found = evaluate(rows, rules, facts)
    stable = [facts[k] for k in sorted(facts) if k not in ("merchant.id", "merchant.normalizedKey", "transaction.systemFinancialRole")]
    found = found.withColumn("fingerprint", fingerprint(*stable))
    each = found.select("workspace_id", F.col("id").alias("transaction_id"), F.explode("matched_rules").alias("rule"), "fingerprint")
    new = insert_missing(made, each, ["workspace_id", "transaction_id", "rule", "fingerprint"])
    hits = new.groupBy("workspace_id", "rule").agg(F.count("*").alias("new_hits"))
    kind = {"category_id": ("set_category", "bigint"), "merchant_id": ("set_merchant", "bigint"), "role": ("set_financial_role", "string")}
    changed = {c: F.coalesce(F.col(name).cast(t), F.col(c)) for c, (name, t) in kind.items() if c in rows.columns and name in found.columns}
    if "category_source" in rows.columns:
        changed["category_source"] = F.when(F.col("set_category").isNotNull(), "RULE").otherwise(F.col("category_source"))
    if "is_excluded" in rows.columns and "set_spend_inclusion" in found.columns:
        changed["is_excluded"] = F.when(F.col("set_spend_inclusion").isNotNull(), F.col("set_spend_inclusion") == "EXCLUDE").otherwise(F.col("is_excluded"))
    return found.withColumns(changed).select(*rows.columns, "tags_added", "tags_removed"), new, hits


def change_tags(tags: DataFrame, applied: DataFrame) -> DataFrame:
    """Tags (workspace_id, transaction_id, tag) after rules: added ones once, removed ones not."""
    key = ["workspace_id", "transaction_id", "tag"]
    named = applied.withColumnRenamed("id", "transaction_id")
    add = named.select(*key[:2], F.explode("tags_added").alias("tag"))
    gone = named.select(*key[:2], F.explode("tags_removed").alias("tag"))
    return tags.select(*key).unionByName(add).distinct().join(gone, key, "left_anti")


def rule_states(rules: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """Rules after requests (id, action: CONFIRM or DEACTIVATE): only a suggestion is confirmed, and a second request changes nothing."""
    rows = rules.join(requests.groupBy("id").agg(F.max("action").alias("action")), "id", "left")
    on = (F.col("action") == "CONFIRM") & (F.col("source") == "SYSTEM_SUGGESTION") & ~F.col("is_active")
    off = (F.col("action") == "DEACTIVATE") & F.col("is_active")
    changed = F.coalesce(on | off, F.lit(False))
    return rows.withColumns({"is_active": F.when(changed, on).otherwise(F.col("is_active")), "updated_at": F.when(changed, at).otherwise(F.col("updated_at"))}).select(*rules.columns)


def new_rules(rules: DataFrame, wanted: DataFrame, at: Column) -> DataFrame:
    """Rules with new ones (workspace_id, id, name, source ...): a suggestion starts inactive, all others active."""
    fresh = wanted.withColumns({"is_active": F.col("source") != "SYSTEM_SUGGESTION", "created_at": at, "updated_at": at})
    return rules.unionByName(insert_missing(rules, fresh.select(*rules.columns), ["id"]))


def confirm_aliases(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Aliases after confirmations (workspace_id, merchant_id, alias, match_type): the one active owner of a text is the last confirmed merchant."""
    key = ["workspace_id", "alias", "match_type"]
    owner = wanted.groupBy(*key).agg(F.max("merchant_id").alias("owner"))
    rows = aliases.join(owner, key, "left")
    kept = rows.withColumns({
        "is_active": F.when(F.col("owner").isNotNull(), F.col("merchant_id") == F.col("owner")).otherwise(F.col("is_active")),
        "confidence": F.when(F.col("merchant_id") == F.col("owner"), F.lit(1).cast("decimal(5,4)")).otherwise(F.col("confidence")),
    }).select(*aliases.columns)
    there = aliases.select(*key, F.col("merchant_id").alias("owner"))
    fresh = owner.join(there, [*key, "owner"], "left_anti").select("workspace_id", F.col("owner").alias("merchant_id"), "alias", "match_type", F.lit(1).cast("decimal(5,4)").alias("confidence"), F.lit(True).alias("is_active"))
    return kept.unionByName(fresh.select(*aliases.columns))


def repoint(table: DataFrame, columns: list[str], merges: DataFrame) -> DataFrame:
    """table with merged merchants replaced (merges: workspace_id, source_id, target_id); a target that merges too is not followed."""
    for c in columns:
        m = merges.select("workspace_id", F.col("source_id").alias(c), F.col("target_id").alias("__to"))
        table = table.join(m, ["workspace_id", c], "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    return table


def merge_merchants(tables: dict[str, tuple[DataFrame, list[str]]], merchants: DataFrame, aliases: DataFrame, rules: DataFrame, merges: DataFrame) -> dict[str, DataFrame]:
    """All tables after merges: columns and rule actions point to the targets, aliases move unless the target has them, sources go.

    A target without an identity hash takes its source's (the least of several).
    """
    out = {name: repoint(table, columns, merges) for name, (table, columns) in tables.items()}
    moved = repoint(aliases, ["merchant_id"], merges)
    key = ["workspace_id", "merchant_id", "alias", "match_type"]
    out["alias"] = moved.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.max("is_active").alias("is_active"))
    by_source = merges.select("workspace_id", F.col("source_id").alias("id"), "target_id")
    hashes = merchants.select("workspace_id", "id", "identity_hash").join(by_source, ["workspace_id", "id"]).groupBy("workspace_id", F.col("target_id").alias("id")).agg(F.min("identity_hash").alias("moved_hash"))
    left = merchants.join(merges.select("workspace_id", F.col("source_id").alias("id")), ["workspace_id", "id"], "left_anti").join(hashes, ["workspace_id", "id"], "left")
    out["merchant"] = left.withColumn("identity_hash", F.coalesce("identity_hash", "moved_hash")).select(*merchants.columns)
    each = rules.select("workspace_id", "id", F.posexplode("actions").alias("place", "a"))
    target = merges.select("workspace_id", F.col("source_id").cast("string").alias("value"), F.col("target_id").cast("string").alias("to"))
    each = each.select("workspace_id", "id", "place", F.col("a.type").alias("type"), F.col("a.value").alias("value")).join(target, ["workspace_id", "value"], "left")
    value = F.when(F.col("type") == "SET_MERCHANT", F.coalesce("to", "value")).otherwise(F.col("value"))
    actions = each.groupBy("workspace_id", "id").agg(F.array_sort(F.collect_list(F.struct("place", "type", value.alias("value")))).alias("x"))
    actions = actions.select("workspace_id", "id", F.transform("x", lambda a: F.struct(a["type"].alias("type"), a["value"].alias("value"))).alias("new_actions"))
    out["rule"] = rules.join(actions, ["workspace_id", "id"], "left").withColumn("actions", F.coalesce("new_actions", "actions")).select(*rules.columns)
    return out


#: What a correction may set: mode column, override flag (or none), value column.
OVERRIDES = (("category", "category_override", "category_value"), ("merchant", "merchant_override", "merchant_value"), ("role", "role_override", "role_value"), ("exclusion", None, "excluded_value"))


def correct(state: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User states after corrections, and the patches that came too late.

    patches: workspace_id, transaction_id, expected_version, and for each of OVERRIDES that it has columns for a mode and a
    value (category_mode, category_value ...). SET overrides with the value, CLEAR with none, INHERIT ends it; no mode leaves
    it. A patch holds only if its version is the current one (0 where there is no state); then the version rises.
    """
    key = ["workspace_id", "transaction_id"]
    told = [x for x in OVERRIDES if f"{x[0]}_mode" in patches.columns]
    new = patches.select(*key, "expected_version", F.lit(True).alias("asked"), *[F.col(f"{n}_mode").alias(f"new_{n}_mode") for n, *_ in told], *[F.col(v).alias(f"new_{v}") for *_, v in told])
    joined = new.join(state, key, "full")
    fits = F.coalesce(F.col("asked") & (F.col("expected_version") == F.coalesce("version", F.lit(0))), F.lit(False))
    late = joined.where(F.col("asked") & ~fits).select(*key, "expected_version", F.coalesce("version", F.lit(0)).alias("version"))
    value: dict[str, Column] = {"version": F.when(fits, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version"))}
    for name, flag, column in told:
        mode = F.col(f"new_{name}_mode")
        given = fits & mode.isNotNull()
        if flag:
            value[flag] = F.when(given, mode != "INHERIT").otherwise(F.col(flag))
        value[column] = F.when(given, F.when(mode == "SET", F.col(f"new_{column}"))).otherwise(F.col(column))
    fixed = joined.where(F.col("version").isNotNull() | fits)
    return fixed.select(*[value.get(c, F.col(c)).alias(c) for c in state.columns]), late


def replace_tags(tags: DataFrame, patches: DataFrame, state: DataFrame) -> DataFrame:
    """Tags after corrections that bring a list (patches: KEY, expected_version, tags): a patch that holds replaces all of a transaction's."""
    key = ["workspace_id", "transaction_id"]
    now = state.select(*key, "version")
    held = patches.where("tags is not null").join(now, key, "left").where(F.col("expected_version") == F.coalesce("version", F.lit(0)))
    new = held.select(*key, F.explode("tags").alias("tag")).distinct()
    return tags.join(held.select(*key), key, "left_anti").unionByName(new.select(*tags.columns))


def suggestions(corrections: DataFrame) -> DataFrame:
    """Inactive rules that corrections suggest (workspace_id, transaction_id, basis, text, merchant_id, category_value): one equal condition, one action."""
    by_text = F.struct(F.lit("transaction.descriptionNormalized").alias("field"), F.col("text").alias("value"))
    by_merchant = F.struct(F.lit("merchant.id").alias("field"), F.col("merchant_id").cast("string").alias("value"))
    rows = corrections.where("category_value is not null").withColumn("condition", F.when(F.col("basis") == "MERCHANT", by_merchant).otherwise(by_text)).where("condition.value is not null")
    return rows.select("workspace_id", "transaction_id", F.col("condition.field").alias("field"), F.lit("eq").alias("operator"), F.col("condition.value").alias("value"), F.col("category_value").alias("set_category"), F.lit("SYSTEM_SUGGESTION").alias("source"), F.lit(False).alias("is_active"))


def hand_over(state: DataFrame, links: DataFrame, tags: DataFrame | None = None, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """User states after confirmed replacements (workspace_id, predecessor_id, successor_id), the links to be reviewed, and the tags.

    A successor that has a state or tags of its own is not overwritten: its link is to be reviewed. A link that was handed
    over before (done) is left alone. What is handed over starts at version 1.
    """
    key = ["workspace_id", "successor_id"]
    taken = state.select("workspace_id", F.col("transaction_id").alias("successor_id"))
    if tags is not None:
        taken = taken.union(tags.select("workspace_id", "transaction_id"))
    if done is not None:
        links = links.join(done.select(*key, "predecessor_id"), [*key, "predecessor_id"], "left_anti")
    conflict = links.join(taken, key, "left_semi")
    free = links.join(taken, key, "left_anti").select(*key, F.col("predecessor_id").alias("transaction_id"))
    moved = state.join(free, ["workspace_id", "transaction_id"]).withColumns({"transaction_id": F.col("successor_id"), "version": F.lit(1).cast(state.schema["version"].dataType)})
    if tags is not None:
        new = tags.join(free, ["workspace_id", "transaction_id"]).withColumn("transaction_id", F.col("successor_id")).select(*tags.columns)
        tags = tags.unionByName(new)
    return state.unionByName(moved.select(*state.columns)), conflict, tags


def review(links: DataFrame, decisions_: DataFrame) -> DataFrame:
    """Replacement links after decisions (workspace_id, predecessor_id, successor_id, decision): confirmed ones can't be rejected any more."""
    key = ["workspace_id", "predecessor_id", "successor_id"]
    rows = links.join(decisions_, key, "left")
    open_ = ~F.col("status").isin("AUTO_CONFIRMED", "USER_CONFIRMED")
    status = F.when((F.col("decision") == "CONFIRM") & (F.col("status") != "REJECTED"), "USER_CONFIRMED").when((F.col("decision") == "REJECT") & open_, "REJECTED").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*links.columns)
