"""Classification rules: a bounded condition language, compiled to Columns, and a fold of ordered rules."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import bank_date
from .money import decimal_text

# The language (fixed values): fields by kind, operators by kind, actions, bounds.
FIELDS = {
    "text": ("transaction.descriptionNormalized", "merchant.normalizedKey", "provider.categoryId"),
    "id": ("transaction.accountId", "merchant.id"),
    "choice": ("transaction.systemDirection", "transaction.systemFinancialRole", "transaction.providerType", "transaction.providerCurrency", "transaction.accountCurrency", "transaction.accountType"),
    "number": ("transaction.providerAmountSigned", "transaction.accountCurrencyAmountSigned", "transaction.installmentTotal"),
    "date": ("transaction.transactionLocalDate",),
}
KIND = {name: kind for kind, names in FIELDS.items() for name in names}
SETS = ("eq", "neq", "in")
ORDERED = ("eq", "neq", "in", "between", "gt", "gte", "lt", "lte")
OPERATORS = {"text": (*SETS, "contains", "starts_with", "regex_safe"), "id": SETS, "choice": SETS, "number": ORDERED, "date": ORDERED}
ACTIONS = ("SET_CATEGORY", "SET_MERCHANT", "SET_FINANCIAL_ROLE", "SET_SPEND_INCLUSION", "ADD_TAG", "REMOVE_TAG", "MARK_RECURRING_CANDIDATE", "STOP_PROCESSING")
SINGLE = ACTIONS[:4]
DEPTH, NODES, GROUP, IN_VALUES, MOST_ACTIONS, BYTES, PATTERN, INPUT = 4, 50, 20, 50, 20, 20_000, 256, 1000
#: No look-around, no back-references, no quantifier behind a group that holds one: such patterns run in linear time enough.
UNSAFE = re.compile(r"\(\?(?!:)|\\[1-9]|\\k|\([^()]*[*+{][^()]*\)[*+{?]|[*+?}][*+]")


class RuleError(ValueError):
    pass


def safe_pattern(pattern: str) -> str:
    if not pattern or len(pattern) > PATTERN or UNSAFE.search(pattern):
        raise RuleError("the pattern is not allowed")
    try:
        re.compile(pattern)
    except re.error as e:
        raise RuleError(f"the pattern does not compile: {e}") from None
    return pattern


def value_of(kind: str, value: Any) -> Any:
    if kind == "number":
        return Decimal(decimal_text(str(value)))
    if kind == "date":
        return bank_date(value)
    if not isinstance(value, (str, int)) or isinstance(value, bool) or (isinstance(value, str) and not 0 < len(value) <= INPUT):
        raise RuleError(f"not a value: {value!r}")
    return value


def check(node: dict, depth: int = 1) -> int:
    """Number of nodes of a sound condition; raises for any other."""
    if not isinstance(node, dict) or depth > DEPTH:
        raise RuleError("conditions are nested too deep, or no object")
    for word in ("all", "any"):
        if word in node:
            if set(node) != {word} or not isinstance(node[word], list) or not 1 <= len(node[word]) <= GROUP:
                raise RuleError(f"a group holds 1 to {GROUP} conditions and nothing else")
            n = 1 + sum(check(x, depth + 1) for x in node[word])
            if n > NODES:
                raise RuleError(f"more than {NODES} conditions")
            return n
    kind, op = KIND.get(node.get("field", "")), node.get("operator")
    if kind is None or op not in OPERATORS[kind] or set(node) - {"field", "operator", "value", "values"}:
        raise RuleError(f"no such condition: {node}")
    if op == "in":
        values = node.get("values")
        if not isinstance(values, list) or not 1 <= len(values) <= IN_VALUES:
            raise RuleError(f"in takes 1 to {IN_VALUES} values")
        _ = [value_of(kind, v) for v in values]
    elif op == "between":
        low, high = [value_of(kind, v) for v in node.get("values", [None, None])]
        if low > high:
            raise RuleError("between takes the lower value first")
    elif op == "regex_safe":
        safe_pattern(node.get("value", ""))
    else:
        value_of(kind, node.get("value"))
    return 1


def check_actions(actions: list[dict]) -> None:
    if not isinstance(actions, list) or not 1 <= len(actions) <= MOST_ACTIONS:
        raise RuleError(f"a rule has 1 to {MOST_ACTIONS} actions")
    seen: set = set()
    for a in actions:
        if a.get("type") not in ACTIONS:
            raise RuleError(f"no such action: {a}")
        key = a["type"] if a["type"] in (*SINGLE, "STOP_PROCESSING", "MARK_RECURRING_CANDIDATE") else ("TAG", a.get("value"))
        if key in seen:
            raise RuleError(f"twice in a rule: {key}")
        seen.add(key)


@dataclass(frozen=True)
class Rule:
    id: str
    condition: dict
    actions: list[dict] = field(hash=False)
    priority: int = 0
    created_at: str = ""
    stop: bool = False

    def __post_init__(self):
        if len(json.dumps([self.condition, self.actions]).encode()) > BYTES:
            raise RuleError("the rule is too long")
        check(self.condition)
        check_actions(self.actions)


def compile_condition(node: dict, facts: dict[str, Column]) -> Column:
    """True or false, never null: an unknown fact meets no condition, not even neq."""
    for word, op in (("all", and_), ("any", or_)):
        if word in node:
            return reduce(op, [compile_condition(x, facts) for x in node[word]])
    kind, op, fact = KIND[node["field"]], node["operator"], facts.get(node["field"], F.lit(None))
    if kind == "number":
        fact = fact.cast("decimal(20,6)")
    lit = lambda v: F.lit(value_of(kind, v)) if kind != "number" else F.lit(value_of(kind, v)).cast("decimal(20,6)")
    if op == "in":
        found = fact.isin(*[value_of(kind, v) for v in node["values"]])
    elif op == "between":
        found = fact.between(*map(lit, node["values"]))
    elif op == "contains":
        found = F.contains(fact, lit(node["value"]))
    elif op == "starts_with":
        found = F.startswith(fact, lit(node["value"]))
    elif op == "regex_safe":
        found = (F.length(fact) <= INPUT) & fact.rlike("(?iu)" + safe_pattern(node["value"]))  # longer facts match nothing
    else:
        x = lit(node["value"])
        found = {"eq": fact == x, "neq": fact != x, "gt": fact > x, "gte": fact >= x, "lt": fact < x, "lte": fact <= x}[op]
    return F.coalesce(found, F.lit(False))


def ordered(rules: list[Rule]) -> list[Rule]:
    if len({r.id for r in rules}) < len(rules):
        raise RuleError("a rule is there twice")
    return sorted(rules, key=lambda r: (-r.priority, r.created_at, r.id))


def evaluate(rows: DataFrame, rules: list[Rule], facts: dict[str, Column]) -> DataFrame:
    """rows with matched_rules, stopped_by, set_<action> columns, tags_added, tags_removed, is_recurring_candidate and conflicts.

    Rules apply in order; the first to set a field wins, later other values are conflicts, and a rule that stops ends it.
    All is one projection: no rule costs a pass of its own.
    """
    hit = "__hit"
    rules = ordered(rules)
    flags = F.array(*[compile_condition(r.condition, facts) for r in rules]) if rules else F.array().cast("array<boolean>")
    out = rows.withColumn(hit, flags)
    stops = [k for k, r in enumerate(rules) if r.stop or any(a["type"] == "STOP_PROCESSING" for a in r.actions)]
    last = F.least(*[F.when(F.get(hit, F.lit(k)), F.lit(k)) for k in stops], F.lit(len(rules)), F.lit(len(rules)))
    out = out.withColumn("__last", last)
    on = {k: F.get(hit, F.lit(k)) & (F.col("__last") >= k) for k in range(len(rules))}
    ids = F.array(*[F.lit(r.id) for r in rules]).cast("array<string>")
    columns: dict[str, Column] = {
        "matched_rules": F.array_compact(F.array(*[F.when(on[k], F.lit(r.id)) for k, r in enumerate(rules)])).cast("array<string>"),
        "stopped_by": F.when(F.col("__last") < len(rules), F.get(ids, F.col("__last"))),
        "is_recurring_candidate": reduce(or_, [on[k] for k, r in enumerate(rules) if any(a["type"] == "MARK_RECURRING_CANDIDATE" for a in r.actions)], F.lit(False)),
    }
    conflicts: list[Column] = []
    for action in SINGLE:
        writers = [(k, str(a["value"])) for k, r in enumerate(rules) for a in r.actions if a["type"] == action]
        value = F.coalesce(*[F.when(on[k], F.lit(v)) for k, v in writers], F.lit(None).cast("string"))
        columns[action.lower()] = value
        conflicts += [F.when(on[k] & (value != v), F.struct(F.lit(action).alias("action"), F.lit(rules[k].id).alias("rule"), value.alias("kept"), F.lit(v).alias("rejected"))) for k, v in writers]
    tags = [(k, a["type"], str(a["value"])) for k, r in enumerate(rules) for a in r.actions if a["type"] in ("ADD_TAG", "REMOVE_TAG")]
    first = {tag: F.coalesce(*[F.when(on[k], F.lit(t)) for k, t, v in tags if v == tag], F.lit(None).cast("string")) for tag in dict.fromkeys(v for *_, v in tags)}
    for name, kind in (("tags_added", "ADD_TAG"), ("tags_removed", "REMOVE_TAG")):
        columns[name] = F.array_compact(F.array(*[F.when(f == kind, F.lit(tag)) for tag, f in first.items()])).cast("array<string>")
    conflicts += [F.when(on[k] & (first[v] != t), F.struct(F.lit("TAG").alias("action"), F.lit(rules[k].id).alias("rule"), F.concat(first[v], F.lit(" "), F.lit(v)).alias("kept"), F.lit(f"{t} {v}").alias("rejected"))) for k, t, v in tags]
    columns["conflicts"] = F.array_compact(F.array(*conflicts)) if conflicts else F.array().cast("array<struct<action:string,rule:string,kept:string,rejected:string>>")
    return out.withColumns(columns).drop(hit, "__last")
