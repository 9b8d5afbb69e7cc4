"""Benchmark decontamination by templates, in DataFrame functions alone.

Numbers (with their decimals and groups; signs do not count), units behind numbers and words in title case become slots
of a type (0, 1, 2) that keep their values; other words count in lower case, punctuation and white space not at all.
A window is WINDOW consecutive words; an item of SHORT to WINDOW - 1 words is one window of its own length. A window of an
item is found in a document in any of these forms:

* template: the words with slots reduced to their types, if LITERAL of them are no slots;
* case-blind: numbers and units reduced, names as words in lower case, if LITERAL of them are no slots; it meets text
  whose case hides its names, and, where the item has no name at all or a template in less than half of its windows, the
  same form of any document;
* verbatim, if fewer words are left for either (items made of numbers): all words with the values of their slots.

A document holds enough of an item if it meets SHARE of its windows, or SHARE of those that have a template, where half of
them have one (a window of numbers and names alone cannot meet a re-parameterised copy).

1. Hashes of every document's windows join those of the benchmark; pairs of a document and an item of which enough
   windows are met are candidates.
2. Candidates are aligned word by word. Along one alignment every slot value of the item must stand for one value in
   the document; windows of alignments that contradict themselves do not count. What still covers enough of the item's
   windows is contaminated; `reparameterised` tells whether some slot has another value than in the item.

Null texts and items of fewer than SHORT words have no windows; such items are never found, as so few words are no
question. Rows that repeat a doc_id count as one document; of rows that repeat an item_id, the least text counts. Rows
without an id are not reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, settle

WINDOW, SHORT, LITERAL, SHARE = 8, 4, 4, 0.8
#: Benchmark windows up to which their hashes are broadcast (24 bytes each); more of them are shuffled.
BROADCAST_WINDOWS = 500_000

# Patterns of the three slot types (fixed values; also used by the SQL).
NUMBER = r"([0-9]+)(?:[.,]([0-9]+))?(?:[.,]([0-9]+))?(?:[.,]([0-9]+))?"
OTHER = r"[^\p{L}\p{M}0-9]+"
UNITS = (
    "km|cm|mm|m|kilometres|kilometre|kilometers|kilometer|metres|metre|meters|meter|centimetres|centimetre|centimeters|centimeter|miles|mile|yards|yard|feet|foot|ft|inches|inch"
    "|kg|mg|g|kilograms|kilogram|grams|gram|pounds|pound|lbs|lb|ounces|ounce|oz|tonnes|tonne|tons|ton|ml|l|litres|litre|liters|liter|gallons|gallon|cups|cup"
    "|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|cents|cent|percent|degrees|degree|usd|eur|gb|mb|kb"
)
UNIT = rf"(0[0-9p]+) ((?i:{UNITS}))( |$)"
NAME = r" (\p{Lu}\p{Ll}+)"


def slotted(text: Column) -> Column:
    """Words in lower case with one space between them; slots begin with the digit of their type."""
    out = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), NUMBER, " 0$1p$2p$3p$4 ")
    out = F.regexp_replace(out, OTHER, " ")
    out = F.when(F.contains(out, F.lit(" 0")), F.regexp_replace(out, UNIT, "$1 1$2$3")).otherwise(out)
    return F.trim(F.lower(F.regexp_replace(out, NAME, " 2$1")))


def template(w: Column) -> Column:
    return F.when(w < "3", F.substring(w, 1, 1)).otherwise(w)


def caseless(w: Column) -> Column:
    return F.when(w < "2", F.substring(w, 1, 1)).when(w < "3", F.substr(w, F.lit(2))).otherwise(w)


def verbatim(w: Column) -> Column:
    return F.when((w >= "2") & (w < "3"), F.substr(w, F.lit(2))).otherwise(w)


def places(words: Column, length: int) -> Column:
    """1-based places of all windows of a length; none for shorter texts."""
    return F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1))).otherwise(F.array().cast("array<int>"))


def hashed(array: str, length: int, salt: str = "") -> Column:
    """Hashes of all windows of an array of word hashes."""
    head = [F.lit(salt)] if salt else []
    return F.transform(places(F.col(array), length), lambda p: F.xxhash64(*head, *[F.get(array, p + (k - 1)) for k in range(length)]))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, place, length, general (whether the window has a template), kind, words (of the form), slots (the slotted words): a row for each form of each window."""
    split = items.select("item_id", F.split(slotted(F.col("text")), " ").alias("w"))
    named = F.exists("w", lambda w: (w >= "2") & (w < "3"))
    split = split.select("item_id", "w", named.alias("named"), *[F.transform("w", form).alias(c) for c, form in (("t", template), ("l", caseless), ("v", verbatim))])

    def rows(length: int) -> DataFrame:
        fits = F.size("w") >= WINDOW if length == WINDOW else F.size("w") == length
        windows = F.transform(places(F.col("w"), length), lambda p: F.struct(p.alias("place"), *[F.slice(c, p, length).alias(c) for c in "wtlv"]))
        general = F.size(F.filter(windows, lambda x: F.size(F.filter(x["t"], lambda w: ~w.isin("0", "1", "2"))) >= LITERAL))
        cut = split.where(fits).select("item_id", "named", F.lit(length).alias("length"), general.alias("templates"), F.size(windows).alias("windows"), F.inline(windows))
        plain, blind = F.size(F.filter("t", lambda w: ~w.isin("0", "1", "2"))), F.size(F.filter("l", lambda w: ~w.isin("0", "1")))
        forms = [
            F.when(plain >= LITERAL, F.struct(F.lit("T").alias("kind"), F.col("t").alias("words"))),
            F.when((blind >= LITERAL) & (F.col("l") != F.col("t")), F.struct(F.lit("L").alias("kind"), F.col("l").alias("words"))),
            F.when((blind >= LITERAL) & (~F.col("named") | (2 * F.col("templates") < F.col("windows"))), F.struct(F.lit("S").alias("kind"), F.col("l").alias("words"))),
            F.when((blind < LITERAL) & (F.lit(length) == WINDOW), F.struct(F.lit("V").alias("kind"), F.col("v").alias("words"))),
        ]
        found = cut.select("item_id", "place", "length", (plain >= LITERAL).alias("general"), F.explode(F.array_compact(F.array(*forms))).alias("x"), F.col("w").alias("slots"))
        return found.select("item_id", "place", "length", "general", "x.*", "slots")

    return reduce(DataFrame.unionByName, map(rows, range(SHORT, WINDOW + 1)))


def window_hashes(docs: DataFrame, lengths: list[int], blind: bool, numeric: bool) -> DataFrame:
    """doc_id, h: hash of each template window; blind, numeric: of the case-blind and the verbatim forms as well.

    Words are hashed once, a window's hash is that of its words' hashes, and nothing but the array of hashes is exploded.
    """
    words = docs.where("doc_id is not null").select("doc_id", F.split(slotted(F.col("text")), " ").alias("w"))

    def form(to) -> Column:
        return F.transform("w", lambda w: F.xxhash64(to(w)))

    forms = [form(template).alias("t")] + [form(caseless).alias("l")] * blind
    if numeric:  # only texts with so many numbers and units can have such a window
        few = F.size(F.filter("w", lambda w: w < "2")) <= WINDOW - LITERAL
        forms.append(F.when(few, F.array().cast("array<bigint>")).otherwise(form(verbatim)).alias("v"))
    every = [hashed("t", n) for n in lengths] + [hashed("l", n, "S") for n in lengths] * blind + [hashed("v", WINDOW, "V")] * numeric
    return words.select("doc_id", *forms).select("doc_id", F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("h"))


def aligned_windows(split: DataFrame, lengths: list[int], blind: bool, numeric: bool) -> DataFrame:
    """doc_id, doc_place, form, words and doc_slots of all windows, for the few documents (doc_id, w: slotted words) that are candidates."""
    forms = [("T", template, lengths)] + [("S", caseless, lengths)] * blind + [("V", verbatim, [WINDOW])] * numeric

    def rows(kind: str, form, length: int) -> DataFrame:
        own = split.select("doc_id", "w", F.transform("w", form).alias("f"))
        # Windows are cut before they become rows: a row that carried the whole text would cost the square of its length.
        cut = F.transform(places(F.col("w"), length), lambda p: F.struct(p.alias("doc_place"), F.slice("f", p, length).alias("words"), F.slice("w", p, length).alias("doc_slots")))
        return own.select("doc_id", F.lit(kind).alias("form"), F.inline(cut)).select("doc_id", "doc_place", "form", "words", "doc_slots")

    return reduce(DataFrame.unionByName, [rows(kind, form, n) for kind, form, some in forms for n in some])


def counts(place: str) -> list[Column]:
    return [F.countDistinct(place).alias("n"), F.countDistinct(F.when(F.col("general"), F.col(place))).alias("n_general")]


def enough() -> Column:
    general = (F.col("n_general") >= SHARE * F.col("item_general")) & (2 * F.col("item_general") >= F.col("item_windows"))
    return (F.col("n") >= SHARE * F.col("item_windows")) | general


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched_windows, item_windows, slot_count, reparameterised of every document that holds an item."""
    items = benchmark.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    own = settle(item_windows(items).withColumn("form", F.when(F.col("kind") == "L", "T").otherwise(F.col("kind"))), "item-windows", small=True)
    facts = own.agg(F.collect_set("length"), F.collect_set("form"), F.count("*")).first()
    lengths, blind, numeric, small = sorted(facts[0]) or [WINDOW], "S" in facts[1], "V" in facts[1], facts[2] <= BROADCAST_WINDOWS
    totals = own.groupBy("item_id").agg(*counts("place")).toDF("item_id", "item_windows", "item_general")
    here = docs.select("doc_id", "text")
    words = F.transform("words", lambda w: F.xxhash64(w))

    def key(form: str, length: int) -> Column:
        return F.xxhash64(*[F.lit(form)] * (form != "T"), *[F.get("h", F.lit(k)) for k in range(length)])

    known = own.select("item_id", "place", "general", "length", "form", words.alias("h"))
    known = known.select("item_id", "place", "general", F.coalesce(*[F.when((F.col("form") == f) & (F.col("length") == n), key(f, n)) for f in "TSV" for n in lengths]).alias("h")).distinct()
    met = window_hashes(here, lengths, blind, numeric).join(F.broadcast(known) if small else known, "h")
    shared = met.groupBy("doc_id", "item_id").agg(*counts("place"))
    candidates = settle(shared.join(totals, "item_id").where(enough()).select("doc_id", "item_id", "item_windows", "item_general"), "candidates", small=True)

    asked = candidates.select("doc_id").distinct()
    few = settle(here.join(asked, "doc_id", "left_semi").select("doc_id", F.split(slotted(F.col("text")), " ").alias("w")), "candidate-words")
    theirs = aligned_windows(few, lengths, blind, numeric)
    ours = own.join(candidates.select("item_id").distinct(), "item_id", "left_semi").withColumnsRenamed({"place": "item_place", "slots": "item_slots"})
    pairs = candidates.join(ours, "item_id").join(theirs, ["doc_id", "form", "words"])
    pairs = pairs.select("doc_id", "item_id", "item_windows", "item_general", "general", "kind", "item_place", (F.col("doc_place") - F.col("item_place")).alias("shift"), "item_slots", "doc_slots")
    both = F.zip_with("item_slots", "doc_slots", lambda a, b: F.struct(a.alias("item_value"), b.alias("doc_value")))
    # A template's slots are all three types; the case-blind forms have names as words, the verbatim form has values.
    below = F.when(F.col("kind") == "T", "3").when(F.col("kind") == "V", "").otherwise("2")
    slots = pairs.select("doc_id", "item_id", "shift", F.explode(F.filter(both, lambda x: x["item_value"] < below)).alias("x")).select("doc_id", "item_id", "shift", "x.*").distinct()
    of_value = slots.groupBy("doc_id", "item_id", "shift", "item_value").agg(F.count("*").alias("values"), F.max(F.col("item_value") != F.col("doc_value")).alias("other"))
    of_shift = of_value.groupBy("doc_id", "item_id", "shift").agg(F.count("*").alias("slots"), F.max("values").alias("values"), F.max("other").alias("other"))
    sound = pairs.join(of_shift, ["doc_id", "item_id", "shift"], "left").where(F.coalesce("values", F.lit(1)) == 1)
    slotted_ = [F.coalesce(F.max("slots"), F.lit(0)).alias("slot_count"), F.coalesce(F.max("other"), F.lit(False)).alias("reparameterised")]
    found = sound.groupBy("doc_id", "item_id", "item_windows", "item_general").agg(*counts("item_place"), *slotted_).where(enough())
    out = settle(found.select("doc_id", "item_id", F.col("n").alias("matched_windows"), "item_windows", "slot_count", "reparameterised"), "contaminated", small=True)
    discard(own, candidates, few)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without contaminated ones; rows without an id stay."""
    leak = fresh(docs, "leak")
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(found, docs["doc_id"] == found[leak], "left_anti")


def sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """The same rows in DuckDB's SQL, with windows as strings."""

    def words(text: str) -> str:
        out = f"regexp_replace(' ' || coalesce({text}, ''), '{NUMBER}', ' 0\\1p\\2p\\3p\\4 ', 'g')"
        out = f"regexp_replace(regexp_replace({out}, '{OTHER}', ' ', 'g'), '{UNIT}', '\\1 1\\2\\3', 'g')"
        return f"trim(lower(regexp_replace({out}, '{NAME}', ' 2\\1', 'g')))"

    def forms(key: str, select: str) -> str:
        return f"""
            select {key}, w, list_transform(w, lambda x: case when x < '3' then x[1] else x end) as t,
                   list_transform(w, lambda x: case when x < '2' then x[1] when x < '3' then x[2:] else x end) as l,
                   list_transform(w, lambda x: case when x >= '2' and x < '3' then x[2:] else x end) as v
            from (select {key}, string_split({words("text")}, ' ') as w from ({select}))"""

    def cut(key: str, table: str, lengths: str) -> str:
        slices = ", ".join(f"list_slice({c}, place, place + n - 1) as {c}" for c in "wtlv")
        return f"select {key}, place, n, whole, {slices} from (select *, w as whole, unnest(range(1, len(w) - n + 2)) as place from {table} join ({lengths}) using ({key}))"

    held = f"""count(distinct item_place) >= {SHARE} * max(item_windows)
        or (count(distinct case when general then item_place end) >= {SHARE} * max(item_general) and 2 * max(item_general) >= max(item_windows))"""
    return f"""
    with item_forms as ({forms("item_id", f"select item_id, min(text) as text from {benchmark} where item_id is not null group by 1")}),
    item_cut as ({cut("item_id", "item_forms", f"select item_id, least(len(w), {WINDOW}) as n from item_forms where len(w) >= {SHORT}")}),
    item_counted as (select *, len(list_filter(t, lambda x: x not in ('0', '1', '2'))) as plain, len(list_filter(l, lambda x: x not in ('0', '1'))) as blind,
                            len(list_filter(whole, lambda x: x >= '2' and x < '3')) > 0 as named,
                            2 * sum(case when len(list_filter(t, lambda x: x not in ('0', '1', '2'))) >= {LITERAL} then 1 else 0 end) over (partition by item_id) < count(*) over (partition by item_id) as few from item_cut),
    ours as (select item_id, place, n, w, plain >= {LITERAL} as general, 'T' as kind, 'T:' || array_to_string(t, ' ') as win from item_counted where plain >= {LITERAL}
             union all select item_id, place, n, w, plain >= {LITERAL}, 'L', 'T:' || array_to_string(l, ' ') from item_counted where blind >= {LITERAL} and l <> t
             union all select item_id, place, n, w, plain >= {LITERAL}, 'S', 'S:' || array_to_string(l, ' ') from item_counted where blind >= {LITERAL} and (few or not named)
             union all select item_id, place, n, w, plain >= {LITERAL}, 'V', 'V:' || array_to_string(v, ' ') from item_counted where blind < {LITERAL} and n = {WINDOW}),
    totals as (select item_id, count(distinct place) as item_windows, count(distinct case when general then place end) as item_general from ours group by 1),
    doc_forms as ({forms("doc_id", f"select doc_id, text from {documents} where doc_id is not null")}),
    doc_cut as ({cut("doc_id", "doc_forms", "select doc_id, n from (select distinct doc_id from doc_forms), (select distinct n from ours)")}),
    theirs as (select doc_id, place, w, 'T:' || array_to_string(t, ' ') as win from doc_cut union all select doc_id, place, w, 'S:' || array_to_string(l, ' ') from doc_cut
               union all select doc_id, place, w, 'V:' || array_to_string(v, ' ') from doc_cut where n = {WINDOW}),
    pairs as (select d.doc_id, i.item_id, i.place as item_place, i.general, i.kind, i.n, d.place - i.place as shift, i.w as item_slots, d.w as doc_slots from theirs d join ours i using (win)),
    candidates as (select doc_id, item_id from pairs join totals using (item_id) group by 1, 2 having {held}),
    kept as (select pairs.* from pairs join candidates using (doc_id, item_id)),
    slots as (select distinct doc_id, item_id, shift, x[1] as item_value, x[2] as doc_value
              from (select doc_id, item_id, shift, kind, unnest(list_transform(range(1, n + 1), lambda k: [item_slots[k], doc_slots[k]])) as x from kept)
              where x[1] < case kind when 'T' then '3' when 'V' then '' else '2' end),
    of_value as (select doc_id, item_id, shift, item_value, count(*) as n, bool_or(item_value <> doc_value) as other from slots group by 1, 2, 3, 4),
    of_shift as (select doc_id, item_id, shift, count(*) as slot_count, max(n) as n, bool_or(other) as other from of_value group by 1, 2, 3)
    select k.doc_id, k.item_id, count(distinct k.item_place) as matched_windows, max(t.item_windows) as item_windows,
           coalesce(max(s.slot_count), 0) as slot_count, coalesce(bool_or(s.other), false) as reparameterised
    from kept k join totals t using (item_id) left join of_shift s on s.doc_id = k.doc_id and s.item_id = k.item_id and s.shift = k.shift
    where coalesce(s.n, 1) = 1
    group by 1, 2 having {held}"""
