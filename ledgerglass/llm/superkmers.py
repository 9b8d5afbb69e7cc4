"""Removal of repeated word windows, found by super-k-mers.

A window is WINDOW consecutive words. Its minimiser is the least hash among its runs of MINIMISER words, so equal
windows of any documents have one minimiser, and consecutive windows that share it travel together as one packed
string to that minimiser's bucket. Steps:

1. every document lists its super-k-mers: place, number of windows, minimiser, hash of the packed string (no text);
2. minimisers met by one document alone drop out (one grouping of numbers); equal super-k-mers of the others collapse to
   one row with their first document, and minimisers with a single packed string need no text at all;
3. of the rest, the first document of each distinct super-k-mer packs it and sends it to the bucket of its minimiser,
   where the windows of all packed strings are sorted and each learns the first document that has it; buckets beyond
   HOT_STRINGS or HOT_WINDOWS are dealt by window instead: a string sends its distinct windows as two independent 64-bit
   hashes each, and they are grouped;
4. every document joins its super-k-mers to those answers and drops the words that an earlier document's windows cover.

A super-k-mer is known by minimiser and packed hash together (two independent 64-bit hashes); inside a bucket, windows
are compared word by word. Null text has no words. Rows without doc_id are never earlier than others and are kept
whole; rows that repeat a doc_id are told apart by their text and never shorten each other. Repeated rows cost what they
hold: what is asked and answered is distinct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, map_batches, settle, small_batches, texts_of

WINDOW, MINIMISER = 50, 8
#: Words of buckets whose windows are compared at once, so that buckets of few words share one pass.
BUCKET_WORDS = 150_000
#: Distinct strings and windows of one minimiser beyond which its windows are dealt one by one.
HOT_STRINGS, HOT_WINDOWS = 512, 16_384
#: Windows of hot buckets in several strings up to which they are broadcast (24 bytes each); more of them are shuffled.
BROADCAST_WINDOWS = 200_000
PACKED = "minimiser bigint, packed_hash bigint, first_doc bigint, packed binary, a array<bigint>, b array<bigint>, which array<int>"
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes], seed: int = 7) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + hashes[k : k + len(out)]
    return mix(out)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def super_kmers(words: list[bytes], window: int = WINDOW, minimiser: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each maximal run of windows that share a minimiser."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding_least(runs(word_hashes(words), minimiser), window - minimiser + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return first, np.diff(np.append(first, len(least))), least[first]


def pack(words: list[bytes], first: int, count: int, window: int = WINDOW) -> bytes:
    return b" ".join(words[first : first + count + window - 1])


def list_super_kmers(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, first, windows, minimiser, packed_hash of every super-k-mer of every document with an id."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], [], []]
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch), strict=True):
                words = words_of(text)
                first, count, least = super_kmers(words)
                places, counts = first.tolist(), count.tolist()
                columns[0] += [doc_id] * len(places)
                columns[1] += [text_hash] * len(places)
                columns[2] += places
                columns[3] += counts
                columns[4].append(least)
                columns[5] += [xxhash.xxh64_intdigest(pack(words, a, n), 11) for a, n in zip(places, counts, strict=True)]
            least = np.concatenate(columns[4]).view(np.int64)
            hashes = np.array(columns[5], np.uint64).view(np.int64)
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(least), pa.array(hashes)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "first", "windows", "minimiser", "packed_hash"])

        return apply

    small_batches(docs.sparkSession)
    schema = "doc_id bigint, text_hash bigint, first int, windows int, minimiser bigint, packed_hash bigint"
    return map_batches(docs.where("doc_id is not null").select("doc_id", "text_hash", "text"), make, schema)


def pack_asked(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """minimiser, packed_hash, first_doc, and packed (the string), or a and b (two hashes of each distinct window) and which of them each window is, where the bucket is hot."""
    wanted = asked.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "windows", "minimiser", "packed_hash", "hot")).alias("asked"))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, text, items in zip(batch.column(0).to_pylist(), texts_of(batch), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                for x in items:
                    first, n = x["first"], x["windows"]
                    packed = a = b = which = None
                    if x["hot"]:
                        both = np.stack([runs(word_hashes(words[first : first + n + WINDOW - 1], seed), WINDOW).view(np.int64) for seed in (7, 13)], 1)
                        both, which = np.unique(both, axis=0, return_inverse=True)
                        a, b, which = both[:, 0], both[:, 1], which.reshape(-1).astype(np.int32)
                    else:
                        packed = pack(words, first, n)
                    rows.append((x["minimiser"], x["packed_hash"], doc_id, packed, a, b, which))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], ["minimiser", "packed_hash", "first_doc", "packed", "a", "b", "which"])

        return apply

    small_batches(docs.sparkSession)
    return map_batches(docs.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text", "asked"), make, PACKED)


def first_documents(packed: list[bytes], docs: np.ndarray, window: int = WINDOW) -> list[list[int]]:
    """For each packed string, the least document among all strings that have its 1st, 2nd, ... window.

    Word codes are exact; windows are sorted by hash, and neighbours of one hash are compared word by word.
    """
    words = [x.split() for x in packed]
    codes: dict[bytes, int] = {}
    for own in words:
        for w in own:
            codes.setdefault(w, len(codes))
    flat = np.fromiter((codes[w] for own in words for w in own), np.int64, sum(map(len, words)))
    sizes = np.array([len(x) for x in words])
    begin = np.cumsum(sizes) - sizes
    counts = sizes - window + 1
    owner = np.repeat(np.arange(len(words)), counts)
    start = np.repeat(begin, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = runs(mix(flat.astype(np.uint64) + np.uint64(1)), window)[start]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    at = np.flatnonzero(same)
    for begin_ in range(0, len(at), 20_000):  # exact comparison
        some = at[begin_ : begin_ + 20_000]
        span = np.arange(window)
        same[some] = (flat[start[order[some]][:, None] + span] == flat[start[order[some + 1]][:, None] + span]).all(1)
    group = np.concatenate(([0], np.cumsum(~same)))
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, docs[owner[order]])
    out = np.empty(len(order), np.int64)
    out[order] = least[group]
    return [x.tolist() for x in np.split(out, np.cumsum(counts)[:-1])]


def answer(packed: DataFrame) -> DataFrame:
    """minimiser, packed_hash, first_doc, firsts (of each window), bucket by bucket from rows sorted by minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            firsts = first_documents([x[3] for x in rows], np.array([x[2] for x in rows], np.int64))
            arrays = [pa.array([x[k] for x in rows], pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(firsts, pa.list_(pa.int64()))], ["minimiser", "packed_hash", "first_doc", "firsts"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:2] == row[:2]:
                    continue  # a repeated row's string
                if size > BUCKET_WORDS and held[-1][0] != row[0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += row[3].count(b" ") + 1
        if held:
            yield flush(held)

    some = packed.where("packed is not null").select("minimiser", "packed_hash", "first_doc", "packed")
    dealt = some.repartition(F.col("minimiser")).sortWithinPartitions("minimiser", "packed_hash")
    return dealt.mapInArrow(run, "minimiser bigint, packed_hash bigint, first_doc bigint, firsts array<bigint>")


def hot_windows(packed: DataFrame) -> DataFrame:
    """minimiser, packed_hash, first_doc, k, a, b: a row for each distinct window of each string of a hot bucket."""
    key = ["minimiser", "packed_hash", "first_doc"]
    strings = packed.where("packed is null").dropDuplicates(key)
    return strings.select(*key, F.posexplode(F.arrays_zip("a", "b")).alias("k", "w")).select(*key, "k", "w.a", "w.b")


def answer_hot(packed: DataFrame, windows: DataFrame, least: DataFrame) -> DataFrame:
    """The same as `answer` for hot buckets. least: a, b, d (first document) of the windows that several strings have."""
    key = ["minimiser", "packed_hash", "first_doc"]
    small = least.count() <= BROADCAST_WINDOWS
    earlier = windows.join(F.broadcast(least) if small else least, ["a", "b"]).where("d < first_doc")
    known = earlier.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("k", "d"))).alias("known"))
    strings = packed.where("packed is null").select(*key, "which").dropDuplicates(key)
    firsts = F.transform("which", lambda k: F.coalesce(F.element_at("known", k), F.col("first_doc")))
    return strings.join(known, key, "left").select(*key, firsts.alias("firsts"))


def covers(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, covers: (place of the first word, number of words) of windows that an earlier document has."""
    kmers = settle(list_super_kmers(docs), "super-kmers")
    met = settle(kmers.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("minimiser"), "minimisers")
    hits = settle(kmers.join(met, "minimiser"), "hits")
    discard(kmers, met)
    # One row for each distinct super-k-mer: its first document, and where it stands there.
    strings = hits.groupBy("minimiser", "packed_hash").agg(F.min(F.struct("doc_id", "text_hash", "first", "windows")).alias("at")).select("minimiser", "packed_hash", "at.*")
    strings = settle(strings, "strings")
    buckets = strings.groupBy("minimiser").agg(F.count("*").alias("strings"), F.sum("windows").alias("all_windows"))
    buckets = settle(buckets.select("minimiser", "strings", F.expr(f"strings > {HOT_STRINGS} or all_windows > {HOT_WINDOWS}").alias("hot")), "buckets")
    asked = settle(strings.join(buckets.where("strings > 1"), "minimiser").drop("strings"), "asked")
    packed = settle(pack_asked(docs, asked), "packed")
    alone = strings.join(buckets.where("strings = 1"), "minimiser").select("minimiser", "packed_hash", F.col("doc_id").alias("first_doc"), F.lit(None).cast("array<bigint>").alias("firsts"))
    windows = settle(hot_windows(packed), "hot-windows")
    least = settle(windows.groupBy("a", "b").agg(F.min("first_doc").alias("d"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    answers = answer(packed).unionByName(answer_hot(packed, windows, least)).unionByName(alone)
    # Without `firsts`, every window of the string was first met in first_doc.
    hit = hits.join(answers, ["minimiser", "packed_hash"]).where(F.coalesce(F.array_min("firsts"), F.col("first_doc")) < F.col("doc_id"))
    whole = F.array(F.struct(F.col("first").alias("first"), (F.col("windows") + WINDOW - 1).alias("words")))
    some = F.transform(
        F.filter(F.arrays_zip(F.sequence(F.lit(0), F.col("windows") - 1).alias("k"), F.col("firsts").alias("d")), lambda x: x["d"] < F.col("doc_id")),
        lambda x: F.struct((F.col("first") + x["k"]).alias("first"), F.lit(WINDOW).alias("words")),
    )
    all_earlier = F.col("firsts").isNull() | (F.array_max("firsts") < F.col("doc_id"))
    spans = hit.select("doc_id", "text_hash", F.when(all_earlier, whole).otherwise(some).alias("spans"))
    found = settle(spans.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("spans")).alias("covers")), "covers")
    discard(hits, strings, buckets, asked, packed, windows, least)
    return found


def keep_flags(n: int, spans: list | None) -> np.ndarray:
    """Which of n words stay."""
    edge = np.zeros(n + 1, np.int64)
    for x in spans or ():
        edge[x["first"]] += 1
        edge[min(n, x["first"] + x["words"])] -= 1
    return np.cumsum(edge)[:n] == 0


def joined(docs: DataFrame) -> DataFrame:
    """The documents' columns, with their covers behind them."""
    found = covers(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"))
    same = (docs["doc_id"] == found["doc_id"]) & (F.xxhash64(docs["text"]) == found["text_hash"])
    return docs.join(found, same, "left").select(*[docs[f"`{c}`"] for c in docs.columns], found["covers"].alias(fresh(docs, "covers")))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, spans in zip(texts_of(batch), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                kept = words if not spans else [w for w, k in zip(words, keep_flags(len(words), spans).tolist(), strict=True) if k]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            a, b, c = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

        return apply

    small_batches(docs.sparkSession)
    return map_batches(joined(docs.select("doc_id", "text")), make, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """The documents with covered words cut out; texts without one stay as they are, white space included.

    A document whose words all go keeps an empty text.
    """

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans and texts[k]:
                    words = words_of(texts[k])
                    texts[k] = b" ".join([w for w, stay in zip(words, keep_flags(len(words), spans).tolist(), strict=True) if stay]).decode("utf-8")
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            return pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

        return apply

    small_batches(docs.sparkSession)
    return map_batches(joined(docs), make, docs.schema)


def sql(documents: str = "documents") -> str:
    """The rows of `digests` in DuckDB's SQL, with windows as strings."""
    return f"""
    with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from {documents}),
    windows as (select doc_id, place, array_to_string(list_slice(words, place, place + {WINDOW - 1}), ' ') as win
                from (select doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) as place from texts)),
    firsts as (select win, min(doc_id) as low from windows group by win),
    bad as (select doc_id, place from windows join firsts using (win) where low < doc_id),
    words as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from texts),
    flagged as (select w.doc_id, w.place, w.word,
                       max(case when b.place is not null then 1 else 0 end)
                           over (partition by w.doc_id order by w.place rows between {WINDOW - 1} preceding and current row) as gone
                from words w left join bad b on b.doc_id = w.doc_id and b.place = w.place),
    kept as (select doc_id, sum(gone) as n_removed, string_agg(case when gone = 0 then word end, ' ' order by place) as text from flagged group by doc_id)
    select t.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
    from texts t left join kept k on k.doc_id = t.doc_id"""
