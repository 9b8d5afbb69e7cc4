"""Language sets by expectation-maximisation over a mixture of n-gram models.

Byte trigrams of lower-cased words, each with a space on both sides, give a multinomial for each language (hashed table,
additive smoothing), counted on executors from about SAMPLE documents a language, those whose ids hash lowest. A document is a mixture: every word comes from one
language; EM estimates the proportions. Sets of the m largest proportions are refitted, and the one with the best
likelihood less half a log of the words for each further language is its language set; the largest proportion in it is
the prediction and its score.

Text that is null or has no letter: `und`, score 0, no languages. Ties go to the language first in alphabetic order.
Without any training row every document is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .common import held, map_batches, slices, small_batches, texts_of

BITS, SAMPLE, SMOOTH, STEPS, REFIT = 15, 1500, 0.5, 6, 3
#: Characters whose words are mixed at once: every word has a row of likelihoods in several arrays.
CHARACTERS = 1 << 18
SCHEMA = "doc_id bigint, lang_pred string, score double, languages array<string>, proportions array<double>"


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words in one run, and how many each word has (none: 0)."""
    raw = [("".join(c for c in w if c.isalpha()) if not w.isalpha() else w).lower().encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b" " + b"  ".join(raw) + b" ", np.uint8).astype(np.uint32)
    code = (text[:-2] << np.uint32(16) | text[1:-1] << np.uint32(8) | text[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    ends = np.cumsum(sizes + 2)
    within = np.repeat(ends - sizes - 2, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return code[within], sizes


def count(texts: list[str]) -> np.ndarray:
    """How often each trigram occurs in the texts."""
    out = np.zeros(1 << BITS, np.int64)
    for some in slices(texts):
        out += np.bincount(grams([w for t in some for w in t.split()])[0], minlength=1 << BITS)
    return out


def model_of(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetic order and their table of log probabilities, (2**BITS, languages)."""
    names = sorted(counts)
    table = np.stack([counts[k] for k in names], 1) + SMOOTH if names else np.zeros((1 << BITS, 0))
    return names, np.log(table / table.sum(0)).astype(np.float32)


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    return model_of({k: count([t for t, lang in zip(texts, langs, strict=True) if lang == k]) for k in set(langs)})


def mixture(likelihood: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents, languages) within the chosen set (0 outside it). likelihood: of each word, over its largest."""
    n = np.diff(np.append(starts, len(likelihood)))[:, None]
    k = likelihood.shape[1]

    def steps(shares: np.ndarray, times: int) -> np.ndarray:
        for _ in range(times):
            part = likelihood * shares[owner]
            part /= part.sum(1, keepdims=True)
            shares = np.add.reduceat(part, starts, axis=0) / n
        return shares

    shares = steps(np.full((len(starts), k), 1 / k), STEPS)
    order = np.argsort(-shares, axis=1, kind="stable")
    best, chosen = np.full(len(starts), -np.inf), shares
    for m in range(1, k + 1):
        inside = np.zeros_like(shares, bool)
        np.put_along_axis(inside, order[:, :m], True, axis=1)
        own = np.where(inside, shares + 1e-9, 0)
        own = steps(own / own.sum(1, keepdims=True), REFIT if m > 1 else 0)
        value = np.add.reduceat(np.log(np.maximum((likelihood * own[owner]).sum(1), 1e-300)), starts) - 0.5 * (m - 1) * np.log(n[:, 0] + 1)
        better = value > best + 1e-9
        best, chosen = np.where(better, value, best), np.where(better[:, None], own, chosen)
    return chosen, best


class Reader:
    """A worker's model; likelihoods of words are kept while they are few."""

    MOST = 100_000

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table
        self.rows: dict[str, int] = {}
        self.known = np.zeros((0, len(names)))

    def cover(self, wanted: set[str]) -> None:
        missing = [w for w in wanted if w not in self.rows]
        if len(self.rows) + len(missing) > self.MOST:
            self.rows, self.known, missing = {}, self.known[:0], list(wanted)
        if not missing:
            return
        code, sizes = grams(missing)
        sums = np.zeros((len(missing), len(self.names)))
        some = np.flatnonzero(sizes)
        if len(some):
            sums[some] = np.add.reduceat(self.table[code].astype(np.float64), (np.cumsum(sizes) - sizes)[some], axis=0)
        found = np.exp(np.maximum(sums - sums.max(1, keepdims=True), -30))
        found[sizes == 0] = -1  # no letter
        self.rows.update(zip(missing, range(len(self.known), len(self.known) + len(missing)), strict=True))
        self.known = np.concatenate([self.known, found])

    def read(self, texts: list[str]) -> list[tuple[str, float, list[str], list[float]]]:
        out: list = [("und", 0.0, [], [])] * len(texts)
        end = 0
        for some in slices(texts, CHARACTERS) if self.names else ():
            first, end = end, end + len(some)
            words = [t.split() for t in some]
            self.cover(set().union(*words))
            rows = [np.fromiter(map(self.rows.__getitem__, w), np.int64, len(w)) for w in words]
            likelihood = self.known[np.concatenate(rows)]
            owner = np.repeat(np.arange(len(words)), [len(r) for r in rows])
            lettered = likelihood[:, 0] >= 0
            likelihood, owner = likelihood[lettered], owner[lettered]
            held, starts, owner = np.unique(owner, return_index=True, return_inverse=True)
            if not len(held):
                continue
            shares, _ = mixture(likelihood, starts, owner)
            for doc, own in zip(held.tolist(), shares, strict=True):
                order = [k for k in np.argsort(-own, kind="stable").tolist() if own[k] > 0]
                out[first + doc] = (self.names[order[0]], float(min(1.0, own[order[0]])), [self.names[k] for k in order], [float(own[k]) for k in order])
        return out


def reader(model: Broadcast) -> Reader:
    return held(("langid", model), lambda: Reader(*model.value))


def learn(docs: DataFrame, trains) -> tuple[list[str], np.ndarray]:
    """The model of about SAMPLE texts of every language: executors count, the driver gets a row a language and trigram."""
    rows = docs.where(trains & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return model_of({})
    spread = 1 << 20
    limit = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(spread, int(spread * SAMPLE / n) + 1))])
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < limit[F.col("lang")]).dropDuplicates().select("lang", "text")

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, texts = batch.column(0).to_pylist(), texts_of(batch)
            found: list[tuple] = []
            for k in sorted(set(langs)):
                own = count([t for t, lang in zip(texts, langs, strict=True) if lang == k])
                at = np.flatnonzero(own)
                found.append((np.full(len(at), k, object), at, own[at]))
            a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["lang", "gram", "n"])

        return apply

    small_batches(docs.sparkSession)
    counts = {k: np.zeros(1 << BITS, np.int64) for k in sizes}
    for r in map_batches(some, make, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"]][r["gram"]] = r["n"]
    return model_of(counts)


def predict(docs: DataFrame, trains, keep: str | None = None) -> DataFrame:
    """doc_id, lang_pred, score, languages, proportions of every document; trains: condition of the rows to learn from.

    With keep: the documents' own columns, and (lang_pred, score, languages) as a struct of that name.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, trains))
    facts = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.int32())])

    def make():
        own = reader(model)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = own.read(texts_of(batch))
            if keep:
                told = pa.array([{"lang_pred": x[0], "score": x[1], "languages": len(x[2])} for x in found], facts)
                return pa.RecordBatch.from_arrays([*batch.columns, told], [*batch.schema.names, keep])
            kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*found, strict=True), kinds)], ["doc_id", "lang_pred", "score", "languages", "proportions"])

        return apply

    small_batches(spark)
    if keep:
        kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("languages", IntegerType())])
        return map_batches(docs, make, StructType([*docs.schema, StructField(keep, kind)]))
    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)
