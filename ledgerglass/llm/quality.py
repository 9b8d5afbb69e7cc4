"""Quality scores by Bradley-Terry pairwise ranking.

Features of a whole text (shape of words, repeats, character classes) enter a linear score. Preference pairs (a document
labelled 1 over one labelled 0) are fitted by Newton steps on the logistic loss of feature differences, with an L2
penalty. Every labelled row teaches: it is in pairs with several rows of the other label, and the threshold is the exact
score quantile at the share of label 0 among all of them; the returned score is the logistic function of the distance from
that threshold. Executors compute features once for all documents and add up each step; the driver takes sums alone.

Null and empty texts have the features of an empty text and a score like any other. With one label only, every score is
that label's share. An id with labels of both kinds teaches nothing; of rows that repeat an id, the text whose hash is
least teaches.
Equal scores at the threshold count as the lower quantile.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, settle, small_batches, texts_of

PAIRS, RIDGE, STEPS = 60_000, 1.0, 25
#: Rows of the rarer label and, at most, of the other one that meet in a group; rows of the rarer label that each of the others is paired with, at least.
RARE, OTHERS, PARTNERS = 64, 4096, 8
SCHEMA = "doc_id bigint, score double, predicted int"
UPPER, LOWER, DIGIT, BREAK, SPACE = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(97, 123), range(48, 58), (10,), (32, 9, 10, 11, 12, 13)))
HIGH = np.arange(256) >= 128
SYMBOLS = [np.arange(256) == ord(c) for c in "!#$%&*|.,@{}<>=/:"]


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    upper, lower, high = (int(bytes_[x].sum()) for x in (UPPER, LOWER, HIGH))
    letters = max(1, upper + lower + high)
    common = Counter(words).most_common(1)[0][1] if words else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    values = [
        np.log1p(n),
        len(set(words)) / max(1, n),
        common / max(1, n),
        sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1),
        pairs / max(1, n - 1),
        upper / letters,
        int(bytes_[DIGIT].sum()) / size,
        int(bytes_[SPACE].sum()) / size,
        (size - letters - int(bytes_[DIGIT].sum()) - int(bytes_[SPACE].sum())) / size,
        letters / max(1, n) / 10,
        len(lines) / max(1, n),
        len(set(lines)) / max(1, len(lines)),
        max(map(len, words), default=0) ** 0.5 / 10,
        *(int(bytes_[x].sum()) / max(1, n) for x in SYMBOLS),
    ]
    return [float(x) for x in values]


def expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, held within 5 deviations, their squares, and whether they are unusual at all."""
    z = np.clip((x - centre) / scale, -5, 5)
    return np.concatenate([z, z * z, np.abs(z) > 1.5], axis=1)


def slopes(differences: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the pairs' log-likelihood and its negated second derivatives."""
    p = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
    return differences.T @ p, (differences * (p * (1 - p))[:, None]).T @ differences


def climb(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """The weights of the greatest likelihood with an L2 penalty, by Newton steps."""
    w = np.zeros(width)
    for _ in range(STEPS):
        slope, curve = sums(w)
        step = np.linalg.solve(curve + RIDGE * np.eye(width), slope - RIDGE * w)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w


class Ranker:
    def __init__(self, x: np.ndarray, y: np.ndarray, share: float):
        self.centre, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(1), np.ones(1))
        self.weights, self.threshold, self.share = None, 0.0, share
        ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(ones) or not len(zeros):
            return
        z, dice = expand(x, self.centre, self.scale), np.random.default_rng(0)
        differences = z[dice.choice(ones, PAIRS)] - z[dice.choice(zeros, PAIRS)]
        w = climb(lambda w: slopes(differences, w), z.shape[1])
        self.weights = w
        scores = z @ w
        # Both labels weigh as they do among all labelled rows, however many of each were drawn.
        weight = np.where(y == 1, share / len(ones), (1 - share) / len(zeros))
        order = np.argsort(scores)
        below = np.searchsorted(np.cumsum(weight[order]), 1 - share)
        self.threshold = float(scores[order[min(below, len(order) - 1)]])

    @classmethod
    def of(cls, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray | None, threshold: float, share: float) -> Ranker:
        ranker = cls(np.zeros((0, 1)), np.zeros(0), share)
        ranker.centre, ranker.scale, ranker.weights, ranker.threshold = centre, scale, weights, threshold
        return ranker

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Each row is summed alone, so its score does not depend on the batch."""
        return (expand(x, self.centre, self.scale) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -40, 40)))


def unanimous(labels: DataFrame, column: str, trains) -> DataFrame:
    """doc_id, label of the ids to learn from; ids with labels of both kinds are left out."""
    return labels.where(trains & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other")).where("label = other").select("doc_id", F.col("label").cast("int").alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, column: str, trains, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """h (hash of the id), text, label of about `sample` documents of each label and a tenth more, those whose ids hash lowest; and how many ids have each label.

    The broadcast side holds at most 2.2 x `sample` ids by expectation, whatever the size of the tables.
    """
    known = unanimous(labels, column, trains)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    spread = 1 << 20
    limit = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(spread, int(spread * sample * 1.1 / n) + 1))) for k, n in counts.items()], F.lit(0))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("label").alias("label"))
    return rows.select(F.xxhash64("doc_id").alias("h"), "text", "label"), counts


def first_of_each(rows: list, sample: int) -> list:
    """Of collected rows with h and label, at most `sample` of each label in the order of their hashes."""
    left, out = {}, []
    for row in sorted(rows, key=lambda r: r["h"]):
        left[row["label"]] = left.get(row["label"], 0) + 1
        if left[row["label"]] <= sample:
            out.append(row)
    return out


def unpack(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows)).reshape(len(rows), -1)


def sums_of(rows: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """The sum over all batches of what add makes of each; a row a task comes to the driver."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += add(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    return sum((np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect()), np.zeros(width))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the features of all rows."""
    width = len(features(""))

    def add(batch: pa.RecordBatch) -> np.ndarray:
        x = unpack(batch.column(batch.schema.get_field_index("x")))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    total = sums_of(rows, add, 1 + 2 * width)
    n, mean = max(1.0, total[0]), total[1 : 1 + width] / max(1.0, total[0])
    return mean, np.sqrt(np.maximum(total[1 + width :] / n - mean * mean, 0)) + 1e-6


def grouped(rows: DataFrame, counts: dict[int, int]) -> tuple[DataFrame, int]:
    """A row for each group of labelled rows (features of both labels), and how many partners of the rarer label each other row has.

    The rarer label is dealt by hash to slots; where a slot holds too many of the other, it is divided, each part with all of its rarer rows.
    """
    rare = min(counts, key=lambda k: (counts[k], k))
    slots = max(1, counts[rare] // RARE)
    parts = -(-counts[1 - rare] // (slots * OTHERS))
    copies = F.when(F.col("label") == rare, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(parts)).cast("int")))
    dealt = rows.select(F.pmod("h", F.lit(slots)).alias("slot"), F.explode(copies).alias("part"), "h", "x", (F.col("label") == rare).alias("rare"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("h")
        few = group.column("rare").to_numpy()
        both = [b"".join(group.filter(pa.array(chosen)).column("x").to_pylist()) for chosen in (few, ~few)]
        sign = 1.0 if rare == 1 else -1.0
        return pa.table({"few": pa.array([both[0]], pa.binary()), "many": pa.array([both[1]], pa.binary()), "sign": [sign]})

    out = settle(dealt.groupBy("slot", "part").applyInArrow(pack, "few binary, many binary, sign double"), "groups")
    return out, max(PARTNERS, -(-PAIRS // counts[1 - rare]))


def fit(groups: DataFrame, partners: int, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights by Newton steps, each one pass over all groups; pairs weigh PAIRS together, whatever their number."""
    width = 3 * len(centre)

    def at(w: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
        def add(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(1 + width + width * width)
            for few, many, sign in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (expand(np.frombuffer(x).reshape(-1, len(centre)), centre, scale) for x in (few, many))
                n = min(partners, len(a))
                for k in range(n):
                    differences = sign * (a[(np.arange(len(b)) * n + k) % len(a)] - b)
                    total += np.concatenate([[len(b)], *(s.ravel() for s in slopes(differences, w))])
            return total

        return add

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = sums_of(groups, at(w), 1 + width + width * width)
        total = total * (PAIRS / max(1.0, total[0]))
        return total[1 : 1 + width], total[1 + width :].reshape(width, width)

    return climb(sums, width)


def flip(bits: np.ndarray) -> np.ndarray:
    """From the bits of doubles to signed integers in their order, and back."""
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def nth(keys: DataFrame, n: int) -> int:
    """The key with n less or equal ones before it, exactly: counts by 16 bits after 16."""
    found = None
    for shift in (48, 32, 16, 0):
        open_ = keys if found is None else keys.where(F.shiftright("key", shift + 16) == found)
        counts = sorted((r["part"], r["count"]) for r in open_.groupBy(F.shiftright("key", shift).alias("part")).count().collect())
        for found, count in counts:
            if n < count:
                break
            n -= count
    return found


def train(seen: DataFrame, known: DataFrame) -> Ranker:
    """The model of all labelled documents, from their features."""
    rows = seen.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text_hash", "x")).alias("least"), F.min("label").alias("label"))
    rows = settle(rows.select(F.xxhash64("doc_id").alias("h"), "least.x", "label"), "labelled")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    centre, scale = moments(rows)
    ranker = Ranker.of(centre, scale, None, 0.0, share)
    if len(counts) == 2:
        groups, partners = grouped(rows, counts)
        ranker.weights = fit(groups, partners, centre, scale)

        def make():
            return lambda batch: pa.RecordBatch.from_arrays([pa.array(flip((ranker.raw(unpack(batch.column(0))) + 0.0).view(np.int64)))], ["key"])

        keys = settle(map_batches(rows.select("x"), make, "key bigint"), "keys")
        ranker.threshold = float(flip(np.array([nth(keys, counts[0] - 1)])).view(np.float64)[0])
        discard(groups, keys)
    discard(rows)
    return ranker


def rank(docs: DataFrame, labels: DataFrame, trains) -> DataFrame:
    """doc_id, score, predicted of every document; trains: condition of the labels to learn from."""
    spark = docs.sparkSession
    small_batches(spark)

    def see():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = pa.array([np.array(features(t)).tobytes() for t in texts_of(batch)], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], ["doc_id", "text_hash", "x"])

        return apply

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    seen = settle(map_batches(rows, see, "doc_id bigint, text_hash bigint, x binary"), "features")
    model = spark.sparkContext.broadcast(train(seen, unanimous(labels, "quality", trains)))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = model.value.score(unpack(batch.column(1)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

        return apply

    return map_batches(seen.select("doc_id", "x"), make, SCHEMA)
