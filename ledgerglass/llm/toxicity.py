"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens do not: a token is labelled toxic if its document is and one of its features (the word and
its beginnings) is far commoner among toxic documents of the sample (at most SAMPLE of each label). The field has two
states; emissions weigh the features of the word and of both neighbours, transitions link the states; it is trained on
segments of SEGMENT tokens by gradients from forward-backward marginals. Scoring runs forward-backward exactly over whole texts of any length: steps of the chain are
2 x 2 matrices, multiplied within rows of ROW tokens for all rows at once and then across rows. A document's score is a
logistic function, fitted on the sample, of its largest marginal and of the expected number and share of toxic tokens; spans are
runs of tokens whose marginal is at least one half, as character offsets.

Null and empty texts have no tokens and score by the intercept. Without toxic labels every score is 0. An id with labels
of both kinds teaches nothing; of rows that repeat an id, the least text teaches.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame

from .common import Memo, held, map_batches, slices, small_batches, texts_of
from .quality import first_of_each, labelled

SAMPLE = 2000
SEGMENT, ROW, RIDGE, STEPS, RATE = 24, 64, 1e-3, 50, 0.5
#: A feature marks toxic tokens if it is in LEAST toxic documents, PURE as a share of both rates, and this unlikely by chance.
LEAST, PURE, SURE = 4, 0.8, 40.0
STEMS = range(4, 9)
#: Characters whose tokens are scored at once: every token has matrices in several arrays.
CHARACTERS = 1 << 18
SCHEMA = "doc_id bigint, score double, predicted int, spans array<struct<begin:int,end:int>>"
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡…“”‘’"
TOKEN = re.compile(r"\S+")


def normal(token: str) -> str:
    return token.strip(EDGES).lower()


def scan(m: np.ndarray) -> np.ndarray:
    """States (n, 2), each of sum 1, of a row vector sent through the matrices m (n, 2, 2) one after another."""
    n = len(m)
    rows = -(-n // ROW)
    full = np.tile(np.eye(2), (rows * ROW, 1, 1))
    full[:n] = m
    full = full.reshape(rows, ROW, 2, 2)
    product = full[:, 0].copy()
    for k in range(1, ROW):
        product = product @ full[:, k]
        product /= product.sum((1, 2), keepdims=True)
    begin = np.empty((rows, 2))
    a, b = 0.5, 0.5
    for k, ((p, q), (r, s)) in enumerate(product.tolist()):
        begin[k] = a, b
        a, b = a * p + b * r, a * q + b * s
        a, b = a / (a + b), b / (a + b)
    out, state = np.empty((rows, ROW, 2)), begin
    for k in range(ROW):
        step = full[:, k]
        state = np.stack([state[:, 0] * step[:, 0, 0] + state[:, 1] * step[:, 1, 0], state[:, 0] * step[:, 0, 1] + state[:, 1] * step[:, 1, 1]], 1)
        state = state / state.sum(1, keepdims=True)
        out[:, k] = state
    return out.reshape(-1, 2)[:n]


def marginals(emission: np.ndarray, first: np.ndarray, initial: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Of state 1 for every token; emission: log odds of state 1 by the token itself; first: whether a chain begins here."""
    e = np.stack([np.ones(len(emission)), np.exp(np.clip(emission, -30, 30))], 1)
    ahead = np.where(first[:, None, None], initial[None, None, :], moves[None]) * e[:, None, :]
    forward = scan(ahead)
    last = np.append(first[1:], True)
    after = np.concatenate([e[1:], np.ones((1, 2))])
    back = np.where(last[:, None, None], 1.0, (moves[None] * after[:, None, :]).transpose(0, 2, 1))
    both = forward * scan(back[::-1])[::-1]
    return both[:, 1] / both.sum(1)


def parts_of(word: str) -> list[str]:
    """Features of a word: itself, and its beginnings (with a mark, as they are no words)."""
    return [word, *(word[:n] + "~" for n in STEMS if n < len(word))] if word else []


def expected_moves(emission: np.ndarray, first: np.ndarray, initial: np.ndarray, moves: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of state to next state within chains, from the forward state and the next token's marginal p."""
    e = np.stack([np.ones(len(emission)), np.exp(np.clip(emission, -30, 30))], 1)
    forward = scan(np.where(first[:, None, None], initial[None, None, :], moves[None]) * e[:, None, :])
    inner = np.flatnonzero(~np.append(first[1:], True))
    given = forward[inner, :, None] * moves[None]
    given /= given.sum(1, keepdims=True)
    return (given * np.stack([1 - p[inner + 1], p[inner + 1]], 1)[:, None, :]).sum(0)


class Field:
    """A trained field: weights of a feature for its own token and as left or right neighbour, and the chain's moves."""

    def __init__(self):
        self.features: dict[str, int] = {}
        self.weights = np.zeros((0, 3))
        self.kinds: dict[tuple[int, ...], int] = {(): 0}
        self.table = np.zeros((1, 3))  # of each kind of token, that is each set of features
        self.bias, self.initial, self.moves = -12.0, np.ones(2), np.ones((2, 2))
        self.outer = np.array([-20.0, 0.0, 0.0, 0.0])

    def kind(self, token: str) -> int:
        """The token's set of known features; there are no more sets than features, twice over, as beginnings nest."""
        key = tuple([k for x in parts_of(normal(token)) if (k := self.features.get(x)) is not None])
        found = self.kinds.get(key)
        if found is None:
            found = self.kinds[key] = len(self.kinds)
        return found

    def weigh(self) -> None:
        """Weights of all kinds met so far."""
        if len(self.table) < len(self.kinds):
            new = [self.weights[list(key)].sum(0) for key in list(self.kinds)[len(self.table) :]]
            self.table = np.concatenate([self.table, new])

    def emissions(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        own, last = self.table[ids], np.append(first[1:], True)
        left, right = np.where(first, 0, np.roll(own[:, 1], 1)), np.where(last, 0, np.roll(own[:, 2], -1))
        return self.bias + own[:, 0] + left + right

    def read(self, lists: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores of documents given as kinds of tokens, and the marginals of their tokens."""
        self.weigh()
        sizes = np.array([len(x) for x in lists], np.int64)
        ends = np.cumsum(sizes)
        p = np.zeros(0)
        if ends[-1]:
            first = np.zeros(ends[-1], bool)
            first[(ends - sizes)[sizes > 0]] = True
            ids = np.concatenate(lists)
            p = marginals(self.emissions(ids, first), first, self.initial, self.moves)
        parts = np.split(p, ends[:-1])
        facts = np.array([self.facts(x) for x in parts])
        return 1 / (1 + np.exp(-np.clip(facts @ self.outer, -40, 40))), parts

    @staticmethod
    def facts(p: np.ndarray) -> tuple[float, float, float, float]:
        """1, log odds of the largest marginal, logs of the expected number and of the expected share."""
        top = min(max(float(p.max()), 1e-6), 1 - 1e-6) if len(p) else 1e-6
        expected = float(p[p > 0.01].sum())
        return 1.0, float(np.log(top / (1 - top))) / 5, float(np.log(expected + 0.05)), float(np.log(expected / (len(p) + 20) + 1e-4))


def surprise(t: int, n1: int, c: int, n0: int) -> float:
    """Twice the log likelihood ratio of t of n1 against c of n0."""
    both = (t + c) / (n1 + n0)
    return 2 * sum(k * np.log(k / n / q) if k else 0.0 for k, n, q in ((t, n1, both), (c, n0, both), (n1 - t, n1, 1 - both), (n0 - c, n0, 1 - both)))


def train(rows: list[tuple[str, int]]) -> Field:
    field = Field()
    labels = np.array([y for _, y in rows])
    if not (labels == 1).any() or not (labels == 0).any():
        return field
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    hits: Counter[str] = Counter()
    for text, y in rows:
        if y:
            hits.update({x for w in {normal(w) for w in text.split()} for x in parts_of(w)})
    often = {x: t for x, t in hits.items() if t >= LEAST}
    del hits
    clean = dict.fromkeys(often, 0)
    for text, y in rows:
        if not y:
            for x in {x for w in {normal(w) for w in text.split()} for x in parts_of(w) if x in clean}:
                clean[x] += 1
    field.features = {x: k for k, x in enumerate(sorted(often))}
    toxic = np.zeros(len(field.features), bool)
    for x, k in field.features.items():
        c, t = clean[x], often[x]
        toxic[k] = t / n1 / (t / n1 + c / n0) >= PURE and surprise(t, n1, c, n0) >= SURE
    ids = [np.array([field.kind(w) for w in t.split()], np.int64) for t, _ in rows]
    keys = list(field.kinds)
    member, of_kind = np.array([f for key in keys for f in key], np.int64), np.repeat(np.arange(len(keys)), [len(key) for key in keys])
    marks = np.bincount(of_kind, toxic[member], len(keys)) > 0
    # Segments with a labelled token, and twice as many without.
    with_, without = [], []
    for x, y in zip(ids, labels.tolist(), strict=True):
        for at in range(0, len(x), SEGMENT):
            some = x[at : at + SEGMENT]
            gold = marks[some] if y else np.zeros(len(some), bool)
            (with_ if gold.any() else without).append((some, gold))
    dice = np.random.default_rng(0)
    batch = [*with_, *(without[k] for k in dice.permutation(len(without))[: max(500, 2 * len(with_))])]
    flat, gold = np.concatenate([s for s, _ in batch]), np.concatenate([g for _, g in batch])
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0, *(len(s) for s, _ in batch[:-1])])] = True
    last, n = np.append(first[1:], True), len(batch)
    field.weights, field.bias = np.zeros((len(field.features), 3)), -3.0
    grade = np.full_like(field.weights, 1e-8), np.full(1, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
    log_moves, log_initial = np.zeros((2, 2)), np.zeros(2)
    y = gold.astype(float)
    inner = np.flatnonzero(~last)
    seen_moves = np.array([[((1 - y[inner]) * (1 - y[inner + 1])).sum(), ((1 - y[inner]) * y[inner + 1]).sum()], [(y[inner] * (1 - y[inner + 1])).sum(), (y[inner] * y[inner + 1]).sum()]])
    for _ in range(STEPS):
        field.moves, field.initial = np.exp(log_moves), np.exp(log_initial)
        field.table = np.stack([np.bincount(of_kind, field.weights[member, c], len(keys)) for c in range(3)], 1)
        emission = field.emissions(flat, first)
        p = marginals(emission, first, field.initial, field.moves)
        expected = expected_moves(emission, first, field.initial, field.moves, p)
        slope = (y - p) / n
        own = np.stack([np.bincount(flat, slope, len(keys)), np.bincount(flat[inner], slope[inner + 1], len(keys)), np.bincount(flat[inner + 1], slope[inner], len(keys))], 1)
        rise = np.stack([np.bincount(member, own[of_kind, c], len(field.features)) for c in range(3)], 1) - RIDGE * field.weights / len(field.features)
        begin = np.array([(1 - y)[first].sum() - (1 - p)[first].sum(), y[first].sum() - p[first].sum()]) / n
        rises = rise, np.array([slope.sum()]), (seen_moves - expected) / n - RIDGE * log_moves, begin - RIDGE * log_initial
        for g, r in zip(grade, rises, strict=True):
            g += r * r
        steps = [RATE * r / np.sqrt(g) for g, r in zip(grade, rises, strict=True)]
        field.weights += steps[0]
        field.bias += float(steps[1][0])
        log_moves += steps[2]
        log_initial += steps[3]
    field.moves, field.initial = np.exp(log_moves), np.exp(log_initial)
    keep = np.flatnonzero(np.abs(field.weights).max(1, initial=0) > 0.05)
    names = sorted(field.features, key=field.features.__getitem__)
    again = Field()
    again.features, again.weights = {names[k]: i for i, k in enumerate(keep.tolist())}, field.weights[keep]
    again.bias, again.moves, again.initial = field.bias, field.moves, field.initial
    ids = [np.array([again.kind(w) for w in t.split()], np.int64) for t, _ in rows]
    facts = np.concatenate([[again.facts(m) for m in again.read(ids[at : at + 200])[1]] for at in range(0, len(ids), 200)])
    w, weight = np.zeros(facts.shape[1]), np.where(labels == 1, n0 / (n0 + n1), n1 / (n0 + n1))
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(facts @ w, -30, 30)))
        curve = (facts * (weight * q * (1 - q))[:, None]).T @ facts + 0.02 * np.eye(len(w))
        w += np.clip(np.linalg.solve(curve, facts.T @ (weight * (labels - q)) - 0.02 * w), -2, 2)
    again.outer = w
    again.kinds, again.table = {(): 0}, np.zeros((1, 3))
    return again


def tagger(model: Broadcast) -> tuple[Field, Memo]:
    return held(("toxicity", model), lambda: (model.value, Memo(lambda tokens: list(map(model.value.kind, tokens)))))


def tag(docs: DataFrame, labels: DataFrame, trains) -> DataFrame:
    """doc_id, score, predicted, spans of every document; trains: condition of the labels to learn from."""
    spark = docs.sparkSession
    rows, _ = labelled(docs, labels, "toxic", trains, SAMPLE)
    rows = [(r["text"], r["label"]) for r in first_of_each(rows.collect(), SAMPLE)]
    model = spark.sparkContext.broadcast(train(rows))

    def make():
        field, ids = tagger(model)

        def spans(text: str, p: np.ndarray) -> list[dict[str, int]]:
            hot = np.flatnonzero(p >= 0.5).tolist()
            if not hot:
                return []
            where, out = [m.span() for m in TOKEN.finditer(text)], []
            for k in hot:
                if out and out[-1][2] == k - 1:
                    out[-1][1:] = where[k][1], k
                else:
                    out.append([*where[k], k])
            return [{"begin": a, "end": b} for a, b, _ in out]

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, found, texts = [], [], texts_of(batch)
            for some in slices(texts, CHARACTERS):
                words = [TOKEN.findall(t) for t in some]
                score, parts = field.read([np.array(x, np.int64) for x in ids.fetch(words)])
                scores.append(score)
                found += [spans(t, p) for t, p in zip(some, parts, strict=True)]
            score = np.concatenate(scores)
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(found, kind)], ["doc_id", "score", "predicted", "spans"])

        return apply

    small_batches(spark)
    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)
