"""Models and grammars against plain versions: enumeration, loops, and properties that define them."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerglass.llm import langid, quality, repair, simhash, toxicity, transcripts


def plain_mixture(text, names, table):
    """Proportions of the chosen language set of one text, in loops over words and languages; nothing without a letter."""
    rows = []
    for word in text.split():
        letters = "".join(c for c in word if c.isalpha()).lower()
        if letters:
            codes, _ = langid.grams([letters])
            logs = [sum(float(table[c, k]) for c in codes) for k in range(len(names))]
            rows.append([np.exp(max(x - max(logs), -30)) for x in logs])
    if not rows or not names:
        return {}

    def steps(shares, times):
        for _ in range(times):
            new = [0.0] * len(shares)
            for row in rows:
                part = [a * b for a, b in zip(row, shares)]
                for k, x in enumerate(part):
                    new[k] += x / sum(part) / len(rows)
            shares = new
        return shares

    first = steps([1 / len(names)] * len(names), langid.STEPS)
    order = sorted(range(len(names)), key=lambda k: (-first[k], k))
    best = None
    for m in range(1, len(names) + 1):
        own = [first[k] + 1e-9 if k in order[:m] else 0.0 for k in range(len(names))]
        own = steps([x / sum(own) for x in own], langid.REFIT if m > 1 else 0)
        value = sum(np.log(max(sum(a * b for a, b in zip(row, own)), 1e-300)) for row in rows) - 0.5 * (m - 1) * np.log(len(rows) + 1)
        if best is None or value > best[0] + 1e-9:
            best = value, own
    return {names[k]: x for k, x in enumerate(best[1]) if x > 0}


def test_mixtures_equal_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, table = langid.learn(docs, F.col("doc_id") % 3 != 0)
    texts = [r["text"] or "" for r in docs.collect() if len(r["text"] or "") < 3000]
    texts += [a[:200] + " " + b[:200] for a, b in zip(texts, texts[7:])][:40]
    for text, (lang, score, langs, shares) in zip(texts, langid.Reader(names, table).read(texts), strict=True):
        want = plain_mixture(text, names, table)
        assert set(langs) == set(want) and (lang == "und") == (not want)
        assert np.allclose(shares, [want[x] for x in langs]) and (not want or abs(score - max(want.values())) < 1e-9)


def test_viterbi_equals_enumeration():
    dice = random.Random(1)
    made = [transcripts.log_of(i, [(dice.choice(transcripts.ROLES), dice.choice(["hi", "what?", "one\n\ntwo lines", "", "a longer line of text here"])) for _ in range(4)]) for i in range(60)]
    model = transcripts.Model(made[:40])
    for transcript, _ in made[40:]:
        seen, _, _ = transcripts.lines_of(transcript)
        seen = seen[:6]

        def value(path):
            out = model.start[path[0]] + sum(model.moves[a, b] for a, b in zip(path, path[1:]))
            return out + sum(table[s, x] for s, features in zip(path, seen) for table, x in zip(model.emissions, features))

        with np.errstate(invalid="ignore"):
            best = max(value(p) for p in itertools.product(range(6), repeat=len(seen)))
        assert abs(value(model.viterbi(seen)) - best) < 1e-9


def test_transcripts_keep_texts(spark):
    table = spark.createDataFrame([(1, 0, "user", "x\n\n y "), (1, 1, "assistant", ""), (1, 2, "user", None), (1, None, "system", "first"), (2, 0, "assistant", "  ")], "conv_id long, turn long, role string, text string")
    raw = transcripts.logs(table)
    assert {r["conv_id"]: (r["roles"], r["texts"]) for r in transcripts.parse(raw, transcripts.fit(raw)).collect()} == {1: (["system", "user", "assistant", "user"], ["first", "x\n\n y", "", ""]), 2: (["assistant"], [""])}


def test_pairwise_fit_is_the_maximum():
    dice = np.random.default_rng(2)
    x = dice.normal(size=(300, 4))
    y = (x[:, 0] + 0.3 * dice.normal(size=300) > 0.4).astype(int)
    share = y.mean()
    ranker = quality.Ranker(x, y, share)
    z, again = quality.expand(x, ranker.centre, ranker.scale), np.random.default_rng(0)
    differences = z[again.choice(np.flatnonzero(y == 1), quality.PAIRS)] - z[again.choice(np.flatnonzero(y == 0), quality.PAIRS)]

    def loss(w):
        return np.log1p(np.exp(-differences @ w)).sum() + quality.RIDGE * (w @ w) / 2

    for k in range(len(ranker.weights)):
        for step in (-1e-3, 1e-3):
            other = ranker.weights.copy()
            other[k] += step
            assert loss(other) >= loss(ranker.weights) - 1e-6
    scores = z @ ranker.weights
    assert (scores < ranker.threshold).mean() <= 1 - share <= (scores <= ranker.threshold).mean() + 1e-9


def test_every_labelled_row_teaches_quality(spark, monkeypatch):
    for name, value in (("RARE", 8), ("OTHERS", 16), ("PAIRS", 500)):
        monkeypatch.setattr(quality, name, value)
    dice = np.random.default_rng(5)
    texts = [" ".join(dice.choice(["word", "Other", "x1", "!!", "lorem"], dice.integers(1, 30))) for _ in range(300)]
    x, y = np.array([quality.features(t) for t in texts]), (dice.random(300) < 0.85).astype(int)
    seen = spark.createDataFrame([(k, k, r.tobytes()) for k, r in enumerate(x)], "doc_id long, text_hash long, x binary")
    known = spark.createDataFrame([(k, int(label)) for k, label in enumerate(y)], "doc_id long, label int")
    rows = seen.join(known, "doc_id").select(F.xxhash64("doc_id").alias("h"), "x", "label")
    groups = quality.grouped(rows, {1: int(y.sum()), 0: int(300 - y.sum())})[0].collect()
    many, few = ([r.tobytes() for g in groups for r in np.frombuffer(g[side]).reshape(-1, x.shape[1])] for side in ("many", "few"))
    assert len(groups) > 5 and sorted(many) == sorted(r.tobytes() for r in x[y == 1]) and set(few) == {r.tobytes() for r in x[y == 0]}
    ranker = quality.train(seen, known)
    assert np.allclose(ranker.centre, x.mean(0)) and np.allclose(ranker.scale, x.std(0) + 1e-6)
    assert ranker.threshold == np.sort(ranker.raw(x))[300 - y.sum() - 1]
    some = quality.flip(dice.normal(size=500).view(np.int64))
    keys = spark.createDataFrame([(int(k),) for k in some], "key long")
    assert [quality.nth(keys, n) for n in (0, 250, 499)] == [np.sort(some)[n] for n in (0, 250, 499)]


def test_expected_moves_equal_enumeration():
    dice = np.random.default_rng(3)
    n, initial, moves, emission = 8, np.array([0.6, 0.4]), dice.uniform(0.2, 2, (2, 2)), dice.normal(size=8)
    first = np.zeros(n, bool)
    first[[0, 3]] = True
    total, want = 0.0, np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        weight = np.prod([np.exp(emission[k] * y[k]) * (initial[y[k]] if first[k] else moves[y[k - 1], y[k]]) for k in range(n)])
        total += weight
        for k in range(1, n):
            if not first[k]:
                want[y[k - 1], y[k]] += weight
    p = toxicity.marginals(emission, first, initial, moves)
    assert np.allclose(toxicity.expected_moves(emission, first, initial, moves, p), want / total)


def plain_repair(ids, terminals, symbols):
    """Re-Pair one pair at a time, the most frequent first (non-overlapping occurrences from the left)."""
    sequence, rules = list(ids), []
    while terminals + len(rules) < symbols:
        counts, last = Counter(), {}
        for k, pair in enumerate(zip(sequence, sequence[1:])):
            if last.get(pair) != k - 1:
                counts[pair] += 1
                last[pair] = k
        if not counts or max(counts.values()) < 2:
            break
        best = max(counts, key=lambda p: (counts[p], (-p[0], -p[1])))
        out, k = [], 0
        while k < len(sequence):
            if tuple(sequence[k : k + 2]) == best:
                out.append(terminals + len(rules))
                k += 2
            else:
                out.append(sequence[k])
                k += 1
        rules.append(best)
        sequence = out
    return rules, sequence


@pytest.mark.parametrize("kind", ["words", "runs", "copies", "few"])
def test_repair_equals_plain_grammar(kind):
    dice = random.Random(4)
    ids = {"words": [dice.choice([1, 2, 3, 4, 5, 6, 7, 7, 7]) for _ in range(3000)], "runs": [5] * 500 + [6, 7] * 200 + [5] * 301, "copies": [dice.randrange(400) for _ in range(200)] * 6, "few": [9]}[kind]
    shard = repair.Shard(repair.compress(np.array(ids, np.uint16), 400))
    assert shard.ids().tolist() == ids
    sequence, rules = shard.sequence.tolist(), [tuple(r) for r in shard.rules.tolist()]
    pairs, last = Counter(), {}
    for k, pair in enumerate(zip(sequence, sequence[1:])):
        if last.get(pair) != k - 1:
            pairs[pair] += 1
            last[pair] = k
    assert not [p for p, n in pairs.items() if n > 1]  # symbols last here, so no pair occurs twice
    used = Counter(x for r in rules for x in r) + Counter(sequence)
    assert all(used[400 + k] for k in range(len(rules))) and len(set(rules)) == len(rules)
    want_rules, want = plain_repair(ids, 400, 1 << 16)
    assert len(sequence) + 2 * len(rules) <= 1.15 * (len(want) + 2 * len(want_rules)) + 4


def test_oversized_shards_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 64)
    monkeypatch.setattr(simhash, "SHARDS", 4)
    monkeypatch.setattr(simhash, "LEAF", 16)
    dice = random.Random(5)
    points = set()
    for _ in range(400):
        x = dice.getrandbits(64)
        for _ in range(4):
            points.add(x)
            x ^= 1 << dice.randrange(64)
    points = np.array(sorted(points), np.uint64)
    frame = spark.createDataFrame([(int(p), 0) for p in points.view(np.int64)], "fp long, first_doc long")
    roots = {r["node"]: r["root"] for r in simhash.contract(simhash.spanning_links(frame)).collect()}
    labels = simhash.link(points)
    groups = Counter(labels.tolist())
    signed = points.view(np.int64).tolist()
    by_root = Counter(roots.get(p, p) for p in signed)
    assert sorted(groups.values()) == sorted(by_root.values())


def test_star_contraction_equals_one_task(spark, monkeypatch):
    dice = random.Random(6)
    pairs = [tuple(sorted(dice.sample(range(-300, 300), 2), reverse=True)) for _ in range(330)] + [(k + 1001, k + 1000) for k in range(60)]
    links = spark.createDataFrame(pairs, "hi long, lo long")
    one = sorted(map(tuple, simhash.contract(links).collect()))
    monkeypatch.setattr(simhash, "ONE_TASK", 0)
    assert one == sorted(map(tuple, simhash.contract(links).collect())) and len(one) > 100
    assert not simhash.contract(links.limit(0)).count()


def test_repeated_ids_with_other_texts_stay(spark):
    rows = [(5, "one text of some words that is here"), (5, "quite another text that nobody has seen before today"), (5, "one text of some words that is here"), (6, "one text of some words that is here"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()) == [(5, rows[0][1]), (5, rows[1][1]), (7, None)]


def test_special_tokens_as_the_library_has_them():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), repair.Encoder(path, 1)
    texts = ["hello <|endoftext|>", "a<|startoftext|>B <|ENDOFTEXT|>", "It's Ünïcode, NAÏVE\tand  straße!? \x01 x1y22", "", " ", "don't  ﬁne e\u0301 \u0130I", "東京 12.5%"]
    ids, sizes = own.texts(texts)
    want = [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert sizes == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_words_go_through_the_library_once_whatever_stands_behind_them(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, dice, seen, fill = P.path("word_bpe_49k.json"), random.Random(8), [], repair.Encoder.encode_words
    monkeypatch.setattr(repair.Encoder, "encode_words", lambda self, words: seen.append(len(words)) or fill(self, words))
    library, own = Tokenizer.from_file(path), repair.Encoder(path, 1)
    words = list(dict.fromkeys("".join(dice.choices("aeinorst", k=9)) for _ in range(140_000)))
    for end in (", ", "?! "):
        for at in range(0, len(words), 20_000):
            text = end.join(words[at : at + 20_000])
            ids, sizes = own.texts([text])
            if not at:
                assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [1] and sizes == [len(ids)]
    assert sum(seen) == len(words)


def test_pieces_as_the_library_has_them():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, dice = P.path("word_bpe_49k.json"), random.Random(9)
    library, own = Tokenizer.from_file(path), repair.Encoder(path, 1)
    parts = [*"aBczéÉßÿ×÷ªºµ·ÀĀİφ東🙂́­\u0085 \t\r\x1c\x0105²'.,!?()-_\"", "'s", "n't", "a×,", "÷.", "é,", "Straße,", *[" "] * 20, *["\n"] * 4]
    for _ in range(300):
        texts = ["".join(dice.choices(parts, k=dice.randint(0, 40))) for _ in range(dice.randint(0, 12))]
        ids, sizes = own.texts(texts)
        want = [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert sizes == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_last_symbols_are_dealt_without_looking_at_rare_pairs(monkeypatch):
    looked, places = [], repair.places
    monkeypatch.setattr(repair, "places", lambda chosen, keys: looked.append(len(keys)) or places(chosen, keys))
    weight = 1 / np.arange(1, 501)
    ids = np.random.default_rng(1).choice(500, 400_000, p=weight / weight.sum()).astype(np.uint16)
    shard = repair.Shard(repair.compress(ids, 60_000))
    assert (shard.ids() == ids).all() and len(shard.rules) == (1 << 16) - 60_000
    assert sum(looked) < len(ids)


def test_most_frequent_pairs_are_those_of_a_full_count():
    sequence = np.minimum(np.random.default_rng(2).zipf(1.4, 20_000), 3_000).astype(np.uint16)
    keys, slots = repair.pairs_of(sequence)
    counts, full = np.bincount(slots, minlength=1 << repair.SLOT_BITS), Counter(keys.tolist())
    for bound, most, guess in itertools.product((2, 3, 40, 10**6), (1, 7, 300, 16_000), (2, 9, 10**6)):
        some, chosen, least = repair.most_frequent(keys, slots, counts, bound, most, guess)
        want = sorted((k for k, n in full.items() if n >= bound), key=lambda k: (-full[k], k))[:most]
        assert chosen.tolist() == want and set(np.flatnonzero(np.isin(keys, chosen))) <= set(some)
        assert least == (full[want[-1]] if len(want) == most else bound)
