"""Each operator against a plain version, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerglass.llm import bpe, langid, matroska, quality, queries, repair, simhash, superkmers, templates, toxicity, transcripts
from ledgerglass.llm.common import crc_mod

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty, blank, repeated and long texts, and columns that are named like inner ones."""
    dice = random.Random(1)
    long = " ".join(dice.choice(["alpha", "beta", "gamma", "Delta!!", "épée", "12.5"]) for _ in range(9000))
    rows = [(0, long), (1, long), (1, long), (2, None), (3, ""), (4, " \n\t "), (5, "one two"), (6, "one two"), (None, "no id here at all"), (None, None), (7, "a" * 3000), (8, "東京 ünï\x1c\x85 x"), (9, long[: len(long) // 2])]
    return documents(spark, [t for _, t in rows], [i for i, _ in rows]).withColumns({c: F.lit(1) for c in ("fp", "ids", "covers", "text_hash", "h", "label", "component_id", "words")})


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_byte_pairs_equal_the_library(spark, odd):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(i), len(ids := library.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows_of(odd))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(odd, path, P.PATTERN).collect()) == want
    own, dice = bpe.load(path, P.PATTERN), random.Random(2)
    for _ in range(400):
        t = "".join(dice.choice(" \n\t  aab'sllΩé12!? 　東京\x1c") for _ in range(dice.randint(0, 40)))
        assert own.encode_texts([t])[0] == np.array(library.encode_ordinary(t), "<u4").tobytes()
    for t in ("ab" * 900, "!" * 700, "é" * 400):
        assert own.encode_texts([t])[0] == np.array(library.encode_ordinary(t), "<u4").tobytes()


def test_token_shards_round_trip(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    shards = repair.write_shards(odd, path, 1)
    got = sorted(repair.read_shards(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 0, 1, 1, *range(2, 10)]
    start, by_id = 0, defaultdict(list)
    for i, t in rows_of(odd):
        by_id[i].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    for r in got:
        sums = {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in by_id[r["doc_id"]]}
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in sums
        start += r["n_tokens"]
    ids = np.array([random.Random(3).choice([1, 2, 3]) for _ in range(9000)] + [5] * 500, np.uint16)
    data = repair.compress(ids, 49408)
    shard = repair.Shard(data)
    assert len(data) < 2 * len(ids) and (shard.ids() == ids).all()
    for a, b in ((0, 0), (0, 9500), (17, 18), (1000, 9400), (9499, 9500)):
        assert (shard.range(a, b) == ids[a:b]).all()


def brute_components(prints):
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(prints):
        groups[top(i)].append(doc)
    return sorted((str(prints[i][0]), f"{prints[i][1]:016x}", str(min((d for d in groups[top(i)] if d is not None), default=None))) for i in range(len(prints)))


def plain_fingerprint(text):
    import xxhash

    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, odd):
    got = sorted((str(r["doc_id"]), f"{r['fp'] & (2**64 - 1):016x}", str(r["component_id"])) for r in simhash.components(odd).collect())
    assert got == brute_components([(i, plain_fingerprint(t)) for i, t in rows_of(odd)])
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r[0]) for r in kept.select("doc_id").collect()) == ["0", "2", "5", "7", "8", "9", "None", "None"]


def test_near_copies(spark):
    dice = random.Random(7)
    words = [dice.choice("abcdefghijklmnopqrst") + dice.choice("uvwxyz") * dice.randint(1, 4) for _ in range(400)]
    near, far = list(words), list(words)
    for k in range(10, 400, 70):
        near[k] = "changed"
    for k in range(0, 400, 9):
        far[k] = "changed"
    docs = documents(spark, [" ".join(words), " ".join(near), " ".join(far), " ".join(reversed(words))])
    assert sorted(r[0] for r in simhash.keep_one(docs).select("doc_id").collect()) == [0, 2, 3]


def plain_groups(texts, similarity=0.8):
    """The least place of each text's group, by comparing all pairs."""
    hashes = [simhash.shingle_hashes(t, 5) for t in texts]
    prints, sets = [simhash.print_of(h) for h in hashes], [set(h.tolist()) for h in hashes]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2 or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    return sorted(set(top))


def kept_of(spark, texts):
    return sorted(r[0] for r in simhash.keep_one(documents(spark, texts)).select("doc_id").collect())


def invented(dice, count):
    return ["".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=dice.randint(3, 8))) for _ in range(count)]


@pytest.mark.parametrize("pairs_a_row", [4, 0])
def test_near_copies_among_shared_passages(spark, monkeypatch, pairs_a_row):
    monkeypatch.setattr(simhash, "PAIRS_A_ROW", pairs_a_row)
    dice = random.Random(3)
    passages = [" ".join(invented(dice, 100)) for _ in range(20)]
    texts = [" ".join(dice.sample(passages, 5)) for _ in range(80)]
    for _ in range(25):
        words = " ".join(dice.sample(passages, 5) + invented(dice, 20)).split()
        other = list(words)
        for k in dice.sample(range(len(words)), 9):
            other[k] = "changed"
        texts += [" ".join(words), " ".join(other)]
    assert kept_of(spark, texts) == plain_groups(texts)

def test_common_shingles_are_counted_in_all_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 0.999999)
    own, shared = invented(random.Random(9), 80), "one passage that many different texts share"
    texts = [f"{' '.join(own[8 * k : 8 * k + 8])} {shared}" for k in range(10)] + ["copies of one text are not frequent"] * 20
    tokens, ranks = simhash.common_shingles(documents(spark, texts), 5)
    assert set(tokens.tolist()) == set(simhash.shingle_hashes(shared, 5).tolist()) and sorted(ranks.tolist()) == [1, 2, 3]


def test_short_near_copies(spark):
    dice = random.Random(5)
    texts = []
    for n in [30] * 120 + [50] * 60:
        words = invented(dice, n)
        other = list(words)
        other[dice.choice([0, 1, n - 2, n - 1])] = "changed"
        texts += [" ".join(words), " ".join(other)]
    assert kept_of(spark, texts) == plain_groups(texts)


def test_links_of_both_kinds_close_together(spark):
    dice = random.Random(6)
    refrain, tails = " ".join(invented(dice, 7) * 60), [" ".join(invented(dice, 60)) for _ in range(3)]
    # 0 and 1 have one fingerprint and other sets, 1 and 2 like sets and other fingerprints.
    texts = [f"{refrain} {tails[0]}", f"{refrain} {tails[1]}", f"{refrain.split()[0]} {tails[1]}", tails[2]]
    assert plain_groups(texts) == [0, 3]
    assert kept_of(spark, texts) == [0, 3]


def test_vantage_trees_miss_no_link(spark, monkeypatch):
    dice = random.Random(4)
    points = set()
    for _ in range(25):
        x = dice.getrandbits(64)
        for _ in range(60):
            x ^= 1 << dice.randrange(64)
            points.add(x)
    points = sorted(points)
    monkeypatch.setattr(simhash, "LEAF", 32)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 200)
    frame = spark.createDataFrame([(int(np.array(p, np.uint64).view(np.int64)), k) for k, p in enumerate(points)], "fp long, first_doc long")
    roots = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in simhash.contract(simhash.spanning_links(frame)).collect()}
    labels = simhash.link(np.array(points, np.uint64))
    want = brute_components(list(enumerate(points)))
    assert sorted((str(k), f"{p:016x}", str(labels[k])) for k, p in enumerate(points)) == want
    assert len({roots.get(p, p) for p in points}) == len({w[2] for w in want})


def brute_windows(rows):
    seen = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        for k in range(len(w) - 49) if i is not None else ():
            seen[key] = min(seen.get(key := tuple(w[k : k + 50]), i), i)
    out = []
    for i, t in rows:
        w, gone = WORDS.findall(t or ""), set()
        for k in range(len(w) - 49) if i is not None else ():
            if seen[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def test_super_kmers_equal_brute_force(spark, odd):
    assert sorted((str(r[0]), *r[1:]) for r in superkmers.digests(odd).collect()) == brute_windows(rows_of(odd))
    dice = random.Random(5)
    base = [[dice.choice("abcdefghij") for _ in range(200)] for _ in range(3)]
    texts = []
    for _ in range(60):
        b, a = dice.choice(base), dice.randrange(120)
        texts.append(" ".join(b[a : a + dice.randint(20, 120)] + ["a"] * dice.choice([0, 3, 70]) + dice.choice(base)[: dice.randint(0, 90)]))
    docs = documents(spark, texts, [i * 7 % 61 for i in range(60)])
    assert sorted((str(r[0]), *r[1:]) for r in superkmers.digests(docs).collect()) == brute_windows(rows_of(docs))
    cut = {r["doc_id"]: r["text"] for r in superkmers.remove(docs).collect()}
    sums = {int(i): s for i, _, n, s in brute_windows(rows_of(docs)) if n}
    assert {i: hashlib.sha256(cut[i].encode()).hexdigest() for i in sums} == sums
    assert all(cut[i] == t for i, t in rows_of(docs) if i not in sums)


@pytest.mark.parametrize("hot", [512, 1])
def test_super_kmers_of_repeated_rows_and_hot_minimisers(spark, monkeypatch, hot):
    monkeypatch.setattr(superkmers, "HOT_STRINGS", hot)
    dice = random.Random(8)
    passage = " ".join(invented(dice, 70))
    rows = [(i, " ".join([*invented(dice, 30), passage, *invented(dice, 30)])) for i in range(40)]
    rows += [(50, " ".join(["tick"] * 300)), (51, " ".join(["tick"] * 200)), (52, passage + " " + " ".join(["tick"] * 60))]
    rows += [rows[0]] * 1000 + [(0, passage)] * 3 + [(50, passage)]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    assert sorted((str(r[0]), *r[1:]) for r in superkmers.digests(docs).collect()) == brute_windows(rows)


def test_super_kmer_sql_agrees(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op8_super_kmers"])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, queries.op8_super_kmers(spark, data).select(*columns).collect())) == sorted(want.fetchall())


ITEM = "A train with Anna and Bert travels 120 km in 3 hours, then Anna walks 7 km before the very long evening meal begins."


def test_templates(spark):
    changed = "Hello. A train with Carl and Dora travels 500 km in 9 hours, then Carl walks 2 km before the very long evening meal begins. Bye"
    docs = documents(spark, [changed, changed.replace("Carl walks", "Emil walks"), ITEM.replace(" ", "\n"), None, "", "quite another text with 5 km and nothing else to see in here"])
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (None, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: r for r in templates.contaminated(docs, items).collect()}
    assert {i: r["reparameterised"] for i, r in got.items()} == {0: True, 2: False}
    assert [r[0] for r in templates.clean(docs, items).select("doc_id").orderBy("doc_id").collect()] == [1, 3, 4, 5]


SUM = "Tom has 5 red apples in a basket. Tom buys 3 more from the old market, and Anna has 2 pounds of 1,500 sweet pears. How many are left?"


def test_templates_of_other_forms(spark):
    """Names that begin sentences, other numbers and units, another case, short items and items made of numbers."""
    items = spark.createDataFrame([(1, SUM), (2, "What is the capital of France?"), (3, "Fill in: 1, 2, 4, 8, 16, 32 and 64 or 12.5"), (4, SUM.lower().replace("apples", "plums")), (5, "in short"), (5, "only few")], "item_id long, text string")
    renamed = SUM.replace("Tom", "Carl").replace("Anna", "Dora").replace("1,500", "900").replace("pounds", "kilograms").replace(" 3 ", " 2.5 ")
    texts = [SUM.upper(), SUM.lower(), renamed, renamed.replace("Carl buys", "Emil buys"), "He asked. What is the capital of Spain? Nobody knew.", "What Is The Capital Of France", "Fill in 1 2 4 8 16 32 and 64 or 12.5!", "Fill in 1 2 4 8 16 33 and 64 or 12.5!", SUM.replace("apples", "plums"), "in short, only few"]
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in templates.contaminated(documents(spark, texts), items).collect()}
    assert got == {(0, 1): False, (1, 1): False, (2, 1): True, (4, 2): True, (6, 3): False, (8, 4): False}


def test_templates_of_repeated_rows(spark):
    items = spark.createDataFrame([(1, ITEM), (1, "zzz " + ITEM), (2, None)], "item_id long, text string")
    docs = documents(spark, [ITEM, ITEM, "x y", None, ITEM], [3, 3, 3, 4, None]).withColumns({"leak": F.lit(1), "h": F.lit(2), "item_id": F.lit(1)})
    assert [r["doc_id"] for r in templates.contaminated(docs, items).collect()] == [3]
    assert sorted(str(r["doc_id"]) for r in templates.clean(docs, items).collect()) == ["4", "None"]


def template_sql(con):
    want = con.execute(queries.ORACLE_SQL["op6_template_decontamination"])
    return [d[0] for d in want.description], sorted(want.fetchall())


def test_template_sql_agrees_on_forms(spark):
    import duckdb
    import pandas as pd

    dice = random.Random(9)
    texts = [SUM, ITEM, "What is the capital of France?", "1, 2, 4, 8, 16, 32, 64 or 12.5 in all", SUM.lower(), "Anna Bert Carl Dora Emil Fritz Gina Hugo Ina met"]
    rows = []
    for i in range(150):
        words = dice.choice(texts).split()
        for _ in range(dice.randint(0, 3)):
            words[dice.randrange(len(words))] = dice.choice(["7", "Zoe", "km", "3.5", "tall", "ÉMILE"])
        rows.append((i, dice.choice([str, str.upper, str.lower, str.title])(" ".join(dice.choice([["Hm,"], []]) + words))))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(list(enumerate(texts)), columns=["item_id", "text"]))
    columns, want = template_sql(con)
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert sorted(map(tuple, templates.contaminated(documents(spark, [t for _, t in rows]), items).select(*columns).collect())) == want and len(want) > 50


def test_template_sql_agrees(spark, data):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    columns, want = template_sql(con)
    assert sorted(map(tuple, queries.op6_template_decontamination(spark, data).select(*columns).collect())) == want


def test_matroska_round_trip(spark, odd):
    got = matroska.round_trip(odd).collect()
    want = []
    for i, t in rows_of(odd):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.append((str(i), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(want)
    packets = matroska.packet_table(matroska.store(odd).where("doc_id = 0")).orderBy("packet").collect()
    data = matroska.store(odd).where("doc_id = 0").first()["media"]
    text = dict(rows_of(odd))[0].encode()
    assert b"".join(data[p["byte_offset"] : p["byte_offset"] + p["byte_size"]] for p in packets)[: len(text)] == text
    assert [p["timestamp"] for p in packets] == [64 * k for k in range(len(packets))]
    broken = spark.createDataFrame([(1, bytearray(b"nonsense")), (2, None), (3, bytearray(data[:-9]))], "doc_id long, media binary")
    assert all(r["error"] for r in matroska.packet_table(broken).collect())


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_matroska_lacings_and_unknown_sizes(lacing):
    frames = [b"a" * 300, b"b" * 300, b"c" * 300] if lacing == 2 else [b"a" * 300, b"b" * 20, b"c" * 700] if lacing else [b"a" * 300]
    head = b"\x81\x00\x05" + bytes([lacing << 1])
    if lacing == 1:
        head += bytes([2]) + b"\xff" + bytes([45, 20])
    elif lacing == 2:
        head += bytes([2])
    elif lacing == 3:
        head += bytes([2]) + matroska.size_field(300) + matroska.size_field(-280 + (1 << 13) - 1, 2)
    block = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, head + b"".join(frames)) + matroska.number(matroska.REFERENCE, 1))
    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.number(matroska.TIMESTAMP, 100) + block
    data = matroska.HEAD + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + matroska.TRACK_TABLE + unknown + unknown
    media = matroska.parse(data)
    assert [data[o : o + n] for _, _, o, n, _, _ in media.packets] == frames * 2
    assert media.packets[0][1] == 105 and not any(p[4] for p in media.packets) and len(media.clusters) == 2


def test_transcripts(spark, data):
    got = {r["conv_id"]: r for r in queries.op5_transcript_roles(spark, data).collect()}
    table = spark.read.parquet(f"{data}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = defaultdict(list)
    for r in table:
        want[r["conv_id"]].append(r["role"])
    assert sum(got[i]["roles"] == ",".join(x) for i, x in want.items()) >= 0.97 * len(want) and len(got) == len(want)
    model = transcripts.Model([("User: hi\n\nBot: hello\nmore", [1, 2, 5])] * 20)
    assert model.turns("Human: what?\n\nAI: that\nand this") == [("user", "what?"), ("assistant", "that\nand this")]
    assert model.turns(None) == model.turns("\n \n") == []
    odd = spark.createDataFrame([(1, 0, None, None), (1, 0, "user", "x"), (None, 1, "user", "y"), (2, 0, "robot", "z\n\nz")], "conv_id long, turn long, role string, text string")
    assert transcripts.parse(transcripts.logs(odd), transcripts.fit(transcripts.logs(odd))).count() == 2
    assert transcripts.parse(transcripts.logs(odd.limit(0)), transcripts.Model([])).count() == 0


def test_language_mixtures(spark, odd):
    en, fr = "the house and the garden are in the sun with a tree ", "la maison et le jardin sont dans le soleil avec un arbre "
    names, table = langid.fit([en * 3, fr * 3], ["en", "fr"])
    read = langid.Reader(names, table).read
    (a,), (b,), (c,), (d,) = (read([t]) for t in (en, fr, en * 3 + fr * 3, " 12 !! "))
    assert (a[0], a[2], b[0], b[2], d[0], d[1]) == ("en", ["en"], "fr", ["fr"], "und", 0.0)
    assert set(c[2]) == {"en", "fr"} and 0.3 < c[3][0] < 0.7
    got = {r["doc_id"]: r for r in langid.predict(odd, F.lit(True)).collect() if r["doc_id"] is not None}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[5]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.predict(odd, F.lit(False)).collect()} == {"und"}


def held(spark, name, sf="/root/testdata/sf0.01"):
    return queries.QUERIES[name](spark, sf).where("held_out"), spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")


def test_held_out_language(spark):
    found, _, docs = held(spark, "op9_language_mixture")
    j = found.join(docs.select("doc_id", "lang"), "doc_id")
    assert j.where("lang_pred = lang").count() >= 0.98 * j.count()


def test_held_out_quality(spark):
    found, labels, _ = held(spark, "op7_pairwise_quality")
    j = found.join(labels, "doc_id")
    assert j.where("predicted = quality").count() >= 0.95 * j.count()


def test_held_out_toxicity(spark):
    found, labels, docs = held(spark, "op2_toxic_spans")
    j = found.join(labels, "doc_id")
    assert j.where("predicted = toxic").count() >= 0.9 * j.count()
    spans = found.join(docs, "doc_id").where("size(spans) > 0").select(F.explode("spans").alias("s"), "text").collect()
    assert spans and all(0 <= r["s"]["begin"] < r["s"]["end"] <= len(r["text"]) and not r["text"][r["s"]["begin"] : r["s"]["end"]].isspace() for r in spans)


def test_chain_marginals_equal_enumeration():
    dice = np.random.default_rng(6)
    n, initial, moves, emission = 9, np.array([0.7, 0.3]), dice.uniform(0.2, 2, (2, 2)), dice.normal(size=9)
    first = np.zeros(n, bool)
    first[[0, 5]] = True
    total, ones = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        weight = np.prod([np.exp(emission[k] * y[k]) * (initial[y[k]] if first[k] else moves[y[k - 1], y[k]]) for k in range(n)])
        total += weight
        ones += weight * np.array(y)
    assert np.allclose(toxicity.marginals(emission, first, initial, moves), ones / total)


def test_classifiers_on_awkward_tables(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (3, 0, 1), (None, 1, 1), (5, None, None), (77, 1, 0)], "doc_id long, quality int, toxic int")
    n = odd.count()
    for some in (labels, labels.limit(0)):
        assert quality.rank(odd, some, crc_mod("doc_id", 3) != 9).where("score between 0 and 1").count() == n
        assert toxicity.tag(odd, some, crc_mod("doc_id", 5) != 9).where("score between 0 and 1").count() == n


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert not bpe.round_trip(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count()
    assert not repair.read_shards(repair.write_shards(none, P.path("word_bpe_49k.json"), 1)).count()
    assert not simhash.components(none).count() and not superkmers.digests(none).count() and not matroska.round_trip(none).count()
    assert not templates.contaminated(odd, items).count() and not templates.contaminated(none, items).count()
    assert not langid.predict(none, F.lit(True)).count()
