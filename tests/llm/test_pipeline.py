"""The pipeline against its stages' plain versions."""

import hashlib
import re

import pytest

import corpus_pipeline
from ledgerglass.llm import langid, simhash
from ledgerglass.llm.common import crc_mod
from pyspark.sql import functions as F

from .test_brute import plain_mixture

P = pytest.importorskip("public_tokenizers")


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    step = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, data).cache()
        step[name] = {r["doc_id"]: r["text"] for r in frame.collect()}
        assert frame.columns == docs.columns
    names, model = langid.learn(docs, crc_mod("doc_id", 4) != 2)
    shares = {r["doc_id"]: plain_mixture(r["text"] or "", names, model) for r in docs.collect()}
    letters = {r["doc_id"]: r["text"] for r in docs.collect() if shares[r["doc_id"]] and max(shares[r["doc_id"]].values()) >= 0.5}
    assert step["language"] == letters
    hashes = {i: simhash.shingle_hashes(t, 5) for i, t in letters.items()}
    prints, sets = {i: simhash.print_of(h) for i, h in hashes.items()}, {i: set(h.tolist()) for i, h in hashes.items()}

    def alike(a, b):
        return bin(prints[a] ^ prints[b]).count("1") <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    kept = step["near_duplicates"]
    assert all(any(alike(i, k) for k in letters if k != i) for i in letters if i not in kept)
    assert not [(a, b) for a in kept for b in kept if a < b and alike(a, b)]
    assert set(step["substrings"]) == set(kept)
    found = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, frame, data).collect()}
    assert set(found) == set(step["decontamination"])
    assert all(found[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in step["decontamination"].items())
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    plain = {i: " ".join(re.findall(r"\w+", (t or "").lower())) for i, t in step["decontamination"].items()}
    assert not [i for i, t in plain.items() for x in items if x in t]


def test_stages_on_awkward_rows(spark, data):
    """Null ids, null, empty, blank and very long texts, repeats, ties, a mixture without a main language, and columns named like inner ones."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    long = " ".join(r["text"] for r in docs.where("text is not null").orderBy("doc_id").limit(60).collect())
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) > 400").collect()}
    mixed = " ".join(w for group in zip(*(t.split()[:60] for t in texts.values())) for w in group)
    item = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    rows = [(None, "no id at all but letters"), (None, None), (900001, None), (900002, ""), (900003, " \n "), (900004, "12 34 !!"), (900005, long), (900006, long), (900006, long), (900006, mixed), (900007, mixed), (900008, f"Well, {item}"), (900008, "another text of that id"), (900009, "a" * 5000)]
    names = ("covers", "covers_", "leak", "language", "gone_id", "gone_hash", "h", "node", "text_hash", "item_id")
    kind = ", ".join(f"{c} {t}" for c, t in docs.dtypes)
    odd = spark.createDataFrame([tuple({"doc_id": i, "text": t}.get(c, None) for c in docs.columns) for i, t in rows], kind)
    odd = odd.unionByName(docs).withColumns({c: F.lit(k) for k, c in enumerate(names)})
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (odd, odd.limit(0)):
            out = stage(spark, frame, data)
            assert out.columns == odd.columns
            left[name, frame is odd] = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in out.collect())
        assert not left[name, False] and out.dtypes == odd.dtypes
    here = {name: [i for i, _ in found if i == -1 or i > 900000] for (name, full), found in left.items() if full}
    assert here["language"] == [-1, 900005, 900006, 900006, *[i for i, t in [(900006, mixed), (900007, mixed)] if (i, t) in left["language", True]], 900008, 900008, 900009]
    assert here["near_duplicates"] == [-1, -1, *[i for i in here["near_duplicates"] if i > 0]] and here["near_duplicates"].count(900006) <= 2 and 900007 not in here["near_duplicates"]
    assert len(left["substrings", True]) == odd.count()
    assert here["decontamination"].count(900008) == 0 and here["decontamination"].count(-1) == 2
    assert corpus_pipeline.STAGES[-1][1](spark, odd, data).count() == odd.count() and not corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), data).count()
