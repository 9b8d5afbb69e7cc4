"""SimHash fingerprints linked by vantage-point trees.

Fingerprints: 64-bit majority votes of XXH64 (seed 42) over word shingles. Equal fingerprints collapse first. A tree of
vantage points, built on a bounded sample of distinct fingerprints, deals the distinct ones into shards: left of a node
within its radius, right beyond it, and whatever lies within RADIUS of the border on the left is dealt to the right too,
so by the triangle inequality every linked pair meets in a shard. Shards that hold too many are dealt again by trees of
their own until none does. Shards search exactly by trees and return spanning links only (no more links than
fingerprints); rounds of star contraction join them across shards.

Null and empty texts have fingerprint zero and link like any other. Null doc_ids never name a component unless
it holds nothing else. Rows that repeat a doc_id keep their own fingerprints and rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, map_batches, settle, small_batches, texts_of

SEED, RADIUS = 42, 2
#: Distinct fingerprints that the driver takes (as expected by their hashes) to place the upper vantage points; fingerprints a shard should hold.
SAMPLE, SHARD_ROWS = 16_384, 24_576
#: Links (16 bytes each) up to which one task joins them.
ONE_TASK = 1 << 20
#: Shards that one tree deals to, at most.
SHARDS = 256
LEAF, CELLS = 768, 1 << 21
#: The share of hashes whose shingles are counted, the number of texts up to which a shingle is not common, and shingles taken as common, at most. They only order shingles; results never depend on them.
COUNTED, FEW, COMMON = 0.375, 3, 1 << 18
#: Pairs of different groups for each row of the index, up to which all are compared without looking for more leaders.
PAIRS_A_ROW = 4
#: Bits of a set's parity (a multiple of 64).
PARITY = 512
#: Ids up to which documents to compare are picked by a broadcast; more of them are shuffled.
BROADCAST_IDS = 500_000


def shingle_hashes(text: str, words_per_shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a whole text; ASCII case and white space do not count."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < words_per_shingle:
        shingles = iter([b" ".join(words)] if words else [])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)


def print_of(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += votes(hashes[at : at + (1 << 14)]).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(np.uint64)[0])


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text; zero for no words."""
    return print_of(shingle_hashes(text, words_per_shingle))


def prefix_of(distinct: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The first shingles of a set, common ones last, and how many are not common: two sets that are so similar share one of the first."""
    if not len(distinct):
        return distinct, 0
    rank = np.zeros(len(distinct), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, distinct), len(common) - 1)
        rank = np.where(common[at] == distinct, ranks[at], 0)
    least = math.ceil(similarity * len(distinct) - 1e-9)
    first = np.lexsort((distinct, rank))[: len(distinct) - least + 1]
    return distinct[first], int((rank[first] == 0).sum())


def parity(distinct: np.ndarray) -> np.ndarray:
    """Whether the shingles of each bucket are odd in number, as signed longs: two sets differ in as many shingles, or more, as their parities in bits."""
    odd = np.bincount((distinct >> np.uint64(32)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def node_of(distinct: np.ndarray) -> int:
    """What stands for a set of shingles; signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(distinct.tobytes(), SEED)).view(np.int64))


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fp (the unsigned bits as a signed long)."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, words_per_shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

        return apply

    small_batches(docs.sparkSession)
    return map_batches(docs.select("doc_id", "text"), make, "doc_id bigint, fp bigint")


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """Of a few candidates, the point whose median splits the points with the fewest near its border; None if no split helps."""
    best = None
    for to in points[:: max(1, len(points) // 8)][:8]:
        d = distances(points, to).astype(np.int64)
        for radius in {int(np.median(d)), int(np.median(d)) - 1}:
            left = int((d <= radius).sum())
            right = len(d) - int((d <= radius - RADIUS).sum())
            if radius >= 0 and 0 < left < len(d) and max(left, right) <= 0.85 * len(d) and (best is None or left + right < best[0]):
                best = (left + right, to, radius)
    return best and best[1:]


def sides(points: np.ndarray, to: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Who goes left and who goes right; points of the left within RADIUS of the right go to both."""
    d = distances(points, to).astype(np.int64)
    return d <= radius, d > radius - RADIUS


@dataclass
class Node:
    to: int = 0
    radius: int = 0
    left: Node | None = None
    right: Node | None = None
    shard: int = -1


def upper_tree(sample: np.ndarray, shards: int) -> tuple[Node, int]:
    """A tree with about so many leaves; the number it has."""
    count = 0

    def build(points: np.ndarray, want: int) -> Node:
        nonlocal count
        split = vantage(points) if want > 1 and len(points) >= 8 else None
        if split is None:
            count += 1
            return Node(shard=count - 1)
        left, right = sides(points, *split)
        return Node(int(split[0]), split[1], build(points[left], (want + 1) // 2), build(points[right], want // 2))

    return build(sample, shards), count


def deal(node: Node, points: np.ndarray, out: list) -> None:
    """(shard, points) for every shard that they reach."""
    if not len(points):
        return
    if node.left is None:
        out.append((node.shard, points))
        return
    left, right = sides(points, np.uint64(node.to), node.radius)
    deal(node.left, points[left], out)
    deal(node.right, points[right], out)


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least index of its class) after joining i and j pairwise."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := labels[labels], labels):
            labels = up
    return labels


def link(points: np.ndarray) -> np.ndarray:
    """For distinct fingerprints, the least index that each one reaches by steps of RADIUS bits at most."""
    labels, todo = np.arange(len(points)), [np.arange(len(points))]
    while todo:
        some = todo.pop()
        split = vantage(points[some]) if len(some) > LEAF else None
        if split is not None:
            left, right = sides(points[some], *split)
            todo += [some[left], some[right]]
            continue
        own = points[some]
        block = max(1, CELLS // max(1, len(own)))
        for at in range(0, len(own), block):
            i, j = np.nonzero(np.bitwise_count(own[at : at + block, None] ^ own[None, at:]) <= RADIUS)
            i, j = i[i < j], j[i < j]
            labels = merge(labels, some[at + i], some[at + j])
    return labels


def spanning_links(distinct: DataFrame) -> DataFrame:
    """hi, lo: links between distinct fingerprints that join all those within RADIUS bits, at most one per fingerprint and shard."""
    spark = distinct.sparkSession
    rows = distinct.count()
    # Those whose hash is low, about SAMPLE of them: what reaches the driver does not grow with partitions.
    low = F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(min(1.0, SAMPLE / max(1, rows)) * (1 << 40))
    sample = np.sort(np.array([r["fp"] for r in distinct.where(low).select("fp").collect()], np.int64)).view(np.uint64)
    tree, _ = upper_tree(sample, min(SHARDS, -(-rows // SHARD_ROWS)))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: list = []
            deal(tree, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), found)
            shards = np.repeat(np.array([s for s, _ in found], np.int64), [len(p) for _, p in found])
            return pa.RecordBatch.from_arrays([pa.array(shards), pa.array(np.concatenate([p for _, p in found]).view(np.int64))], ["shard", "fp"])

        return apply

    def split(shard: pa.Table) -> pa.Table:
        points = np.sort(shard.column("fp").to_numpy()).view(np.uint64)
        own, found = upper_tree(points[:: max(1, len(points) // SAMPLE)], min(SHARDS, -(-len(points) // SHARD_ROWS)))[0], []
        deal(own, points, found)
        names = np.repeat(np.array([s for s, _ in found], np.int64), [len(p) for _, p in found])
        return pa.table({"shard": shard.column("shard")[0].as_py() * SHARDS + names, "fp": np.concatenate([p for _, p in found]).view(np.int64)})

    def search(shard: pa.Table) -> pa.Table:
        points = np.sort(shard.column("fp").to_numpy())
        labels = link(points.view(np.uint64))
        linked = np.flatnonzero(labels != np.arange(len(points)))
        return pa.table({"hi": points[linked], "lo": points[labels[linked]]})

    small_batches(spark)
    dealt = map_batches(distinct.select("fp"), make, "shard bigint, fp bigint")
    if rows > SHARD_ROWS:
        dealt, before = settle(dealt, "shards"), math.inf
        # Splitting goes on while it helps; fingerprints that no vantage point parts stay together.
        while 2 * SHARD_ROWS < (most := dealt.groupBy("shard").count().agg(F.max("count")).first()[0]) < 0.9 * before:
            before, old = most, dealt
            dealt = settle(dealt.groupBy("shard").applyInArrow(split, "shard bigint, fp bigint"), "shards")
            discard(old)
    return dealt.groupBy("shard").applyInArrow(search, "hi bigint, lo bigint")


def joined_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hi, lo: every linked node that is not the least of its component, and the least."""
    held = pa.Table.from_batches(batches, pa.schema([("hi", pa.int64()), ("lo", pa.int64())]))
    ends = np.stack([held.column(c).to_numpy() for c in ("hi", "lo")])
    nodes, at = np.unique(ends, return_inverse=True)
    at = at.reshape(ends.shape)
    labels = merge(np.arange(len(nodes)), at[0], at[1])
    rest = np.flatnonzero(labels != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(nodes[labels[rest]])], ["hi", "lo"])


def contract(links: DataFrame) -> DataFrame:
    """From links (hi > lo) to node, root (the least node of its component) for all linked nodes.

    Few links are joined in one task. More take star contraction, which alternates large and small stars, each one grouped
    minimum and one join, and writes every round to the shared folder.
    """
    links, before = settle(links.where("hi > lo").distinct(), "links", small=True), None
    if links.count() <= ONE_TASK:
        few, links = links, settle(links.coalesce(1).mapInArrow(joined_links, "hi bigint, lo bigint"), "links")
        discard(few)
        roots = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        roots.settled_at = links.settled_at
        return roots
    while True:
        count, *mark = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")), F.min("hi"), F.max("lo")).first()
        if (count, mark) == before or not count:
            roots = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            roots.settled_at = links.settled_at
            return roots
        before = (count, mark)
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")))).alias("x"))
        old, links = links, settle(small.select("x.*").where("hi > lo").distinct(), "links", small=True)
        discard(old)


def name_components(prints: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of rows of (doc_id, fp)."""
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    roots = contract(spanning_links(distinct))
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    names = classes.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return prints.join(classes.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def components(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    return name_components(settle(fingerprints(docs, words_per_shingle), "fingerprints"))


def common_shingles(docs: DataFrame, words_per_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than FEW different texts have, ascending, and their ranks by that number (from 1).

    All documents are counted, for the shingles of the lower COUNTED of all hashes: prefixes hold the lowest ones, beside a few more.
    Texts are told apart by 64 bits of a mask, so copies of one text count once; the COMMON most frequent are taken.
    """
    below = np.uint64(int(COUNTED * (1 << 64)))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for text in texts_of(batch):
                hashes = shingle_hashes(text, words_per_shingle)
                found.append(np.unique(hashes[hashes < below]))
            masks = np.repeat(np.int64(1) << (batch.column(0).to_numpy(zero_copy_only=False) % 64), [len(f) for f in found])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(masks)], ["token", "mask"])

        return apply

    small_batches(docs.sparkSession)
    tokens = map_batches(docs.select(F.pmod(F.xxhash64("text"), F.lit(64)).alias("slot"), "text"), make, "token bigint, mask bigint")
    # Few tokens repeat within a task, so they are counted behind the shuffle only.
    counted = tokens.repartition("token").groupBy("token").agg(F.bit_count(F.bit_or("mask")).alias("texts"), F.count("*").alias("n")).where(F.col("texts") > FEW)
    counted = settle(counted, "common", small=True)
    found = counted.orderBy(F.desc("texts"), F.desc("n"), "token").limit(COMMON).select("token").toArrow()
    discard(counted)
    tokens = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], len(tokens) - order


def sketches(docs: DataFrame, words_per_shingle: int, similarity: float) -> DataFrame:
    """doc_id, text_hash, fp, node (stands for the set of shingles), shingles (number of distinct ones), prefix (shingles to find similar sets by), rare (how many of them are not common), parity."""
    common, ranks = common_shingles(docs, words_per_shingle)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes = [shingle_hashes(t, words_per_shingle) for t in texts_of(batch)]
            fp = np.array([print_of(h) for h in hashes], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            first = [prefix_of(u, common, ranks, similarity) for u in sets]
            prefix, rare = pa.array([p.view(np.int64) for p, _ in first], pa.list_(pa.int64())), pa.array([r for _, r in first], pa.int32())
            nodes, sizes = pa.array([node_of(u) for u in sets], pa.int64()), pa.array([len(u) for u in sets], pa.int32())
            bits = pa.array([parity(u) for u in sets], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp, nodes, sizes, prefix, rare, bits], ["doc_id", "text_hash", "fp", "node", "shingles", "prefix", "rare", "parity"])

        return apply

    small_batches(docs.sparkSession)
    known = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(known, make, "doc_id bigint, text_hash bigint, fp bigint, node bigint, shingles int, prefix array<bigint>, rare int, parity array<bigint>")


def shingle_sets(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """node, shingles: the distinct shingle hashes in order."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingle_hashes(t, words_per_shingle)) for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([pa.array([node_of(u) for u in sets], pa.int64()), pa.array([u.astype("<u8").tobytes() for u in sets], pa.binary())], ["node", "shingles"])

        return apply

    small_batches(docs.sparkSession)
    return map_batches(docs.select("doc_id", "text"), make, "node bigint, shingles binary")


def print_links(nodes: DataFrame) -> DataFrame:
    """hi, lo: links between nodes whose fingerprints are within RADIUS bits, enough to join them all."""
    distinct = settle(nodes.groupBy("fp").agg(F.min("node").alias("node")), "distinct")
    same = nodes.select("fp", F.col("node").alias("hi")).join(distinct.withColumnRenamed("node", "lo"), "fp").select("hi", "lo")
    near = spanning_links(distinct).join(distinct.toDF("hi", "a"), "hi").join(distinct.toDF("lo", "b"), "lo")
    return same.union(near.select(F.greatest("a", "b"), F.least("a", "b")))


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words_per_shingle: int, similarity: float) -> DataFrame:
    """hi, lo: those of the pairs whose shingle sets are so similar; a settled table."""
    asked = pairs.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    ids = settle(nodes.join(asked, "node").select("doc_id").distinct(), "ids", small=True)
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    # Rows that repeat a doc_id have sets of their own; rows that repeat a text have one.
    sets = shingle_sets(docs.select("doc_id", "text").join(some, "doc_id"), words_per_shingle)
    sets = sets.join(asked, "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(sets.toDF("lo", "b"), "lo").join(sets.toDF("hi", "a"), "hi").select("hi", "lo", "a", "b")

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            alike = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(common >= similarity * (len(x) + len(y) - common))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["hi", "lo"]).filter(pa.array(alike, pa.bool_()))

        return apply

    small_batches(docs.sparkSession)
    found = settle(map_batches(both, make, "hi bigint, lo bigint"), "similar")
    discard(ids)
    return found


def candidates(rows: DataFrame, some: DataFrame, similarity: float) -> DataFrame:
    """hi, lo: pairs of a row and one of `some` in different groups that share a token, once a shared token.

    Only where the token may be the first that both have (behind it, each holds enough for such a similarity) and the
    parities do not differ in more bits than such sets may in shingles.
    """
    other = some.toDF(*[c if c == "token" else f"{c}_b" for c in some.columns])
    sizes = F.col("shingles") + F.col("shingles_b")
    able = F.least("shingles", "shingles_b") >= similarity * F.greatest("shingles", "shingles_b") - 1e-6
    first = F.least(F.col("shingles") - F.col("place"), F.col("shingles_b") - F.col("place_b")) >= similarity / (1 + similarity) * sizes - 1e-6
    apart = sum((F.bit_count(F.col(f"parity{k}").bitwiseXOR(F.col(f"parity{k}_b"))) for k in range(PARITY // 64)), F.lit(0))
    near = apart <= (1 - similarity) / (1 + similarity) * sizes + 1e-6
    once = F.col("node") < F.col("node_b") if rows is some else F.lit(True)
    met = rows.join(other, "token").where((F.col("root") != F.col("root_b")) & once & able & first & near)
    return met.select(F.greatest("node", "node_b").alias("hi"), F.least("node", "node_b").alias("lo"))


def close(docs: DataFrame, nodes: DataFrame, labels: DataFrame, words_per_shingle: int, similarity: float) -> DataFrame:
    """node, root after joining all groups that hold a pair of sets so similar.

    Similar sets share shingles of their prefixes, so every pair of different groups that shares one where it can be the
    first is compared. Before that, the sets of each shingle are compared with the one of them that has the shingle
    nearest to its beginning, which joins copies of one text in linear work. If pairs of different groups are still many,
    other sets lead, until that no longer halves the pairs; then all of them are compared.
    """

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))

    tokens = rooted(nodes.select("node", "shingles", "prefix", "rare")).select("node", "shingles", "root", "rare", F.posexplode("prefix").alias("place", "token"))
    # Rare shingles meet in one shuffle; common ones, which would meet in few tasks, are a bounded number of groups.
    common = tokens.where("place >= rare")
    shared = common.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("token")
    here = Window.partitionBy("token")
    met = tokens.where("place < rare").drop("rare").select("*", F.min("root").over(here).alias("a"), F.max("root").over(here).alias("b")).where("a < b")
    columns = ["token", "node", "shingles", "place"]
    index, before, turn = settle(met.select(columns).union(common.join(F.broadcast(shared), "token").select(columns)), "index"), None, 0
    while True:
        all_rows = rooted(index)
        several = all_rows.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("most"))
        rows = all_rows.join(several.where("roots > 1").select("token", "most"), "token")
        rows = settle(rows.join(nodes.select("node", *[F.get("parity", F.lit(k)).alias(f"parity{k}") for k in range(PARITY // 64)]), "node"), "rows")
        size, pairs = rows.count(), 0
        if turn and size:
            pairs = candidates(rows, rows, similarity).count()
        if not size or (turn and not pairs):
            discard(rows)
            break
        every = turn > 0 and (pairs <= PAIRS_A_ROW * size or (before is not None and pairs > before / 2))
        before, turn = pairs or None, turn + 1
        if every:
            some = rows
        else:
            nearest = F.struct("place", "node") if turn == 1 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
            lead = (rows if turn == 1 else rows.where("root <> most")).groupBy("token").agg(F.min(nearest).alias("x")).select("token", "x.node")
            some = rows.join(lead, ["token", "node"]).select(rows.columns)
        asked = settle(candidates(rows, some, similarity).distinct(), "pairs", small=True)
        found = similar(docs, nodes, asked, words_per_shingle, similarity)
        old, labels = labels, contract(labels.toDF("hi", "lo").union(found))
        discard(old, rows, asked, found)
        if every:
            break
    discard(index)
    return labels


def keep_one(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group: the one with the least doc_id (of rows that repeat it, the one whose text hashes least). All columns stay.

    Documents group if their fingerprints link within RADIUS bits or their shingle sets are `similarity` alike; both
    kinds of links are closed together. Rows without an id stay as they are; of rows that repeat id and text, one stays.
    """
    prints = settle(sketches(docs, words_per_shingle, similarity), "sketches")
    nodes = settle(prints.groupBy("node").agg(*[F.min(c).alias(c) for c in ("doc_id", "fp", "shingles", "rare")], *[F.first(c).alias(c) for c in ("prefix", "parity")]), "nodes")
    labels = close(docs, nodes, contract(print_links(nodes)), words_per_shingle, similarity)
    rows = prints.select("doc_id", "text_hash", "node").join(labels, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
    rows = settle(rows.groupBy("doc_id", "text_hash", "root").agg(F.count("*").alias("copies")), "members")
    least = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select("x.*")
    gone = settle(rows.join(least, ["doc_id", "text_hash"], "left_anti").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")), "gone")
    repeated = rows.where("copies > 1").limit(1).count()
    discard(prints, nodes, rows, labels)
    kept = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")
    if not repeated:
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(kept.where("doc_id is null"))
