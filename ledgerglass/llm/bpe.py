"""Byte-level BPE over length-bucketed padded matrices.

Pieces (matches of the split pattern) of like length form the rows of one numpy matrix of token ids.
Each round, every row merges its leftmost pair of least rank; ranks come from an open-addressing hash table
of pairs; rows without a mergeable pair leave the matrix. Pieces beyond LONGEST bytes, for which rounds
cost the square of the length, take a heap of pairs that makes the same merges in the same order.

Null text: empty, no ids. Any text round-trips, as every byte has an id.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Memo, held, map_batches, slices, small_batches, texts_of

NONE = np.int32(2**31 - 1)
#: Bytes of the longest piece that goes into a matrix, and cells of the largest matrix.
LONGEST, CELLS = 192, 2_000_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: A space followed by another white-space character: there a text can't be cut at the space.
BEFORE_SPACE = re.compile(r" \s")
CUT = re.compile(r" (?=\S)")


class PairTable:
    """Open addressing with linear probes: (left id, right id) to the id of their concatenation."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, int(len(pairs) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64(2**bits - 1)
        self.keys, self.values = np.full(2**bits, -1, np.int64), np.full(2**bits, NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64).reshape(-1)
        values, slots = np.array(list(pairs.values()), np.int32), self.slot(keys)
        while len(keys):
            slots, first = np.where(self.keys[slots] == -1, slots, -1), slots
            _, chosen = np.unique(slots, return_index=True)
            chosen = chosen[slots[chosen] >= 0]
            self.keys[slots[chosen]], self.values[slots[chosen]] = keys[chosen], values[chosen]
            left = np.ones(len(keys), bool)
            left[chosen] = False
            keys, values, slots = keys[left], values[left], (first[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair, or NONE; a negative id is padding and pairs with nothing."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        keys[(left < 0) | (right < 0)] = -2
        slots = self.slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        slots = slots[open_]
        while len(open_):
            slots = (slots + 1) & self.mask
            held = self.keys[slots]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slots[hit]]
            on = ~hit & (held != -1)
            open_, slots = open_[on], slots[on]
        return out


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.spelling = pa.array(self.tokens, pa.large_binary())
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.table = PairTable(self.pairs)
        self.split = regex.compile(pattern).findall
        self.pieces = Memo(self.encode_pieces)
        self.chunks = Memo(self.encode_chunks)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each piece."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for i in np.flatnonzero(sizes > LONGEST):
            out[i] = self.encode_long(raw[i])
        width = 1
        low = 0
        while low < LONGEST:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(rows), max(1, CELLS // width)):
                self.encode_matrix(raw, rows[at : at + max(1, CELLS // width)], width, out)
            low, width = width, min(LONGEST, max(width + 1, width * 3 // 2))
        return out

    def encode_matrix(self, raw: list[bytes], rows: np.ndarray, width: int, out: list[bytes]) -> None:
        n = len(rows)
        text = np.frombuffer(b"".join([raw[i].ljust(width, b"\0") for i in rows]), np.uint8).reshape(n, width)
        sizes = np.fromiter((len(raw[i]) for i in rows), np.int64, n)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_ids[text], np.int32(-1))
        ranks = self.table.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            line = np.arange(len(rows))
            least = ranks[line, at] if ranks.shape[1] else np.full(len(rows), NONE)
            live = least < NONE
            if not live.all():
                done = ids[~live]
                full = done >= 0
                flat, ends = done[full].astype("<u4").tobytes(), (full.sum(1).cumsum() * 4).tolist()
                begin = 0
                for row, end in zip(rows[~live].tolist(), ends, strict=True):
                    out[row] = flat[begin:end]
                    begin = end
                rows, ids, ranks, at, least = rows[live], ids[live], ranks[live], at[live], least[live]
                if not len(rows):
                    return
                line = np.arange(len(rows))
            ids[line, at] = least
            keep = np.ones(ids.shape, bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            for side in (at - 1, at):
                some = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                ranks[some, side[some]] = self.table.ranks(ids[some, side[some]], ids[some, side[some] + 1])
            used = int((ids >= 0).any(0).sum())
            if used < ids.shape[1]:
                ids, ranks = ids[:, :used], ranks[:, : max(0, used - 1)]

    def encode_long(self, raw: bytes) -> bytes:
        """The same merges for one long piece, by a heap of (rank, place)."""
        ids, n = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist(), len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.pairs.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.pairs.get((rank, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := self.pairs.get((ids[before[i]], rank))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = [self.split(c) for c in chunks]
        return list(map(b"".join, self.pieces.fetch(split)))

    @staticmethod
    def cut(text: str) -> list[str]:
        """Chunks whose borders are always borders of the pattern's matches: before a space that a non-space follows."""
        parts = CUT.split(text) if BEFORE_SPACE.search(text) else text.split(" ")
        if len(parts) > 1 and parts[-1] == "":  # a space at the end is a match of its own, or ends one
            parts[-2:] = [parts[-2] + " "] if len(parts) == 2 else [parts[-2] + " "]
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text."""
        return [ids for some in slices(texts) for ids in self.encode_slice(some)]

    def encode_slice(self, texts: list[str]) -> list[bytes]:
        """Each distinct chunk is looked up once; the ids of a text are the bytes of its chunks end to end."""
        out: list[bytes] = [b""] * len(texts)
        odd = [k for k, t in enumerate(texts) if t.endswith(" ") or BEFORE_SPACE.search(t)]
        for k, chunks in zip(odd, self.chunks.fetch([self.cut(texts[k]) for k in odd]), strict=True):
            out[k] = b"".join(chunks)
        rest = sorted(set(range(len(texts))).difference(odd))
        if not rest:
            return out
        cut = pc.split_pattern(pa.array([texts[k] for k in rest], pa.large_string()), " ")
        edges, known = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        words, at = known.dictionary.to_pylist(), known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        begin, own = np.unique(at[edges[:-1]], return_inverse=True)  # a text's first chunk has no space before it
        at[edges[:-1]] = len(words) + own
        ids = self.chunks.of([" " + w for w in words]) + self.chunks.of([words[k] for k in begin.tolist()])
        for k, found in zip(rest, joined(pa.array(ids, pa.large_binary()), at, edges), strict=True):
            out[k] = found
        return out

    def decode(self, ids: bytes) -> bytes:
        return joined(self.spelling, np.frombuffer(ids, "<u4"), np.array([0, len(ids) // 4]))[0]


def joined(values: pa.Array, at: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """values[at], joined between the edges; values are large binaries."""
    taken = values.take(pa.array(at))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(at) + 1][edges].tolist() if len(at) else [0] * len(edges)
    raw = memoryview(taken.buffers()[2] or b"")
    return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]


def load(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker."""
    return held(("bpe", path, pattern), lambda: read(path, pattern))


def read(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return ByteBpe(ranks, pattern)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encode, decode the ids, and return the digests of both (columns of SCHEMA)."""

    def make():
        bpe = load(vocabulary, pattern)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = bpe.encode_texts(texts_of(batch))
            digests = [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *map(pa.array, digests)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return apply

    small_batches(docs.sparkSession)
    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)
