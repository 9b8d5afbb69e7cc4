"""Token-id output compressed by Re-Pair, in shards that allow random access.

A shard holds whole documents, SHARD_TOKENS ids or more. Re-Pair by rounds: each replaces all pairs of neighbouring
symbols that occur as often as a bound, the more frequent pair (then the lesser) winning where two overlap; the bound
halves from round to round, from half the most frequent pair down to two, and rounds of two go on until no pair occurs
twice or the 16-bit symbols are used up. Every rule replaces two occurrences or more. A shard's file form is one blob: header, rules (left and right symbol), expansion length of every rule, the
sequence, and the expanded length before every STEP-th symbol, so any id range decodes without the rest.
Blobs are rows of a Parquet table in the shared folder, in ascending doc_id order by (part, shard).

Null text is empty (only the end id), null doc_ids come first, rows with equal doc_ids follow the order of their texts.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_BYTES, Memo, held, shared_folder, slices, small_batches, texts_of, tidy

MAGIC, HEADER = b"RPG1", "<4sIIII"
SHARD_TOKENS, STEP, SYMBOLS = 1 << 20, 1024, 1 << 16
#: Slots (a power of two) of the hashed counts that tell which pairs can reach a bound at all.
SLOT_BITS = 18
SHARD_SCHEMA = "part int, shard int, part_start bigint, tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, data binary"
READ_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard_bytes bigint"

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Kinds of bytes: what parts chunks, letters (ASCII, and 0xC3 with what may follow), PUNCTUATION, all others.
SPACE, LETTER, MARKS, OTHER = range(4)
KINDS = bytes(SPACE if b in b" \n" else LETTER if b == 0xC3 or 0x80 <= b < 0xC0 or bytes([b]).isalpha() else MARKS if b in PUNCTUATION else OTHER for b in range(256))


class Encoder:
    """Word ids by the tokenizers library, end id appended.

    Normaliser and pre-tokenizer of the vocabulary never join characters across white space, so a text's ids are those
    of its chunks between spaces. Of a chunk of Latin letters with ASCII punctuation behind them, both parts are words of
    their own, and case does not count; what has letters alone needs no normaliser and no pattern, only the library's
    model. Chunks are cut into such pieces before they are told apart, and each distinct piece goes through the library
    once while the memo holds it. Texts that may hold a special token go through the library whole.
    """

    #: A word of one id that parts the words of a call.
    MARK = "\x01"

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > SYMBOLS:
            raise ValueError("terminals must fit 16 bits")
        self.plain_words = Tokenizer(self.library.model)
        self.plain_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.end, self.terminals = struct.pack("<H", end_id), self.library.get_vocab_size()
        (self.mark,) = self.library.encode(self.MARK, add_special_tokens=False).ids
        self.special = tuple({x.content[:2] for x in self.library.get_added_tokens_decoder().values()})
        suffix = self.library.model.end_of_word_suffix
        self.ends = np.zeros(SYMBOLS, bool)  # ids that end a word
        self.ends[[k for word, k in self.library.get_vocab().items() if word.endswith(suffix)]] = True
        self.pieces = Memo(self.encode_pieces, 36 << 20)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Of words of letters, in either case; many in one call, as a call costs more than a word."""
        out = []
        for at in range(0, len(words), 250):
            ids = np.array(self.plain_words.encode_batch_fast([" ".join(words[at : at + 250]).lower()], add_special_tokens=False)[0].ids, "<u2")
            ends, raw = (2 * np.flatnonzero(self.ends[ids]) + 2).tolist(), ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def encode_others(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            if any(self.MARK in w for w in some):
                out += [self.whole(w) for w in some]
                continue
            ids = np.array(self.library.encode_batch_fast([f" {self.MARK} ".join(some)], add_special_tokens=False)[0].ids, "<u2")
            marks = np.flatnonzero(ids == self.mark).tolist()
            raw = ids.tobytes()
            out += [raw[2 * a + 2 : 2 * b] for a, b in zip([-1, *marks], [*marks, len(ids)], strict=True)]
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        letters = [w.isalpha() and (w.isascii() or max(w) < "\u0130") for w in pieces]
        words = iter(self.encode_words([w for w, k in zip(pieces, letters, strict=True) if k]))
        others = iter(self.encode_others([w for w, k in zip(pieces, letters, strict=True) if not k]))
        return [next(words) if k else next(others) for k in letters]

    def cut(self, texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The pieces of all texts, and where each text's begin: the chunks between spaces, what is behind a chunk's letters on its own."""
        coded = [t.encode() for t in texts]
        joined = b" ".join(coded)
        raw, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(KINDS), np.uint8)
        before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))[: len(kind)]
        solid, solid_before = kind != SPACE, before != SPACE
        begin, end = np.flatnonzero(solid & ~solid_before), np.flatnonzero(~solid & solid_before)
        if len(end) < len(begin):
            end = np.append(end, len(raw))
        # Chunks of which no part is a word of its own: letters behind punctuation, or anything else.
        mixed = (kind == OTHER) | (before == MARKS) & (kind == LETTER)
        mixed[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # the signs of times and division
        whole = np.zeros(len(begin), bool)
        whole[np.searchsorted(begin, np.flatnonzero(mixed), "right") - 1] = True
        tails = np.flatnonzero((before == LETTER) & (kind == MARKS))
        chunk = np.searchsorted(begin, tails, "right") - 1
        tails, chunk = tails[~whole[chunk]], chunk[~whole[chunk]]
        after = np.cumsum(end - begin)
        at = after - (end - begin)  # of a chunk, without spaces
        places = np.sort(np.concatenate((at, at[chunk] + tails - begin[chunk], after[-1:])), kind="stable")
        starts = np.cumsum([0, *(len(c) + 1 for c in coded)])
        chunks = np.searchsorted(begin, starts)
        edges = chunks + np.searchsorted(tails, starts)
        if not len(begin):
            return pa.array([], pa.large_string()), edges
        return pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(raw[solid])), edges

    @staticmethod
    def plain(text: str) -> str:
        """Lower case for Latin-1 texts, where it is as the vocabulary's normaliser has it."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts end to end, and how many each has."""
        ids, sizes = [], []
        for some in slices(texts, BATCH_BYTES):
            odd = {k: self.whole(t) for k, t in enumerate(some) if any(x in t for x in self.special)}
            cut, edges = self.cut(["" if k in odd else self.plain(t) for k, t in enumerate(some)])
            known = cut.dictionary_encode()
            distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(known.dictionary)], known.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py()
            values = self.pieces.of(distinct.split(" ") if distinct else [])
            taken = pa.array(values, pa.large_binary()).take(known.indices)
            at = np.concatenate(([0], np.cumsum(pc.binary_length(taken).to_numpy())))[edges].tolist()
            raw = memoryview(taken.buffers()[2] or b"")
            for k in range(len(some)):
                own = odd.get(k, raw[at[k] : at[k + 1]])
                ids += [own, self.end]
                sizes.append(len(own) // 2 + 1)
        return np.frombuffer(b"".join(ids), "<u2"), sizes


def encoder(path: str, end_id: int) -> Encoder:
    return held(("repair", path, end_id), lambda: Encoder(path, end_id))


def places(chosen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key is in chosen, or -1: hash tables, one after another, each for the pairs that collided before."""
    out, open_, left = np.full(len(keys), -1, np.int32), np.arange(len(keys)), np.arange(len(chosen), dtype=np.int32)
    factor = np.uint32(0x9E3779B1)
    while len(left) and len(open_):
        table, slots = np.full(1 << 18, -1, np.int32), (chosen[left] * factor >> np.uint32(14)).astype(np.intp)
        table[slots] = left
        found = table.take((keys[open_] * factor >> np.uint32(14)).astype(np.intp))
        filled = np.flatnonzero(found >= 0)  # a pair whose slot is empty is none of those chosen
        open_, found = open_[filled], found[filled]
        hit = chosen[found] == keys[open_]
        out[open_[hit]] = found[hit]
        open_, left, factor = open_[~hit], left[table[slots] != left], np.uint32((int(factor) * 3 + 2) & 0xFFFFFFFF)
    return out


def pairs_of(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs as 32-bit keys, and their hashed slots."""
    keys = sequence[:-1].astype(np.uint32)
    keys <<= np.uint32(16)
    keys |= sequence[1:]
    slots = keys * np.uint32(0x9E3779B1)
    slots >>= np.uint32(32 - SLOT_BITS)
    return keys, slots.astype(np.intp)


def most_frequent(keys: np.ndarray, slots: np.ndarray, counts: np.ndarray, bound: int, most: int, guess: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places that hold all occurrences of the `most` pairs with the most, bound at least, the lesser first of equals; these pairs; the least of their numbers.

    Where symbols are nearly used up, few pairs are wanted of very many: a higher bound, guess at most, is tried first, and holds if enough pairs reach it.
    """
    reach = np.cumsum(np.bincount(counts)[::-1])[::-1]  # slots with as many occurrences or more
    least = max(bound, min(guess, int(np.count_nonzero(reach >= 2 * most)) - 1))
    while True:
        some = np.flatnonzero((counts >= least).take(slots))
        ordered = np.sort(keys[some])
        begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
        often = np.diff(np.append(begin, len(ordered)))
        enough = np.flatnonzero(often >= least)
        if least == bound or len(enough) >= most:
            enough = enough[np.argsort(-often[enough], kind="stable")[:most]]
            return some, ordered[begin[enough]], int(often[enough[-1]]) if len(enough) == most else bound
        least = max(bound, least * 3 // 4)


def winners(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of occurrences (place, rank of the pair, 0 first), those to replace: where two overlap, the better rank; of a run of one pair, every second."""
    left = np.ones(len(at), bool)
    won = np.zeros(len(at), bool)
    place = np.arange(len(at))
    while len(some := np.flatnonzero(left)):
        p, r = at[some], rank[some]
        joint = np.diff(p) == 1
        worse = np.zeros(len(some), bool)
        worse[1:] |= joint & (r[:-1] < r[1:])
        worse[:-1] |= joint & (r[1:] < r[:-1])
        first = np.concatenate(([True], ~(joint & (r[1:] == r[:-1]))))  # of a run of one pair
        line = place[: len(some)]
        odd = (line - np.maximum.accumulate(np.where(first, line, 0))) % 2 == 1
        run = np.cumsum(first) - 1
        beaten = np.zeros(run[-1] + 1, bool)
        beaten[run[worse]] = True  # a run whose end is beaten waits for the next turn
        take = ~beaten[run] & ~odd
        won[some[take]] = True
        gone = take | (~beaten[run] & odd)
        gone[1:] |= joint & take[:-1]
        gone[:-1] |= joint & take[1:]
        left[some[gone]] = False
    return won


def compress(ids: np.ndarray, terminals: int) -> bytes:
    """Re-Pair of one shard's ids (uint16)."""
    rules, lengths, sequence, total = [], np.ones(SYMBOLS, np.uint32), ids, terminals
    keys, slots = pairs_of(sequence)
    counts = np.bincount(slots, minlength=1 << SLOT_BITS)
    bound, guess = max(2, int(counts.max(initial=0)) // 2), len(ids)
    while len(keys) and total < SYMBOLS:
        some, chosen, guess = most_frequent(keys, slots, counts, bound, SYMBOLS - total, guess)
        rank = places(chosen, keys[some])
        at, rank = some[rank >= 0], rank[rank >= 0]
        won = winners(at, rank)
        times = np.bincount(rank[won], minlength=len(chosen))
        used = times >= 2
        if not used.any():
            if bound == 2:
                break
            bound = max(2, bound // 2)
            continue
        won &= used[rank]
        at, symbol = at[won], (total - 1 + np.cumsum(used))[rank[won]].astype(np.uint16)
        left, right = (chosen[used] >> np.uint32(16)).astype(np.uint16), (chosen[used] & np.uint32(0xFFFF)).astype(np.uint16)
        rules.append(np.stack([left, right], 1))
        lengths[total : total + len(left)] = lengths[left] + lengths[right]
        total += len(left)
        sequence = sequence.copy()
        sequence[at] = symbol
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence = sequence[keep]
        keys, slots = pairs_of(sequence)
        counts, bound = np.bincount(slots, minlength=1 << SLOT_BITS), max(2, bound // 2)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)
    before = np.concatenate(([0], np.cumsum(lengths[sequence], dtype=np.uint64)[:-1])).astype("<u8")[::STEP] if len(sequence) else np.zeros(0, "<u8")
    head = struct.pack(HEADER, MAGIC, terminals, len(table), len(sequence), len(before))
    return head + table.astype("<u2").tobytes() + lengths[terminals:total].astype("<u4").tobytes() + sequence.astype("<u2").tobytes() + before.tobytes()


class Shard:
    """Reads one blob."""

    def __init__(self, data: bytes):
        magic, self.terminals, n_rules, n, n_before = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize(HEADER)
        self.rules = np.frombuffer(data, "<u2", 2 * n_rules, at).reshape(-1, 2)
        at += 4 * n_rules
        rule_lengths = np.frombuffer(data, "<u4", n_rules, at)
        at += 4 * n_rules
        self.sequence = np.frombuffer(data, "<u2", n, at)
        self.before = np.frombuffer(data, "<u8", n_before, at + 2 * n)
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), rule_lengths.astype(np.int64)])
        self.flat, self.starts = self.expand_rules()

    def expand_rules(self) -> tuple[np.ndarray, np.ndarray]:
        """The expansion of every symbol, end to end; a rule only uses symbols before it, so waves of ready rules fill it."""
        starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        flat = np.zeros(int(self.lengths.sum()), "<u2")
        flat[: self.terminals] = np.arange(self.terminals)
        ready = np.zeros(len(self.lengths), bool)
        ready[: self.terminals] = True
        left, right = self.rules[:, 0].astype(np.int64), self.rules[:, 1].astype(np.int64)
        while len(open_ := np.flatnonzero(~ready[self.terminals :])):
            now = open_[ready[left[open_]] & ready[right[open_]]]
            own = now + self.terminals
            for part, to in ((left[now], starts[own]), (right[now], starts[own] + self.lengths[left[now]])):
                size = self.lengths[part]
                within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                flat[np.repeat(to, size) + within] = flat[np.repeat(starts[part], size) + within]
            ready[own] = True
        return flat, starts

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.lengths[symbols]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[np.repeat(self.starts[symbols], size) + within]

    def ids(self) -> np.ndarray:
        return self.expand(self.sequence)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard; only the symbols from the nearest sample on are expanded."""
        stop = max(start, stop)
        step = max(0, int(np.searchsorted(self.before, start, "right")) - 1)
        last = int(np.searchsorted(self.before, stop, "left"))
        found = self.expand(self.sequence[step * STEP : last * STEP])
        begin = start - int(self.before[step]) if len(self.before) else 0
        return found[begin : begin + stop - start]


def write_shards(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Encode all texts, write them in ascending doc_id order as shards, and return the table that was written.

    One range shuffle of the texts; each task then streams its sorted documents into shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(vocabulary, end_id), TaskContext.get().partitionId()
        doc_ids: list = []
        sizes: list[int] = []
        held_: list[np.ndarray] = []
        shard, start, total = 0, 0, 0

        def flush() -> pa.RecordBatch:
            row = [[part], [shard], [start], [total], [doc_ids], [sizes], [compress(np.concatenate(held_), words.terminals)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "shard", "part_start", "tokens", "doc_ids", "doc_tokens", "data"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            ids, counts = words.texts(texts_of(batch))
            begin = 0
            for doc_id, n in zip(batch.column(0).to_pylist(), counts, strict=True):
                doc_ids.append(doc_id)
                sizes.append(n)
                held_.append(ids[begin : begin + n])
                total, begin = total + n, begin + n
                if total >= SHARD_TOKENS:
                    yield flush()
                    shard, start, total = shard + 1, start + total, 0
                    doc_ids, sizes, held_ = [], [], []
        if doc_ids:
            yield flush()

    spark = docs.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    with tidy(spark):
        ordered.mapInArrow(run, SHARD_SCHEMA).write.parquet(path)
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document: its start among all ids, its ids' number and crc32 as unsigned 32-bit little-endian integers.

    A part's ids are counted from the small columns alone: a row for each range partition, whose number the shuffle setting bounds.
    """
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("of_part"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(ahead), F.lit(0)).alias("ahead"))
    placed = shards.join(F.broadcast(parts), "part").select((F.col("ahead") + F.col("part_start")).alias("start"), "doc_ids", "doc_tokens", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, sizes, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = Shard(data).ids().astype("<u4")
                raw, ends = memoryview(ids.tobytes()), np.cumsum(sizes)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes, strict=True)]
                starts = start + ends - np.array(sizes)
                columns = [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array([len(data)] * len(sizes), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "shard_bytes"])

    small_batches(shards.sparkSession)
    return placed.mapInArrow(run, READ_SCHEMA)
