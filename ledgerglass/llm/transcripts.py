"""Roles of raw chat transcripts by a hidden Markov model, and canonical rendering of the turns.

A transcript is text whose turns may begin with a speaker marker ("User:", "**Assistant:**", "[system]", "Q:", ...),
may have lost it, and may run over several lines. States are role x (begins a turn, goes on); a line shows its marker
class, whether a blank line stands before it, its length and whether it asks. Start, move and emission probabilities are
smoothed counts, taken on executors from about SAMPLE labelled conversations; Viterbi finds the states of all lines of a
whole transcript (of equally likely ones, the state named first: system, user, assistant, then going on). Turns are
rendered as `<|role|>`, a newline, the text, `<|end|>` and a newline; blank lines inside a turn stay, those around it go.

Null or empty transcripts have no turns. Turns without a number come first, those with the same one follow role, then
text. Null text is empty, and an empty turn keeps its marker; null or unknown roles count as user. Rows without conv_id
belong to no conversation and are left out. A conversation is one row, as Viterbi needs the whole of it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches

ROLES = ("system", "user", "assistant")
SAMPLE = 1000
#: Marker words of each role (fixed values).
WORDS = {"system": ("system", "sys", "instruction", "instructions", "prompt"), "user": ("user", "human", "q", "question", "customer", "me"), "assistant": ("assistant", "ai", "bot", "a", "answer", "model", "agent")}
CLASS = {w: k for k, role in enumerate(ROLES) for w in WORDS[role]}
MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*{1,2}|\[|<\|?|>\s*)?([A-Za-z]{1,14})(?:\*{1,2}\s*:|:\s*\*{0,2}|\]\s*:?|\|?>\s*:?|\s+-\s)\s*")
NONE, OTHER, MARKERS, LENGTHS = 3, 4, 5, 4
SCHEMA = "conv_id bigint, n_turns bigint, roles array<string>, texts array<string>, rendered string"


def look(line: str) -> tuple[int, str]:
    """Marker class of a line, and what follows the marker."""
    found = MARKER.match(line)
    if not found:
        return NONE, line
    kind = CLASS.get(found[1].lower())
    return (OTHER, line) if kind is None else (kind, line[found.end() :])


def lines_of(transcript: str | None) -> tuple[list[tuple[int, int, int, int]], list[str], list[str]]:
    """Features of every line that is not blank; its text with the blank lines before it; its text without the marker."""
    seen, raw, bare, blank = [], [], [], ""
    for line in (transcript or "").split("\n"):
        if not line.strip():
            blank += line + "\n"
            continue
        kind, rest = look(line)
        words = len(rest.split())
        seen.append((kind, int(bool(blank) or not raw), min(LENGTHS - 1, words.bit_length() // 2), int(rest.rstrip().endswith("?"))))
        raw.append(blank + line)
        bare.append(rest)
        blank = ""
    return seen, raw, bare


class Model:
    """States 0-2 begin a turn of a role, 3-5 go on with it."""

    SIZES = (MARKERS, 2, LENGTHS, 2)

    def __init__(self, labelled: list[tuple[str, list[int]]] | np.ndarray):
        """From labelled transcripts, or from the sum of their counts."""
        counts = labelled if isinstance(labelled, np.ndarray) else self.counts(labelled)
        start, moves, *emissions = self.parts(counts)
        allowed = np.array([[b < 3 or a % 3 == b % 3 for b in range(6)] for a in range(6)])
        with np.errstate(divide="ignore"):
            self.start = np.log(np.where(np.arange(6) < 3, start + 1, 0) / (start[:3].sum() + 3))
            moves = np.where(allowed, moves + 0.2, 0)
            self.moves = np.log(moves / moves.sum(1, keepdims=True))
        self.emissions = [np.log((t + 0.2) / (t + 0.2).sum(1, keepdims=True)) for t in emissions]

    @classmethod
    def parts(cls, flat: np.ndarray) -> list[np.ndarray]:
        """Start, moves and emission tables within one flat array, as views."""
        shapes, out, at = [(6,), (6, 6), *((6, n) for n in cls.SIZES)], [], 0
        for shape in shapes:
            size = int(np.prod(shape))
            out.append(flat[at : at + size].reshape(shape))
            at += size
        return out

    @classmethod
    def counts(cls, labelled: list[tuple[str, list[int]]]) -> np.ndarray:
        flat = np.zeros(42 + 6 * sum(cls.SIZES))
        start, moves, *emissions = cls.parts(flat)
        for transcript, states in labelled:
            seen, _, _ = lines_of(transcript)
            for k, (features, state) in enumerate(zip(seen, states, strict=True)):
                if k:
                    moves[states[k - 1], state] += 1
                else:
                    start[state] += 1
                for table, x in zip(emissions, features, strict=True):
                    table[state, x] += 1
        return flat

    def viterbi(self, seen: list[tuple[int, int, int, int]]) -> list[int]:
        if not seen:
            return []
        x = np.array(seen)
        e = sum(table[:, x[:, k]] for k, table in enumerate(self.emissions)).T
        best, back = self.start + e[0], np.zeros(x.shape[:1] + (6,), np.int8)
        for t in range(1, len(x)):
            through = best[:, None] + self.moves
            back[t] = through.argmax(0)
            best = through[back[t], np.arange(6)] + e[t]
        path = [int(best.argmax())]
        for t in range(len(x) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        return path[::-1]

    def turns(self, transcript: str | None) -> list[tuple[str, str]]:
        seen, raw, bare = lines_of(transcript)
        out: list[tuple[str, list[str]]] = []
        for state, with_, without in zip(self.viterbi(seen), raw, bare, strict=True):
            if state < 3 or not out:
                out.append((ROLES[state % 3], [without]))
            else:
                out[-1][1].append(with_)
        return [(role, "\n".join(lines)) for role, lines in out]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns)


#: How the raw logs of the query mark the roles: (system, user, assistant).
STYLES = [("System: ", "User: ", "Assistant: "), ("**System:** ", "**Human:** ", "**Assistant:** "), ("[system] ", "[user] ", "[assistant] "), ("### Instruction: ", "### Question: ", "### Answer: "), ("<|system|> ", "<|user|> ", "<|assistant|> "), ("SYSTEM - ", "Q - ", "A - ")]


def log_of(conv_id: int, turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """A raw transcript of known turns, and the states of its lines: the style follows the conversation, and from the second turn on some markers are lost."""
    style = STYLES[hashlib.blake2b(str(conv_id).encode(), digest_size=2).digest()[0] % len(STYLES)]
    blocks, states = [], []
    for k, (role, text) in enumerate(turns):
        number = ROLES.index(role) if role in ROLES else 1
        lines = text.strip().split("\n")
        lost = k and text.strip() and hashlib.blake2b(f"{conv_id} {k}".encode(), digest_size=1).digest()[0] < 26
        blocks.append(("" if lost else style[number]) + "\n".join(lines))
        states += [number] + [number + 3] * (sum(bool(x.strip()) for x in lines) - 1)
    return "\n\n".join(blocks), states


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of turn, role, text in order): one shuffle on conv_id."""
    turns = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turns)).alias("turns"))


def logs(rows: DataFrame) -> DataFrame:
    """conv_id, transcript, roles: raw logs made of the table's turns, and the roles that the parser should find."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [log_of(i, [(t["role"], t["text"]) for t in turns]) for i, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in made], pa.string()), pa.array([y for _, y in made], pa.list_(pa.int32()))], ["conv_id", "transcript", "states"])

        return apply

    small_batches(rows.sparkSession)
    return map_batches(conversations(rows), make, "conv_id bigint, transcript string, states array<int>")


def fit(raw: DataFrame) -> Model:
    """From about SAMPLE labelled transcripts (those whose ids hash low), however many there are; executors count."""
    low = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 40)) < int(min(1.0, SAMPLE / max(1, raw.count())) * (1 << 40))

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = Model.counts(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found)], ["k", "n"])

        return apply

    small_batches(raw.sparkSession)
    total = Model.counts([])
    for r in map_batches(raw.where(low).select("transcript", "states"), make, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():
        total[r["k"]] = r["n"]
    return Model(total)


def parse(raw: DataFrame, model: Model) -> DataFrame:
    """conv_id, n_turns, roles, texts, rendered of (conv_id, transcript)."""
    shared = raw.sparkSession.sparkContext.broadcast(model)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shared.value.turns(t) for t in batch.column(1).to_pylist()]
            columns = [[len(x) for x in found], [[r for r, _ in x] for x in found], [[t for _, t in x] for x in found], list(map(render, found))]
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["conv_id", "n_turns", "roles", "texts", "rendered"])

        return apply

    small_batches(raw.sparkSession)
    return map_batches(raw.select("conv_id", "transcript"), make, SCHEMA)
