"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript is lines of text, with speaker markers in many styles or none. Each
role has two hidden states, for a line that opens a turn and one that goes on.
What is seen of a line is the marker at its front, whether it is blank or follows
a blank line, how long it is and how it ends. Probabilities are counted on
transcripts whose roles are known; Viterbi gives the best states of a transcript,
and its lines are put together as turns in one canonical form.

A long transcript is cut into parts, and the cuts do not change the result. Every
part first gives its best score, and its number of turns, from each state to each
state; these small tables are joined along the transcript to find the states at
the cuts, and every part is then traced back between its own two. So no task ever
holds more than a part's text, whatever a conversation's length.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
PART_TURNS = 512
#: Known transcripts that probabilities are counted on, at most.
SAMPLE = 20_000

#: Speaker words by the role they stand for.
_SPEAKERS = {
    "system": ("system", "instruction", "instructions", "sys"),
    "user": ("user", "human", "question", "q", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model"),
}
_ROLE_OF = {word: role for role, words in _SPEAKERS.items() for word in words}
_WORDS = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
_MARKER = re.compile(
    rf"(?ai)\s*(?:<\|(?P<a>{_WORDS})\|>|\[(?P<b>{_WORDS})\]:?|#+\s*(?P<c>{_WORDS})\s*:?\s*$|\*\*(?P<d>{_WORDS}):?\*\*:?|(?P<e>{_WORDS})\s*:)\s*"
)
N_STATES = 2 * len(ROLES)
#: Values of each feature of a line: marker role or none, blank, blank before, length, ending.
_SIZES = (len(ROLES) + 1, 2, 2, 6, 4)


def marker(line: str) -> tuple[str | None, str]:
    """The role that a marker at a line's front names, and the line without the marker."""
    m = _MARKER.match(line)
    if not m:
        return None, line
    return _ROLE_OF[next(x for x in m.groups() if x).lower()], line[m.end() :]


def features(lines: Sequence[str], before: str | None) -> np.ndarray:
    """A row of feature values for each line; before is the line that comes ahead of them."""
    out = np.zeros((len(lines), len(_SIZES)), np.int64)
    blank_before = int(before is not None and not before.strip())
    for i, line in enumerate(lines):
        role, rest = marker(line)
        text = rest.strip()
        out[i, 0] = 0 if role is None else 1 + ROLES.index(role)
        out[i, 1] = not line.strip()
        out[i, 2] = blank_before
        out[i, 3] = min(5, len(text).bit_length() // 2)
        out[i, 4] = 0 if not text else 1 if text[-1] == "?" else 2 if text[-1] in ".!" else 3
        blank_before = out[i, 1]
    return out


@dataclass
class Model:
    """Log probabilities: first state, next state, and each feature's value by state."""

    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    @staticmethod
    def counted(start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]) -> "Model":
        """From counts, one added to each; a first line opens a turn, and one goes on only in its own role."""
        allowed = np.ones((N_STATES, N_STATES), bool)
        for s in range(N_STATES):
            for t in range(1, N_STATES, 2):
                allowed[s, t] = s // 2 == t // 2
        step = np.where(allowed, step + 1.0, 0)
        start = np.where(np.arange(N_STATES) % 2 == 0, start + 1.0, 0)
        with np.errstate(divide="ignore"):
            return Model(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), [np.log((e + 1.0) / (e + 1.0).sum(axis=1, keepdims=True)) for e in emit])

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(e[:, seen[:, k]] for k, e in enumerate(self.emit)).T

    def table(self, seen: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best score from the state before (any, when first) to each last state, and that path's turns and first state."""
        score = self.scores(seen)
        opens = np.arange(N_STATES) % 2 == 0
        value = np.tile(self.start, (N_STATES, 1)) if first else self.step.copy()
        value += score[0]
        turns = np.tile(opens.astype(np.int64), (N_STATES, 1))
        heads = np.tile(np.arange(N_STATES), (N_STATES, 1))
        for row in score[1:]:
            every = value[:, :, None] + self.step[None]
            best = every.argmax(axis=1)
            value = np.take_along_axis(every, best[:, None, :], 1)[:, 0] + row
            turns = np.take_along_axis(turns, best, 1) + opens
            heads = np.take_along_axis(heads, best, 1)
        return value, turns, heads

    def trace(self, seen: np.ndarray, before: int, last: int) -> list[int]:
        """The best states between the state before (-1: none) and the last one."""
        score = self.scores(seen)
        value = (self.start if before < 0 else self.step[before]) + score[0]
        back = []
        for row in score[1:]:
            every = value[:, None] + self.step
            back.append(every.argmax(axis=0))
            value = every.max(axis=0) + row
        path = [last]
        for best in reversed(back):
            path.append(int(best[path[-1]]))
        return path[::-1]


def canonical(role: str, text: str, opens: bool = True, closes: bool = True) -> str:
    """One turn in the canonical form; what looks like its marks in the text is kept apart by a second bar."""
    body = text.replace("<|", "<||")
    return (f"<|{role}|>\n" if opens else "") + body + "\n" + ("<|end|>\n" if closes else "")


_PART_KEY = "conv_id long, part long"


def _lines(table: pa.Table) -> tuple[list[str], str | None]:
    """The lines of a part in order, and the one before them."""
    order = np.lexsort((table["order"].to_numpy(),))
    rows = table.take(pa.array(order))
    lines = [line for text in rows["text"].to_pylist() for line in (text or "").split("\n")]
    before = rows["before"][0].as_py()
    return lines, None if before is None else before.rsplit("\n", 1)[-1]


def transcript_parts(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """Pieces of transcripts, keyed for parse(): conv_id, part, order, text, and the piece before a part's first.

    Pieces are put in order of turn, then text; a null turn comes last, a null text
    is an empty line. A piece's part is its turn's, so no sort spans a conversation.
    """
    place = F.coalesce(F.col(turn).cast("long"), F.lit((1 << 62)))
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = rows.select(F.col(conv).cast("long").alias("conv_id"), F.floor(place / part_turns).cast("long").alias("part"), place.alias("place"), body.alias("text"))
    inside = Window.partitionBy("conv_id", "part").orderBy("place", "text")
    numbered = keyed.withColumn("order", F.row_number().over(inside))
    ends = numbered.groupBy("conv_id", "part").agg(F.max_by("text", "order").alias("last"))
    ahead = Window.partitionBy("conv_id").orderBy("part")
    before = ends.select(F.col("conv_id").alias("of"), F.col("part").alias("at"), F.lag("last").over(ahead).alias("before"))
    match = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))
    return numbered.join(before, match).select("conv_id", "part", "order", "text", "before")


def train(rows: DataFrame, raw: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", sample: int = SAMPLE) -> Model:
    """Counts on conversations whose roles are all known; raw is a row's transcript text.

    At most `sample` conversations, chosen by a hash of their ids, each by its first
    part; rows with a null id, turn, text or an unknown role take their conversation out.
    """
    own = rows.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.array_position(F.array(*map(F.lit, ROLES)), F.col(role)).cast("int").alias("role"),
        raw.alias("text"),
    ).filter(F.col("turn") < PART_TURNS)
    bad = F.max(F.when(F.col("turn").isNull() | F.col("text").isNull() | (F.coalesce("role", F.lit(0)) == 0), 1).otherwise(0))
    good = own.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(bad.alias("bad")).filter("bad = 0")
    chosen = good.orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample).select("conv_id")
    columns = N_STATES * (1 + N_STATES + sum(_SIZES))

    def count(table: pa.Table) -> pa.Table:
        out = np.zeros(columns)
        part = table.to_pandas().sort_values(["turn", "text"])
        _count_one(part["role"].tolist(), part["text"].tolist(), out)
        return pa.table({"at": np.flatnonzero(out), "n": out[np.flatnonzero(out)]})

    counts = own.join(chosen, "conv_id").groupBy("conv_id").applyInArrow(count, "at long, n double")
    total = np.zeros(columns)
    for row in counts.groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[row["at"]] = row["n"]
    start, step = total[:N_STATES], total[N_STATES : N_STATES * (1 + N_STATES)].reshape(N_STATES, N_STATES)
    emit, at = [], N_STATES * (1 + N_STATES)
    for size in _SIZES:
        emit.append(total[at : at + N_STATES * size].reshape(N_STATES, size))
        at += N_STATES * size
    return Model.counted(start, step, emit)


def _count_one(roles: list[int], texts: list[str], out: np.ndarray) -> None:
    lines, states = [], []
    for role, text in zip(roles, texts):
        own = text.split("\n")
        lines += own
        states += [2 * (role - 1)] + [2 * (role - 1) + 1] * (len(own) - 1)
    seen = features(lines, None)
    out[states[0]] += 1
    for a, b in zip(states, states[1:]):
        out[N_STATES + a * N_STATES + b] += 1
    at = N_STATES * (1 + N_STATES)
    for k, size in enumerate(_SIZES):
        np.add.at(out, at + np.array(states) * size + seen[:, k], 1)
        at += N_STATES * size


def parse(parts: DataFrame, model: Model) -> DataFrame:
    """Recovered turns of transcript_parts(): conv_id, turn from 0, part, role, text, rendered.

    A turn that runs over a part's end gives a row in each part, with the same
    number; the first is rendered with its opening, the last with its end. Pieces of a null conv_id make one transcript. Empty input gives no rows.
    """
    sent = parts.sparkSession.sparkContext.broadcast(model)

    def tables(table: pa.Table) -> pa.Table:
        lines, before = _lines(table)
        best = sent.value.table(features(lines, before), before is None)
        return pa.table({"conv_id": table["conv_id"].slice(0, 1), "part": table["part"].slice(0, 1)} | {name: [x.tobytes()] for name, x in zip(("value", "turns", "heads"), best)})

    def cuts(table: pa.Table) -> pa.Table:
        rows = table.take(pa.array(np.argsort(table["part"].to_numpy(), kind="stable")))
        value, opened, heads = ([np.frombuffer(x, kind).reshape(N_STATES, N_STATES) for x in rows[name].to_pylist()] for name, kind in (("value", float), ("turns", np.int64), ("heads", np.int64)))
        score, back = value[0][0], []
        for one in value[1:]:
            every = score[:, None] + one
            back.append(every.argmax(axis=0))
            score = every.max(axis=0)
        last = [int(score.argmax())]
        for best in reversed(back):
            last.append(int(best[last[-1]]))
        last.reverse()
        entry = [-1, *last[:-1]]
        path = [(max(e, 0), s) for e, s in zip(entry, last)]
        ahead = np.cumsum([0, *[int(x[at]) for x, at in zip(opened, path)]])[:-1]
        closes = [int(x[at]) % 2 == 0 for x, at in zip(heads, path)][1:] + [True]
        return pa.table({"conv_id": rows["conv_id"], "part": rows["part"], "entry": pa.array(entry, pa.int32()), "last": pa.array(last, pa.int32()), "opened": pa.array(ahead, pa.int64()), "closes": closes})

    def turns(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [] for name in ("turn", "role", "text", "opens")}
        closes = True
        if left.num_rows:
            lines, before = _lines(left)
            entry, last, opened, closes = (right[name][0].as_py() for name in ("entry", "last", "opened", "closes"))
            path = sent.value.trace(features(lines, before), entry, last)
            number = opened - 1
            for line, state in zip(lines, path):
                opens = state % 2 == 0
                number += opens
                if opens or not out["turn"]:
                    out["turn"].append(number)
                    out["role"].append(ROLES[state // 2])
                    out["text"].append([marker(line)[1] if opens else line])
                    out["opens"].append(opens)
                else:
                    out["text"][-1].append(line)
        n = len(out["turn"])
        texts = ["\n".join(x).strip("\n") for x in out["text"]]
        return pa.table(
            {
                "conv_id": pa.array([left["conv_id"][0].as_py()] * n if n else [], pa.int64()),
                "turn": pa.array(out["turn"], pa.int64()),
                "part": pa.array([left["part"][0].as_py()] * n if n else [], pa.int64()),
                "role": pa.array(out["role"], pa.string()),
                "text": pa.array(texts, pa.string()),
                "rendered": pa.array([canonical(r, t, o, closes or k < n - 1) for k, (r, t, o) in enumerate(zip(out["role"], texts, out["opens"]))], pa.string()),
            }
        )

    scored = parts.groupBy("conv_id", "part").applyInArrow(tables, f"{_PART_KEY}, value binary, turns binary, heads binary")
    found = scored.groupBy("conv_id").applyInArrow(cuts, f"{_PART_KEY}, entry int, last int, opened long, closes boolean")
    pieces = parts.groupBy("conv_id", "part").cogroup(found.groupBy("conv_id", "part"))
    return pieces.applyInArrow(turns, "conv_id long, turn long, part long, role string, text string, rendered string")
