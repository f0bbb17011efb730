"""Substring dedup by level-wise doubling of repeated word windows.

Levels are window lengths that double up to the length asked for (7 and 13; 7,
13, 25 and 50; ...). A window goes on to the next level only where the windows of
half its length in it all occur in more than one document; a level without
candidates sends nothing on, and the levels above it are empty. The first level
looks at anchors alone: in every window of the second level, its first-level
windows of least hash. Equal windows have equal anchors, and each is judged by its
own, so none is missed.
The last level compares 128-bit hashes and finds the smallest document of each.

Documents lie in blocks, and every level is one exchange of probe.py between
blocks and hash fragments. Documents are shuffled once into blocks, read again at
each level, and never gathered by key.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import probe, shared
from . import words as W

_LAST = (1 << 63) - 1
OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<array<bigint>>"


def levels(length: int) -> list[int]:
    """Window lengths up to `length`, each at most twice the one before, from at least 4 (or `length` itself)."""
    out = [length]
    while out[0] >= 8:
        out.insert(0, -(-out[0] // 2))
    if len(out) > 2 and out[0] < 7:
        out.pop(0)
    return out


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n = len(hashes)
    least, span = hashes.copy(), 1
    while span * 2 <= width:
        least[: n - span] = np.minimum(least[: n - span], least[span:n])
        span *= 2
    rest = width - span
    if rest:
        least[: n - rest] = np.minimum(least[: n - rest], least[rest:n])
    return least[: max(0, n - width + 1)]


def anchors(hashes: np.ndarray, at: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Places, among windows at `at`, with the least hash of some `width` neighbours in their document.

    A tie goes to every one of the least, which equal stretches share.
    """
    n = len(hashes)
    if n < width:
        return np.empty(0, np.int64)
    whole = np.flatnonzero((at[width - 1 :] - at[: n - width + 1] == width - 1) & (owner[width - 1 :] == owner[: n - width + 1]))
    low = _least(hashes, width)[whole]
    chosen = np.zeros(n, bool)
    for k in range(width):
        chosen[whole[hashes[whole + k] == low] + k] = True
    return np.flatnonzero(chosen)


class _Level:
    """Candidate windows of one length in a chunk."""

    def __init__(self, chunk: W.Chunk, hashes: np.ndarray, owner: np.ndarray, length: int):
        self.keys, self.at = chunk.window_hashes(length, hashes)
        self.owner = owner[self.at]
        self.length = length


def _anchored(level: _Level, below: _Level, known: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Windows whose own anchors are shared: the least hash of the windows below in each stays the least among shared anchors.

    Other anchors inside do not count: they may be the least of a window that reaches
    beyond the repeated stretch, and so be no anchors of the other document.
    """
    width = level.length - below.length + 1
    told = np.full(len(below.keys), np.iinfo(np.uint64).max, np.uint64)
    told[places[known]] = below.keys[places[known]]
    at = np.searchsorted(below.at, level.at)
    return _least(told, width)[at] == _least(below.keys, width)[at]


def _supported(level: _Level, below: _Level, known: np.ndarray, n_words: int) -> np.ndarray:
    """Windows in which every window below is shared."""
    bad = np.zeros(n_words + 1, np.int64)
    bad[below.at[~known] + 1] = 1
    bad = np.cumsum(bad)
    last = level.at + level.length - below.length
    return bad[last + 1] == bad[level.at]


def _block_keys(table: pa.Table, run: int, lengths: list[int], answers: list[probe.Answers]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Level `run`'s candidates of a block: keys, documents and, at the last level, second hashes."""
    last = run == len(lengths) - 1
    keys, docs, checks = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    ids = _ranked(table)
    for chunk in W.chunks(table["text"], W.SPACED):
        hashes, owner = chunk.hashes(), chunk.owner()
        level, at = _candidates(chunk, hashes, owner, run, lengths, answers)
        keys.append(level.keys[at])
        docs.append(ids[chunk.row + level.owner[at]])
        if last:
            checks.append(chunk.window_hashes(lengths[run], chunk.hashes(1))[0][at])
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(checks) if last else None


def _ranked(table: pa.Table) -> np.ndarray:
    """Ids as numbers whose order is theirs, a null after all others: the largest id and null share one, which no other row can precede."""
    return table["doc_id"].fill_null(_LAST).to_numpy()


def _candidates(chunk, hashes, owner, run, lengths, answers) -> tuple[_Level, np.ndarray]:
    level = _Level(chunk, hashes, owner, lengths[0])
    places = anchors(level.keys, level.at, level.owner, lengths[1] - lengths[0] + 1) if len(lengths) > 1 else np.arange(len(level.keys))
    for k in range(run):
        known, _ = answers[k].find(level.keys[places])
        above = _Level(chunk, hashes, owner, lengths[k + 1])
        if k:
            every = np.zeros(len(level.keys), bool)
            every[places] = known
            shared_below = _supported(above, level, every, len(hashes))
        else:
            shared_below = _anchored(above, level, known, places)
        places, level = np.flatnonzero(shared_below), above
    return level, places


def _ask(block: int, keys: np.ndarray, docs: np.ndarray, check: np.ndarray | None, exchange: probe.Exchange) -> pa.Table:
    """Distinct keys of a block: before the last level with whether two documents hold each, at the last with the smallest."""
    if not len(keys):
        return probe.requests_table([])
    order = np.lexsort((docs, keys) if check is None else (docs, check, keys))
    keys, docs, check = keys[order], docs[order], None if check is None else check[order]
    first, run = probe.runs(keys, check)
    if check is not None:
        return probe.requests_table(list(exchange.split(block, keys[first], docs[first], check[first])))
    several = (np.maximum.reduceat(docs, first) > docs[first]).astype(np.uint8)
    return probe.requests_table(list(exchange.split(block, keys[first], several)))


def _shared_reply(first, run, values):
    several = (np.diff(np.append(first, len(run))) > 1) | (np.maximum.reduceat(values, first) > 0) if len(run) else np.zeros(0, bool)
    return several[run], None


def _earlier_reply(first, run, values):
    """Answered where another block has a smaller document."""
    return values > np.minimum.reduceat(values, first)[run] if len(run) else np.zeros(0, bool), None


def _finish(table: pa.Table, lengths: list[int], final: probe.Answers, with_text: bool) -> pa.Table:
    length = lengths[-1]
    table = shared.side(table, doc_id=pa.int64(), text=pa.string())
    ids = _ranked(table)
    every: list[tuple[W.Chunk, _Level]] = []
    keys, docs, check = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for chunk in W.chunks(table["text"], W.SPACED):
        level = _Level(chunk, chunk.hashes(), chunk.owner(), length)
        keys.append(level.keys)
        docs.append(ids[chunk.row + level.owner])
        check.append(chunk.window_hashes(length, chunk.hashes(1))[0])
        every.append((chunk, level))
    keys, docs, check = np.concatenate(keys), np.concatenate(docs), np.concatenate(check)
    order = np.lexsort((docs, check, keys))
    first, run = probe.runs(keys[order], check[order])
    gone = np.empty(len(keys), bool)
    gone[order] = docs[order] > docs[order][first][run]
    gone |= final.find(keys, check)[0]
    out: list[tuple] = []
    done = 0
    for chunk, level in every:
        own = gone[done : done + len(level.keys)]
        done += len(level.keys)
        cover = np.zeros(len(chunk.starts) + 1, np.int64)
        cover[level.at[own]] += 1
        cover[level.at[own] + length] -= 1
        removed = np.cumsum(cover[:-1]) > 0
        for i in range(chunk.n_texts):
            lo, hi = int(chunk.first[i]), int(chunk.first[i + 1])
            cut = removed[lo:hi]
            base = int(chunk.starts[lo]) if hi > lo else 0
            raw = chunk.data[base : int(chunk.ends[hi - 1]) if hi > lo else 0].tobytes()
            spans = zip(chunk.starts[lo:hi][~cut].tolist(), chunk.ends[lo:hi][~cut].tolist())
            kept = b" ".join([raw[s - base : e - base] for s, e in spans])
            edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))).reshape(-1, 2).tolist()
            out.append((hi - lo, int(cut.sum()), kept.decode() if with_text else hashlib.sha256(kept).hexdigest(), edges))
    n_words, n_removed, kept, edges = zip(*out) if out else ((), (), (), ())
    return pa.table(
        {
            "doc_id": table["doc_id"],
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.string()),
            "removed": pa.array(edges, pa.list_(pa.list_(pa.int64()))),
        }
    )


def substring_dedup(docs: DataFrame, length: int = 13, digest_only: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text, removed spans [first word, end).

    A word goes when a window of `length` words that covers it starts in a document
    with a smaller id too; windows are judged on the whole input. Documents of
    fewer words keep all. A null text is empty; a null id comes after all others;
    rows of equal id do not remove each other's words. Repeated rows give a row each,
    an empty table none. digest_only puts the kept
    text's SHA-256 in place of the text. Other columns of docs are not looked at.
    """
    if length < 1:
        raise ValueError("length must be positive")
    total = shared.total_bytes(docs, text)
    exchange = probe.Exchange.over(total, docs.count())
    blocks = shared.in_blocks(docs, exchange.blocks, id_col, text)
    lengths = levels(length)
    told: list[DataFrame] = []
    for run in range(len(lengths)):
        last = run == len(lengths) - 1
        first_ask, later_ask = _asks(run, lengths, exchange)
        if run:
            asked = blocks.groupBy("block").cogroup(_together(told).groupBy("block")).applyInArrow(later_ask, probe.REQUEST)
        else:
            asked = blocks.groupBy("block").applyInArrow(first_ask, probe.REQUEST)
        if last:
            told = [exchange.answer(asked, _earlier_reply, "<i8", checked=True)]
        else:
            told.append(exchange.answer(asked, _shared_reply, "<u1"))

    def finish(table: pa.Table, given: pa.Table) -> pa.Table:
        return _finish(table, lengths, exchange.answers(given, checked=True), not digest_only)

    return blocks.groupBy("block").cogroup(told[0].groupBy("block")).applyInArrow(finish, OUT)


def _asks(run: int, lengths: list[int], exchange: probe.Exchange):
    """The requests of a level, from a block alone and from a block with the answers of the levels below."""

    def first(table: pa.Table) -> pa.Table:
        return _ask(table["block"][0].as_py(), *_block_keys(table, run, lengths, []), exchange)

    def later(table: pa.Table, given: pa.Table) -> pa.Table:
        if not table.num_rows:
            return probe.requests_table([])
        known = [exchange.answers(_of(given, k)) for k in range(run)]
        return _ask(table["block"][0].as_py(), *_block_keys(table, run, lengths, known), exchange)

    return first, later


def _together(told: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [t.withColumn("level", F.lit(k)) for k, t in enumerate(told)])


def _of(table: pa.Table, level: int) -> pa.Table:
    return table.filter(pc.equal(table["level"], level)) if table.num_columns else table
