"""Benchmark decontamination by Wu-Manber search over words.

Symbols are 64-bit word hashes, blocks are pairs of words. A table indexed by a
block's hash gives how far the search may jump: the least distance from that
block to the end of any test string, or the most possible for blocks that no
test string holds. Where it is 0, the block's bucket names the test strings
that end with it, all their symbols are compared, and then the words' bytes.
Test strings of each length have tables of their own. The search keeps one
cursor for each stretch of a document and moves all of a chunk's cursors
together.

Documents are read in place and nothing is shuffled. Test strings travel to the
executors as flat arrays: the words' bytes, the items' words by number, and where
each test string begins, about six bytes for each byte of item text. They go in
parts of at most PART_BYTES of item text (an item counts whole); a larger
benchmark takes one pass for each part, and what a pass found is written before
the next one, so no executor ever holds two parts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import free_names, same_columns, written

WINDOW = 13
PART_BYTES = 8 << 20
STRETCH = 256
TABLE_BITS = 20


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


@dataclass
class Vocabulary:
    """The distinct words of some items: their bytes, bounds and hashes."""

    data: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def same(self, chunk: W.Chunk, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether the chunk's words at `place` are these words, byte by byte."""
        size = chunk.ends[place] - chunk.starts[place]
        own = self.bounds[word + 1] - self.bounds[word]
        out = size == own
        some = np.flatnonzero(out)
        size = size[some]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        here = chunk.kind.fold[chunk.data[np.repeat(chunk.starts[place[some]], size) + step]]
        there = self.data[np.repeat(self.bounds[word[some]], size) + step]
        if len(some):
            out[some] = np.add.reduceat(here != there, first) == 0
        return out


class Searcher:
    """All distinct test strings of one length, as places in a stream of numbered words, with their items."""

    def __init__(self, length: int, vocabulary: Vocabulary, stream: np.ndarray, begin: np.ndarray, owner: np.ndarray, names: list[str]):
        self.length, self.vocabulary, self.stream, self.names = length, vocabulary, stream, names
        # Equal strings, by 128 bits, are one string with several items; what is found is compared by its bytes.
        hashes = vocabulary.hashes[stream]
        inside = np.arange(length)
        one = np.concatenate([W.windows(hashes, length), np.zeros(length - 1, np.uint64)])[begin]
        two = np.concatenate([W.windows(W.mix(hashes ^ np.uint64(W._STEP)), length), np.zeros(length - 1, np.uint64)])[begin]
        order = np.lexsort((owner, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        self.begin = begin[order][new].astype(np.int32)
        pair = np.stack([np.cumsum(new) - 1, owner[order]])
        keep = np.ones(len(order), bool)
        keep[1:] = (pair[:, 1:] != pair[:, :-1]).any(axis=0)
        self.item = pair[1][keep].astype(np.int32)
        self.item_at = np.searchsorted(pair[0][keep], np.arange(len(self.begin) + 1)).astype(np.int32)
        self.width = min(2, length)
        self.jump = length - self.width + 1
        self.shift = np.full(1 << TABLE_BITS, self.jump, np.uint8 if self.jump < 256 else np.int32)
        for k in inside[: self.jump]:
            at = self.begin + k
            block = _block(hashes[at], hashes[at + 1]) if self.width == 2 else W.mix(hashes[at])
            np.minimum.at(self.shift, self._index(block), self.jump - 1 - k)
        order = np.argsort(block, kind="stable")
        self.suffixes, self.first = np.unique(block[order], return_index=True)
        self.bucket = order.astype(np.int32)
        self.first = self.first.astype(np.int32)
        self.ends = np.append(self.first[1:], np.int32(len(order)))

    @staticmethod
    def _index(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, chunk: W.Chunk, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and string of every occurrence."""
        n_words = np.diff(chunk.first)
        begin, end = [], []
        many = np.maximum(0, -(-(n_words - self.length + 1) // STRETCH))
        text = np.repeat(np.arange(len(n_words)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        begin = chunk.first[text] + nth * STRETCH + self.length - 1
        end = np.minimum(begin + STRETCH, chunk.first[text + 1])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(begin):
            block = _block(hashes[begin - 1], hashes[begin]) if self.width == 2 else W.mix(hashes[begin])
            step = self.shift[self._index(block)].astype(np.int64)
            stop = np.flatnonzero(step == 0)
            if len(stop):
                at = np.searchsorted(self.suffixes, block[stop])
                known = (at < len(self.suffixes)) & (self.suffixes[np.minimum(at, len(self.suffixes) - 1)] == block[stop])
                found.append((begin[stop[known]], at[known]))
                step[stop] = 1
            begin = begin + step
            alive = begin < end
            begin, end = begin[alive], end[alive]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        last, suffix = (np.concatenate(x) for x in zip(*found))
        size = self.ends[suffix] - self.first[suffix]
        place = np.repeat(self.first[suffix], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start, string = np.repeat(last, size) - self.length + 1, self.bucket[place]
        for exact in (False, True):
            for k in range(self.length):
                word = self.stream[self.begin[string] + k]
                same = self.vocabulary.same(chunk, start + k, word) if exact else hashes[start + k] == self.vocabulary.hashes[word]
                start, string = start[same], string[same]
        return start, string

    def items_of(self, string: int) -> list[str]:
        return [self.names[i] for i in self.item[self.item_at[string] : self.item_at[string + 1]].tolist()]


def searchers(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[Searcher]:
    """A searcher for each length of test string: `window`, and those of items that have fewer words."""
    names = [item for item, _ in items]
    chunk = next(W.chunks(pa.array([text for _, text in items], pa.string()), W.ALNUM_LOWER, 1 << 62), None)
    if chunk is None or not len(chunk.starts):
        return []
    example, stream = chunk.distinct()
    words = [chunk.word(i) for i in example.tolist()]
    vocabulary = Vocabulary(np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum([len(w) for w in words])), chunk.hashes()[example])
    count = np.diff(chunk.first)
    length = np.minimum(count, window)
    out = []
    for n in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == n)
        many = count[own] - n + 1
        owner = np.repeat(own, many)
        begin = np.repeat(chunk.first[own], many) + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        out.append(Searcher(n, vocabulary, stream.astype(np.int32), begin, owner, names))
    return out


_TRAIL = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]


def _scan(batches: Iterator[pa.RecordBatch], part: list[Searcher]) -> Iterator[pa.RecordBatch]:
    """Adds each text's hits to the trail columns; spans are [first word, end), merged."""
    for batch in batches:
        before = batch["spans"].to_pylist(), batch["items"].to_pylist()
        out: list[tuple] = []
        for chunk in W.chunks(batch["text"], W.ALNUM_LOWER):
            hashes = chunk.hashes()
            cover = np.zeros(len(hashes) + 1, np.int64)
            items: dict[int, set[str]] = defaultdict(set)
            for i in range(chunk.n_texts):
                for lo, hi in before[0][chunk.row + i] or ():
                    cover[chunk.first[i] + lo] += 1
                    cover[chunk.first[i] + hi] -= 1
                items[i].update(before[1][chunk.row + i] or ())
            for one in part:
                start, string = one.search(chunk, hashes)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + one.length, -1)
                for i, p in zip((np.searchsorted(chunk.first, start, "right") - 1).tolist(), string.tolist()):
                    items[i].update(one.items_of(p))
            hit = np.cumsum(cover[:-1]) > 0
            hits = np.append(0, np.cumsum(hit))
            for i in range(chunk.n_texts):
                lo, hi = int(chunk.first[i]), int(chunk.first[i + 1])
                n_hit = int(hits[hi] - hits[lo])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].view(np.int8), [0]]))).reshape(-1, 2).tolist() if n_hit else []
                out.append((hi - lo, n_hit, edges, sorted(items[i])))
        keep = {name: batch[name] for name in batch.schema.names if name not in dict(_TRAIL)}
        trail = {name: pa.array([row[k] for row in out], kind) for k, (name, kind) in enumerate(_TRAIL)}
        yield pa.RecordBatch.from_pydict(keep | trail)


def _parts(benchmark: DataFrame, item_id: str, item_text: str, part_bytes: int, window: int) -> Iterator[list[Searcher]]:
    part, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(item_text)).filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    for item, text in rows.toLocalIterator():
        own = len(text.encode())
        if part and size + own > part_bytes:
            yield searchers(part, window)
            part, size = [], 0
        part.append((item, text))
        size += own
    yield searchers(part, window)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row per row of docs: doc_id, text, n_words, n_hit, spans of hit words, items.

    An item of fewer words than the window is one test string; an item without
    words, text or id has none. A null or empty text has no words. Repeated rows
    are judged alike, and other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<array<bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for k, part in enumerate(_parts(benchmark, item_id, item_text, part_bytes, window)):
        rows = rows if not k else written(rows, "search")
        sent = spark.sparkContext.broadcast(part)  # at most part_bytes of item text and an item
        rows = rows.mapInArrow(lambda batches, sent=sent: _scan(batches, sent.value), rows.schema)
    return rows


def contaminated(n_hit, n_words):
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, all columns as they are, without a shuffle.

    Null and empty texts stay, rows that repeat are judged alike, an empty table gives none.
    """
    spark = docs.sparkSession
    body, trail = free_names(docs, "body", "trail")
    kind = "struct<n_words:bigint,n_hit:bigint,spans:array<array<bigint>>,items:array<string>>"
    marked = docs.withColumn(body, F.col(text)).withColumn(trail, F.lit(None).cast(kind))
    for k, part in enumerate(_parts(benchmark, "item_id", "text", part_bytes, WINDOW)):
        marked = marked if not k else written(marked, "search")
        sent = spark.sparkContext.broadcast(part)  # at most part_bytes of item text and an item
        marked = marked.mapInArrow(lambda batches, sent=sent: _nested(batches, sent.value), marked.schema)
    verdict = contaminated(F.col(f"{trail}.n_hit"), F.col(f"{trail}.n_words"))
    return same_columns(marked.filter(~verdict), docs)


def _nested(batches: Iterator[pa.RecordBatch], part: list[Searcher]) -> Iterator[pa.RecordBatch]:
    """_scan for rows whose last two columns are the text and the trail."""
    for batch in batches:
        text, trail = batch.columns[-2:]
        inner = pa.RecordBatch.from_pydict({"text": text, "spans": trail.field("spans"), "items": trail.field("items")})
        (found,) = _scan(iter([inner]), part)
        struct = pa.StructArray.from_arrays([found[name] for name, _ in _TRAIL], [name for name, _ in _TRAIL])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], struct], batch.schema.names)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()
