"""Similarity join on word n-grams by vertical partitioning.

The global order of n-grams is (document frequency, hash). Hash ranges are its
fragments: frequencies are counted per fragment (probe.py), and overlaps of
documents are counted per fragment and summed per pair.

1. Every fragment counts its n-grams' documents. A document whose share of
   n-grams that other documents have is below the threshold links with nothing.
2. What is left is reduced to one representative for each distinct set (16-byte
   digests). Two sets at the threshold share an n-gram of their prefixes in the
   global order, so joining each prefix n-gram's sets to its least set makes
   families that hold every link.
3. Families of up to FAMILY_BLOCK n-grams are packed into tasks of about that
   size. A larger family is dealt in the way that ships less: as pairs of such
   blocks, or by prefix n-gram, a hot one again in block pairs and n-grams of the
   same members once. So a family that grew together by chance costs about its
   prefixes, and one of near copies about its blocks.
4. In a task only sets that share a prefix n-gram meet, if their sizes and the
   n-gram's places allow the threshold, and if they are not yet in one tree. Their
   partial overlaps are counted fragment by fragment; pairs that cannot reach the
   threshold with the fragments left are dropped. A task sends back a spanning
   forest of its links, never the pairs.
5. Components of these links, widened to the copies, give each document's group.

No cap is set on partners. N-grams are compared by 64-bit hashes within a pair:
of two sets of 1000, one false n-gram comes about once in 10^13 pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import probe, shared
from . import words as W
from .components import components

#: N-grams in a block: a task gets one or two of these.
FAMILY_BLOCK = 1 << 17
#: Fragments in which overlaps are counted.
OVERLAP_FRAGMENTS = 4
#: Families beyond a block, of 24 bytes each, up to which a list of them is sent to all executors.
SENT_FAMILIES = 1_000_000

STATE = "doc_id long, n_shingles long, digest binary, grams binary, prefix array<long>, skipped int"


def gram_sets(chunk: W.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, sorted by text and hash, with the texts' bounds; fewer words make one gram."""
    hashes = chunk.hashes()
    keys, at = chunk.window_hashes(n, hashes)
    owner = chunk.owner()[at] if len(at) else np.empty(0, np.int64)
    count = np.diff(chunk.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = [W.windows(hashes[chunk.first[i] : chunk.first[i + 1]], int(count[i]))[0] for i in short.tolist()]
        keys, owner = np.concatenate([keys, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(chunk.n_texts + 1))


def _ask(table: pa.Table, n: int, exchange: probe.Exchange) -> pa.Table:
    keys = [gram_sets(chunk, n)[0] for chunk in W.chunks(table["text"], W.SPACED_LOWER)]
    keys = np.sort(np.concatenate(keys))
    first, _ = probe.runs(keys)
    counts = np.diff(np.append(first, len(keys))).astype("<u4")
    return probe.requests_table(list(exchange.split(table["block"][0].as_py(), keys[first], counts)))


def _frequency_reply(first, run, values):
    if not len(run):
        return np.zeros(0, bool), values
    total = np.minimum(np.add.reduceat(values.astype(np.int64), first), (1 << 32) - 1)
    return (total > 1)[run], total[run].astype("<u4")[(total > 1)[run]]


def _prune(table: pa.Table, given: pa.Table, n: int, percent: int, exchange: probe.Exchange) -> pa.Table:
    known = exchange.answers(given, "<u4")
    table = shared.side(table, doc_id=pa.int64(), text=pa.string())
    sizes, digests, grams, prefixes, skipped = [], [], [], [], []
    for chunk in W.chunks(table["text"], W.SPACED_LOWER):
        keys, bounds = gram_sets(chunk, n)
        told, place = known.find(keys)
        shared_upto = np.append(0, np.cumsum(told))
        for i in range(chunk.n_texts):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            size = hi - lo
            sizes.append(size)
            if not size or 100 * int(shared_upto[hi] - shared_upto[lo]) < percent * size:
                digests.append(None), grams.append(None), prefixes.append(None), skipped.append(None)
                continue
            own = keys[lo:hi]
            frequency = np.ones(size, np.int64)
            frequency[told[lo:hi]] = known.values[place[lo:hi][told[lo:hi]]]
            order = np.lexsort((own, frequency))[: size - -(-percent * size // 100) + 1]
            alone = int((frequency[order] == 1).sum())  # these come first
            order = order[alone:]
            raw = own.tobytes()
            digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            skipped.append(alone)
            grams.append(raw)
            prefixes.append(own[order].view(np.int64))
    return pa.table(
        {
            "doc_id": table["doc_id"],
            "n_shingles": pa.array(sizes, pa.int64()),
            "digest": pa.array(digests, pa.binary()),
            "grams": pa.array(grams, pa.binary()),
            "prefix": pa.array(prefixes, pa.list_(pa.int64())),
            "skipped": pa.array(skipped, pa.int32()),
        }
    )


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges lo to hi, and where each range's begin among them."""
    size = hi - lo
    upto = np.append(0, np.cumsum(size))
    return np.arange(upto[-1]) + np.repeat(lo - upto[:-1], size), upto


class _Index:
    """Sets as numbers, cut into fragments of the hash order, and the places of their prefix grams."""

    def __init__(self, sets: list[np.ndarray], prefixes: list[np.ndarray], skipped: np.ndarray):
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        vocabulary, key = np.unique(every, return_inverse=True)
        row = np.repeat(np.arange(len(sets)), self.size)
        cut = (every >> np.uint64(62)).astype(np.int64)
        self.parts = []
        for f in range(OVERLAP_FRAGMENTS):
            inside = np.flatnonzero(cut == f)
            self.parts.append((key[inside], np.searchsorted(row[inside], np.arange(len(sets) + 1))))
        self.mark = np.zeros(len(vocabulary), np.int8)
        length = np.array([len(x) for x in prefixes], np.int64)
        gram = np.searchsorted(vocabulary, np.concatenate(prefixes))
        self.first = np.append(0, np.cumsum(length))
        self.gram = gram
        owner = np.repeat(np.arange(len(sets)), length)
        self.place = np.arange(len(gram)) - np.repeat(self.first[:-1], length) + np.repeat(skipped, length)
        self.order = np.argsort(gram, kind="stable")
        self.held = owner[self.order], self.place[self.order]
        self.at = np.searchsorted(gram[self.order], np.arange(len(vocabulary) + 1))


def forest(sets: list[np.ndarray], prefixes: list[np.ndarray], skipped: np.ndarray, percent: int, side: np.ndarray | None = None) -> tuple[list[tuple[int, int]], int]:
    """A spanning forest of the links among the sets, and how many pairs were compared.

    Sets are sorted hashes; a prefix is in the global order, without the `skipped`
    grams at its front that no other set has. With sides, two of one side don't meet.
    """
    if len(sets) < 2:
        return [], 0
    index = _Index(sets, prefixes, skipped)
    size, mark, root = index.size, index.mark, np.arange(len(sets))
    edges, compared = [], 0
    for x in range(len(sets)):
        own = slice(index.first[x], index.first[x + 1])
        gram = index.gram[own]
        at, upto = _ranges(index.at[gram], index.at[gram + 1])
        y, there = index.held[0][at], index.held[1][at]
        here = np.repeat(index.place[own], np.diff(upto))
        need = -(-percent * (size[x] + size[y]) // (100 + percent))
        good = (y > x) & (root[y] != root[x]) & (np.minimum(size[x] - here, size[y] - there) >= need)
        if side is not None:
            good &= side[y] != side[x]
        y = np.unique(y[good])
        if not len(y):
            continue
        compared += len(y)
        need = -(-percent * (size[x] + size[y]) // (100 + percent))
        got, rest_x, rest = np.zeros(len(y), np.int64), int(size[x]), size[y].copy()
        for key, bounds in index.parts:
            mine = key[bounds[x] : bounds[x + 1]]
            mark[mine] = 1
            places, upto = _ranges(bounds[y], bounds[y + 1])
            total = np.append(0, np.cumsum(mark[key[places]], dtype=np.int64))
            got += total[upto[1:]] - total[upto[:-1]]
            mark[mine] = 0
            rest_x -= len(mine)
            rest -= np.diff(upto)
            able = got + np.minimum(rest_x, rest) >= need
            y, need, got, rest = y[able], need[able], got[able], rest[able]
            if not len(y):
                break
        for other in y.tolist():
            if root[x] != root[other]:
                edges.append((x, other))
                root[root == root[other]] = root[x]
    return edges, compared


def _task(table: pa.Table, percent: int) -> pa.Table:
    """Links among a task's sets; of a pair of two blocks, only those between them."""
    order = np.argsort(table["node"].to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    sets = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
    prefixes = [np.array(x, np.int64).view(np.uint64) for x in table["prefix"].to_pylist()]
    side = table["block"].to_numpy() if table["first"][0].as_py() != table["second"][0].as_py() else None
    edges, _ = forest(sets, prefixes, table["skipped"].to_numpy().astype(np.int64), percent, side)
    pairs = table["node"].to_numpy()[np.array(edges, np.int64).reshape(-1, 2)]
    return pa.table({"u": pa.array(pairs[:, 0], pa.int64()), "v": pa.array(pairs[:, 1], pa.int64())})


def _families(sets: DataFrame) -> DataFrame:
    """(node, component) of the sets that a shared prefix n-gram joins."""
    prefix = sets.select("node", F.explode("prefix").alias("gram"))
    lead = prefix.groupBy("gram").agg(F.min("node").alias("v"), F.max("node").alias("most")).filter("v < most").select("gram", "v")
    return components(prefix.join(lead, "gram").select(F.col("node").alias("u"), "v"), "families")


def _block_pairs(rows: DataFrame, parts: str) -> DataFrame:
    """(block, first, second): a set's block among `parts`, and the pairs of blocks in which it is held."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col(parts)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(parts) - 1).cast("int"))))
    return rows.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})


def _large(light: DataFrame, held: DataFrame, few) -> DataFrame:
    """(node, task, block, first, second) for the sets of families beyond a block.

    A family goes in block pairs or by prefix gram, whichever copies fewer grams. Of
    grams that the same sets hold (equal in number, size and two hashes) one is taken.
    """
    of_gram = held.groupBy("component", "gram").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"), F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"), F.first("whole").alias("whole"), F.first("parts").alias("parts")
    )
    of_gram = of_gram.filter("n > 1").groupBy("component", "n", "grams", "one", "two", "whole", "parts").agg(F.min("gram").alias("gram"))
    of_gram = of_gram.withColumn("gram_parts", F.ceil(F.col("grams") / FAMILY_BLOCK))
    cost = of_gram.groupBy("component").agg(F.sum(F.col("grams") * F.col("gram_parts")).alias("by_gram"), F.first("whole").alias("whole"), F.first("parts").alias("parts"))
    chosen = shared.written(cost.select("component", (F.col("by_gram") < F.col("whole") * F.col("parts")).alias("by_gram")), "dealt")
    blocks = _block_pairs(light.join(few(chosen.filter("NOT by_gram")), "component", "left_semi"), "parts").withColumn("gram", F.lit(0).cast("long"))
    own = of_gram.join(few(chosen.filter("by_gram")), "component", "left_semi").select("component", "gram", "gram_parts")
    grams = _block_pairs(held.join(own, ["component", "gram"]), "gram_parts")
    columns = ("node", "component", "gram", "block", "first", "second")
    return blocks.select(*columns).unionAll(grams.select(*columns))


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): a spanning forest, or more, of the links between distinct sets."""
    family = shared.written(sets.select("node", "prefix", (F.octet_length("grams") / 8).cast("long").alias("size")).join(_families(sets), "node"), "placed")
    total = family.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-total // FAMILY_BLOCK))
    whole = family.groupBy("component").agg(F.sum("size").alias("whole")).filter(F.col("whole") > FAMILY_BLOCK)
    big = shared.written(whole.withColumn("parts", F.ceil(F.col("whole") / FAMILY_BLOCK)), "large")
    many = big.count()

    def few(rows: DataFrame) -> DataFrame:
        """A list of large families, sent to all while it is short; else joined by shuffling."""
        return F.broadcast(rows) if many <= SENT_FAMILIES else rows

    none = [F.lit(0).alias(name) for name in ("block", "first", "second")]
    small = family.join(few(big), "component", "left_anti") if many else family
    dealt = small.select("node", F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("component"), F.lit(None).cast("long").alias("gram"), *none)
    if many:
        light = family.join(few(big), "component")
        held = light.select("component", "node", "size", "whole", "parts", F.explode("prefix").alias("gram"))
        dealt = dealt.unionAll(_large(light, held, few))
    placed = dealt.join(sets.select("node", "grams", "prefix", "skipped"), "node")
    return placed.groupBy("component", "gram", "first", "second").applyInArrow(lambda table: _task(table, percent), "u long, v long")


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Documents link when the Jaccard similarity of their sets of distinct n-word
    shingles (A-Z lowered) is at least percent / 100; a text of fewer words is one
    shingle. component_id is the least doc_id that links reach. Texts that are
    null, empty or without words have no shingles and stay alone. Equal sets link,
    whatever their ids; a null id comes after all others. Rows that repeat are one
    set. An empty table gives no rows. Other columns of docs are not looked at.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    total = shared.total_bytes(docs, text)
    exchange = probe.Exchange.over(total, docs.count())
    blocks = shared.in_blocks(docs, exchange.blocks, id_col, text)
    asked = blocks.groupBy("block").applyInArrow(lambda table: _ask(table, n, exchange), probe.REQUEST)
    told = exchange.answer(asked, _frequency_reply, "<u4")
    pruned = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda table, given: _prune(table, given, n, percent, exchange), STATE)
    state = shared.written(pruned, "grams")

    distinct = state.filter("digest IS NOT NULL").groupBy("digest").agg(*[F.first(name).alias(name) for name in ("grams", "prefix", "skipped")])
    # Numbers given once and written are the same for every later reader, whichever task is run again.
    sets = shared.written(distinct.withColumn("node", F.monotonically_increasing_id()), "sets")
    group = components(_links(sets, percent), "links")

    members = state.filter("digest IS NOT NULL").select("doc_id", "n_shingles", "digest").join(sets.select("digest", "node"), "digest")
    members = members.join(group, "node", "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    least = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = members.join(least, "component").select("doc_id", "n_shingles", "component_id")
    alone = state.filter("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone)


def first_rows(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that have the least id of their group, all columns as they are; rows of one id stay or go together."""
    own, stay = shared.free_names(docs, "own_id", "stay_id")
    groups = jaccard_groups(docs, n, percent, id_col, text)
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(stay)).distinct()
    marked = docs.withColumn(own, F.col(id_col).cast("long"))
    return shared.same_columns(marked.join(first, F.col(own).eqNullSafe(F.col(stay)), "left_semi"), docs)
