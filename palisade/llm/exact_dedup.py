"""Exact dedup against a minimal perfect hash over historical distinct digests.

Rows with an id up to a cut are the history. Their distinct digests are dealt
into buckets by digest; each bucket gets a minimal perfect hash (hash and
displace: groups of keys, largest first, each with the first pilot that sends
its keys to free slots; a lone key stores its slot). A slot holds the full
32-byte digest and the winner's id. The later rows, reduced to distinct digests
first, look their slot up and compare all bytes; members are repeats of the
slot's winner, nonmembers are grouped among themselves.

Texts are hashed once, into a table of digests in the shared folder that all
later steps read. Only distinct digests meet in a bucket, so a text that a third
of all rows share counts once there; the counting before is combined on the map
side, and the join that hands results back to rows is one that Spark splits when
skewed. A row that repeats stays as many rows; nothing is gathered for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_RUN, free_names, same_columns, text_or_empty, written
from .words import mix

BUCKET_KEYS = 4000
GROUP_KEYS = 4


def _lanes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def _slots(step: np.ndarray, start: np.ndarray, pilot, n: int) -> np.ndarray:
    return (mix(start + np.asarray(pilot, np.uint64) * (step | np.uint64(1))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Slots 0..n-1 for n distinct 32-byte digests, with a locator each."""

    def __init__(self, digests: list[bytes], locators: list[int]):
        n = self.n = len(digests)
        self.groups = n // GROUP_KEYS + 1
        self.pilots = np.zeros(self.groups, np.int64)
        self.digests, self.locators = np.zeros((n, 4), np.uint64), np.zeros(n, np.int64)
        if not n:
            return
        keys = _lanes(digests)
        group = (keys[:, 1] % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(self.groups + 1))
        free, slot = np.ones(n, bool), np.empty(n, np.int64)
        sizes = np.diff(bounds)
        trial = np.arange(64, dtype=np.uint64)[:, None]
        for g in np.argsort(-sizes, kind="stable"):
            own = order[bounds[g] : bounds[g + 1]]
            if len(own) < 2:
                break
            base = 0
            while True:
                at = np.sort(_slots(keys[own, 2], keys[own, 3], trial + np.uint64(base), n), axis=1)
                good = free[at].all(axis=1) & (np.diff(at, axis=1) != 0).all(axis=1)
                if good.any():
                    pilot = base + int(good.argmax())
                    break
                base += 64
            self.pilots[g] = pilot
            slot[own] = _slots(keys[own, 2], keys[own, 3], pilot, n)
            free[slot[own]] = False
        lone = np.flatnonzero(sizes == 1)
        rest = np.flatnonzero(free)
        self.pilots[lone] = -1 - rest
        slot[order[bounds[lone]]] = rest
        self.digests[slot], self.locators[slot] = keys, np.asarray(locators, np.int64)

    def find(self, digests: list[bytes]) -> np.ndarray:
        """Each digest's slot, or -1 where the slot's 32 bytes differ."""
        if not self.n or not digests:
            return np.full(len(digests), -1)
        keys = _lanes(digests)
        pilot = self.pilots[(keys[:, 1] % np.uint64(self.groups)).astype(np.int64)]
        at = np.where(pilot < 0, -1 - pilot, _slots(keys[:, 2], keys[:, 3], np.maximum(pilot, 0), self.n))
        return np.where((self.digests[at] == keys).all(axis=1), at, -1)


_RESOLVED = "digest binary, keep_id long, keep_row long, group_size long"


def _resolve(rows: pa.Table) -> pa.Table:
    """One row per distinct digest of a bucket, from its history and its later rows."""
    old, new = rows.filter(rows["past"]), rows.filter(pc.invert(rows["past"]))
    have, extra = old["digest"].to_pylist(), new["digest"].to_pylist()
    table = PerfectHash(have, list(range(len(have))))
    at = table.find(extra)
    member = at >= 0
    counts = new["n"].to_numpy()
    size = old["n"].to_numpy().copy()
    np.add.at(size, table.locators[at[member]], counts[member])
    fresh = new.filter(pa.array(~member))
    first = pa.concat_tables([old, fresh]).select(["digest", "keep_id", "keep_row"])
    return first.append_column("group_size", pa.array(np.concatenate([size, counts[~member]]).astype(np.int64)))


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of the text with each white-space run made one space."""
    plain = F.regexp_replace(text_or_empty(text), SPACE_RUN, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, cut: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest.

    cut: the last id of the history; by default the middle of the ids. A null
    text counts as empty. Of equal texts the smallest id is kept, and of rows
    that repeat both id and text one; a null id comes after all others. An empty
    table gives no rows. Further columns of docs are not looked at.
    """
    rows = written(digests(docs, id_col, text).withColumn("row", F.monotonically_increasing_id()), "digests")
    lo, hi, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    if cut is None:
        cut = 0 if lo is None else (lo + hi) // 2
    buckets = max(1, -(-n // BUCKET_KEYS))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    counted = rows.groupBy("digest", F.when(F.col("doc_id") <= cut, True).otherwise(False).alias("past")).agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    counted = counted.select("digest", "past", "n", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"))
    resolved = counted.groupBy("bucket").applyInArrow(_resolve, _RESOLVED)
    return rows.join(resolved, "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns as they are."""
    stay_id, stay_digest, own_id, own_digest, nth = free_names(docs, "stay_id", "stay_digest", "own_id", "own_digest", "nth")
    stay = exact_dedup(docs, id_col=id_col, text=text).filter("kept").select(F.col("doc_id").alias(stay_id), F.col("digest").alias(stay_digest))
    plain = F.regexp_replace(text_or_empty(text), SPACE_RUN, " ")
    marked = docs.withColumns({own_id: F.col(id_col).cast("long"), own_digest: F.unhex(F.sha2(plain.cast("binary"), 256))})
    match = F.col(own_id).eqNullSafe(F.col(stay_id)) & (F.col(own_digest) == F.col(stay_digest))
    own = marked.join(stay, match, "left_semi")
    first = Window.partitionBy(own_id, own_digest).orderBy(text)
    return same_columns(own.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1), docs)
