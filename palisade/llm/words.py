"""Vectorised words and word windows over UTF-8 buffers.

Texts stay in the Arrow buffer they arrive in. Byte classes are looked up in a
256-entry table, words are found as runs of word bytes, and words and windows of
words get 64-bit hashes lane by lane and by doubling, so no Python object is made
per word. Two seeds give 128 bits. Work is cut into chunks of a bounded number of bytes;
a text longer than a chunk forms a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21

_MASK = (1 << 64) - 1
_STEP, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The low 0 to 8 bytes of a lane.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the bytes data[start:end], none of them empty; another seed gives another hash.

    Each lane of 8 bytes is mixed with its place, and the lanes' sum with the
    length, so no arrangement of equal letters makes two strings agree.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    size = ends - starts
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    place = mix(np.arange((int(size.max()) + 7) // 8, dtype=np.uint64) * _STEP + np.uint64(seed * 2 + 1))
    out = mix((lanes[starts] & _LOW[np.minimum(size, 8)]) + place[0])
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        first = np.cumsum(more) - more
        nth = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        left = np.repeat(size[long], more) - 8 * nth
        value = lanes[np.repeat(starts[long], more) + 8 * nth] & _LOW[np.minimum(left, 8)]
        out[long] += np.add.reduceat(mix(value + place[nth]), first)
    return mix(out + size.astype(np.uint64) * _PAIR + np.uint64(seed))


@dataclass(frozen=True)
class WordClass:
    """Which bytes make words, and the byte each counts as."""

    member: np.ndarray
    fold: np.ndarray
    lower: bool

    @staticmethod
    def build(excluded: bytes, lower: bool) -> "WordClass":
        member = np.ones(256, bool)
        member[np.frombuffer(excluded, np.uint8)] = False
        fold = np.arange(256, dtype=np.uint8)
        if lower:
            fold[65:91] += 32
            member[65:91] = member[97:123]
        return WordClass(member, fold, lower)


_SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Words are runs of anything but ASCII white space.
SPACED = WordClass.build(_SPACES, lower=False)
#: The same with A-Z lowered.
SPACED_LOWER = WordClass.build(_SPACES, lower=True)
#: Words are runs of digits, a-z (A-Z lowered) and everything beyond ASCII.
ALNUM_LOWER = WordClass.build(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), lower=True)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring runs from theirs."""
    return mix((left ^ (left >> np.uint64(29))) * _PAIR + right)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` hashes, put together from runs of powers of two; shorter input gives nothing."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64)
    many = n - length + 1
    out, done, power, size = None, 0, hashes, 1
    while True:
        if length & size:
            part = power[done : done + many]
            out = part if out is None else joined(out, part)
            done += size
        if done == length:
            return mix(out + np.uint64(length * int(_STEP) & _MASK))
        power = joined(power[: len(power) - size], power[size:])
        size *= 2


@dataclass
class Chunk:
    """Words of some consecutive texts: `first[i]:first[i + 1]` are those of text i."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    kind: WordClass
    #: Where each text begins in data, and the end.
    offsets: np.ndarray | None = None

    @property
    def n_texts(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts, dtype=np.int64), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        return byte_hashes(self.kind.fold[self.data] if self.kind.lower else self.data, self.starts, self.ends, seed)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One word of each spelling, and which of these every word is; hashes propose, all bytes are compared."""
        _, example, which = np.unique(self.hashes(), return_index=True, return_inverse=True)
        if not len(which):
            return example, which
        size = self.ends - self.starts
        first = np.cumsum(size) - size
        at = np.repeat(self.starts - first, size) + np.arange(int(size.sum()))
        other = at + np.repeat(self.starts[example][which] - self.starts, size)
        data = self.kind.fold[self.data] if self.kind.lower else self.data
        differ = np.add.reduceat(data[at] != data[np.minimum(other, len(data) - 1)], first) > 0
        wrong = np.flatnonzero(differ | (size != size[example][which]))
        if len(wrong):
            known: dict[bytes, int] = {}
            for i in wrong.tolist():
                which[i] = known.setdefault(self.word(i), len(example) + len(known))
            firsts: dict[int, int] = {}
            for i in wrong.tolist():
                firsts.setdefault(int(which[i]), i)
            example = np.concatenate([example, np.array([firsts[k] for k in sorted(firsts)], example.dtype)])
        return example, which

    def window_hashes(self, length: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows that lie within one text, and each one's first word."""
        hashes = self.hashes() if hashes is None else hashes
        every = windows(hashes, length)
        if not len(every):
            return every, np.empty(0, np.int64)
        end = np.repeat(self.first[1:], np.diff(self.first))[: len(every)]
        at = np.flatnonzero(np.arange(len(every)) + length <= end)
        return every[at], at

    def word(self, i: int) -> bytes:
        return self.kind.fold[self.data[self.starts[i] : self.ends[i]]].tobytes()

    def words(self, lo: int, hi: int) -> list[bytes]:
        if hi <= lo:
            return []
        base = int(self.starts[lo])
        raw = self.kind.fold[self.data[base : self.ends[hi - 1]]].tobytes()
        return [raw[s - base : e - base] for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist())]


def _plain(texts) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    return texts.cast(pa.large_string())


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about most_bytes of a string or list column, a row at least."""
    n, values = batch.num_rows, batch.column(column)
    if isinstance(values, pa.ListArray):
        size = values.offsets.to_numpy()[: n + 1].astype(np.int64)
    else:
        size = np.append(0, np.cumsum(np.nan_to_num(pc.binary_length(values).to_numpy(zero_copy_only=False)))).astype(np.int64)
    lo = 0
    while lo < n or not lo:
        hi = min(n, max(lo + 1, int(np.searchsorted(size, size[lo] + most_bytes, "right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = max(hi, 1)


def chunks(texts, kind: WordClass, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Words of an Arrow array of texts, in order; a null text counts as empty."""
    texts = _plain(texts)
    n = len(texts)
    if not n:
        return
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, "right")) - 1)
        hi = min(hi, n)
        yield _chunk(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], kind)
        lo = hi


def _chunk(row: int, data: np.ndarray, offsets: np.ndarray, kind: WordClass) -> Chunk:
    inside = kind.member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Chunk(row, data, starts, ends, np.searchsorted(starts, offsets), kind, offsets)
