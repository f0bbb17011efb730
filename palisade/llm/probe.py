"""Which keys occur in more than one block: a request and answer exchange.

A block is a bounded number of documents. Instead of a row for each key, a block
sends each fragment of the key space one binary of its own distinct keys, and
gets one binary back. A key that a third of all documents hold costs one entry
for each block, whatever its count, so no key makes a large group. Fragments are
cut by the key's top bits, so they are even, and their number follows the data.
Keys have 4 bytes (the fragment gives more), 8, or 16 with a second hash beside.

Where fragments are many, a block writes to groups of neighbouring fragments, and a
relay puts the messages of some blocks to one group together and deals them out by
fragment; answers come back the same way. So messages stay long at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import side

#: Text bytes in a block, and keys in a fragment, on average.
LEAST_BLOCK, MOST_BLOCK = 4 << 20, 32 << 20
FRAGMENT_KEYS = 1 << 20
#: Keys for a byte of text.
DENSITY = 0.16
#: Fragments that blocks write to themselves, at most; groups of fragments beyond that; keys in a relay's message.
MOST_DIRECT, GROUPS, RELAYED_KEYS = 8192, 4096, 1024

REQUEST = "fragment int, block int, keys binary, values binary"
ANSWER = "block int, fragment int, keys binary, values binary"


def block_count(total: int, rows: int) -> int:
    """Blocks grow with the root of the data up to a bound, so that requests stay long; rows bound them too."""
    size = min(MOST_BLOCK, max(LEAST_BLOCK, int((total * 8192) ** 0.5)))
    return max(1, -(-total // size), -(-rows // 200_000))


def fragment_count(total: int, density: float = DENSITY) -> int:
    return max(4, int(total * density) // FRAGMENT_KEYS + 1)


def fragment_of(keys: np.ndarray, fragments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def requests_table(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    f, b, k, v = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"fragment": pa.array(f, pa.int32()), "block": pa.array(b, pa.int32()), "keys": pa.array(k, pa.binary()), "values": pa.array(v, pa.binary())})


def _numbers(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Keys of some messages, and their second hashes if they have any."""
    every = np.frombuffer(b"".join(raw), "<u4" if width == 4 else "<u8")
    return (every[::2], every[1::2]) if width == 16 else (every, None)


def _dealt(parts: np.ndarray, count: int, *carried: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Arrays put in order of their entries' parts, and the parts' bounds."""
    order = np.argsort(parts, kind="stable")
    return np.searchsorted(parts[order], np.arange(count + 1)), [None if x is None else x[order] for x in carried]


def _cut(values: np.ndarray | None, lo: int, hi: int) -> bytes:
    return b"" if values is None else values[lo:hi].tobytes()


def _paired(keys: np.ndarray, check: np.ndarray | None) -> np.ndarray:
    return keys if check is None else np.stack([keys, check], axis=1)


@dataclass(frozen=True)
class Exchange:
    """How many blocks and fragments there are, groups of fragments that blocks write to, and blocks that share a relay."""

    blocks: int
    fragments: int
    groups: int
    span: int = 1

    @staticmethod
    def over(total: int, rows: int) -> "Exchange":
        """For so many bytes of text in so many rows."""
        blocks, fragments = block_count(total, rows), fragment_count(total)
        if fragments <= MOST_DIRECT:
            return Exchange(blocks, fragments, fragments)
        each = -(-fragments // GROUPS)
        sent = max(1, int(total * DENSITY / blocks / GROUPS))
        return Exchange(blocks, GROUPS * each, GROUPS, -(-RELAYED_KEYS * each // sent))

    @property
    def direct(self) -> bool:
        return self.groups == self.fragments

    def width(self, checked: bool) -> int:
        """Bytes of a key. Alone, and within a fragment of bounded size, two keys of 4 bytes agree by chance about once in four thousand, which is enough where a false match costs only time."""
        return 16 if checked else 4 if self.direct else 8

    def split(self, block: int, keys: np.ndarray, values: np.ndarray, check: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes, bytes]]:
        """One request a group for a block's distinct sorted keys."""
        if not len(keys):
            return
        each = self.fragments // self.groups
        bounds = np.searchsorted(fragment_of(keys, self.fragments) // each, np.arange(self.groups + 1))
        sent = keys.astype(np.uint32) if self.width(check is not None) == 4 else _paired(keys, check)
        for f in np.flatnonzero(np.diff(bounds)).tolist():
            lo, hi = bounds[f], bounds[f + 1]
            yield f, block, sent[lo:hi].tobytes(), values[lo:hi].tobytes()

    def answer(self, requests: DataFrame, reply: Callable, value: str, checked: bool = False) -> DataFrame:
        """Answers to every block: reply gets where each key's run begins, the run of each entry, and the values, by key.

        It returns which entries are answered, and a value of the same kind for each of these or None.
        """
        width = self.width(checked)
        if self.direct:
            return requests.groupBy("fragment").applyInArrow(lambda table: _answered(table, reply, width, value), ANSWER)
        relay = F.floor(F.col("block") / self.span).cast("int")
        out = requests.withColumn("relay", relay).groupBy("fragment", "relay").applyInArrow(lambda table: self._outward(table, width, value), f"{REQUEST}, sources binary")
        told = out.groupBy("fragment").applyInArrow(lambda table: _answered(table, reply, width, value), f"{ANSWER}, sources binary")
        group = F.floor(F.col("fragment") / (self.fragments // self.groups)).cast("int")
        return told.withColumn("group", group).groupBy("block", "group").applyInArrow(lambda table: self._homeward(table, width, value), ANSWER)

    def _outward(self, table: pa.Table, width: int, value: str) -> pa.Table:
        """Messages of a relay's blocks to one group, as one message a fragment with the block of each key."""
        raw, relay, each = table["keys"].to_pylist(), table["relay"][0].as_py(), self.fragments // self.groups
        keys, check = _numbers(raw, width)
        source = np.repeat(table["block"].to_numpy().astype("<i4"), [len(x) // width for x in raw])
        base = table["fragment"][0].as_py() * each
        bounds, (keys, check, source, values) = _dealt(fragment_of(keys, self.fragments) - base, each, keys, check, source, _values(table, value))
        some, sent = np.flatnonzero(np.diff(bounds)).tolist(), _paired(keys, check)
        cuts = [(bounds[f], bounds[f + 1]) for f in some]
        return pa.table(
            {
                "fragment": pa.array([base + f for f in some], pa.int32()),
                "block": pa.array([relay] * len(some), pa.int32()),
                "keys": pa.array([_cut(sent, *c) for c in cuts], pa.binary()),
                "values": pa.array([_cut(values, *c) for c in cuts], pa.binary()),
                "sources": pa.array([_cut(source, *c) for c in cuts], pa.binary()),
            }
        )

    def _homeward(self, table: pa.Table, width: int, value: str) -> pa.Table:
        """Answers of a group's fragments to one relay, as one message a block."""
        keys, check = _numbers(table["keys"].to_pylist(), width)
        source = np.frombuffer(b"".join(table["sources"].to_pylist()), "<i4")
        base, group = int(table["block"][0].as_py()) * self.span, table["group"][0].as_py()
        bounds, (keys, check, values) = _dealt(source - base, self.span, keys, check, _values(table, value))
        some, sent = np.flatnonzero(np.diff(bounds)).tolist(), _paired(keys, check)
        cuts = [(bounds[b], bounds[b + 1]) for b in some]
        return pa.table(
            {
                "block": pa.array([base + b for b in some], pa.int32()),
                "fragment": pa.array([group] * len(some), pa.int32()),
                "keys": pa.array([_cut(sent, *c) for c in cuts], pa.binary()),
                "values": pa.array([_cut(values, *c) for c in cuts], pa.binary()),
            }
        )

    def answers(self, table: pa.Table, value: str | None = None, checked: bool = False) -> "Answers":
        """What a block was answered."""
        return Answers(table, self.fragments, self.width(checked), value)


def _values(table: pa.Table, value: str) -> np.ndarray | None:
    """The messages' values, if they have any."""
    raw = b"".join(table["values"].to_pylist())
    return np.frombuffer(raw, value) if raw else None


def _answered(table: pa.Table, reply: Callable, width: int, value: str) -> pa.Table:
    """One fragment's answers, a message for each it got; sources come back where they were sent."""
    raw = table["keys"].to_pylist()
    keys, check = _numbers(raw, width)
    values = np.frombuffer(b"".join(table["values"].to_pylist()), value)
    sources = np.frombuffer(b"".join(table["sources"].to_pylist()), "<i4") if "sources" in table.column_names else None
    message = np.repeat(np.arange(len(raw), dtype=np.int32), [len(x) // width for x in raw])
    order = np.argsort(keys, kind="stable") if check is None else np.lexsort((check, keys))
    keys, check = keys[order], None if check is None else check[order]
    told, back = reply(*runs(keys, check), values[order])
    order = order[told]
    bounds, (keys, check, sources, back) = _dealt(message[order], len(raw), keys[told], None if check is None else check[told], None if sources is None else sources[order], back)
    some, sent = np.flatnonzero(np.diff(bounds)).tolist(), _paired(keys, check)
    cuts = [(bounds[i], bounds[i + 1]) for i in some]
    out = {
        "block": pa.array(table["block"].to_numpy()[some], pa.int32()),
        "fragment": pa.array([table["fragment"][0].as_py()] * len(some), pa.int32()),
        "keys": pa.array([_cut(sent, *c) for c in cuts], pa.binary()),
        "values": pa.array([_cut(back, *c) for c in cuts], pa.binary()),
    }
    return pa.table(out if sources is None else out | {"sources": pa.array([_cut(sources, *c) for c in cuts], pa.binary())})


def runs(keys: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each run of equal ones begins, and the run of each."""
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    if check is not None:
        new[1:] |= check[1:] != check[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


class Answers:
    """A block's answers: looks keys up by fragment."""

    def __init__(self, table: pa.Table, fragments: int, width: int, value: str | None = None):
        table = side(table, fragment=pa.int32(), keys=pa.binary(), values=pa.binary())
        raw = table["keys"].to_pylist()
        self.tags, self.check = _numbers(raw, width)
        self.fragments, self.width = fragments, width
        if width == 4:
            self.tags = self.tags | np.repeat(table["fragment"].to_numpy().astype(np.uint64) << np.uint64(32), [len(x) // 4 for x in raw])
        order = np.argsort(self.tags, kind="stable")
        self.tags = self.tags[order]
        self.check = None if self.check is None else self.check[order]
        self.values = np.frombuffer(b"".join(table["values"].to_pylist()), value)[order] if value else None

    def find(self, keys: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are answered, and each one's place among the answers."""
        tags = keys if self.width != 4 else keys & np.uint64(0xFFFFFFFF) | fragment_of(keys, self.fragments).astype(np.uint64) << np.uint64(32)
        if not len(self.tags):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.tags, tags), len(self.tags) - 1)
        known = self.tags[at] == tags
        if self.check is not None:
            known &= self.check[at] == check
            # Answers that share the first hash alone are looked through one by one.
            for i in np.flatnonzero(self.tags[1:] == self.tags[:-1]).tolist():
                known |= (tags == self.tags[i + 1]) & (check == self.check[i + 1])
        return known, at
