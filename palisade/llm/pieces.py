"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

A batch's distinct words (white space leads a word) are grouped by length, and
words of equal length advance one character together. At each character, hashes
of the substrings that end there probe the sorted hashes of the pieces; the best
admissible piece is a vectorised maximum, and its length the backpointer.

For a unigram model the maximum is over summed piece scores. A BPE model has no
such scores: its result is the one segmentation in which every two neighbours are
what merging their joint text gives, so there the maximum runs over the pieces,
the longest first, that are admissible after the best path's last piece. Both
give the ids that the model defines. Characters without a piece become bytes.

A long word is first cut at the characters that no piece spans, which changes
nothing, as no path has a piece there. The stretches join the batch; long ones
with few equals to advance with are walked by the same recurrence with plain
look-ups, so unbroken text takes time in proportion to its length.

A literal U+2581, which a vocabulary cannot tell from a space, becomes bytes too,
so decoding gives every text back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

_SPACE = 0x2581
_LITERAL = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd, so that no two hashes meet: short texts have small ones, which this spreads.
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_SEEN_BITS, _FIRST_BITS = 20, 18
#: Pairs of pieces whose admissibility a worker remembers, each in one place.
_MEMO_BITS = 20
CHUNK_BYTES = 2 << 20
#: Characters from which a word is cut, and from which stretches of a length with fewer than FEW of them are walked; all are from the last on.
LONG_WORD, WALKED, ALL_WALKED, FEW = 48, 16, 256, 32


def _key(points: list[int]) -> int:
    h = 0
    for c in points:
        h = (h * int(_BASE) + c + 1) & W._MASK
    return h


@dataclass
class Pieces:
    """A vocabulary: piece texts by id, scores, and which ids are bytes."""

    texts: list[str]
    scores: np.ndarray
    normal: np.ndarray
    byte_of: np.ndarray
    bpe: bool
    keys: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)

    def __post_init__(self):
        usable = np.flatnonzero(self.normal)
        hashes = np.array([_key(list(map(ord, self.texts[i]))) for i in usable], np.uint64)
        keys = hashes * _SPREAD
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], usable[order]
        # Where the sorted keys of each leading bit pattern begin, and how many one has at most.
        bounds = np.searchsorted(self.keys >> np.uint64(64 - _FIRST_BITS), np.arange((1 << _FIRST_BITS) + 1, dtype=np.uint64))
        self.first, self.most = np.minimum(bounds[:-1], max(0, len(self.keys) - 1)), int(np.diff(bounds).max())
        self.longest = max((len(self.texts[i]) for i in usable), default=1)
        self.seen = np.zeros(1 << _SEEN_BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)] = True
        self.byte_id = np.zeros(256, np.int64)
        self.byte_id[self.byte_of[self.byte_of >= 0]] = np.flatnonzero(self.byte_of >= 0)
        self.hash_of = np.zeros(len(self.texts), np.uint64)
        self.hash_of[usable] = hashes
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.powers = np.array([pow(int(_BASE), i, 1 << 64) for i in range(2 * self.longest + 1)], np.uint64)
        raw = [bytes([b]) if b >= 0 else (t.replace(chr(_SPACE), " ").encode() if n else b"") for t, b, n in zip(self.texts, self.byte_of.tolist(), self.normal.tolist())]
        self.bytes_at = np.append(0, np.cumsum([len(x) for x in raw]))
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        if self.bpe:
            self._merges()

    @staticmethod
    def load(path: str) -> "Pieces":
        """From a SentencePiece model file."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kind = type(model.pieces[0])
        byte_of = [int(p.piece[3:5], 16) if p.type == kind.BYTE else -1 for p in model.pieces]
        return Pieces(
            [p.piece for p in model.pieces],
            np.array([p.score for p in model.pieces], np.float64),
            np.array([p.type in (kind.NORMAL, kind.USER_DEFINED) for p in model.pieces]),
            np.array(byte_of, np.int64),
            model.trainer_spec.model_type == model.trainer_spec.BPE,
        )

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there are none."""
        out = np.full(len(hashes), -1, np.int64)
        keys = hashes * _SPREAD
        some = np.flatnonzero(self.seen[(keys >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)])
        wanted = keys[some]
        at = self.first[(wanted >> np.uint64(64 - _FIRST_BITS)).astype(np.int64)]
        for _ in range(self.most):
            good = self.keys[at] == wanted
            out[some[good]] = self.ids[at[good]]
            rest = ~good
            some, wanted, at = some[rest], wanted[rest], np.minimum(at[rest] + 1, len(self.keys) - 1)
            if not len(some):
                break
        return out

    def _merges(self) -> None:
        """Merge ranks, and each piece's two halves in its own last merge; a single character is its own."""
        size = len(self.texts)
        order = sorted(np.flatnonzero(self.normal).tolist(), key=lambda i: (len(self.texts[i]) > 1, -self.scores[i], i))
        self.rank = np.zeros(size, np.int64)
        self.rank[order] = np.arange(len(order))
        rank = {self.texts[i]: int(self.rank[i]) for i in order}
        number = {self.texts[i]: i for i in order}
        self.left, self.right = np.arange(size), np.arange(size)
        self.reachable = np.zeros(size, bool)
        for i in order:
            text = self.texts[i]
            if len(text) == 1:
                self.reachable[i] = True
                continue
            parts = list(text)
            while len(parts) > 2:
                best, k = min((rank.get(a + b, size), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == size:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2 and parts[0] in number and parts[1] in number:
                self.left[i], self.right[i] = number[parts[0]], number[parts[1]]
                self.reachable[i] = True

    def admissible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """_admissible with a memory of pairs met before."""
        memo = self.__dict__.get("memo")
        if memo is None:
            memo = self.memo = (np.full(1 << _MEMO_BITS, -1, np.int64), np.zeros(1 << _MEMO_BITS, bool))
        pair = one * len(self.texts) + two
        place = ((pair.astype(np.uint64) * _BASE) >> np.uint64(64 - _MEMO_BITS)).astype(np.int64)
        out = memo[1][place]
        new = np.flatnonzero(memo[0][place] != pair)
        if len(new):
            out[new] = self._admissible(one[new], two[new])
            memo[0][place[new]], memo[1][place[new]] = pair[new], out[new]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "plain")}

    def _admissible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging the joint text of two pieces leaves just these two.

        Their inner borders are undone from the latest merge back; a merge across
        the border that comes before the merge it would need to wait for forbids the pair.
        """
        out = np.ones(len(one), bool)
        live = np.arange(len(one))
        a, b = one, two
        limit = np.full(len(one), np.iinfo(np.int64).max)
        while len(live):
            joint = self.find(self.hash_of[a] * self.powers[self.length[b]] + self.hash_of[b])
            bad = (joint >= 0) & (self.rank[joint] < limit)
            out[live[bad]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            leaf_a, leaf_b = self.length[a] == 1, self.length[b] == 1
            first = rank_a > rank_b
            open_a = (first & ~leaf_a) | (~first & leaf_b & ~leaf_a)
            open_b = ~open_a & ~leaf_b
            go = ~bad & (open_a | open_b)
            limit = np.where(open_a, rank_a, rank_b + 1)[go]
            a, b = np.where(open_a, self.right[a], a)[go], np.where(open_b, self.left[b], b)[go]
            live = live[go]
        return out

    def segment(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of m words of n characters each, an (m, n + 1) array of the best path's last piece and of its length.

        -1 marks a character without a piece.
        """
        m, n = points.shape
        sums = np.zeros((n + 1, m), np.uint64)
        for i in range(n):
            sums[i + 1] = sums[i] * _BASE + points[:, i] + np.uint64(1)
        last, back = np.full((n + 1, m), -1, np.int64), np.ones((n + 1, m), np.int64)
        best = np.zeros((n + 1, m))
        lowest = float(self.scores[self.normal].min(initial=0)) - 10
        for i in range(1, n + 1):
            open_ = np.arange(m)
            if not self.bpe:
                best[i] = best[i - 1] + lowest
            for size in range(min(i, self.longest), 0, -1):
                j = i - size
                ids = self.find(sums[i, open_] - sums[j, open_] * self.powers[size])
                hit = np.flatnonzero(ids >= 0)
                if not len(hit):
                    continue
                row, ids = open_[hit], ids[hit]
                if self.bpe:
                    good = self.reachable[ids].copy()
                    if j:
                        before = last[j, row]
                        ask = np.flatnonzero(good & (before >= 0))
                        good[ask] = self.admissible(before[ask], ids[ask])
                    row, ids, hit = row[good], ids[good], hit[good]
                    open_ = np.delete(open_, hit)
                else:
                    score = best[j, row] + self.scores[ids]
                    more = score > best[i, row]
                    row, ids = row[more], ids[more]
                    best[i, row] = score[more]
                last[i, row], back[i, row] = ids, size
                if not len(open_):
                    break
        return last, back

    def stretches(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bounds of the words, with long ones cut wherever no piece spans two neighbouring characters."""
        if not (np.diff(bounds) >= LONG_WORD).any():
            return bounds
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        inside = np.repeat(np.diff(bounds) >= LONG_WORD, np.diff(bounds))
        end = np.repeat(bounds[1:], np.diff(bounds))
        spanned = np.zeros(n + 2, np.int64)
        at = np.flatnonzero(inside)
        hashes = points[at].astype(np.uint64) + np.uint64(1)
        for size in range(2, self.longest + 1):
            keep = at + size <= end[at]
            at, hashes = at[keep], hashes[keep] * _BASE + points[at[keep] + size - 1].astype(np.uint64) + np.uint64(1)
            hit = at[self.find(hashes) >= 0]
            spanned[hit + 1] += 1
            spanned[hit + size] -= 1
        free = np.cumsum(spanned)[: n + 1] == 0
        free[:-1] &= inside
        return np.flatnonzero(free | edge)

    def walk(self, points: np.ndarray) -> list[int]:
        """segment() for one stretch: the ids of its best path, -1 less the code point where there is no piece."""
        plain = self.__dict__.get("plain")
        if plain is None:
            usable = np.flatnonzero(self.normal).tolist()
            parts = (self.left.tolist(), self.right.tolist(), self.rank.tolist(), self.reachable.tolist()) if self.bpe else ((), (), (), ())
            plain = self.plain = ({self.texts[i]: i for i in usable}, {}, *parts)
        number, met, left, right, rank, reachable = plain
        text = points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass") if points.max() < _LITERAL else "".join(chr(c) if c < _LITERAL else "\x00" for c in points.tolist())
        texts, n, longest = self.texts, len(text), self.longest

        def admits(a: int, b: int) -> bool:
            limit = 1 << 62
            while True:
                joint = number.get(texts[a] + texts[b])
                if joint is not None and rank[joint] < limit:
                    return False
                leaf_a, leaf_b = len(texts[a]) == 1, len(texts[b]) == 1
                if not leaf_a and (leaf_b or rank[a] > rank[b]):
                    limit, a = rank[a], right[a]
                elif not leaf_b:
                    limit, b = rank[b] + 1, left[b]
                else:
                    return True

        last, back = [-1] * (n + 1), [1] * (n + 1)
        best, scores = [0.0] * (n + 1), self.scores
        lowest = float(self.scores[self.normal].min(initial=0)) - 10
        for i in range(1, n + 1):
            best[i] = best[i - 1] + lowest
            for size in range(min(i, longest), 0, -1):
                one = number.get(text[i - size : i])
                if one is None:
                    continue
                j = i - size
                if not self.bpe:
                    if best[j] + scores[one] > best[i]:
                        best[i], last[i], back[i] = best[j] + scores[one], one, size
                    continue
                if not reachable[one]:
                    continue
                before = last[j]
                if j and before >= 0:
                    good = met.get((before, one))
                    if good is None:
                        if len(met) > 1 << _MEMO_BITS:
                            met.clear()
                        good = met[before, one] = admits(before, one)
                    if not good:
                        continue
                last[i], back[i] = one, size
                break
        out, i = [], n
        while i:
            out.append(last[i] if last[i] >= 0 else -1 - int(points[i - 1]))
            i -= back[i]
        return out[::-1]

    def encode_words(self, points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of code points, and each word's bounds among them."""
        bounds = self.stretches(points, words)
        ids, cuts = self._encode_stretches(points, bounds)
        return ids, cuts[np.searchsorted(bounds, words)]

    def _encode_stretches(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(bounds)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        many = np.bincount(size)
        alone = (size >= ALL_WALKED) | ((size >= WALKED) & (many[size] < FEW))
        for k in np.flatnonzero(alone).tolist():
            ids = self.walk(points[bounds[k] : bounds[k + 1]])
            found.append((np.full(len(ids), k), np.arange(len(ids), 0, -1), np.array(ids, np.int64)))
        for n in np.unique(size[~alone]).tolist():
            rows = np.flatnonzero(size == n)
            for part in np.array_split(rows, -(-len(rows) * n // (1 << 19))):
                text = points[bounds[part][:, None] + np.arange(n)].astype(np.uint64)
                last, back = self.segment(text)
                at, live, step = np.full(len(part), n), np.arange(len(part)), 0
                while len(live):
                    where = at[live]
                    ids = last[where, live]
                    found.append((part[live], np.full(len(live), step), np.where(ids >= 0, ids, -1 - text[live, where - 1].astype(np.int64))))
                    at[live] -= back[where, live]
                    live = live[at[live] > 0]
                    step += 1
        if not found:
            return np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
        word, step, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-step, word))
        word, ids = word[order], ids[order]
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            point = -1 - ids[unknown]
            point[point == _LITERAL] = _SPACE
            as_bytes = [chr(c).encode() for c in point.tolist()]
            times = np.ones(len(ids), np.int64)
            times[unknown] = [len(x) for x in as_bytes]
            first = np.cumsum(times) - times
            word, ids = np.repeat(word, times), np.repeat(ids, times)
            fill = np.repeat(first[unknown], times[unknown]) + np.concatenate([np.arange(len(x)) for x in as_bytes])
            ids[fill] = self.byte_id[np.frombuffer(b"".join(as_bytes), np.uint8)]
        return ids, np.searchsorted(word, np.arange(len(bounds)))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts, and each text's bounds; a null or empty text has none."""
        texts = W._plain(texts)
        spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        ids, ends, done = [np.empty(0, np.int64)], [np.zeros(1, np.int64)], 0
        for chunk in W.chunks(spaced, W.SPACED, CHUNK_BYTES):
            flat, bounds = self._encode_chunk(chunk)
            ids.append(flat)
            ends.append(bounds[1:] + done)
            done += len(flat)
        return np.concatenate(ids), np.concatenate(ends)

    def _encode_chunk(self, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        data = chunk.data
        if not len(data):
            return np.empty(0, np.int64), np.zeros(chunk.n_texts + 1, np.int64)
        space, control = data == 32, (data < 32) | (data == 127)
        start = control.copy()
        start[0] = True
        start[1:] |= (space[1:] & ~space[:-1]) | control[:-1]
        start[chunk.offsets[:-1][chunk.offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        whole = W.Chunk(0, data, starts, ends, np.searchsorted(starts, chunk.offsets), W.SPACED)
        example, which = whole.distinct()
        lo, size = starts[example], (ends - starts)[example]
        at = np.append(0, np.cumsum(size))
        raw = data[np.repeat(lo - at[:-1], size) + np.arange(at[-1])]
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        char = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        points = np.where(points == _SPACE, _LITERAL, np.where(points == 32, _SPACE, points))
        ids, bounds = self.encode_words(points, char[at])
        count = np.diff(bounds)[which]
        upto = np.append(0, np.cumsum(count))
        flat = ids[np.repeat(bounds[which] - upto[:-1], count) + np.arange(upto[-1])]
        return flat, upto[whole.first]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of runs of ids; what is not UTF-8 becomes U+FFFD."""
        size = (self.bytes_at[1:] - self.bytes_at[:-1])[ids]
        upto = np.append(0, np.cumsum(size))
        raw = self.bytes[np.repeat(self.bytes_at[ids] - upto[:-1], size) + np.arange(upto[-1])]
        cut = upto[bounds]
        first = cut[:-1].copy()
        lead = (first < cut[1:]) & (raw[np.minimum(first, max(0, len(raw) - 1))] == 32) if len(raw) else np.zeros(len(first), bool)
        keep = np.ones(len(raw), bool)
        keep[first[lead]] = False
        cut = cut - np.append(0, np.cumsum(lead))
        raw = raw[keep]
        try:
            texts = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(raw)])
            texts.validate(full=True)
        except pa.ArrowInvalid:
            texts = pa.array([raw[a:b].tobytes().decode(errors="replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.large_string())
        return texts


def encoded(docs: DataFrame, pieces: Pieces, text: str = "text", out: str = "ids", check: str | None = None) -> DataFrame:
    """docs with a column of piece ids; null for a null text, none for an empty one.

    check names a further column: whether the ids decode to the text, null for a
    null text. No rows are dropped or moved. Columns of these names in docs are
    replaced.
    """

    def convert(column: pa.Array, pieces: Pieces) -> list[pa.Array]:
        ids = _encode_column(column, pieces)
        return [ids] if check is None else [ids, pc.equal(_decode_column(ids, pieces), column.cast(pa.string()))]

    fields = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(check, T.BooleanType())] if check else [])]
    return _with(docs, pieces, text, fields, convert)


def decoded(docs: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "text") -> DataFrame:
    """docs with the text of a column of piece ids; null for null."""
    return _with(docs, pieces, ids, [T.StructField(out, T.StringType())], lambda column, pieces: [_decode_column(column, pieces)])


def _encode_column(column: pa.Array, pieces: Pieces) -> pa.Array:
    ids, bounds = pieces.encode(column)
    flat = pa.array(ids.astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat, mask=column.is_null() if column.null_count else None)


def _decode_column(column: pa.Array, pieces: Pieces) -> pa.Array:
    lists = column.fill_null([]) if column.null_count else column
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    texts = pieces.decode(lists.flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(size))).cast(pa.string())
    return pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string())) if column.null_count else texts


def _with(docs: DataFrame, pieces: Pieces, source: str, new: list[T.StructField], convert) -> DataFrame:
    """Adds columns made from one, in parts of a batch of bounded bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    names = [field.name for field in new]
    stay = [name for name in docs.columns if name not in names]
    rows = docs.select(*[F.col(f"`{name}`") for name in stay], F.col(f"`{source}`").alias("\x00source"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, batch.num_columns - 1, CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *convert(part.columns[-1], sent.value)], [*stay, *names])

    return rows.mapInArrow(apply, T.StructType([*rows.schema.fields[:-1], *new]))
