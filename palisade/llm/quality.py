"""Quality classifier: cumulative-link regression on graded ratings.

A document's grade is ordered: 0 poor, 1 well formed but toxic, 2 good. One vector
of hashed-text weights gives a score; thresholds that rise by construction cut it
into grades, P(grade <= k) = logistic(threshold_k - score). The expected grade
ranks documents, and the tail probability P(grade >= 2) selects them.

Features are hashed into FEATURES buckets: which words occur and how longer ones
begin, how much of the text each token shape makes up (letters, digits and signs
with repeats dropped), and bands of length, distinct words, capitals and word
length. The model is fitted on at most SAMPLE rated documents, chosen by a hash of
their ids. Their features are counted on the executors, and only those that go
with higher or lower grades get a weight: their grades' mean must lie so far from
that of all that, of features that tell nothing, FALSE_FEATURES are let through at
any size of the sample. These features alone are sent to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import free_names, same_columns, written

SAMPLE = 12_000
FEATURES = 1 << 22
LEAST_DOCS = 4
#: Features without a bearing on the grade that may pass as telling, among all.
FALSE_FEATURES = 10.0
EPOCHS = 40
GOOD = 2
#: Tail probability from which a document is selected.
KEEP = 0.5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
#: Bytes of a word's beginning that count as a feature, for inflected words.
_STEMS = (4, 6)
_SALT = {"word": 1, "shape": 2, "band": 3, "stem": 4}


def _salted(keys: np.ndarray, kind: str) -> np.ndarray:
    return (W.mix(keys + np.uint64(_SALT[kind] * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(FEATURES)).astype(np.uint32)


def _shapes(chunk: W.Chunk) -> np.ndarray:
    """Hash of each word's shape."""
    shape = _SHAPE[chunk.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[chunk.starts] = True
    nth = np.cumsum(keep) - 1
    return W.byte_hashes(shape[keep], nth[chunk.starts], nth[chunk.ends - 1] + 1)


def _tally(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key) in order, with counts."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], keys[first], np.diff(np.append(first, len(keys)))


def _band(value: np.ndarray, number: int, steps: int) -> np.ndarray:
    cut = np.clip((value * steps).astype(np.int64), 0, steps - 1)
    return _salted((cut + 1000 * number).astype(np.uint64), "band")


def featurise(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, texts, owner, feature, value) of each chunk; owners count from the first row."""
    for chunk in W.chunks(texts, W.SPACED):
        n = chunk.n_texts
        n_words = np.diff(chunk.first)
        owner = chunk.owner()
        own_s, shape, times = _tally(owner, _shapes(chunk))
        plain = W.Chunk(chunk.row, chunk.data, *_alnum(chunk), W.ALNUM_LOWER)
        plain_owner = plain.owner()
        own_w, word, _ = _tally(plain_owner, plain.hashes())
        stems = [_tally(plain_owner[long], _stem(plain, long, size))[:2] for size in _STEMS for long in [plain.ends - plain.starts > size]]
        distinct = np.bincount(own_w, minlength=n) / np.maximum(1, np.diff(plain.first))
        capitals = ((chunk.data >= 65) & (chunk.data <= 90)).astype(np.int64)
        upto = np.append(0, np.cumsum(capitals))
        lo = chunk.starts[np.minimum(chunk.first[:-1], max(0, len(chunk.starts) - 1))] if len(chunk.starts) else np.zeros(n, np.int64)
        hi = chunk.ends[np.maximum(chunk.first[1:] - 1, 0)] if len(chunk.starts) else np.zeros(n, np.int64)
        span = np.where(n_words > 0, hi - lo, 0)
        capital = np.where(n_words > 0, upto[hi] - upto[lo], 0) / np.maximum(1, span)
        every = np.arange(n)
        bands = [
            _band(np.minimum(np.log2(n_words + 1) / 16, 0.999), 1, 16),
            _band(distinct, 2, 10),
            _band(capital, 3, 10),
            _band(np.minimum(span / np.maximum(1, n_words) / 32, 0.999), 4, 16),
        ]
        yield (
            chunk.row,
            n,
            np.concatenate([own_w, own_s, *[own for own, _ in stems], *[every] * len(bands)]),
            np.concatenate([_salted(word, "word"), _salted(shape, "shape"), *[_salted(key, "stem") for _, key in stems], *bands]),
            np.concatenate([np.ones(len(own_w)), 2 * np.sqrt(times / n_words[own_s]), np.ones(sum(len(own) for own, _ in stems) + n * len(bands))]).astype(np.float32),
        )


def _stem(chunk: W.Chunk, long: np.ndarray, size: int) -> np.ndarray:
    cut = W.Chunk(chunk.row, chunk.data, chunk.starts[long], chunk.starts[long] + size, chunk.first, chunk.kind)
    return cut.hashes()


def _alnum(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alphanumeric words of the same texts; they lie inside the spaced ones."""
    inside = W.ALNUM_LOWER.member[chunk.data]
    starts, ends = inside.copy(), inside.copy()
    if len(inside):
        edge = np.zeros(len(inside) + 1, bool)
        edge[chunk.starts] = edge[chunk.ends] = True
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    word = np.searchsorted(chunk.starts, starts, "right") - 1
    return starts, ends, np.searchsorted(word, chunk.first)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights by sorted feature, and the thresholds below each grade but 0."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(FEATURES, np.float32)
        out[self.features] = self.weights
        return out

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return _logistic(score[:, None] - self.thresholds[None, :])


def least_z(tested: int, false_features: float = FALSE_FEATURES) -> float:
    """Standard errors that false_features of `tested` features without a bearing pass by chance."""
    return NormalDist().inv_cdf(1 - min(0.5, false_features / max(1, tested)) / 2)


def telling(feature: np.ndarray, seen: np.ndarray, grades: np.ndarray, mean: float, deviation: float, false_features: float = FALSE_FEATURES) -> np.ndarray:
    """Features, by the number and the summed grades of their documents, whose mean grade is far enough from that of all.

    The rest would only add noise that grows with a document's length.
    """
    known = seen >= LEAST_DOCS
    feature, seen, grades = feature[known], seen[known], grades[known]
    z = (grades / seen - mean) / (max(deviation, 1e-6) / np.sqrt(seen))
    return np.sort(feature[np.abs(z) >= least_z(len(feature), false_features)])


def fit(known: np.ndarray, owner: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, rate: float = 0.3, shrink: float = 1e-5) -> Model:
    """AdaGrad over small batches, with weights for the sorted features `known`; grades from 0, all below the highest + 1."""
    top = max(GOOD, int(grade.max())) if len(grade) else GOOD
    if not len(grade):
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), np.full(top, -30.0))
    use = np.flatnonzero(np.isin(feature, known))
    owner, col, value = owner[use], np.searchsorted(known, feature[use]), value[use].astype(np.float64)
    order = np.argsort(owner, kind="stable")
    owner, col, value = owner[order], col[order], value[order]
    bounds = np.searchsorted(owner, np.arange(len(grade) + 1))
    weight, memory = np.zeros(len(known)), np.full(len(known), 1e-3)
    share = np.clip(np.array([(grade < k).mean() for k in range(1, top + 1)]), 1e-3, 1 - 1e-3)
    cut = np.log(share / (1 - share))
    # The first threshold and the logs of the steps to the next ones.
    bend, bend_memory = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 0.1))]), np.full(top, 1e-3)
    batch = 64
    random = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for lo in random.permutation(np.arange(0, len(grade), batch)).tolist():
            hi = min(lo + batch, len(grade))
            a, b = bounds[lo], bounds[hi]
            row, c, v, y = owner[a:b] - lo, col[a:b], value[a:b], grade[lo:hi]
            score = np.bincount(row, weight[c] * v, hi - lo)
            cuts = np.concatenate([bend[:1], bend[0] + np.cumsum(np.exp(bend[1:]))])
            padded = np.concatenate([[-np.inf], cuts, [np.inf]])
            upper, lower = padded[y + 1] - score, padded[y] - score
            pu, pl = _logistic(upper), _logistic(lower)
            pu[np.isposinf(upper)], pl[np.isneginf(lower)] = 1.0, 0.0
            p = np.maximum(pu - pl, 1e-9)
            du, dl = pu * (1 - pu) / p, pl * (1 - pl) / p
            g = np.bincount(c, (du - dl)[row] * v, len(known)) / len(y)
            touched = np.flatnonzero(g)
            g = g[touched] + shrink * weight[touched]
            memory[touched] += g * g
            weight[touched] -= rate * g / np.sqrt(memory[touched])
            d_cut = np.zeros(top)
            np.add.at(d_cut, y[y < top], -du[y < top])
            np.add.at(d_cut, y[y > 0] - 1, dl[y > 0])
            d = np.concatenate([[d_cut.sum()], np.exp(bend[1:]) * np.cumsum(d_cut[::-1])[::-1][1:]]) / len(y)
            bend_memory += d * d
            bend -= rate * d / np.sqrt(bend_memory)
    cuts = np.concatenate([bend[:1], bend[0] + np.cumsum(np.exp(bend[1:]))])
    return Model(known, weight.astype(np.float32), cuts)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feats: list[bytes] = []
        values: list[bytes] = []
        for _, n, owner, feature, value in featurise(batch["text"]):
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(n + 1))
            feature, value = feature[order], value[order]
            for i in range(n):
                feats.append(feature[bounds[i] : bounds[i + 1]].tobytes())
                values.append(value[bounds[i] : bounds[i + 1]].tobytes())
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "grade": batch["grade"], "features": pa.array(feats, pa.binary()), "values": pa.array(values, pa.binary())})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and summed grades by feature; a document has a feature once."""
    for batch in batches:
        raw, grade = batch["features"].to_pylist(), batch["grade"].to_numpy()
        feature = np.concatenate([np.empty(0, np.uint32), *[np.frombuffer(x, np.uint32) for x in raw]])
        own = np.repeat(grade, [len(x) // 4 for x in raw]).astype(np.int64)
        seen, which = np.unique(feature, return_inverse=True)
        sums = np.bincount(which, own, len(seen)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(seen, pa.int64()), "seen": pa.array(np.bincount(which, minlength=len(seen)), pa.int64()), "grades": pa.array(sums, pa.int64())})


def _told_only(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feats, values = [], []
        for feature, value in zip(batch["features"].to_pylist(), batch["values"].to_pylist()):
            feature = np.frombuffer(feature, np.uint32)
            keep = np.isin(feature, known)
            feats.append(feature[keep].tobytes())
            values.append(np.frombuffer(value, np.float32)[keep].tobytes())
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "grade": batch["grade"], "features": pa.array(feats, pa.binary()), "values": pa.array(values, pa.binary())})


_SAMPLED = "doc_id long, grade int, features binary, values binary"


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text", false_features: float = FALSE_FEATURES) -> Model:
    """A model from rated documents; ratings with a null in any part are not used, of several for one id the least.

    Of documents that share an id, the one with the least hash of its text is used.
    Without ratings, or without documents for them, the model has no features and
    selects everything.
    """
    quality, toxic = F.col("quality"), F.col("toxic")
    rated = labels.filter(F.col("doc_id").isNotNull() & quality.isNotNull() & toxic.isNotNull())
    grade = F.when(quality <= 0, 0).when(toxic > 0, 1).otherwise(GOOD).cast("int")
    rated = rated.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    joined = rows.join(F.broadcast(chosen), "doc_id")  # at most `sample` ids and grades
    once = joined.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("grade").alias("grade"))
    features = written(once.mapInArrow(_sample_features, _SAMPLED), "features")
    n, mean, deviation = features.agg(F.count(F.lit(1)), F.avg("grade"), F.stddev_pop("grade")).first()
    if not n:
        return fit(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    counts = features.mapInArrow(_counted, "feature long, seen long, grades long").groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("grades").alias("grades"))
    # At most FEATURES rows of three numbers, fewer by those that are rare.
    found = counts.filter(F.col("seen") >= LEAST_DOCS).toArrow()
    known = telling(*(found[name].to_numpy() for name in ("feature", "seen", "grades")), mean, deviation, false_features)
    told = features.mapInArrow(lambda batches: _told_only(batches, known), _SAMPLED).toArrow()
    ids, grade = told["doc_id"].to_numpy(), told["grade"].to_numpy().astype(np.int64)
    order = np.lexsort((ids, W.mix(ids.astype(np.uint64))))
    raw, values = (told[name].combine_chunks() for name in ("features", "values"))
    size = pc.binary_length(raw).to_numpy()[order] // 4
    feature = _joined(raw, order, np.uint32).astype(np.int64)
    return fit(known, np.repeat(np.arange(len(order), dtype=np.int32), size), feature, _joined(values, order, np.float32), grade[order])


def _joined(column: pa.Array, order: np.ndarray, kind) -> np.ndarray:
    """The numbers of a column of binaries, row after row."""
    if not len(order):
        return np.empty(0, kind)
    return np.concatenate([np.frombuffer(column[i].as_buffer(), kind) for i in order.tolist()])


def _grade_texts(texts, model: Model, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    expected, tail = [np.empty(0)], [np.empty(0)]
    for _, n, owner, feature, value in featurise(texts):
        above = model.above(np.bincount(owner, dense[feature] * value, n))
        expected.append(above.sum(axis=1))
        tail.append(above[:, GOOD - 1])
    return np.concatenate(expected), np.concatenate(tail)


def graded(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with {prefix}expected_grade and {prefix}tail_probability; a null text counts as empty.

    No rows are dropped or moved, rows that repeat are judged alike, an empty table
    gives none, and a text of any length is read whole. Columns of docs that have
    these names are replaced.
    """
    names = [f"{prefix}expected_grade", f"{prefix}tail_probability"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    stay = [name for name in docs.columns if name not in names]
    if text not in stay:
        raise ValueError(f"no column {text!r} beside the new ones")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = sent.value.dense()
        for batch in batches:
            found = _grade_texts(batch[text], sent.value, dense)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*stay, *names])

    rows = docs.select(*[F.col(f"`{name}`") for name in stay])
    schema = T.StructType([*rows.schema.fields, *[T.StructField(name, T.DoubleType()) for name in names]])
    return rows.mapInArrow(apply, schema)


def kept_rows(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs whose tail probability is at least KEEP, all columns as they are."""
    (prefix,) = free_names(docs, "expected_grade", "tail_probability")[:1]
    prefix = prefix.removesuffix("expected_grade")
    marked = graded(docs, model, text, prefix)
    return same_columns(marked.filter(F.col(f"{prefix}tail_probability") >= KEEP), docs)
