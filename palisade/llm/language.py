"""Language identification of words by Viterbi with a switching penalty.

A word's script, read from its characters' ranges, leaves only the languages
written in it. Each of these scores the word by the log probabilities of its byte
trigrams, learned from labelled documents. The best labelling of a document's
words pays a penalty for every switch, so stray look-alikes do not break a
passage while passages of another language come out as spans of their own. All
documents of a chunk advance together, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Labelled documents of each language that the model is fitted on, about; all of a language that has fewer.
SAMPLE = 3000
BUCKETS = 1 << 16
SWITCH_PENALTY = 8.0
UNKNOWN = "und"
#: A language counts as written in a script with at least this share of its letters.
SCRIPT_SHARE = 0.002
CHUNK_BYTES = 4 << 20

#: Where the ranges of scripts begin, by code point: fixed values of the character set. 0 is Latin.
_RANGES = [
    (0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0700, 6), (0x0750, 5), (0x0780, 6), (0x08A0, 5),
    (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 11), (0x0B80, 12), (0x0C00, 13), (0x0C80, 14), (0x0D00, 15), (0x0D80, 16),
    (0x0E00, 17), (0x0E80, 18), (0x0F00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x13A0, 24), (0x1780, 25), (0x1800, 26), (0x18B0, 24),
    (0x1C90, 21), (0x1CC0, 24), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x2C00, 24), (0x2C60, 0), (0x2C80, 24), (0x2D00, 21), (0x2D30, 24),
    (0x2DE0, 2), (0x2E00, 24), (0x2E80, 27), (0x3040, 28), (0x3100, 27), (0x3130, 22), (0x3190, 27), (0x31F0, 28), (0x3200, 27), (0xA000, 24),
    (0xA640, 2), (0xA6A0, 24), (0xA720, 0), (0xA800, 24), (0xAB30, 0), (0xAB70, 24), (0xAC00, 22), (0xD7FC, 24), (0xF900, 27), (0xFB00, 0),
    (0xFB13, 3), (0xFB1D, 4), (0xFB50, 5), (0xFE00, 24), (0xFE70, 5), (0xFF00, 0), (0xFF65, 28), (0xFFA0, 22), (0x10000, 24), (0x20000, 27),
]
_RANGE_AT, _RANGE_SCRIPT = (np.array(x, np.int64) for x in zip(*_RANGES))
N_SCRIPTS = int(_RANGE_SCRIPT.max()) + 1

#: The small letter of each character of two bytes, where that is one of two bytes too.
_SMALL = np.arange(0x800)
for _point in range(0x80, 0x800):
    _low = chr(_point).lower()
    if len(_low) == 1 and 0x80 <= ord(_low) < 0x800:
        _SMALL[_point] = ord(_low)

_LETTERS = W.WordClass.build(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


def _not_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of characters beyond ASCII that are signs: U+0080-00BF, U+2000-2BFF, U+3000-303F."""
    out = np.zeros(len(data), bool)
    two = np.flatnonzero(data == 0xC2)
    three = np.flatnonzero((data == 0xE2) | (data == 0xE3))
    second = data[np.minimum(three + 1, len(data) - 1)]
    three = three[((data[three] == 0xE2) & (second < 0xB0)) | ((data[three] == 0xE3) & (second == 0x80))]
    for at, size in ((two, 2), (three, 3)):
        for k in range(size):
            out[np.minimum(at + k, len(data) - 1)] = True
    return out


def letter_chunks(texts, most_bytes: int = CHUNK_BYTES) -> Iterator[W.Chunk]:
    """Runs of letters as words, in chunks."""
    for chunk in W.chunks(texts, _LETTERS, most_bytes):
        signs = _not_letters(chunk.data) if len(chunk.data) else np.zeros(0, bool)
        if signs.any():
            inside = _LETTERS.member[chunk.data] & ~signs
            edge = np.zeros(len(inside) + 1, bool)
            edge[chunk.offsets] = True
            starts, ends = inside.copy(), inside.copy()
            starts[1:] &= ~inside[:-1] | edge[1:-1]
            ends[:-1] &= ~inside[1:] | edge[1:-1]
            starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
            chunk = W.Chunk(chunk.row, chunk.data, starts, ends, np.searchsorted(starts, chunk.offsets), _LETTERS, chunk.offsets)
        yield chunk


def _lowered(data: np.ndarray) -> np.ndarray:
    low = _LETTERS.fold[data]
    lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xDF))
    point = _SMALL[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    low[lead], low[lead + 1] = 0xC0 | point >> 6, 0x80 | point & 63
    return low


def _points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters beyond ASCII that begin at these places of UTF-8 bytes."""
    byte = lambda k: raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64)
    lead = byte(0)
    two = (lead & 0x1F) << 6 | byte(1) & 0x3F
    three = (lead & 0x0F) << 12 | (byte(1) & 0x3F) << 6 | byte(2) & 0x3F
    four = (lead & 0x07) << 18 | (byte(1) & 0x3F) << 12 | (byte(2) & 0x3F) << 6 | byte(3) & 0x3F
    return np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))


@dataclass
class _Words:
    """Distinct words of a chunk: their trigrams with bounds, scripts and letters, and which word is which."""

    which: np.ndarray
    trigrams: np.ndarray
    bounds: np.ndarray
    script: np.ndarray
    letters: np.ndarray


def _distinct(chunk: W.Chunk) -> _Words:
    example, which = chunk.distinct()
    lo, size = chunk.starts[example], (chunk.ends - chunk.starts)[example]
    at = np.append(0, np.cumsum(size))
    place = np.repeat(lo - at[:-1], size) + np.arange(at[-1])
    raw = _lowered(chunk.data)[place].astype(np.uint64) if len(place) else np.empty(0, np.uint64)
    before, after = np.full(len(raw), 32, np.uint64), np.full(len(raw), 32, np.uint64)
    before[1:], after[:-1] = raw[:-1], raw[1:]
    before[at[:-1]] = 32
    after[at[1:] - 1] = 32
    trigrams = (W.mix(before << np.uint64(16) | raw << np.uint64(8) | after) % np.uint64(BUCKETS)).astype(np.int64)
    lead = np.flatnonzero(raw >= 0xC2)
    script = np.zeros(len(size), np.int64)
    if len(lead):
        word = np.repeat(np.arange(len(size)), size)[lead]
        np.maximum.at(script, word, _RANGE_SCRIPT[np.searchsorted(_RANGE_AT, _points(raw, lead), "right") - 1])
    head = np.append(0, np.cumsum((raw & np.uint64(0xC0)) != 0x80))
    return _Words(which, trigrams, at, script, head[at[1:]] - head[at[:-1]])


@dataclass
class Model:
    """Log probabilities by trigram and language, and the scripts of each language."""

    languages: list[str]
    log: np.ndarray
    scripts: np.ndarray

    def emissions(self, words: _Words) -> np.ndarray:
        """Each distinct word's score by language, at most 0; -50 a letter where the script is not the language's."""
        upto = np.zeros((len(words.trigrams) + 1, len(self.languages)))
        np.cumsum(self.log[words.trigrams], axis=0, out=upto[1:])
        score = upto[words.bounds[1:]] - upto[words.bounds[:-1]]
        score -= score.max(axis=1, keepdims=True)
        allowed = self.scripts[:, words.script].T
        allowed[~allowed.any(axis=1)] = True
        score = np.where(allowed, score, -50.0 * words.letters[:, None])
        return score - score.max(axis=1, keepdims=True)


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; rows first[i]:first[i + 1] of score are those of text i.

    Of equal paths the one that does not switch, then the lower language.
    """
    n_words = np.diff(first)
    order = np.argsort(-n_words, kind="stable")
    begin, size = first[:-1][order], n_words[order]
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    jump = np.zeros(len(score), np.int16)
    stay = np.ones(score.shape, bool)
    state = np.zeros(len(score), np.int64)
    value = np.zeros((len(order), score.shape[1]))
    last = np.zeros((len(order), score.shape[1]))
    for t, n in enumerate(active.tolist()):
        at = begin[:n] + t
        now = value[:n]
        if t:
            best = now.argmax(axis=1)
            other = now[np.arange(n), best][:, None] - penalty
            keep = now >= other
            jump[at], stay[at] = best, keep
            now = np.where(keep, now, other)
        value[:n] = now + score[at]
        gone = active[t + 1] if t + 1 < len(active) else 0
        last[gone:n] = value[gone:n]
    if len(active):
        full = active[0]
        state[begin[:full] + size[:full] - 1] = last[:full].argmax(axis=1)
        for t in range(len(active) - 1, 0, -1):
            at = begin[: active[t]] + t
            own = state[at]
            state[at - 1] = np.where(stay[at, own], own, jump[at])
    return state


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("lang_pred", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))),
    ]
)


def _label(batches: Iterator[pa.RecordBatch], model: Model, penalty: float) -> Iterator[pa.RecordBatch]:
    names = np.array(model.languages, object)
    # Scores take a number for each word and language.
    most_bytes = max(1 << 16, CHUNK_BYTES * 8 // max(8, len(names)))
    for batch in batches:
        best, share, spans = [], [], []
        for chunk in letter_chunks(batch["text"], most_bytes):
            words = _distinct(chunk)
            n, owner = chunk.n_texts, chunk.owner()
            score = model.emissions(words)[words.which]
            state = viterbi(score, chunk.first, penalty)
            letters = words.letters[words.which]
            total = np.bincount(owner * len(names) + state, letters, n * len(names)).reshape(n, -1)
            top = total.argmax(axis=1)
            whole = total.sum(axis=1)
            new = np.ones(len(state), bool)
            new[1:] = (state[1:] != state[:-1]) | (owner[1:] != owner[:-1])
            cut = np.flatnonzero(new)
            stop = np.append(cut[1:], len(state))
            bounds = np.searchsorted(owner[cut], np.arange(n + 1))
            for i in range(n):
                known = whole[i] > 0 and (_ascii_letter(chunk, i) or any(map(str.isalpha, batch["text"][chunk.row + i].as_py())))
                best.append(names[top[i]] if known else UNKNOWN)
                share.append(float(total[i, top[i]] / whole[i]) if known else 0.0)
                own = range(bounds[i], bounds[i + 1]) if known else ()
                base = chunk.first[i]
                spans.append([{"lang": names[state[cut[k]]], "first_word": int(cut[k] - base), "end_word": int(stop[k] - base)} for k in own])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(best, pa.string()), pa.array(share, pa.float64()), pa.array(spans, _OUT.types[3])], schema=_OUT)


def _ascii_letter(chunk: W.Chunk, i: int) -> bool:
    lo, hi = chunk.first[i], chunk.first[i + 1]
    return bool((chunk.data[chunk.starts[lo:hi]] < 0x80).any())


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams and script letters of labelled texts; a script's bucket is -1 less its number."""
    for batch in batches:
        labels = batch["lang"].to_pylist()
        number = {lang: k for k, lang in enumerate(dict.fromkeys(labels))}
        own = np.array([number[x] for x in labels], np.int64)
        counts = np.zeros((len(number), BUCKETS), np.int64)
        scripts = np.zeros((len(number), N_SCRIPTS), np.int64)
        for chunk in letter_chunks(batch["text"]):
            words = _distinct(chunk)
            lang = own[chunk.row + chunk.owner()]
            for k in range(len(number)):
                times = np.bincount(words.which[lang == k], minlength=len(words.letters))
                counts[k] += np.bincount(words.trigrams, np.repeat(times, np.diff(words.bounds)), BUCKETS).astype(np.int64)
                scripts[k] += np.bincount(words.script, times * words.letters, N_SCRIPTS).astype(np.int64)
        every = np.concatenate([counts, scripts], axis=1)
        row, col = np.nonzero(every)
        keys = np.where(col < BUCKETS, col, BUCKETS - 1 - col)
        names = np.array(list(number), object)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(names[row], pa.string()), "bucket": pa.array(keys, pa.int64()), "n": pa.array(every[row, col], pa.int64())})


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fitted on about `sample` documents of each language, whole texts, chosen by a hash of their ids.

    A null id, text or language is not learned from. The driver gets one number
    for each language and trigram bucket, however many documents there are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, N_SCRIPTS), bool))
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, sample / sizes[name]))])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) / F.lit(float(1 << 53))
    chosen = rows.filter(draw < F.element_at(share, F.col("lang"))).select("text", "lang")
    found = chosen.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS + N_SCRIPTS))
    place = {name: k for k, name in enumerate(languages)}
    bucket = found["bucket"].to_numpy()
    counts[[place[x] for x in found["lang"].to_pylist()], np.where(bucket >= 0, bucket, BUCKETS - 1 - bucket)] = found["n"].to_numpy()
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    log = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    written_in = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(languages, np.ascontiguousarray(log.T), written_in)


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, spans of words of one language.

    lang_pred is the language of most letters and score their share; `und` and 0
    without a letter or a learned language. Rows that repeat are judged alike, an
    empty table gives no rows, a text of any length is read whole. Other columns of
    docs are not looked at, and nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first_word:bigint,end_word:bigint>>"
    if not model.languages:
        none = F.array().cast("array<struct<lang:string,first_word:bigint,end_word:bigint>>")
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("spans"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda batches: _label(batches, sent.value, penalty), kind)
