"""Secret scans: fixed patterns, and zstandard novelty of strings in sensitive contexts.

Three patterns find assignments, access keys and long hexadecimal runs. Beyond
these, a string near a sensitive word is a candidate; its novelty is the number
of bytes that it adds when its surroundings are compressed with it rather than
without it, by a compressor primed with a dictionary: the words and parts of
identifiers that most documents of the corpus hold, and some names that go with
secrets. Strings made of these or of parts of the surrounding code (copies of the
string left out) add little; keys and passwords add about their length, and those
are reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Words that make what follows sensitive.
_CONTEXT = re.compile(r"(?ai)auth|bearer|credential|private|passphrase|signature|session|cookie|api.?key|secret|token|passw|pwd")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Characters after a sensitive word in which candidates begin, and kept on both sides of one.
REACH, AROUND = 48, 256
#: Added bytes for each character from which a candidate is reported.
LEAST_NOVELTY = 0.7

#: Letters of a word in the dictionary, and words of the corpus in it: about as much as the compressor's window holds well.
LEAST_LETTERS, MOST_LETTERS, DICTIONARY_WORDS = 3, 10, 4000

_IDENTIFIERS = """
authorization bearer basic token access_token refresh_token id_token session_id session_key cookie csrf_token
api_key apikey api_secret client_id client_secret consumer_key private_key public_key secret_key access_key
password passwd passphrase credential credentials username user_name account signature fingerprint certificate
config configuration settings environment variable parameter property attribute default value string integer
boolean object array list dictionary function method class instance module package import export return
request response header headers content_type application json xml html text plain charset utf-8 encoding
connection database server hostname port localhost endpoint service region bucket container cluster instance
example sample test dummy placeholder changeme your_key_here your_token_here xxxxxxxxxxxxxxxx 0123456789 123456789
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef
"""


def dictionary(words: Sequence[str]) -> bytes:
    """The content that the compressor is primed with; the most common words come last, where references are short."""
    return (_IDENTIFIERS + " ".join(reversed(words))).encode()


class Novelty:
    """Marginal compressed bytes against a primed dictionary."""

    def __init__(self, words: Sequence[str] = ()):
        primed = zstandard.ZstdCompressionDict(dictionary(words), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.pack = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def added(self, before: str, candidate: str, after: str) -> int:
        around = (before + "\n" + after + "\n").encode()
        return len(self.pack.compress(around + candidate.encode())) - len(self.pack.compress(around))


_LETTERS = W.WordClass.build(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x100)]), lower=True)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by word: runs of letters, cut where a capital follows a small one, that touch no digit."""
    for batch in batches:
        found: dict[bytes, int] = {}
        for chunk in W.chunks(batch["text"], W.SPACED):
            data = chunk.data
            inside = _LETTERS.member[data]
            if not inside.any():
                continue
            capital, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
            fresh = inside.copy()
            fresh[1:] &= ~inside[:-1] | (capital[1:] & ~capital[:-1])
            edge = np.zeros(len(data) + 1, bool)
            edge[chunk.offsets] = True
            fresh |= inside & edge[:-1]
            starts = np.flatnonzero(fresh)
            stop = np.append(~inside[1:] | fresh[1:], True) & inside
            ends = np.flatnonzero(stop) + 1
            near = np.append(digit, False)[ends] | np.append(False, digit)[starts]
            good = (ends - starts >= LEAST_LETTERS) & (ends - starts <= MOST_LETTERS) & ~near
            words = W.Chunk(chunk.row, data, starts[good], ends[good], np.searchsorted(starts[good], chunk.offsets), _LETTERS, chunk.offsets)
            example, which = words.distinct()
            pair = np.unique(words.owner() * len(example) + which)
            times = np.bincount(pair % max(1, len(example)), minlength=len(example)).tolist()
            for i, n in zip(example.tolist(), times):
                word = words.word(i)
                found[word] = found.get(word, 0) + n
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in found], pa.string()), "n": pa.array(found.values(), pa.int64())})


def identifiers(docs: DataFrame, most: int = DICTIONARY_WORDS, text: str = "text") -> list[str]:
    """The words that most documents hold, counted over all of them; at most `most` come to the driver."""
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [row["word"] for row in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def _without_copies(text: str, lo: int, hi: int) -> tuple[str, str, str]:
    """What stands before a candidate, itself, and what stands after it, without its copies, whole or cut by the edge.

    Signs around a candidate do not make its copies others.
    """
    value = text[lo:hi]
    core = value.strip("+/_=-") or value
    wide = AROUND + len(core) - 1
    before, after = text[max(0, lo - wide) : lo], text[hi : hi + wide]
    first, last = max(0, len(before) - AROUND), min(len(after), AROUND)
    blank = "\n" * len(core)
    return before.replace(core, blank)[first:], value, after.replace(core, blank)[:last]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, known: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Candidates after sensitive words that overlap no known span and that their surroundings do not explain."""
    found, done = [], 0
    # The known spans as gaps to jump over: their starts, and how far any up to each reaches.
    starts, reach = [a for a, _, _ in known], list(accumulate((b for _, _, b in known), max))
    for word in _CONTEXT.finditer(text):
        stop = word.end() + REACH
        at = max(word.end(), done)
        while at < stop and (m := _CANDIDATE.search(text, at, max(stop, at) + REACH)) and m.start() < stop:
            lo, hi = _CANDIDATE.match(text, m.start()).span()
            at = done = hi
            before = bisect_left(starts, hi)
            if before and reach[before - 1] > lo:
                continue
            if novelty.added(*_without_copies(text, lo, hi)) >= LEAST_NOVELTY * (hi - lo):
                found.append((lo, 3, hi))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None, novelty: Novelty) -> tuple[int, int, int, int, str, str, list]:
    """Counts by kind, the digest of the pattern spans, all spans as text, and all with their strings."""
    text = text or ""
    base = base_spans(text)
    more = novel_spans(text, base, novelty)
    every = sorted(base + more)
    count = [sum(k == kind for _, k, _ in every) for kind in range(4)]
    return (*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), [(KINDS[k], a, b, text[a:b]) for a, k, b in every])


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        *[(f"n_{k}", pa.int64()) for k in KINDS],
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
        ("secrets", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch], words: Sequence[str]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty(words)
    for batch in batches:
        rows = [scan(text.as_py(), novelty) for text in batch["text"]]
        columns = list(zip(*rows)) if rows else [()] * 7
        secrets = [[dict(zip(("kind", "start", "end", "value"), one)) for one in row] for row in (columns[6] if rows else ())]
        arrays = [batch["doc_id"], *[pa.array(c, t) for c, t in zip(columns[:6], _OUT.types[1:7])], pa.array(secrets, _OUT.types[7])]
        yield pa.RecordBatch.from_arrays(arrays, schema=_OUT)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: Sequence[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, counts by kind, base_sha256, spans, and secrets with their strings.

    Spans count code points, the end excluded, in order of start, then kind. A null
    text counts as empty, and a text of any length is read whole. Rows that repeat
    are judged alike; an empty table gives no rows; other columns are not looked at.
    words are those of the dictionary, by default the docs' own; only their counts
    are shuffled.
    """
    words = identifiers(docs, text=text) if words is None else list(words)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    struct = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
    return rows.mapInArrow(lambda batches: _scan(batches, words), f"doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, secrets {struct}")
