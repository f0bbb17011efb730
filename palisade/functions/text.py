"""Text normal forms and string similarities."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(text: str) -> str:
    """Lower case, then without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def canonical(text: str) -> str:
    """NFC, trimmed, white space runs as one space, lower case."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text).strip()).lower()


def _each(function):
    """A vectorised UDF that works each distinct value of a batch out once."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = {x: function(x) for x in batch.dropna().unique()}
            yield batch.map(known)

    return run


tx_fold = _each(fold)
tx_canonical = _each(canonical)


def tx_tokenize(column: Column) -> Column:
    """Folded words between white space."""
    return F.filter(F.split(tx_fold(column), r"\s+"), lambda x: x != "")


def lev_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def damerau(a: str, b: str) -> int:
    """Edits and transpositions of neighbours, each pair edited at most once."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def jaro_winkler(a: str, b: str, scale: float = 0.1, threshold: float = 0.7) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (y for y, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    lead = 0
    while lead < min(4, len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    return jaro + lead * scale * (1 - jaro) if jaro > threshold else jaro


def _pairs(function):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(function(x, y)) for x, y in zip(a, b)])

    return run


jaro_winkler_column = _pairs(jaro_winkler)
damerau_similarity = _pairs(lambda a, b: 1.0 if not a and not b else 1 - damerau(a, b) / max(len(a), len(b)))
