"""Annotated documents: gazetteers, annotation rules and word forms.

An annotation is (doc_id, type, start, end, features), features being strings by
name. Rules run over one document at a time, in Python over Arrow, since matching
is sequential inside a document and independent between documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.text import fold, tx_fold

SCHEMA = "doc_id long, type string, start long, `end` long, features map<string,string>"
#: Tokens from which a part of a batch is handed on.
PART_TOKENS = 50_000
CONTROLS = ("appelt", "brill", "all", "first", "once")


def import_annotations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One annotation for each document, type and span, and the number dropped by document."""
    kept = rows.dropDuplicates(["doc_id", "type", "start", "end"])
    counts = rows.groupBy("doc_id").agg((F.count(F.lit(1)) - F.count_distinct("type", "start", "end")).alias("dropped"))
    return kept, counts


def tokenise(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Token annotations: runs of word characters and single signs."""

    def part(ids: list, starts: list, ends: list, strings: list) -> pa.RecordBatch:
        names = pa.array(["string"] * len(ids), pa.string())
        features = pa.MapArray.from_arrays(pa.array(range(len(ids) + 1), pa.int32()), names, pa.array(strings, pa.string()))
        columns = [pa.array(ids, pa.int64()), pa.array(["Token"] * len(ids), pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), features]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "type", "start", "end", "features"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends, strings = held = [], [], [], []
            for i, x in zip(batch["doc_id"].to_pylist(), batch["text"]):
                for m in re.finditer(r"\w+|[^\w\s]", x.as_py() or ""):
                    ids.append(i)
                    starts.append(m.start())
                    ends.append(m.end())
                    strings.append(m[0])
                if len(ids) >= PART_TOKENS:
                    yield part(*held)
                    for column in held:
                        column.clear()
            yield part(*held)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, nth, sentence): ends at . ! ? before white space (blank, tab, line or form feed, return), or at a line's end; without blanks around it."""
    parts = F.split(F.col(text), r"(?<=[.!?])[ \t\n\f\r]+|\n+")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")).alias("nth", "sentence"))
    return rows


def gazetteer(docs: DataFrame, entries: list[tuple[str, str, str]], mode: str = "exact", id_col: str = "doc_id", text: str = "text", most_entries: int = 200_000) -> DataFrame:
    """Longest matches of (phrase, type, category) entries at word starts; mode exact, ci, fold or lemma.

    lemma looks words up as they are in a column `lemmas` of docs, an array of the
    same length as the words. The entries are sent to executors, so their number is
    bounded; longer lists go through join_gazetteer.
    """
    if len(entries) > most_entries:
        raise EngineError("gazetteer_too_large", f"{len(entries)} entries; use join_gazetteer")
    norm = {"exact": str, "ci": str.lower, "fold": fold, "lemma": str.lower}[mode]
    table: dict[tuple[str, ...], tuple[str, str]] = {}
    for phrase, kind, category in entries:
        table.setdefault(tuple(norm(w) for w in re.findall(r"\w+", phrase)), (kind, category))
    longest = max(map(len, table), default=0)
    lemmas = mode == "lemma"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, (i, x) in enumerate(zip(batch["doc_id"], batch["text"])):
                found = list(re.finditer(r"\w+", x or ""))
                words = [norm(w) for w in batch["lemmas"].iloc[k]] if lemmas else [norm(m[0]) for m in found]
                at = 0
                while at < len(found):
                    for n in range(min(longest, len(found) - at), 0, -1):
                        hit = table.get(tuple(words[at : at + n]))
                        if hit:
                            rows.append((i, hit[0], found[at].start(), found[at + n - 1].end(), {"category": hit[1]}))
                            at += n - 1
                            break
                    at += 1
            yield pd.DataFrame(rows, columns=["doc_id", "type", "start", "end", "features"])

    columns = [F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *([F.col("lemmas")] if lemmas else [])]
    return docs.select(*columns).mapInPandas(run, SCHEMA)


def join_gazetteer(words: DataFrame, entries: DataFrame, longest: int = 4) -> DataFrame:
    """The same by a join, for lists of any size: words (doc_id, nth, word) against entries (phrase, type), folded.

    Runs of up to `longest` words are joined on their text; of overlapping matches the
    one that starts first stays, the longest of those.
    """
    order = Window.partitionBy("doc_id").orderBy("nth")
    folded = words.withColumn("word", tx_fold(F.col("word")))
    grams = None
    for n in range(1, longest + 1):
        text = F.array_join(F.collect_list("word").over(order.rowsBetween(0, n - 1)), " ")
        one = folded.select("doc_id", "nth", F.lit(n).alias("n"), text.alias("phrase"), F.count("word").over(order.rowsBetween(0, n - 1)).alias("got")).filter(F.col("got") == n)
        grams = one if grams is None else grams.unionAll(one)
    hits = grams.join(entries.withColumn("phrase", tx_fold(F.col("phrase"))), "phrase")
    best = hits.groupBy("doc_id", "nth").agg(F.max_by(F.struct("n", "phrase", "type"), "n").alias("best")).select("doc_id", "nth", "best.*")
    before = Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("nth") + F.col("n")).over(before), F.lit(-1))
    return best.withColumn("reach", reach).filter("nth >= reach").drop("reach")


@dataclass(frozen=True)
class Step:
    """One part of a rule's left side; exactly one form.

    ann with constraints, text, lemma, all_of (with negated members), group of
    alternatives, each a sequence, or a look ahead (after) that takes nothing.
    """

    ann: str | None = None
    where: dict[str, Any] = field(default_factory=dict)
    text: str | None = None
    lemma: str | None = None
    all_of: tuple["Step", ...] = ()
    negate: bool = False
    contains: "Step | None" = None
    within: "Step | None" = None
    group: tuple[tuple["Step", ...], ...] = ()
    after: "Step | None" = None
    not_after: "Step | None" = None
    least: int = 1
    most: int = 1
    bind: str | None = None


@dataclass(frozen=True)
class Rule:
    """actions are ("add", type, bind or None, features) and ("update", bind, features); a feature is a literal or (bind, getter)."""

    name: str
    steps: tuple[Step, ...]
    actions: tuple[tuple, ...]
    priority: int = 0


def holds(value: Any, test: Any) -> bool:
    """A feature against a literal, {"regex"}, {"in"}, or bounds gt, gte, lt, lte."""
    if not isinstance(test, dict):
        return value is not None and str(value) == str(test)
    if value is None:
        return False
    if "regex" in test:
        return re.search(test["regex"], str(value)) is not None
    if "in" in test:
        return str(value) in [str(x) for x in test["in"]]
    try:
        number = float(value)
    except ValueError:
        return False
    return all({"gt": number > x, "gte": number >= x, "lt": number < x, "lte": number <= x}[k] for k, x in test.items())


class _Matcher:
    def __init__(self, text: str, anns: list[dict]):
        self.text = text
        self.anns = sorted(anns, key=lambda a: (a["start"], -a["end"], a["type"]))
        self.at = {}
        for a in self.anns:
            self.at.setdefault(a["start"], []).append(a)
        self.starts = sorted(self.at)

    def next_start(self, place: int) -> int | None:
        return next((s for s in self.starts if s >= place), None)

    def here(self, step: Step, a: dict) -> bool:
        """Whether one annotation fits a step's form."""
        if step.all_of:
            same = [x for x in self.at.get(a["start"], [])]
            return all(any(self.here(m, x) for x in same) != m.negate for m in step.all_of)
        if step.ann is not None:
            ok = a["type"] == step.ann and all(holds(a["features"].get(k), v) for k, v in step.where.items())
        elif step.text is not None:
            ok = a["type"] == "Token" and self.text[a["start"] : a["end"]] == step.text
        elif step.lemma is not None:
            ok = a["type"] == "Token" and a["features"].get("lemma") == step.lemma
        else:
            return False
        if ok and step.contains is not None:
            ok = any(a["start"] <= x["start"] and x["end"] <= a["end"] and x is not a and self.here(step.contains, x) for x in self.anns)
        if ok and step.within is not None:
            ok = any(x["start"] <= a["start"] and a["end"] <= x["end"] and x is not a and self.here(step.within, x) for x in self.anns)
        return ok

    def once(self, step: Step, place: int) -> Iterator[tuple[int, int, dict, dict | None]]:
        """(first, end, binds, annotation) of the ways a step fits once from a place."""
        start = self.next_start(place)
        if step.after is not None or step.not_after is not None:
            ahead = step.after or step.not_after
            fits = start is not None and any(self.here(ahead, a) for a in self.at[start])
            if fits == (step.after is not None):
                yield place, place, {}, None
            return
        if step.group:
            for sequence in step.group:
                for first, end, binds in self.sequence(sequence, place):
                    yield first, end, binds, None
            return
        if start is not None:
            for a in self.at[start]:
                if self.here(step, a):
                    yield a["start"], a["end"], {}, a

    def repeated(self, step: Step, place: int) -> Iterator[tuple[int, int, dict]]:
        def more(first: int, end: int, binds: dict, times: int, last: dict | None):
            if times >= step.least:
                own = {step.bind: (first, end, last)} if step.bind and times else {}
                yield first, end, binds | own
            if times < step.most:
                for f, e, b, a in self.once(step, end):
                    if e > end or not times:
                        yield from more(first if times else f, e, binds | b, times + 1, a)
                    if e == end:
                        break

        yield from more(place, place, {}, 0, None)

    def sequence(self, steps: tuple[Step, ...], place: int) -> Iterator[tuple[int, int, dict]]:
        if not steps:
            yield place, place, {}
            return
        for first, end, binds in self.repeated(steps[0], place):
            for f, e, b in self.sequence(steps[1:], end):
                yield (first if end > first else f), e, binds | b


def run_rules(text: str, anns: list[dict], rules: tuple[Rule, ...], control: str) -> list[tuple[Rule, int, int, dict]]:
    """Firings (rule, start, end, binds) over one document in one of the control styles.

    appelt: the longest match, then the highest priority, then the earliest rule, and
    on after it. brill: every rule that matches, and on after the longest. all: every
    rule, and on at the next start. first: the first rule in order, at its shortest.
    once: as appelt, and then no more.
    """
    if control not in CONTROLS:
        raise EngineError("validation_failed", f"control {control}")
    m, place, out = _Matcher(text, anns), 0, []
    while (start := m.next_start(place)) is not None:
        found = []
        for k, rule in enumerate(rules):
            ways = [(f, e, b) for f, e, b in m.sequence(rule.steps, start) if e > start or f >= start]
            ways = [w for w in ways if w[1] > w[0]]
            if ways:
                pick = min(ways, key=lambda w: w[1]) if control == "first" else max(ways, key=lambda w: w[1])
                found.append((k, rule, pick))
                if control == "first":
                    break
        if not found:
            place = start + 1
            continue
        if control in ("appelt", "once"):
            found = [max(found, key=lambda x: (x[2][1], x[1].priority, -x[0]))]
        out += [(rule, f, e, b) for _, rule, (f, e, b) in found]
        if control == "once":
            break
        place = start + 1 if control == "all" else max(e for _, _, (_, e, _) in found)
    return out


def _fire(text: str, anns: list[dict], firings: list[tuple[Rule, int, int, dict]]) -> list[dict]:
    """All annotations after the firings' actions."""

    def feature(value: Any, binds: dict) -> str | None:
        if not isinstance(value, tuple):
            return None if value is None else str(value)
        first, end, ann = binds[value[0]]
        if value[1] == "@string":
            return text[first:end]
        if value[1] == "@length":
            return str(end - first)
        return (ann or {"features": {}})["features"].get(value[1])

    out = list(anns)
    for rule, first, end, binds in firings:
        for action in rule.actions:
            if action[0] == "add":
                _, kind, bind, features = action
                lo, hi = (binds[bind][0], binds[bind][1]) if bind else (first, end)
                out.append({"type": kind, "start": lo, "end": hi, "features": {k: feature(v, binds) for k, v in features.items()} | {"rule": rule.name}})
            elif binds.get(action[1], (0, 0, None))[2] is not None:
                binds[action[1]][2]["features"].update({k: feature(v, binds) for k, v in action[2].items()})
    return out


def apply_rules(docs: DataFrame, annotations: DataFrame, rules: tuple[Rule, ...], control: str = "appelt", inputs: tuple[str, ...] = (), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The annotations of every document after the rules; rules see only the input types, if any are named."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "type", "start", "end", "features"]
        if left.empty:
            return pd.DataFrame(columns=columns)
        anns = [{"type": t, "start": int(s), "end": int(e), "features": dict(f) if f is not None else {}} for t, s, e, f in zip(*(right[c] for c in columns[1:]))] if not right.empty else []
        seen = [a for a in anns if not inputs or a["type"] in inputs]
        body = left["text"].iloc[0] or ""
        made = _fire(body, seen, run_rules(body, seen, rules, control))
        made += [a for a in anns if inputs and a["type"] not in inputs]
        return pd.DataFrame([(key[0], a["type"], a["start"], a["end"], a["features"]) for a in made], columns=columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.groupBy("doc_id").cogroup(annotations.groupBy("doc_id")).applyInPandas(run, SCHEMA)


def morph_lookup(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words (word) with the best analysis of lexicon (surface, lemma, pos, weight): exact, else folded."""
    ranked = Window.partitionBy("surface").orderBy(F.desc("weight"), "lemma")
    exact = lexicon.withColumn("nth", F.row_number().over(ranked)).filter("nth = 1").select("surface", F.struct("lemma", "pos").alias("exact"))
    lex = lexicon.withColumn("folded", tx_fold(F.col("surface")))
    near = Window.partitionBy("folded").orderBy(F.desc("weight"), "lemma")
    folded = lex.withColumn("nth", F.row_number().over(near)).filter("nth = 1").select("folded", F.struct("lemma", "pos").alias("near"))
    rows = words.withColumn("folded", tx_fold(F.col("word")))
    joined = rows.join(exact, rows["word"] == exact["surface"], "left").join(folded, "folded", "left")
    best = F.coalesce("exact", "near")
    via = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "folded").otherwise("none")
    return joined.select(*words.columns, best["lemma"].alias("lemma"), best["pos"].alias("pos"), via.alias("via"))


def morph_chain(words: DataFrame, lexicon: DataFrame, statistical: DataFrame | None = None, suffixes: tuple[str, ...] = (), stem: int = 3) -> DataFrame:
    """Lexicon, then a table of learned (word, lemma), then the word without the longest known suffix that leaves a stem."""
    found = morph_lookup(words, lexicon)
    if statistical is not None:
        found = found.join(statistical.select("word", F.col("lemma").alias("learned")), "word", "left")
    else:
        found = found.withColumn("learned", F.lit(None).cast("string"))
    guess = F.col("word")
    for suffix in sorted(suffixes, key=len):
        guess = F.when(F.col("word").endswith(suffix) & (F.length("word") - len(suffix) >= stem), F.expr(f"left(word, length(word) - {len(suffix)})")).otherwise(guess)
    via = F.when(F.col("lemma").isNotNull(), F.col("via")).when(F.col("learned").isNotNull(), "statistical").otherwise("guess")
    return found.select(*words.columns, F.coalesce("lemma", "learned", guess).alias("lemma"), "pos", via.alias("via"))


def morph_generate(stems: DataFrame, paradigms: DataFrame) -> DataFrame:
    """(lemma, form, tag): every stem (lemma, stem, paradigm) with its paradigm's endings (paradigm, ending, tag)."""
    return stems.join(paradigms, "paradigm").select("lemma", F.concat("stem", "ending").alias("form"), "tag")


def morph_metrics(tokens: DataFrame) -> DataFrame:
    """By pos, of tokens (pos, gold, lemmas, folded_lemmas): coverage, lemma in set, head of list, fold collisions."""
    known = F.size("lemmas") > 0
    part = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return tokens.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"),
        part(known).alias("coverage"),
        F.avg(F.when(known, F.array_contains("lemmas", F.col("gold")).cast("double"))).alias("lemma_in_set"),
        F.avg(F.when(known, (F.element_at("lemmas", 1) == F.col("gold")).cast("double"))).alias("head"),
        part(F.size("folded_lemmas") > F.size("lemmas")).alias("fold_collision"),
    )
