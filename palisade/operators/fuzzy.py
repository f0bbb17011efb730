"""Fuzzy matching of spans against a vocabulary, as joins on tokens.

Candidates are (id, value, category). Postings come from exploding a value's
folded tokens. A query token meets only vocabulary tokens within two edits, found
by joining on the pieces left when a token is cut in three: two edits leave one
piece whole. Nothing is crossed, and only a query's candidates are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaro_winkler_column, lev_similarity, damerau_similarity, tx_canonical, tx_fold

MOST_EDITS = 2
LEAST_RETRIEVED, RETRIEVED_FACTOR = 500, 4
ORDER_BONUS, MOST_BONUS = 1.1, 1.5
LOOKUP_CAP = 200
SHORT_TERM = 3


def tokens(column: Column) -> Column:
    return F.filter(F.split(column, r"\s+"), lambda x: x != "")


def _with_tokens(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the folded tokens of a text; each distinct text is folded once, null texts have none."""
    own = rows.select(F.col(text).alias("__text")).filter("__text IS NOT NULL").distinct().withColumn(name, tokens(tx_fold(F.col("__text"))))
    return rows.join(own, F.col(text) == F.col("__text"), "left").drop("__text")


def prepared(candidates: DataFrame) -> DataFrame:
    """Candidates with folded tokens."""
    return _with_tokens(candidates.select("id", "value", "category"), "value", "tokens")


def seeds(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(span_id, id, category, value): candidates that share an exact token with a span, or, for a span
    of which no token is known, those with a token within two edits of one of its own."""
    rows = prepared(candidates)
    postings = rows.select("id", "category", "value", F.explode(F.array_distinct("tokens")).alias("token"))
    each = _with_tokens(queries.select("span_id", "span"), "span", "query_tokens").select("span_id", F.explode(F.array_distinct("query_tokens")).alias("query_token"))
    vocabulary = postings.select("token").distinct()
    exact = each.join(vocabulary, F.col("query_token") == F.col("token")).select("span_id", "token")
    lost = each.join(exact.select("span_id").distinct(), "span_id", "left_anti")
    near = lost.join(resolve(lost.select("query_token"), vocabulary), "query_token").select("span_id", "token")
    return exact.unionAll(near).distinct().join(postings, "token").select("span_id", "id", "category", "value").distinct()


def idf(prepared_rows: DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln((N + 1) / (df + 1)) + 1."""
    total = prepared_rows.agg(F.count(F.lit(1)).alias("total"))
    postings = prepared_rows.select(F.explode(F.array_distinct("tokens")).alias("token"))
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return counts.crossJoin(total).select("token", "df", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def _pieces(token: Column, length: Column) -> Column:
    """(place, text) of a token's three parts, for a token of a given length."""
    third = F.floor(length / 3).cast("int")
    return F.array(
        F.struct(F.lit(0).alias("place"), F.substring(token, F.lit(1), third).alias("text")),
        F.struct(F.lit(1).alias("place"), F.substring(token, third + 1, third).alias("text")),
        F.struct(F.lit(2).alias("place"), F.substring(token, 2 * third + 1, length).alias("text")),
    )


def resolve(query_tokens: DataFrame, vocabulary: DataFrame, edits: int = MOST_EDITS) -> DataFrame:
    """(query_token, token, distance) within `edits` (at most two), the token itself included.

    A vocabulary token's parts are looked for in the query token at their place,
    shifted by up to the edits; short tokens, whose parts are empty, meet by length.
    """
    size = F.length("token")
    parts = vocabulary.select("token", size.alias("size"), F.explode(_pieces(F.col("token"), size)).alias("piece"))
    parts = parts.select("token", "size", F.col("piece.place").alias("place"), F.col("piece.text").alias("text"))
    lengths = F.sequence(F.greatest(F.length("query_token") - edits, F.lit(1)), F.length("query_token") + edits)
    q = query_tokens.select("query_token").distinct().withColumn("size", F.explode(lengths))
    third = F.floor(F.col("size") / 3).cast("int")
    starts = [(0, F.lit(1), third), (1, third + 1, third), (2, 2 * third + 1, F.col("size") - 2 * third)]
    shifts = [F.struct(F.lit(p).alias("place"), F.substring("query_token", F.greatest(at + s, F.lit(1)), n).alias("text")) for p, at, n in starts for s in range(-edits, edits + 1)]
    q = q.select("query_token", "size", F.explode(F.array_distinct(F.array(*shifts))).alias("piece"))
    q = q.select("query_token", "size", F.col("piece.place").alias("place"), F.col("piece.text").alias("text"))
    met = q.join(parts, ["size", "place", "text"]).select("query_token", "token").distinct()
    return met.withColumn("distance", F.levenshtein("query_token", "token", edits)).filter(F.col("distance") >= 0)


def _order_bonus(query: Column, candidate: Column) -> Column:
    """ORDER_BONUS to the number of query token pairs in order in the candidate, capped."""
    places = F.transform(query, lambda t: F.array_position(candidate, t))
    pairs = F.aggregate(
        F.sequence(F.lit(0), F.size(query) - 1),
        F.lit(0),
        lambda total, i: total + F.size(F.filter(places, lambda p, j: (j > i) & (F.element_at(places, (i + 1).cast("int")) > 0) & (p > F.element_at(places, (i + 1).cast("int"))))),
    )
    return F.least(F.pow(F.lit(ORDER_BONUS), pairs), F.lit(MOST_BONUS))


def _scored_lists(q: DataFrame, rows: DataFrame, unknown: DataFrame) -> DataFrame:
    """(query_tokens, tokens, base, bonus) for each pair of token lists that meet in a token within two edits."""
    weights = idf(rows)
    each = q.select("query_tokens").distinct().select("query_tokens", F.posexplode("query_tokens").alias("place", "query_token"))
    near = resolve(each.select("query_token"), weights).join(weights, "token")
    postings = rows.select("tokens").distinct().select("tokens", F.explode(F.array_distinct("tokens")).alias("token"))
    hits = each.join(near, "query_token").join(postings, "token")
    quality = 1 - F.col("distance") / F.greatest(F.length("query_token"), F.length("token"))
    best = hits.groupBy("query_tokens", "tokens", "place").agg(
        F.min_by(F.struct(quality.alias("quality"), F.col("idf").alias("weight")), F.struct("distance", "token")).alias("best")
    )
    summed = best.groupBy("query_tokens", "tokens").agg(
        F.sum(F.col("best.quality") * F.col("best.weight")).alias("got"), F.sum("best.weight").alias("weight"), F.count(F.lit(1)).alias("found")
    )
    base = F.col("got") / (F.col("weight") + (F.size("query_tokens") - F.col("found")) * F.col("unknown"))
    bonus = _order_bonus(F.col("query_tokens"), F.col("tokens"))
    return summed.crossJoin(unknown).select("query_tokens", "tokens", F.round(base, 12).alias("base"), bonus.alias("bonus"))


def retrieve(queries: DataFrame, candidates: DataFrame, limit: int = 10, each_category: bool = False) -> DataFrame:
    """(query_tokens, tokens, id, category, value, base, bonus, rank): for each distinct token list of the spans, the
    candidates of the best weighted token scores, max(500, 4 * limit) of them, ties by id, category and value.

    Postings hold distinct token lists, so values that repeat are scored once; of
    candidates that share a list, the first ones are enough for the ranks.
    """
    kept = max(LEAST_RETRIEVED, RETRIEVED_FACTOR * limit)
    rows = prepared(candidates)
    unknown = candidates.agg((F.log(F.count(F.lit(1)) + 1) + 1).alias("unknown"))
    q = _with_tokens(queries.select("span"), "span", "query_tokens").filter(F.size("query_tokens") > 0)
    by = ("category",) if each_category else ()
    alike = Window.partitionBy("tokens", *by).orderBy("id", "category", "value")
    members = rows.withColumn("rank", F.row_number().over(alike)).filter(F.col("rank") <= kept).drop("rank")
    first = Window.partitionBy("query_tokens", *by).orderBy(F.desc("base"), "id", "category", "value")
    found = _scored_lists(q, rows, unknown).join(members, "tokens")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= kept)


def match(queries: DataFrame, candidates: DataFrame, limit: int = 10, each_category: bool = False) -> DataFrame:
    """(span_id, id, category, value, score, nth): IDF-weighted token scores, the best `limit` a span.

    queries are (span_id, span). A query token counts with the nearest token of the
    candidate among those within two edits, at 1 - distance / longer length and that
    token's idf; tokens without one count nothing at the weight of an unknown token.
    With each_category, the best `limit` of every category are taken.
    """
    found = retrieve(queries, candidates, limit, each_category)
    scored = found.withColumn("score", F.round(F.col("base") * F.col("bonus"), 9))
    by = ("query_tokens", "category") if each_category else ("query_tokens",)
    best = top(scored.select("query_tokens", "id", "category", "value", "score"), limit, *by)
    spans = _with_tokens(queries.select("span_id", "span"), "span", "query_tokens")
    return spans.join(best, "query_tokens").select("span_id", "id", "category", "value", "score", "nth")


def batch(queries: DataFrame, candidates: DataFrame, categories: list[str], limit: int = 10) -> DataFrame:
    """match() of many spans against several categories at once: the best `limit` of each, an (id, category) once a span."""
    own = candidates.filter(F.col("category").isin(*categories))
    found = match(queries, own, limit, each_category=True)
    once = Window.partitionBy("span_id", "id", "category").orderBy("nth")
    return found.withColumn("__nth", F.row_number().over(once)).filter("__nth = 1").drop("__nth")


def top(scored: DataFrame, limit: int, *by: str) -> DataFrame:
    """The best rows of each span (or other columns); ties by id, then category."""
    order = Window.partitionBy(*(by or ("span_id",))).orderBy(F.desc("score"), "id", "category")
    return scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit)


def similarity(name: str, a: Column, b: Column) -> Column:
    """levenshtein, damerau, or jaro_winkler (which hamming stands for too)."""
    if name == "levenshtein":
        return lev_similarity(a, b)
    return damerau_similarity(a, b) if name == "damerau" else jaro_winkler_column(a, b)


def legacy_score(query: Column, candidate: Column) -> Column:
    """1 - summed nearest distances / all characters, times the order bonus, on token arrays."""
    nearest = F.transform(query, lambda t: F.coalesce(F.array_min(F.transform(candidate, lambda c: F.levenshtein(t, c))), F.length(t)))
    total = F.aggregate(nearest, F.lit(0), lambda x, y: x + y)
    chars = F.aggregate(F.concat(query, candidate), F.lit(0), lambda x, y: x + F.length(y))
    return F.when(chars == 0, F.lit(1.0)).otherwise((1 - total / chars) * _order_bonus(query, candidate))


def cascade(steps: list[tuple[DataFrame, float]]) -> DataFrame:
    """Per span, the rows of the first step whose best score reaches its least; else of the last step."""
    marked = None
    for k, (rows, least) in enumerate(steps):
        best = rows.groupBy("span_id").agg(F.max("score").alias("best"))
        one = rows.join(best, "span_id").withColumn("step", F.lit(k)).withColumn("wins", (F.col("best") >= least) | F.lit(k == len(steps) - 1)).drop("best")
        marked = one if marked is None else marked.unionByName(one)
    first = marked.filter("wins").groupBy("span_id").agg(F.min("step").alias("step"))
    return marked.filter("wins").join(first, ["span_id", "step"]).drop("wins")


def lookup(candidates: DataFrame, categories: list[str], prefix: str = "", cap: int = LOOKUP_CAP) -> tuple[DataFrame, DataFrame]:
    """Members of categories in order, at most cap, and the categories that are not known."""
    asked = candidates.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    found = candidates.join(asked, "category", "left_semi").filter(F.lower("value").startswith(prefix.lower()))
    return found.orderBy("category", "value", "id").limit(cap), asked.join(candidates, "category", "left_anti")


def admitted(query: Column, candidate: Column, method: str, typos: int = 0) -> Column:
    """Whether a pair passes: exact, tokens (one in common) or typos."""
    if method == "exact":
        return query == candidate
    if method == "tokens":
        return F.arrays_overlap(tokens(query), tokens(candidate))
    return F.levenshtein(query, candidate) <= typos


@dataclass(frozen=True)
class Rule:
    """norm: canonical, folded or lemma; typos is (edits, penalty an edit)."""

    norm: str
    exact: float | None = None
    tokens: bool = False
    typos: tuple[int, float] | None = None


def profile_score(rows: DataFrame, rules: list[Rule], query: str = "span", candidate: str = "value", score: str = "score") -> DataFrame:
    """Rows with the best firing of the rules as score; rows that nothing fires on go.

    Typos never fire for candidates of three characters or fewer, nor at or below 0.
    """
    norms = {"canonical": tx_canonical, "folded": tx_fold}
    forms = {n: (f(F.col(query)), f(F.col(candidate))) for n, f in norms.items()}
    forms["lemma"] = (F.coalesce(F.col("query_lemma"), forms["folded"][0]) if "query_lemma" in rows.columns else forms["folded"][0], F.coalesce(F.col("lemma"), forms["folded"][1]) if "lemma" in rows.columns else forms["folded"][1])
    fired = []
    for rule in rules:
        q, c = forms[rule.norm]
        if rule.exact is not None:
            fired.append(F.when(q == c, F.lit(float(rule.exact))))
        if rule.tokens:
            fired.append(F.col(score))
        if rule.typos and rule.exact is not None:
            edits, penalty = rule.typos
            d = F.levenshtein(q, c)
            value = F.lit(float(rule.exact)) - d * F.lit(float(penalty))
            fired.append(F.when(d.between(1, edits) & (value > 0) & (F.length(forms["canonical"][1]) > SHORT_TERM), value))
    best = F.greatest(*fired) if len(fired) > 1 else fired[0]
    return rows.withColumn(score, best).filter(F.col(score).isNotNull())


def with_margin(rows: DataFrame, target: str = "target", suppressed: str | None = None) -> DataFrame:
    """margin: the target's best score less the best of any other target of the span that is not suppressed."""
    live = rows.filter(~F.col(suppressed)) if suppressed else rows
    best = live.groupBy("span_id", target).agg(F.max("score").alias("best"))
    two = Window.partitionBy("span_id").orderBy(F.desc("best"), target)
    ranked = best.withColumn("nth", F.row_number().over(two)).filter("nth <= 2")
    tops = ranked.groupBy("span_id").agg(F.max(F.when(F.col("nth") == 1, F.col(target))).alias("__first"), F.max(F.when(F.col("nth") == 1, F.col("best"))).alias("__a"), F.max(F.when(F.col("nth") == 2, F.col("best"))).alias("__b"))
    own = rows.groupBy("span_id", target).agg(F.max("score").alias("__own"))
    rival = F.when(F.col(target) == F.col("__first"), F.coalesce("__b", F.lit(0.0))).otherwise(F.col("__a"))
    return rows.join(own, ["span_id", target]).join(tops, "span_id", "left").withColumn("margin", F.col("__own") - F.coalesce(rival, F.lit(0.0))).drop("__own", "__first", "__a", "__b")


def with_overlay(rows: DataFrame, negatives: DataFrame) -> DataFrame:
    """negative flags (span, id) pairs that were marked wrong; the rows stay."""
    marks = negatives.select("span", "id").distinct().withColumn("__no", F.lit(True))
    return rows.join(marks, ["span", "id"], "left").withColumn("negative", F.coalesce("__no", F.lit(False))).drop("__no")


def with_positives(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """Confirmed spans as further candidates."""
    return candidates.unionByName(positives.select("id", F.col("span").alias("value"), "category")).distinct()
