import datetime as dt
import functools
import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade import EngineError
from palisade.functions import grounding, scalar, text
from palisade.operators import annotate, fuzzy, graph
from palisade.operators.annotate import Rule, Step
from palisade.plans import frontends

REFERENCE = dt.date(2026, 5, 20)


@given(st.text(max_size=30))
def test_fold_is_stable(x):
    assert text.fold(text.fold(x)) == text.fold(x)
    assert text.canonical(text.canonical(x)) == text.canonical(x)


_WORD = st.text("abcd", max_size=7)


@given(_WORD, _WORD)
def test_similarities(a, b):
    d, jw = duckdb.execute("SELECT damerau_levenshtein(?, ?), jaro_winkler_similarity(?, ?)", [a, b, a, b]).fetchone()
    assert d <= text.damerau(a, b) <= max(len(a), len(b))
    assert abs(text.jaro_winkler(a, b) - jw) < 1e-9 or not a or not b


def test_dates():
    cases = {
        "tomorrow": ("2026-05-21", "2026-05-22"),
        "last year": ("2025-01-01", "2026-01-01"),
        "this quarter": ("2026-04-01", "2026-07-01"),
        "last 1 month": ("2026-04-20", "2026-05-21"),
        "15. 3.": ("2026-03-15", "2026-03-16"),
        "March": ("2026-03-01", "2026-04-01"),
        "period 202612": ("2026-12-01", "2027-01-01"),
    }
    for span, (a, b) in cases.items():
        found = grounding.recognise_date(span, REFERENCE)
        assert (str(found.start), str(found.end)) == (a, b), span
    for span in ("nothing here", "doklad 200312", "31.2.2026", "quarter"):
        assert grounding.recognise_date(span, REFERENCE) is None, span
    assert grounding.recognise_date("this or last year", REFERENCE) is None
    assert grounding.recognise_date("fiskální čtvrtletí", REFERENCE) is None
    assert grounding.recognise_date("fiskální čtvrtletí", REFERENCE, ["fiskální"]).code == "2026Q2"
    explicit, bare = (grounding.recognise_date(s, REFERENCE) for s in ("období 202605", "202605"))
    assert explicit.code == bare.code == "202605" and explicit.confidence > bare.confidence
    december = grounding.recognise_date("December", REFERENCE)
    assert december.start.year == 2026 and december.alternatives[0].start.year == 2025


@given(st.dates(dt.date(1900, 1, 1), dt.date(2999, 12, 31)))
def test_iso_days_are_half_open(day):
    found = grounding.recognise_date(day.isoformat(), REFERENCE)
    assert (found.start, found.end) == (day, day + dt.timedelta(days=1))


def test_money():
    assert grounding.recognise_money("1,5 mil Kč", "cs").amount == Decimal("1500000.0")
    assert grounding.recognise_money("sto tisíc").amount == 100_000
    assert grounding.recognise_money("nothing") is None
    assert grounding.recognise_money("půl") is None
    assert grounding.recognise_money("around 100 at today's rate").at_current_rate
    assert grounding.recognise_money("100,50 Kč", "").amount == Decimal("100.50")


@pytest.mark.parametrize(
    "span, comparator, currency",
    [
        ("no more than 5000 EUR", "le", "EUR"), ("not more than 5000", "le", None), ("not over 5000 PLN", "le", "PLN"), ("not less than 5000 EUR", "ge", "EUR"), ("no less than 5000", "ge", None),
        ("5000 in Europe", "ge", None), ("European sales above 5000", "gt", None), ("under 5000 zł", "lt", "PLN"), ("up to 5000 pounds", "le", "GBP"), (">= 5000", "ge", None), ("< 5000 USD", "lt", "USD"),
    ],
)
def test_comparators_and_currencies(span, comparator, currency):
    found = grounding.recognise_money(span)
    assert (found.amount, found.comparator, found.currency) == (5000, comparator, currency)


@given(st.integers(0, 10**9), st.integers(0, 99), st.sampled_from(["en", "cs"]))
def test_amounts_read_as_written(whole, cents, locale):
    group, point = (",", ".") if locale == "en" else (".", ",")
    for written in (f"{whole:,}".replace(",", group), f"{whole:,}".replace(",", " "), str(whole)):
        assert grounding.recognise_money(f"{written}{point}{cents:02d} EUR", locale).amount == whole + Decimal(cents) / 100


def test_spans_of_a_column(spark):
    spans = spark.createDataFrame([("today",), (None,), ("today",), ("none of it",)], "span string")
    assert sorted(map(str, ((r["span"], r["first"]) for r in grounding.read_dates(spans, REFERENCE).collect()))) == sorted(map(str, [("today", REFERENCE), (None, None), ("none of it", None)]))
    assert {r["amount"] for r in grounding.read_money(spans).collect()} == {None}


def test_seeds_fall_back_to_near_tokens(spark):
    members = spark.createDataFrame([("1", "Red Stone", "c"), ("2", "Blue Stone", "c"), ("3", "Green", "c")], "id string, value string, category string")
    spans = spark.createDataFrame([(1, "red thing"), (2, "greem"), (3, "qqqqqqqq"), (4, None), (5, "stone rad")], "span_id long, span string")
    found = {(r["span_id"], r["id"]) for r in fuzzy.seeds(spans, members).collect()}
    assert found == {(1, "1"), (2, "3"), (5, "1"), (5, "2")}


def test_model_search():
    from palisade.catalog import parquet_catalog

    catalog = parquet_catalog("/none")
    hit = catalog.search("open orders of 2000")[0]
    assert (hit.kind, hit.name, hit.score, hit.params) == ("query", "open_orders", 1.0, {"year": "2000"})
    every = catalog.search("orders", 0.3)
    assert catalog.search("orders", 0.3, offset=1, limit=1) == every[1:2] and catalog.search("zzzzzz") == []
    assert all(a.score >= b.score for a, b in zip(every, every[1:]))


def test_fx_refuses_without_a_day(spark):
    rates = spark.createDataFrame([("EUR", "CZK", 25.0, dt.date(2020, 1, 1), dt.date(2021, 1, 1))], "from_ccy string, to_ccy string, rate double, valid_from date, valid_to date")
    facts = spark.createDataFrame([(2.0,)], "amount double")
    with pytest.raises(EngineError, match="as_of_required"):
        grounding.fx_join(facts, rates, "amount", "EUR", "CZK", None)
    assert grounding.fx_join(facts, rates, "amount", "EUR", "CZK", dt.date(2020, 5, 1)).first()["domestic"] == 50.0
    assert grounding.fx_join(facts, rates, "amount", "EUR", "CZK", dt.date(2021, 1, 1)).count() == 0


def test_boundaries():
    b = grounding.boundary('{"type": "MultiPolygon", "coordinates": [[[[1, 2], [3, 2], [3, 4], [1, 2]], [[0, 0], [9, 9], [0, 0]]], [[[5, 5], [6, 5], [5, 5]]]]}')
    assert b.wkt == "MULTIPOLYGON (((1 2, 3 2, 3 4, 1 2)), ((5 5, 6 5, 5 5)))" and b.box == (2, 1, 5, 6)
    with pytest.raises(EngineError):
        grounding.boundary('{"type": "Point", "coordinates": [1, 2]}')


def test_like_has_no_escape(spark):
    df = spark.createDataFrame([("a\\b",), ("a%b",), ("axb",)], "s string")
    assert [r["s"] for r in df.filter(scalar.like(F.col("s"), "a\\%")).collect()] == ["a\\b"]
    assert df.filter(scalar.collated_like(F.col("s"), "Á_B")).count() == 3


def test_dialect_shims():
    assert frontends.shim_sql("SELECT TOP 5 a FROM t WITH(NOLOCK) ORDER BY a;") == "SELECT a FROM t  ORDER BY a LIMIT 5"
    assert "coalesce(x," in frontends.shim_sql("SELECT ISNULL(x, 0)") and "`a`" in frontends.shim_sql("SELECT [a]")
    assert frontends.shim_sql("SELECT DATEADD(DAY, -120, CAST(GETDATE() AS date))") == "SELECT date_add(CAST(current_timestamp() AS date), -120)"


def test_resolve_finds_all_within_two_edits(spark):
    words = ["a", "ab", "abc", "abcd", "stone", "stoned", "store", "tones", "stonework", "notes", "abxd", "xbcd", "phone"]
    v = spark.createDataFrame([(w,) for w in words], "token string")
    q = v.withColumnRenamed("token", "query_token")
    got = {(r["query_token"], r["token"]) for r in fuzzy.resolve(q, v).collect()}
    want = {(a, b) for a in words for b in words if duckdb.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0] <= 2}
    assert got == want


def test_match(spark):
    members = spark.createDataFrame([("1", "Red Stone", "c"), ("2", "Blue Stone", "c"), ("3", "Žlutý kůň", "c")], "id string, value string, category string")
    spans = spark.createDataFrame([(1, "red stone"), (2, "zluty kun"), (3, "blu ston"), (4, "zzzzzzz")], "span_id long, span string")
    best = {r["span_id"]: (r["id"], round(r["score"], 6)) for r in fuzzy.match(spans, members, 2).filter("nth = 1").collect()}
    assert best[1] == ("1", 1.1) and best[2] == ("3", 1.1) and best[3][0] == "2" and 4 not in best


def _plain_match(spans, members, limit, kept):
    """Every span against every candidate."""
    split = lambda x: text.fold(x).split() if x is not None else []
    df = Counter(t for _, v, _ in members for t in set(split(v)))
    idf = {t: math.log((len(members) + 1) / (n + 1)) + 1 for t, n in df.items()}
    edits = functools.cache(lambda a, b: duckdb.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0])
    out = []
    for span_id, span in spans:
        scored = []
        for i, value, category in members:
            have, got, weight, places = split(value), 0.0, 0.0, []
            for t in split(span):
                d, token = min(((edits(t, c), c) for c in have), default=(9, ""))
                got += (1 - d / max(len(t), len(token))) * idf[token] if d <= 2 else 0
                weight += idf[token] if d <= 2 else math.log(len(members) + 1) + 1
                places.append((have.index(t) + 1 if t in have else 0, d <= 2))
            if any(near for _, near in places):
                pairs = sum(0 < p < r for k, (p, _) in enumerate(places) for r, _ in places[k + 1 :])
                scored.append((got / weight, i, category, value, min(1.1**pairs, 1.5)))
        scored = sorted(scored, key=lambda x: (-round(x[0], 12), *x[1:4]))[:kept]
        ranked = sorted(((i, c, v, round(base * bonus, 9)) for base, i, c, v, bonus in scored), key=lambda x: (-x[3], x[0], x[1]))
        out += [(span_id, *row, n) for n, row in enumerate(ranked[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("kept", [500, 12])
def test_match_equals_brute_force(spark, monkeypatch, kept):
    monkeypatch.setattr(fuzzy, "LEAST_RETRIEVED", kept)
    values = ["red widget", "blue bolt", "hot gear", "Red Widget", "widget red", "small hot ring gear", "big žlutý bolt", "red red bolt", "gear", "", None, "ring of small hot gears", "bold blue widgets"]
    members = [(f"{k}", v, "ab"[k % 2]) for k, v in enumerate(values * 3)] + [("0", "blue ring", "b")]
    spans = [(1, "red widget"), (2, "re widget"), (3, "zluty bolt"), (4, "gaer hot"), (5, "small hot ring gear"), (6, ""), (7, None), (8, "qqqqqqqq"), (9, "red widget"), (10, "blu qqqqqqqq rng"), (11, "widget red bolt")]
    got = fuzzy.match(spark.createDataFrame(spans, "span_id long, span string"), spark.createDataFrame(members, "id string, value string, category string"), 3)
    got = sorted((r["span_id"], r["id"], r["category"], r["value"], r["score"], r["nth"]) for r in got.collect())
    want = _plain_match(spans, members, 3, kept)
    assert [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in want] and [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=2e-9)


def test_traverse_takes_the_least_depth(spark):
    edges = spark.createDataFrame([("a", "x", "b"), ("b", "x", "c"), ("a", "x", "c"), ("c", "x", "a"), ("a", "y", "z")], "src string, kind string, dst string")
    found = {r["node"]: r["depth"] for r in graph.traverse(edges, "a", ("x",), depth=3).collect()}
    assert found == {"a": 0, "b": 1, "c": 1}
    assert {r["node"] for r in graph.traverse(edges, "z", (), "in", 1).collect()} == {"z", "a"}
    with pytest.raises(EngineError):
        graph.traverse(edges, "a", depth=11)


def _anns(body):
    import re

    return [{"type": "Token", "start": m.start(), "end": m.end(), "features": {"lemma": m[0].lower()}} for m in re.finditer(r"\w+", body)]


def _fired(body, rules, control):
    return [(r.name, body[a:b]) for r, a, b, _ in annotate.run_rules(body, _anns(body), rules, control)]


def test_control_styles():
    one = Rule("one", (Step(text="a"),), ())
    two = Rule("two", (Step(text="a"), Step(text="b")), ())
    many = Rule("many", (Step(ann="Token", least=1, most=3),), ())
    assert _fired("a b c a", (one, two), "appelt") == [("two", "a b"), ("one", "a")]
    assert _fired("a b c a", (one, two), "brill") == [("one", "a"), ("two", "a b"), ("one", "a")]
    assert _fired("a b c a", (one, two), "once") == [("two", "a b")]
    assert _fired("a b c d", (many,), "first") == [("many", x) for x in "abcd"]
    assert _fired("a b c d", (many,), "appelt") == [("many", "a b c"), ("many", "d")]
    assert _fired("a b c d", (many,), "all") == [("many", "a b c"), ("many", "b c d"), ("many", "c d"), ("many", "d")]
    low, high = Rule("low", (Step(text="a"),), ()), Rule("high", (Step(text="a"),), (), priority=5)
    assert _fired("a", (low, high), "appelt") == [("high", "a")] and _fired("a", (low, one), "appelt") == [("low", "a")]
    with pytest.raises(EngineError):
        _fired("a", (one,), "sideways")


def test_step_forms():
    lemma = Rule("r", (Step(lemma="pay"), Step(group=((Step(text="now"),), (Step(text="right"), Step(text="away"))))), ())
    assert _fired("Pay right away", (lemma,), "appelt") == [("r", "Pay right away")]
    ahead = Rule("r", (Step(text="a"), Step(after=Step(text="b"))), ())
    never = Rule("r", (Step(text="a"), Step(not_after=Step(text="b"))), ())
    assert _fired("a b a c", (ahead,), "appelt") == [("r", "a")] and _fired("a b a c", (never,), "brill") == [("r", "a")]
    both = Step(all_of=(Step(ann="Token"), Step(text="x", negate=True)))
    assert _fired("x y", (Rule("r", (both,), ()),), "appelt") == [("r", "y")]
    assert annotate.holds("5", {"gte": 5, "lt": 6}) and not annotate.holds("5", {"gt": 5}) and annotate.holds("ab", {"regex": "^a"}) and annotate.holds("3", {"in": [3]}) and not annotate.holds(None, {"in": [1]})


def test_join_gazetteer_keeps_the_longest(spark):
    words = spark.createDataFrame([(1, k, w) for k, w in enumerate("the New York Times in york".split())], "doc_id long, nth int, word string")
    entries = spark.createDataFrame([("new york", "City"), ("New York Times", "Paper"), ("York", "City")], "phrase string, type string")
    assert sorted((r["nth"], r["type"]) for r in annotate.join_gazetteer(words, entries).collect()) == [(1, "Paper"), (5, "City")]


def test_stream_equals_batch(spark, sf, tmp_path):
    from palisade.streaming import events

    table = spark.read.parquet(f"{sf}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    query = events.follow(spark, str(tmp_path / "in"), table.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    closed = {(str(r["start"]), r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    every = {(str(r["start"]), r["event_type"]): r["n"] for r in events.windowed(table).collect()}
    assert closed and all(every[k] == n for k, n in closed.items())
