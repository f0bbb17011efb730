"""From a span of text to a predicate or a join: time, money and place."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from .spans import recognise_date, recognise_money

EARTH_M = 6_371_008.8


def period_start(code: Column) -> Column:
    """First day of yyyyMM, or the day of yyyyMMdd."""
    return F.when(F.length(code) == 6, F.to_date(F.concat(code, F.lit("01")), "yyyyMMdd")).otherwise(F.to_date(code, "yyyyMMdd"))


def period_end(code: Column) -> Column:
    """The day after the period's last."""
    return F.when(F.length(code) == 6, F.add_months(period_start(code), 1)).otherwise(F.date_add(period_start(code), 1))


def geo_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres by the haversine formula."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.lit(EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


CATALOG: dict[str, Callable[..., Column]] = {"period_start": period_start, "period_end": period_end, "geo_distance_m": geo_distance_m}


def period_code(code: Column, form: str) -> Column:
    """yyyyMM or yyyyQn written as form: yyyyMM, yyyy-MM, yyyy/MM, yyyyQn or yyyy-Qn."""
    bare = F.regexp_replace(code, "[-/]", "")
    sign = {"yyyyMM": "", "yyyy-MM": "-", "yyyy/MM": "/", "yyyyQn": "", "yyyy-Qn": "-"}
    if form not in sign:
        raise EngineError("validation_failed", f"period form {form}")
    return F.concat(F.substring(bare, 1, 4), F.lit(sign[form]), F.substring(bare, 5, 2))


def period_join(facts: DataFrame, periods: DataFrame, date: str, code: str, start: str = "start_date", end: str = "end_date", period: str = "period") -> DataFrame:
    """Facts of one period by its table; one period's rows are few whatever the facts."""
    one = periods.filter(F.col(period) == code).select(F.col(start).alias("__start"), F.col(end).alias("__end"))
    return facts.join(one, (F.col(date) >= F.col("__start")) & (F.col(date) < F.col("__end")), "left_semi")


_READ = "span string, first date, after date, code string"
_PRICED = "span string, amount decimal(28,6), currency string, comparator string, tolerance boolean"


def read_dates(spans: DataFrame, reference: dt.date, span: str = "span", triggers: tuple[str, ...] = ()) -> DataFrame:
    """(span, first, after, code) for each distinct span; nulls where it names no time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [None if text is None else recognise_date(text, reference, triggers) for text in texts]
            columns = [[x and getattr(x, name) for x in found] for name in ("start", "end", "code")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([texts, *columns], (pa.string(), pa.date32(), pa.date32(), pa.string()))], ["span", "first", "after", "code"])

    return spans.select(F.col(span).alias("span")).distinct().mapInArrow(read, _READ)


def read_money(spans: DataFrame, locale: str = "en", span: str = "span") -> DataFrame:
    """(span, amount, currency, comparator, tolerance) for each distinct span; nulls where it names no amount."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.decimal128(28, 6), pa.string(), pa.string(), pa.bool_())
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [None if text is None else recognise_money(text, locale) for text in texts]
            columns = [[x and x.amount.quantize(Decimal("0.000001")) for x in found], *[[None if x is None else getattr(x, name) for x in found] for name in ("currency", "comparator", "tolerance")]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([texts, *columns], kinds)], ["span", "amount", "currency", "comparator", "tolerance"])

    return spans.select(F.col(span).alias("span")).distinct().mapInArrow(read, _PRICED)


def fx_join(facts: DataFrame, rates: DataFrame, amount: str, source: str, target: str, as_of: dt.date | None, out: str = "domestic") -> DataFrame:
    """Amounts in the target currency at the rate valid on a day; without the day, rows would fan out, so it refuses."""
    if as_of is None:
        raise EngineError("as_of_required", f"{source} to {target}")
    day = F.lit(as_of)
    one = rates.filter((F.col("from_ccy") == source) & (F.col("to_ccy") == target) & (day >= F.col("valid_from")) & (day < F.col("valid_to")))
    return facts.crossJoin(one.select(F.col("rate").alias("__rate")).limit(1)).withColumn(out, F.col(amount) * F.col("__rate")).drop("__rate")


def fx_validity(facts: DataFrame, rates: DataFrame, currency: str, date: str, amount: str, target: str, out: str = "domestic") -> DataFrame:
    """Each fact at the rate valid on its own day."""
    r = rates.filter(F.col("to_ccy") == target)
    on = (F.col(currency) == F.col("from_ccy")) & (F.col(date) >= F.col("valid_from")) & (F.col(date) < F.col("valid_to"))
    return facts.join(r, on).withColumn(out, F.col(amount) * F.col("rate")).drop(*rates.columns)


@dataclass(frozen=True)
class Boundary:
    """A place's outer ring, its box, and the ring as WKT."""

    wkt: str
    box: tuple[float, float, float, float]
    rings: tuple[tuple[tuple[float, float], ...], ...] = field(default=())

    def in_box(self, lat: Column, lon: Column) -> Column:
        lo_lat, lo_lon, hi_lat, hi_lon = self.box
        return lat.between(lo_lat, hi_lat) & lon.between(lo_lon, hi_lon)


def _plain(x: float) -> str:
    """The shortest decimal that reads back as x, whole numbers without a point."""
    return repr(x).removesuffix(".0")


def boundary(geojson: str) -> Boundary:
    """From a GeoJSON Polygon or MultiPolygon; holes are left out."""
    body = json.loads(geojson)
    body = body.get("geometry", body)
    if body.get("type") == "Polygon":
        polygons = [body["coordinates"]]
    elif body.get("type") == "MultiPolygon":
        polygons = body["coordinates"]
    else:
        raise EngineError("validation_failed", f"geometry {body.get('type')}")
    rings = tuple(tuple((float(x), float(y)) for x, y, *_ in polygon[0]) for polygon in polygons)
    lons, lats = [x for ring in rings for x, _ in ring], [y for ring in rings for _, y in ring]
    texts = ["((" + ", ".join(f"{_plain(x)} {_plain(y)}" for x, y in ring) + "))" for ring in rings]
    wkt = f"POLYGON {texts[0]}" if body["type"] == "Polygon" else f"MULTIPOLYGON ({', '.join(texts)})"
    return Boundary(wkt, (min(lats), min(lons), max(lats), max(lons)), rings)


def near_place(facts: DataFrame, places: DataFrame, place: str, metres: float, lat: str = "lat", lon: str = "lon", name: str = "name") -> DataFrame:
    """Facts within metres of a named place."""
    one = places.filter(F.col(name) == place).select(F.col(lat).alias("__lat"), F.col(lon).alias("__lon"))
    return facts.join(one, geo_distance_m(F.col(lat), F.col(lon), F.col("__lat"), F.col("__lon")) <= metres, "left_semi")
