"""Frames from values, JSON rows, Arrow batches, files and databases."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


def json_rows(spark: SparkSession, text: str) -> DataFrame:
    """An array of objects: keys in order of first sight; bool, then long, double, string over all rows."""
    try:
        rows = json.loads(text)
    except ValueError as e:
        raise EngineError("validation_failed", "not JSON") from e
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise EngineError("validation_failed", "not an array of objects")
    names = list(dict.fromkeys(k for r in rows for k in r))
    fields = []
    for name in names:
        seen = [r[name] for r in rows if r.get(name) is not None]
        if seen and all(isinstance(x, bool) for x in seen):
            kind: T.DataType = T.BooleanType()
        elif seen and all(isinstance(x, int) and not isinstance(x, bool) for x in seen):
            kind = T.LongType()
        elif seen and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in seen):
            kind = T.DoubleType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(name, kind))

    def cast(x, kind):
        if x is None:
            return None
        if isinstance(kind, T.DoubleType):
            return float(x)
        if isinstance(kind, T.StringType):
            return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        return x

    return spark.createDataFrame([tuple(cast(r.get(f.name), f.dataType) for f in fields) for r in rows], T.StructType(fields))


def json_files(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Large JSON, one object a line, with a declared schema so nothing is read twice."""
    return spark.read.schema(columns).json(path)


_WIDER = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64()}


def arrow_batches(spark: SparkSession, batches: Iterable[pa.RecordBatch]) -> DataFrame:
    """Batches of one schema, the first that has rows setting it; unsigned integers are widened."""
    batches = list(batches)
    filled = [b for b in batches if b.num_rows] or batches[:1]
    if not filled:
        raise EngineError("validation_failed", "no batches")
    schema = filled[0].schema
    for b in filled:
        if not b.schema.equals(schema):
            raise EngineError("schema_mismatch", "batches differ")
    table = pa.Table.from_batches(filled)
    return spark.createDataFrame(table.cast(pa.schema([f.with_type(_WIDER.get(f.type, f.type)) for f in schema])))


def ipc_file(spark: SparkSession, path: str, most_bytes: int = 128 << 20) -> DataFrame:
    """One Arrow IPC object, read through Spark so any store it knows will do; beyond most_bytes use Parquet."""
    found = spark.read.format("binaryFile").load(path).select("length", "content")
    size = found.select("length").first()
    if size is None:
        raise EngineError("blob_not_found", path)
    if size[0] > most_bytes:
        raise EngineError("blob_too_large", path)
    return arrow_batches(spark, pa.ipc.open_stream(bytes(found.first()["content"])).read_all().to_batches())


def jdbc_table(spark: SparkSession, url: str, table: str, fetch: int = 10_000, partition: tuple[str, int, int, int] | None = None, tenant: str | None = None, **options: str) -> DataFrame:
    """A whole table through a cursor; partition gives (column, low, high, parts) for parallel reads.

    tenant is set in the database session, so its own row policies hold.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=identifier(table), fetchsize=fetch, **options)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=identifier(column), lowerBound=low, upperBound=high, numPartitions=parts)
    if tenant is not None:
        if not re.fullmatch(r"[0-9a-fA-F-]{36}", tenant):
            raise EngineError("tenant_id_required", "not a UUID")
        reader = reader.option("sessionInitStatement", f"SET app.tenant_id = '{tenant}'")
    return reader.load()


def identifier(name: str) -> str:
    if not _IDENTIFIER.fullmatch(name):
        raise EngineError("validation_failed", f"identifier {name!r}")
    return name


def vocabulary(df: DataFrame, key: str, column: str, category: str, aliases: DataFrame | None = None) -> DataFrame:
    """(id, value, category) of a column's members, with those of an alias table."""
    out = df.select(F.col(identifier(key)).cast("string").alias("id"), F.col(identifier(column)).alias("value"), F.lit(category).alias("category"))
    if aliases is not None:
        out = out.unionAll(aliases.select(F.col(identifier(key)).cast("string"), F.col("alias"), F.lit(category)))
    return out.filter("value IS NOT NULL").distinct()
