"""Files that the driver and all executors share, and helpers for Arrow groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_RUN = "[ \\t-\\r]+"

#: Folders written while settled() makes its rows.
_FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, written to the shared folder and read from there, which cuts the lineage; and where they lie."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folders = _FOLDERS.get()
    if folders is not None:
        folders.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read from there; the folder stays, since the result may be read at any time."""
    return written_at(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Takes away a folder that written_at() gave, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """make()'s rows, written, and where they lie; what was written to make them is removed, also if that fails."""
    inner: list[str] = []
    token = _FOLDERS.set(inner)
    try:
        rows = make()
        _FOLDERS.reset(token)
        token = None
        return written_at(rows, name)
    finally:
        if token is not None:
            _FOLDERS.reset(token)
        for path in inner:
            removed(spark, path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that df does not have."""
    lead, taken = "_", {name.lower() for name in df.columns}
    while any(f"{lead}{name}".lower() in taken for name in wanted):
        lead += "_"
    return [f"{lead}{name}" for name in wanted]


def same_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{name}`") for name in like.columns])


def side(table: pa.Table, **kinds: pa.DataType) -> pa.Table:
    """A cogroup's side; one without rows comes without columns and gets those named."""
    return table if table.num_rows and table.num_columns else pa.table({name: pa.array([], kind) for name, kind in kinds.items()})


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def in_blocks(docs: DataFrame, n_blocks: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, doc_id, text): every row falls into one of n_blocks by a hash of its id, its text and its partition.

    With the partition, a row that repeats very often does not fill one block.
    Nothing else of the row is carried, so columns of clashing names do no harm.
    """
    ident = F.col(id_col).cast("long")
    body = text_or_empty(text)
    block = F.pmod(F.xxhash64(ident, F.crc32(body.cast("binary")), F.spark_partition_id()), F.lit(n_blocks))
    return docs.select(block.cast("int").alias("block"), ident.alias("doc_id"), body.alias("text"))
