"""Guarded moves between blobs, cached values, session frames and database tables."""

from __future__ import annotations

import tempfile
import time
import uuid
import zipfile
from dataclasses import dataclass
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import EngineError
from ..operators import fingerprint
from ..operators.workspace import Workspace

BLOB, CACHE, FRAME, TABLE = "blob", "cache", "session_df", "db_table"
KINDS = (BLOB, CACHE, FRAME, TABLE)


@dataclass(frozen=True)
class Location:
    """kind, and what names the place: a path, a key, (session, frame), or a table with its connection."""

    kind: str
    name: str
    scope: str = ""


def legal(verb: str, source: Location, target: Location | None = None) -> str:
    """allowed, same_location or disallowed.

    materialize goes to blob, cache or, from outside the database, a table, and
    not between two session frames; stage goes into session frames only; copy
    joins any two places but session frames to one another; evict spares database
    tables; describe is always allowed.
    """
    if verb == "describe":
        return "allowed"
    if verb == "evict":
        return "disallowed" if source.kind == TABLE else "allowed"
    if target is None:
        raise EngineError("validation_failed", f"{verb} without a target")
    if verb == "stage":
        return "same_location" if source == target and target.kind == FRAME else "allowed" if target.kind == FRAME else "disallowed"
    if source == target:
        return "same_location"
    if verb == "materialize":
        return "disallowed" if target.kind == FRAME or source.kind == target.kind == TABLE else "allowed"
    if verb == "copy":
        return "disallowed" if source.kind == target.kind == FRAME else "allowed"
    raise EngineError("validation_failed", verb)


@dataclass
class Mover:
    """Moves frames; base is the shared folder for blobs, cached values and staging."""

    spark: SparkSession
    base: str
    workspace: Workspace
    writable: tuple[str, ...] = ("*",)

    def _path(self, at: Location) -> str:
        return f"{self.base.rstrip('/')}/{'blobs' if at.kind == BLOB else 'cache'}/{at.name.strip('/')}"

    def _allowed(self, at: Location) -> None:
        if at.kind == TABLE and "*" not in self.writable and at.name.split(".")[0] not in self.writable:
            raise EngineError("write_not_allowed", at.name)

    def read(self, at: Location) -> DataFrame:
        if at.kind == FRAME:
            return self.workspace.get(at.scope, at.name)
        if at.kind == TABLE:
            return self.spark.table(at.name)
        if at.kind == CACHE:
            info = self._info(at)
            if info is not None and info["expires"] is not None and info["expires"] < time.time():
                raise EngineError("cache_expired", at.name)
        return self.spark.read.parquet(self._path(at))

    def _info(self, at: Location) -> dict | None:
        path = self._path(at) + ".info"
        if not self._exists(path):
            return None
        return self.spark.read.schema("fingerprint string, expires double").json(path).first().asDict()

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where, jvm

    def _exists(self, path: str) -> bool:
        fs, where, _ = self._fs(path)
        return fs.exists(where)

    def _swap(self, staged: str, final: str) -> None:
        """Puts a finished folder in place of another, which is put back if that fails."""
        fs, src, jvm = self._fs(staged)
        dst = jvm.org.apache.hadoop.fs.Path(final)
        old = jvm.org.apache.hadoop.fs.Path(f"{staged}.old")
        fs.mkdirs(dst.getParent())
        there = fs.exists(dst)
        if there and not fs.rename(dst, old):
            raise EngineError("write_failed", final)
        if not fs.rename(src, dst):
            if there:
                fs.rename(old, dst)
            raise EngineError("write_failed", final)
        if there:
            fs.delete(old, True)

    def move(self, verb: str, source: Location, target: Location, mode: str = "create", expect: str | None = None, ttl: float | None = None) -> dict:
        """The schema's fingerprint is checked before anything is written; a failed write leaves the target as it was."""
        verdict = legal(verb, source, target)
        if verdict == "disallowed":
            raise EngineError("illegal_move", f"{verb} {source.kind} to {target.kind}")
        if verdict == "same_location":
            return {"moved": False, "note": "same location"}
        self._allowed(target)
        df = self.read(source)
        mark = fingerprint.of_frame(df)
        if expect is not None and expect != mark:
            raise EngineError("fingerprint_mismatch", source.name)
        self.write(df, target, mode, ttl)
        return {"moved": True, "fingerprint": mark}

    def write(self, df: DataFrame, target: Location, mode: str = "create", ttl: float | None = None) -> None:
        if target.kind == FRAME:
            self.workspace.put(target.scope, target.name, df)
            return
        if target.kind == TABLE:
            self._table(df, target.name, mode)
            return
        path = self._path(target)
        staged = f"{self.base.rstrip('/')}/staging/{uuid.uuid4().hex}"
        if mode == "create" and target.kind == BLOB and self._exists(path):
            raise EngineError("target_exists", target.name)
        df.write.parquet(staged)
        self._swap(staged, path)
        if target.kind == CACHE:
            mark, expires = fingerprint.of_frame(df), None if ttl is None else time.time() + ttl
            note = self.spark.createDataFrame([(mark, expires)], "fingerprint string, expires double")
            note.coalesce(1).write.mode("overwrite").json(path + ".info")

    def _table(self, df: DataFrame, name: str, mode: str) -> None:
        nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        if nested:
            raise EngineError("unsupported_type", f"column {nested[0]}")
        there = self.spark.catalog.tableExists(name)
        if mode == "create":
            if there:
                raise EngineError("target_exists", name)
            df.write.saveAsTable(name)
        elif mode == "replace":
            mark = uuid.uuid4().hex[:8]
            staged, old = f"{name}_staged_{mark}", f"{name}_old_{mark}"
            df.write.saveAsTable(staged)
            if there:
                self.spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
            try:
                self.spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
            except Exception:
                if there:
                    self.spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
                raise
            if there:
                self.spark.sql(f"DROP TABLE {old}")
        elif mode == "append":
            if not there:
                raise EngineError("target_not_found", name)
            if [(n, t) for n, t in self.spark.table(name).dtypes] != df.dtypes:
                raise EngineError("schema_mismatch", name)
            df.write.mode("append").saveAsTable(name)
        else:
            raise EngineError("validation_failed", mode)

    def put_bytes(self, name: str, body: bytes) -> str:
        """A blob as it is; returns its path."""
        path = self._path(Location(BLOB, name))
        fs, where, _ = self._fs(path)
        out = fs.create(where, True)
        out.write(bytearray(body))
        out.close()
        return path

    def evict(self, at: Location) -> bool:
        """Removes a place's data; a blob name that ends in / removes all below it."""
        if legal("evict", at) == "disallowed":
            raise EngineError("illegal_move", f"evict {at.kind}")
        if at.kind == FRAME:
            return self.workspace.drop(at.scope, at.name)
        fs, where, jvm = self._fs(self._path(at))
        fs.delete(jvm.org.apache.hadoop.fs.Path(self._path(at) + ".info"), True)
        return fs.delete(where, True)

    def describe(self, at: Location, count: bool = False) -> dict:
        df = self.read(at)
        info = self._info(at) if at.kind == CACHE else None
        return {"schema": df.schema, "fingerprint": fingerprint.of_frame(df), "rows": df.count() if count else -1, "expires": info["expires"] if info else None}


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **options: str) -> None:
    """A database table over JDBC. One transaction covers a partition only, so replace goes through a staging table.

    The staged rows take the place of the old ones in one transaction, so readers see
    either; a failure before it leaves the table as it was.
    """
    from .readers import identifier

    if mode not in ("create", "replace", "append"):
        raise EngineError("validation_failed", mode)
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise EngineError("unsupported_type", f"column {nested[0]}")

    def save(name: str, how: str) -> None:
        df.write.format("jdbc").options(url=url, dbtable=identifier(name), batchsize=batch, **options).mode(how).save()

    if mode != "replace":
        save(table, {"create": "errorifexists", "append": "append"}[mode])
        return
    staged = f"{table}_staged_{uuid.uuid4().hex[:8]}"
    save(staged, "errorifexists")
    old, new = identifier(table), identifier(staged)
    connection = _connection(df.sparkSession, url, options)
    try:
        connection.setAutoCommit(False)
        there = connection.getMetaData().getTables(None, None, None, None)
        names = set()
        while there.next():
            names.add(there.getString("TABLE_NAME").lower())
        there.close()
        if old.rsplit(".", 1)[-1].strip('"`[]').lower() in names:
            columns = ", ".join(_quoted(connection, name) for name in df.columns)
            _execute(connection, f"DELETE FROM {old}", f"INSERT INTO {old} ({columns}) SELECT {columns} FROM {new}")
        else:
            _execute(connection, f"CREATE TABLE {old} AS SELECT * FROM {new} WITH NO DATA", f"INSERT INTO {old} SELECT * FROM {new}")
        _execute(connection, f"DROP TABLE {new}")
        connection.commit()
    except Exception:
        connection.rollback()
        _execute(connection, f"DROP TABLE {new}")
        connection.commit()
        raise
    finally:
        connection.close()


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def packed_database(df: DataFrame, table: str) -> str:
    """URL of a read-only Derby database that holds the rows as a table, for readers in any process of the application.

    Only one process may have an embedded database open for writing, so the rows
    stream through the driver, which fills it one by one: for small tables. Spark
    hands it to the executors as a jar, which any number of processes may read; it
    goes with the application.
    """
    from .readers import identifier

    spark, name = df.sparkSession, f"d{uuid.uuid4().hex}"
    jar = Path(tempfile.mkdtemp(prefix="derby-", dir=SparkFiles.getRootDirectory()), f"{name}.jar")
    with tempfile.TemporaryDirectory(prefix="derby-", dir=jar.parent) as home:
        url = f"jdbc:derby:{home}/{name}"
        write_jdbc(df.limit(0), f"{url};create=true", table, "create", **DERBY)
        connection = _connection(spark, url, DERBY)
        connection.setAutoCommit(False)
        insert = connection.prepareStatement(f"INSERT INTO {identifier(table)} VALUES ({', '.join('?' * len(df.columns))})")
        for row in df.toLocalIterator():
            for k, value in enumerate(row, 1):
                insert.setObject(k, value)
            insert.executeUpdate()
        connection.commit()
        connection.close()
        try:
            _connection(spark, f"{url};shutdown=true", DERBY)
        except Py4JJavaError as e:  # Derby reports an orderly end as an error of this state
            if e.java_exception.getSQLState() != "08006":
                raise
        with zipfile.ZipFile(jar, "w") as out:  # not compressed, so pages are found by their place
            for p in sorted(Path(home).rglob("*")):
                if p.is_file():
                    out.write(p, p.relative_to(home))
    spark.sql(f"ADD JAR '{jar}'")
    return f"jdbc:derby:classpath:{name}"


def _connection(spark: SparkSession, url: str, options: dict[str, str]):
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    for key, value in options.items():
        if key in ("user", "password"):
            properties.setProperty(key, value)
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    return jvm.java.sql.DriverManager.getConnection(url, properties)


def _quoted(connection, name: str) -> str:
    mark = connection.getMetaData().getIdentifierQuoteString().strip()
    return f"{mark}{name}{mark}"


def _execute(connection, *statements: str) -> None:
    for statement in statements:
        one = connection.createStatement()
        one.execute(statement)
        one.close()
