"""A table store on plain Parquet: appended versions, a commit log, insert-only merges, history, time travel.

`<table>/v=<n>-<id>/` holds the files of version n and `<table>/_log/<n>.json` commits them: readers list the log only, so a
failed append is invisible.  The log goes through Hadoop's file system API; its files appear whole and are never replaced,
and a lost race surfaces as CommitConflict.  Every SUMMARY versions a file repeats the whole log, so that a reader opens
few files however long the history is.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Log entries after which a summary of all is written.
SUMMARY = 16


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class DuplicateKey(RuntimeError):
    """Candidate rows are not unique by their merge key."""


@dataclass(frozen=True)
class MergeResult:
    candidates: int
    inserted: int


class Files:
    """The few file operations the store needs, on Hadoop's API."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, content: bytes) -> bool:
        """A new file that appears whole or not at all; False if it exists already.

        The content is written aside first.  On a local disk a hard link, which fails if its name is taken, puts it in
        place; elsewhere a rename does, which HDFS refuses onto an existing file.  On an object store, where a rename
        replaces, one writer a table is assumed.
        """
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        aside = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        try:
            if fs.getScheme() != "file":
                return fs.rename(aside, p)
            at = lambda x: self.jvm.java.io.File(x.toUri().getPath()).toPath()
            try:
                self.jvm.java.nio.file.Files.createLink(at(p), at(aside))
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" in str(e):
                    return False
                raise
            return True
        finally:
            fs.delete(aside, False)

    def rename(self, path: str, to: str) -> bool:
        fs, p = self._at(path)
        return fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(to))

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)


#: Whether Spark removes a job's shuffle files as soon as the job ends (Spark 4.1).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame | Sequence[DataFrame], path: str) -> None:
    """Parquet files of a frame, or of several one after the other, compressed by zstd since hash keys are long.

    The shuffle files behind a frame go when it is written, not when the driver collects garbage.
    """
    for part in [df] if isinstance(df, DataFrame) else df:
        conf = part.sparkSession.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            part.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def _repeats(df: DataFrame, key: str) -> bool:
    """Whether rows repeat a key.  Eight bytes of a hash move first; the keys themselves only where hashes repeat."""
    h = F.xxhash64(key).alias("_h")
    twice = df.groupBy(h).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h")
    if twice.isEmpty():
        return False
    return not df.withColumn("_h", h).join(twice, "_h", "left_semi").groupBy(key).count().filter("count > 1").isEmpty()


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _log(self, table: str) -> list[str]:
        return [n for n in self.files.names(f"{self.path(table)}/_log") if n.endswith((".json", ".all"))]

    def all_versions(self, table: str) -> list[dict]:
        """Log entries in order: those of the last summary (`<n>.all`) in one read, later ones one by one."""
        log, names = f"{self.path(table)}/_log", self._log(table)
        summary = next((n for n in reversed(names) if n.endswith(".all")), None)
        done = json.loads(self.files.read(f"{log}/{summary}")) if summary else []
        return done + [json.loads(self.files.read(f"{log}/{n}")) for n in names if n.endswith(".json") and int(n[:-5]) >= len(done)]

    def exists(self, table: str) -> bool:
        return bool(self._log(table))

    def _parts(self, table: str, version: int | None = None) -> tuple[list[str], StructType]:
        """Committed folders since the last overwrite, and the schema."""
        entries = [e for e in self.all_versions(table) if version is None or e["version"] <= version]
        if not entries:
            raise FileNotFoundError(f"no such table or version: {table}")
        start = max((i for i, e in enumerate(entries) if e["operation"] == "OVERWRITE"), default=0)
        return [f"{self.path(table)}/{e['folder']}" for e in entries[start:] if e["rows"]], StructType.fromJson(entries[-1]["schema"])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        parts, schema = self._parts(table, version)
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def read_or_none(self, table: str) -> DataFrame | None:
        return self.read(table) if self.exists(table) else None

    def _folder(self, version: int) -> str:
        return f"v={version}-{uuid.uuid4().hex}"  # a writer that loses the race leaves the winner's files alone

    def _enter(self, table: str, versions: list[dict], folder: str, schema: StructType, operation: str, batch_id: str | None, rows: int, candidates: int) -> None:
        """Commit a written folder as the next version."""
        version = len(versions)
        entry = {"version": version, "folder": folder, "operation": operation, "rows": rows, "candidates": candidates, "batch_id": batch_id, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "schema": schema.jsonValue()}
        log = f"{self.path(table)}/_log"
        if not self.files.create(f"{log}/{version:020d}.json", json.dumps(entry, sort_keys=True).encode()):
            self.files.delete(f"{self.path(table)}/{folder}")
            raise CommitConflict(f"version {version} of {table} exists")
        if version % SUMMARY == SUMMARY - 1:
            self.files.create(f"{log}/{version:020d}.all", json.dumps([*versions, entry], sort_keys=True).encode())

    def _commit(self, table: str, df: DataFrame | Sequence[DataFrame], operation: str, batch_id: str | None, candidates: int | None = None) -> int:
        """Write a frame (or a union's frames) once as the next version; of a merge that finds nothing new, nothing stays."""
        versions = self.all_versions(table)
        folder = self._folder(len(versions))
        path = f"{self.path(table)}/{folder}"
        write(df, path)
        schema = (df if isinstance(df, DataFrame) else df[0]).schema
        rows = self.spark.read.schema(schema).parquet(path).count()  # from the files' footers
        if operation == "MERGE" and not rows:
            self.files.delete(path)
            return 0
        self._enter(table, versions, folder, schema, operation, batch_id, rows, rows if candidates is None else candidates)
        return rows

    def overwrite(self, table: str, df: DataFrame | Sequence[DataFrame], batch_id: str | None = None) -> int:
        return self._commit(table, df, "OVERWRITE", batch_id)

    def append(self, table: str, df: DataFrame, batch_id: str | None = None) -> int:
        return self._commit(table, df, "APPEND", batch_id)

    def merge_new(self, table: str, df: DataFrame, key: str, batch_id: str | None = None) -> MergeResult:
        """Insert the rows whose key the table lacks; nothing is updated or deleted.

        The candidates are written once: as the table's first version, or aside, so that neither counting nor the one
        anti-join repeats their plan.
        """
        versions = self.all_versions(table)
        folder = self._folder(0) if not versions else f"_staged-{uuid.uuid4().hex}"
        stage = f"{self.path(table)}/{folder}"
        write(df, stage)
        staged = self.spark.read.schema(df.schema).parquet(stage)
        candidates = staged.count()
        kept = False
        try:
            if not candidates:
                return MergeResult(0, 0)
            if _repeats(staged, key):
                raise DuplicateKey(f"candidates of {table} repeat {key}")
            if not versions:
                kept = True
                self._enter(table, versions, folder, df.schema, "CREATE", batch_id, candidates, candidates)
                return MergeResult(candidates, candidates)
            fresh = staged.join(self.read(table).select(key), key, "left_anti").select(df.columns)
            return MergeResult(candidates, self._commit(table, fresh, "MERGE", batch_id, candidates))
        finally:
            if not kept:
                self.files.delete(stage)

    def history(self, table: str) -> DataFrame:
        rows = [(e["version"], e["operation"], e["rows"], e["candidates"], e["batch_id"], e["at"]) for e in self.all_versions(table)]
        return self.spark.createDataFrame(rows, "version long, operation string, rows_inserted long, candidates long, batch_id string, committed_at string")

    def register(self, database: str, required: Sequence[str], optional: Sequence[str] = ()) -> list[str]:
        """Views of the tables' present state in a database of the catalog, made if need be; doing it again refreshes them.

        A required table that is missing raises, an optional one is skipped.
        """
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        done = []
        for table in dict.fromkeys([*required, *optional]):
            if not self.exists(table):
                if table in required:
                    raise FileNotFoundError(f"required table {table} does not exist")
                continue
            parts, schema = self._parts(table)
            columns = ", ".join(f"`{f.name}`" for f in schema.fields)
            nothing = "SELECT " + ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields) + " WHERE false"
            query = " UNION ALL ".join(f"SELECT {columns} FROM parquet.`{p}`" for p in parts) or nothing
            self.spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{table}` AS {query}")
            done.append(table)
        return done
