"""Stored tables in versions: readers hold one, writers add the next, small files are put together.

A folder has ``data`` (Parquet files, a folder for each commit), ``parts`` (lists of files, one for each
period and change) and ``versions`` (one file each, naming the part of every period). A commit
writes its files, then new parts for the periods it touches, then publishes the version by one rename
that fails if that version is there. So a writer lost on the way shows nothing, of two writers on one
version one is refused, and a version once read stays as it was. What the driver lists is bounded: the
periods by the calendar, the files by the periods asked for or touched.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files below this are put together, up to this.
TARGET_BYTES = 128 * 1024 * 1024
#: Lists of files that are read or written at a time.
AT_ONCE = 16


class Conflict(RuntimeError):
    """Another writer has published the version first."""


@dataclass(frozen=True)
class File:
    """A data file: its place below the table's folder, its period and batches, rows and bytes."""

    path: str
    period: str
    batches: tuple[str, ...]
    rows: int
    bytes: int


class _Folder:
    """The few small files that the driver reads and writes, through the cluster's file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.root = self._path(path)
        self.fs = self.root.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.root)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, folder: str) -> list[str]:
        there = self.at(folder)
        return [status.getPath().getName() for status in self.fs.listStatus(there)] if self.fs.exists(there) else []

    def write(self, name: str, value) -> None:
        out = self.fs.create(self.at(name), False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()

    def read(self, name: str):
        source = self.fs.open(self.at(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def read_all(self, names: list[str]) -> list:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return list(pool.map(self.read, names))

    def write_all(self, values: dict[str, object]) -> None:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(self.write, values.keys(), values.values()))

    def publish(self, name: str, target: str) -> None:
        """Rename, unless the target is there."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
        try:
            context.rename(self.at(name), self.at(target), options)
        except Py4JJavaError as failed:
            if "FileAlreadyExistsException" not in str(failed.java_exception.getClass().getName()):
                raise
            self.remove(name)
            raise Conflict(target) from None

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _packed(files: Iterable[File], target: int) -> list[list[File]]:
    """Small files in as few bins of at most ``target`` bytes as first fit finds, larger files first; single ones stay."""
    bins: list[tuple[int, list[File]]] = []
    for file in sorted((file for file in files if file.bytes < target), key=lambda file: (-file.bytes, file.path)):
        for k, (size, held) in enumerate(bins):
            if size + file.bytes <= target:
                bins[k] = (size + file.bytes, [*held, file])
                break
        else:
            bins.append((file.bytes, [file]))
    return [held for _, held in bins if len(held) > 1]


class VersionedTable:
    """A table in versions. Rows have the columns of ``schema``, among them ``period`` and ``batch``."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, *, period: str = "event_period", batch: str = "ingest_batch", order: tuple[str, ...] = ()
    ) -> None:
        self.spark, self.path, self.schema, self.period, self.batch, self.order = spark, path, schema, period, batch, order
        self.folder = _Folder(spark, path)

    # Reading

    def versions(self) -> list[int]:
        return sorted(int(name.split(".")[0]) for name in self.folder.names("versions") if name.endswith(".json") and not name.startswith("."))

    def latest(self) -> int:
        """The last version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def _parts(self, version: int) -> dict[str, str]:
        return self.folder.read(f"versions/{version:020d}.json")["parts"] if version else {}

    def files(self, version: int | None = None, periods: Callable[[str], bool] | None = None) -> list[File]:
        """The files of a version, of all periods or of those that ``periods`` takes (as text; the empty text is null)."""
        parts = self._parts(self.latest() if version is None else version)
        listed = self.folder.read_all([f"parts/{part}" for period, part in parts.items() if periods is None or periods(period)])
        return [File(**{**entry, "batches": tuple(entry["batches"])}) for entries in listed for entry in entries]

    def read(self, version: int | None = None, periods: Callable[[str], bool] | None = None) -> DataFrame:
        """The rows of a version, now the last. The frame keeps that version, whatever is committed later."""
        return self.rows(self.files(version, periods))

    def rows(self, files: Iterable[File]) -> DataFrame:
        """The rows of some files."""
        paths = [self.folder.at(file.path).toString() for file in files]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # Writing

    def commit(self, add: DataFrame | None, on: int, remove: Iterable[File] = (), what: str = "") -> int:
        """The next version after ``on``: without the removed files, with the added rows.

        Raises Conflict if another writer has made that version; nothing of this commit is then seen.
        """
        return self._publish(self._write(add) if add is not None else [], list(remove), on, what)

    def _write(self, rows: DataFrame, bins: str | None = None) -> list[File]:
        """Data files of the rows, not yet seen by anyone. Files hold one period each, and one bin if there are."""
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.select(*self.schema.fieldNames(), F.coalesce(F.col(self.period).cast("string"), F.lit("")).alias("_period"), *([bins] if bins else []))
        # Spark splits a large period over several tasks; a bin is of a bounded size.
        dealt = placed.repartition(bins) if bins else placed.hint("rebalance", "_period")
        keys = ["_period", *([bins] if bins else [])]
        path = self.folder.at(folder).toString()
        dealt.sortWithinPartitions(*keys, *self.order).write.partitionBy(*keys).parquet(path)
        if not any(name.startswith("_period=") for name in self.folder.names(folder)):
            return []
        stored = self.spark.read.schema(self.schema).parquet(path)
        place, period = F.col("_metadata.file_path"), F.coalesce(F.col(self.period).cast("string"), F.lit(""))
        counted = stored.groupBy(place.alias("file"), F.col("_metadata.file_size").alias("size")).agg(
            F.any_value(period).alias("period"), F.sort_array(F.collect_set(self.batch)).alias("batches"), F.count("*").alias("n")
        )
        below = self.folder.root.toUri().getPath().rstrip("/") + "/"
        of = lambda file: self._disk_path(file)[len(below) :]
        return [File(of(row.file), row.period, tuple(row.batches), row.n, row["size"]) for row in counted.collect()]  # as many as the commit has files

    def _disk_path(self, file: str) -> str:
        """The path of a file's URI, with its characters as they are on disk."""
        return self.spark._jvm.java.net.URI(file).getPath()

    def _publish(self, added: list[File], removed: list[File], on: int, what: str) -> int:
        parts = dict(self._parts(on))
        gone = {file.path for file in removed}
        entries: dict[str, list] = {period: [] for period in {file.period for file in [*added, *removed]}}
        before = [period for period in entries if period in parts]
        for period, listed in zip(before, self.folder.read_all([f"parts/{parts[period]}" for period in before]), strict=True):
            entries[period] += [entry for entry in listed if entry["path"] not in gone]
        for file in added:
            entries[file.period].append(asdict(file))
        for period, listed in entries.items():
            parts.pop(period, None)
            if listed:
                parts[period] = f"{uuid.uuid4().hex}.json"
        self.folder.write_all({f"parts/{parts[period]}": listed for period, listed in entries.items() if listed})
        waiting = f"versions/.{uuid.uuid4().hex}"
        self.folder.write(waiting, {"version": on + 1, "what": what, "parts": parts})
        self.folder.publish(waiting, f"versions/{on + 1:020d}.json")
        return on + 1

    def append(self, rows: DataFrame, batch: str, tries: int = 10) -> int:
        """Add a batch, in place of what the table has of it.

        Files of that batch alone are dropped, rows of it in files of several batches are written anew without it.
        Another writer's commit in between does no harm: the new files stay, the version is tried again.
        """
        added = self._write(rows.withColumn(self.batch, F.lit(batch)))
        return self._tried(lambda on: self._without(batch, on, added), f"append {batch}", tries)

    def _without(self, batch: str, on: int, added: list[File]) -> tuple[list[File], list[File]]:
        stale = [file for file in self.files(on) if batch in file.batches]
        mixed = [file for file in stale if len(file.batches) > 1]
        rest = self._write(self.rows(mixed).filter(~F.col(self.batch).eqNullSafe(batch))) if mixed else []
        return [*added, *rest], stale

    def drop(self, files: list[File], what: str = "drop", tries: int = 10) -> int:
        """A version without these files, whatever else has been committed."""
        return self._tried(lambda on: ([], files), what, tries)

    def _tried(self, change: Callable[[int], tuple[list[File], list[File]]], what: str, tries: int) -> int:
        while True:
            on, tries = self.latest(), tries - 1
            try:
                return self._publish(*change(on), on, what)
            except Conflict:
                if not tries:
                    raise

    def update(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame], on: int, key: str = "row_id", what: str = "update") -> int:
        """Change rows whose ``key`` is among those of ``touched``; only files that have such rows are read whole and written anew.

        ``change`` is given all rows of these files. Which they are is found on the key column alone.
        """
        files = self.files(on)
        keys = touched.select(F.col(key).alias("_key")).distinct()
        found = self.rows(files).select(F.col(key).alias("_key"), F.col("_metadata.file_path").alias("file")).join(keys, "_key", "left_semi").select("file").distinct()
        hit = {self._disk_path(row.file) for row in found.collect()}  # at most as many as there are files
        below = self.folder.root.toUri().getPath().rstrip("/") + "/"
        stale = [file for file in files if below + file.path in hit]
        if not stale:
            return on
        return self.commit(change(self.rows(stale)).select(self.schema.fieldNames()), on, stale, what)

    def compact(self, target: int = TARGET_BYTES, on: int | None = None) -> int:
        """Put the small files of each period together, by their sizes in the lists; the rows stay as they are.

        Returns the new version, or the present one if there is nothing to do. Raises Conflict if the table
        was changed meanwhile; the next run then starts from what it has become.
        """
        on = self.latest() if on is None else on
        by_period: dict[str, list[File]] = {}
        for file in self.files(on):
            by_period.setdefault(file.period, []).append(file)
        bins = [held for files in by_period.values() for held in _packed(files, target)]
        if not bins:
            return on
        stale = [file for held in bins for file in held]
        numbered = self.spark.createDataFrame([(self.folder.at(file.path).toUri().getPath(), k) for k, held in enumerate(bins) for file in held], "_file string, _bin int")
        rows = self.rows(stale).withColumn("_file", _plain_path(F.col("_metadata.file_path"))).join(numbered, "_file")
        added = self._write(rows, "_bin")
        return self._publish(added, stale, on, "compact")

    def forget(self, keep: int) -> int:
        """Remove versions before ``keep``, and files that no version names any more; returns their number.

        For a time when nobody writes and no reader holds an earlier version: files of a commit
        under way belong to no version yet.
        """
        live = [version for version in self.versions() if version >= keep]
        if not live:
            raise ValueError(f"there is no version {keep}")
        parts = {part for version in live for part in self._parts(version).values()}
        named = {file.path for version in live for file in self.files(version)}
        for version in self.versions():
            if version < keep:
                self.folder.remove(f"versions/{version:020d}.json")
        gone = 0
        for part in set(self.folder.names("parts")) - parts:
            if not part.startswith("."):
                self.folder.remove(f"parts/{part}")
        for commit in self.folder.names("data"):
            gone += self._sweep(f"data/{commit}", named)
        return gone

    def _sweep(self, folder: str, named: set[str]) -> int:
        gone = 0
        for name in self.folder.names(folder):
            below = f"{folder}/{name}"
            if self.folder.fs.getFileStatus(self.folder.at(below)).isDirectory():
                gone += self._sweep(below, named)
            elif name.endswith(".parquet") and below not in named:
                self.folder.remove(below)
                gone += 1
        left = sum(name.endswith(".parquet") or "=" in name for name in self.folder.names(folder))
        if not left:
            self.folder.remove(folder)
        return gone


def _plain_path(uri: Column) -> Column:
    """The path of a file's URI, decoded."""
    path = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
