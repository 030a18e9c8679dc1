"""Tables found by key: versions whose periods are buckets of the key's hash, so that a small batch reads only its buckets.

Two of them stand beside the ledger: the index of logged requests, which says whether an inquiry was
logged in a round whatever its date, and the confirmed answers, one row for each fingerprint.
"""

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeledger import schemas
from codeledger.operators.reviews import confirmations
from codeledger.sources import tables
from codeledger.sources.tables import conform
from codeledger.sources.versions import Conflict, File, VersionedTable

#: Buckets of a new table. A table keeps the number it was made with.
BUCKETS = 64

_PLACE = [T.StructField("bucket", T.IntegerType()), T.StructField("ingest_batch", T.StringType())]
LOGGED = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("round", T.IntegerType()), *_PLACE])
CONFIRMED = T.StructType([*schemas.VERIFIED.fields, *_PLACE])


class KeyedTable:
    """A table of versions in buckets of a key. Every file holds rows of one bucket, in order of the key."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], buckets: int = BUCKETS) -> None:
        self.key = tuple(key)
        self.table = VersionedTable(spark, path, schema, period="bucket", order=self.key)
        self.buckets = self._made_with(buckets)

    def _made_with(self, buckets: int) -> int:
        """The number of buckets that the table has; the first to open a new one sets it."""
        folder = self.table.folder
        if "buckets" not in folder.names("made"):
            waiting = f"made/.{uuid.uuid4().hex}"
            folder.write(waiting, buckets)
            try:
                folder.publish(waiting, "made/buckets")
            except Conflict:
                pass  # another was first
        return folder.read("made/buckets")

    def bucket(self) -> Column:
        types = {field.name: field.dataType for field in self.table.schema}
        return F.pmod(F.xxhash64(*(F.col(name).cast(types[name]) for name in self.key)), F.lit(self.buckets)).cast("int")

    def placed(self, rows: DataFrame) -> DataFrame:
        return conform(rows.withColumn("bucket", self.bucket()), self.table.schema)

    def files_for(self, rows: DataFrame, version: int | None = None) -> list[File]:
        """The files of the buckets that the rows' keys fall in. What the driver is told is bounded by the buckets."""
        if not self.table.files(version):
            return []  # the rows need not be read
        wanted = {str(row.bucket) for row in rows.select(self.bucket().alias("bucket")).distinct().collect()}
        return self.table.files(version, lambda period: period in wanted)

    def matching(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """The table's rows whose key is among those of ``rows``; only their buckets are read.

        A key with a null is like no other. The keys of a small batch are broadcast by their measured size, so the table's side is not shuffled.
        """
        files = self.files_for(rows, version)
        if not files:
            return self.table.rows([])
        keys = rows.select(*(F.col(name).alias(f"_{name}") for name in self.key)).distinct()
        return self.table.rows(files).join(keys, self._same_key(), "left_semi")

    def _same_key(self) -> list[Column]:
        return [F.col(name) == F.col(f"_{name}") for name in self.key]

    def append(self, rows: DataFrame, batch: str) -> int:
        """Add a batch, in place of what the table has of it."""
        return self.table.append(self.placed(rows), batch)

    def merge(self, rows: DataFrame, order: Sequence[str], tries: int = 10) -> int:
        """Add rows, keeping one of each key: the first by ``order``, of equals the first by its other columns.

        Keys that the table lacks are appended. Only where a new row comes before a stored one is a bucket
        written anew. The same rows again change nothing. If another writer was first, it is done again on what that one left.
        """
        added = self.placed(rows).persist()
        try:
            while True:
                on, tries = self.table.latest(), tries - 1
                try:
                    return self._merge(added, [*order], on)
                except Conflict:
                    if not tries:
                        raise
        finally:
            added.unpersist()

    def _merge(self, added: DataFrame, order: list[str], on: int) -> int:
        names = [name for name in self.table.schema.fieldNames() if name not in ("bucket", self.table.batch)]
        known = self.matching(added, on)
        ranked = Window.partitionBy(*self.key).orderBy(*(F.col(name) for name in [*order, *(name for name in names if name not in order), self.table.batch]))
        first = known.unionByName(added).withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")
        stored = known.select(*(F.col(name).alias(f"_{name}") for name in names))
        empty = not self.table.files(on)
        new = first.persist() if empty else first.join(stored, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in names], "left_anti").persist()
        try:
            if new.isEmpty():
                return on
            if empty:
                return self.table.commit(new, on, what="merge")
            gone = known.join(new.select(*(F.col(name).alias(f"_{name}") for name in self.key)), self._same_key(), "left_semi")
            stale = self.files_for(gone, on)
            rest = self.table.rows(stale).join(new.select(*(F.col(name).alias(f"_{name}") for name in self.key)), self._same_key(), "left_anti")
            return self.table.commit(new.unionByName(rest) if stale else new, on, stale, "merge")
        finally:
            new.unpersist()

    def compact(self) -> int:
        return self.table.compact()


def logged_requests(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    """The index of logged requests: ``row_id, round`` of every ledger row that has an id, and its batch."""
    return KeyedTable(spark, path, LOGGED, ("row_id", "round"), buckets)


def _requests(rows: DataFrame) -> DataFrame:
    return rows.filter("row_id IS NOT NULL").withColumn("round", F.coalesce("round", F.lit(1)))


def index_logged(records: DataFrame, index: KeyedTable, batch: str) -> int:
    """Enter a batch of ledger rows, in place of what the index has of that batch."""
    return index.append(_requests(records).select("row_id", "round"), batch)


def index_history(history: DataFrame, index: KeyedTable) -> int:
    """Enter a ledger that was kept without an index, under the batches it names."""
    rows = _requests(history).select("row_id", "round", "ingest_batch").distinct()
    return index.table.commit(index.placed(rows), index.table.latest(), what="index")


def not_logged(cases: DataFrame, index: KeyedTable, batch: str) -> DataFrame:
    """The cases whose inquiry and round no other batch has logged, under whatever date.

    Cases without an id repeat nothing. Only the buckets of the cases are read.
    """
    if not index.table.files():
        return cases
    logged = index.matching(_requests(cases)).filter(F.col("ingest_batch") != batch).select(F.col("row_id").alias("_id"), F.col("round").alias("_round")).distinct()
    same = (F.col("row_id") == F.col("_id")) & (F.coalesce("round", F.lit(1)) == F.col("_round"))
    return cases.join(logged, same, "left_anti")


def confirmed_answers(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    """The confirmed answers by fingerprint: the earliest confirmation of each."""
    return KeyedTable(spark, path, CONFIRMED, ("product_fingerprint",), buckets)


def merge_confirmed(answers: DataFrame, table: KeyedTable, batch: str) -> int:
    """Take in confirmations; of each fingerprint the earliest stays.

    A batch taken in again changes nothing. One that is corrected adds its rows and takes none back: that is for the log
    (:func:`codeledger.sources.tables.append_verified`), from which the table can be made anew.
    """
    usable = answers.filter(F.col("product_fingerprint") != "").withColumn("ingest_batch", F.lit(batch))
    return table.merge(usable, ("senior_timestamp", "row_id"))


def submit_reviews(submitted: DataFrame, reviews_path: str, verified_path: str, confirmed: KeyedTable, batch: str) -> None:
    """As :func:`codeledger.sources.tables.submit_reviews`, the confirming ones also into the table by fingerprint."""
    merge_confirmed(confirmations(submitted), confirmed, batch)
    tables.submit_reviews(submitted, reviews_path, verified_path, batch)


def relevant_confirmed(table: KeyedTable, fingerprints: DataFrame) -> DataFrame:
    """The confirmations of the fingerprints, one each; only their buckets are read, and that side is not shuffled."""
    return table.matching(fingerprints).drop("bucket", "ingest_batch")
