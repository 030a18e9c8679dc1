"""Stored tables: the ledger, the review log and the confirmed answers.

Layout for large tables: the ledger is partitioned by period (days, or months where days
are small) and write batch, so reports over a time span read only its periods, and writing
a batch again replaces that batch. Reviews are appended to a log and laid over the ledger
when it is read; :func:`fold_reviews` works them into the partitions they touch.
"""

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from codeledger import schemas
from codeledger.operators.reviews import apply_reviews, confirmations, latest_reviews

LEDGER_PARTITIONS = ("event_period", "ingest_batch")
_BATCH = T.StructField("ingest_batch", T.StringType())

VERIFIED_TABLE = T.StructType(schemas.VERIFIED.fields + [_BATCH])
REVIEW_LOG = T.StructType(
    [
        T.StructField("row_id", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("senior_user", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("reviewed_at", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
        _BATCH,
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table under its declared schema; an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _write_partitions(rows: DataFrame, path: str, partitions: tuple[str, ...]) -> None:
    """Write the partitions that the rows have, in place of those that are there."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def _batch_files(spark: SparkSession, path: str, schema: T.StructType, batch: str) -> set[str]:
    """The files of one batch."""
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    files = stored.filter(F.col("ingest_batch") == batch).select("_metadata.file_path").distinct()
    return {row.file_path for row in files.collect()}


def _write_batch(rows: DataFrame, path: str, schema: T.StructType, partitions: tuple[str, ...], batch: str) -> None:
    """Append a batch. Repeating a batch replaces it, whatever its periods; an empty repeat empties it.

    Partitions that the repeat has no rows for are removed after the new ones are in place, so a
    job lost in between leaves rows of both; running it again clears them.
    """
    spark = rows.sparkSession
    before = _batch_files(spark, path, schema, batch)
    _write_partitions(rows, path, partitions)
    if not before:
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    for file in before & _batch_files(spark, path, schema, batch):
        left = hadoop.Path(spark._jvm.java.net.URI(file))
        left.getFileSystem(spark._jsc.hadoopConfiguration()).delete(left, False)


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema, in its order and types; missing ones are null."""
    return rows.select(
        *(
            (F.col(field.name) if field.name in rows.columns else F.lit(None)).cast(field.dataType).alias(field.name)
            for field in schema
        )
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.HISTORY_TABLE)


def period_of(column: str, grain: str) -> Column:
    return F.date_trunc(grain, F.col(column)).cast("date")


def _within(rows: DataFrame) -> Column:
    """Whether ``event_period`` is one that the rows have.

    The periods come to the driver as literals, so that a scan under this filter lists only
    their folders. Their number is bounded by the calendar, not by the rows.
    """
    periods = [row.event_period for row in rows.select("event_period").distinct().collect()]
    here = F.col("event_period").isin([period for period in periods if period is not None])
    # Rows without a time have a partition of their own.
    return here | F.col("event_period").isNull() if None in periods else here


def append_history(
    records: DataFrame, path: str, batch: str, *, grain: str = "day", expand: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Append ledger rows as the named batch, partitioned by period (``day``, ``month`` or ``year``).

    Rows are brought together by period before writing, so that a batch leaves few files
    per period. The rebalance splits a large period over several tasks, whatever its share
    of the rows, and the order by time lets file statistics prune within a period.
    With ``expand`` the records are what ledger rows are made of, row by row, which happens once they are in place:
    it keeps ``timestamp`` and the two columns of the partition.
    """
    placed = records.withColumns({"event_period": period_of("timestamp", grain), "ingest_batch": F.lit(batch)})
    rows = placed if expand else conform(placed, schemas.HISTORY_TABLE)
    ordered = rows.hint("rebalance", "event_period").sortWithinPartitions("event_period", "timestamp")
    if expand:
        ordered = conform(expand(ordered), schemas.HISTORY_TABLE)
    _write_batch(ordered, path, schemas.HISTORY_TABLE, LEDGER_PARTITIONS, batch)


def not_logged(cases: DataFrame, history: DataFrame, batch: str, *, grain: str = "day") -> DataFrame:
    """The cases whose inquiry and round (``row_id, round``) no other batch has logged.

    The ledger is searched in the periods of the cases only: a repeat has the time of the
    inquiry it repeats. Cases without an id repeat nothing.
    """
    placed = cases.withColumn("event_period", period_of("timestamp", grain))
    logged = history.filter(_within(placed) & (F.col("ingest_batch") != batch)).select(
        F.col("event_period").alias("_period"),
        F.col("row_id").alias("_id"),
        F.coalesce("round", F.lit(1)).alias("_round"),
    )
    same = F.col("event_period").eqNullSafe(F.col("_period"))
    same = same & (F.col("row_id") == F.col("_id")) & (F.col("round") == F.col("_round"))
    return placed.join(logged, same, "left_anti").select(cases.columns)


def read_verified(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, VERIFIED_TABLE).drop("ingest_batch")


def append_verified(answers: DataFrame, path: str, batch: str) -> None:
    rows = conform(answers.withColumn("ingest_batch", F.lit(batch)), VERIFIED_TABLE)
    _write_batch(rows, path, VERIFIED_TABLE, ("ingest_batch",), batch)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, REVIEW_LOG)


def append_reviews(reviews: DataFrame, path: str, batch: str) -> None:
    rows = conform(reviews.withColumn("ingest_batch", F.lit(batch)), REVIEW_LOG)
    _write_batch(rows, path, REVIEW_LOG, ("ingest_batch",), batch)


def submit_reviews(submitted: DataFrame, reviews_path: str, verified_path: str, batch: str) -> None:
    """Take in reviews: all of them into the log, the confirming ones into the confirmed answers, too.

    ``submitted`` has the columns of the log and the ``cn_code, taric_code, description`` that the
    reviewer saw. The log comes last, so a batch that is in the log has its confirmations; a
    batch lost in between is submitted again under its name, which replaces what it left.
    """
    append_verified(confirmations(submitted), verified_path, batch)
    append_reviews(submitted, reviews_path, batch)


def current_history(spark: SparkSession, history_path: str, reviews_path: str) -> DataFrame:
    """The ledger as of now: stored rows with the review log laid over them."""
    return apply_reviews(read_history(spark, history_path), read_reviews(spark, reviews_path))


def fold_reviews(spark: SparkSession, history_path: str, reviews: DataFrame, staging_path: str) -> None:
    """Work reviews into the stored ledger, rewriting only the partitions they touch.

    The new partitions are first written whole to ``staging_path``, which must not exist
    yet, and then put in place from there. If the second write is lost, the staged copy
    is complete: :func:`put_in_place` finishes the job.
    """
    history = read_history(spark, history_path)
    ids = latest_reviews(reviews).select("row_id")
    touched = history.join(ids, "row_id", "left_semi").select(*LEDGER_PARTITIONS).distinct()
    keys = touched.select(*(F.col(name).alias(f"_{name}") for name in LEDGER_PARTITIONS))
    same = reduce(and_, (F.col(name).eqNullSafe(F.col(f"_{name}")) for name in LEDGER_PARTITIONS))
    stale = history.filter(_within(touched)).join(keys, same, "left_semi")
    updated = apply_reviews(stale, reviews).select(schemas.HISTORY_TABLE.fieldNames())
    updated.write.mode("errorifexists").partitionBy(*LEDGER_PARTITIONS).parquet(staging_path)
    put_in_place(spark, history_path, staging_path)


def put_in_place(spark: SparkSession, history_path: str, staging_path: str) -> None:
    staged = spark.read.schema(schemas.HISTORY_TABLE).parquet(staging_path)
    _write_partitions(staged, history_path, LEDGER_PARTITIONS)
