"""The ledger and the review log as tables of versions: appended, reviewed, compacted, read as of any version."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeledger import schemas
from codeledger.operators.reviews import apply_reviews, latest_reviews
from codeledger.sources.tables import REVIEW_LOG, conform, period_of
from codeledger.sources.versions import VersionedTable

LOG = T.StructType([*REVIEW_LOG.fields, T.StructField("event_period", T.DateType())])


def ledger(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, schemas.HISTORY_TABLE, order=("timestamp",))


def review_log(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, LOG, order=("reviewed_at",))


def append_history(records: DataFrame, table: VersionedTable, batch: str, *, grain: str = "day") -> int:
    """Add ledger rows as the named batch, in place of what the ledger has of it; returns the version."""
    return table.append(conform(records.withColumn("event_period", period_of("timestamp", grain)), schemas.HISTORY_TABLE), batch)


def append_reviews(reviews: DataFrame, log: VersionedTable, batch: str, *, grain: str = "month") -> int:
    return log.append(conform(reviews.withColumn("event_period", period_of("reviewed_at", grain)), LOG), batch)


def current_history(table: VersionedTable, log: VersionedTable) -> DataFrame:
    """The ledger as of now: its last version with the log laid over it."""
    return apply_reviews(table.read(), log.read())


def fold_reviews(table: VersionedTable, log: VersionedTable) -> int:
    """Work the logged reviews into the ledger and retire them from the log; returns the ledger's version.

    Only files that have a reviewed row are read whole and written anew. The ledger comes first: if the
    work is lost in between, the same reviews are folded in again, which changes nothing. Reviews that
    arrive meanwhile stay in the log. Raises Conflict if the ledger was changed meanwhile.
    """
    folded = log.files()
    reviews = log.rows(folded)
    version = table.update(latest_reviews(reviews), lambda rows: apply_reviews(rows, reviews), table.latest(), what="fold")
    if folded:
        log.drop(folded, "folded")
    return version
