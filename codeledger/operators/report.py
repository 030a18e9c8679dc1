"""Reports on the ledger."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeledger.operators.decisions import OUTCOMES
from codeledger.operators.reviews import reviewed_text

# The report's columns in order, and the review states to filter by.
DISPLAY_COLUMNS = (
    "timestamp", "user", "description", "cn_code", "taric_code",
    "confidence", "outcome", "senior_reviewed", "senior_verdict", "senior_user",
)
ALL, PENDING, REVIEWED = "All", "Pending review", "Reviewed"
RECENT = 10


def history_filter(history: DataFrame, outcomes: Sequence[str] = OUTCOMES, status: str = ALL) -> DataFrame:
    """Rows with one of the outcomes and the review state; no outcome means no filter.

    The reviewed flag is compared untrimmed here, unlike in the review queue.
    """
    if status not in (ALL, PENDING, REVIEWED):
        raise ValueError(f"unknown review status {status!r}")
    rows = history.filter(F.col("outcome").isin(*outcomes)) if outcomes else history
    if status == ALL:
        return rows
    reviewed = F.coalesce(F.lower(reviewed_text(history)) == "yes", F.lit(False))
    return rows.filter(reviewed if status == REVIEWED else ~reviewed)


def history_display(history: DataFrame) -> DataFrame:
    """The display columns that the ledger has, in display order."""
    return history.select(*(name for name in DISPLAY_COLUMNS if name in history.columns))


def history_kpis(history: DataFrame) -> DataFrame:
    """One row of counts. Partial validations count as validated too, as their text contains it."""
    outcome = F.col("outcome")
    has = lambda text: F.contains(outcome, F.lit(text))
    reviewed = F.lit(False)
    if "senior_reviewed" in history.columns:
        reviewed = F.lower(reviewed_text(history)) == "yes"
    return history.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(has("VALIDATED") & ~has("NOT")).alias("validated"),
        F.count_if(has("PARTIAL")).alias("partial"),
        F.count_if(has("NOT VALIDATED")).alias("rejected"),
        F.count_if(reviewed).alias("reviewed"),
    )


def recent_results(history: DataFrame, code: str = "validated_code", limit: int = RECENT) -> DataFrame:
    """The newest results of each user, newest first: ``user, rank, time, code, outcome``.

    The limit is applied below the shuffle as well, so a busy user costs no more than others.
    """
    newest = Window.partitionBy("user").orderBy(F.col("timestamp").desc(), F.col("row_id").desc())
    ranked = history.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)
    return ranked.select(
        "user",
        "rank",
        F.date_format("timestamp", "HH:mm").alias("time"),
        F.coalesce(F.col(code), F.lit("")).alias("code"),
        "outcome",
    )
