"""Senior reviews: the queue, the confirmed-answers table and its lookup."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeledger.functions.text import as_column, fingerprint, strip

CONFIRMED = "CONFIRMED"
DEFAULT_SENIOR = "senior"

# Columns that give a row its place in the order in which reviews were written.
REVIEW_ORDER = ("reviewed_at", "seq")


def reviewed_text(rows: DataFrame) -> Column:
    """The reviewed flag as text: imported ledgers carry text, our own tables a boolean."""
    flag = F.col("senior_reviewed")
    if rows.schema["senior_reviewed"].dataType == T.BooleanType():
        return F.when(flag, "yes").otherwise("no")
    return flag


def pending_reviews(history: DataFrame) -> DataFrame:
    """Rows whose trimmed flag is not yes; a missing flag counts as pending."""
    return history.filter(F.lower(strip(F.coalesce(reviewed_text(history), F.lit("")))) != "yes")


def _first(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row per key.

    The filter on the row number becomes a group limit below the shuffle: every map task
    sends at most one row per key, so a key that holds much of the data stays cheap.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def first_verified(verified: DataFrame) -> DataFrame:
    """One confirmation per fingerprint: the earliest. The empty fingerprint never matches."""
    usable = verified.filter(F.col("product_fingerprint") != "")
    return _first(usable, "product_fingerprint", [F.col("senior_timestamp"), F.col("row_id")])


def relevant_verified(verified: DataFrame, inquiries: DataFrame) -> DataFrame:
    """The confirmations whose fingerprint occurs among the inquiries.

    For a small batch against a large table: what is left of the table after one pass
    without a shuffle of it, the batch's fingerprints being few enough to broadcast by
    their measured size. Reads nothing but the descriptions of the batch.
    """
    wanted = inquiries.select(fingerprint("description").alias("product_fingerprint")).distinct()
    return verified.join(wanted, "product_fingerprint", "left_semi")


def verified_lookup(inquiries: DataFrame, verified: DataFrame, *, one_each: bool = False) -> DataFrame:
    """Add the earliest confirmation with the fingerprint of the description, or nulls.

    The inquiries need ``row_id`` and ``description``; their fingerprint is kept in
    ``product_fingerprint``. No broadcast is forced: the confirmations grow with the data,
    so their side is broadcast only when its size, from file or shuffle statistics, is
    below the session's threshold. Otherwise both sides meet in a shuffle join, where a hot
    fingerprint is split by adaptive execution because the other side has one row for it.
    Inquiries that cannot match get a key of their own instead of one shared blank key.
    ``one_each`` says that the confirmations have no fingerprint twice and no blank one.
    """
    keyed = inquiries.withColumn("product_fingerprint", fingerprint("description"))
    mark = F.col("product_fingerprint")
    keyed = keyed.withColumn(
        "_probe", F.when(F.coalesce(mark, F.lit("")) != "", mark).otherwise(F.concat(F.lit("#"), "row_id"))
    )
    found = (verified if one_each else first_verified(verified)).select(
        F.col("product_fingerprint").alias("_found"),
        F.col("row_id").alias("verified_row_id"),
        F.col("cn_code").alias("verified_cn_code"),
        F.col("taric_code").alias("verified_taric_code"),
        F.col("senior_user").alias("verified_user"),
        F.col("senior_timestamp").alias("verified_at"),
        F.col("senior_comment").alias("verified_comment"),
    )
    return keyed.join(found, F.col("_probe") == F.col("_found"), "left").drop("_probe", "_found")


def verified_by(code: Column | str = "code") -> Column:
    """Who confirmed the final code before and when, or null if another code was confirmed."""
    senior = F.coalesce("verified_user", F.lit(DEFAULT_SENIOR))
    day = F.coalesce(F.date_format("verified_at", "yyyy-MM-dd"), F.lit(""))
    text = F.concat(senior, F.lit(" on "), day)
    return F.when(F.col("verified_row_id").isNotNull() & (F.col("verified_cn_code") == as_column(code)), text)


def latest_reviews(reviews: DataFrame, order: Sequence[str] = REVIEW_ORDER) -> DataFrame:
    """The last review of each row."""
    return _first(reviews, "row_id", [F.col(name).desc() for name in order])


def apply_reviews(history: DataFrame, reviews: DataFrame, order: Sequence[str] = REVIEW_ORDER) -> DataFrame:
    """The ledger with the last review of each row written over its review columns.

    Reviews of unknown rows change nothing; rows without a review stay as they are.
    """
    latest = latest_reviews(reviews, order).select(
        "row_id",
        F.lit(True).alias("_hit"),
        F.col("senior_user").alias("_user"),
        F.col("reviewed_at").alias("_at"),
        F.col("verdict").alias("_verdict"),
        F.col("comment").alias("_comment"),
    )
    native = history.schema["senior_reviewed"].dataType == T.BooleanType()
    written = {
        "senior_reviewed": F.lit(True) if native else F.lit("yes"),
        "senior_user": F.col("_user"),
        "senior_timestamp": F.col("_at"),
        "senior_verdict": F.col("_verdict"),
        "senior_comment": F.col("_comment"),
    }
    joined = history.join(latest, "row_id", "left")
    updated = joined.withColumns(
        {name: F.when(F.col("_hit"), value).otherwise(F.col(name)) for name, value in written.items()}
    )
    return updated.select(history.columns)


def confirmations(submitted: DataFrame) -> DataFrame:
    """One confirmed-answers row per confirming review, from the codes and the description that the review carries.

    No ledger is read, so a confirmation counts whether or not its row is known.
    """
    confirming = submitted.filter(F.col("verdict") == CONFIRMED)
    return confirming.select(
        "row_id", fingerprint("description").alias("product_fingerprint"), "cn_code", "taric_code", "senior_user",
        F.col("reviewed_at").alias("senior_timestamp"), F.col("comment").alias("senior_comment"),
        F.col("description").alias("original_description"),
    )


def promote_confirmed(history: DataFrame, reviews: DataFrame) -> DataFrame:
    """One confirmed-answers row per confirming review, repeated ones too.

    The fingerprint carried by the ledger is used; where the ledger has none, it is taken from
    the description, which happens after the join, for the confirmed rows only.
    """
    confirming = reviews.filter(F.col("verdict") == CONFIRMED).select(
        "row_id", "senior_user", F.col("reviewed_at").alias("senior_timestamp"), F.col("comment").alias("senior_comment")
    )
    mark = fingerprint("original_description")
    carried = ["product_fingerprint"] if "product_fingerprint" in history.columns else []
    if carried:
        mark = F.coalesce("product_fingerprint", mark)
    answers = history.select(
        "row_id", *carried, "cn_code", "taric_code", F.col("description").alias("original_description")
    )
    return confirming.join(answers, "row_id").select(
        "row_id", mark.alias("product_fingerprint"), "cn_code", "taric_code",
        "senior_user", "senior_timestamp", "senior_comment", "original_description",
    )
