from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeledger.functions.text import fingerprint
from codeledger.operators import report, reviews

DAY = [datetime(2024, 1, day) for day in range(1, 32)]
VERIFIED = "row_id string, product_fingerprint string, cn_code string, taric_code string, senior_user string, " \
    "senior_timestamp timestamp_ntz, senior_comment string, original_description string"
REVIEW = "row_id string, seq long, verdict string, senior_user string, comment string, reviewed_at timestamp_ntz"


def inquiries(spark, **descriptions):
    return spark.createDataFrame(list(descriptions.items()), "row_id string, description string")


def test_first_match_wins(spark):
    verified = spark.createDataFrame(
        [("v2", "pump steel", "2", "", "eve", DAY[2], "", ""), ("v1", "pump steel", "1", "", "bob", DAY[1], "", ""),
         ("v0", "pump steel", "0", "", "ann", DAY[1], "", ""), ("v3", "", "3", "", "eve", DAY[0], "", "")],
        VERIFIED,
    )
    asked = inquiries(spark, a="Steel PUMP", b="pump", c="", d=None, e="!!")
    found = {row.row_id: row for row in reviews.verified_lookup(asked, verified).collect()}
    assert len(found) == 5
    assert (found["a"].verified_row_id, found["a"].verified_cn_code) == ("v0", "0")
    assert all(found[key].verified_row_id is None for key in "bcde")


def test_verified_by(spark):
    frame = spark.createDataFrame(
        [("a", "1", "v", "1", "eve", DAY[4]), ("b", "2", "v", "1", "eve", DAY[4]), ("c", "1", "v", "1", None, DAY[4]), ("d", "", None, None, None, None)],
        "row_id string, code string, verified_row_id string, verified_cn_code string, verified_user string, verified_at timestamp_ntz",
    )
    got = {row.row_id: row.v for row in frame.select("row_id", reviews.verified_by().alias("v")).collect()}
    assert got == {"a": "eve on 2024-01-05", "b": None, "c": "senior on 2024-01-05", "d": None}


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_lookup_with_hot_keys(spark, threshold):
    """A third of the rows has one description, a third none; the result is that of brute force."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        n = 3000
        asked = spark.range(n).select(
            F.col("id").cast("string").alias("row_id"),
            F.when(F.col("id") % 3 == 0, "hot pump").when(F.col("id") % 3 == 1, "").otherwise(F.concat(F.lit("part "), "id")).alias("description"),
        )
        answers = spark.range(n).select(
            F.concat(F.lit("v"), "id").alias("row_id"),
            F.when(F.col("id") % 3 == 0, "hot pump").otherwise(F.concat(F.lit("part "), F.col("id") % 500)).alias("original_description"),
            F.col("id").cast("string").alias("cn_code"), F.lit("").alias("taric_code"), F.lit("s").alias("senior_user"),
            (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 7919) % n)).alias("senior_timestamp"),
            F.lit("").alias("senior_comment"),
        ).withColumn("product_fingerprint", fingerprint("original_description"))
        got = {row.row_id: row.verified_row_id for row in reviews.verified_lookup(asked, answers).collect()}
        small = reviews.relevant_verified(answers, asked)
        assert got == {row.row_id: row.verified_row_id for row in reviews.verified_lookup(asked, small).collect()}
        first = {}
        for row in sorted(answers.collect(), key=lambda row: (row.senior_timestamp, row.row_id)):
            first.setdefault(row.product_fingerprint, row.row_id)
        marks = {row.row_id: row.m for row in asked.select("row_id", fingerprint("description").alias("m")).collect()}
        assert got == {key: first.get(mark) if mark else None for key, mark in marks.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def ledger(spark, *rows):
    return spark.createDataFrame(
        [(row_id, flag, "", None, "", "", "desc " + row_id, "1", "10") for row_id, flag in rows],
        "row_id string, senior_reviewed string, senior_user string, senior_timestamp timestamp_ntz, senior_verdict string, "
        "senior_comment string, description string, cn_code string, taric_code string",
    )


def test_last_review_wins(spark):
    history = ledger(spark, ("a", "no"), ("b", "no"), ("c", "yes"))
    written = spark.createDataFrame(
        [("a", 1, "CONFIRMED", "eve", "first", DAY[1]), ("a", 2, "REJECTED", "bob", "last", DAY[1]),
         ("b", 1, "NEEDS_MORE_INFO", "eve", "", DAY[3]), ("b", 9, "CONFIRMED", "eve", "", DAY[2]), ("zz", 1, "CONFIRMED", "eve", "", DAY[1])],
        REVIEW,
    )
    after = {row.row_id: row for row in reviews.apply_reviews(history, written).collect()}
    assert set(after) == {"a", "b", "c"}
    assert (after["a"].senior_verdict, after["a"].senior_user, after["a"].senior_comment) == ("REJECTED", "bob", "last")
    assert (after["b"].senior_verdict, after["b"].senior_reviewed, after["b"].senior_timestamp) == ("NEEDS_MORE_INFO", "yes", DAY[3])
    assert (after["c"].senior_reviewed, after["c"].senior_verdict) == ("yes", "")
    assert reviews.apply_reviews(history, written).columns == history.columns

    promoted = sorted((row.row_id, row.senior_timestamp, row.product_fingerprint) for row in reviews.promote_confirmed(history, written).collect())
    assert promoted == [("a", DAY[1], "a desc"), ("b", DAY[2], "b desc")]


def test_promotion_uses_the_carried_fingerprint(spark):
    history = ledger(spark, ("a", "no")).withColumn("product_fingerprint", F.lit("of the whole text"))
    written = spark.createDataFrame([("a", 1, "CONFIRMED", "eve", "", DAY[1])], REVIEW)
    assert reviews.promote_confirmed(history, written).first().product_fingerprint == "of the whole text"


def test_review_states(spark):
    rows = ledger(spark, ("a", "yes"), ("b", " Yes "), ("c", "no"), ("d", None), ("e", "YES")).withColumn("outcome", F.lit("VALIDATED"))
    ids = lambda frame: sorted(row.row_id for row in frame.collect())
    assert ids(reviews.pending_reviews(rows)) == ["c", "d"]
    assert ids(report.history_filter(rows, status=report.PENDING)) == ["b", "c", "d"]
    assert ids(report.history_filter(rows, status=report.REVIEWED)) == ["a", "e"]
    native = rows.withColumn("senior_reviewed", F.col("senior_reviewed") == "yes")
    assert ids(reviews.pending_reviews(native)) == ["b", "c", "d", "e"]
    with pytest.raises(ValueError):
        report.history_filter(rows, status="open")


def test_report(spark):
    outcomes = ["VALIDATED", "PARTIALLY VALIDATED", "NOT VALIDATED", "UNKNOWN", None]
    rows = spark.createDataFrame(
        [(str(n), "u", DAY[n], outcome, "yes" if n == 0 else " Yes ", f"c{n}") for n, outcome in enumerate(outcomes)],
        "row_id string, user string, timestamp timestamp_ntz, outcome string, senior_reviewed string, validated_code string",
    )
    assert report.history_kpis(rows).first().asDict() == {"total": 5, "validated": 2, "partial": 1, "rejected": 1, "reviewed": 1}
    assert report.history_kpis(rows.drop("senior_reviewed")).first().reviewed == 0
    assert report.history_filter(rows).count() == 3
    assert report.history_filter(rows, outcomes=[]).count() == 5
    assert report.history_display(rows).columns == ["timestamp", "user", "outcome", "senior_reviewed"]
    recent = report.recent_results(rows, limit=2).orderBy("rank").collect()
    assert [(row.rank, row.code, row.outcome) for row in recent] == [(1, "c4", None), (2, "c3", "UNKNOWN")]
