"""Plans: what must hold for large tables whatever the test data."""

import pytest
from pyspark.sql import functions as F

from codeledger.functions.text import fingerprint
from codeledger.operators import decisions, report, reviews
from codeledger.functions.payload import with_payloads
from codeledger.plans.fixtures import spark_fixture
from codeledger.sources import tables


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """Cases, ledger, confirmations and reviews as stored tables."""
    folder = tmp_path_factory.mktemp("stored")
    spark_fixture(spark, sf_dir, "cases").write.parquet(str(folder / "cases"))
    history = spark_fixture(spark, sf_dir, "history")
    tables.append_history(history.withColumn("senior_reviewed", F.lit(False)), str(folder / "history"), "b", grain="year")
    confirmed = history.filter("senior_verdict = 'CONFIRMED'").withColumns(
        {"product_fingerprint": fingerprint("description"), "senior_timestamp": F.col("timestamp")}
    )
    tables.append_verified(confirmed, str(folder / "verified"), "b")
    tables.append_reviews(spark_fixture(spark, sf_dir, "reviews"), str(folder / "reviews"), "b")
    return {
        "cases": spark.read.parquet(str(folder / "cases")),
        "history": tables.read_history(spark, str(folder / "history")),
        "verified": tables.read_verified(spark, str(folder / "verified")),
        "reviews": tables.read_reviews(spark, str(folder / "reviews")),
    }


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_over_cases_need_no_shuffle(stored):
    resolved = decisions.resolve_result(with_payloads(stored["cases"]))
    for frame in (decisions.verdict_label(resolved), decisions.contract_check(resolved)):
        text = plan(frame)
        assert "Exchange" not in text and "Python" not in text


def test_only_the_needed_answers_are_read(stored):
    text = plan(with_payloads(stored["cases"]).select("row_id", "step2.cn_code"))
    assert "ReadSchema: struct<row_id:string,raw2:string>" in text


def test_first_and_last_rows_are_limited_below_the_shuffle(stored, no_broadcast):
    for frame in (
        reviews.first_verified(stored["verified"]),
        reviews.latest_reviews(stored["reviews"]),
        report.recent_results(stored["history"]),
    ):
        text = plan(frame)
        assert text.count("WindowGroupLimit") == 2
        assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_answers_are_parsed_below_the_join(spark, sf_dir, no_broadcast):
    """What is shuffled is fields: no answer text is in an exchange."""
    answers = [spark_fixture(spark, sf_dir, name) for name in ("resp2", "resp3")]
    text = plan(decisions.resolve_result(decisions.join_responses(*answers)).select("row_id", "code"))
    join = text.index("SortMergeJoin")
    assert "from_json" in text[join:] and "from_json" not in text[:join]


def test_fingerprints_are_taken_of_confirmed_rows_only(stored, no_broadcast):
    bare = stored["history"].drop("product_fingerprint")
    text = plan(reviews.promote_confirmed(bare, stored["reviews"]))
    assert "array_distinct" in text[: text.index("SortMergeJoin")]
    assert "array_distinct" not in text[text.index("SortMergeJoin") :]


def test_no_broadcast_is_forced(stored, no_broadcast):
    looked_up = reviews.verified_lookup(stored["cases"], stored["verified"])
    for frame in (
        looked_up,
        reviews.apply_reviews(stored["history"], stored["reviews"]),
        reviews.promote_confirmed(stored["history"], stored["reviews"]),
    ):
        text = plan(frame)
        assert "Broadcast" not in text and "SortMergeJoin" in text


def test_small_review_logs_leave_the_ledger_unshuffled(stored):
    text = plan(reviews.apply_reviews(stored["history"], stored["reviews"]))
    join = text.index("BroadcastHashJoin")
    ledger_side = text[join : text.index("BroadcastExchange")]
    assert "hashpartitioning" not in ledger_side


def test_counts_are_combined_before_the_shuffle(stored):
    text = plan(report.history_kpis(stored["history"]))
    assert "partial_count" in text
    assert "ReadSchema: struct<outcome:string,senior_reviewed:boolean>" in text


def test_report_filters_reach_the_files(stored):
    frame = report.history_display(report.history_filter(stored["history"]))
    assert "In(outcome, [NOT VALIDATED,PARTIALLY VALIDATED,VALIDATED])" in plan(frame)


def test_small_confirmed_tables_leave_the_inquiries_unshuffled(stored):
    text = plan(reviews.verified_lookup(stored["cases"], stored["verified"]))
    inquiry_side = text[text.index("BroadcastHashJoin") : text.index("BroadcastExchange")]
    assert "hashpartitioning" not in inquiry_side


def test_a_batch_does_not_shuffle_the_confirmed_answers(stored):
    """Only what a broadcast of the batch's fingerprints leaves of them is shuffled."""
    text = plan(reviews.relevant_verified(stored["verified"], stored["cases"]))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text
    assert "ReadSchema: struct<description:string>" in text
    confirmed_side = text[text.index("BroadcastHashJoin") : text.index("BroadcastExchange")]
    assert "hashpartitioning" not in confirmed_side
