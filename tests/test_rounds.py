from datetime import datetime

from pyspark.sql import functions as F

from codeledger.plans.fixtures import FILE_OF, spark_fixture
from codeledger.plans.pipeline import Calls
from codeledger.plans.rounds import ask_round, classification_round, followup_round
from codeledger.plans.stub import PROMPTS, stub_model
from codeledger.sources import attachments, tables

WHEN = datetime(2024, 1, 2)
INQUIRY = "row_id string, timestamp timestamp_ntz, user string, description string, specs string, has_image boolean, has_invoice boolean"


def rows_of(spark, path):
    return {(row.row_id, row["round"]): row for row in tables.read_history(spark, str(path)).collect()}


def inquiries(spark, n=80):
    return spark.createDataFrame([(f"r{k}", WHEN, "ann" if k else " ", f"item {k}", "", False, False) for k in range(n)], INQUIRY)


def submitted(spark, *rows):
    return spark.createDataFrame(
        list(rows),
        "row_id string, verdict string, senior_user string, comment string, reviewed_at timestamp_ntz, seq long, cn_code string, taric_code string, description string",
    )


def test_rounds_end_in_the_ledger(spark, tmp_path):
    paths = {name: str(tmp_path / name) for name in ("one", "two", "three", "ledger", "reviews", "verified")}
    verified = tables.read_verified(spark, paths["verified"])
    cases = classification_round(inquiries(spark), verified, PROMPTS, Calls(stub_model), paths["one"], paths["ledger"], "first")
    assert cases.count() == 79
    logged = rows_of(spark, paths["ledger"])
    asked = ask_round(cases, PROMPTS, Calls(stub_model), paths["one"])
    waiting = {row.row_id for row in asked.collect()}
    # Everyone admitted is either logged or asked.
    assert waiting and {key for key, _ in logged} | waiting == {f"r{k}" for k in range(1, 80)} and not {key for key, _ in logged} & waiting

    silent = min(waiting)
    answers = asked.withColumn("answer", F.when(F.col("row_id") == silent, " ").otherwise("brass"))
    followup_round(cases, answers, PROMPTS, Calls(stub_model), paths["two"], paths["ledger"], "second")
    both = rows_of(spark, paths["ledger"])
    assert {key for key, turn in both if turn == 2} == waiting - {silent}
    assert all(both[key, 2].followup_qa[0].a == "brass" and both[key, 2].verified_by is None for key in waiting - {silent})
    assert {key: row for key, row in both.items() if key[1] == 1} == logged

    # A confirmed answer is noted when the same product is asked for again; with another code it isn't.
    known, other = sorted(logged)[:2]
    sent = [(row.row_id, "CONFIRMED", "eve", "", WHEN, 1, code, "", row.description) for row, code in ((logged[known], logged[known].cn_code), (logged[other], "1"))]
    tables.submit_reviews(submitted(spark, *sent), paths["reviews"], paths["verified"], "r1")
    verified = tables.read_verified(spark, paths["verified"])
    classification_round(inquiries(spark), verified, PROMPTS, Calls(stub_model), paths["three"], f"{paths['ledger']}-later", "third")
    assert {key[0]: row.verified_by for key, row in rows_of(spark, f"{paths['ledger']}-later").items() if row.verified_by} == {known[0]: "eve on 2024-01-02"}


def test_a_rerun_is_sent_its_files_again(spark, tmp_path):
    def factory():
        return lambda system, text, files=(): f"{system} {len(files)}"

    cases = inquiries(spark, 3).filter("row_id <> 'r0'").selectExpr("*", "array(named_struct('media_type', 'image/png', 'data', 'QQ==')) AS files")
    answered = classification_round(cases, tables.read_verified(spark, str(tmp_path / "none")), PROMPTS, Calls(factory), str(tmp_path / "one"), str(tmp_path / "ledger"), "first", files="files")
    assert "files" not in answered.columns and {row.raw1 for row in answered.collect()} == {"extract 1"}
    answers = spark.createDataFrame([("r1", 1, "Use?", "water")], "row_id string, pos int, question string, answer string")
    both = followup_round(answered.join(cases.select("row_id", "files"), "row_id"), answers, PROMPTS, Calls(factory), str(tmp_path / "two"), str(tmp_path / "ledger"), "second", files="files")
    assert {(row.row_id, row["round"], row.raw1) for row in both.collect()} == {("r1", 2, "extract 1"), ("r2", 1, "extract 1")} and "files" not in both.columns
    assert set(rows_of(spark, tmp_path / "ledger")) == {("r1", 2)}


def test_submitted_reviews(spark, tmp_path):
    log, verified = str(tmp_path / "log"), str(tmp_path / "verified")
    first = [("a", "CONFIRMED", "eve", "ok", WHEN, 1, "01", "0100", "Pump, steel"), ("unknown", "CONFIRMED", "eve", None, WHEN, 2, "02", None, None), ("b", "REJECTED", "eve", "no", WHEN, 3, "03", "", "x"), (None, None, None, None, None, None, None, None, None)]
    tables.submit_reviews(submitted(spark, *first), log, verified, "one")
    assert tables.read_reviews(spark, log).count() == 4
    kept = {row.row_id: row for row in tables.read_verified(spark, verified).collect()}
    assert set(kept) == {"a", "unknown"}
    assert (kept["a"].product_fingerprint, kept["a"].original_description, kept["a"].cn_code) == ("pump steel", "Pump, steel", "01")
    # The same batch again replaces itself; an empty one empties it.
    tables.submit_reviews(submitted(spark, *first[:1]), log, verified, "one")
    assert tables.read_reviews(spark, log).count() == tables.read_verified(spark, verified).count() == 1
    tables.submit_reviews(submitted(spark, *first).limit(0), log, verified, "one")
    assert tables.read_reviews(spark, log).count() == tables.read_verified(spark, verified).count() == 0


def test_the_fixture_has_inquiries_with_two_files(spark, sf_dir):
    files = attachments.accepted(spark_fixture(spark, sf_dir, "attachments")).select(F.expr(FILE_OF).alias("row_id"))
    counts = files.join(spark_fixture(spark, sf_dir, "inquiries").filter("has_image"), "row_id").groupBy("row_id").count()
    assert {row["count"] for row in counts.collect()} == {1, 2}
