from datetime import datetime

from pyspark.sql import functions as F

from codeledger import schemas
from codeledger.functions.text import fingerprint
from codeledger.operators.ledger import history_text
from codeledger.plans.fixtures import spark_fixture
from codeledger.sources import tables
from codeledger.streaming.intake import ledger_rows, log_cases, loggable, repeats, start_intake


def case(row_id, description, code="01020304", user="ann"):
    raw2 = f'{{"cn_code": "{code}"}}'
    return (row_id, datetime(2024, 1, 2), user, description, "", False, False, "-", raw2, '{"validation_outcome": "VALIDATED"}')


def write(spark, folder, *rows, schema=schemas.CASES):
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(folder))


def confirm(spark, path, description, code, batch):
    rows = spark.createDataFrame(
        [("v", code, "eve", datetime(2024, 1, 1), description)],
        "row_id string, cn_code string, senior_user string, senior_timestamp timestamp_ntz, original_description string",
    )
    tables.append_verified(rows.withColumn("product_fingerprint", fingerprint("original_description")), path, batch)


def run(spark, folder, **options):
    paths = [str(folder / name) for name in ("source", "history", "verified", "checkpoint")]
    start_intake(spark, *paths, **options).awaitTermination()
    return {row.row_id: row for row in tables.read_history(spark, paths[1]).collect()}


def test_later_confirmations_count(spark, tmp_path):
    write(spark, tmp_path / "source", case("a", "pump"), case("a", "pump"), case("b", "pump", code=""), case("c", ""), case("d", "x", user=" "))
    assert set(run(spark, tmp_path)) == {"a"}
    confirm(spark, str(tmp_path / "verified"), "PUMP", "01020304", "r0")
    write(spark, tmp_path / "source", case("e", "pump"), case("f", "Pump!", code="09"))
    logged = run(spark, tmp_path)
    assert {key: row.verified_by for key, row in logged.items()} == {"a": None, "e": "eve on 2024-01-01", "f": None}
    # Nothing new arrived: nothing changes.
    assert set(run(spark, tmp_path)) == {"a", "e", "f"}


def test_reruns_and_repeats(spark, tmp_path):
    source, asked = tmp_path / "source", [("Use?", "water")]
    open_case, untimed = case("b", "pump", code=""), ("c", None, *case("c", "pump")[2:])
    write(spark, source, case("a", "pump"), open_case, untimed, (None, *case("", "x")[1:]), (None, *case("", "y")[1:]))
    run(spark, tmp_path)
    # Repeats of what is logged, a rerun without a code, and one that found a code; each twice.
    again = [(*case("a", "pump"), None, None), (*untimed, 1, None), (*open_case, 2, asked), (*case("a", "pump"), 2, asked)]
    write(spark, source, *again, *again, schema=schemas.INTAKE)
    run(spark, tmp_path)
    write(spark, source, *again, schema=schemas.INTAKE)
    run(spark, tmp_path)
    logged = tables.read_history(spark, str(tmp_path / "history")).collect()
    shown = sorted((row.row_id or "", row.round, row.description, len(row.followup_qa)) for row in logged)
    assert shown == [("", 1, "x", 0), ("", 1, "y", 0), ("a", 1, "pump", 0), ("a", 2, "pump", 1), ("b", 2, "pump", 1), ("c", 1, "pump", 0)]


def test_texts_are_logged_whole(spark, tmp_path):
    long = "pump " * 1000
    write(spark, tmp_path / "source", (*case("a", long)[:4], "s" * 900, False, False, "-" * 900, *case("a", long)[8:]))
    row = run(spark, tmp_path)["a"]
    assert (row.description, row.specs, row.raw_step1) == (long, "s" * 900, "-" * 900)
    assert long in row.decision_tree


def test_a_replayed_batch_is_stored_once(spark, tmp_path):
    write(spark, tmp_path / "source", case("a", "pump"), case("b", "valve"))
    run(spark, tmp_path)
    # The batch was written, but its commit was lost: the checkpoint has no record of it.
    for commit in (tmp_path / "checkpoint" / "commits").iterdir():
        commit.unlink()
    assert set(run(spark, tmp_path)) == {"a", "b"}
    assert tables.read_history(spark, str(tmp_path / "history")).count() == 2


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    cases = spark_fixture(spark, sf_dir, "cases")
    cases.repartition(4, "row_id").write.parquet(str(tmp_path / "source"))
    history = spark_fixture(spark, sf_dir, "history").filter("senior_verdict = 'CONFIRMED'")
    confirmed = history.withColumns({"product_fingerprint": fingerprint("description"), "senior_timestamp": F.col("timestamp")})
    tables.append_verified(confirmed, str(tmp_path / "verified"), "r0")
    run(spark, tmp_path, max_files=2, grain="year")
    logged = tables.read_history(spark, str(tmp_path / "history"))
    assert logged.select("ingest_batch").distinct().count() == 2
    batch = ledger_rows(cases, tables.read_verified(spark, str(tmp_path / "verified")))
    shown = lambda frame: sorted(map(tuple, history_text(frame, "verified_by").na.fill("").collect()))
    assert shown(logged) == shown(batch)


def test_rounds_in_the_ledger(spark):
    rows = [(*case("a", "pump"), 1, None), (*case("b", "pump", code=""), 1, None), (*case("c", "pump", code=""), 2, [("Use?", "water")]),
            (*case("d", "pump"), 2, [("Use?", "air")])]
    schema = schemas.T.StructType(schemas.CASES.fields + [
        schemas.T.StructField("round", schemas.T.IntegerType()), schemas.T.StructField("qa", schemas.QA_PAIRS)])
    verified = spark.createDataFrame(
        [("v", "pump", "01020304", "", "eve", datetime(2024, 1, 1), "", "pump")], schemas.VERIFIED
    )
    shown = history_text(ledger_rows(spark.createDataFrame(rows, schema), verified), "verified_by")
    got = {row.row_id: (row.verified_by, row.followup_qa, "FOLLOW-UP" in row.decision_tree) for row in shown.collect()}
    assert got == {
        "a": ("eve on 2024-01-01", "", False),
        "c": (None, "Q: Use? → A: water", True),
        "d": (None, "Q: Use? → A: air", True),
    }


def test_rows_travel_as_they_came(spark, tmp_path):
    """Ledger rows are made after they are in place, and are those of the batch form; the order by time holds."""
    rows = spark.createDataFrame([case("a", "pump"), case("b", "valve"), case("c", "x", code="")], schemas.CASES)
    verified = spark.createDataFrame([("v", "pump", "01020304", "", "eve", datetime(2024, 1, 1), "", "pump")], schemas.VERIFIED)
    log_cases(loggable(rows), verified, str(tmp_path / "history"), "one")
    shown = lambda frame: sorted(map(tuple, history_text(frame, "verified_by", "product_fingerprint", "round").na.fill("").collect()))
    logged = tables.read_history(spark, str(tmp_path / "history"))
    assert shown(logged) == shown(ledger_rows(rows, verified)) and logged.count() == 2
    assert {(str(row.event_period), row.ingest_batch) for row in logged.collect()} == {("2024-01-02", "one")}


def test_what_comes_twice_is_seen(spark):
    rounds = lambda *rows: spark.createDataFrame(list(rows), "row_id string, round int")
    assert not repeats(rounds(("a", 1), ("a", 2), (None, 1), (None, 1), ("b", 1)))
    assert repeats(rounds(("a", 1), ("b", 1), ("a", 1)))
