import os

import pytest
from pyspark.sql import functions as F

from codeledger.functions.payload import with_payloads
from codeledger.operators import followup, requests
from codeledger.plans.pipeline import Calls, ask_questions, followup_retry, three_steps
from codeledger.plans.stub import PROMPTS, digits_of, stub_model
from codeledger.sources.answers import request_key


def inquiries(spark, n=20):
    return spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("row_id"), F.concat(F.lit("item "), "id").alias("description"), F.lit("").alias("specs")
    )


def counting(folder):
    """A factory whose function leaves one mark per call."""

    def factory():
        import uuid

        model = stub_model()

        def ask(system, text, *files):
            with open(f"{folder}/{system}-{uuid.uuid4().hex}", "w") as mark:
                mark.write(text or "")
            return model(system, text)

        return ask

    return factory


def expected(row):
    model = stub_model()
    raw1 = model("extract", f"Product description / invoice text:\n{row.description}")
    raw2 = model("classify", f"Structured product data from feature extractor:\n\n{raw1}")
    json2 = raw2[raw2.rfind("{"):]
    raw3 = model("validate", f"Product data:\n{raw1}\n\nProposed classification:\n{json2}\n\nFull reasoning:\n{raw2}")
    return raw1, raw2, raw3


@pytest.mark.parametrize("calls", [Calls(stub_model), Calls(stub_model, concurrency=4, partitions=3)])
def test_three_steps(spark, tmp_path, calls):
    answered = three_steps(inquiries(spark), PROMPTS, calls, str(tmp_path / "work")).collect()
    assert len(answered) == 20
    for row in answered:
        assert (row.raw1, row.raw2, row.raw3) == expected(row)


def test_one_call_per_step_however_often_it_is_read(spark, tmp_path):
    marks, work = tmp_path / "marks", str(tmp_path / "work")
    marks.mkdir()
    calls = Calls(counting(str(marks)))
    answered = three_steps(inquiries(spark), PROMPTS, calls, work)
    parsed = with_payloads(answered)
    parsed.filter(followup.needs_followup()).count()
    parsed.select("step1", "step2", "step3").collect()
    assert len(os.listdir(marks)) == 60
    three_steps(inquiries(spark), PROMPTS, calls, work).count()
    assert len(os.listdir(marks)) == 60


def test_files_reach_the_first_step(spark, tmp_path):
    def factory():
        return lambda system, text, files=(): f"{system} {text} " + ",".join(f["media_type"] + f["data"] for f in files)

    rows = inquiries(spark, 2).withColumns(
        {"description": F.lit(""), "files": F.expr("IF(row_id = 'r0', array(named_struct('media_type', 'image/png', 'data', 'QQ==')), NULL)")}
    )
    answered = three_steps(rows, PROMPTS, Calls(factory), str(tmp_path / "work"), files="files")
    assert {row.row_id: row.raw1 for row in answered.collect()} == {"r0": "extract None image/pngQQ==", "r1": "extract None "}


def broken(step, n=None):
    """A factory whose function has no answer at a step, or to one request in n of it."""

    def factory():
        model = stub_model()

        def ask(system, text, *files):
            if system == getattr(PROMPTS, step) and (n is None or int(digits_of(system, text)[:4]) % n == 0):
                raise RuntimeError("no answer")
            return model(system, text, *files)

        return ask

    return factory


@pytest.mark.parametrize("calls", [Calls, lambda factory: Calls(factory, concurrency=3, waves=3)])
@pytest.mark.parametrize("step", ["extract", "classify", "validate"])
def test_a_failed_call_costs_its_row_and_only_that_is_asked_again(spark, tmp_path, step, calls):
    marks, work = tmp_path / "marks", str(tmp_path / "work")
    marks.mkdir()
    first = {row.row_id: row for row in three_steps(inquiries(spark), PROMPTS, calls(broken(step, 3)), work).collect()}
    failed = {key for key, row in first.items() if row.failed}
    assert len(first) == 20 and 0 < len(failed) < 20
    assert {first[key].failed for key in failed} == {f"{step}: RuntimeError: no answer"}
    assert all(first[key].raw3 is None for key in failed)
    assert all((row.raw1, row.raw2, row.raw3) == expected(row) for key, row in first.items() if key not in failed)
    again = three_steps(inquiries(spark), PROMPTS, calls(counting(str(marks))), work).collect()
    assert len(again) == 20 and not any(row.failed for row in again)
    assert all((row.raw1, row.raw2, row.raw3) == expected(row) for row in again)
    steps = ["extract", "classify", "validate"]
    assert len(os.listdir(marks)) == len(failed) * len(steps[steps.index(step):])


def test_a_step_that_fails_altogether(spark, tmp_path):
    rows = three_steps(inquiries(spark), PROMPTS, Calls(broken("extract")), str(tmp_path / "work")).collect()
    assert len(rows) == 20 and {row.failed for row in rows} == {"extract: RuntimeError: no answer"}


def test_other_inquiries_in_the_same_folder_get_their_own_answers(spark, tmp_path):
    work = str(tmp_path / "work")
    three_steps(inquiries(spark, 3), PROMPTS, Calls(stub_model), work)
    others = inquiries(spark, 8).filter("row_id > 'r2'")
    rows = three_steps(others, PROMPTS, Calls(stub_model), work).collect()
    assert {row.row_id for row in rows} == {"r3", "r4", "r5", "r6", "r7"}
    assert all((row.raw1, row.raw2, row.raw3) == expected(row) for row in rows)


def test_equal_requests_are_called_once_over_runs_that_share_a_store(spark, tmp_path):
    marks, store = tmp_path / "marks", str(tmp_path / "store")
    marks.mkdir()
    same = inquiries(spark, 50).withColumns({"description": F.lit("pump"), "row_id": F.when(F.col("row_id") != "r3", F.col("row_id"))})
    for run in ("one", "two"):
        rows = three_steps(same, PROMPTS, Calls(counting(str(marks))), str(tmp_path / run), answers=store).collect()
        assert len(rows) == 50 and all((row.raw1, row.raw2, row.raw3) == expected(row) for row in rows)
    assert len(os.listdir(marks)) == 3


def test_equal_inquiries_go_through_the_steps_once(spark, tmp_path):
    """Rows of one description and first request are one row in every step's table; each inquiry gets its answers."""
    rows = inquiries(spark, 60).withColumns({"description": F.expr("IF(row_id < 'r3', 'pump', IF(row_id < 'r5', '', NULL))"), "failed": F.expr("IF(row_id = 'r9', 'before', NULL)")})
    answered = three_steps(rows, PROMPTS, Calls(stub_model), str(tmp_path / "work"))
    [made] = [tmp_path / "work" / name for name in os.listdir(tmp_path / "work") if name.startswith("steps-")]
    assert [spark.read.parquet(str(made / step)).count() for step in ("cases", "extract", "classify", "validate")] == [3] * 4
    by_id = {row.row_id: row for row in answered.collect()}
    assert len(by_id) == 60 and answered.columns == ["row_id", "description", "specs", "failed", "raw1", "raw2", "raw3"]
    assert (by_id["r9"].failed, by_id["r9"].raw1) == ("before", None)
    assert all((row.raw1, row.raw2, row.raw3) == expected(row) for row in by_id.values() if row.description)
    blank = {(row.raw1, row.raw2, row.raw3) for row in by_id.values() if not row.description and row.row_id != "r9"}
    assert len(blank) == 1 and None not in blank.pop()


def test_requests_are_made_for_cases_and_inquiries_join_by_digest(spark, tmp_path):
    """What an inquiry is given its answers by is 32 bytes, and no request text is made again where they are joined."""
    rows = inquiries(spark, 40).withColumns({
        "description": F.expr("CASE WHEN row_id < 'r2' THEN 'pump' WHEN row_id < 'r3' THEN '' ELSE 'valve' END"),
        "specs": F.expr("CASE WHEN row_id < 'r15' THEN 'DN 40' WHEN row_id < 'r35' THEN '' WHEN row_id < 'r8' THEN NULL ELSE ' DN 40' END"),
        "failed": F.expr("IF(row_id = 'r9', 'before', NULL)"),
    })
    answered = three_steps(rows.unionByName(rows.filter("row_id = 'r1'")), PROMPTS, Calls(stub_model), str(tmp_path / "work"))
    assert "Product description" not in answered._jdf.queryExecution().optimizedPlan().toString()
    [made] = [tmp_path / "work" / name for name in os.listdir(tmp_path / "work") if name.startswith("steps-")]
    cases = spark.read.parquet(str(made / "cases"))
    given = {(row.description, row.specs) for row in rows.filter("failed IS NULL").collect()}
    assert cases.count() == len(given) and {len(row._case) for row in cases.collect()} == {32}
    model, by_id = stub_model(), {}
    for row in answered.collect():
        by_id.setdefault(row.row_id, []).append(row)
        if row.row_id != "r9":
            sections = [("Product description / invoice text:\n", row.description), ("Technical specifications:\n", row.specs)]
            request = "\n\n".join(label + text for label, text in sections if text).strip() or None
            assert row.raw1 == model("extract", request) and row.raw3 and row.failed is None
    assert len(by_id) == 40 and len(by_id["r1"]) == 2 and (by_id["r9"][0].failed, by_id["r9"][0].raw1) == ("before", None)
    calls = spark.read.parquet(str(tmp_path / "work" / "answers")).filter("step = 'extract'")
    assert calls.count() == calls.select("request_key").distinct().count()


def test_equal_attachments_reach_the_first_step_once(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    one = "array(named_struct('media_type', 'image/png', 'data', 'QQ=='))"
    rows = inquiries(spark, 9).withColumns({"description": F.lit("pump"), "files": F.expr(f"CASE WHEN row_id < 'r4' THEN {one} WHEN row_id < 'r6' THEN filter({one}, file -> false) END")})
    answered = three_steps(rows, PROMPTS, Calls(counting(str(marks))), str(tmp_path / "work"), files="files")
    assert len(answered.collect()) == 9 and "files" not in answered.columns
    assert sorted(name.split("-")[0] for name in os.listdir(marks)) == ["classify", "extract", "extract", "validate"]


def test_keys_tell_requests_apart(spark):
    files = "array<struct<media_type string, data string>>"
    rows = spark.createDataFrame([("a", None), ("a", []), ("a", [("x", "y")]), ("a", [("xy", "")]), ("a", [("x", None)]), (None, None), ("", None)], f"text string, files {files}")
    keys = [row.key for row in rows.select(request_key("s", "p", F.col("text"), F.col("files")).alias("key")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 6
    plain = rows.limit(1).select(request_key("s", "p", F.col("text")), request_key("sp", "", F.col("text")), request_key("s", "q", F.col("text"))).first()
    assert len(set(plain)) == 3


def test_no_inquiries(spark, tmp_path):
    assert three_steps(inquiries(spark).limit(0), PROMPTS, Calls(stub_model), str(tmp_path / "work")).collect() == []


def test_retry(spark, tmp_path):
    none, some = '{"cn_code": ""}', '{"cn_code": "01020304", "confidence": "MEDIUM"}'
    cases = spark.createDataFrame(
        [("a", "pump", "", "-", none, "-"), ("b", "pump", "", "-", none, "-"), ("c", "pump", "", "-", some, "-"),
         ("d", "pump", "", "-", None, "-"), ("e", "pump", "", "-", some, "-")],
        "row_id string, description string, specs string, raw1 string, raw2 string, raw3 string",
    )
    answers = spark.createDataFrame(
        [("a", 2, "Y?", "y"), ("a", 1, "X?", "x"), ("b", 1, "X?", " "), ("c", 1, "X?", "x")],
        "row_id string, pos int, question string, answer string",
    )
    marks = tmp_path / "marks"
    marks.mkdir()
    calls = Calls(counting(str(marks)))
    rows = {row.row_id: row for row in followup_retry(cases, answers, PROMPTS, calls, str(tmp_path / "one")).collect()}
    assert {key: row["round"] for key, row in rows.items()} == {"a": 2, "b": 1, "c": 1, "d": 1, "e": 1}
    assert rows["c"].raw2 == some and rows["d"].raw2 is None
    assert [tuple(pair) for pair in rows["a"].qa] == [("X?", "x"), ("Y?", "y")]
    [request] = [(marks / name).read_text() for name in os.listdir(marks) if name.startswith("extract")]
    assert request == (
        "Product description / invoice text:\npump\n\nAdditional information provided by the user:\n- X?: x\n- Y?: y"
    )
    wider = followup_retry(
        cases, answers, PROMPTS, Calls(stub_model), str(tmp_path / "two"),
        eligible=lambda parsed: followup.needs_followup() | followup.offer_improvement(F.lit(True)),
    )
    assert {row.row_id for row in wider.filter("round = 2").collect()} == {"a", "c"}


def test_questions_are_asked_and_read(spark, tmp_path):
    cases = inquiries(spark, 3).withColumns({"raw1": F.lit("-"), "raw2": F.lit("-"), "raw3": F.lit("-")})
    parsed = with_payloads(cases)
    asked = ask_questions(parsed, requests.question_text(parsed), PROMPTS, Calls(stub_model), str(tmp_path / "ask"))
    rows = followup.question_rows(asked).collect()
    assert len(rows) == 3 and all(row.question.startswith("What about ") for row in rows)
