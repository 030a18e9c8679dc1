from pyspark.sql import functions as F

from codeledger.functions.payload import with_payloads
from codeledger.operators import audit, decisions, ledger
from codeledger.operators.followup import collect_answers


def cases(spark, *rows):
    data = [(str(n), "pump", "", *row) for n, row in enumerate(rows)]
    return spark.createDataFrame(
        data, "row_id string, description string, specs string, raw1 string, raw2 string, raw3 string"
    ).withColumns(
        {"timestamp": F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"), "user": F.lit("ann"),
         "has_image": F.lit(True), "has_invoice": F.lit(None).cast("boolean")}
    )


def resolved(spark, *rows):
    return decisions.resolve_result(with_payloads(cases(spark, *rows)))


def rows_of(frame, *columns):
    return [tuple(row) for row in frame.orderBy("row_id").select(*columns).collect()]


def test_resolve_result(spark):
    two = '{"cn_code": "01020304", "taric_code": "0102030405", "manual_review_recommended": false}'
    frame = resolved(
        spark,
        (None, two, None),
        (None, two, '{"validation_outcome": "VALIDATED", "validated_code": "", "taric_code": "9", "issues": null}'),
        (None, None, '{"validated_code": "5", "manual_review_recommended": true, "issues": ["i", "j"]}'),
        (None, None, None),
    )
    assert rows_of(frame, "outcome", "code", "taric", "manual", "result_issues") == [
        ("UNKNOWN", "01020304", "0102030405", False, []),
        ("VALIDATED", "01020304", "9", False, []),
        ("UNKNOWN", "5", "", True, ["i", "j"]),
        ("UNKNOWN", "", "", False, []),
    ]


def test_verdict_label(spark):
    two = '{"cn_code": "1", "cn_description": "Pumps", "taric_description": "Pumps, other"}'
    three = '{{"validation_outcome": "{}", "taric_code": "{}", "manual_review_recommended": true, "issues": ["a", "b"]}}'
    frame = resolved(
        spark,
        (None, two, three.format("NOT VALIDATED", "1")),
        (None, two, three.format("PARTIALLY VALIDATED", "12")),
        (None, None, three.format("VALIDATED", "12")),
        (None, two, None),
        (None, two, three.format("NOT VALIDATED", "")),
    ).withColumn("verified_by", F.when(F.col("row_id") == "4", "eve on 2024-01-01"))
    shown = decisions.verdict_label(frame)
    names = ("verdict", "verdict_icon", "verdict_label", "verdict_code", "verdict_subtitle", "verdict_note", "verdict_issues")
    manual = "Manual review recommended"
    assert rows_of(shown, *names) == [
        ("invalid", "✗", "Not validated", "1", "Pumps · Pumps, other", manual, "a; b"),
        ("partial", "~", "Partially validated", "1 / 12", "Pumps · Pumps, other", manual, "a; b"),
        ("validated", "✓", "Validated", "— / 12", "", manual, "a; b"),
        ("validated", "✓", "Validated", "1", "Pumps · Pumps, other", "", ""),
        ("verified", "✓✓", "Verified by previous inquiry (eve on 2024-01-01)", "1", "Pumps · Pumps, other", "", "a; b"),
    ]


def test_outcome_symbol(each):
    outcomes = ["VALIDATED", "PARTIALLY VALIDATED", "NOT VALIDATED", "PARTIAL", "UNKNOWN", ""]
    assert each(decisions.outcome_symbol, outcomes) == ["✓", "✓", "✗", "~", "✗", "✗"]


def test_code_structure(spark):
    frame = spark.createDataFrame(
        [("0", "01020304", "0102030405", "VALIDATED"), ("1", "01020304", "01020304", "VALIDATED"),
         ("2", "0102 0304", "99020304 05", "VALIDATED"), ("3", "", None, "UNKNOWN"), ("4", "1" * 8 + "\n", "1" * 10, "VALIDATED")],
        "row_id string, cn_code string, taric_code string, outcome string",
    )
    checked = decisions.code_structure(frame)
    issue = "TARIC code incomplete - only {} digits provided, 10 required for EU import.".format
    assert rows_of(checked, "heading", "cn_ok", "taric_ok", "taric_extends_cn", "structure_issue", "checked_outcome") == [
        ("0102", True, True, True, None, "VALIDATED"),
        ("0102", True, False, True, issue(8), "NOT VALIDATED"),
        ("0102", False, False, False, None, "VALIDATED"),
        ("", False, False, False, issue(0), "NOT VALIDATED"),
        ("1111", False, True, False, None, "VALIDATED"),
    ]


def test_contract_check(spark):
    frame = with_payloads(
        cases(
            spark,
            ('{"category_hint": "food", "data_quality": "high", "is_set": false, "materials": []}',
             '{"confidence": "HIGH"}', '{"validation_outcome": "VALIDATED"}'),
            ('{"category_hint": "Food", "data_quality": "bad", "is_set": "no", "materials": "steel"}',
             '{"confidence": "LOW", "manual_review_recommended": "false"}', '{"issues": []}'),
            (None, None, None),
        )
    )
    checked = decisions.contract_check(frame)
    assert rows_of(checked, "violations") == [
        ([],),
        (["category_hint breaks the contract", "data_quality breaks the contract", "low_confidence breaks the contract",
          "outcome breaks the contract", "step1.materials has another type", "step1.is_set has another type",
          "step2.manual_review_recommended has another type"],),
        (["step1 has no payload", "step2 has no payload", "step3 has no payload"],),
    ]
    flags = ("category_hint_ok", "data_quality_ok", "confidence_ok", "low_confidence_ok", "outcome_ok")
    assert rows_of(checked, *flags) == [(True,) * 5, (False, False, True, False, False), (None,) * 5]


TREE = """CLASSIFICATION DECISION TREE
============================================================

▸ INPUT
  Description : pump

▸ FOLLOW-UP ANSWERS
  Q: Use?
  A: water

▸ STEP 1 — FEATURE EXTRACTION
  Product     : pump
  Materials   : iron, steel
  Function    : —
  Form        : —
  Category    : —
  Is part     : True
  Is set      : False
  Data quality: low
  ⚠ Missing   : size

▸ STEP 2 — CLASSIFICATION REASONING
  Candidates  : 8413, 8414
  Reasoning excerpts:
  │ Heading 8413
  │ {"cn_code": "84137080", "candidate_headings": ["8413", 8414], "warnings": ["w1", "w2"], "manual_review_recommended": tru
  → CN code   : 84137080
  → TARIC code: —
  Confidence  : —
  ⚠ Warning   : w1
  ⚠ Warning   : w2
  Manual review: YES

▸ STEP 3 — VALIDATION
  Outcome     : ✓ PARTIALLY VALIDATED
  Final code  : 84137080
  ✗ Issue     : i1
  ⚠ Missing   : m1
  Manual review: no

============================================================
  Generated : 2024-05-06 07:08:09"""

BARE = """CLASSIFICATION DECISION TREE
============================================================

▸ INPUT
  Description : pump

▸ STEP 1 — FEATURE EXTRACTION
  ⚠ Could not parse structured extraction

▸ STEP 2 — CLASSIFICATION REASONING
  ⚠ Could not parse classification JSON

▸ STEP 3 — VALIDATION
  ⚠ Could not parse validation JSON

============================================================
  Generated : 2024-05-06 07:08:09"""


def full_case(spark):
    return cases(
        spark,
        (
            '{"product_identification": "pump", "materials": ["iron", "steel"], "is_part": true, '
            '"missing_information": ["size"], "data_quality": "low"}',
            'Heading 8413\n{"cn_code": "84137080", "candidate_headings": ["8413", 8414], "warnings": ["w1", "w2"], '
            '"manual_review_recommended": true}',
            '{"validation_outcome": "PARTIALLY VALIDATED", "validated_code": "84137080", "issues": ["i1"], "missing_data": ["m1"]}',
        ),
    )


def test_decision_tree(spark):
    answers = spark.createDataFrame([("0", 1, "Use?", "water")], "row_id string, pos int, question string, answer string")
    parsed = with_payloads(full_case(spark).join(collect_answers(answers), "row_id", "left"))
    assert parsed.select(audit.decision_tree(parsed, qa="qa", shown=audit.BRIEF)).first()[0] == TREE
    bare = with_payloads(cases(spark, (None, "nothing", None)))
    assert bare.select(audit.decision_tree(bare)).first()[0] == BARE


def test_history_row(spark):
    frame = full_case(spark).withColumn("description", F.repeat(F.lit("é"), 250))
    frame = frame.withColumn("raw3", F.repeat(F.lit("z"), 600))
    record = ledger.history_record(decisions.resolve_result(with_payloads(frame)))
    whole = ledger.history_text(record).first()
    assert (whole.description, whole.raw_step3) == ("é" * 250, "z" * 600)
    row = ledger.history_text(record, input_width=ledger.SHOWN_INPUT, answer_width=ledger.SHOWN_ANSWER).first()
    assert row.description == "é" * 200
    assert (row.has_image, row.has_invoice, row.senior_reviewed, row.manual_review) == ("yes", "no", "no", "yes")
    assert row.raw_step1.startswith('{"product') and row.raw_step3 == "z" * 500
    assert (row.outcome, row.validated_code, row.timestamp) == ("UNKNOWN", "84137080", "2024-05-06 07:08:09")
    assert record.first().product_fingerprint == ""


def test_request_id(one):
    make = lambda **options: one(lambda: ledger.request_id("a", "b", **options), a="x", b="y")
    assert make() == make() and len(make()) == 32 and make(length=8) == make()[:8]
