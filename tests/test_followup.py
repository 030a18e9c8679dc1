from pyspark.sql import functions as F

from codeledger import schemas
from codeledger.functions.payload import with_payloads
from codeledger.operators import followup, requests


def parsed(spark, *rows):
    """Frame with payloads from (raw1, raw2, raw3) texts."""
    data = [(str(n), "pump", "", *row) for n, row in enumerate(rows)]
    return with_payloads(
        spark.createDataFrame(data, "row_id string, description string, specs string, raw1 string, raw2 string, raw3 string")
    )


def column(frame, value):
    return [row.v for row in frame.select("row_id", value.alias("v")).orderBy("row_id").collect()]


STEP2 = [
    None,
    "no object",
    "{}",
    '{"cn_code": " \\u2003"}',
    '{"cn_code": "84137080", "confidence": "low", "warnings": ["a"]}',
    '{"cn_code": "84137080", "confidence": "Medium", "warnings": ["Material UNKNOWN", "size not provided", "c"]}',
    '{"cn_code": "84137080", "confidence": "MEDIUM", "warnings": ["unclear use", "fine"]}',
    '{"confidence": "MEDIUM"}',
]


def test_needs_followup(spark):
    frame = parsed(spark, *((None, raw, None) for raw in STEP2))
    assert column(frame, followup.needs_followup()) == [True, True, True, True, False, False, False, True]
    assert column(frame, followup.needs_followup_strict()) == [True, True, True, True, True, True, False, True]


def test_offer_improvement(spark):
    frame = parsed(spark, *((None, raw, None) for raw in STEP2))
    retry = column(frame, followup.offer_improvement(F.lit(False), retry=True))
    assert retry == [False, False, False, False, False, True, True, False]
    assert column(frame, followup.offer_improvement(F.lit(True))) == retry
    assert not any(column(frame, followup.offer_improvement(F.lit(None).cast("boolean"))))


def test_soft_warnings(spark):
    missing = '{"missing_data": ["m1", "m2", "m3", "m4"]}'
    frame = parsed(
        spark,
        (None, '{"cn_code": "1", "confidence": "HIGH", "warnings": ["w"]}', missing),
        (None, '{"cn_code": "1", "confidence": "medium", "warnings": ["w1", "w2"]}', missing),
        (None, '{"cn_code": "", "confidence": "LOW", "warnings": ["w"]}', missing),
        (None, '{"cn_code": "1", "confidence": "LOW", "warnings": null}', None),
    )
    assert column(frame, followup.soft_warnings(limit=followup.SOFT_WARNINGS)) == [
        ["m1", "m2", "m3", "m4"], ["w1", "w2", "m1", "m2", "m3"], [], []
    ]
    assert column(frame, followup.soft_warnings())[1] == ["w1", "w2", "m1", "m2", "m3", "m4"]


def test_questions(each):
    texts = [
        '{"questions": ["A?", "B?"]}',
        '1. ignored\n{"questions": ["A?"]}',
        '{"questions": []}\n1. not one value',
        "Intro\n1. First?\n  2) - Second?\n²) odd\nthen 3\n\u00a04.\n5 a\r\n6 b\n7 c",
        "nothing",
    ]
    assert each(followup.questions, texts)[3] == ["First?", "Second?", "²) odd", "", "a", "b", "c"]
    assert each(lambda raw: followup.questions(raw, followup.NUMBERED_QUESTIONS), texts) == [
        ["A?", "B?"], ["A?"], ["not one value"], ["First?", "Second?", "²) odd", "", "a", "b"], []
    ]
    assert each(followup.questions, [None]) == [[]]


def test_a_digit_is_what_unicode_calls_one(each):
    marks = [chr(code) for code in range(0x21, 0x3000) if not chr(code).isspace()]
    got = each(lambda t: F.size(followup.questions(t)) > 0, [f"{mark} x" for mark in marks])
    differ = [mark for mark, found in zip(marks, got) if found != mark.isdigit()]
    assert differ == []


def answers(spark, *rows):
    return spark.createDataFrame(rows, "row_id string, pos int, question string, answer string")


def test_answers(spark):
    given = answers(
        spark, ("a", 2, "Use?", "pipes"), ("a", 1, "What—or -?", " steel "), ("b", 1, "X?", "\u2003"), ("c", 1, "X?", None),
        ("d", 1, "X?", ""), ("d", 2, "Y?", "y"), ("d", 3, "X?", "x"),
    )
    collected = {row.row_id: row for row in followup.collect_answers(given).withColumns(
        {"context": followup.context_text(), "text": followup.qa_text()}).collect()}
    assert collected["a"].context == "- What—or -?:  steel \n- Use?: pipes"
    assert collected["a"].text == "Q: What—or -? → A:  steel  | Q: Use? → A: pipes"
    assert {key: row.complete for key, row in collected.items()} == {"a": True, "b": False, "c": False, "d": True}
    assert [tuple(pair) for pair in collected["d"].qa] == [("X?", "x"), ("Y?", "y")]
    complete = {row.row_id: row.complete for row in followup.answers_complete(given).collect()}
    assert (complete["a"], complete["b"], complete["c"]) == (True, False, False)


def test_pair_rows(spark):
    stored = spark.createDataFrame([("a", "Q: x → A: 1 | Q: y → A: 2"), ("b", ""), ("c", None)], "row_id string, followup_qa string")
    assert sorted(map(tuple, followup.pair_rows(stored).collect())) == [("a", 1, "Q: x → A: 1"), ("a", 2, "Q: y → A: 2")]


def test_rewrite_suggestion(spark):
    qa = [("Material — steel - or?", "Steel "), ("Use - what?", " N/A "), ("Size?", "?"), ("Colour", "red")]
    frame = spark.createDataFrame([("  pump \n", qa), (None, [])], schemas.T.StructType([
        schemas.T.StructField("description", schemas.T.StringType()), schemas.T.StructField("qa", schemas.QA_PAIRS)]))
    got = [row.v for row in frame.select(followup.rewrite_suggestion().alias("v")).collect()]
    assert got == ["pump (Material: Steel , Colour: red)", ""]


def test_missing_items(spark):
    many = ", ".join(f'"m{n}"' for n in range(9))
    frame = parsed(
        spark,
        ('{"missing_information": ["a"]}', None, f'{{"missing_data": [{many}]}}'),
        ('{"missing_information": ["a"]}', None, '{"missing_data": []}'),
        (None, None, None),
    )
    assert column(frame, followup.missing_items()) == [[f"m{n}" for n in range(9)], ["a"], []]
    assert column(frame, followup.missing_items(limit=followup.MISSING_ITEMS)) == [[f"m{n}" for n in range(6)], ["a"], []]


def test_requests(one, spark):
    text = lambda **row: one(lambda: requests.step1_text("d", "s", "e"), **row)
    assert text(d="pump", s="", e=None) == "Product description / invoice text:\npump"
    assert text(d=None, s="x", e="- q: a") == (
        "Technical specifications:\nx\n\nAdditional information provided by the user:\n- q: a"
    )
    assert text(d="", s=None, e="") is None
    assert one(lambda: requests.step2_text("j", "r"), j=None, r="raw").endswith(":\n\nraw")
    assert one(lambda: requests.step3_text("d", "j1", "j2", "r"), d="pump", j1=None, j2=None, r="why") == (
        "Product data:\npump\n\nProposed classification:\nwhy\n\nFull reasoning:\nwhy"
    )
    frame = parsed(spark, ('{"missing_information": ["m"]}', '{"cn_code": "1", "candidate_headings": [8413, "8414"]}', None))
    assert column(frame, requests.question_text(frame, improve=True)) == [
        'Product description: pump\n\nStep 1 extraction:\n{"missing_information": ["m"]}\n\nStep 2 warnings:\n[]\n\n'
        'Missing information:\n["m"]\n\nCurrent code: 1 (MEDIUM confidence)\n\nCandidate headings: ["8413","8414"]'
    ]


def test_admission(spark):
    rows = [("a", "x", "u", False, False), ("b", "", "", False, False), ("c", None, "u", True, False),
            ("d", " ", "\u2003", False, False), ("e", "", "u", None, None)]
    frame = spark.createDataFrame(rows, "row_id string, description string, user string, has_image boolean, has_invoice boolean")
    assert column(frame, requests.reject_reason()) == [None, requests.NO_INPUT, None, requests.NO_USER, requests.NO_INPUT]
    assert [row.row_id for row in requests.admitted(frame).collect()] == ["a", "c"]
