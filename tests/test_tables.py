from datetime import datetime

from pyspark.sql import functions as F

from codeledger import schemas
from codeledger.operators.reviews import pending_reviews
from codeledger.sources import attachments, tables


def records(spark, *rows):
    frame = spark.createDataFrame(rows, "row_id string, timestamp timestamp_ntz, issues array<string>, senior_reviewed boolean")
    return frame.withColumn("description", F.concat(F.lit("item "), "row_id"))


ROWS = [
    ("a", datetime(2024, 1, 1, 9), ["x"], False),
    ("b", datetime(2024, 1, 1, 10), [], False),
    ("c", datetime(2024, 2, 3, 11), None, False),
]


def ids(frame):
    return sorted(row.row_id for row in frame.collect())


def test_missing_table_is_empty(spark, tmp_path):
    history = tables.read_history(spark, str(tmp_path / "none"))
    assert history.schema == schemas.HISTORY_TABLE and history.count() == 0
    assert tables.read_verified(spark, str(tmp_path / "none")).columns == schemas.VERIFIED.fieldNames()


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "history")
    tables.append_history(records(spark, *ROWS), path, "b0")
    tables.append_history(records(spark, ("d", datetime(2024, 1, 1, 12), [], False)), path, "b1")
    tables.append_history(records(spark, *ROWS), path, "b0")
    assert ids(tables.read_history(spark, path)) == ["a", "b", "c", "d"]
    assert tables.read_history(spark, path).schema["issues"].dataType.simpleString() == "array<string>"


def test_a_repeated_batch_leaves_nothing_of_itself(spark, tmp_path):
    path = str(tmp_path / "history")
    tables.append_history(records(spark, *ROWS), path, "b:0")
    tables.append_history(records(spark, ("d", datetime(2024, 1, 1, 12), [], False)), path, "b1")
    # The same row with a corrected date, and one without.
    tables.append_history(records(spark, ("a", datetime(2024, 5, 1), [], False), ("b", None, [], False)), path, "b:0")
    assert ids(tables.read_history(spark, path)) == ["a", "b", "d"]
    tables.append_history(records(spark, *ROWS).limit(0), path, "b:0")
    assert ids(tables.read_history(spark, path)) == ["d"]


def test_reviews_of_rows_without_a_time_are_folded_in(spark, tmp_path):
    history = str(tmp_path / "history")
    tables.append_history(records(spark, *ROWS, ("n", None, [], False)), history, "b0")
    tables.fold_reviews(spark, history, review(spark, ("n", "CONFIRMED", 1), ("c", "REJECTED", 1)), str(tmp_path / "staging"))
    folded = {row.row_id: row.senior_verdict for row in tables.read_history(spark, history).collect()}
    assert folded == {"a": None, "b": None, "c": "REJECTED", "n": "CONFIRMED"}


def test_periods_are_pruned(spark, tmp_path):
    path = str(tmp_path / "history")
    tables.append_history(records(spark, *ROWS), path, "b0")
    january = tables.read_history(spark, path).filter(F.col("event_period") < F.lit("2024-02-01").cast("date"))
    plan = january._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_period" in plan
    assert ids(january) == ["a", "b"]


def review(spark, *rows):
    return spark.createDataFrame(
        [(row_id, verdict, "eve", "", datetime(2024, 3, 1), seq) for row_id, verdict, seq in rows],
        "row_id string, verdict string, senior_user string, comment string, reviewed_at timestamp_ntz, seq long",
    )


def test_reviews_are_laid_over_and_folded_in(spark, tmp_path):
    history, log = str(tmp_path / "history"), str(tmp_path / "reviews")
    tables.append_history(records(spark, *ROWS), history, "b0")
    tables.append_reviews(review(spark, ("a", "CONFIRMED", 1)), log, "r0")
    tables.append_reviews(review(spark, ("a", "REJECTED", 2), ("zz", "CONFIRMED", 1)), log, "r1")
    current = {row.row_id: row.senior_verdict for row in tables.current_history(spark, history, log).collect()}
    assert current == {"a": "REJECTED", "b": None, "c": None}
    assert ids(pending_reviews(tables.current_history(spark, history, log))) == ["b", "c"]

    untouched = sorted(path.name for path in (tmp_path / "history").glob("event_period=2024-02-*/**/*.parquet"))
    tables.fold_reviews(spark, history, tables.read_reviews(spark, log), str(tmp_path / "staging"))
    folded = tables.read_history(spark, history)
    assert {row.row_id: row.senior_verdict for row in folded.collect()} == current
    assert ids(pending_reviews(folded)) == ["b", "c"]
    # Days without a review keep their files.
    assert untouched == sorted(path.name for path in (tmp_path / "history").glob("event_period=2024-02-*/**/*.parquet"))
    # Finishing again from the staged copy changes nothing.
    tables.put_in_place(spark, history, str(tmp_path / "staging"))
    assert {row.row_id: row.senior_verdict for row in tables.read_history(spark, history).collect()} == current


def test_verified_table(spark, tmp_path):
    path = str(tmp_path / "verified")
    rows = spark.createDataFrame([("a", "m", "0102")], "row_id string, product_fingerprint string, cn_code string")
    for batch in ("r0", "r1", "r1"):
        tables.append_verified(rows, path, batch)
    stored = tables.read_verified(spark, path)
    assert stored.schema == schemas.VERIFIED
    assert [row.cn_code for row in stored.collect()] == ["0102", "0102"]


def test_attachments(spark, tmp_path):
    content = bytes(range(256)) * 3
    for name in ("a.PNG", "b.pdf", "c.txt", "png", "d.x.jpeg"):
        (tmp_path / name).write_bytes(content)
    names = lambda frame: sorted(row.path.rsplit("/", 1)[-1] for row in frame.collect())
    assert names(attachments.read_attachments(spark, str(tmp_path))) == ["a.PNG", "b.pdf", "d.x.jpeg"]
    images = attachments.read_attachments(spark, str(tmp_path), attachments.IMAGE_TYPES)
    assert names(images) == ["a.PNG", "d.x.jpeg"]
    from base64 import b64encode

    payload = attachments.attachment_payload(images.withColumn("mime", F.lit(""))).first()
    assert (payload.media_type, payload.data) == ("image/jpeg", b64encode(content).decode())
