from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeledger.sources import versioned_ledger as ledgers
from codeledger.sources.versions import Conflict, File, _packed


def records(spark, *ids, month=1):
    rows = [(key, None if key == "n" else datetime(2024, month, 1 + k % 28)) for k, key in enumerate(ids)]
    frame = spark.createDataFrame(rows, "row_id string, timestamp timestamp_ntz")
    return frame.withColumns({"description": F.concat(F.lit("item "), "row_id"), "issues": F.array("row_id"), "ingest_batch": F.lit("clash")})


def reviews(spark, *rows):
    return spark.createDataFrame(
        [(key, verdict, "eve", None, datetime(2024, 3, 1), seq) for key, verdict, seq in rows],
        "row_id string, verdict string, senior_user string, comment string, reviewed_at timestamp_ntz, seq long",
    )


def ids(frame):
    return sorted(row.row_id or "" for row in frame.select("row_id").collect())


@pytest.fixture
def table(spark, tmp_path):
    return ledgers.ledger(spark, str(tmp_path / "the ledger"))


def test_versions_stay_as_they_were(spark, table):
    assert table.latest() == 0 and table.read().count() == 0 and table.read().schema == table.schema
    assert ledgers.append_history(records(spark, "a", "b", "n"), table, "one") == 1
    first = table.read()
    assert ledgers.append_history(records(spark, "c", month=2), table, "two") == 2
    assert ids(table.read(1)) == ids(first) == ["a", "b", "n"] and ids(table.read()) == ["a", "b", "c", "n"]
    row = table.read().filter("row_id = 'a'").first()
    assert (row.description, row.issues, row.ingest_batch, str(row.event_period)) == ("item a", ["a"], "one", "2024-01-01")
    assert table.read().schema == table.schema
    assert {row.event_period for row in table.read().filter("row_id = 'n'").collect()} == {None}


def test_periods_bound_the_listing(spark, table, monkeypatch):
    for month in range(1, 5):
        ledgers.append_history(records(spark, f"a{month}", f"b{month}", month=month), table, f"m{month}", grain="month")
    read = []
    monkeypatch.setattr(type(table.folder), "read", lambda self, name, real=type(table.folder).read: read.append(name) or real(self, name))
    assert ids(table.read(periods=lambda period: "2024-02" <= period < "2024-04")) == ["a2", "a3", "b2", "b3"]
    assert sum(name.startswith("parts/") for name in read) == 2


def test_a_repeated_batch_replaces_itself_even_after_compaction(spark, table):
    ledgers.append_history(records(spark, "a", "b"), table, "one", grain="year")
    ledgers.append_history(records(spark, "c"), table, "two", grain="year")
    table.compact()
    assert len(table.files()) == 1 and table.files()[0].batches == ("one", "two")
    ledgers.append_history(records(spark, "b", "d", month=5), table, "one", grain="year")
    assert ids(table.read()) == ["b", "c", "d"]
    ledgers.append_history(records(spark, "x").limit(0), table, "one", grain="year")
    assert ids(table.read()) == ["c"]


def test_a_lost_writer_shows_nothing(spark, table, monkeypatch):
    ledgers.append_history(records(spark, "a"), table, "one")

    def lost(*_):
        raise RuntimeError("lost")

    for name in ("publish", "write"):
        with monkeypatch.context() as patch:
            patch.setattr(table.folder, name, lost)
            with pytest.raises(RuntimeError, match="lost"):
                ledgers.append_history(records(spark, "b"), table, "two")
        assert table.versions() == [1] and ids(table.read()) == ["a"]
    ledgers.append_history(records(spark, "b"), table, "two")
    assert ids(table.read()) == ["a", "b"]
    # What the lost writers left is swept; versions before the one that is kept go, too.
    assert table.forget(2) >= 2 and table.versions() == [2] and ids(table.read()) == ["a", "b"]
    assert table.forget(2) == 0


def test_of_two_writers_on_one_version_one_is_refused(spark, table):
    ledgers.append_history(records(spark, "a"), table, "one")
    rows = table.read(1).limit(0).unionByName(records(spark, "b").drop("ingest_batch"), allowMissingColumns=True)
    other = ledgers.ledger(spark, table.path)
    assert other.commit(rows, 1) == 2
    with pytest.raises(Conflict):
        table.commit(rows, 1)
    with pytest.raises(Conflict):
        table._publish([], table.files(1), 1, "drop")
    assert table.latest() == 2 and ids(table.read()) == ["a", "b"]
    # An append does not depend on what others have added: it is tried again on the new version.
    late = iter([1])
    table.latest = lambda: next(late, 2)
    assert ledgers.append_history(records(spark, "c"), table, "two") == 3
    assert ids(other.read()) == ["a", "b", "c"]


def test_many_small_files_become_few_and_rows_stay(spark, table):
    for k in range(12):
        ledgers.append_history(records(spark, *(f"{k}-{n}" for n in range(9)), month=1 + k % 3), table, f"b{k}", grain="month")
    before = sorted(map(str, table.read().collect()))
    small = max(file.bytes for file in table.files())
    assert len(table.files()) == 12
    version = table.compact(target=2 * small)
    assert len(table.files()) == 6 and sorted(map(str, table.read().collect())) == before
    assert table.compact(target=2 * small) == version, "what is left does not fit together"
    table.compact()
    assert len(table.files()) == 3 and sorted(map(str, table.read().collect())) == before
    assert sum(file.rows for file in table.files()) == 108
    assert all(len(file.batches) == 4 for file in table.files())
    table.forget(table.latest())
    assert sorted(map(str, table.read().collect())) == before


def test_compaction_gives_way_to_a_writer(spark, table):
    ledgers.append_history(records(spark, "a"), table, "one", grain="year")
    ledgers.append_history(records(spark, "b"), table, "two", grain="year")
    ledgers.append_history(records(spark, "c"), table, "three", grain="year")
    with pytest.raises(Conflict):
        table.compact(on=2)
    assert ids(table.read()) == ["a", "b", "c"]


def test_reviews_rewrite_only_touched_files_and_leave_the_log(spark, tmp_path, table):
    log = ledgers.review_log(spark, str(tmp_path / "log"))
    for month in (1, 2, 3):
        ledgers.append_history(records(spark, f"a{month}", f"b{month}", month=month), table, f"m{month}", grain="month")
    ledgers.append_reviews(reviews(spark, ("a2", "REJECTED", 1), ("a2", "CONFIRMED", 2), ("zz", "CONFIRMED", 1), (None, "CONFIRMED", 1)), log, "r1")
    laid = sorted(map(str, ledgers.current_history(table, log).collect()))
    before = {file.path for file in table.files()}
    ledgers.fold_reviews(table, log)
    assert len(before & {file.path for file in table.files()}) == 2 and log.read().count() == 0
    assert sorted(map(str, ledgers.current_history(table, log).collect())) == laid
    assert {row.row_id: row.senior_verdict for row in table.read().collect()} == {"a1": None, "b1": None, "a2": "CONFIRMED", "b2": None, "a3": None, "b3": None}
    # Nothing left to fold: the ledger's version stays.
    assert ledgers.fold_reviews(table, log) == table.latest()


def test_reviews_that_arrive_while_others_are_folded_stay(spark, tmp_path, table, monkeypatch):
    log = ledgers.review_log(spark, str(tmp_path / "log"))
    ledgers.append_history(records(spark, "a", "b"), table, "one")
    ledgers.append_reviews(reviews(spark, ("a", "CONFIRMED", 1)), log, "r1")
    real = table.update

    def late(*args, **options):
        ledgers.append_reviews(reviews(spark, ("b", "REJECTED", 1)), log, "r2")
        return real(*args, **options)

    monkeypatch.setattr(table, "update", late)
    ledgers.fold_reviews(table, log)
    assert ids(log.read()) == ["b"] and ids(table.read().filter("senior_verdict = 'CONFIRMED'")) == ["a"]


def test_bins_are_filled_and_none_is_dropped():
    files = [File(f"f{k}", "p", ("b",), 1, size) for k, size in enumerate([90, 60, 50, 40, 30, 10, 120, 5])]
    bins = _packed(files, 100)
    assert all(sum(file.bytes for file in held) <= 100 and len(held) > 1 for held in bins)
    assert sorted(file.path for held in bins for file in held) == ["f0", "f1", "f2", "f3", "f4", "f5", "f7"]
