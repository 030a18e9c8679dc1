import gzip
import hashlib
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codeledger.llm import warc
from codeledger.llm.common import shared_folder
from codeledger.llm.sql import ORACLES

SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
URLS = [None, "", "http://a.com/x", "https://a.com/x", "HTTP://A.com:80/x?y=%20 z\n", "no scheme", "http://é.org/ü", "http://u@b.org/"]
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def by_sql(path):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS FROM '{path}'")
    return sorted(connection.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_capture_index']})").fetchall(), key=str)


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    """Null ids and urls, shared payloads, a very long one, equal rows, many captures of one url."""
    pick, rows = random.Random(3), []
    for k in range(3000):
        url = pick.choice([*URLS, f"http://h{k % 50}.com/{k}"])
        rows.append((pick.choice([None, k, k, k, -k]), url, pick.choice([None, "", "same", "é" * 10, f"page {k}", f"page\r\n\r\n{k}"])))
    rows += rows[:30] + [rows[0]] * 50 + [(5000, "http://long.com/", "x" * 5_000_000)]
    path = str(tmp_path_factory.mktemp("pages") / "rows.parquet")
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, row, strict=True)) for row in rows], SCHEMA), path)
    return path


@pytest.mark.parametrize("hot_share", [1, 10, 1_000_000])
def test_archives_read_back_as_sql_says(spark, pages, hot_share, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", hot_share)
    rows = spark.read.parquet(pages).withColumns({"place": F.lit("clash"), "sha1": F.lit("clash")}).repartition(5)
    found = warc.archive_and_read(rows).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == by_sql(pages)


def test_the_given_pages(spark, sf_dir):
    found = warc.archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == by_sql(f"{sf_dir}/pages.parquet")


def test_small_payloads_are_no_revisits_below_the_bound(spark):
    rows = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://a/", "longer"), (4, "http://b/", "longer")], "page_id long, url string, html string")
    found = {row.page_id: (row.record_type, row.refers_to) for row in warc.archive_and_read(rows, min_bytes=5).collect()}
    assert found == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_archives_are_gzip_members_of_whole_records_and_the_index_finds_each(spark, pages):
    folder = shared_folder(spark, "warc-test")
    rows = spark.read.parquet(pages)
    archives = warc.write(rows, folder)
    listed = archives.orderBy("part").collect()
    assert sum(row.captures for row in listed) == rows.count()
    assert all(a.last <= b.first for a, b in zip(listed, listed[1:], strict=False))
    for row in listed:
        data = gzip.decompress(open(f"{folder}/{row.archive}", "rb").read())
        assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC-Record-ID: ") == row.captures
        ids = [line for line in data.split(b"\r\n") if line.startswith(b"WARC-Record-ID: ")]
        assert len(set(ids)) == len(ids)
    wanted = spark.createDataFrame([("http://h7.com/7", 7), ("http://nowhere/", 1), ("http://long.com/", 5000), ("http://long.com/", 5000)], "url string, page_id long")
    found = warc.look_up(wanted, archives, folder).collect()
    assert [row.payload_bytes for row in found if row.page_id == 5000] == [5_000_000]
    assert not [row for row in found if row.page_id == 1]


def test_a_revisit_names_the_record_of_its_response():
    response = warc.record(9, "http://a/", "DIGEST", 4, b"same", None, "1970-01-01T00:00:00Z", 0)
    revisit = warc.record(3, "http://b/ c\n", "DIGEST", 4, None, 9, "1970-01-01T00:00:00Z", "0 1")
    first, http, payload = warc.parsed(response)
    other, other_http, nothing = warc.parsed(revisit)
    assert payload == b"same" and nothing == b"" and other_http["Content-Length"] == "4"
    assert other["WARC-Refers-To"] == first["WARC-Record-ID"] and other["WARC-Target-URI"] == "http://b/%20c%0A"


def test_url_keys(spark):
    urls = ["http://www.A.com:80/x?Y", "https://a.com", "no scheme", None, "http://b.org/ \n%20", "http://b.org/?q=://z"]
    rows = spark.createDataFrame(list(enumerate(urls)), "n int, url string").orderBy("n")
    assert [row.key for row in rows.select(warc.url_key(F.col("url")).alias("key")).collect()] == ["com,a,www:80)/x?Y", "com,a)", ")no%20scheme", ")", "org,b)/%20%20%2520", "org,b)/?q=://z"]


def test_places_sort_as_numbers(spark):
    ids = [None, -(2**63), -5, 0, 3, 20, 2**63 - 1]
    rows = spark.createDataFrame([(k,) for k in ids], "k long").select("k", warc.place(F.lit("u"), F.col("k")).alias("place"))
    assert [row.k for row in sorted(rows.collect(), key=lambda row: row.place)] == ids


def test_no_pages_and_digest_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_read(empty).collect() == []
    assert warc.digest_text(hashlib.sha1(b"").digest()) == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
