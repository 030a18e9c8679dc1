import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from codeledger.session import local_session

    session = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{sf_dir}/{file}'")
    return connection


@pytest.fixture
def one(spark):
    """The value of a column expression over one row of strings."""

    def value(make, **row):
        frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{name}` string" for name in row))
        return frame.select(make().alias("v")).first().v

    return value


@pytest.fixture
def each(spark):
    """The values of a column expression for many texts, in order."""

    def values(make, texts):
        frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        rows = frame.select("i", make("t").alias("v")).collect()
        return [row.v for row in sorted(rows, key=lambda row: row.i)]

    return values
