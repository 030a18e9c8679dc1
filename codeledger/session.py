"""Session settings and the shared scratch folder."""

import os
import shutil
import tempfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

# Runtime SQL settings only, so that they can be applied to a session made elsewhere.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codeledger")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        # Call sites of column expressions cost more than building the expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_scratch: str | None = None


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder of this application under the cluster's shared ``spark.checkpoint.dir``.

    Only where that is unset, as in tests, a local temporary folder takes its place.
    """
    global _local_scratch
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="codeledger-")
        root = _local_scratch
    return os.path.join(root, spark.sparkContext.applicationId, name)


_shipped: SparkContext | None = None


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, from wherever the driver was started."""
    global _shipped
    if _shipped is not spark.sparkContext:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="codeledger-"), "codeledger")
        spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", root, "codeledger"))
        _shipped = spark.sparkContext
