"""The store of model answers, one row for each call, found again by what was asked.

A request is the step, the system prompt, the request text and the attachments; its key is a hash of
them. A call that failed is a row with its error. Rows are only ever added, a folder for each writing job,
so a lost job leaves what it had committed and nothing else.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeledger.sources.tables import read_table

ANSWERS = T.StructType(
    [
        T.StructField("request_key", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("step", T.StringType()),
        T.StructField("asked_in", T.StringType()),
    ]
)
_PARTITIONS = ("step", "asked_in")


def _part(text: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def texts_key(*names: str) -> Column:
    """A digest of text columns, as 32 bytes: narrower in a shuffle than its digits. Null is not the empty text."""
    return F.unhex(F.sha2(F.concat(*(_part(F.col(name)) for name in names)), 256))


def request_key(step: str, system: str, request: Column, files: Column | None = None) -> Column:
    """The key of a request. Every part goes in with its length, so that parts can't run into each other."""
    parts = [_part(F.lit(step)), _part(F.lit(system)), _part(request)]
    if files is not None:
        # A hash for each file: the payloads themselves need not be copied into one text.
        one = lambda file: F.concat(_part(file["media_type"]), F.sha2(F.coalesce(file["data"], F.lit("")), 256))
        hashes = F.array_join(F.transform(files, one), ",")
        parts.append(F.when(F.size(files) > 0, hashes).otherwise(""))
    return F.sha2(F.concat(*parts), 256)


def read_answers(spark: SparkSession, path: str, step: str | None = None) -> DataFrame:
    """All calls, of one step or of all."""
    rows = read_table(spark, path, ANSWERS)
    return rows if step is None else rows.filter(F.col("step") == step)


def append_answers(answers: DataFrame, path: str, step: str, batch: str) -> None:
    """Add the calls (request_key, answer, error) of one writing job; its name sorts by time."""
    rows = answers.select("request_key", "answer", "error", F.lit(step).alias("step"), F.lit(batch).alias("asked_in"))
    rows.write.mode("append").partitionBy(*_PARTITIONS).parquet(path)


def outcome(calls: DataFrame) -> DataFrame:
    """One row for each request: its first answer if a call was answered, else its last error.

    Writing jobs are named by their time, so later calls change no answer. The group limit stands below the shuffle, so a request that failed often sends one row a task.
    """
    order = [F.col("error").isNotNull(), F.when(F.col("error").isNotNull(), F.col("asked_in")).desc(), "asked_in", "answer"]
    rank = F.row_number().over(Window.partitionBy("request_key").orderBy(*order))
    return calls.withColumn("_rank", rank).filter("_rank = 1").select("request_key", "answer", "error")
