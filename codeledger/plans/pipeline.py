"""The three chained model steps, and the retry with follow-up answers.

A model call is slow and paid for. Every answer goes into a store (:mod:`codeledger.sources.answers`)
under what was asked, before the next step reads it: equal requests are called once, whatever rows
they come from, and a job run again asks only what has no answer yet. So neither a re-planned
query nor a lost executor repeats a call whose answer was stored, and other inquiries get answers
of their own. A call that fails costs its own rows: they say so and go no further.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeledger.functions.payload import usable_json, with_payloads
from codeledger.operators import followup
from codeledger.operators.requests import step1_text, step2_text, step3_text
from codeledger.sources.answers import append_answers, outcome, read_answers, request_key, texts_key

# model_fn(system, text) -> answer text. With attachments: model_fn(system, text, attachments),
# attachments being a list of {"media_type": ..., "data": ...}.
ModelFn = Callable[..., str]
# Called once per task, so that a client is made where it is used.
ModelFactory = Callable[[], ModelFn]


@dataclass(frozen=True)
class Prompts:
    """The caller's system prompts."""

    extract: str
    classify: str
    validate: str
    ask: str = ""


@dataclass(frozen=True)
class Calls:
    """How the model is called.

    ``concurrency`` is the number of calls a task has under way at once, ``partitions`` the
    number of tasks per step (by default that of the shuffle). A step is done in ``waves`` jobs, each
    of which stores its answers when it ends: what a lost job loses.
    """

    factory: ModelFactory
    concurrency: int = 1
    partitions: int | None = None
    waves: int = 1


_CALLED = T.StructType([T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])


def _called(calls: Calls, system: str, with_files: bool):
    """A column function: request texts in, answers and errors out, in the same order.

    As a scalar function over batches it takes only the request through Python. An exception
    of the model function is that request's error.
    """

    def one(model: ModelFn, *request) -> tuple[str | None, str | None]:
        try:
            return model(system, *request), None
        except Exception as failed:  # whatever the caller's client raises
            return None, f"{type(failed).__name__}: {failed}"

    def ask(model: ModelFn, pool: ThreadPoolExecutor | None, *requests) -> pd.DataFrame:
        run = pool.map if pool else map
        return pd.DataFrame(list(run(lambda *request: one(model, *request), *requests)), columns=_CALLED.names, dtype=object)

    def pooled(batches, split) -> Iterator[pd.DataFrame]:
        model = calls.factory()
        if calls.concurrency == 1:
            for batch in batches:
                yield ask(model, None, *split(batch))
            return
        with ThreadPoolExecutor(calls.concurrency) as pool:
            for batch in batches:
                yield ask(model, pool, *split(batch))

    if with_files:

        def answer_files(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            files = lambda given: [] if given is None else [dict(file) for file in given]
            yield from pooled(batches, lambda batch: (batch[0], batch[1].map(files)))

        return F.pandas_udf(answer_files, _CALLED).asNondeterministic()

    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from pooled(batches, lambda batch: (batch,))

    return F.pandas_udf(answer, _CALLED).asNondeterministic()


#: Column of rows that go no further: the step whose call failed, and its error.
FAILED = "failed"


def _with_failed(rows: DataFrame) -> DataFrame:
    return rows if FAILED in rows.columns else rows.withColumn(FAILED, F.lit(None).cast("string"))


def _ask(requests: DataFrame, step: str, system: str, calls: Calls, store: str, files: str | None = None) -> None:
    """Call the model for the requests (``_key, _request``, one row each) that have no answer in the store, and store what it says."""
    spark = requests.sparkSession
    ask = _called(calls, system, files is not None)
    for wave in range(calls.waves):
        part = requests if calls.waves == 1 else requests.filter(F.pmod(F.xxhash64("_key"), F.lit(calls.waves)) == wave)
        answered = read_answers(spark, store, step).filter("error IS NULL").select(F.col("request_key").alias("_key"))
        new = part.join(answered, "_key", "left_anti")
        if calls.partitions:
            new = new.repartition(calls.partitions, "_key")
        asked = new.select(F.col("_key").alias("request_key"), (ask("_request", files) if files else ask("_request")).alias("_call"))
        append_answers(asked.select("request_key", "_call.answer", "_call.error"), store, step, f"{time.time_ns():020d}-{uuid.uuid4().hex}")


def _spread(rows: DataFrame, key: str) -> Column:
    """The key, or for rows without one a value of their own; none of these equals a digest, in hexadecimal or as bytes."""
    own = F.concat(F.lit("-"), F.xxhash64(*rows.columns).cast("string"))
    return F.coalesce(key, own.cast(rows.schema[key].dataType))


def _with_answers(rows: DataFrame, answer: str, step: str, store: str) -> DataFrame:
    """The rows with the stored answers to their ``_key``, and in ``failed`` why there is none."""
    stored = outcome(read_answers(rows.sparkSession, store, step))
    found = stored.select(F.col("request_key").alias("_key"), F.col("answer").alias(answer), F.col("error").alias("_error"))
    joined = rows.withColumn("_key", _spread(rows, "_key")).join(found, "_key", "left")
    told = F.coalesce(FAILED, F.concat(F.lit(f"{step}: "), F.col("_error")))
    return joined.withColumn(FAILED, told).drop("_key", "_error")


def model_step(rows: DataFrame, request: Column, answer: str, step: str, system: str, calls: Calls, store: str) -> DataFrame:
    """Add the column ``answer``: what the model function returns for the request text.

    Each distinct request without an answer in the store is called once, and all rows that make it get
    its answer. Rows that have failed before ask nothing; those whose request fails now get ``failed``.
    Besides the rows' own, the returned columns are the answer and ``failed``. The rows are computed twice.
    """
    rows = _with_failed(rows).withColumn("_request", request)
    rows = rows.withColumn("_key", F.when(F.col(FAILED).isNull(), request_key(step, system, F.col("_request"))))
    # Nothing but grouping columns: texts in an aggregate would be sorted.
    _ask(rows.filter(F.col(FAILED).isNull()).select("_key", "_request").distinct(), step, system, calls, store)
    return _with_answers(rows.drop("_request"), answer, step, store)


def _store(work_dir: str, answers: str | None) -> str:
    return answers or f"{work_dir}/answers"


def _written(rows: DataFrame, path: str) -> DataFrame:
    """The rows as they are now, in a table of the run. It holds nothing that can't be made again."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def three_steps(
    inquiries: DataFrame,
    prompts: Prompts,
    calls: Calls,
    work_dir: str,
    *,
    extra: str | None = None,
    files: str | None = None,
    answers: str | None = None,
) -> DataFrame:
    """Extract, classify and validate: the inquiries with ``raw1, raw2, raw3`` and ``failed``.

    ``failed`` is null, or the step whose call failed and the error: such a row has no later answers, and
    a run over it again asks what is missing. ``extra`` names a column with extra context, ``files``
    one with an array of attachment payloads, which only the first step is given and which is stored
    nowhere. ``work_dir`` is a folder of this run in shared storage; ``answers`` is the folder of the store,
    which runs may share, by default one in ``work_dir``.

    Inquiries of equal texts and attachments differ in nothing that a step is given: each such case goes through
    the steps once, in tables of the run that a step is read from only once written, and its answers are joined to
    its inquiries at the end. An inquiry itself is only told its case; requests and their keys are made for cases.
    """
    store, made = _store(work_dir, answers), f"{work_dir}/steps-{uuid.uuid4().hex}"
    rows = _with_failed(inquiries)
    kept = [name for name in rows.columns if name != files]
    request = step1_text("description", "specs", extra)
    if files:
        rows = rows.withColumn("_request", request).withColumn("_attached", F.coalesce(F.size(files) > 0, F.lit(False)))
        rows = rows.withColumn("_key", F.when(F.col(FAILED).isNull(), request_key("extract", prompts.extract, F.col("_request"), F.col(files))))
        attached = rows.filter(F.col(FAILED).isNull() & F.col("_attached")).groupBy("_key").agg(F.first("_request").alias("_request"), F.first(files).alias(files))
        # Without the payloads, so that they are not read again.
        rows = _written(rows.drop(files), f"{made}/inquiries")
        given, case = ["_key", "_request", "_attached", "description"], texts_key("_key", "description")
    else:
        given = ["description", "specs", *([extra] if extra else [])]
        case = texts_key(*given)
    # The columns as they are, so that most repeats go before anything is made of them.
    cases = rows.filter(F.col(FAILED).isNull()).select(*given).distinct().withColumn("_case", case)
    if not files:
        cases = cases.withColumn("_request", request).withColumn("_key", request_key("extract", prompts.extract, F.col("_request")))
        cases = cases.select("_case", "_key", "_request", "description")
    cases = _with_failed(_written(cases, f"{made}/cases"))
    asked = cases.select("_key", "_request")
    if files:
        bare = cases.filter("NOT _attached").select("_key", "_request").distinct()
        asked = bare.withColumn(files, F.lit(None).cast(attached.schema[files].dataType)).unionByName(attached)
    else:
        asked = asked.distinct()
    _ask(asked, "extract", prompts.extract, calls, store, files)
    first = _with_answers(cases.select("_case", "_key", "description", FAILED), "raw1", "extract", store)
    first = _written(first, f"{made}/extract")
    second = model_step(first, step2_text(usable_json("raw1"), "raw1"), "raw2", "classify", prompts.classify, calls, store)
    second = _written(second, f"{made}/classify")
    request = step3_text("description", usable_json("raw1"), usable_json("raw2"), "raw2")
    third = model_step(second, request, "raw3", "validate", prompts.validate, calls, store)
    third = _written(third.select("_case", F.col(FAILED).alias("_failed"), "raw1", "raw2", "raw3"), f"{made}/validate")
    rows = rows.withColumn("_case", F.when(F.col(FAILED).isNull(), case)).select(*kept, "_case")
    joined = rows.withColumn("_case", _spread(rows, "_case")).join(third, "_case", "left")
    return joined.withColumn(FAILED, F.coalesce(FAILED, "_failed")).select(*kept, "raw1", "raw2", "raw3")


def ask_questions(
    requests: DataFrame, request: Column, prompts: Prompts, calls: Calls, work_dir: str, *, answers: str | None = None
) -> DataFrame:
    """``row_id, raw_q``: the answer of the question step to the given request text; rows whose call failed are left out."""
    # A table of the run: what the requests are made from is parsed once.
    asked = _written(requests.select("row_id", request.alias("_asked")), f"{work_dir}/asked-{uuid.uuid4().hex}")
    answered = model_step(asked, F.col("_asked"), "raw_q", "ask", prompts.ask, calls, _store(work_dir, answers))
    return answered.filter(F.col(FAILED).isNull()).select("row_id", "raw_q")


def followup_retry(
    cases: DataFrame,
    answers: DataFrame,
    prompts: Prompts,
    calls: Calls,
    work_dir: str,
    *,
    eligible: Callable[[DataFrame], Column] | None = None,
    files: str | None = None,
    store: str | None = None,
) -> DataFrame:
    """Second round: rerun the inquiries that need it and whose answers are complete.

    All others keep their first round. Adds ``round`` (1 or 2), ``qa``, the answers of a
    rerun, and ``failed`` (:func:`three_steps`). Inquiries that failed in their first round are not rerun. ``eligible`` widens the choice, such as to inquiries offered an improvement;
    only eligible rows are shuffled to their answers. Attachments are not among the columns returned.
    """
    eligible = eligible or (lambda parsed: followup.needs_followup())
    columns = [name for name in cases.columns if name != files]
    attached = [files] if files else []
    parsed = with_payloads(_with_failed(cases))
    columns = [*columns, FAILED] if FAILED not in columns else columns
    flagged = parsed.withColumn("_eligible", eligible(parsed) & F.col(FAILED).isNull()).select(*columns, *attached, "_eligible")
    nothing = F.lit(None)

    complete = followup.collect_answers(answers).filter("complete").select("row_id", "qa")
    matched = flagged.filter("_eligible").drop("_eligible").join(complete, "row_id", "left")
    matched = _written(matched, f"{work_dir}/eligible")

    untouched = flagged.filter(~F.coalesce("_eligible", nothing.cast("boolean"), F.lit(False))).select(*columns)
    untouched = untouched.withColumn("qa", nothing.cast(matched.schema["qa"].dataType))
    unanswered = matched.filter(F.col("qa").isNull()).select(*untouched.columns)
    rerun = three_steps(
        matched.filter(F.col("qa").isNotNull())
        .drop("raw1", "raw2", "raw3")
        .withColumn("_extra", followup.context_text("qa")),
        prompts,
        calls,
        f"{work_dir}/retry",
        extra="_extra",
        files=files,
        answers=_store(work_dir, store),
    ).select(*untouched.columns)
    first_round = untouched.unionByName(unanswered).withColumn("round", F.lit(1))
    return first_round.unionByName(rerun.withColumn("round", F.lit(2)))
