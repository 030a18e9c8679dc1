"""Continuous intake: answered inquiries arrive as files and become ledger rows.

Each micro-batch is a batch job over operators that are also used elsewhere, so stream and
batch give the same rows. No state is kept between batches: an inquiry and its three
answers arrive on one row, and what was logged before is looked up in the ledger.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeledger import schemas
from codeledger.functions.payload import with_payloads
from codeledger.functions.text import fingerprint
from codeledger.operators.decisions import resolve_result
from codeledger.operators.followup import needs_followup
from codeledger.operators.ledger import history_record
from codeledger.operators.requests import admitted
from codeledger.operators.reviews import relevant_verified, verified_by, verified_lookup
from codeledger.sources import keyed
from codeledger.sources.tables import LEDGER_PARTITIONS, append_history, not_logged, read_history, read_verified


def _rerun(cases: DataFrame) -> Column:
    return F.coalesce(F.col("round") > 1, F.lit(False)) if "round" in cases.columns else F.lit(False)


def loggable(cases: DataFrame) -> DataFrame:
    """The admitted inquiries that go to the ledger: first rounds that need no follow-up, and all reruns."""
    parsed = with_payloads(admitted(cases))
    return parsed.filter(_rerun(cases) | ~needs_followup()).select(cases.columns)


def one_of_each(cases: DataFrame) -> DataFrame:
    """One row for each inquiry and round (``row_id, round``): the latest, of equals the first by a hash of the row.

    Rows without an id are all kept, each being an inquiry of its own.
    """
    order = [F.col("timestamp").desc_nulls_last(), F.xxhash64(*cases.columns)]
    rank = F.row_number().over(Window.partitionBy("row_id", "round").orderBy(*order))
    first = cases.filter("row_id IS NOT NULL").withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return first.unionByName(cases.filter("row_id IS NULL"))


def repeats(cases: DataFrame) -> bool:
    """Whether an inquiry comes twice in a round. Only ids and rounds are shuffled."""
    often = cases.filter("row_id IS NOT NULL").groupBy("row_id", "round").count().filter("count > 1")
    return not often.isEmpty()


def ledger_rows(cases: DataFrame, verified: DataFrame | None = None, *, one_each: bool = False) -> DataFrame:
    """Ledger rows of admitted, answered inquiries.

    A first round that needs follow-up is not logged; its rerun is, however it ended, with
    the answers given and without a note on earlier confirmations. Rows of
    :func:`codeledger.plans.pipeline.followup_retry` say which round they are of. Without
    ``verified`` no row has a note; ``one_each`` is that of the lookup.
    """
    return _records(_looked_up(loggable(cases), verified, one_each))


def log_cases(
    cases: DataFrame, verified: DataFrame | None, history_path: str, batch: str, *, grain: str = "day", one_each: bool = False
) -> None:
    """Log what is :func:`loggable` as the named batch. Rows travel as they came; ledger rows are made where they are written."""
    append_history(_looked_up(cases, verified, one_each), history_path, batch, grain=grain, expand=lambda rows: _records(rows, *LEDGER_PARTITIONS))


def _looked_up(cases: DataFrame, verified: DataFrame | None, one_each: bool) -> DataFrame:
    return cases if verified is None else verified_lookup(cases, verified, one_each=one_each)


def _records(cases: DataFrame, *also: str) -> DataFrame:
    logged = resolve_result(with_payloads(cases))
    if "verified_row_id" in cases.columns:
        logged = logged.withColumn("verified_by", F.when(~_rerun(cases), verified_by()))
    return history_record(logged, *also, qa="qa" if "qa" in cases.columns else None)


def start_intake(
    spark: SparkSession,
    source_path: str,
    history_path: str,
    verified_path: str,
    checkpoint_path: str,
    *,
    name: str = "intake",
    max_files: int | None = None,
    grain: str = "day",
    index_path: str | None = None,
    buckets: int = keyed.BUCKETS,
) -> StreamingQuery:
    """Process what has arrived and stop; run again, or on a schedule, to go on.

    Files have the columns of ``schemas.INTAKE``; without ``round`` a row is a first round. The
    confirmed answers are read anew for every batch, so later confirmations count. A batch that
    is run again after a failure replaces what it wrote before: its rows are stored under its
    name and number. ``name`` must therefore stay with its checkpoint. An inquiry that another
    batch has logged, in the same round and period, is not logged again.

    With ``index_path`` the folder has the index of logged requests (``logged``), which the stream keeps, and the
    confirmed answers by fingerprint (``confirmed``), which it reads instead of ``verified_path``
    (:mod:`codeledger.sources.keyed`). Of both a batch reads only the buckets of its own keys, and an inquiry that
    was logged under any date is not logged again. The index is written after the ledger: a batch lost in
    between is run again under its name, which replaces both. Tables that are new get ``buckets``. For a ledger
    kept without an index see ``index_history``.
    """

    def log_batch(batch: DataFrame, batch_id: int) -> None:
        session, label = batch.sparkSession, f"{name}-{batch_id}"
        rounds = batch.withColumn("round", F.coalesce("round", F.lit(1)))
        if index_path:
            log_by_index(session, rounds, label)
            return
        # Used several times below, and a stream's batch is read whole each time.
        arrived = loggable(rounds).persist()
        cases = one_of_each(arrived).persist() if repeats(arrived) else arrived
        try:
            new = not_logged(cases, read_history(session, history_path), label, grain=grain)
            verified = relevant_verified(read_verified(session, verified_path), cases)
            log_cases(new, verified, history_path, label, grain=grain)
        finally:
            cases.unpersist()
            arrived.unpersist()

    def log_by_index(session: SparkSession, rounds: DataFrame, label: str) -> None:
        index = keyed.logged_requests(session, f"{index_path}/logged", buckets)
        confirmed = keyed.confirmed_answers(session, f"{index_path}/confirmed", buckets)
        # What is logged goes by its key alone, so it is left out before any answer is parsed. A batch that is looked up is read several times.
        known = bool(index.table.files())
        rounds = rounds.persist() if known else rounds
        arrived = loggable(keyed.not_logged(rounds, index, label)).persist()
        new = one_of_each(arrived).persist() if repeats(arrived) else arrived
        try:
            wanted = new.select(fingerprint("description").alias("product_fingerprint")).distinct().persist()
            verified = keyed.relevant_confirmed(confirmed, wanted)
            log_cases(new, verified, history_path, label, grain=grain, one_each=True)
            wanted.unpersist()
            keyed.index_logged(new, index, label)
        finally:
            new.unpersist()
            arrived.unpersist()
            if known:
                rounds.unpersist()

    source = spark.readStream.schema(schemas.INTAKE)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    return (
        source.parquet(source_path)
        .writeStream.foreachBatch(log_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
