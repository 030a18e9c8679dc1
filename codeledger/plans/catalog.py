"""The registered queries: each operator on inputs derived from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeledger import schemas
from codeledger.functions.payload import extract_json, typed, usable_json, with_payloads
from codeledger.functions.text import EXCERPT_LINES, EXCERPT_WIDTH, FINGERPRINT_WORDS, fingerprint, reasoning_excerpts
from codeledger.operators import audit, decisions, followup, ledger, report, requests, reviews
from codeledger.plans.fixtures import FILE_OF, REVIEWED, spark_fixture
from codeledger.plans.pipeline import Calls, followup_retry, three_steps
from codeledger.plans.rounds import ask_round
from codeledger.plans.rounds import classification_round as first_round, followup_round as second_round
from codeledger.plans.stub import PROMPTS, flaky_model, stub_model
from codeledger.session import SETTINGS, scratch_dir, ship_package
from codeledger.sources import attachments, keyed, tables, versioned_ledger
from codeledger.sources.answers import read_answers
from codeledger.streaming.intake import start_intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LIST_SEPARATOR = " | "
# Days and months of the given tables hold too few rows for a partition of their own, and so do many buckets.
GRAIN = "year"
KEY_BUCKETS = 4


def _flat(rows: DataFrame) -> DataFrame:
    """Lists and flags as text and counts as long, so that both engines show them alike."""

    def shown(field: T.StructField):
        value = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value, LIST_SEPARATOR)
        elif isinstance(field.dataType, T.BooleanType):
            value = value.cast("string")
        elif isinstance(field.dataType, T.IntegerType):
            value = value.cast("long")
        return value.alias(field.name)

    return rows.select(*(shown(field) for field in rows.schema))


def _query(key: str) -> Callable[[Query], Query]:
    """Register a query under a key."""

    def register(run: Query) -> Query:
        def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
            for name, value in SETTINGS.items():
                spark.conf.set(name, value)
            return _flat(run(spark, sf_dir))

        QUERIES[key] = registered
        return registered

    return register


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_payloads(spark_fixture(spark, sf_dir, "cases"))


def _verified(history: DataFrame) -> DataFrame:
    """The confirmed rows of the ledger as a confirmed-answers table."""
    return history.filter(F.col("senior_verdict") == reviews.CONFIRMED).select(
        "row_id",
        fingerprint("description").alias("product_fingerprint"),
        "cn_code",
        "taric_code",
        "senior_user",
        F.col("timestamp").alias("senior_timestamp"),
        F.lit("").alias("senior_comment"),
        F.col("description").alias("original_description"),
    )


def _looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = decisions.resolve_result(_parsed(spark, sf_dir))
    found = reviews.verified_lookup(resolved, _verified(spark_fixture(spark, sf_dir, "history")))
    return found.withColumn("verified_by", reviews.verified_by())


def _new_folder(spark: SparkSession, name: str) -> str:
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")


# Sources and sinks


@_query("history_scan")
def history_scan(spark, sf_dir):
    history = spark_fixture(spark, sf_dir, "history")
    native = history.withColumn("senior_reviewed", F.lower(F.trim("senior_reviewed")) == "yes")
    path = _new_folder(spark, "history")
    tables.append_history(native, path, "import", grain=GRAIN)
    return ledger.history_text(tables.read_history(spark, path))


@_query("history_row")
def history_row(spark, sf_dir):
    resolved = decisions.resolve_result(_parsed(spark, sf_dir))
    record = ledger.history_record(resolved, row_id=ledger.request_id("row_id"), shown=audit.BRIEF)
    return ledger.history_text(record, input_width=ledger.SHOWN_INPUT, answer_width=ledger.SHOWN_ANSWER)


@_query("attachment_payload")
def attachment_payload(spark, sf_dir):
    files = spark_fixture(spark, sf_dir, "attachments").withColumn("content", F.col("html").cast("binary"))
    payloads = attachments.attachment_payload(attachments.accepted(files))
    return payloads.select("page_id", "path", "media_type", "data")


# Filters and predicates


@_query("admissible_requests")
def admissible_requests(spark, sf_dir):
    reason = requests.reject_reason()
    return spark_fixture(spark, sf_dir, "inquiries").select(
        "row_id", reason.isNull().alias("admitted"), F.coalesce(reason, F.lit("")).alias("reject_reason")
    )


@_query("pending_reviews")
def pending_reviews(spark, sf_dir):
    pending = reviews.pending_reviews(spark_fixture(spark, sf_dir, "history"))
    return pending.select("row_id", "timestamp", "user", "description", "cn_code", "outcome", "senior_reviewed")


@_query("history_filter")
def history_filter(spark, sf_dir):
    history = spark_fixture(spark, sf_dir, "history")
    pending = report.history_filter(history, status=report.PENDING)
    reviewed = report.history_filter(history, outcomes=[], status=report.REVIEWED)
    return (
        pending.withColumn("variant", F.lit("pending"))
        .unionByName(reviewed.withColumn("variant", F.lit("reviewed")))
        .select("variant", "row_id", "outcome", "senior_reviewed")
    )


@_query("history_display")
def history_display(spark, sf_dir):
    return report.history_display(report.history_filter(spark_fixture(spark, sf_dir, "history")))


@_query("needs_followup")
def needs_followup(spark, sf_dir):
    return _parsed(spark, sf_dir).select("row_id", followup.needs_followup().alias("needs_followup"))


@_query("needs_followup_strict")
def needs_followup_strict(spark, sf_dir):
    return _parsed(spark, sf_dir).select("row_id", followup.needs_followup_strict().alias("needs_followup"))


@_query("offer_improvement")
def offer_improvement(spark, sf_dir):
    resolved = decisions.resolve_result(_parsed(spark, sf_dir))
    return resolved.select(
        "row_id",
        followup.offer_improvement("manual").alias("first_round"),
        followup.offer_improvement("manual", retry=True).alias("retry_round"),
    )


@_query("answers_complete")
def answers_complete(spark, sf_dir):
    return followup.answers_complete(spark_fixture(spark, sf_dir, "answers"))


# Text, JSON and array columns


@_query("extract_json")
def extract_json_tail(spark, sf_dir):
    cases = spark_fixture(spark, sf_dir, "cases")
    return cases.select("row_id", *(extract_json(f"raw{n}").alias(f"json{n}") for n in (1, 2, 3)))



@_query("parse_steps")
def parse_steps(spark, sf_dir):
    kinds = {"step1": schemas.STEP1, "step2": schemas.STEP2, "step3": schemas.STEP3}
    fields = [F.col(step)[name].alias(f"{step}_{name}") for step, kind in kinds.items() for name in kind.fieldNames()]
    return _parsed(spark, sf_dir).select("row_id", *fields)


@_query("build_step1_input")
def build_step1_input(spark, sf_dir):
    extra = F.when(F.col("has_invoice"), F.concat(F.lit("asked by "), "user"))
    text = requests.step1_text("description", "specs", extra)
    return spark_fixture(spark, sf_dir, "inquiries").select("row_id", text.alias("request"))


@_query("build_step2_input")
def build_step2_input(spark, sf_dir):
    return _parsed(spark, sf_dir).select("row_id", requests.step2_text("json1", "raw1").alias("request"))


@_query("build_step3_input")
def build_step3_input(spark, sf_dir):
    text = requests.step3_text("description", "json1", "json2", "raw2")
    return _parsed(spark, sf_dir).select("row_id", text.alias("request"))


@_query("build_followup_input")
def build_followup_input(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    return parsed.select(
        "row_id",
        requests.question_text(parsed).alias("request"),
        requests.question_text(parsed, improve=True).alias("improve_request"),
    )


@_query("followup_questions")
def followup_questions(spark, sf_dir):
    return followup.question_rows(spark_fixture(spark, sf_dir, "followup_raw"), limit=followup.NUMBERED_QUESTIONS)


@_query("followup_context")
def followup_context(spark, sf_dir):
    collected = followup.collect_answers(spark_fixture(spark, sf_dir, "answers"))
    return collected.select(
        "row_id", followup.context_text().alias("context"), followup.qa_text().alias("followup_qa")
    )


@_query("followup_pairs")
def followup_pairs(spark, sf_dir):
    collected = followup.collect_answers(spark_fixture(spark, sf_dir, "answers"))
    return followup.pair_rows(collected.select("row_id", followup.qa_text().alias("followup_qa")))


@_query("suggest_rewrite")
def suggest_rewrite(spark, sf_dir):
    cases = spark_fixture(spark, sf_dir, "cases")
    unresolved = cases.filter(followup.needs_followup(typed(usable_json("raw2"), schemas.STEP2)))
    # Joined before parsing: what is shuffled is the texts of the unresolved inquiries only.
    answers = followup.collect_answers(spark_fixture(spark, sf_dir, "answers"))
    answered = with_payloads(unresolved.join(answers, "row_id"))
    return answered.select(
        "row_id",
        followup.rewrite_suggestion().alias("suggestion"),
        followup.missing_items(limit=followup.MISSING_ITEMS).alias("missing"),
        F.coalesce(F.array_join("step2.candidate_headings", ", "), F.lit("")).alias("candidates"),
    )


@_query("soft_warnings")
def soft_warnings(spark, sf_dir):
    return _parsed(spark, sf_dir).select("row_id", followup.soft_warnings(limit=followup.SOFT_WARNINGS).alias("warnings"))


@_query("reasoning_excerpts")
def reasoning_lines(spark, sf_dir):
    excerpts = reasoning_excerpts("raw2", EXCERPT_LINES, EXCERPT_WIDTH)
    return spark_fixture(spark, sf_dir, "resp2").select("row_id", excerpts.alias("excerpts"))


@_query("fingerprint")
def document_fingerprint(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return documents.select("doc_id", fingerprint("text", FINGERPRINT_WORDS).alias("fingerprint"))



@_query("decision_tree")
def decision_tree(spark, sf_dir):
    answers = followup.collect_answers(spark_fixture(spark, sf_dir, "answers"))
    parsed = with_payloads(spark_fixture(spark, sf_dir, "cases").join(answers, "row_id", "left"))
    return parsed.select("row_id", audit.decision_tree(parsed, qa="qa", shown=audit.BRIEF).alias("decision_tree"))


# Decision columns


@_query("resolve_result")
def resolve_result(spark, sf_dir):
    joined = decisions.join_responses(spark_fixture(spark, sf_dir, "resp2"), spark_fixture(spark, sf_dir, "resp3"))
    resolved = decisions.resolve_result(joined)
    return resolved.select("row_id", "outcome", "code", "taric", "manual", "result_issues")


@_query("verdict_label")
def verdict_label(spark, sf_dir):
    labelled = decisions.verdict_label(_looked_up(spark, sf_dir))
    return labelled.select("row_id", *(name for name in labelled.columns if name.startswith("verdict")))


@_query("outcome_symbol")
def outcome_symbol(spark, sf_dir):
    return spark_fixture(spark, sf_dir, "history").select(
        "row_id",
        "outcome",
        decisions.outcome_symbol().alias("symbol"),
        decisions.outcome_color().alias("color"),
    )


@_query("code_structure")
def code_structure(spark, sf_dir):
    checked = decisions.code_structure(spark_fixture(spark, sf_dir, "history"))
    return checked.select(
        "row_id", "heading", "cn_ok", "taric_ok", "taric_extends_cn", "structure_issue", "checked_outcome"
    )


@_query("contract_check")
def contract_check(spark, sf_dir):
    checked = decisions.contract_check(_parsed(spark, sf_dir))
    return checked.select("row_id", *(name for name in checked.columns if name.endswith("_ok")), "violations")


# Joins


@_query("verified_lookup")
def verified_lookup(spark, sf_dir):
    verified = _verified(spark_fixture(spark, sf_dir, "history"))
    found = reviews.verified_lookup(spark_fixture(spark, sf_dir, "inquiries"), verified)
    return found.select("row_id", *(name for name in found.columns if name.startswith("verified_")))


@_query("verified_by")
def verified_by(spark, sf_dir):
    return _looked_up(spark, sf_dir).select("row_id", "code", "verified_by")


# Aggregation, ordering, top-k


@_query("history_kpis")
def history_kpis(spark, sf_dir):
    return report.history_kpis(spark_fixture(spark, sf_dir, "history"))


@_query("recent_results")
def recent_results(spark, sf_dir):
    return report.recent_results(spark_fixture(spark, sf_dir, "history"), code="cn_code")


# Table mutations


@_query("apply_reviews")
def apply_reviews(spark, sf_dir):
    history = spark_fixture(spark, sf_dir, "history").withColumns(
        {"senior_timestamp": F.lit(None).cast("timestamp_ntz"), "senior_comment": F.lit("")}
    )
    updated = reviews.apply_reviews(history, spark_fixture(spark, sf_dir, "reviews"))
    return updated.select(
        "row_id", "outcome", "senior_reviewed", "senior_user", "senior_timestamp", "senior_verdict", "senior_comment"
    )


@_query("folded_history")
def folded_history(spark, sf_dir):
    folder = _new_folder(spark, "folded")
    history = spark_fixture(spark, sf_dir, "history")
    native = history.withColumn("senior_reviewed", F.lower(F.trim("senior_reviewed")) == "yes")
    tables.append_history(native, f"{folder}/history", "import", grain=GRAIN)
    tables.fold_reviews(spark, f"{folder}/history", spark_fixture(spark, sf_dir, "reviews"), f"{folder}/staging")
    return tables.read_history(spark, f"{folder}/history").select(
        "row_id", "outcome", "senior_reviewed", "senior_user", "senior_timestamp", "senior_verdict", "senior_comment"
    )


@_query("history_as_of")
def history_as_of(spark, sf_dir):
    """Three batches, the reviews folded in, small files put together: the ledger as it was after two, and as it is."""
    folder = _new_folder(spark, "versions")
    history = spark_fixture(spark, sf_dir, "history").withColumn("senior_reviewed", F.lower(F.trim("senior_reviewed")) == "yes")
    digit = F.right("row_id", F.lit(1))
    table, log = versioned_ledger.ledger(spark, f"{folder}/ledger"), versioned_ledger.review_log(spark, f"{folder}/reviews")
    for batch, digits in (("one", "012"), ("two", "3456"), ("three", "789")):
        versioned_ledger.append_history(history.filter(digit.isin(*digits)), table, batch, grain=GRAIN)
    versioned_ledger.append_reviews(spark_fixture(spark, sf_dir, "reviews"), log, "first", grain=GRAIN)
    versioned_ledger.fold_reviews(table, log)
    table.compact()
    shown = ["row_id", "outcome", "senior_reviewed", "senior_user", "senior_timestamp", "senior_verdict", "senior_comment", "ingest_batch"]
    return table.read(2).select(F.lit("two").alias("as_of"), *shown).unionByName(table.read().select(F.lit("last").alias("as_of"), *shown))


@_query("promote_confirmed")
def promote_confirmed(spark, sf_dir):
    return reviews.promote_confirmed(spark_fixture(spark, sf_dir, "history"), spark_fixture(spark, sf_dir, "reviews"))


@_query("submit_reviews")
def submit_reviews(spark, sf_dir):
    folder = _new_folder(spark, "reviews")
    history = spark_fixture(spark, sf_dir, "history")
    native = history.withColumn("senior_reviewed", F.lower(F.trim("senior_reviewed")) == "yes")
    tables.append_history(native, f"{folder}/history", "import", grain=GRAIN)
    submitted = spark_fixture(spark, sf_dir, "reviews").selectExpr("seq", "verdict", "senior_user", "comment", "reviewed_at", *REVIEWED)
    tables.submit_reviews(submitted, f"{folder}/log", f"{folder}/verified", "first")
    shown = ["row_id", "cn_code", "taric_code", "senior_user", "senior_timestamp", "senior_comment"]
    current = tables.current_history(spark, f"{folder}/history", f"{folder}/log").select(
        F.lit("ledger").alias("stored_in"), *shown, "senior_verdict", F.col("description").alias("original_description"), F.lit("").alias("product_fingerprint")
    )
    confirmed = tables.read_verified(spark, f"{folder}/verified").select(
        F.lit("verified").alias("stored_in"), *shown, F.lit("").alias("senior_verdict"), "original_description", "product_fingerprint"
    )
    return current.unionByName(confirmed)


# Pipeline and stream


@_query("three_step_pipeline")
def three_step_pipeline(spark, sf_dir):
    ship_package(spark)
    inquiries = requests.admitted(spark_fixture(spark, sf_dir, "inquiries"))
    answered = three_steps(inquiries, PROMPTS, Calls(stub_model), _new_folder(spark, "pipeline"))
    return answered.select("row_id", "raw1", "raw2", "raw3")


@_query("answer_store")
def answer_store(spark, sf_dir):
    """Inquiries that come twice, on a day when calls fail and on a better one: each request is called once over both."""
    ship_package(spark)
    folder = _new_folder(spark, "store")
    once = requests.admitted(spark_fixture(spark, sf_dir, "inquiries"))
    twice = once.unionByName(once.filter("has_image").withColumn("row_id", F.concat("row_id", F.lit("-again"))))
    # As they would be: a stored table that both days read.
    twice.write.parquet(f"{folder}/inquiries")
    inquiries = spark.read.schema(twice.schema).parquet(f"{folder}/inquiries")
    first = three_steps(inquiries, PROMPTS, Calls(flaky_model, waves=2), folder)
    failed = first.select("row_id", F.col("failed").alias("failed_first"))
    # What failed is read before the second day's calls; a table of the run keeps it.
    failed.write.parquet(f"{folder}/failed")
    second = three_steps(inquiries, PROMPTS, Calls(stub_model), folder)
    none = F.lit(None).cast("string")
    rows = second.join(spark.read.parquet(f"{folder}/failed"), "row_id").select(
        F.col("row_id").alias("name"), none.alias("step"), "failed_first", "raw1", "raw2", "raw3", F.lit(None).cast("long").alias("calls"), F.lit(None).cast("long").alias("errors")
    )
    calls = read_answers(spark, f"{folder}/answers").groupBy("step", "request_key").agg(F.count("*").alias("calls"), F.count("error").alias("errors"))
    blank = {name: none for name in ("failed_first", "raw1", "raw2", "raw3")}
    return rows.unionByName(calls.withColumnRenamed("request_key", "name").withColumns(blank))


@_query("followup_retry")
def followup_rerun(spark, sf_dir):
    ship_package(spark)
    both = followup_retry(
        spark_fixture(spark, sf_dir, "cases"),
        spark_fixture(spark, sf_dir, "answers"),
        PROMPTS,
        Calls(stub_model),
        _new_folder(spark, "retry"),
    )
    resolved = decisions.resolve_result(with_payloads(both))
    return resolved.select(
        "row_id", "round", "outcome", "code", "taric", followup.needs_followup().alias("still_insufficient")
    )



@_query("classification_round")
def classification_round(spark, sf_dir):
    ship_package(spark)
    folder = _new_folder(spark, "round")
    payloads = attachments.attachment_payload(attachments.accepted(spark_fixture(spark, sf_dir, "attachments").withColumn("content", F.col("html").cast("binary"))))
    files = attachments.by_request(payloads.select(F.expr(FILE_OF).alias("row_id"), "path", "media_type", "data"))
    inquiries = spark_fixture(spark, sf_dir, "inquiries").join(files, "row_id", "left")
    verified = _verified(spark_fixture(spark, sf_dir, "history"))
    first_round(inquiries, verified, PROMPTS, Calls(stub_model), folder, f"{folder}/history", "first", files="files", grain=GRAIN)
    return ledger.history_text(tables.read_history(spark, f"{folder}/history"), "verified_by", "product_fingerprint")


@_query("followup_round")
def followup_round(spark, sf_dir):
    ship_package(spark)
    folder = _new_folder(spark, "followup")
    cases = spark_fixture(spark, sf_dir, "cases")
    asked = ask_round(cases, PROMPTS, Calls(stub_model), folder, limit=followup.NUMBERED_QUESTIONS)
    # One in ten leaves the form blank.
    answers = asked.withColumn("answer", F.when(F.right("row_id", F.lit(1)) == "0", " ").otherwise(F.concat(F.lit("see "), "row_id")))
    second_round(cases, answers, PROMPTS, Calls(stub_model), folder, f"{folder}/history", "second", grain=GRAIN)
    return ledger.history_text(tables.read_history(spark, f"{folder}/history"), "product_fingerprint", "round")


@_query("stream_log")
def stream_log(spark, sf_dir):
    folder = _new_folder(spark, "stream")
    cases = spark_fixture(spark, sf_dir, "cases")
    tables.append_verified(_verified(spark_fixture(spark, sf_dir, "history")), f"{folder}/verified", "import")
    # First rounds; then the reruns, with cases that the sender repeats.
    answers = followup.collect_answers(spark_fixture(spark, sf_dir, "answers")).select("row_id", "qa")
    reruns = cases.join(answers, "row_id").withColumn("round", F.lit(2))
    later = reruns.unionByName(cases.filter("has_image"), allowMissingColumns=True)
    for arriving in (cases, later):
        arriving.write.mode("append").parquet(f"{folder}/source")
        start_intake(
            spark, f"{folder}/source", f"{folder}/history", f"{folder}/verified", f"{folder}/checkpoint", grain=GRAIN
        ).awaitTermination()
    logged = tables.read_history(spark, f"{folder}/history")
    return ledger.history_text(logged, "verified_by", "product_fingerprint")


@_query("stream_repeats")
def stream_repeats(spark, sf_dir):
    """All inquiries arrive, then all of them again a year and a day later: each is logged once; confirmations are looked up by bucket."""
    folder = _new_folder(spark, "repeats")
    cases = spark_fixture(spark, sf_dir, "cases")
    confirmed = keyed.confirmed_answers(spark, f"{folder}/index/confirmed", KEY_BUCKETS)
    keyed.merge_confirmed(_verified(spark_fixture(spark, sf_dir, "history")), confirmed, "import")
    for arriving in (cases, cases.withColumn("timestamp", F.expr("timestamp + INTERVAL 366 DAYS"))):
        arriving.write.mode("append").parquet(f"{folder}/source")
        start_intake(
            spark, f"{folder}/source", f"{folder}/history", f"{folder}/verified", f"{folder}/checkpoint", grain=GRAIN, index_path=f"{folder}/index", buckets=KEY_BUCKETS
        ).awaitTermination()
    logged = tables.read_history(spark, f"{folder}/history")
    return ledger.history_text(logged, "verified_by", "product_fingerprint")


@_query("confirmed_by_fingerprint")
def confirmed_by_fingerprint(spark, sf_dir):
    """Three batches of confirmations, the last digits first, one of them twice: the earliest of each fingerprint."""
    answers = _verified(spark_fixture(spark, sf_dir, "history"))
    table = keyed.confirmed_answers(spark, f"{_new_folder(spark, 'confirmed')}/table", KEY_BUCKETS)
    digit = F.right("row_id", F.lit(1))
    dealt = answers.withColumn("dealt", F.when(digit.isin(*"012"), "one").when(digit.isin(*"3456"), "two").otherwise("three"))
    for batch in ("three", "two", "one", "two"):
        keyed.merge_confirmed(dealt.filter(F.col("dealt") == batch), table, batch)
    table.compact()
    return table.table.read().select("product_fingerprint", "row_id", "cn_code", "taric_code", "senior_user", "senior_timestamp", "original_description", "ingest_batch")


# How did the inquiries end?


@_query("verdict_summary")
def verdict_summary(spark, sf_dir):
    joined = decisions.join_responses(spark_fixture(spark, sf_dir, "resp2"), spark_fixture(spark, sf_dir, "resp3"))
    labelled = decisions.verdict_label(decisions.resolve_result(joined))
    return labelled.groupBy("verdict", "verdict_label").agg(
        F.count(F.lit(1)).alias("inquiries"), F.count_if("manual").alias("manual_reviews")
    )
