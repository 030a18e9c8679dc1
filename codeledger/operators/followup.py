"""Follow-up round: when to ask, what was asked and answered, what to suggest."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeledger import schemas
from codeledger.functions.payload import typed, usable_json
from codeledger.functions.text import as_column, contains_any, first_items, is_blank, lines, strip, texts

# Words in a warning that make it critical under the strict rule.
CRITICAL_WORDS = (
    "unknown", "unspecified", "missing", "cannot distinguish",
    "insufficient", "unclear", "not provided",
)
CRITICAL_WARNINGS = 2

# Characters numbering a question line, and how many such lines the short form reads.
NUMBERING = "0123456789.-) "
NUMBERED_QUESTIONS = 6
# Characters that count as a digit although they are not decimal digits (superscripts,
# subscripts, circled, parenthesised and full-stop digits, and the two digit-only scripts).
_DIGIT = (
    r"\p{Nd}²³¹፩-፱᧚⁰⁴-⁹₀-₉"
    r"①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿"
    r"❶-❾➀-➈➊-➒"
)

# Answers that say nothing.
EMPTY_ANSWERS = ("no clue", "unknown", "?", "", "n/a")
# How many details and missing items the short forms list.
SOFT_WARNINGS = 5
MISSING_ITEMS = 6

PAIR_SEPARATOR = " | "


def _confidence(step2: Column) -> Column:
    return F.upper(F.coalesce(step2.confidence, F.lit("")))


def needs_followup(step2: Column | str = "step2") -> Column:
    """No usable classification, or one without a code.

    The code of an absent payload is null, so one look at it answers both; as a filter this
    is pushed down to the answers, where every mention of the payload is a parse.
    """
    return is_blank(as_column(step2).cn_code)


def needs_followup_strict(step2: Column | str = "step2") -> Column:
    """Also on low confidence, or when two warnings are critical."""
    step2 = as_column(step2)
    critical = F.filter(texts(step2.warnings), lambda warning: contains_any(warning, CRITICAL_WORDS))
    return needs_followup(step2) | (_confidence(step2) == "LOW") | (F.size(critical) >= CRITICAL_WARNINGS)


def offer_improvement(manual: Column | str, step2: Column | str = "step2", *, retry: bool = False) -> Column:
    """Offer more questions for a found code of medium confidence.

    After the first round only if a manual review was recommended, after a retry always.
    """
    step2 = as_column(step2)
    offered = ~needs_followup(step2) & (_confidence(step2) == "MEDIUM")
    return offered if retry else offered & F.coalesce(as_column(manual), F.lit(False))


def soft_warnings(step2: Column | str = "step2", step3: Column | str = "step3", limit: int | None = None) -> Column:
    """What would make a found code more precise: the first ``limit`` details, or all."""
    step2, step3 = as_column(step2), as_column(step3)
    doubts = F.when(_confidence(step2).isin("LOW", "MEDIUM"), texts(step2.warnings)).otherwise(texts(F.lit(None)))
    details = first_items(F.concat(doubts, texts(step3.missing_data)), limit)
    return F.when(needs_followup(step2), texts(F.lit(None))).otherwise(details)


def questions(raw: Column | str, limit: int | None = None) -> Column:
    """The questions of an answer text: its payload's list, else its numbered lines (the first ``limit``, or all)."""
    raw = as_column(raw)
    listed = texts(typed(usable_json(raw), schemas.QUESTIONS).questions)
    numbered = F.filter(F.transform(lines(raw), strip), lambda line: line.rlike(rf"\A[{_DIGIT}]"))
    bare = F.transform(numbered, lambda line: strip(F.ltrim(line, F.lit(NUMBERING))))
    return F.when(F.size(listed) > 0, listed).otherwise(texts(first_items(bare, limit)))


def question_rows(asked: DataFrame, raw: str = "raw_q", limit: int | None = None) -> DataFrame:
    """One row per question: ``row_id, pos, question``, counted from 1."""
    exploded = asked.select("row_id", F.posexplode(questions(raw, limit)).alias("pos", "question"))
    return exploded.withColumn("pos", F.col("pos") + 1)


def answers_complete(answers: DataFrame) -> DataFrame:
    """``row_id, complete``: is every answer of the request non-blank?

    A question asked twice counts by its last answer, as in :func:`collect_answers`.
    """
    last = answers.groupBy("row_id", "question").agg(F.max_by(~is_blank("answer"), "pos").alias("answered"))
    return last.groupBy("row_id").agg(F.every("answered").alias("complete"))


def collect_answers(answers: DataFrame) -> DataFrame:
    """``row_id, complete, qa``: the answers of a request in question order, on one row.

    The list is the request's own form data and ends up in one text cell, so its length is
    that of one form. A question asked twice keeps its first place and its last answer.
    """
    entry = F.struct("pos", F.col("question").alias("q"), F.coalesce("answer", F.lit("")).alias("a"))
    grouped = answers.groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("_rows"))

    def last_answer(question: Column) -> Column:
        same = F.filter("_rows", lambda row: row.q.eqNullSafe(question))
        return F.element_at(same, -1).a

    pairs = F.transform(
        F.array_distinct(F.col("_rows.q")),
        lambda question: F.struct(question.alias("q"), last_answer(question).alias("a")),
    )
    collected = grouped.select("row_id", pairs.cast(schemas.QA_PAIRS).alias("qa"))
    return collected.withColumn("complete", F.forall("qa", lambda pair: ~is_blank(pair.a)))


def context_text(qa: Column | str = "qa") -> Column:
    """Answers as the extra context of a retry: one ``- question: answer`` line each."""
    item = lambda pair: F.concat(F.lit("- "), pair.q, F.lit(": "), pair.a)
    return F.array_join(F.transform(as_column(qa), item), "\n")


def qa_text(qa: Column | str = "qa") -> Column:
    """Answers as the ledger stores them."""
    item = lambda pair: F.concat(F.lit("Q: "), pair.q, F.lit(" → A: "), pair.a)
    return F.array_join(F.transform(as_column(qa), item), PAIR_SEPARATOR)


def pair_rows(stored: DataFrame, text: str = "followup_qa") -> DataFrame:
    """Stored question-and-answer text, one row per pair."""
    filled = stored.filter(F.coalesce(F.col(text), F.lit("")) != "")
    exploded = filled.select("row_id", F.posexplode(F.split(text, r"\Q | \E")).alias("pos", "pair"))
    return exploded.withColumn("pos", F.col("pos") + 1)


def rewrite_suggestion(description: Column | str = "description", qa: Column | str = "qa") -> Column:
    """The description with the informative answers appended in parentheses."""
    informative = F.filter(as_column(qa), lambda pair: ~F.lower(strip(pair.a)).isin(*EMPTY_ANSWERS))

    def known(pair: Column) -> Column:
        before_dash = F.substring_index(F.substring_index(pair.q, "—", 1), "-", 1)
        return F.concat(strip(before_dash), F.lit(": "), pair.a)

    details = F.array_join(F.transform(informative, known), ", ")
    suffix = F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")")))
    return F.concat(strip(F.coalesce(as_column(description), F.lit(""))), F.coalesce(suffix, F.lit("")))


def missing_items(step1: Column | str = "step1", step3: Column | str = "step3", limit: int | None = None) -> Column:
    """What the validation, else the extraction, says is missing: the first ``limit`` items, or all."""
    validated, extracted = texts(as_column(step3).missing_data), texts(as_column(step1).missing_information)
    return first_items(F.when(F.size(validated) > 0, validated).otherwise(extracted), limit)
