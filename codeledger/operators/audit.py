"""The audit text of a classification."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeledger.functions.text import EXCERPT_LINES, EXCERPT_WIDTH, blank_to_null, reasoning_excerpts, shortened, texts
from codeledger.operators.decisions import outcome_symbol

_RULE = "=" * 60
_NOTHING = "—"


@dataclass(frozen=True)
class Shown:
    """How much of its parts the audit text shows; None is all."""

    text: int | None = None
    question: int | None = None
    excerpts: int | None = None
    excerpt: int | None = None


WHOLE = Shown()
# The short form of the audit text.
BRIEF = Shown(text=120, question=80, excerpts=EXCERPT_LINES, excerpt=EXCERPT_WIDTH)


def _or_dash(value: Column) -> Column:
    return F.coalesce(value, F.lit(_NOTHING))


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"  {label}: "), value)


def _line_each(label: str, values: Column) -> Column:
    return F.transform(texts(values), lambda value: _line(label, value))


def _line_joined(label: str, values: Column) -> Column:
    """One line for the whole list, or null if it is empty."""
    values = texts(values)
    return F.when(F.size(values) > 0, _line(label, F.array_join(values, ", ")))


def _yes_no(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "YES").otherwise("no")


def _true_false(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "True").otherwise("False")


def _block(step: Column, fallback: str, *parts: Column) -> Column:
    """The lines of a step as one list, or its fallback line when it has no payload."""
    return F.when(step.isNotNull(), F.concat(*parts)).otherwise(F.array(F.lit(fallback)))


def _some(*parts: Column) -> Column:
    """Single lines as a list, leaving out the null ones."""
    return F.array_compact(F.array(*parts))


# Fixed values below: the headings, labels and layout of the audit text.


def decision_tree(
    parsed: DataFrame, qa: str | None = None, timestamp: str = "timestamp", shown: Shown = WHOLE
) -> Column:
    """The audit text of a frame with payloads; ``qa`` names the follow-up answers, if any.

    The time is that of the row, so that the text is the same whenever it is made.
    """
    step1, step2, step3 = F.col("step1"), F.col("step2"), F.col("step3")
    description = F.coalesce(blank_to_null("description"), F.lit(_NOTHING))
    specs = blank_to_null("specs")

    intro = _some(
        F.lit("CLASSIFICATION DECISION TREE"),
        F.lit(_RULE),
        F.lit("\n▸ INPUT"),
        _line("Description ", shortened(description, shown.text)),
        _line("Specs       ", shortened(specs, shown.text)),
    )
    answers = F.array().cast("array<string>")
    if qa is not None:
        pairs = F.flatten(
            F.transform(
                F.col(qa),
                lambda pair: F.array(
                    _line("Q", shortened(pair.q, shown.question)), _line("A", shortened(pair.a, shown.text))
                ),
            )
        )
        answers = F.when(F.size(qa) > 0, F.concat(F.array(F.lit("\n▸ FOLLOW-UP ANSWERS")), pairs)).otherwise(answers)

    extraction = _block(
        step1,
        "  ⚠ Could not parse structured extraction",
        _some(
            _line("Product     ", _or_dash(step1.product_identification)),
            _line("Materials   ", _or_dash(blank_to_null(F.array_join(texts(step1.materials), ", ")))),
            _line("Function    ", _or_dash(step1.function)),
            _line("Form        ", _or_dash(step1.form)),
            _line("Category    ", _or_dash(step1.category_hint)),
            _line("Is part     ", _true_false(step1.is_part)),
            _line("Is set      ", _true_false(step1.is_set)),
            _line("Data quality", _or_dash(step1.data_quality)),
            _line_joined("⚠ Missing   ", step1.missing_information),
            _line_joined("⚠ Ambiguous ", step1.ambiguities),
        ),
    )

    # The heading goes with the first excerpt: the excerpts are worked out once.
    excerpt_lines = F.transform(
        reasoning_excerpts("raw2", shown.excerpts, shown.excerpt),
        lambda line, place: F.concat(F.when(place == 0, "  Reasoning excerpts:\n").otherwise(""), F.lit("  │ "), line),
    )
    reasoning = _block(
        step2,
        "  ⚠ Could not parse classification JSON",
        _some(_line_joined("Candidates  ", step2.candidate_headings)),
        texts(excerpt_lines),
        _some(
            _line("→ CN code   ", _or_dash(step2.cn_code)),
            _line("→ TARIC code", _or_dash(step2.taric_code)),
            _line("Confidence  ", _or_dash(step2.confidence)),
        ),
        _line_each("⚠ Warning   ", step2.warnings),
        _some(_line("Manual review", _yes_no(step2.manual_review_recommended))),
    )

    outcome = _or_dash(step3.validation_outcome)
    validation = _block(
        step3,
        "  ⚠ Could not parse validation JSON",
        _some(
            _line("Outcome     ", F.concat(outcome_symbol(outcome), F.lit(" "), outcome)),
            _line("Final code  ", _or_dash(step3.validated_code)),
        ),
        _line_each("✗ Issue     ", step3.issues),
        _line_each("⚠ Missing   ", step3.missing_data),
        _some(_line("Manual review", _yes_no(step3.manual_review_recommended))),
    )

    closing = _some(
        F.lit(""), F.lit(_RULE), _line("Generated ", F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss"))
    )
    return F.array_join(
        F.concat(
            intro,
            answers,
            F.array(F.lit("\n▸ STEP 1 — FEATURE EXTRACTION")),
            extraction,
            F.array(F.lit("\n▸ STEP 2 — CLASSIFICATION REASONING")),
            reasoning,
            F.array(F.lit("\n▸ STEP 3 — VALIDATION")),
            validation,
            closing,
        ),
        "\n",
    )
