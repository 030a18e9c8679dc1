"""Decision columns over the three typed payloads of an inquiry."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeledger import schemas
from codeledger.functions import codes
from codeledger.functions.payload import as_written, with_payloads
from codeledger.functions.text import as_column, blank_to_null, texts

UNKNOWN = "UNKNOWN"
NOT_VALIDATED = "NOT VALIDATED"

# The closed value sets of the payload contract.
CATEGORY_HINTS = (
    "food", "chemical", "machine/electrical", "textile", "metal article", "plastic/rubber", "mixed/other",
)
DATA_QUALITIES = ("high", "medium", "low")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
OUTCOMES = ("VALIDATED", "PARTIALLY VALIDATED", "NOT VALIDATED")


def join_responses(step2: DataFrame, step3: DataFrame) -> DataFrame:
    """Separately stored answers of steps 2 and 3, typed, side by side; step 3 may be missing.

    Each side is parsed below the join, so that fields are shuffled and not the answer texts.
    """
    narrow = [with_payloads(rows).drop(f"raw{n}", f"json{n}") for n, rows in ((2, step2), (3, step3))]
    return narrow[0].join(narrow[1], "row_id", "left")


def resolve_result(parsed: DataFrame) -> DataFrame:
    """Add ``outcome, code, taric, manual, result_issues`` from the typed payloads.

    The validated code wins over the proposed one unless it is empty; CN and TARIC code
    are chosen independently of each other.
    """
    step2, step3 = F.col("step2"), F.col("step3")

    def first_code(validated: Column, proposed: Column) -> Column:
        return F.coalesce(blank_to_null(validated), blank_to_null(proposed), F.lit(""))

    def flag(step: Column) -> Column:
        return F.coalesce(step.manual_review_recommended, F.lit(False))

    return parsed.withColumns(
        {
            "outcome": F.coalesce(step3.validation_outcome, F.lit(UNKNOWN)),
            "code": first_code(step3.validated_code, step2.cn_code),
            "taric": first_code(step3.taric_code, step2.taric_code),
            "manual": flag(step3) | flag(step2),
            "result_issues": texts(step3.issues),
        }
    )


def _is_validated(outcome: Column) -> Column:
    return F.contains(outcome, F.lit("VALIDATED")) & ~F.contains(outcome, F.lit("NOT"))


def verdict_label(resolved: DataFrame) -> DataFrame:
    """Add the verdict shown for a resolved inquiry.

    ``verified_by`` is used if the frame has it. Every outcome that is neither rejected nor
    partial reads as validated, the unknown one too.
    """
    outcome, code, taric = F.col("outcome"), F.col("code"), F.col("taric")
    step2 = F.col("step2")
    verified_by = F.col("verified_by") if "verified_by" in resolved.columns else F.lit(None).cast("string")
    verified = F.coalesce(verified_by, F.lit("")) != ""
    rejected = F.contains(outcome, F.lit("NOT VALIDATED"))
    partial = F.contains(outcome, F.lit("PARTIAL"))

    def by_verdict(if_verified: Column, if_rejected: str, if_partial: str, otherwise: str) -> Column:
        return F.when(verified, if_verified).when(rejected, if_rejected).when(partial, if_partial).otherwise(otherwise)

    note = F.concat(F.lit("Verified by previous inquiry ("), verified_by, F.lit(")"))
    shown_code = F.concat(
        F.coalesce(blank_to_null(code), F.lit("—")),
        F.when((taric != "") & (taric != code), F.concat(F.lit(" / "), taric)).otherwise(""),
    )
    title = blank_to_null(step2.cn_description)
    subtitle = blank_to_null(step2.taric_description)
    shown_title = F.when(
        title.isNotNull(),
        F.concat(title, F.when(subtitle != title, F.concat(F.lit(" · "), subtitle)).otherwise("")),
    ).otherwise("")
    return resolved.withColumns(
        {
            # Verdict names, marks and labels.
            "verdict": by_verdict(F.lit("verified"), "invalid", "partial", "validated"),
            "verdict_icon": by_verdict(F.lit("✓✓"), "✗", "~", "✓"),
            "verdict_label": by_verdict(note, "Not validated", "Partially validated", "Validated"),
            "verdict_code": shown_code,
            "verdict_subtitle": shown_title,
            "verdict_note": F.when(F.col("manual") & ~verified, "Manual review recommended").otherwise(""),
            "verdict_issues": F.array_join("result_issues", "; "),
        }
    )


def outcome_symbol(outcome: Column | str = "outcome") -> Column:
    """The mark of an outcome in lists. Unlike the verdict, partial validation gets a tick."""
    outcome = as_column(outcome)
    return (
        F.when(_is_validated(outcome), "✓")
        .when(F.contains(outcome, F.lit("PARTIAL")), "~")
        .otherwise("✗")
    )


def outcome_color(outcome: Column | str = "outcome") -> Column:
    """The colour of an outcome in lists, by the same rule as its mark."""
    # The three colours.
    symbol = outcome_symbol(outcome)
    return F.when(symbol == "✓", "#4a9e4a").when(symbol == "~", "#c8880a").otherwise("#c84a4a")


def code_structure(
    rows: DataFrame, cn_code: str = "cn_code", taric_code: str = "taric_code", outcome: str = "outcome"
) -> DataFrame:
    """Add digit checks of both codes; a short TARIC code forces the outcome down."""
    return rows.withColumns(
        {
            "heading": codes.heading(cn_code),
            "cn_ok": codes.cn_ok(cn_code),
            "taric_ok": codes.taric_ok(taric_code),
            "taric_extends_cn": codes.taric_extends_cn(cn_code, taric_code),
            "structure_issue": codes.short_taric_issue(taric_code),
            "checked_outcome": F.when(codes.taric_short(taric_code), NOT_VALIDATED).otherwise(F.col(outcome)),
        }
    )


def _typed_fields(schema: T.StructType) -> list[str]:
    """Fields promised as something else than text."""
    return [field.name for field in schema if field.dataType != T.StringType()]


def _mistyped(step: str, written: Column, schema: T.StructType) -> Column:
    """Names of the fields whose value is there but of another type than promised."""
    read = F.col(step)
    names = [
        F.when(written[name].isNotNull() & read[name].isNull(), f"{step}.{name} has another type")
        for name in _typed_fields(schema)
    ]
    return F.array_compact(F.array(*names))


def contract_check(parsed: DataFrame) -> DataFrame:
    """Add one flag per promised value set, and ``violations`` naming what is broken.

    A flag is null when its payload is absent, which is a violation of its own.
    """
    step1, step2, step3 = F.col("step1"), F.col("step2"), F.col("step3")

    def within(step: Column, field: str, allowed: tuple[str, ...]) -> Column:
        return F.when(step.isNotNull(), F.coalesce(step[field], F.lit("")).isin(*allowed))

    low = F.upper(F.coalesce(step2.confidence, F.lit(""))) == "LOW"
    flags = {
        "category_hint_ok": within(step1, "category_hint", CATEGORY_HINTS),
        "data_quality_ok": within(step1, "data_quality", DATA_QUALITIES),
        "confidence_ok": within(step2, "confidence", CONFIDENCES),
        "low_confidence_ok": F.when(
            step2.isNotNull(), ~low | F.coalesce(step2.manual_review_recommended, F.lit(False))
        ),
        "outcome_ok": within(step3, "validation_outcome", OUTCOMES),
    }
    absent = [F.when(F.col(f"step{n}").isNull(), f"step{n} has no payload") for n in (1, 2, 3)]
    broken = [F.when(~F.col(name), name.removesuffix("_ok") + " breaks the contract") for name in flags]
    kinds = {"step1": schemas.STEP1, "step2": schemas.STEP2, "step3": schemas.STEP3}
    # A projection of its own: each payload is read once more, not once per field.
    flagged = parsed.withColumns(
        flags
        | {f"_{step}": as_written(step.replace("step", "json"), _typed_fields(kind)) for step, kind in kinds.items()}
    )
    mistyped = [_mistyped(step, F.col(f"_{step}"), kind) for step, kind in kinds.items()]
    violations = F.concat(F.array_compact(F.array(*absent, *broken)), *mistyped)
    return flagged.withColumn("violations", violations).drop(*(f"_{step}" for step in kinds))
