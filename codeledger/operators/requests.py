"""From an inquiry to the texts sent to the model function."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeledger.functions.text import as_column, blank_to_null, is_blank, strip, texts

# Reasons for turning an inquiry away.
NO_INPUT = "no description or attachment"
NO_USER = "no user"


def reject_reason(
    description: Column | str = "description",
    user: Column | str = "user",
    has_image: Column | str = "has_image",
    has_invoice: Column | str = "has_invoice",
) -> Column:
    """Why an inquiry is not admitted, or null. Missing input is reported before a missing user."""
    no_text = F.coalesce(as_column(description), F.lit("")) == ""
    no_files = ~F.coalesce(as_column(has_image), F.lit(False)) & ~F.coalesce(as_column(has_invoice), F.lit(False))
    return F.when(no_text & no_files, NO_INPUT).when(is_blank(user), NO_USER)


def admitted(inquiries: DataFrame) -> DataFrame:
    return inquiries.filter(reject_reason().isNull())


def _section(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(label), value))


# The section labels of the request texts.


def step1_text(description: Column | str, specs: Column | str, extra: Column | str | None = None) -> Column:
    """Labelled optional sections; null when there is no text at all, only attachments."""
    sections = [
        _section("Product description / invoice text:\n", blank_to_null(description)),
        _section("Technical specifications:\n", blank_to_null(specs)),
    ]
    if extra is not None:
        sections.append(_section("Additional information provided by the user:\n", blank_to_null(extra)))
    return blank_to_null(strip(F.concat_ws("\n\n", *sections)))


def step2_text(json1: Column | str, raw1: Column | str) -> Column:
    return F.concat(
        F.lit("Structured product data from feature extractor:\n\n"),
        F.coalesce(as_column(json1), as_column(raw1), F.lit("")),
    )


def step3_text(description: Column | str, json1: Column | str, json2: Column | str, raw2: Column | str) -> Column:
    raw2 = F.coalesce(as_column(raw2), F.lit(""))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("Product data:\n"), F.coalesce(as_column(json1), as_column(description), F.lit(""))),
        F.concat(F.lit("Proposed classification:\n"), F.coalesce(as_column(json2), raw2)),
        F.concat(F.lit("Full reasoning:\n"), raw2),
    )


def question_text(parsed: DataFrame, *, improve: bool = False) -> Column:
    """What the question step is asked, from a frame with payloads.

    ``improve`` is the form for a found code of medium confidence: it names that code.
    """
    description, step1, step2 = (F.col(name) for name in ("description", "step1", "step2"))

    def listed(value: Column) -> Column:
        return F.to_json(texts(value))

    sections = [
        F.concat(F.lit("Product description: "), F.coalesce(description, F.lit(""))),
        F.concat(F.lit("Step 1 extraction:\n"), F.coalesce(parsed.json1, parsed.raw1, F.lit(""))),
        F.concat(F.lit("Step 2 warnings:\n"), listed(step2.warnings)),
        F.concat(F.lit("Missing information:\n"), listed(step1.missing_information)),
    ]
    if improve:
        code = F.coalesce(step2.cn_code, F.lit(""))
        sections += [
            F.concat(F.lit("Current code: "), code, F.lit(" (MEDIUM confidence)")),
            F.concat(F.lit("Candidate headings: "), listed(step2.candidate_headings)),
        ]
    else:
        sections.append(F.concat(F.lit("Candidate headings found: "), listed(step2.candidate_headings)))
    return F.concat_ws("\n\n", *sections)
