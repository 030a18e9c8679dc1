"""Structure of the commodity codes: heading 4, CN 8 and TARIC 10 digits."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeledger.functions.text import as_column

# Code lengths.
HEADING_DIGITS = 4
CN_DIGITS = 8
TARIC_DIGITS = 10


def _code(value: Column | str) -> Column:
    return F.coalesce(as_column(value), F.lit(""))


def heading(cn_code: Column | str) -> Column:
    return F.left(_code(cn_code), F.lit(HEADING_DIGITS))


def cn_ok(cn_code: Column | str) -> Column:
    return _code(cn_code).rlike(rf"\A[0-9]{{{CN_DIGITS}}}\z")


def taric_ok(taric_code: Column | str) -> Column:
    return _code(taric_code).rlike(rf"\A[0-9]{{{TARIC_DIGITS}}}\z")


def taric_extends_cn(cn_code: Column | str, taric_code: Column | str) -> Column:
    return (_code(cn_code) != "") & F.startswith(_code(taric_code), _code(cn_code))


def taric_digits(taric_code: Column | str) -> Column:
    """How many digits the code really has; spaces and dots do not count."""
    return F.length(F.regexp_replace(_code(taric_code), "[^0-9]", ""))


def taric_short(taric_code: Column | str) -> Column:
    return taric_digits(taric_code) < TARIC_DIGITS


def short_taric_issue(taric_code: Column | str) -> Column:
    """The issue text of a short code, else null."""
    digits = taric_digits(taric_code)
    # Fixed value: the wording of the issue.
    text = F.concat(
        F.lit("TARIC code incomplete - only "),
        digits.cast("string"),
        F.lit(f" digits provided, {TARIC_DIGITS} required for EU import."),
    )
    return F.when(digits < TARIC_DIGITS, text)
