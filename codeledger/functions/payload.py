"""JSON objects at the end of answer texts.

An answer's payload is whatever stands between its last opening brace and its end, and it
counts only if that is exactly one JSON value. The JSON functions of Spark stop reading
after the first value and tolerate single quotes, so two checks are combined: a pattern
that finds the closing brace outside strings at the very end, and a strict parse.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeledger import schemas
from codeledger.functions.text import as_column

# An object without another brace in it, closing brace outside strings and last. The strict
# parse knows more spellings of infinity than the payload grammar: outside strings, "I" only
# starts the word in full and "+" only an exponent. Possessive quantifiers: nothing is tried
# twice, whatever the length of the text.
_MEMBERS = r'(?:[^"}I+]++|Infinity|(?<=[eE])\+|"(?:[^"\\]++|\\.)*+")*+'
_OBJECT = r"(?s)\A\{" + _MEMBERS + r"\}[ \t\n\r]*+\z"
_FILLED_OBJECT = r"(?s)\A\{(?![ \t\n\r]*\})" + _MEMBERS + r"\}[ \t\n\r]*+\z"
# The parser's own limits on numbers, depth and texts are lifted: a payload is read whatever its size.
_UNLIMITED = str(2**31 - 1)
_STRICT = {"allowSingleQuotes": "false", "maxNumLen": _UNLIMITED, "maxNestingDepth": _UNLIMITED, "maxStringLen": _UNLIMITED}
# A parse that keeps nothing but whether it failed: it passes over all values.
_FAILED = T.StructType([T.StructField("failed", T.StringType())])


def _tail(raw: Column | str) -> Column:
    """From the last brace on. Two byte searches: cheap enough to be mentioned repeatedly."""
    raw = as_column(raw)
    return F.when(F.contains(raw, F.lit("{")), F.concat(F.lit("{"), F.substring_index(raw, "{", -1)))


def _checked(tail: Column, pattern: str) -> Column:
    parsed = F.from_json(tail, _FAILED, _STRICT | {"columnNameOfCorruptRecord": "failed"})
    return F.when(tail.rlike(pattern) & parsed.failed.isNull(), tail)


def extract_json(raw: Column | str) -> Column:
    """The payload text of an answer, or null."""
    return _checked(_tail(raw), _OBJECT)


def usable_json(raw: Column | str) -> Column:
    """As :func:`extract_json`, with the empty object counted as absent."""
    return _checked(_tail(raw), _FILLED_OBJECT)


def typed(payload: Column | str, schema: T.StructType) -> Column:
    """A checked payload text as a struct; fields of another type become null."""
    return F.from_json(as_column(payload), schema, _STRICT)


def as_written(payload: Column | str, fields: list[str]) -> Column:
    """Fields of a checked payload as their own text, whatever type they were given."""
    return typed(payload, T.StructType([T.StructField(name, T.StringType()) for name in fields]))


def with_payloads(cases: DataFrame) -> DataFrame:
    """Add ``json1..3`` (payload texts) and ``step1..3`` (typed) to ``raw1..3``.

    One projection per stage, so that each text is cut, checked and parsed once however
    often the results are used.
    """
    present = [n for n in (1, 2, 3) if f"raw{n}" in cases.columns]
    kinds = {1: schemas.STEP1, 2: schemas.STEP2, 3: schemas.STEP3}
    cut = cases.withColumns({f"json{n}": _tail(f"raw{n}") for n in present})
    checked = cut.withColumns({f"json{n}": _checked(F.col(f"json{n}"), _FILLED_OBJECT) for n in present})
    return checked.withColumns({f"step{n}": typed(f"json{n}", kinds[n]) for n in present})
