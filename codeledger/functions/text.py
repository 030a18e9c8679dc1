"""Text columns: stripping, lines, keyword excerpts and the product fingerprint."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode-aware stripping removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The characters that end a line.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# Words that mark a reasoning line worth keeping.
REASONING_KEYWORDS = (
    "STEP 3", "STEP 4", "STEP 5", "STEP 6", "STEP 7", "STEP 8",
    "GIR", "legal note", "heading", "subheading", "chapter", "section",
)
# How much the short forms keep. Everything is whole unless a caller passes them.
EXCERPT_WIDTH = 120
EXCERPT_LINES = 20
FINGERPRINT_WORDS = 30


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.btrim(as_column(value), F.lit(WHITESPACE))


def blank_to_null(value: Column | str) -> Column:
    """Null for the empty string only; white space is content."""
    return F.nullif(as_column(value), F.lit(""))


def is_blank(value: Column | str) -> Column:
    return strip(F.coalesce(as_column(value), F.lit(""))) == ""


def texts(value: Column) -> Column:
    """A list column with null read as the empty list."""
    return F.coalesce(value, F.array().cast("array<string>"))


def shortened(value: Column | str, width: int | None) -> Column:
    """The first characters of a text; without a width all of it."""
    return as_column(value) if width is None else F.left(as_column(value), F.lit(width))


def first_items(values: Column, limit: int | None) -> Column:
    """The first items of a list; without a limit all of them."""
    return values if limit is None else F.slice(values, 1, limit)


def lines(value: Column | str) -> Column:
    """The lines of a text. A pair of line ends gives a blank line; callers drop those."""
    return F.split(F.translate(as_column(value), LINE_ENDS, "\n" * len(LINE_ENDS)), "\n")


def contains_any(value: Column, words: tuple[str, ...]) -> Column:
    """Case-insensitive: does the text contain one of the words?"""
    lowered = [word.lower() for word in words]
    # The look-ahead passes over most characters without trying the words.
    starts = "".join(sorted({word[0] for word in lowered}))
    pattern = "|".join(rf"\Q{word}\E" for word in lowered)
    return F.lower(value).rlike(f"(?=[{starts}])(?:{pattern})")


def reasoning_excerpts(raw: Column | str, limit: int | None = None, width: int | None = None) -> Column:
    """Stripped lines that name a method step or legal source; ``limit`` of them, each cut to ``width``."""
    kept = F.filter(lines(raw), lambda line: contains_any(line, REASONING_KEYWORDS))
    return F.transform(first_items(kept, limit), lambda line: shortened(strip(line), width))


def fingerprint(description: Column | str, limit: int | None = None) -> Column:
    """Sorted distinct ASCII words of the lowered text, space-joined; only the first ``limit``, if given.

    The fingerprint is a join key: cut short, it takes two products for one.
    """
    words = F.split(F.regexp_replace(F.lower(as_column(description)), "[^a-z0-9]+", " "), " ")
    kept = F.array_sort(F.array_distinct(F.filter(words, lambda word: word != "")))
    return F.array_join(first_items(kept, limit), " ")
