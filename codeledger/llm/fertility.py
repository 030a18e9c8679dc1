"""Quality rules from a public vocabulary's fertility, beside counts of words, symbols and repeats.

A text is held against two bands: that of its script, set around public prose, and that of the texts of
its own language and length in the table, whose median and spread are taken over all rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeledger.llm.common import OTHER_SPACE, ship_package, steps, stored, working

#: What is measured of each text for itself; ``group`` is what it is compared with, ``vote`` is alike for near copies.
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, reason string, group string, length_class int, vote long"
)
#: The types of measures as Arrow has them.
MEASURE_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
#: The column of documents that names their language.
LANGUAGE = "lang"
#: Median and spread of a group decide from so many texts on, copies counted once; below, only the script's band does.
MEMBERS = 100
#: How far below its group's medians a text may lie: the mean of both distances in spreads, times the root of two.
EVIDENCE = 2.5
#: The least spread, as a share of the median: a group of near copies alone says nothing about others.
LEAST_SPREAD = 0.01
#: Quartiles of a normal distribution are so many standard deviations apart.
QUARTILES_APART = 1.349
#: Relative error of medians and quartiles is one over this.
ACCURACY = 10_000
#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: What str.split() takes for white space and bytes.split() doesn't.
WIDE_SPACE = "".join(set(OTHER_SPACE) - set(ASCII_SPACE))
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: How a script is told by the first word of its letters' Unicode names; others are "other".
SCRIPTS = ("latin", "cyrillic", "greek", "arabic", "hebrew", "devanagari", "cjk", "hiragana", "katakana", "hangul", "thai")


@dataclass(frozen=True)
class Band:
    """What a script's texts show of a vocabulary: outside of it a text is rejected.

    Characters per token, the largest share of tokens that are single bytes, and the entropy of
    the tokens in bits, over what a text of so many tokens can have at most.
    """

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: tuple[float, float]


#: Bands for a vocabulary of some ten thousand pieces, mostly of Latin script, set around public prose (the
#: Universal Declaration of Human Rights, article 1). Characters per token there: English 4.23, Hungarian 2.20, Finnish 2.07,
#: Polish 2.01, Turkish 1.89, random letters a-z up to 1.65; Russian 2.21, its letters at random up to 1.27; 0.76 to 0.98 where
#: a token is a letter, which tells no order of letters, but 0.24 and less for letters of four bytes each. Byte shares there: up to 0.10.
BANDS = {
    "latin": Band((1.68, 7.0), 0.05, (0.35, 1.0)),
    # Azerbaijani 1.63, Navajo 1.48 there.
    "marked latin": Band((1.25, 7.0), 0.15, (0.35, 1.0)),
    "vietnamese": Band((0.95, 4.0), 0.15, (0.35, 1.0)),
    "cyrillic": Band((1.3, 6.0), 0.15, (0.30, 1.0)),
    "greek": Band((0.6, 4.0), 0.25, (0.25, 1.0)),
    "arabic": Band((0.6, 4.0), 0.30, (0.25, 1.0)),
    "hebrew": Band((0.6, 4.0), 0.30, (0.25, 1.0)),
    "devanagari": Band((0.5, 4.0), 0.40, (0.25, 1.0)),
    "cjk": Band((0.4, 4.0), 0.70, (0.25, 1.0)),
    "hiragana": Band((0.4, 4.0), 0.60, (0.25, 1.0)),
    "katakana": Band((0.4, 4.0), 0.60, (0.25, 1.0)),
    "hangul": Band((0.35, 4.0), 0.70, (0.25, 1.0)),
    "thai": Band((0.5, 4.0), 0.40, (0.25, 1.0)),
    # Living scripts that the vocabulary lacks have three bytes a letter.
    "other": Band((0.27, 4.0), 1.0, (0.20, 1.0)),
    "": Band((0.27, 9.0), 0.90, (0.20, 1.0)),
}
#: Latin letters of Vietnamese alone, and the least share of them: its syllables have fewer characters per token than random letters.
VIETNAMESE = "\u01a0\u01a1\u01af\u01b0" + "".join(map(chr, range(0x1EA0, 0x1EFA)))
VIETNAMESE_SHARE = 0.05
#: The least share of Latin letters other than a-z from which a text is "marked latin": such languages are rare in vocabularies.
MARKED_SHARE = 0.08


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """The tokenizer and which of its ids are single bytes, once for each Python worker."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return pieces, np.array([pieces.is_byte(k) for k in range(pieces.vocab_size())], np.uint8)


@lru_cache(maxsize=1)
def _script_of() -> np.ndarray:
    """The script of each code point: 0 none, k the k-th of SCRIPTS, one more for other letters."""
    table = np.zeros(0x110000, np.uint8)
    number = {name: k for k, name in enumerate(SCRIPTS, 1)}
    for code in range(0x30000):
        if (char := chr(code)).isalpha():
            table[code] = number.get(unicodedata.name(char, "-").split(" ")[0].lower(), len(SCRIPTS) + 1)
    return table


@lru_cache(maxsize=1)
def _vietnamese() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(char) for char in VIETNAMESE]] = True
    return table


def script(text: str) -> str:
    """The script of most letters of a text, the first of equals; "" without letters.

    Latin with the letters of Vietnamese is "vietnamese", with many others than a-z "marked latin".
    """
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(_script_of()[codes], minlength=len(SCRIPTS) + 2)[1:]
    name = (*SCRIPTS, "other")[int(counts.argmax())] if counts.any() else ""
    if name == "latin" and _vietnamese()[codes].sum() >= VIETNAMESE_SHARE * counts[0]:
        return "vietnamese"
    if name == "latin" and (codes[_script_of()[codes] == 1] > 0x7F).sum() >= MARKED_SHARE * counts[0]:
        return "marked latin"
    return name


def repeated_words(words: list[str]) -> int:
    """Words that stand in a window of three that the text has twice or more."""
    if len(words) < 3:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(word, len(number)) for word in words], np.int64)
    base = len(number)
    if base < 2_000_000:
        key = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
        key = pairs[:-1] * base + ids[2:]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for shift in range(3):
        hit[shift : shift + len(key)] |= again
    return int(hit.sum())


def base_counts(text: str) -> tuple[list[str], tuple[int, int, int, int, int]]:
    """The words, then n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    if any(map(text.__contains__, WIDE_SPACE)):
        words = [word.decode("utf-8", "surrogatepass") for word in text.encode("utf-8", "surrogatepass").split()]
    else:
        words = text.split()
    lines = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
    return words, (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def verdict(name: str, chars_per_token: float, byte_share: float, entropy: float, bands: dict[str, Band]) -> str | None:
    """Why the method rejects a text, or None."""
    band = bands.get(name, bands[""])
    if not band.chars_per_token[0] <= chars_per_token <= band.chars_per_token[1]:
        return "chars_per_token"
    if byte_share > band.byte_share:
        return "byte_share"
    return None if band.entropy[0] <= entropy <= band.entropy[1] else "token_entropy"


def vote(ids: np.ndarray) -> int:
    """Two MinHash values of a text's runs of three tokens as one number, which most near copies share."""
    if len(ids) < 3:
        return 0
    runs = ids.astype(np.uint64)
    runs = (runs[:-2] * np.uint64(0x100000001B3) + runs[1:-1]) * np.uint64(0x100000001B3) + runs[2:]
    out = 0
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        mixed = runs * np.uint64(factor)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(factor)
        out = (31 * out + int(mixed.min())) & 0x7FFFFFFFFFFFFFFF
    return out


def _measured(batches: Iterable[pa.RecordBatch], vocabulary_path: str, bands: dict[str, Band], language: str, carried: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``carried`` and the measures of each row's text."""
    working("fertility", vocabulary.cache_clear)
    pieces, is_byte = vocabulary(vocabulary_path)
    schema = pa.schema([(name, MEASURE_TYPES[kind]) for name, kind in map(str.split, MEASURES.split(", "))])
    for batch in steps(batches, "text"):
        texts = [text or "" for text in batch.column("text").to_pylist()]
        counted = [base_counts(text) for text in texts]
        rows = []
        encoded = pieces.encode([" ".join(words) for words, _ in counted], num_threads=1)
        for label, text, (_, counts), ids in zip(batch.column(language).to_pylist(), texts, counted, encoded, strict=True):
            n_words, word_chars, _, _, n_repeat = counts
            n, entropy, bytes_, per_token, seen = len(ids), 0.0, 0.0, 0.0, np.array(ids, np.int64)
            if n:
                part = np.unique(seen, return_counts=True)[1] / n
                entropy = float(-(part * np.log2(part)).sum()) / np.log2(n) if n > 1 else 1.0
                bytes_, per_token = float(is_byte[seen].mean()), word_chars / n
            failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
            name = script(text)
            reason = "base" if failed else verdict(name, per_token, bytes_, min(1.0, entropy), bands)
            rows.append((*counts, failed, name, n, per_token, bytes_, entropy, reason, f"{(label or '').strip().lower()} {name}", n.bit_length(), 0 if reason else vote(seen)))
        measures = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), schema.types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(name) for name in carried] + [pa.StructArray.from_arrays(measures, fields=list(schema))], names=[*carried, "measures"])


def _stored_measures(documents: DataFrame, carried: list[str], vocabulary_path: str, bands: dict[str, Band] | None) -> DataFrame:
    """The columns ``carried`` of ``documents`` and ``measures``, written once, as they are read twice."""
    ship_package(documents.sparkSession)
    label = F.col(LANGUAGE).cast("string") if LANGUAGE in documents.columns else F.lit(None).cast("string")
    work = partial(_measured, vocabulary_path=vocabulary_path, bands=bands or BANDS, language="_language", carried=carried)
    struct = ", ".join(part.replace(" ", ": ") for part in MEASURES.split(", "))
    schema = ", ".join(f"`{name}` {documents.schema[name].dataType.simpleString()}" for name in carried)
    return stored(documents.withColumn("_language", label).mapInArrow(work, f"{schema}, measures struct<{struct}>"), "quality-measures")


def table_bands(measures: DataFrame) -> DataFrame:
    """Medians and spreads of each group and length class of texts that all other rules keep.

    Rows of one vote, copies and most near copies, count once. All rows are read, in two aggregates
    that are combined before they are shuffled; medians are Spark's bounded sketches.
    """
    kept = measures.select("measures.*").filter("reason IS NULL")
    votes = kept.groupBy("group", "length_class", "vote").agg(F.min(F.struct("n_tokens", "chars_per_token", "token_entropy")).alias("of"))
    quartiles = {name: F.percentile_approx(f"of.{name}", [0.25, 0.5, 0.75], ACCURACY) for name in ("chars_per_token", "token_entropy")}
    found = votes.groupBy("group", "length_class").agg(F.count("*").alias("members"), *(value.alias(name) for name, value in quartiles.items()))
    spread = lambda name: F.greatest((F.col(name)[2] - F.col(name)[0]) / QUARTILES_APART, F.col(name)[1] * LEAST_SPREAD)
    return found.filter(F.col("members") >= MEMBERS).select(
        "group", "length_class", *(value for name in quartiles for value in (F.col(name)[1].alias(f"{name}_median"), spread(name).alias(f"{name}_spread")))
    )


def _decided(rows: DataFrame) -> DataFrame:
    """Measured rows with ``evidence``, null where no group speaks, and the whole ``reason``."""
    table = stored(table_bands(rows), "quality-bands").withColumnsRenamed({"group": "_group", "length_class": "_length_class"})
    joined = rows.join(table, (F.col("measures.group") == F.col("_group")) & (F.col("measures.length_class") == F.col("_length_class")), "left")
    distance = lambda name: (F.col(f"measures.{name}") - F.col(f"{name}_median")) / F.col(f"{name}_spread")
    evidence = (distance("chars_per_token") + distance("token_entropy")) / F.sqrt(F.lit(2.0))
    return joined.select(*rows.columns, evidence.alias("evidence"), F.coalesce("measures.reason", F.when(evidence < -EVIDENCE, "language")).alias("reason"))


def good(documents: DataFrame, vocabulary_path: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of ``documents`` that ``judge`` keeps, each by its own text."""
    columns = documents.columns
    return _decided(_stored_measures(documents, columns, vocabulary_path, bands)).filter(F.col("reason").isNull()).select(*columns)


def judge(documents: DataFrame, vocabulary_path: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """One row per document: counts of its words, and what the vocabulary makes of them.

    A null or empty text has no words and fails. ``base_failed`` texts are rejected; others are
    judged by the band of their script (``bands[""]`` where it has none): characters per token,
    share of byte-fallback tokens, and entropy of the tokens over log2 of their number, over all
    words of the whole text joined by single spaces. What these keep is held against the table's own
    texts of the same language (``lang``, if there is one), script and number of tokens (by powers of
    two): characters per token and entropy, each in spreads from the median, together not more than
    ``EVIDENCE`` below; groups under ``MEMBERS`` texts don't speak. ``reason`` names the first rule
    that rejects. Repeated rows and null ids come out as they are, each by its own text; only doc_id,
    text and lang are read. A step of work holds some megabytes of texts, or one text; the measures
    are written once, without the texts, and read for the bands and for the verdict. The bands, one
    row a group, are joined by their size: broadcast where small.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([LANGUAGE] if LANGUAGE in documents.columns else []))
    names = [part.split(" ")[0] for part in MEASURES.split(", ")]
    first = names[: names.index("base_failed") + 1]
    rest = [name for name in names if name not in (*first, "reason", "group", "length_class", "vote")]
    found = _decided(_stored_measures(rows, ["doc_id"], vocabulary_path, bands))
    shown = lambda some: [F.col(f"measures.{name}") for name in some]
    return found.select("doc_id", *shown(first), F.col("reason").isNull().alias("kept"), *shown(rest), "evidence", "reason")
