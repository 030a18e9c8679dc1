"""Language identification by string kernels: n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeledger.llm.common import ship_package, steps, working

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: The blended spectrum: n-grams of one to ORDERS characters, each hashed to one of 2 ** SLOT_BITS slots.
ORDERS, SLOT_BITS = 4, 16
SLOTS = 1 << SLOT_BITS
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters; all other characters count as a space."""
    return np.array([chr(code).isalpha() for code in range(0x110000)], bool)


def grams(text: str, flags: np.ndarray) -> np.ndarray | None:
    """The slots of the n-grams that a text has, each once, ascending; None without a letter.

    The text is lower-cased and every run of other characters than letters is one space.
    ``flags`` is a work space of SLOTS falses and is left so.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    codes = np.concatenate([[32], codes[kept], [32]]).astype(np.uint32)
    rolled = np.zeros(len(codes), np.uint32)
    for order in range(ORDERS):
        if order >= len(codes):
            break
        rolled = (rolled[: len(codes) - order] if order == 0 else rolled[:-1]) * np.uint32(0x01000193) + codes[order:] * np.uint32(0x9E3779B1) + np.uint32(order + 1)
        mixed = rolled ^ (rolled >> np.uint32(15))
        flags[(mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - SLOT_BITS)] = True
    slots = np.flatnonzero(flags)
    flags[slots] = False
    return slots


@dataclass(frozen=True)
class Model:
    """Languages, and the weight of each slot for each of them.

    The kernel of two texts is the number of n-grams that both have, over the root of the product
    of how many each has. A text's kernels with all landmarks, times the regression's weights of
    the landmarks, is a product of its presence row with (landmarks' presence rows times those
    weights): the model holds the latter product.
    """

    languages: tuple[str, ...]
    weights: np.ndarray
    #: The least evidence of a text that is told (see ``least_evidence``), and the fewest n-grams that it was learned from.
    floor: float = -np.inf
    fewest: int = 0

    def told(self, texts: list[str | None]) -> np.ndarray:
        """Which texts are in a learned language: those with a letter whose evidence, the winning regression's value over

        the root of the number of n-grams, is ``floor`` or more. Texts shorter than all of the sample can't be judged so; they are told.
        """
        named, lengths, product = self._values(texts)
        out = np.zeros(len(texts), bool)
        if named:
            out[named] = (product.max(1) >= self.floor * np.sqrt(lengths)) | (lengths < self.fewest)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores of a batch of texts: one product of presence rows and weights."""
        named, _, product = self._values(texts)
        found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if named:
            best = product.argmax(1)
            score[named] = np.clip((product[np.arange(len(named)), best] + 1) / 2, 0, 1)
            for k, at in zip(named, best, strict=True):
                found[k] = self.languages[at]
        return found, score

    def _values(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Which texts have a letter, and of those how many n-grams they have and every regression's value."""
        flags = np.zeros(SLOTS, bool)
        rows = [grams(text, flags) if text and self.languages else None for text in texts]
        named = [k for k, row in enumerate(rows) if row is not None]
        if not named:
            return named, np.zeros(0), np.zeros((0, len(self.languages)))
        lengths = np.array([len(rows[k]) for k in named])
        starts = np.cumsum(lengths) - lengths
        return named, lengths, np.add.reduceat(self.weights[np.concatenate([rows[k] for k in named])], starts) / np.sqrt(lengths)[:, None]


def _unit_kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernels between presence rows (packed bits) and landmark rows (packed bits)."""
    right = np.unpackbits(landmarks, axis=1).astype(np.float32)
    right /= np.sqrt(np.maximum(right.sum(1), 1))[:, None]
    out = np.empty((len(rows), len(landmarks)))
    for first in range(0, len(rows), 64):
        left = np.unpackbits(rows[first : first + 64], axis=1).astype(np.float32)
        out[first : first + 64] = (left @ right.T) / np.sqrt(np.maximum(left.sum(1), 1))[:, None]
    return out


def fit_rows(rows: np.ndarray, labels: list[str], landmarks: int, ridge: float) -> Model:
    """Kernel ridge regression, one language against the rest, in the span of the landmarks.

    rows: packed presence rows. Landmarks are taken from each language in turn.
    """
    languages = tuple(sorted(set(labels)))
    if not languages:
        return Model((), np.zeros((SLOTS, 0), np.float32))
    turn: dict[str, int] = dict.fromkeys(languages, 0)
    order = []
    for k, label in enumerate(labels):
        order.append((turn[label], k))
        turn[label] += 1
    chosen = rows[[k for _, k in sorted(order)[:landmarks]]]
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Each language has the same weight, however many of its texts there are.
    weight = np.array([1 / turn[label] for label in labels])
    cross, own = _unit_kernel(rows, chosen), _unit_kernel(chosen, chosen)
    left = cross.T @ (cross * weight[:, None]) + ridge * own + 1e-8 * np.eye(len(chosen))
    solved = np.linalg.solve(left, cross.T @ (target * weight[:, None])).astype(np.float32)
    weights = np.zeros((SLOTS, len(languages)), np.float32)
    for first in range(0, len(chosen), 64):
        some = np.unpackbits(chosen[first : first + 64], axis=1).astype(np.float32)
        some /= np.sqrt(np.maximum(some.sum(1), 1))[:, None]
        weights += some.T @ solved[first : first + 64]
    return Model(languages, weights, *least_evidence(rows, labels, languages, weights))


def least_evidence(rows: np.ndarray, labels: list[str], languages: tuple[str, ...], weights: np.ndarray) -> tuple[float, int]:
    """A bound on a text's evidence, learned from the sample's own: a quarter of what 99 of 100 reach with their label.

    Evidence is a regression's value over the root of the number of n-grams, the mean weight of an
    n-gram. That of texts in no learned language is about nought or less, however long they are, that of
    prose falls with its length, which the quarter leaves room for. Also the fewest n-grams of a text of the sample.
    """
    evidence, lengths = np.empty(len(rows)), np.empty(len(rows))
    own = np.array([languages.index(label) for label in labels])
    for first in range(0, len(rows), 64):
        some = np.unpackbits(rows[first : first + 64], axis=1).astype(np.float32)
        lengths[first : first + 64] = np.maximum(some.sum(1), 1)
        evidence[first : first + 64] = (some @ weights)[np.arange(len(some)), own[first : first + 64]] / lengths[first : first + 64]
    return max(0.0, float(np.quantile(evidence, 0.01)) / 4), int(lengths.min())


def _presence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    working("language")
    flags = np.zeros(SLOTS, bool)
    for batch in steps(batches, "text"):
        rows = []
        for text in batch.column("text").to_pylist():
            slots = grams(text, flags) if text else None
            if slots is None:
                rows.append(None)
                continue
            flags[slots] = True
            rows.append(np.packbits(flags).tobytes())
            flags[slots] = False
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.binary())], names=["doc_id", "lang", "presence"])


def held_out():
    """Whether a document is kept from the training: crc32 of its id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, sample: int = 1024, landmarks: int = 192, ridge: float = 1e-3) -> Model:
    """Learn from a bounded sample of the labelled documents that are not held out.

    ``sample`` documents at most (or four of each language, if that is more), as many of each
    language, are chosen by a hash of their ids; what reaches the driver is a presence row of
    SLOTS bits for each. Labels and ids serve the choice and the targets only.
    """
    spark = documents.sparkSession
    ship_package(spark)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    labelled = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    languages = labelled.agg(F.countDistinct("lang")).first()[0]
    each = max(4, sample // max(1, languages))
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    keys = labelled.select("lang", "doc_id").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= each).select("lang", "doc_id").distinct()
    # The sample is bounded, so its ids may go to every executor.
    texts = labelled.join(F.broadcast(keys), ["lang", "doc_id"], "left_semi").select("doc_id", "lang", "text")
    presence = texts.mapInArrow(_presence, "doc_id long, lang string, presence binary").filter("presence IS NOT NULL")
    got = presence.groupBy("lang", "doc_id").agg(F.min("presence").alias("presence")).collect()
    got.sort(key=lambda row: (row.lang, row.doc_id))
    packed = np.array([np.frombuffer(row.presence, np.uint8) for row in got]).reshape(-1, SLOTS // 8)
    return fit_rows(packed, [row.lang for row in got], landmarks, ridge)


def _predicted(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    working("language")
    for batch in steps(batches, "text"):
        found, score = model.predict(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """The language of every document from its whole text; ``und`` for null texts and such without a letter.

    The score is 0 to 1: the winning regression's value, -1 to 1, carried to that range. Without a
    learned language all are ``und`` with score 0. Rows stand for themselves: repeated rows and null
    ids (never held out) come out as they are. Only doc_id and text are read, without a shuffle.
    """
    ship_package(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_predicted, model=model), SCHEMA)


def _told(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    working("language")
    for batch in steps(batches, "text"):
        yield batch.filter(pa.array(model.told(batch.column("text").to_pylist())))


def told(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` whose text is in a learned language (see Model.told), each judged for itself, without a shuffle."""
    ship_package(documents.sparkSession)
    return documents.mapInArrow(partial(_told, model=model), documents.schema)
