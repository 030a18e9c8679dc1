"""Helpers that several operators share: batches, byte-pair encoding, scratch tables."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from codeledger.session import scratch_dir, ship_package

#: Texts of one step of work, in bytes: what a task holds besides the batch that Spark hands it.
STEP_BYTES = 4_000_000
#: Bytes of memory for the chunks that an encoder remembers, in two halves of which the older goes first.
REMEMBERED_BYTES = 32_000_000
#: Characters of texts whose chunks are gathered at once.
GATHERED_BYTES = 4_000_000
#: New chunks that are encoded as one text.
JOINED = 4096
#: Stands where a text is cut; texts that have it themselves are cut another way.
CUT = "\x00"
#: White space besides the space itself, of which a text seldom has any next to a space.
OTHER_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


#: What operators remember in this Python worker, and how it is forgotten.
_remembered: dict[str, Callable[[], None]] = {}


def working(name: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called as a task of an operator begins: what other operators have left in a reused worker is forgotten."""
    for other in [other for other in _remembered if other != name]:
        _remembered.pop(other)()
        give_back()
    _remembered[name] = forget


def give_back() -> None:
    """Return memory that is free to the system, which counts it against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def steps(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts together stay near STEP_BYTES; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, first = np.cumsum(np.diff(_offsets(batch.column(text))).astype(np.int64)), 0
        while first < batch.num_rows:
            limit = (sizes[first - 1] if first else 0) + STEP_BYTES
            end = max(first + 1, int(np.searchsorted(sizes, limit, "right")))
            yield batch.slice(first, end - first)
            first = end
        give_back()


def _offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]


class Encoder:
    """A byte-level BPE of the tokenizers library, each distinct chunk of text encoded once.

    The vocabulary's pre-tokenizer starts a token at a space between two characters that are no white space,
    between a letter or number and a comma or full stop, and on both sides of a single line break. A
    text cut there has the ids of its chunks, one after the other; texts with other spaces are cut
    only at spaces, by a slower rule. ``prefix`` is put before every text.
    """

    def __init__(self, path: str, prefix: str = "") -> None:
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # A byte-level vocabulary writes each byte as one character.
        self.bytes_of = np.zeros(self.vocab_size, np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes_of[k] = len(token)
        self.single_space = re.compile(r"(?<=\S)(?= \S)")
        self.prefix = prefix
        self.known, self.older = Chunks(), Chunks()

    def plain(self, text: str) -> bool:
        """Whether every space of the text stands between two characters that are no white space."""
        return not (CUT in text or "  " in text or text[:1] == " " or text[-1:] == " " or any(c in text and (f" {c}" in text or f"{c} " in text) for c in OTHER_SPACE))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; of a null or empty text those of the prefix."""
        if self.known.held > REMEMBERED_BYTES // 2:
            self.older, self.known = self.known, Chunks()
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        plain = [self.plain(text or "") for text in texts]
        for kind in (True, False):
            at = [k for k, value in enumerate(plain) if value == kind]
            while at:
                some, size = [], 0
                while len(some) < len(at) and (not some or size < GATHERED_BYTES):
                    some.append(self.prefix + (texts[at[len(some)]] or ""))
                    size += len(some[-1])
                cut = self._cut(some) if kind else pa.array([self.single_space.split(text) for text in some], pa.large_list(pa.large_string()))
                for k, ids in zip(at, self._gathered(cut), strict=False):
                    out[k] = ids
                at = at[len(some) :]
        return out

    def _cut(self, texts: list[str]) -> pa.Array:
        """The chunks of plain texts; a space belongs to the chunk after it."""
        marked = pc.replace_substring(pa.array(texts, pa.large_string()), " ", CUT + " ")
        marked = pc.replace_substring_regex(marked, r"([\pL\pN])([,.])", r"\1" + CUT + r"\2")
        # A line break whose neighbour was the last one's is left uncut, which changes no ids.
        marked = pc.replace_substring_regex(marked, r"([^\s\pZ\x{85}])\n([^\s\pZ\x{85}" + CUT + r"])", r"\1" + CUT + "\n" + CUT + r"\2")
        return pc.split_pattern(marked, CUT)

    def _gathered(self, cut: pa.Array) -> list[np.ndarray]:
        """The ids of texts cut into chunks: each distinct chunk is looked up once, its ids are gathered by number."""
        ends, named = cut.offsets.to_numpy().astype(np.int64), cut.flatten().dictionary_encode()
        number, places = named.indices.to_numpy(), self._places(named.dictionary)
        lengths = self.known.sizes[places][number]
        before = np.cumsum(lengths, dtype=np.int64) - lengths
        shift = (self.known.starts[places][number] - before).astype(np.int32)
        where = np.repeat(shift, lengths)
        where += np.arange(len(where), dtype=np.int32)
        return np.split(self.known.ids[where], np.append(before, len(where))[ends[1:-1] - ends[0]])

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Where the chunks, each given once, stand among the known; those that are not there are put there first."""
        places = self.known.find(chunks)
        for known in (self.older.entries, self._learn):
            missing = np.flatnonzero(places < 0)
            if len(missing):
                found, sizes, ids = known(chunks.take(pa.array(missing)))
                places[missing[found]] = len(self.known.texts) + np.arange(len(found))
                self.known.add(chunks.take(pa.array(missing[found])), sizes, ids)
        return places

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode chunks: their numbers, how many ids each has, and the ids.

        Chunks of a space and what is no white space at its ends go as one text, cut afterwards by the bytes of its
        tokens; so do chunks without white space at their ends, a line break after each, whose token is left out. As above, the ids are those of each alone.
        """
        inner, first = pc.utf8_trim_whitespace(new), pc.utf8_slice_codeunits(new, 0, 1)
        rest = pc.utf8_slice_codeunits(new, 1)
        spaced = pc.and_(pc.equal(first, " "), pc.and_(pc.not_equal(rest, ""), pc.equal(pc.utf8_trim_whitespace(rest), rest)))
        whole = pc.and_(pc.not_equal(new, ""), pc.equal(inner, new))
        spaced, whole = (mask.to_numpy(zero_copy_only=False) for mask in (spaced, whole))
        order, sizes, ids = [], [], []
        for mask, after in ((spaced, ""), (whole, "\n")):
            at = np.flatnonzero(mask)
            for low in range(0, len(at), JOINED):
                some = new.take(pa.array(at[low : low + JOINED]))
                text = after.join(some.to_pylist()) + after
                found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                ends = np.cumsum(pc.binary_length(some).to_numpy() + len(after))
                ends = np.searchsorted(np.cumsum(self.bytes_of[found]), ends) + 1
                order.append(at[low : low + JOINED])
                sizes.append(np.diff(ends, prepend=0) - len(after))
                ids.append(np.delete(found, ends - 1) if after else found)
        at = np.flatnonzero(~(spaced | whole))
        alone = self.tokenizer.encode_batch_fast(new.take(pa.array(at)).to_pylist(), add_special_tokens=False)
        order.append(at)
        sizes.append(np.array([len(found.ids) for found in alone], np.int64))
        ids += [np.array(found.ids, "<u4") for found in alone]
        return np.concatenate(order), np.concatenate(sizes), np.concatenate([np.zeros(0, "<u4"), *ids])


class Chunks:
    """Chunks of texts and their ids, side by side in arrays: an entry has no objects of its own."""

    def __init__(self) -> None:
        self.texts = pa.array([], pa.large_string())
        self.sizes, self.starts, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, "<u4")

    @property
    def held(self) -> int:
        return self.texts.nbytes + self.sizes.nbytes + self.starts.nbytes + self.ids.nbytes

    def find(self, texts: pa.Array) -> np.ndarray:
        """The place of each text, -1 if it has none."""
        return pc.fill_null(pc.index_in(texts, value_set=self.texts), -1).to_numpy().astype(np.int64)

    def entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of those texts that are here: their numbers among the given ones, how many ids each has, and the ids."""
        places = self.find(texts)
        found = np.flatnonzero(places >= 0)
        sizes, starts = self.sizes[places[found]], self.starts[places[found]]
        where = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return found, sizes, self.ids[where + np.arange(len(where))]

    def add(self, texts: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Texts that are not here, and their ids one after the other."""
        self.texts = pa.concat_arrays([self.texts, texts])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids])


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker, for the task that begins."""
    working("encoder", _encoder.cache_clear)
    return _encoder(path)


def stored(frame: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends there, lost executors lose nothing."""
    path = shared_folder(frame.sparkSession, name)
    writer = frame.write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared scratch folder; the package goes to the Python workers, too."""
    ship_package(spark)
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")


def filesystem(path: str):
    """The file system of a folder and the folder's path in it; other stores than local ones are reached by their URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path
