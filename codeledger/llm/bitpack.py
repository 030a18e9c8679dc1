"""Token ids in files of fixed-width bits, with block offsets for random access.

A file: ``HEAD``, then blocks of ``BLOCK`` ids (the last may be shorter), each id in ``bits``
bits, lowest bit first, each block from a byte of its own; then the offsets of the blocks and
the end of the last (unsigned 64 bits), the document ids (signed 64 bits), their null marks
(bytes), the number of ids up to the end of each document (unsigned 64 bits), and ``FOOT``.
All numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeledger.llm.common import encoder, filesystem, shared_folder, ship_package, steps, stored

MAGIC, VERSION, BLOCK = b"IDBITS", 1, 8192
HEAD = struct.Struct("<6sHII")  # magic, version, bits, ids of a block
FOOT = struct.Struct("<QQQQ6s")  # where the block offsets begin, blocks, documents, ids, magic
MANIFEST = "part int, file string, docs long, tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Documents that a reader takes at once.
READ_DOCS = 512
#: Widths of whole bytes: bits in order, lowest first, are then little-endian numbers.
WHOLE_BYTES = {8: "<u1", 16: "<u2", 32: "<u4"}


def bits_for(vocab_size: int) -> int:
    """The fewest bits that hold every id below the vocabulary's size."""
    return max(1, (vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, without gaps, lowest bit first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in WHOLE_BYTES:
        return ids.astype(WHOLE_BYTES[bits]).tobytes()
    spread = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of what pack_bits has made."""
    if bits in WHOLE_BYTES:
        return np.frombuffer(data, WHOLE_BYTES[bits], n).astype("<u4")
    spread = np.zeros((n, 32), np.uint8)
    spread[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(spread.reshape(-1), bitorder="little").view("<u4")


class Writer:
    """Writes one file from a stream of documents; holds a block and the index."""

    def __init__(self, out, bits: int) -> None:
        self.out, self.bits, self.at = out, bits, HEAD.size
        self.offsets, self.docs, self.ends, self.tokens = [HEAD.size], [], [], 0
        self.waiting, self.held = [], 0
        out.write(HEAD.pack(MAGIC, VERSION, bits, BLOCK))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.tokens += len(ids)
        self.docs.append(doc)
        self.ends.append(self.tokens)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ids = np.concatenate(self.waiting)
            full = len(ids) // BLOCK * BLOCK
            for first in range(0, full, BLOCK):
                self._block(ids[first : first + BLOCK])
            self.waiting, self.held = [ids[full:]], len(ids) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([0 if doc is None else doc for doc in self.docs], "<i8").tobytes())
        self.out.write(np.array([doc is None for doc in self.docs], np.uint8).tobytes())
        self.out.write(np.array(self.ends, "<u8").tobytes())
        self.out.write(FOOT.pack(self.offsets[-1], len(self.offsets) - 1, len(self.docs), self.tokens, MAGIC))


class Reader:
    """Random access to a file: any run of ids, or of documents, by the blocks that hold it."""

    def __init__(self, file) -> None:
        self.file = file
        magic, version, self.bits, self.block = HEAD.unpack(self._at(0, HEAD.size))
        begin, blocks, docs, self.tokens, end = FOOT.unpack(self._at(file.size() - FOOT.size, FOOT.size))
        if (magic, end, version) != (MAGIC, MAGIC, VERSION):
            raise ValueError("not a whole file of packed ids")
        data = self._at(begin, 8 * (blocks + 1) + 17 * docs)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1)
        at = 8 * (blocks + 1)
        ids, null = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.docs = [None if gone else int(doc) for doc, gone in zip(ids, null, strict=True)]
        self.ends = np.concatenate([[0], np.frombuffer(data, "<u8", docs, at + 9 * docs)]).astype(np.int64)

    def _at(self, where: int, n: int) -> bytes:
        self.file.seek(where)
        return self.file.read(n)

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids from number ``first`` up to ``end``, which is not included."""
        if first >= end:
            return np.zeros(0, "<u4")
        low, high = first // self.block, (end - 1) // self.block + 1
        data = self._at(int(self.offsets[low]), int(self.offsets[high] - self.offsets[low]))
        base, parts = int(self.offsets[low]), []
        for k in range(low, high):
            n = min(self.block, self.tokens - k * self.block)
            parts.append(unpack_bits(data[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base], self.bits, n))
        return np.concatenate(parts)[first - low * self.block : end - low * self.block]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        return self.ids(int(self.ends[k]), int(self.ends[k + 1]))


def _written(batches: Iterable[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, known, end = TaskContext.get().partitionId(), encoder(tokenizer), np.array([end_id], "<u4")
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    # Each attempt writes a file of its own; the manifest names that of the attempt that counts.
    file = f"part-{part:06d}-{uuid.uuid4().hex}.idbits"
    writer = None
    for batch in steps(batches, "text"):
        for doc, ids in zip(batch.column("doc_id").to_pylist(), known.encode(batch.column("text").to_pylist()), strict=True):
            if writer is None:
                out = store.open_output_stream(f"{path}/{file}")
                writer = Writer(out, bits_for(known.vocab_size))
            writer.add(doc, np.concatenate([ids, end]))
    if writer is not None:
        writer.close()
        out.close()
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "file": file, "docs": len(writer.docs), "tokens": writer.tokens}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
        )


def _read(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, path = filesystem(folder)
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    for batch in batches:
        for row in batch.to_pylist():
            with store.open_input_file(f"{path}/{row['file']}") as file:
                reader = Reader(file)
                for low in range(0, len(reader.docs), READ_DOCS):
                    high = min(low + READ_DOCS, len(reader.docs))
                    first = int(reader.ends[low])
                    data = reader.ids(first, int(reader.ends[high])).tobytes()
                    ends = reader.ends[low : high + 1]
                    columns = (reader.docs[low:high], ends[:-1] + row["start"], np.diff(ends), [zlib.crc32(data[4 * (a - first) : 4 * (b - first)]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)


def write_ids(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the ids of all documents, in ascending doc_id order, to files; returns their manifest.

    Rows are dealt by ranges of doc_id and sorted by doc_id, null ids first, equal ids by text.
    A null or empty text has ``end_id`` only. A partition writes one file, named anew at each
    attempt, so a task that runs twice harms nothing: the manifest, itself a table in the shared
    folder, has the files that count. Only the columns doc_id and text are read. The folder must
    be one that all executors reach.
    """
    ship_package(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(partial(_written, folder=folder, tokenizer=tokenizer, end_id=end_id), MANIFEST), "idbits-manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, over all files; the sum runs over the
    manifest, which has a row for each file and none for documents. A task reads a file at a time.
    """
    files = manifest.count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))
    return starts.repartition(max(1, files)).mapInArrow(partial(_read, folder=folder), RESULT)


def token_files(documents: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the ids of the documents to files and read them back: see write_ids and read_ids."""
    folder = folder or shared_folder(documents.sparkSession, "idbits")
    return read_ids(write_ids(documents, folder, tokenizer, end_id), folder)
