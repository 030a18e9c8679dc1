"""Alignment of two tokenizers over a corpus, with corpus-wide counts of the token pairs that end together.

First pass: every text is encoded by both vocabularies and its tokens are cut into groups wherever a
token of each ends. A block of some megabytes of text leaves its documents' ids and its distinct
pairs with their numbers. The distinct pairs of all blocks get a minimal perfect hash
(:class:`PerfectHash`), sharded by a mix of the pair, and the blocks' numbers are added up in
dense vectors indexed by it, a tree of sums for each shard. Second pass: a block's pairs are looked up,
keys verified, and its documents are aligned again with the counts at hand.

Everything that a task holds is a block or a shard; blocks and shards meet in shuffles, with the
shard's rows dealt to as many groups as there are blocks to serve. Only the highest count of each
id of the second vocabulary is gathered on the driver: no more numbers than that vocabulary has ids.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeledger.llm.common import Encoder, steps, stored, working

#: Text bytes of a block: its documents are aligned again with its own pairs at hand.
BLOCK_BYTES = 16_000_000
#: Text bytes aligned at once; a longer text stands alone.
SLICE_BYTES = 1_000_000
#: Distinct pairs of a shard on average: what a task holds of the dictionary.
SHARD_KEYS = 65_536
#: Blocks served by one copy of a shard, and vectors added up at once.
BLOCKS_OF_COPY, FAN = 256, 16
#: Blocks that a task of the second pass aligns, one after the other.
BLOCKS_OF_TASK = 2

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# --- The two vocabularies ---------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: printable ones stand for themselves,

    the others, in order, for the characters from 256 on.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [byte for byte in range(256) if byte not in printable]
    return {**{chr(byte): byte for byte in printable}, **{chr(256 + k): byte for k, byte in enumerate(others)}}


class ByteLevel(Encoder):
    """The byte-level encoder, with the bytes of its tokens."""

    def token_bytes(self) -> list[bytes]:
        of, entries = byte_letters(), [b""] * self.vocab_size
        for token, k in self.tokenizer.get_vocab().items():
            # An added token is written as it is.
            entries[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        return entries


class Tokens:
    """Both vocabularies: their encoders, the bytes of their tokens, and their ids in writing."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = ByteLevel(path_a, prefix=" ")
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        of_b = [bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode() for k, piece in enumerate(pieces)]
        of_a = self.a.token_bytes()
        self.size_a, self.size_b = len(of_a), len(of_b)
        self.bytes_a, self.bytes_b = pa.array(of_a, pa.large_binary()), pa.array(of_b, pa.large_binary())
        self.lengths_a = np.array([len(token) for token in of_a], np.int64)
        self.lengths_b = np.array([len(token) for token in of_b], np.int64)
        # Ids as text with what follows them: a,  a|  b,  b;  b at the very end.
        self.written = pa.array([f"{k}{end}" for n, ends in ((self.size_a, ",|"), (self.size_b, (",", ";", ""))) for end in ends for k in range(n)], pa.large_string())
        self.ids = np.dtype("<u2") if max(self.size_a, self.size_b) <= 1 << 16 else np.dtype("<u4")

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of space + text by both; None where the tokens' bytes are not those of the text."""
        first = self.a.encode(texts)
        second = self.b.encode(texts, out_type=int, num_threads=1)
        sizes = [len(ids) for ids in second]
        joined = np.fromiter(chain.from_iterable(second), np.int64, sum(sizes))
        second = np.split(joined, np.cumsum(sizes)[:-1])
        whole_a, whole_b = _joined(self.bytes_a, first), _joined(self.bytes_b, second)
        return [
            (a.astype(self.ids), b.astype(self.ids)) if bytes_a == bytes_b == b" " + text.encode() else None
            for text, a, b, bytes_a, bytes_b in zip(texts, first, second, whole_a, whole_b, strict=True)
        ]


@lru_cache(maxsize=1)
def _tokens(path_a: str, path_b: str) -> Tokens:
    return Tokens(path_a, path_b)


def tokens(path_a: str, path_b: str) -> Tokens:
    """Both vocabularies, once for each Python worker, for the task that begins."""
    working("align", _tokens.cache_clear)
    return _tokens(path_a, path_b)


def _joined(entries: pa.Array, ids: list[np.ndarray]) -> list[bytes]:
    """The bytes of each list of ids: one gather over all of them, cut at the lists' ends."""
    found = entries.take(pa.array(np.concatenate(ids)))
    ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1][np.cumsum([0, *map(len, ids)])]
    data = (found.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [data[start:end] for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def folded(ids: np.ndarray) -> bytes:
    """Ids for storage: how many, then their bytes, all lowest ones first, compressed."""
    planes = np.ascontiguousarray(ids.view(np.uint8).reshape(len(ids), ids.dtype.itemsize).T)
    return struct.pack("<Q", len(ids)) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unfolded(data: bytes, dtype: np.dtype) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", data)
    planes = pa.decompress(memoryview(data)[8:], decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n)


# --- Alignment --------------------------------------------------------------------------------------


class Alignment:
    """Several documents aligned at once: the ids of each behind those of the one before.

    Both sides have a document's bytes, so ends counted over all documents meet at the documents'
    ends. ``last_a`` and ``last_b`` are the places of the tokens that end together: the links.
    """

    def __init__(self, both: Tokens, a: list[np.ndarray], b: list[np.ndarray]) -> None:
        self.both, self.docs_a, self.docs_b = both, np.cumsum([0, *map(len, a)]), np.cumsum([0, *map(len, b)])
        self.a, self.b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        ends_a, ends_b = np.cumsum(both.lengths_a[self.a]), np.cumsum(both.lengths_b[self.b])
        at = np.searchsorted(ends_a, ends_b)
        self.last_b = np.flatnonzero(ends_a[at] == ends_b)
        self.last_a = at[self.last_b]
        # Links before each document's end: each document ends in one.
        self.docs_links = np.searchsorted(self.last_a, self.docs_a)

    def pairs(self) -> np.ndarray:
        """The pair of each link as one number."""
        return self.a[self.last_a] * self.both.size_b + self.b[self.last_b]

    def digests(self) -> list[str]:
        """The hash of each document's groups, ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b, size_a, size_b = len(self.a), len(self.b), self.both.size_a, self.both.size_b
        ends_a, ends_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        ends_a[self.last_a], ends_b[self.last_b] = 1, 1
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        before_b, after_a = np.concatenate([[0], self.last_b + 1]), self.last_a + 1
        ends_b[self.docs_b[1:] - 1] = 2
        order = np.empty(n_a + n_b, np.int64)
        order[np.arange(n_a) + before_b[group_a]] = self.a + size_a * ends_a
        order[np.arange(n_b) + after_a[group_b]] = self.b + size_b * ends_b + 2 * size_a
        found = self.both.written.take(pa.array(order))
        cuts = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1][self.docs_a + self.docs_b]
        data = memoryview(found.buffers()[2])
        return [hashlib.sha256(data[start:end]).hexdigest() for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


# --- First pass: documents into ids and pairs -------------------------------------------------------

# kind: doc (ids of one), pairs (distinct pairs of a block, with their numbers).
_FIRST = "kind string, block long, doc_id long, a binary, b binary, keys binary, counts binary"
_FIRST_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("doc_id", pa.int64())] + [(name, pa.binary()) for name in ("a", "b", "keys", "counts")])


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its counts added up."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return found, total


def _slices(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes together stay near SLICE_BYTES."""
    start, held, k = 0, 0, 0
    for k, size in enumerate(sizes, 1):
        held += size
        if held >= SLICE_BYTES:
            yield start, k
            start, held = k, 0
    if start < k:
        yield start, k


def _first(batches: Iterable[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    both, block, held = tokens(path_a, path_b), TaskContext.get().partitionId() << 32, 0
    keys, counts = [], []

    def closed() -> Iterator[pa.RecordBatch]:
        if keys:
            found, total = _merged(keys, counts)
            yield pa.RecordBatch.from_pylist([{"kind": "pairs", "block": block, "keys": found.tobytes(), "counts": total.tobytes()}], _FIRST_ARROW)

    for batch in steps(batches, "text"):
        docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for start, end in _slices(len(text or "") for text in texts):
            some = [text for text in texts[start:end] if text]
            found = iter(both.encode(some)) if some else iter(())
            ids = [next(found) if text else None for text in texts[start:end]]
            there = [pair for pair in ids if pair]
            if there:
                pair_keys, n = np.unique(Alignment(both, *map(list, zip(*there, strict=True))).pairs(), return_counts=True)
                keys.append(pair_keys)
                counts.append(n)
            rows = [
                {"kind": "doc", "block": block, "doc_id": doc, "a": pair and folded(pair[0]), "b": pair and folded(pair[1])} for doc, pair in zip(docs[start:end], ids, strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, _FIRST_ARROW)
            held += sum(len(text) for text in some)
            if held >= BLOCK_BYTES:
                yield from closed()
                block, held, keys, counts = block + 1, 0, [], []
    yield from closed()


# --- The minimal perfect hash -----------------------------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each key; one to one for a seed."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys, 0) % np.uint64(shards)).astype(np.int64)


class PerfectHash:
    """Gives n distinct keys the numbers 0 to n - 1.

    Each level is a field of twice as many bits as it has keys: a bit is set where one key alone
    falls, the other keys go to the next level. A key's number is that of set bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels, self.before, n = levels, [], 0
        for bits in levels:
            self.before.append(n + np.cumsum(bits, dtype=np.int64) - bits)
            n += int(bits.sum())
        self.n = n

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            at = (mixed(left, len(levels) + 1) % np.uint64(2 * len(left))).astype(np.int64)
            falls = np.bincount(at, minlength=2 * len(left))
            levels.append((falls == 1).astype(np.uint8))
            left = left[falls[at] != 1]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; of another key any number or -1, so what is stored there must be compared."""
        numbers, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self.before, strict=True), 1):
            at = (mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            here = bits[at] == 1
            numbers[left[here]] = before[at[here]]
            left = left[~here]
        return numbers

    def tobytes(self) -> bytes:
        """Number of levels, bits of each, then their fields, eight bits a byte."""
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return sizes + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def frombytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", n, 8).tolist(), 8 * (n + 1), []
        for size in sizes:
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size))
            at += width
        return cls(levels)


class Shard:
    """A part of the dictionary: its hash and, by number, its keys and their counts."""

    def __init__(self, hashed: bytes, keys: bytes, counts: bytes | None) -> None:
        self.hash, self.keys = PerfectHash.frombytes(hashed), np.frombuffer(keys, "<i8")
        self.counts = None if counts is None else np.frombuffer(counts, "<i8")

    def number(self, keys: np.ndarray) -> np.ndarray:
        numbers = self.hash.number(keys)
        if (numbers < 0).any() or not np.array_equal(self.keys[numbers], keys):
            raise ValueError("a pair is not in the dictionary")
        return numbers


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys in batch.column("keys"):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_buffer(), "<i8"))], names=["key"])


def _with_shard(batches: Iterable[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(shard_of(keys, shards))], names=["key", "shard"])


def _built(table: pa.Table) -> pa.Table:
    """One shard's hash and its keys by number. A shard has SHARD_KEYS keys on average, evenly mixed."""
    keys = np.sort(table.column("key").to_numpy())
    found = PerfectHash.of(keys)
    placed = np.empty(len(keys), "<i8")
    placed[found.number(keys)] = keys
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "hashed": pa.array([found.tobytes()], pa.binary()), "keys": pa.array([placed.tobytes()], pa.binary())})


# --- Blocks and shards meet -------------------------------------------------------------------------

# One row type for a shard (own = 0) and what a block has of it (own = 1), so that both come in order.
_MEET = "shard long, copy long, own int, block long, hashed binary, keys binary, counts binary"
_MEET_ARROW = pa.schema([("shard", pa.int64()), ("copy", pa.int64()), ("own", pa.int32()), ("block", pa.int64())] + [(name, pa.binary()) for name in ("hashed", "keys", "counts")])


def _split(batches: Iterable[pa.RecordBatch], shards: int, copies: int) -> Iterator[pa.RecordBatch]:
    """A block's pairs by shard."""
    for batch in batches:
        for row in batch.to_pylist():
            keys, counts = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["counts"], "<i8")
            shard = shard_of(keys, shards)
            order = np.argsort(shard, kind="stable")
            keys, counts, cuts = keys[order], counts[order], np.searchsorted(shard[order], np.arange(shards + 1))
            copy = int(mixed(np.array([row["block"]]), 1)[0] % np.uint64(copies))
            yield pa.RecordBatch.from_pylist(
                [
                    {"shard": k, "copy": copy, "own": 1, "block": row["block"], "keys": keys[start:end].tobytes(), "counts": counts[start:end].tobytes()}
                    for k, (start, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                    if start < end
                ],
                _MEET_ARROW,
            )


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, Shard | None]]:
    """Rows of blocks with their shard; the shard itself comes first, with None."""
    shard = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if not row["own"]:
                shard = Shard(row["hashed"], row["keys"], row["counts"])
                yield row, None
            else:
                yield row, shard


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A copy's dense vector: the numbers of all its blocks, each at its pair's place."""

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"shard": at["shard"], "copy": at["copy"], "counts": total.tobytes()}], _VECTOR_ARROW)

    at = total = None
    for meeting, shard in _meetings(batches):
        if shard is None:
            if at is not None:
                yield row()
            at, total = meeting, np.zeros(len(meeting["keys"]) // 8, "<i8")
            continue
        total[shard.number(np.frombuffer(meeting["keys"], "<i8"))] += np.frombuffer(meeting["counts"], "<i8")
    if at is not None:
        yield row()


_VECTOR = "shard long, copy long, counts binary"
_VECTOR_ARROW = pa.schema([("shard", pa.int64()), ("copy", pa.int64()), ("counts", pa.binary())])


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(counts.as_buffer(), "<i8") for counts in table.column("counts")], axis=0, dtype="<i8")
    first = table.slice(0, 1)
    return pa.table({"shard": first.column("shard"), "copy": first.column("copy"), "counts": pa.array([total.tobytes()], pa.binary())})


def _highest(batches: Iterable[pa.RecordBatch], size_b: int) -> Iterator[pa.RecordBatch]:
    """The highest count of each second id within a shard."""
    for batch in batches:
        for row in batch.to_pylist():
            of, best = np.frombuffer(row["keys"], "<i8") % size_b, np.zeros(size_b, np.int64)
            np.maximum.at(best, of, np.frombuffer(row["counts"], "<i8"))
            there = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(best[there])], names=["b", "n"])


def _answered(batches: Iterable[pa.RecordBatch], best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's pairs with their corpus-wide counts, negative where they are their second id's highest."""
    for row, shard in _meetings(batches):
        if shard is not None:
            keys = np.frombuffer(row["keys"], "<i8")
            counts = shard.counts[shard.number(keys)]
            signed = np.where(counts == best[keys % len(best)], -counts, counts)
            yield pa.RecordBatch.from_pylist([{"kind": "pairs", "block": row["block"], "keys": keys.tobytes(), "counts": signed.tobytes()}], _FIRST_ARROW)


# --- Second pass ------------------------------------------------------------------------------------

_RESULT_ARROW = pa.schema([(name, pa.int64()) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])


def _second(batches: Iterable[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """A block's answers, then its documents: aligned again, with the counts of their links."""
    both, block, keys, counts, ready = tokens(path_a, path_b), None, [], [], False
    for batch in batches:
        for start, end in _slices(4 * struct.unpack_from("<Q", a.as_buffer())[0] if a.is_valid else 0 for a in batch.column("a")):
            rows = batch.slice(start, end - start).to_pylist()
            while rows:
                if rows[0]["block"] != block:
                    block, keys, counts, ready = rows[0]["block"], [], [], False
                n = next((k for k, row in enumerate(rows) if row["block"] != block), len(rows))
                here, rows = rows[:n], rows[n:]
                for row in here:
                    if row["kind"] == "pairs":
                        keys.append(np.frombuffer(row["keys"], "<i8"))
                        counts.append(np.frombuffer(row["counts"], "<i8"))
                docs = [row for row in here if row["kind"] == "doc"]
                if docs and not ready:
                    known, signed = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, counts))
                    order, ready = np.argsort(known), True
                    known, signed, keys, counts = known[order], signed[order], [], []
                if docs:
                    yield _results(both, docs, known, signed)


def _results(both: Tokens, docs: list[dict], known: np.ndarray, signed: np.ndarray) -> pa.RecordBatch:
    rows = [{"doc_id": row["doc_id"], **dict.fromkeys(_RESULT_ARROW.names[1:-1], 0), "groups_sha256": ""} for row in docs]
    there = [k for k, row in enumerate(docs) if row["a"]]
    if there:
        aligned = Alignment(both, *([unfolded(docs[k][side], both.ids) for k in there] for side in "ab"))
        pairs = aligned.pairs()
        at = np.searchsorted(known, pairs)
        if not np.array_equal(known[at], pairs):
            raise ValueError("a document's pair is not among its block's")
        found, cuts = signed[at], aligned.docs_links
        best, total = (np.concatenate([[0], np.cumsum(x)]) for x in (found < 0, np.abs(found)))
        columns = zip(
            there, np.diff(aligned.docs_a).tolist(), np.diff(aligned.docs_b).tolist(), np.diff(cuts).tolist(), np.diff(best[cuts]).tolist(), np.diff(total[cuts]).tolist(), aligned.digests(), strict=True
        )
        for k, n_a, n_b, links, n_best, count_sum, digest in columns:
            # A token has at least a byte, so each group ends in one link.
            rows[k].update(n_a=n_a, n_b=n_b, n_groups=links, n_links=links, n_best=n_best, count_sum=count_sum, groups_sha256=digest)
    return pa.RecordBatch.from_pylist(rows, _RESULT_ARROW)


# --- The operator -----------------------------------------------------------------------------------


def dictionary(pairs: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame, int]:
    """The distinct pairs' shards with their counts, the blocks' pairs by shard, and the number of copies.

    ``pairs`` has a row for each block: its distinct pairs as keys and their numbers as counts.
    """
    keys = stored(pairs.select("keys").mapInArrow(_keys, "key long").distinct(), "align-keys")
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    built = keys.mapInArrow(partial(_with_shard, shards=shards), "key long, shard long").groupBy("shard").applyInArrow(_built, "shard long, hashed binary, keys binary")
    built = stored(built, "align-hash")
    copies = max(1, -(-blocks // BLOCKS_OF_COPY))
    parts = stored(pairs.select("block", "keys", "counts").mapInArrow(partial(_split, shards=shards, copies=copies), _MEET), "align-pairs")
    vectors = meet(built.withColumn("counts", F.lit(None).cast("binary")), parts, copies).mapInArrow(_counted, _VECTOR)
    while True:
        vectors = stored(vectors, "align-sums")
        if copies <= 1:
            break
        vectors = vectors.withColumn("copy", F.floor(F.col("copy") / FAN)).groupBy("shard", "copy").applyInArrow(_added, _VECTOR)
        copies = -(-copies // FAN)
    whole = built.join(vectors.select("shard", "counts"), "shard")
    return whole, parts, max(1, -(-blocks // BLOCKS_OF_COPY))


def meet(shards: DataFrame, parts: DataFrame, copies: int) -> DataFrame:
    """Each copy of a shard followed by the rows of its blocks."""
    copied = shards.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    columns = [F.col("shard"), F.col("copy"), F.lit(0).alias("own"), F.lit(None).cast("long").alias("block"), F.col("hashed"), F.col("keys"), F.col("counts")]
    return copied.select(*columns).unionByName(parts).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "own", "block")


def align(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """RESULT for every row of ``documents`` (doc_id, text; other columns are not read).

    ``path_a`` is a byte-level vocabulary of the tokenizers library, given space + text, ``path_b`` a
    SentencePiece model that puts the space there itself. Texts that are null, empty or changed by a
    vocabulary have no tokens: zeros and an empty hash. Rows are kept one by one, null or repeated
    ids too; an empty table gives an empty result. Memory follows blocks, shards and the longest text.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    first = stored(rows.mapInArrow(partial(_first, path_a=path_a, path_b=path_b), _FIRST), "align-first", "kind")
    pairs, docs = first.filter("kind = 'pairs'"), first.filter("kind = 'doc'")
    size_b = tokens(os.fspath(path_a), os.fspath(path_b)).size_b
    blocks = pairs.count()
    whole, parts, copies = dictionary(pairs, blocks)
    whole = stored(whole, "align-dictionary")
    highest = whole.select("keys", "counts").mapInArrow(partial(_highest, size_b=size_b), "b long, n long").groupBy("b").agg(F.max("n").alias("n"))
    best = np.zeros(size_b, np.int64)
    for row in highest.collect():  # at most one for each id of the vocabulary
        best[row.b] = row.n
    answers = meet(whole, parts, copies).mapInArrow(partial(_answered, best=best), _FIRST)
    tasks = max(1, -(-blocks // BLOCKS_OF_TASK))
    ordered = answers.unionByName(docs).repartition(tasks, "block").sortWithinPartitions("block", F.col("kind").desc())
    return ordered.mapInArrow(partial(_second, path_a=path_a, path_b=path_b), RESULT)
