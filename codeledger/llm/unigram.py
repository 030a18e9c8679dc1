"""Unigram encoding: the best-scored cut of a text into pieces, by Viterbi over a double-array trie."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeledger.llm.common import ship_package, steps, working

SCHEMA = "doc_id long, ids array<int>, n_ids long, n_bytes long, score double, round_trip boolean"
#: Fixed values of the format: the mark that stands for a space, and what an unknown character costs below the worst piece.
MARK = "▁"
UNKNOWN_COST = 10.0
#: Parts of a text up to so many bytes are cut all at once, longer ones each for itself.
SHORT = 64


class DoubleArray:
    """A trie of byte strings in two arrays: node n has a child by byte b where check[base[n] + b] == n."""

    def __init__(self, keys: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for number, key in enumerate(keys):
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                node = children[node][byte]
            ends[node] = number
        size = len(children) + 512
        base, check, value = [0] * size, [-1] * size, [-1] * size
        slot = [0] * len(children)
        check[0], free, crowded = 0, 257, 257  # above 256, any byte fits below; crowded: where nodes of several children are tried from, so that none is tried twice
        value[0] = ends.get(0, -1)
        for node, below in enumerate(children):  # a node comes after its parent
            if not below:
                continue
            low = min(below)
            at = free if len(below) == 1 else crowded
            while True:
                start = at - low
                while start + 256 >= len(check):
                    more = len(check)
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                if all(check[start + byte] < 0 for byte in below):
                    break
                at += 1
            base[slot[node]] = start
            if len(below) > 1:
                crowded = max(crowded, at)
            for byte, child in below.items():
                slot[child] = start + byte
                check[start + byte] = slot[node]
                value[start + byte] = ends.get(child, -1)
            while free < len(check) and check[free] >= 0:
                free += 1
        self.base, self.check, self.value = base, check, value
        self.arrays = tuple(np.array(column, np.int32) for column in (base, check, value))

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, number) of each key that begins at one of ``starts`` and ends by its end: all walk down at once."""
        base, check, value = self.arrays
        node, found, length = np.zeros(len(starts), np.int32), [(starts[:0], starts[:0], starts[:0])], 0
        while len(starts):
            going = (starts + length < ends) & (base[node] > 0)
            starts, ends, node = starts[going], ends[going], node[going]
            child = base[node] + data[starts + length]
            going = check[child] == node
            starts, ends, node = starts[going], ends[going], child[going]
            length += 1
            at = np.flatnonzero(value[node] >= 0)
            found.append((starts[at], np.full(len(at), length), value[node[at]]))
        return tuple(np.concatenate(column) for column in zip(*found, strict=True))

    def prefixes(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, number) of each key that the data have at ``start``."""
        base, check, value, node = self.base, self.check, self.value, 0
        for at in range(start, len(data)):
            child = base[node] + data[at]
            # Only an inner node has a base above 0, and only its children bear its number.
            if not base[node] or check[child] != node:
                return
            node = child
            if value[node] >= 0:
                yield at + 1, value[node]


class Unigram:
    """Pieces with log scores; characters that no piece covers fall back to their bytes."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], ids: list[int]) -> None:
        """pieces: text and score; ids: the id of each; byte_ids: the id of each of the 256 bytes."""
        texts = [text.encode("utf-8", "surrogatepass") for text, _ in pieces]
        self.trie = DoubleArray(texts)
        self.scores, self.ids, self.byte_ids = [score for _, score in pieces], ids, byte_ids
        self.unknown = min(self.scores, default=0.0) - UNKNOWN_COST
        of = {k: bytes([byte]) for byte, k in enumerate(byte_ids)} | dict(zip(ids, texts, strict=True))
        self.bytes_of = pa.array([of.get(k, b"") for k in range(max(of, default=-1) + 1)], pa.large_binary())
        self.score_of, self.id_of, self.byte_id_of = np.array(self.scores), np.array(ids, "<i4"), np.array(byte_ids, "<i4")
        # Whether a mark always begins a piece: no piece has one after another character.
        self.cuts = all(MARK not in text.lstrip(MARK) for text, _ in pieces)

    def viterbi(self, text: str) -> tuple[list[int], float, int]:
        """Ids, score and number of byte ids of the best cut; of equals the one whose last piece is longest.

        A character that begins no piece of its own costs ``unknown`` and gives its bytes.
        """
        data = text.encode("utf-8", "surrogatepass")
        n, worst = len(data), float("-inf")
        best, back, number = [worst] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], scores, at = 0.0, self.scores, 0
        base, check, value, unknown = self.trie.base, self.trie.check, self.trie.value, self.unknown
        while at < n:
            lead = data[at]
            step = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            so_far, single = best[at], False  # every character is reachable
            node, end = 0, at
            # The walk of DoubleArray.prefixes, written out, as it is most of the work.
            while end < n and (below := base[node]):
                child = below + data[end]
                if check[child] != node:
                    break
                node, end = child, end + 1
                piece = value[node]
                if piece >= 0:
                    total = so_far + scores[piece]
                    single = single or end == step
                    if total > best[end]:
                        best[end], back[end], number[end] = total, at, piece
            if not single and so_far + unknown > best[step]:
                best[step], back[step], number[step] = so_far + unknown, at, -1
            at = step
        out: list[int] = []
        bytes_, at = 0, n
        while at:
            if number[at] >= 0:
                out.append(self.ids[number[at]])
            else:
                raw = data[back[at] : at]
                bytes_ += len(raw)
                out.extend(self.byte_ids[byte] for byte in reversed(raw))
            at = back[at]
        return out[::-1], best[n], bytes_

    def cut_all(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``viterbi`` of many short byte strings at once, which lie one after the other and end at ``ends``.

        Returns all ids, and of each string their number, the score and the number of byte ids. A step
        takes the pieces of one length that begin at one distance from the start of their strings.
        """
        starts = np.append(0, ends[:-1])
        lengths = ends - starts
        first, last = np.repeat(starts, lengths), np.repeat(ends, lengths)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
        start, length, number = self.trie.matches(data, at, last[at])
        # A character that is no piece is taken as its bytes.
        width = np.diff(np.append(at, len(data)))
        single = np.zeros(len(data), bool)
        whole = np.zeros(len(data), np.int64)
        whole[at] = width
        single[start[length == whole[start]]] = True
        lone = ~single[at]
        start, length = np.concatenate([start, at[lone]]), np.concatenate([length, width[lone]])
        number = np.concatenate([number, np.full(int(lone.sum()), -1, number.dtype)])
        gain = np.where(number >= 0, self.score_of[number] if len(self.score_of) else 0.0, self.unknown)
        step = ((start - first[start]) * (SHORT + 1) + length).astype(np.int16)
        order = np.argsort(step, kind="stable")
        start, length, number, gain, step = start[order], length[order], number[order], gain[order], step[order]
        # Strings have a place more than bytes: place p of string k is at p + k.
        shift = np.repeat(np.arange(len(ends)), lengths)
        best, back, chosen = np.full(len(data) + len(ends), -np.inf), np.zeros(len(data) + len(ends), np.int64), np.full(len(data) + len(ends), -1, np.int64)
        best[starts + np.arange(len(ends))] = 0.0
        source = start + shift[start]
        target = source + length
        bounds = np.append(np.flatnonzero(np.diff(step, prepend=-1)), len(step))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            to = target[low:high]
            total = best[source[low:high]] + gain[low:high]
            better = np.flatnonzero(total > best[to])
            to = to[better]
            best[to], back[to], chosen[to] = total[better], source[low:high][better], number[low:high][better]
        # From the ends back: which piece or character begins at each byte of the best cut.
        taken, size = np.full(len(data), -2, np.int64), np.zeros(len(data), np.int64)
        here, string = ends + np.arange(len(ends)), np.arange(len(ends))
        origin = starts + string
        score = best[here]
        while len(here):
            came = back[here]
            taken[came - string], size[came - string] = chosen[here], here - came
            going = came > origin[string]
            here, string = came[going], string[going]
        where = np.flatnonzero(taken > -2)
        piece = taken[where]
        count = np.where(piece >= 0, 1, size[where])
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        piece, where_each = np.repeat(piece, count), np.repeat(where, count) + within
        ids = np.where(piece >= 0, self.id_of[piece] if len(self.id_of) else 0, self.byte_id_of[data[where_each]]).astype("<i4")
        of = np.repeat(np.arange(len(ends)), lengths)[where_each]
        return ids, np.bincount(of, minlength=len(ends)), score, np.bincount(of[piece < 0], minlength=len(ends))

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The texts, marked and cut before each run of marks, and the number of parts before each text and in all."""
        wide = partial(pa.scalar, type=pa.large_string())
        text = pc.if_else(pc.equal(pc.binary_length(texts), 0), wide(""), pc.binary_join_element_wise(wide(MARK), pc.replace_substring(texts, " ", MARK), wide("")))
        text = pa.concat_arrays([text.cast(pa.large_binary())])
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        first = np.zeros(len(data) + 1, bool)  # bytes where a part begins, and the end
        first[offsets] = True
        if self.cuts and len(data) > 2:
            mark = np.zeros(len(data) + 3, bool)  # three bytes late
            mark[3:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            first[:-1] |= mark[3:] & ~mark[:-3]
            first[: offsets[0]] = first[offsets[-1] + 1 :] = False
        cuts = np.flatnonzero(first)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), text.buffers()[2]]), np.searchsorted(cuts, offsets)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of texts without nulls, and of each its number of ids, its score and its number of byte ids.

        A space becomes a mark, and a mark is put before a text. Where a mark begins every piece that
        has one, apart from runs of marks, the best cut of a text is that of its parts from one run of
        marks to the next; equal parts are worked out once.
        """
        parts, before = self._parts(texts.cast(pa.large_string()))
        named = parts.dictionary_encode()
        which, distinct = named.indices.to_numpy().astype(np.int64), named.dictionary
        length = pc.binary_length(distinct).to_numpy()
        short, long = np.flatnonzero(length <= SHORT), np.flatnonzero(length > SHORT)
        some = distinct.take(pa.array(short))
        if len(short):
            data = np.frombuffer(some.buffers()[2], np.uint8)[: int(length[short].sum())]
            pool, sizes, scores, bytes_ = self.cut_all(data, np.cumsum(length[short]))
        else:
            pool, sizes, scores, bytes_ = np.zeros(0, "<i4"), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        alone = [self.viterbi(distinct[int(k)].as_py().decode("utf-8")) for k in long]
        pool = np.concatenate([pool, *(np.array(ids, "<i4") for ids, _, _ in alone)])
        place = np.argsort(np.concatenate([short, long]), kind="stable")
        sizes = np.concatenate([sizes, np.array([len(ids) for ids, _, _ in alone], np.int64)])
        begins = (np.cumsum(sizes) - sizes)[place][which]
        scores = np.concatenate([scores, np.array([score for _, score, _ in alone])])[place][which]
        bytes_ = np.concatenate([bytes_, np.array([n for _, _, n in alone], np.int64)])[place][which]
        sizes = sizes[place][which]
        ids = pool[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        total = lambda values: np.diff(np.append(0, np.cumsum(values))[before])
        of = np.repeat(np.arange(len(texts)), np.diff(before))
        return ids, total(sizes), np.bincount(of, scores, len(texts)), total(bytes_)

    def encode(self, text: str) -> tuple[np.ndarray, float, int]:
        """Ids, score and number of byte ids of one text."""
        ids, _, scores, bytes_ = self.encode_all(pa.array([text], pa.large_string()))
        return ids, float(scores[0]), int(bytes_[0])

    def decode_all(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of ids: pieces and bytes in order, marks as spaces, the first mark off."""
        taken = self.bytes_of.take(pa.array(ids))
        ends = np.append(0, np.cumsum(pc.binary_length(taken).to_numpy()))[np.append(0, np.cumsum(lengths))]
        data = b"" if not len(ids) else taken.buffers()[2].to_pybytes()
        texts = (data[start:end].decode("utf-8", "replace").replace(MARK, " ") for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        return [text[1:] if text[:1] == " " else text for text in texts]

    def decode(self, ids: Iterable[int]) -> str:
        some = np.array(list(ids), np.int64)
        return self.decode_all(some, np.array([len(some)]))[0]


def log_scores(scores: list[float]) -> list[float]:
    """Log probabilities of pieces. A unigram vocabulary has them; a byte-pair vocabulary has merge ranks,

    whole numbers from 0 down. A piece's rank is its place by frequency, so it gets the probability that
    Zipf's law gives the place: in proportion to 1 / (rank + 1), summing to one. Nothing is trained.
    """
    if not scores or any(score != int(score) for score in scores):
        return scores
    rank = np.empty(len(scores))
    rank[np.argsort(-np.array(scores), kind="stable")] = np.arange(1, len(scores) + 1)
    return (-np.log(rank) - np.log((1 / rank).sum())).tolist()


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    """The pieces, scores and byte ids of a SentencePiece model file, once for each Python worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    plain = [k for k in range(size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
    byte_ids = [model.piece_to_id(f"<0x{byte:02X}>") for byte in range(256)]
    scores = log_scores([model.get_score(k) for k in plain])
    return Unigram([(model.id_to_piece(k), score) for k, score in zip(plain, scores, strict=True)], byte_ids, plain)


def _encoded(batches: Iterable[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    working("unigram", unigram.cache_clear)
    model = unigram(model_path)
    for batch in steps(batches, "text"):
        texts = pc.fill_null(batch.column("text"), "")
        ids, lengths, scores, bytes_ = model.encode_all(texts)
        same = [back == text for back, text in zip(model.decode_all(ids, lengths), pc.replace_substring(texts, MARK, " ").to_pylist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(ids))
        columns = [batch.column("doc_id"), lists, pa.array(lengths, pa.int64()), pa.array(bytes_, pa.int64()), pa.array(scores), pa.array(same, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_ids", "n_bytes", "score", "round_trip"])


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """The ids of every whole text, their score, how many are single bytes, and whether decoding gives the text back.

    The mark itself in a text comes back as a space, as in the format, and counts as one here. A null
    or empty text has no ids and score 0. Rows stand for themselves: repeated rows and null ids come
    out as they are. Only doc_id and text are read; no shuffle.
    """
    ship_package(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_encoded, model_path=model_path), SCHEMA)
