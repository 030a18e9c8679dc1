"""Packing and token files against plain encodings."""

import io
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeledger.llm import bitpack, packing
from codeledger.llm.common import Encoder
from codeledger.llm.queries import BYTE_BPE, QUERIES


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.encode_special_tokens = True
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def crc(ids):
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def expect_packed(rows, texts, plain, window=1024):
    """Every id in exactly one piece, sequences without gaps, at most a window, none padded."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        pieces[row.doc_id].append(row)
        sequences[row.sequence_id].append(row)
    assert set(pieces) == set(texts)
    for doc, mine in pieces.items():
        ids, at = plain(texts[doc]), 0
        for row in sorted(mine, key=lambda row: row.start):
            assert (row.start, row.doc_tokens, row.ids_crc32) == (at, len(ids), crc(ids[at : at + row.length]))
            at += row.length
        assert at == len(ids)
    for mine in sequences.values():
        at = 0
        for row in sorted(mine, key=lambda row: row.offset):
            assert row.offset == at
            at += row.length
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_packing(spark, sf_dir, documents, plain):
    rows = QUERIES["op8_packing"](spark, sf_dir).collect()
    expect_packed(rows, {row.doc_id: row.text for row in documents.collect()}, plain)


def test_packing_of_odd_rows(odd_documents, no_documents, plain):
    unique = odd_documents.dropDuplicates(["doc_id", "text"])
    expect_packed(packing.pack(unique, BYTE_BPE, 64).collect(), {row.doc_id: row.text for row in unique.collect()}, plain, 64)
    assert packing.pack(odd_documents, BYTE_BPE).filter("doc_id = 3 AND start = 0").count() == 3
    assert packing.pack(no_documents, BYTE_BPE).count() == 0


def least_squares_level(count, n, window):
    """Brute force: the sum of squares after each possible move; of equals the fullest level."""
    best = None
    for level in range(window - n, -1, -1):
        if level and not count[level]:
            continue
        after = count.copy()
        if level:
            after[level] -= 1
        if level + n < window:
            after[level + n] += 1
        key = int((after * after).sum())
        if best is None or key < best[0]:
            best = key, level
    return best[1]


@given(st.lists(st.integers(1, 15), max_size=60))
@settings(max_examples=60, deadline=None)
def test_level_has_least_sum_of_squares(sizes):
    levels = packing.SumOfSquares(16)
    for k, n in enumerate(sizes):
        assert levels.level(n) == least_squares_level(levels.count, n, 16)
        levels.place((k, 0, np.zeros(n, "<u4"), n))
        assert [len(x) for x in levels.open] == levels.count.tolist()


@given(st.lists(st.integers(1, 70), max_size=40))
@settings(max_examples=60, deadline=None)
def test_windows_hold_every_id_once(sizes):
    found = list(packing.windows(((k, np.full(n, k, "<u4")) for k, n in enumerate(sizes)), 16))
    totals = [sum(len(ids) for _, _, ids, _ in pieces) for pieces in found]
    assert all(n == 16 or n & (n - 1) == 0 and n < 16 for n in totals) and sum(n != 16 for n in totals) <= 4
    starts = sorted((doc, start + k) for pieces in found for doc, start, ids, _ in pieces for k in range(len(ids)))
    assert starts == [(doc, k) for doc, n in enumerate(sizes) for k in range(n)]


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_chunks_give_the_ids_of_the_whole_text(plain_encoder, text):
    encoder, tokenizer = plain_encoder
    text = text.encode("utf-8", "replace").decode()
    assert encoder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def plain_encoder():
    encoder = Encoder(BYTE_BPE)
    return encoder, encoder.tokenizer


@pytest.mark.parametrize("text", ["a  b", "  a", "a ", "a \n b", "a  b", "  x", "don't  we're", "a\x1c b", "x\n\n y  \n"])
def test_spaces_in_a_row(plain_encoder, text):
    encoder, tokenizer = plain_encoder
    assert encoder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_new_words_go_to_the_library_together_and_known_ones_not_at_all(monkeypatch):
    encoder = Encoder(BYTE_BPE)
    tokenizer, given = encoder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    # Each word once after a space and once at the start of a line; é has two bytes.
    texts = ["\n".join(f"wé{k}x it's, wé{k}x. 'sé{k}" for k in range(start, start + 500)) for start in (0, 500)]
    expected = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert [ids.tolist() for ids in encoder.encode(texts)] == expected
    assert len(given) <= 4
    assert [ids.tolist() for ids in encoder.encode(texts)] == expected
    assert len(given) <= 4
    # The older half of what is remembered is found, too, and what is in neither is learned again.
    monkeypatch.setattr("codeledger.llm.common.REMEMBERED_BYTES", 1000)
    for some in (texts[:1], texts[1:], texts, texts[:1]):
        assert [ids.tolist() for ids in encoder.encode(some)] == [expected[texts.index(text)] for text in some]


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(max_examples=100, deadline=None)
def test_bits_round_trip(bits, ids):
    ids = np.array([k % (1 << bits) for k in ids], "<u4")
    data = bitpack.pack_bits(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert bitpack.unpack_bits(data, bits, len(ids)).tolist() == ids.tolist()


def test_fewest_bits():
    assert [bitpack.bits_for(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]
    with pytest.raises(ValueError):
        bitpack.pack_bits(np.array([4], "<u4"), 2)


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_random_access():
    out, made = io.BytesIO(), np.random.default_rng(1)
    writer, texts = bitpack.Writer(out, 13), [made.integers(0, 1 << 13, n).astype("<u4") for n in (0, 3, 9000, 1, 20_000, 8191)]
    for k, ids in enumerate(texts):
        writer.add(None if k == 3 else k, ids)
    writer.close()
    reader, whole = bitpack.Reader(_File(out.getvalue())), np.concatenate(texts)
    assert reader.docs == [0, 1, 2, None, 4, 5]
    assert all(reader.document(k).tolist() == ids.tolist() for k, ids in enumerate(texts))
    for first, end in ((0, 1), (8190, 8195), (8192, 16384), (37_000, len(whole)), (5, 5)):
        assert reader.ids(first, end).tolist() == whole[first:end].tolist()
    with pytest.raises(ValueError):
        bitpack.Reader(_File(out.getvalue()[:-1] + b"x"))


def test_token_files(spark, sf_dir, documents, plain):
    at = 0
    got = {row.doc_id: row for row in QUERIES["op5_token_files"](spark, sf_dir).collect()}
    for row in documents.orderBy("doc_id").collect():
        ids = plain(row.text)
        assert tuple(got[row.doc_id]) == (row.doc_id, at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == documents.count()


def test_token_files_of_odd_rows(odd_documents, no_documents, plain):
    rows = sorted(bitpack.token_files(odd_documents, BYTE_BPE).collect(), key=lambda row: row.start)
    assert [row.doc_id for row in rows] == [None, 0, 1, 2, 3, 3, 3, *range(4, 14)]
    assert [row.start for row in rows] == np.cumsum([0, *(row.n_tokens for row in rows)])[:-1].tolist()
    assert rows[1].n_tokens == 1 and rows[1].ids_crc32 == crc(plain(None))
    assert bitpack.token_files(no_documents, BYTE_BPE).count() == 0


def test_vocabulary_is_a_parameter():
    assert BYTE_BPE == public_tokenizers.path("byte_bpe_50k.json")
