import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codeledger.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [" lead", "a  b \n", "▁a", "日本語 ☃😀", "<|endoftext|> <s> <0x41>", "x" * 3000, "ﬁ\x00y", "tab\t\x85 é é", "same text here", "same text here"]


def plainly(texts):
    """Each text's result by sets and dictionaries, straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    entries, letters = {k: token for token, k in first.get_vocab().items()}, align.byte_letters()
    pieces = lambda k: bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode()

    def ends(ids, of):
        total, found = 0, {}
        for n, k in enumerate(ids):
            total += len(of(k))
            found[total] = n
        return found

    aligned, counts = [], Counter()
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        of_a = lambda k: bytes(letters[c] for c in entries[k])
        if not text or not (b"".join(map(of_a, a)) == b"".join(map(pieces, b)) == f" {text}".encode()):
            aligned.append(None)
            continue
        ends_a, ends_b = ends(a, of_a), ends(b, pieces)
        links, groups, from_a, from_b = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            to_a, to_b = ends_a[end] + 1, ends_b[end] + 1
            links.append((a[to_a - 1], b[to_b - 1]))
            groups.append(",".join(map(str, a[from_a:to_a])) + "|" + ",".join(map(str, b[from_b:to_b])))
            from_a, from_b = to_a, to_b
        counts.update(links)
        aligned.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    none = (0,) * 6 + ("",)
    return [found and (*found[:3], len(found[3]), sum(counts[x] == highest[x[1]] for x in found[3]), sum(counts[x] for x in found[3]), found[4]) or none for found in aligned]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_plain_dictionaries(spark, documents, odd_documents, small, monkeypatch):
    if small:  # many shards, copies of them, and several rounds of sums
        for name, value in (("SHARD_KEYS", 300), ("BLOCKS_OF_COPY", 2), ("FAN", 2)):
            monkeypatch.setattr(align, name, value)
    given = spark.createDataFrame([(10**9 + k, text) for k, text in enumerate(TEXTS)], "doc_id long, text string")
    rows = documents.select("doc_id", "text").unionByName(given).unionByName(odd_documents.select("doc_id", "text")).withColumn("block", F.lit("clash"))
    found = align.align(rows.repartition(9), A, B).collect()
    local = rows.collect()
    wanted = sorted(zip([row.doc_id for row in local], plainly([row.text for row in local]), strict=True), key=str)
    assert sorted(((row.doc_id, tuple(row)[1:]) for row in found), key=str) == wanted


def test_no_documents(no_documents):
    assert align.align(no_documents, A, B).collect() == []


def test_only_documents_without_tokens(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string")
    assert {tuple(row) for row in align.align(rows, A, B).collect()} == {(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, None)}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_numbers_all_keys_once(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False)
    found = align.PerfectHash.frombytes(align.PerfectHash.of(keys).tobytes())
    assert sorted(found.number(keys).tolist()) == list(range(n))
    assert found.n == n


def test_a_foreign_key_is_noticed():
    keys = np.arange(100, dtype="<i8")
    hashed = align.PerfectHash.of(keys)
    placed = np.empty(100, "<i8")
    placed[hashed.number(keys)] = keys
    shard = align.Shard(hashed.tobytes(), placed.tobytes(), None)
    assert np.array_equal(placed[shard.number(keys)], keys)
    with pytest.raises(ValueError, match="dictionary"):
        shard.number(np.array([12345]))
