"""Near-duplicates against all pairs, and components against a plain search."""

import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeledger.llm import components as cc
from codeledger.llm import minhash
from codeledger.llm.queries import QUERIES


def word_sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, words, percent):
    """(doc_id, size, smallest linked id) of each row, all pairs that share a shingle compared."""
    sets = [word_sets(text, words) for _, text in rows]
    at = defaultdict(list)
    for k, members in enumerate(sets):
        for member in members:
            at[member].append(k)
    near = {pair for found in at.values() for pair in combinations(found, 2)}
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in near:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    least = {}
    for k, (doc, _) in enumerate(rows):
        least.setdefault(find(k), []).append(doc)
    least = {k: min((doc for doc in docs if doc is not None), default=None) for k, docs in least.items()}
    return sorted(((doc, len(sets[k]), least[find(k)], doc == least[find(k)]) for k, (doc, _) in enumerate(rows)), key=repr)


def got(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_query(spark, sf_dir, documents):
    assert got(QUERIES["op2_minhash_dedup"](spark, sf_dir)) == brute([(row.doc_id, row.text) for row in documents.collect()], 3, 85)


def test_odd_rows(odd_documents, no_documents):
    likeness = minhash.Likeness()
    assert got(minhash.near_duplicates(odd_documents, likeness)) == brute([(row.doc_id, row.text) for row in odd_documents.collect()], 5, 80)
    assert got(minhash.near_duplicates(no_documents, likeness)) == []


def test_near_copies_without_ids_and_under_one_id(spark):
    base = [f"w{k}" for k in range(120)]
    changed = lambda at: " ".join(base[:at] + ["new"] + base[at + 1 :])
    other = lambda name: " ".join(f"{name}{k}" for k in range(100))
    rows = [(None, changed(3)), (None, changed(60)), (None, other("x")), (7, changed(90)), (7, other("y")), (7, other("z")), (9, other("z") + " more"), (8, other("y") + " more"), (4, other("v")), (4, other("v"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("clash"))
    assert got(minhash.near_duplicates(frame, minhash.Likeness())) == brute(rows, 5, 80)


@pytest.mark.parametrize("small", [1, 16])
def test_chain_and_large_group(spark, monkeypatch, small):
    """Each text is like its neighbours only, so no leader is like all; and one with many exact and near copies."""
    monkeypatch.setattr(minhash, "PAIRS_LEFT", 0)
    for name, value in {"MEMBERS": 16, "SMALL": small, "BLOCK": 7}.items():
        monkeypatch.setattr(minhash, name, value)
    words = [f"w{k}" for k in range(400)]
    chain = [(k, " ".join(words[6 * k : 6 * k + 200])) for k in range(20)]
    copies = [(100 + k, " ".join([*(f"c{i}" for i in range(150)), f"own{k % 40}"])) for k in range(120)]
    rows = [*chain, *copies, (900, "c1 c2 c3 alone")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(minhash.near_duplicates(frame, minhash.Likeness(words=3, percent=85))) == brute(rows, 3, 85)


def test_rows_with_one_id_stand_alone(spark):
    rows = [(7, "a b c d e f g"), (7, "h i j k l m n"), (9, "h i j k l m n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(frame, minhash.Likeness())) == [(7, 3, 7, True), (7, 3, 7, True), (9, 3, 7, False)]


def test_coordinates_are_shifts_of_one_permutation():
    """Coordinate k is the least of the permutation at the set's places, shifted by k."""
    members = np.sort(np.random.default_rng(3).integers(0, 2**63, 50).astype(np.uint64))
    order = np.random.default_rng(minhash.SEED).permutation(1 << minhash.POSITION_BITS)
    places = (members >> np.uint64(64 - minhash.POSITION_BITS)).astype(np.int64)
    expected = [order[(places + k) % len(order)].min() for k in range(16)]
    assert minhash.signature(members, 16).tolist() == expected


def test_equal_coordinates_estimate_likeness():
    made = np.random.default_rng(5)
    pool = np.unique(made.integers(0, 2**63, 3000).astype(np.uint64) << np.uint64(1))
    left, right = pool[:2000], pool[200:2200]
    same = minhash.signature(left, 512) == minhash.signature(right, 512)
    assert abs(same.mean() - 1800 / 2200) < 0.06


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_bands_find_the_threshold(percent):
    bands, length = minhash.Likeness(percent=percent).bands()
    assert bands * length <= 128 and (1 - (percent / 100) ** length) ** bands <= 1e-4


@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.integers(1, 100))
@settings(max_examples=200, deadline=None)
def test_alike(left, right, percent):
    expected = bool(left and right) and 100 * len(left & right) >= percent * len(left | right)
    assert minhash.alike(np.array(sorted(left), np.uint64), np.array(sorted(right), np.uint64), percent) == expected


def test_components(spark):
    made = np.random.default_rng(2)
    links = [tuple(map(int, pair)) for pair in made.integers(0, 150, (110, 2))] + [(1000 + k, 1001 + k) for k in range(30)] + [(5, 5)]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    alone = {a for a in root if all(a not in pair or pair[0] == pair[1] for pair in links)}
    found = cc.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted((a, b) for a, b in root.items() if a not in alone)
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0
