"""Near-duplicates by circulant MinHash: two permutations make all coordinates; links are confirmed on whole sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeledger.llm.common import ship_package, steps, stored, working
from codeledger.llm.components import components

#: Positions that the permutations act on, and the seed of the second; the first is a hash of the shingles.
POSITION_BITS, SEED = 22, 20240229
#: Shingles whose rows of the circulant matrix are gathered at once.
GATHERED = 8192
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
#: Members that a leader's text is compared with in one task.
MEMBERS = 256
#: When buckets have no more pairs than so many for each of their members, they are compared without leaders.
PAIRS_LEFT = 4
#: Buckets of up to so many members are compared pair by pair, larger ones by blocks of so many members.
SMALL, BLOCK = 16, 256
#: What a text with words has: a character that is none of the white space of ``shingles``.
WORDED = r"[^\x09-\x0D ]"
_SKETCHED = "doc_id long, mark long, n_shingles long, class binary, bands array<long>"


@dataclass(frozen=True)
class Likeness:
    """Words of a shingle, and the percentage of a pair's shingles that both must have."""

    words: int = 5
    percent: int = 80
    coordinates: int = 128
    #: The chance that a pair right at the threshold shares no band.
    missed: float = 1e-4

    def bands(self) -> tuple[int, int]:
        """(bands, coordinates of a band): the longest bands by which a pair at the threshold is still found."""
        level = self.percent / 100
        fit = [(self.coordinates // r, r) for r in range(1, self.coordinates + 1) if (1 - level**r) ** (self.coordinates // r) <= self.missed]
        return max(fit, key=lambda x: x[1], default=(self.coordinates, 1))


@lru_cache(maxsize=2)
def _circulant(coordinates: int) -> np.ndarray:
    """Row p: the second permutation at p and the places after it, that is, shifted by 0, 1, 2 and so on."""
    order = np.random.default_rng(SEED).permutation(1 << POSITION_BITS).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:coordinates]]), coordinates)


_words: dict[bytes, int] = {}


def _forget() -> None:
    _words.clear()
    _circulant.cache_clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as ascending hashes of 64 bits.

    A-Z are lower-cased; words are what stands between spaces and U+0009 to U+000D. A text with fewer
    words than a shingle has its whole sequence as one; without words there is none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    for word in set(found).difference(_words):
        _words[word] = xxhash.xxh3_64_intdigest(word)
    hashes = np.array(list(map(_words.__getitem__, found)), np.uint64)
    n = min(words, len(hashes))
    rolled = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k])
    return np.unique(rolled)


def signature(members: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k: the least value of the second permutation, shifted by k, over the set's places in the first."""
    matrix, places = _circulant(coordinates), (members >> np.uint64(64 - POSITION_BITS)).astype(np.int64)
    out = np.full(coordinates, np.iinfo(np.int32).max, np.int32)
    for first in range(0, len(places), GATHERED):
        np.minimum(out, matrix[places[first : first + GATHERED]].min(axis=0), out=out)
    return out


def band_hashes(coordinates: np.ndarray, bands: int, length: int) -> np.ndarray:
    rolled = np.arange(1, bands + 1, dtype=np.uint64)
    for column in coordinates[: bands * length].reshape(bands, length).T.astype(np.uint64):
        rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + column)
    return rolled.view(np.int64)


def alike(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """100 * common >= percent * all, on ascending sets; empty sets are like nothing."""
    small, large = sorted((len(left), len(right)))
    if not small or 100 * small < percent * large:
        return False
    both = np.sort(np.concatenate([left, right]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (small + large - common)


def _sketched(batches: Iterable[pa.RecordBatch], likeness: Likeness) -> Iterator[pa.RecordBatch]:
    working("shingles", _forget)
    bands, length = likeness.bands()
    for batch in steps(batches, "text"):
        sizes, classes, hashes, last = [], [], [], (None, None, None)
        for text in batch.column("text").to_pylist():
            members = shingles(text, likeness.words)
            sizes.append(len(members))
            if len(members):
                name = xxhash.xxh3_128_digest(members.tobytes())
                if name != last[0]:  # copies often stand together
                    last = (name, band_hashes(signature(members, likeness.coordinates), bands, length))
                classes.append(name)
                hashes.append(last[1])
            else:
                classes.append(None)
                hashes.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "mark", "n_shingles", "class", "bands"]
        )


def _verified(batches: Iterable[pa.RecordBatch], likeness: Likeness) -> Iterator[pa.RecordBatch]:
    """Rows in order of leader and salt, each leader's text before those of its members."""
    working("shingles", _forget)
    leader, members = None, np.zeros(0, np.uint64)
    for batch in steps(batches, "text"):
        out = []
        for row in batch.to_pylist():
            own = shingles(row["text"], likeness.words)
            if row["member"] is None:
                leader, members = row["leader"], own
            elif row["leader"] == leader and alike(members, own, likeness.percent):
                out.append((row["member"], leader))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], names=["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame, likeness: Likeness) -> DataFrame:
    """The pairs (member, leader) whose whole sets are alike, as links a, b.

    A leader's text goes once to every MEMBERS of its members, so neither a large group nor a
    text with many partners is one task's work, and no set travels once for each pair.
    """
    parts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("member"), "parts").cast("int").alias("part"), F.col("member"), F.col("member").alias("class"))
    leaders = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("member"), F.col("leader").alias("class"))
    rows = members.unionByName(leaders).join(texts, "class").select("leader", "part", "member", "text")
    dealt = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", F.col("member").asc_nulls_first())
    return dealt.mapInArrow(partial(_verified, likeness=likeness), "a binary, b binary")


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets that still meet different components, of those that did before: band, class, root.

    Components only grow, so a bucket that is one component stays so.
    """
    named = rows.drop("root").join(roots, rows["class"] == roots["node"], "left").select("band", "class", F.coalesce("root", "class").alias("root"))
    mixed = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
    return named.join(mixed, "band")


def _leaders(rows: DataFrame) -> DataFrame:
    """Pairs (member, leader) of each bucket's leader and its other members.

    The leader of a bucket is its member that meets most others, over all of its buckets: near copies
    of one text meet each other less often than they meet that text. A member in several buckets
    takes the leader it meets most often.
    """
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"))
    met = rows.join(sizes, "band").groupBy("class").agg(F.sum("n").alias("met"))
    first = rows.join(met, "class").groupBy("band").agg(F.max(F.struct("met", "class")).alias("first")).select("band", F.col("first.class").alias("leader"))
    pairs = rows.join(first, "band").filter("class <> leader").groupBy(F.col("class").alias("member"), "leader").agg(F.count("*").alias("n"))
    return pairs.groupBy("member").agg(F.max(F.struct("n", "leader")).alias("most")).select("member", "most.leader")


def _sizes(rows: DataFrame) -> DataFrame:
    """Of each bucket: its members, its pairs in different components, its largest component."""
    of_root = rows.groupBy("band", "root").agg(F.count("*").alias("own"))
    biggest = F.max(F.struct("own", "root"))
    return of_root.groupBy("band").agg(F.sum("own").alias("n"), ((F.sum("own") * F.sum("own") - F.sum(F.col("own") * F.col("own"))) / 2).alias("pairs"), biggest["root"].alias("major"), biggest["own"].alias("in_major"))


def _pairs(rows: DataFrame) -> DataFrame:
    """The pairs of small buckets in different components, once each."""
    few = rows.filter(F.col("n") <= SMALL).select("band", "class", "root")
    other = few.select("band", F.col("class").alias("leader"), F.col("root").alias("leader_root"))
    return few.join(other, "band").filter((F.col("root") != F.col("leader_root")) & (F.col("class") < F.col("leader"))).select(F.col("class").alias("member"), "leader").distinct()


def _blocks(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Large buckets, cut into blocks: members outside of the largest component meet all members.

    A row of a block: band, across, down, asked (whether its pairs are wanted), class, root, text.
    """
    many = rows.filter(F.col("n") > SMALL).withColumns({"down_n": F.ceil((F.col("n") - F.col("in_major")) / BLOCK).cast("int"), "across_n": F.ceil(F.col("n") / BLOCK).cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    asked = many.filter("root <> major").select("band", "class", "root", F.lit(True).alias("asked"), own("down_n").alias("down"), every("across_n").alias("across"))
    given = many.select("band", "class", "root", F.lit(False).alias("asked"), own("across_n").alias("across"), every("down_n").alias("down"))
    dealt = asked.unionByName(given).join(texts, "class").repartition("band", "across", "down")
    return dealt.sortWithinPartitions("band", "across", "down", "asked", "class").select("band", "across", "down", "asked", "class", "root", "text")


def _compared(batches: Iterable[pa.RecordBatch], likeness: Likeness) -> Iterator[pa.RecordBatch]:
    """Links that join components within a block, by common shingles counted over an inverted index."""
    working("shingles", _forget)
    here, names, roots, sets, index = None, [], [], [], None
    merged: dict[bytes, bytes] = {}

    def top(root: bytes) -> bytes:
        while root in merged:
            root = merged[root]
        return root

    for batch in steps(batches, "text"):
        out = []
        for row in batch.to_pylist():
            if (place := (row["band"], row["across"], row["down"])) != here:
                here, names, roots, sets, index = place, [], [], [], None
                merged = {}
            members = shingles(row["text"], likeness.words)
            if not row["asked"]:
                names.append(row["class"])
                roots.append(row["root"])
                sets.append(members)
                continue
            if index is None:
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                order = np.argsort(flat, kind="stable")
                keys, starts = np.unique(flat[order], return_index=True)
                index = keys, np.append(starts, len(flat)), owner[order], np.array([len(x) for x in sets])
            keys, starts, owner, sizes = index
            at = np.minimum(np.searchsorted(keys, members), len(keys) - 1)
            at = at[keys[at] == members]
            lengths = starts[at + 1] - starts[at]
            hits = owner[np.repeat(starts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
            common = np.bincount(hits, minlength=len(sizes))
            for k in np.flatnonzero(100 * common >= likeness.percent * (len(members) + sizes - common)):
                if (a := top(row["root"])) != (b := top(roots[k])):
                    merged[a] = b
                    out.append((row["class"], names[k]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], names=["a", "b"])


def near_duplicates(documents: DataFrame, likeness: Likeness) -> DataFrame:
    """See _components: doc_id, n_shingles, component_id, kept."""
    return _components(documents, likeness).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(documents: DataFrame, likeness: Likeness) -> DataFrame:
    """The rows of ``documents`` (doc_id, text and others) of which one stays of each component, all columns.

    Of a component that is the row of the smallest doc_id, nulls last, then of the smallest hash of the
    text and the other columns; rows without words are linked with nothing and stay. So rows that
    share an id are told apart, and of rows equal in all columns one stays. The choice is made on
    ids and hashes. The texts meet only what goes, a table that is broadcast when it turns out small.
    """
    names = ["__unnamed", "__id", "__mark"]
    keys = [F.col("doc_id").isNull().alias("__unnamed"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("__id")]
    others = [name for name in documents.columns if name not in ("doc_id", "text")]
    found = _components(documents, likeness, others).filter("root IS NOT NULL").select("root", "doc_id", *keys, F.col("mark").alias("__mark"))
    best = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "__mark")
    first = found.withColumn("__place", F.row_number().over(best)).filter("__place = 1").select(*names, F.lit(True).alias("__first"))
    told = found.groupBy(*names).agg(F.count("*").alias("__n")).join(first, names, "left")
    told = stored(told.filter("__first IS NULL OR __n > 1"), "minhash-choice")

    text = F.col("text").cast("string")
    worded = F.coalesce(text.rlike(WORDED), F.lit(False))
    rows = documents.filter(worded).select("*", *keys, _mark(text, others).alias("__mark"))
    alone = rows.join(told, names, "left_anti")
    equal = rows.join(told.filter("__first").select(*names), names, "left_semi")
    place = F.row_number().over(Window.partitionBy(*names).orderBy("__mark"))
    one = equal.withColumn("__place", place).filter("__place = 1")
    return alone.select(*documents.columns).unionByName(one.select(*documents.columns)).unionByName(documents.filter(~worded))


def _mark(text: Column, others: list[str]) -> Column:
    """A hash by which rows of one id are told apart; equal ones have equal texts."""
    return F.xxhash64(text, *(F.col(name) for name in others))


def _components(documents: DataFrame, likeness: Likeness, others: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and the mark and root by which it is told apart.

    Documents with equal sets are one class. Classes meet in buckets of equal bands. Where buckets
    are large, each class is first compared with a leader, and the confirmed links make components;
    buckets that are one component then are done. In the others all pairs in different components
    are compared: in small ones pair by pair, in large ones by blocks, the members outside of the
    largest component with all. So a large group costs about as many comparisons as it has members,
    unless its members are not alike, and no pair is left out that could join two components.

    component_id is the smallest doc_id that links reach; near_duplicates keeps a document that has it as its own.
    A document without words or text is linked with nothing. Rows that share an id are documents of
    their own; a null id is linked as any other, but is no component's smallest, unless all are
    null. Only doc_id, text and the ``others``, which go into the mark, are read; an empty table gives no rows.
    """
    ship_package(documents.sparkSession)
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long"), _mark(text, others or []).alias("mark"), text.alias("text"))
    sketched = stored(rows.mapInArrow(partial(_sketched, likeness=likeness), _SKETCHED), "minhash")
    classes = sketched.filter("class IS NOT NULL").groupBy("class").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id"))
    exploded = classes.select(F.explode("bands").alias("band"), "class")
    shared = exploded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    buckets = stored(exploded.join(shared, "band"), "minhash-buckets")

    # One text for each class with a partner, that of its smallest document. An id may be null or
    # stand for several texts, so the text's own hash is part of the key.
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("at")
    first = sketched.filter("class IS NOT NULL").groupBy("class").agg(smallest).join(buckets.select("class").distinct(), "class")
    first = first.select("class", F.col("at.doc_id").alias("first_id"), F.col("at.mark").alias("first_mark"))
    same = (rows["mark"] == first["first_mark"]) & rows["doc_id"].eqNullSafe(first["first_id"])
    texts = stored(rows.join(first, same).select("class", "text").dropDuplicates(["class"]), "minhash-texts")

    roots, left = None, buckets.withColumn("root", F.col("class"))
    sizes = stored(_sizes(left), "minhash-sizes")
    links, (members, pairs) = None, sizes.agg(F.sum("n"), F.sum("pairs")).first()
    if members and pairs > PAIRS_LEFT * members:
        links = stored(_confirmed(_leaders(buckets), texts, likeness), "minhash-links")
        roots = components(links)
        left = stored(_open(left, roots), "minhash-open")
        sizes = stored(_sizes(left), "minhash-sizes")
    if members and not sizes.isEmpty():
        rest = stored(left.join(sizes, "band"), "minhash-rest")
        found = _confirmed(_pairs(rest), texts, likeness).unionByName(_blocks(rest, texts).mapInArrow(partial(_compared, likeness=likeness), "a binary, b binary"))
        found = stored(found, "minhash-links")
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    named = sketched.drop("bands")
    if roots is None:
        named = named.withColumn("root", F.col("class"))
    else:
        named = named.join(roots, named["class"] == roots["node"], "left").withColumn("root", F.coalesce("root", "class")).drop("node")
    least = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return named.join(least, "root", "left").select("doc_id", "n_shingles", component.alias("component_id"), "mark", "root")
