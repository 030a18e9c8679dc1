"""Exact top-k by inner product, pruned a block at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeledger.llm.common import ship_package, stored

#: Rows of a block, blocks of a run (a row of the stored index), queries of a chunk.
BLOCK, RUN, CHUNK = 128, 64, 256
#: Vectors that order the index: near vectors get near numbers, which keeps the blocks' maxima low.
PIVOTS = 64
VECTORS = "vec_id long, vector array<long>"
_RUN = "run long, ids binary, vectors binary, width int"
_FOUND = "query_id long, vec_id long, score long"


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id and floor(1024 * x) of every component; without null ids and vectors that are null or not finite throughout."""
    usable = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = embeddings.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("long")).alias("vector"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to the width."""
    lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _near(batches: Iterable[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the number of the pivot with the highest inner product."""
    for batch in batches:
        if batch.num_rows:
            at = (_matrix(batch.column("vector"), pivots.shape[1]).astype(np.float64) @ pivots.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["vec_id", "vector", "pivot"])


def _gathered(batches: Iterable[pa.RecordBatch], width: int, rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, vectors and (if there) floors of ``rows`` rows at a time."""
    held: list[pa.RecordBatch] = []
    n = 0

    def out():
        table = pa.Table.from_batches(held).combine_chunks()
        floors = table.column("floor").to_numpy() if "floor" in table.column_names else None
        return table.column("vec_id").to_numpy(), _matrix(table.column("vector").chunk(0), width), floors

    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, rows - n)
            batch, n = batch.slice(some.num_rows), n + some.num_rows
            held.append(some)
            if n == rows:
                yield out()
                held, n = [], 0
    if n:
        yield out()


def _runs(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    for k, (ids, vectors, _) in enumerate(_gathered(batches, width, BLOCK * RUN)):
        yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary()), pa.array([width], pa.int32())], names=["run", "ids", "vectors", "width"])


def _chunks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for ids, vectors, floors in _gathered(batches, width, CHUNK):
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, floors.astype(np.float64))], names=["q_ids", "q_vectors", "q_floors"])


def _number_type(queries: np.ndarray, vectors: np.ndarray):
    """A type in which every inner product, whatever its order, is exact: floats, else long integers, else Python's."""
    most = [max((abs(int(x.max())), abs(int(x.min()))), default=0) if x.size else 0 for x in (queries, vectors)]
    bound = most[0] * most[1] * max(1, queries.shape[1])
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def search_run(q_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, blocks: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Each query's k best of a run: (query ids, vector ids, scores).

    A term is a component with its sign, so a block has two maxima for each: its largest and its
    smallest component. Their sum over the query's terms bounds the scores of the block. Blocks are
    scored from the highest bound down until a bound is below the query's kth score, or below its
    floor, a kth score known from elsewhere. ``blocks``: so many blocks at most for each query,
    for a first floor.
    """
    kind = _number_type(queries, vectors)
    starts = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(vectors, starts).astype(kind), np.minimum.reduceat(vectors, starts).astype(kind)
    queries, vectors = queries.astype(kind), vectors.astype(kind)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    for row, (q_id, query) in enumerate(zip(q_ids, queries, strict=True)):
        best_ids, best, floor = np.zeros(0, np.int64), np.zeros(0, kind), floors[row]
        for at in np.argsort(-bounds[row], kind="stable")[:blocks]:
            if bounds[row, at] < floor:
                break
            some = ids[starts[at] : starts[at] + BLOCK]
            score = vectors[starts[at] : starts[at] + BLOCK] @ query
            take = (score >= floor) & (some != q_id)
            if take.any():
                best_ids, best = np.concatenate([best_ids, some[take]]), np.concatenate([best, score[take]])
                order = np.lexsort((best_ids, -best))[:k] if kind is not object else np.array(sorted(range(len(best)), key=lambda i: (-best[i], best_ids[i]))[:k])
                best_ids, best = best_ids[order], best[order]
                if len(best) == k:
                    floor = max(floor, best[-1])
        if len(best):
            yield np.full(len(best), q_id), best_ids, best


def _found(batches: Iterable[pa.RecordBatch], k: int, blocks: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, q_ids, floors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_floors"], np.float64)
            vectors, queries = (np.frombuffer(row[name], np.int64).reshape(-1, row["width"]) for name in ("vectors", "q_vectors"))
            if found := list(search_run(q_ids, queries, floors, ids, vectors, k, blocks)):
                columns = [np.concatenate(x) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in column], pa.int64()) for column in columns], names=["query_id", "vec_id", "score"])


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Each query's k highest integer inner products among all vectors with another id; ties to the smaller id.

    vectors, queries: VECTORS, without nulls (see integers). Shorter vectors count as filled up with
    zeros. The vectors are numbered by their nearest pivot and then by id, and stored as runs of
    blocks with their vectors as forward index. Every chunk of queries meets every run once to get a
    first kth score from its best block, and once more to score all blocks that can reach it; only k
    rows for each query and run leave a task. Queries are a stated set against all rows, in blocks.
    Repeated rows count each; an empty table gives no rows. Products are exact whatever their size; one
    that no long integer holds is shown as the nearest that is.
    """
    ship_package(vectors.sparkSession)
    width = vectors.agg(F.max(F.size("vector"))).first()[0]
    if not width:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(PIVOTS).collect()
    pivots = np.zeros((len(sample), width))
    for row, (vector,) in zip(pivots, sample, strict=True):
        row[: len(vector)] = vector
        row /= np.linalg.norm(row) or 1
    numbered = vectors.mapInArrow(partial(_near, pivots=pivots), f"{VECTORS}, pivot int")
    runs = stored(numbered.repartitionByRange("pivot", "vec_id").sortWithinPartitions("pivot", "vec_id").mapInArrow(partial(_runs, width=width), _RUN), "topk-runs")
    parts = max(1, -(-queries.count() // CHUNK))

    def searched(asked: DataFrame, blocks: int | None) -> DataFrame:
        chunks = stored(asked.repartition(parts, F.xxhash64("vec_id")).mapInArrow(partial(_chunks, width=width), "q_ids binary, q_vectors binary, q_floors binary"), "topk-queries")
        return runs.crossJoin(chunks).mapInArrow(partial(_found, k=k, blocks=blocks), _FOUND)

    first = _best(searched(queries.withColumn("floor", F.lit(float("-inf"))), 1), k)
    floors = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    # A long's double may lie above it: one step down keeps the floor a lower bound.
    lower = F.coalesce(F.col("kth") - F.abs("kth") * 1e-15, F.lit(float("-inf"))).alias("floor")
    asked = queries.join(floors.dropDuplicates(["vec_id"]), "vec_id", "left").select("vec_id", "vector", lower)
    return _best(searched(asked, None), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
