"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

The candidates stay where they lie. The queries go to them in blocks of bounded size, each with a score that its k-th best
surely has (that of its k-th best in a bounded sample). A task takes its candidates in blocks too. In a block each dimension
has its list of candidates in the order of their components; a query reads lists downwards from the end that suits the sign
of its component, until the best score that anything unmet could have is below its k-th best score so far: the sum of what
stands at the depth reached, and for the lists that aren't read of what stands at their top, or the product of the rests' norms
if that is less. That score is carried from block to block, so the depth where it stops, and the fewest lists that have to be
read (those that fall most come first), are known from the lists before a row is met: at depth 0 the block is passed over; up
to a share of the block the rows met are gathered and scored; beyond it one matrix product scores the block for all such
queries. The tasks' answers are merged and written, block of queries by block.

How much is passed over depends on the data: directions that are alike in all dimensions leave the bound too high to stop
early, and then every pair is scored; vectors whose components differ in size, or queries with near neighbours, stop soon.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does one without an id.
Vectors meet only vectors with as many components. Every row is a candidate but the query's own, so rows that repeat an id or
a vector count as often as they come. Ties go to the smaller id. Components and scores beyond a long are held at its ends.
An empty table gives no rows; a query without candidates gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, written

#: Queries that go to the candidates at a time (and no more than COMPONENTS have room for); rows of the sample; components of a block of candidates, and of scores at once.
QUERIES, SAMPLE, COMPONENTS, SCORES = 4096, 4096, 1 << 22, 1 << 22
#: The share of a block beyond which it is scored whole.
WHOLE = 0.25


def scaled(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component as longs; null for vectors that take no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


@dataclass
class Best:
    """The k best of each query so far: rows of (score, id), the worst last; and the least score that can still enter."""

    queries: np.ndarray
    own: np.ndarray  # the queries' own rows
    least: np.ndarray
    scores: list[np.ndarray]
    ids: list[np.ndarray]
    scored: int = 0
    pairs: int = 0

    @staticmethod
    def of(queries: np.ndarray, own: np.ndarray, least: np.ndarray) -> Best:
        n = len(queries)
        return Best(queries, own, least.copy(), [np.empty(0, queries.dtype)] * n, [np.empty(0, np.int64)] * n)

    def meet(self, q: int, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        top, top_ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        best = np.lexsort((top_ids, -top))[:k]
        self.scores[q], self.ids[q] = top[best], top_ids[best]
        if len(best) == k:
            self.least[q] = max(self.least[q], self.scores[q][-1])


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)  # never below the true ones


def depths(n: int) -> list[int]:
    """Where bounds are looked at: 0, then doubling."""
    return [0, *(1 << i for i in range(3, max(3, n.bit_length())) if 1 << i < n)]


def reach(queries: np.ndarray, top: np.ndarray, low: np.ndarray, norm: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many lists each query has to read to a depth for its bound to fall below least (more than there are: never), and the
    order in which it takes them. top, low: what stands at depth 0 and at the depth for positive and for negative components."""
    first, then = (np.where(queries > 0, queries * a, queries * b) for a, b in (top, low))
    order = np.argsort(then - first, axis=1, kind="stable")
    along = lambda x: np.concatenate([np.zeros((len(x), 1), x.dtype), np.cumsum(np.take_along_axis(x, order, axis=1), axis=1)], axis=1)
    read, rest = along(then), along(first)
    rest = rest[:, -1:] - rest
    if queries.dtype != object:
        squares = along(queries * queries)
        rest = np.minimum(rest, np.sqrt(np.maximum(squares[:, -1:] - squares, 0)) * norm * (1 + 1e-9) + 1e-9)
    enough = read + rest < least[:, None]
    return np.where(enough.any(axis=1), enough.argmax(axis=1), queries.shape[1] + 1), order


def search_block(best: Best, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
    """Let the queries of best meet a block of candidates (vectors, ids, and what row they are)."""
    n, queries = len(vectors), best.queries
    dimension = queries.shape[1]
    best.pairs += n * len(queries)
    lists = np.argsort(vectors.T, axis=1, kind="stable")  # rows of each dimension, ascending
    at = lambda place: vectors[lists[:, place], np.arange(dimension)] if dimension else np.empty(0, vectors.dtype)
    norm = float(norms(vectors).max()) if vectors.dtype != object else np.inf
    cost = np.full(len(queries), n, np.int64)
    plans: dict[int, tuple[int, np.ndarray]] = {}
    for t in depths(n):
        m, order = reach(queries, (at(n - 1), at(0)), (at(n - 1 - t), at(t)), norm, best.least)
        if t == 0:
            cost[m <= dimension] = 0  # nothing in the block can enter
            continue
        better = np.flatnonzero((m <= dimension) & (np.maximum(m, 1) * t < cost))
        cost[better] = np.maximum(m[better], 1) * t
        plans |= {q: (t, order[q, : m[q]]) for q in better.tolist()}
    for q in np.flatnonzero((cost > 0) & (cost < WHOLE * n)).tolist():
        t, own = plans[q]
        met = np.unique(np.concatenate([lists[i, n - t :] if queries[q, i] > 0 else lists[i, :t] for i in own.tolist()]))
        best.scored += len(met)
        scores = vectors[met] @ queries[q]
        good = (scores >= best.least[q]) & (rows[met] != best.own[q])
        best.meet(q, scores[good], ids[met][good], k)
    whole = np.flatnonzero(cost >= WHOLE * n)
    step = max(1, SCORES // n)
    for a in range(0, len(whole), step):
        own = whole[a : a + step]
        scores = queries[own] @ vectors.T
        best.scored += scores.size
        for q, row in zip(own.tolist(), scores):
            good = np.flatnonzero((row >= best.least[q]) & (rows != best.own[q]))
            if len(good):
                best.meet(q, row[good], ids[good], k)


def matrix(rows: pa.ChunkedArray | pa.Array, dimension: int, exact: bool) -> np.ndarray:
    """Vectors as doubles where sums of products are exact in them, else as integers of any size."""
    flat = rows.flatten() if isinstance(rows, pa.Array) else rows.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(rows), dimension).astype(np.float64 if exact else object)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", queries: int = QUERIES, sample: int = SAMPLE, components: int = COMPONENTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is a query its k best among the other rows."""
    spark = vectors.sparkSession
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col)).alias("v"), is_query.alias("asks"))
    usable = usable.filter("v IS NOT NULL AND vec_id IS NOT NULL").withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id())
    usable = written(usable, "vectors")
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    counts = usable.groupBy("dim").agg(F.count_if("asks").alias("q"), F.coalesce(F.max(largest), F.lit(0.0)).alias("most")).filter("q > 0").collect()
    exact = {r.dim: r.most * r.most * max(1, r.dim) < 2**53 for r in counts}
    asked = sum(r.q for r in counts)
    # of long vectors fewer queries go at a time, so that what a task makes of a block of them is bounded
    queries = max(1, min(queries, components // max(1, max(exact, default=1))))
    blocks = -(-asked // queries)

    def by_dimension(rows: DataFrame) -> dict[int, pa.Table]:
        table = rows.select("row", "vec_id", "dim", "v").toArrow()
        dims = table.column("dim").to_numpy()
        return {int(d): table.filter(pa.array(dims == d)) for d in np.unique(dims)}

    few = {}
    if asked:  # at most `sample` rows
        few = by_dimension(usable.filter(F.col("dim").isin(list(exact))).orderBy(F.xxhash64("row")).limit(min(sample, max(k + 1, components // max(1, max(exact))))))

    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")

    def blocks_found() -> Iterator[DataFrame]:
        """The ranked rows of each block of queries; the block is let go before the next one is sent."""
        for b in range(blocks):
            shared = spark.sparkContext.broadcast(asking_of(b))
            found = usable.select("row", "vec_id", "dim", "v").mapInArrow(met_by(shared), "row long, query_id long, vec_id long, score long")
            yield found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            shared.destroy()

    def asking_of(b: int) -> dict[int, tuple]:
        sent = {}
        for dim, table in by_dimension(usable.filter("asks").filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).items():
            own = Best.of(matrix(table.column("v"), dim, exact[dim]), table.column("row").to_numpy(), np.full(len(table), -np.inf, np.float64 if exact[dim] else object))
            if dim in few:
                search_block(own, matrix(few[dim].column("v"), dim, exact[dim]), few[dim].column("vec_id").to_numpy(), few[dim].column("row").to_numpy(), k)
            sent[dim] = own.queries, own.own, own.least, table.column("vec_id").to_numpy()
        return sent

    def met_by(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asking = shared.value
            best = {dim: Best.of(*parts[:3]) for dim, parts in asking.items()}
            held: dict[int, list[pa.RecordBatch]] = {}

            def meet(dim: int) -> None:
                table = pa.Table.from_batches(held.pop(dim))
                search_block(best[dim], matrix(table.column("v"), dim, exact[dim]), table.column("vec_id").to_numpy(), table.column("row").to_numpy(), k)

            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim in best:
                        held.setdefault(dim, []).append(batch.filter(pa.array(dims == dim)))
                        if sum(map(len, held[dim])) * max(1, dim) >= components:
                            meet(dim)
            for dim in list(held):
                meet(dim)
            for dim, own in best.items():
                _, rows, _, names = asking[dim]
                size = np.array(list(map(len, own.scores)))
                if size.sum():
                    held_at = lambda scores: np.array([max(-(2**63), min(int(s), 2**63 - 1)) for s in scores.tolist()], np.int64)
                    columns = [np.repeat(rows, size), np.repeat(names, size), np.concatenate(own.ids), held_at(np.concatenate(own.scores))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "query_id", "vec_id", "score"])

        return run

    return gathered(spark, blocks_found(), "query_id long, rank int, vec_id long, score long", "topk")
