"""Exact cosine search over vectors.

Filters go before the search: the index is exact, so a search over the vectors that pass a filter returns what a search over
all of them would, once its other hits are taken away. A score is rounded to six digits before it is compared, so that
ties within rounding are broken by id and the order is total.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pairs
from .pairs import DIGITS

#: Of so many queries the products cost more than dealing the vectors to all cores.
DEALT_FROM = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """0 where a norm is 0; the norms are given, so that each vector's is computed once."""
    norms = norm_a * norm_b
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def score_all(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """Vectors of the query's dimension with their score; the others take no part."""
    same = vectors.filter(F.size("embedding") == len(query))
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    return same.withColumn("score", F.round(cosine(F.col("embedding"), literal(query), norm(F.col("embedding")), F.lit(length)), DIGITS))


def search(vectors: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """chunk_id, score: the k best; ties to the smaller id. One scan, and a bounded heap in each task."""
    return score_all(vectors, query).orderBy(F.desc("score"), "chunk_id").limit(k).select("chunk_id", "score")


def dimension_mismatches(vectors: DataFrame, dimension: int) -> DataFrame:
    return vectors.agg(F.count_if(F.size("embedding") != dimension).alias("mismatches"))


def search_each(vectors: DataFrame, queries: DataFrame, k: int = 10, most_queries: int = 16384, most_vectors: int = 32768) -> DataFrame:
    """query_id, chunk_id, score, rank for a set of queries (query_id, query).

    The queries are counted. Up to ``most_queries`` are sent everywhere, and vectors meet them where they lie (those of many
    queries are dealt to all cores first). More are dealt into blocks, and each block of queries meets each block of vectors
    once, in a join on the pair of blocks. Either way a task multiplies matrices and passes on the best of each query alone.
    """
    n = queries.count()
    vectors, queries = vectors.select("chunk_id", "embedding"), queries.select("query_id", "query")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id long, score double"
    if n <= most_queries:
        context = vectors.sparkSession.sparkContext
        sent = context.broadcast(queries.toArrow())

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = pairs.Search(sent.value, k)
            for batch in batches:
                search.meet(batch)
            yield from search.hits().to_batches()

        scored = (vectors.repartition(context.defaultParallelism, "chunk_id") if n > DEALT_FROM else vectors).mapInArrow(meet, schema)
    else:
        q_blocks, v_blocks = -(-n // most_queries), max(1, -(-vectors.count() // most_vectors))
        own = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
        every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        dealt = vectors.withColumn("vb", own("chunk_id", v_blocks)).withColumn("qb", every(q_blocks))
        asked = queries.withColumn("qb", own("query_id", q_blocks)).withColumn("vb", every(v_blocks))

        def meet_block(asked: pa.Table, dealt: pa.Table) -> pa.Table:
            search = pairs.Search(asked, k)
            search.meet(dealt)
            return search.hits()

        scored = asked.groupBy("qb", "vb").cogroup(dealt.groupBy("qb", "vb")).applyInArrow(meet_block, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The last vector of a chunk wins; new (index_kind, chunk_id, embedding, and at, by which the last is told)."""
    last = new.groupBy("index_kind", "chunk_id").agg(F.max_by("embedding", "at").alias("embedding"))
    return old.join(last, ["index_kind", "chunk_id"], "left_anti").unionByName(last)
