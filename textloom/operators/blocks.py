"""Exact cosine search that reads only the blocks of vectors that can matter.

Vectors are grouped by direction: centres come from a bounded sample, and each vector goes to the centre nearest to it. Blocks are
folders of a Parquet table, and of each the driver knows the centre and the widest angle from it. No vector of a block is nearer
to a query than the angle to the centre less that width; that is the block's bound. A search reads the blocks of the highest
bounds until they hold k vectors, and then those whose bound isn't below the k-th score. What it returns is what a search over
all vectors returns, whatever the grouping; only how much is read depends on it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..session import shared_folder
from . import vectors as V

#: Blocks of a dimension, and vectors of the sample that their centres come from.
BLOCKS, SAMPLE = 256, 8192
#: Vectors of the sample that a block has at least on average, so that a small table has few folders.
PER_BLOCK = 8
#: The block of vectors without a direction (null, all zero or not finite), which is always read.
FLAT = -1
#: By how much scores and angles may be off: rounding to V.DIGITS, and floats.
SLACK = 2e-6


def directions(vectors: list[Sequence[float] | None]) -> np.ndarray:
    """Unit vectors of one dimension as rows; zeros where there is no direction."""
    rows = np.array(vectors, np.float64)
    lengths = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    with np.errstate(all="ignore"):
        unit = rows / lengths
    return np.where(np.isfinite(unit).all(axis=1, keepdims=True) & (lengths > 0), unit, 0.0)


def centres_of(unit: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of n groups of unit vectors: each far from those before it, then moved to the means of their groups."""
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, unit @ unit[far])
    centres = unit[chosen]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        moved = directions(sums)
        centres = np.where((moved != 0).any(axis=1, keepdims=True), moved, centres)
    return centres


@dataclass(frozen=True)
class Blocks:
    """rows: the vectors with their block, a folder for each; centres by dimension; known: block -> (dimension, widest cosine, vectors)."""

    rows: DataFrame
    centres: dict[int, tuple[int, np.ndarray]]  # dimension -> (first block, centres)
    known: dict[int, tuple[float, int]]

    @staticmethod
    def of(vectors: DataFrame, blocks: int = BLOCKS, sample: int = SAMPLE) -> Blocks:
        """vectors (chunk_id, embedding, …) dealt into blocks; null embeddings stay, in the block without a direction."""
        spark = vectors.sparkSession
        some = vectors.filter("embedding IS NOT NULL").select("embedding").orderBy(F.xxhash64("chunk_id")).limit(sample).toArrow().column("embedding").to_pylist()
        centres, first = {}, 0
        for dim in sorted({len(v) for v in some if None not in v}):
            unit = directions([v for v in some if len(v) == dim and None not in v])
            unit = unit[(unit != 0).any(axis=1)]
            if len(unit):
                centres[dim] = first, centres_of(unit, min(blocks, max(1, len(unit) // PER_BLOCK)))
                first += len(centres[dim][1])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("embedding").to_pylist()
                block, cosine = np.full(len(own), FLAT), np.ones(len(own))
                for dim, (start, middle) in centres.items():
                    at = np.array([i for i, v in enumerate(own) if v is not None and len(v) == dim and None not in v], int)
                    unit = directions([own[i] for i in at]) if len(at) else np.empty((0, dim))
                    at, unit = at[(unit != 0).any(axis=1)], unit[(unit != 0).any(axis=1)]
                    if len(at):
                        near = unit @ middle.T
                        block[at], cosine[at] = start + near.argmax(axis=1), near.max(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int32()), pa.array(cosine, pa.float64())], [*batch.schema.names, "block_", "cosine_"])

        schema = StructType([*vectors.schema.fields, StructField("block_", IntegerType()), StructField("cosine_", DoubleType())])
        path = f"{shared_folder(spark)}/textloom/blocks-{uuid.uuid4().hex}"
        # dealt by block, large ones over several tasks and small ones together
        vectors.mapInArrow(deal, schema).hint("rebalance", "block_").write.partitionBy("block_").parquet(path)
        made = spark.read.schema(schema).parquet(path)
        stats = made.groupBy("block_").agg(F.min("cosine_").alias("least"), F.count("*").alias("n")).collect()
        return Blocks(made, centres, {r.block_: (r.least, r.n) for r in stats})

    def bounds(self, query: Sequence[float]) -> dict[int, float]:
        """The highest score that each block of the query's dimension could have."""
        out = {FLAT: np.inf} if FLAT in self.known else {}
        first, centres = self.centres.get(len(query), (0, np.empty((0, len(query)))))
        unit = directions([query])[0]
        for i, angle in enumerate(np.arccos(np.clip(centres @ unit, -1, 1)).tolist()):
            if first + i in self.known:
                width = float(np.arccos(np.clip(self.known[first + i][0], -1, 1)))
                out[first + i] = float(np.cos(max(0.0, angle - width - SLACK))) + SLACK if unit.any() else np.inf
        # a dimension that the sample didn't meet has no centres: its vectors are without a direction, and always read
        return out

    def _scored(self, blocks: list[int], query: Sequence[float], passing: DataFrame | None) -> DataFrame:
        found = V.score_all(self.rows.filter(F.col("block_").isin(blocks)), query).select("chunk_id", "score")
        return found if passing is None else found.join(passing.select("chunk_id"), "chunk_id", "left_semi")

    def needed(self, query: Sequence[float], k: int, passing: DataFrame | None = None) -> list[int]:
        """The blocks that a search reads. Once, k scores come to the driver."""
        bounds = self.bounds(query)
        order = sorted(bounds, key=lambda b: -bounds[b])
        held, first = 0, []
        for b in order:
            if held >= k and bounds[b] < np.inf:
                break
            first.append(b)
            held += self.known[b][1] if bounds[b] < np.inf else 0
        scores = sorted((r.score for r in self._scored(first, query, passing).orderBy(F.desc("score"), "chunk_id").limit(k).collect()), reverse=True)
        least = scores[k - 1] if len(scores) == k else -np.inf
        return [b for b in order if b in first or bounds[b] >= least]

    def search(self, query: Sequence[float], k: int = 10, passing: DataFrame | None = None) -> DataFrame:
        """chunk_id, score: as vectors.search, over those that pass (chunk_id) if given."""
        return self._scored(self.needed(query, k, passing), query, passing).orderBy(F.desc("score"), "chunk_id").limit(k)
