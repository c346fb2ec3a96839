"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing looks at lengths alone, and there are no more lengths than tokens in a sequence. So the histogram of
piece lengths, whose size doesn't grow with the corpus, is packed on the driver: a segment tree over remaining capacities
finds the tightest open bins in logarithmic time, and bins that are filled alike are moved as one group. The outcome is that
of placing the pieces one by one in decreasing length, and is a list of runs: pieces of length L with ranks a to b go, ``per``
to a bin, to the bins from ``bin`` on. Pieces get their rank within their length from a range partitioning by
(length, document, piece), in which a length that many pieces share is dealt over many partitions.

Defined cases: a null or empty text is its end token alone. Repeated rows are packed as often as they come. An empty table
gives no rows. Only documents longer than a sequence are cut; their first piece holds the remainder.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import counter_of, default_vocabulary

LENGTH, END = 1024, 2


def cut_points(n: int, length: int) -> list[int]:
    """Where the pieces of a document of n tokens begin and end: whole up to the length, else full pieces after a remainder."""
    if n <= length:
        return [0, n]
    return [0, *range(n % length or length, n + 1, length)]


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and with_ids the ids themselves. One pass over the texts."""
    small_batches(docs.sparkSession)
    path = path or default_vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = counter_of(path, True), np.uint32(end).astype("<u4").tobytes()
        for batch in batches:
            owner, rows = [], []
            for i, ids in enumerate(tokens.batch(batch.column(1).to_pylist())):
                ids += last
                points = cut_points(len(ids) // 4, length)
                for k, (a, b) in enumerate(zip(points, points[1:])):
                    part = ids[4 * a : 4 * b]
                    owner.append(i)
                    rows.append((k, a, b - a, crc32(part), *([np.frombuffer(part, "<u4").tolist()] if with_ids else ())))
            columns = list(zip(*rows)) or [()] * (len(names) - 1)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


class Capacities:
    """A segment tree over remaining capacities: a leaf holds the groups of bins that have just so much room."""

    def __init__(self, most: int):
        self.half = 1 << most.bit_length()
        self.open = [False] * (2 * self.half)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def mark(self, room: int) -> None:
        node, self.open[self.half + room] = self.half + room, bool(self.groups[room])
        while node > 1:
            node >>= 1
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.groups[room].append((first, count))
            self.mark(room)

    def take(self, room: int) -> tuple[int, int]:
        group = self.groups[room].pop()
        self.mark(room)
        return group

    def tightest(self, length: int) -> int | None:
        """The least room that holds the length, among the open bins."""
        node = self.half + length
        if self.open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.half:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.half
            node >>= 1
        return None


def best_fit(histogram: dict[int, int], capacity: int = LENGTH) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """Best-fit decreasing over (length -> pieces): for each length its runs (rank, pieces, bin, per, used), and the number of bins.

    The piece of rank r in a run goes to ``bin + (r - rank) // per`` at ``used + (r - rank) % per * length``.
    """
    tree, runs, bins = Capacities(capacity), {}, 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, rank, own = histogram[length], 0, runs.setdefault(length, [])
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = tree.take(room)
            per = room // length
            full = min(count, left // per)
            part = left - full * per if full < count else 0
            part = part if part < per else 0
            placed = full * per + part
            own.append((rank, placed, first, per, capacity - room))
            tree.put(room - per * length, first, full)
            tree.put(room - part * length, first + full, 1 if part else 0)
            used = full + (1 if part else 0)
            tree.put(room, first + used, count - used)
            left, rank = left - placed, rank + placed
    return runs, bins


def place(cut: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to pieces that are written already (they are read twice: to sample splitters, and to deal)."""
    spark = cut.sparkSession
    low = (1 << 33) - 1  # monotonically_increasing_id holds the partition above, the row below
    dealt = cut.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece", "ids_crc32")
    ranked = written(dealt.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    # as many rows as partitions and lengths together, for the partitions are ranges of lengths
    counts = ranked.groupBy(part.alias("part"), "length").agg(F.count("*").alias("n"), F.min(F.col("at").bitwiseAND(low)).alias("least")).collect()
    histogram: dict[int, int] = {}
    bases = []
    for r in sorted(counts, key=lambda r: (r.length, r.part)):
        bases.append((r.part, r.length, histogram.get(r.length, 0) - r.least))
        histogram[r.length] = histogram.get(r.length, 0) + r.n
    runs, _ = best_fit(histogram, capacity)
    base = spark.createDataFrame(bases, "part long, length long, base long")
    plan = spark.createDataFrame(list(runs.items()), "length long, runs array<struct<rank:long,n:long,bin:long,per:long,used:long>>")
    rank = F.col("at").bitwiseAND(low) + F.col("base")
    found = ranked.withColumn("part", part).join(F.broadcast(base), ["part", "length"]).join(F.broadcast(plan), "length").withColumn("r", rank)
    found = found.withColumn("run", F.filter("runs", lambda x: (F.col("r") >= x["rank"]) & (F.col("r") < x["rank"] + x["n"]))[0])
    nth = F.col("r") - F.col("run.rank")
    return found.select(
        *cut.columns,
        (F.col("run.bin") + F.floor(nth / F.col("run.per"))).cast("long").alias("sequence_id"),
        (F.col("run.used") + nth % F.col("run.per") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of the documents and their places in sequences; with_ids keeps the token ids for writing sequences out."""
    return place(written(pieces(docs, length, end, path, with_ids), "pieces"), length)
