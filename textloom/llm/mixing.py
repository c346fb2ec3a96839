"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets per source come from weights, with a ceiling of ``most`` times the source's size whose excess is reshared. The mix is
counted in blocks of ``block`` words. Blocks are seats: the sources get theirs by highest quotients of their targets, and
within a source its shards (of about ``shard_rows`` documents, by a seeded hash of the id) get theirs by highest quotients of
their sizes. In a shard the documents stand in a seeded order; a quota of q of its n blocks takes every block q // n times
and q % n blocks, the first of a seeded permutation, once more.

``mix`` counts the words that every document has in blocks taken. ``mixture`` returns whole documents: every one of a shard
as often as all its blocks are taken, and some once more, chosen by a seeded hash in each class of lengths until the words of
the quota are met; what one class leaves over or takes too much goes to the next shorter one.

A source has shards in proportion to its rows: one for ``shard_rows``, but of ``most_shards`` no more than its share of all rows,
and one at least; so a hot source is split however many others there are. The driver holds a number for each source and shard,
``most_shards`` and one a source together; a source is expected to be a provider of documents, not a document. The documents of
a shard are gone through as a sorted stream, and never held together.

Defined cases: a null text has size 0 and takes nothing; null is a source of its own, last in order; a source without words
has target 0. Repeated rows are mixed as separate documents; in ``mixture`` rows equal in id and text are chosen together.
An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterable, Iterator, Sequence
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, written

WEIGHTS, SHARE, MOST, BLOCK, SEED = (3, 1, 2), 1.5, 2, 16, 9


def targets(sizes: Sequence[int], weights: Sequence[int], share: float = SHARE, most: int = MOST) -> list[float]:
    """Words for each source: the share of all words by weight; what is above ``most`` times a source is shared anew."""
    total = Fraction(share) * sum(sizes)
    fixed: dict[int, Fraction] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        own = {i: left * weights[i] / weight for i in free} if weight else {}
        above = {i: Fraction(most * sizes[i]) for i in free if own.get(i, 0) > most * sizes[i]}
        if not above:
            return [float(fixed[i] if i in fixed else own[i]) for i in range(len(sizes))]
        fixed |= above


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients weight / (2 * seats so far + 1), none above its ``most``; ties to the first.

    Seats that every party surely gets are given at once, so the work doesn't grow with the number of seats.
    """
    seats = min(seats, sum(most))
    own, live = [0] * len(weights), {i for i, w in enumerate(weights) if w > 0 and most[i] > 0}
    while live:
        left, weight = seats - sum(own), sum(weights[i] for i in live)
        # at a divisor slightly above the final one a party keeps at least the floor of its share, less one
        sure = {i: min(most[i] - own[i], int(left * (weights[i] / weight)) - 1) for i in live} if left > 4 * len(live) else {}
        if max(sure.values(), default=0) <= 0 or any(own[i] for i in live):
            break
        for i, n in sure.items():
            own[i] = max(0, n)
        break
    heap = [(-weights[i] / (2 * own[i] + 1), i) for i in sorted(live) if own[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(own)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        own[i] += 1
        if own[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * own[i] + 1), i))
    return own


def sizes(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def deal(seed: int = SEED) -> Column:
    """What puts a document into a shard of its source."""
    return F.xxhash64(F.lit(seed), "doc_id")


def with_shard(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the columns of sources, and shard, to rows with source and deal."""
    found = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("source_of"))).drop("source_of")
    return found.withColumn("shard", F.pmod("deal", F.col("shards")).cast("int")).drop("shards", "deal")


def apportioned(
    sized: DataFrame, block: int = BLOCK, share: float = SHARE, most: int = MOST, weights: Sequence[int] = WEIGHTS, shard_rows: int = 1000, most_shards: int = 16384
) -> tuple[DataFrame, list[tuple]]:
    """From source, deal and size of written rows: the sources (source_of, source_size, target, shards) and the quotas of their
    shards as (source, shard, words, n blocks, quota)."""
    found = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("words")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r.words for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    total = sum(r.rows for r in found)
    sources = sized.sparkSession.createDataFrame(
        [(r.source, r.words, t, max(1, min(most_shards * r.rows // total, -(-r.rows // shard_rows)))) for r, t in zip(found, goal)], "source_of string, source_size long, target double, shards int"
    )
    cells = with_shard(sized, sources).groupBy("source", "shard").agg(F.sum("size").alias("words")).collect()
    by_source: dict = {}
    for c in sorted(cells, key=lambda c: c.shard):
        by_source.setdefault(c.source, []).append((c.shard, c.words, -(-c.words // block)))
    seats = sainte_lague(goal, round(sum(goal) / block), [sum(most * n for _, _, n in by_source[r.source]) for r in found])
    quotas = []
    for r, q in zip(found, seats):
        own = by_source[r.source]
        got = sainte_lague([w for _, w, _ in own], q, [most * n for _, _, n in own])
        quotas += [(r.source, shard, words, n, g) for (shard, words, n), g in zip(own, got) if n]
    return sources, quotas


def permutation(source: str | None, shard: int, n: int, seed: int) -> tuple[int, int]:
    """Factor and shift of the seeded order (factor * j + shift) mod n of a shard's n blocks."""
    rng = random.Random(f"{seed} {shard} {source!r}")
    factor = rng.randrange(n) | 1
    while math.gcd(factor, n) > 1:
        factor += 2 if n % 2 == 0 else 1
    return factor % n, rng.randrange(n)


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words in blocks taken, as often as they are) for each document."""
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), deal(seed).alias("deal"), sizes(docs).alias("size")), "sized")
    sources, quotas = apportioned(sized, block, **options)
    plan = [(source, shard, n, got // n, got % n, *permutation(source, shard, n, seed)) for source, shard, _, n, got in quotas]
    quota = docs.sparkSession.createDataFrame(plan, "source_of string, shard_of int, n long, every long, extra long, factor long, shift long")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")
    placed = with_shard(sized, sources).withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    here = F.col("source").eqNullSafe(F.col("source_of")) & (F.col("shard") == F.col("shard_of"))
    start = F.col("end") - F.col("size")
    blocks = F.sequence(F.floor(start / block), F.floor((F.col("end") - 1) / block))

    def once_more(words: Column, j: Column) -> Column:
        inside = F.least((j + 1) * block, F.col("end")) - F.greatest(j * block, start)
        return words + F.when((j * F.col("factor") + F.col("shift")) % F.col("n") < F.col("extra"), inside).otherwise(F.lit(0).cast("long"))

    taken = F.col("every") * F.col("size") + F.aggregate(blocks, F.lit(0).cast("long"), once_more)
    found = placed.join(F.broadcast(quota), here, "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce(F.when(F.col("size") > 0, taken), F.lit(0)).cast("long").alias("taken"))


def choices(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(source, shard, kind, every, until) from (source, shard, want, words, kind, kind_words, pick, size), which come shard by shard,
    longer kinds first, in the order of picks: documents of a kind are taken every times, those with a pick of at most until once
    more, so that the words taken come to want. What a kind leaves over or takes too much goes to the next."""
    shard = kind = pick = until = None
    every = before = end = best = 0
    share = goal = left = 0.0

    def closer() -> None:
        nonlocal best, until
        if abs(end - goal) < abs(best - goal):
            best, until = end, pick

    for source, number, want, words, own_kind, kind_words, own_pick, size in rows:
        if (source, number, own_kind) != (*(shard or (None, None)), kind) or shard is None:
            if shard is not None:
                closer()
                left = goal - best
                yield (*shard, kind, every, until)
            if (source, number) != shard:
                shard, left = (source, number), 0.0
                every, extra = divmod(want, words)
                share = extra / words
            kind, goal, end, best, until, pick = own_kind, left + share * kind_words, 0, 0, None, None
        elif own_pick != pick:
            closer()  # equal picks go together
        pick, end = own_pick, end + size
    if shard is not None:
        closer()
        yield (*shard, kind, every, until)


def mixture(docs: DataFrame, block: int = BLOCK, seed: int = SEED, most: int = MOST, **options) -> DataFrame:
    """The documents of the mix, whole, each as often as it is taken. Only hashes and sizes are shuffled, no texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = F.floor(F.log2(F.octet_length(text) + 1)).cast("int")
    picked = F.xxhash64(F.lit(seed + 1), "doc_id", text)
    source = F.col("source").cast("string")
    sized = written(docs.select(source.alias("source"), deal(seed).alias("deal"), kind.alias("kind"), picked.alias("pick"), sizes(docs).alias("size")), "sized")
    sources, quotas = apportioned(sized, block, most=most, **options)
    wants = [(source, shard, min(got * block, most * words)) for source, shard, words, _, got in quotas if got]
    want = docs.sparkSession.createDataFrame(wants, "source_of string, shard_of int, want long")
    here = F.col("source").eqNullSafe(F.col("source_of")) & (F.col("shard") == F.col("shard_of"))
    asked = with_shard(sized.filter("size > 0"), sources).join(F.broadcast(want), here).select("source", "shard", "want", "kind", "pick", "size")
    total = lambda *by: F.sum("size").over(Window.partitionBy("source", "shard", *by))
    columns = ["source", "shard", "want", "words", "kind", "kind_words", "pick", "size"]
    dealt = asked.repartition("source", "shard").withColumns({"words": total(), "kind_words": total("kind")}).select(*columns)
    stream = dealt.sortWithinPartitions("source", "shard", F.desc("kind"), "pick")
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    names = ["source_of", "shard_of", "kind_of", "every", "until"]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = choices(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        while some := list(islice(made, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), kinds)], names)

    # a row for each shard and class of lengths, of which there are 31 at most
    plans = written(stream.mapInArrow(plan, "source_of string, shard_of int, kind_of int, every int, until long"), "mix-plan")
    worded = F.coalesce(F.col("text").rlike(f"[^{WHITE}]"), F.lit(False))
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    rows = docs.select(row, source.alias("source"), deal(seed).alias("deal"), kind.alias("kind"), picked.alias("pick"), worded.alias("worded")).filter("worded")
    found = with_shard(rows, sources).join(F.broadcast(plans), here & (F.col("kind") == F.col("kind_of")))
    copies = F.col("every") + F.when(F.col("pick") <= F.col("until"), 1).otherwise(0)
    return found.filter(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies))).select("row.*")
