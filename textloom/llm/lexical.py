"""Ranked lexical search by sort-based accumulation.

The documents are indexed once, in segments of bounded size: each holds its documents' lengths, its terms, and for each term the
documents that have it with how often. Corpus counts come from all segments. The queries are dealt into blocks of bounded size
that go to the segments one after the other. In a segment the lists of a block's terms become arrays of (item, document, impact),
put together for a range of items at a time so that they stay small; item and document are packed into one number, the numbers
are sorted digit by digit (radix sort), and the impacts of equal numbers are summed with reduceat. Each task keeps the k best of
an item in a heap; what the tasks found is written, dealt by ranges of items, and ranked.

Defined cases: a null or empty text has no terms; such documents aren't counted and never found. Repeated rows are documents of
their own, so that an id may be found more than once; a repeated item gets an answer each. Equal scores go by ascending id, null
last, and then by no defined order. Other columns aren't read. Items that nothing matches, and empty tables, give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, gathered, small_batches, written
from .licenses import words_of
from .words import NOT_ALPHANUMERIC, Words, gathered_batches, lists, ranges

#: Bytes and documents of a segment; (item, term) pairs of a block of queries; impacts that are sorted at a time.
SEGMENT, DOCUMENTS, ENTRIES, MATCHES = 8 << 20, 2048, 1 << 18, 1 << 22


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index, a row for each segment: ids and lengths of documents; terms, sizes of their lists; documents and counts."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered_batches(batches, 1, SEGMENT, DOCUMENTS):
            words = Words.of(batch.column(1), NOT_ALPHANUMERIC, lower=True)
            codes, terms = words.codes()
            doc = np.repeat(np.arange(len(batch)), np.diff(words.first))
            pairs, count = np.unique(codes.astype(np.int64) * len(batch) + doc, return_counts=True)
            sizes = np.bincount(pairs // len(batch), minlength=len(terms))
            columns = [
                lists(batch.column(0), batch.column(0).type), lists(np.diff(words.first), pa.int32()), lists(terms, pa.string()),
                lists(sizes, pa.int32()), lists(pairs % len(batch), pa.int32()), lists(count, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "terms", "sizes", "docs", "counts"])

    schema = f"ids array<{id_type}>, lengths array<int>, terms array<string>, sizes array<int>, docs array<int>, counts array<int>"
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(own.mapInArrow(run, schema), "lists", **LARGE_ROWS)


def weight(df: Column, n: int) -> Column:
    return F.floor(F.lit(1000) * F.log((F.lit(2 * n + 2)).cast("double") / (2 * df + 1).cast("double")))


def asked_terms(postings: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """item, term, weight for the terms of items that are in the corpus and weigh something. items: item, terms (distinct)."""
    known = postings.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("sizes").alias("size")))).groupBy("term").agg(F.sum("size").alias("df"))
    terms = items.select("item", F.explode("terms").alias("term"))
    return terms.join(known, "term").select("item", "term", weight(F.col("df"), n).alias("weight")).filter("weight > 0")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of unsigned 32-bit numbers, by their lower and then their upper 16 bits; numpy sorts such digits by radix."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    upper = (keys >> 16).astype(np.uint16)
    return order[np.argsort(upper[order], kind="stable")] if upper.any() else order


@dataclass(frozen=True, slots=True)
class Later:
    """An id in a heap: of equal scores the one with the larger id, or with none, is the worse."""

    id: Any

    def __lt__(self, other: Later) -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id


def block_of(rows: pa.Table) -> dict:
    """(item, term, weight) as arrays: items in order, each with its numbers of terms and their weights."""
    rows = rows.sort_by("item")
    items, first = np.unique(rows.column("item").to_numpy(), return_index=True)
    coded = rows.column("term").combine_chunks().dictionary_encode()
    return {"items": items, "first": np.append(first, len(rows)), "terms": coded.dictionary, "codes": coded.indices.to_numpy(zero_copy_only=False), "weights": rows.column("weight").to_numpy()}


def scores(segment: dict, block: dict, total: int, n: int, matches: int = MATCHES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item of the block, document of the segment, score) by ranges of items, all by item."""
    size = np.asarray(segment["sizes"], np.int64)
    begin = np.cumsum(size) - size
    m = np.array([10 + 90 * length * n // total for length in segment["lengths"].to_pylist()], np.int64)
    docs, counts = np.asarray(segment["docs"], np.int64), np.asarray(segment["counts"], np.int64)
    known = pc.fill_null(pc.index_in(block["terms"], value_set=segment["terms"]), -1).to_numpy(zero_copy_only=False)[block["codes"]]
    number = np.append(size, 0)[known]  # 0 for terms that aren't there
    before = np.concatenate([[0], np.cumsum(number)])[block["first"]]  # impacts before each item
    a, last = 0, len(block["items"])
    while a < last:
        b = min(max(a + 1, int(np.searchsorted(before, before[a] + matches, "right")) - 1), last, a + ((1 << 32) - 1) // max(len(m), 1))
        own = np.arange(block["first"][a], block["first"][b])
        own = own[number[own] > 0]
        at = ranges(begin[known[own]], number[own])
        if len(at):
            item = np.searchsorted(block["first"], own, "right") - 1
            keys = (np.repeat(item - a, number[own]) * len(m) + docs[at]).astype(np.uint32)
            impact = np.repeat(block["weights"][own], number[own]) * (1_000_000_000 * counts[at] // (1000 * counts[at] + 8 * m[docs[at]]))
            order = radix_order(keys)
            keys = keys[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            pair = keys[starts].astype(np.int64)
            yield a + pair // len(m), pair % len(m), np.add.reduceat(impact[order], starts)
        a = b


def keep_best(heaps: dict[int, list], item: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: list, k: int) -> None:
    """Into each item's heap of its k best (score, id); item is ascending."""
    edges = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(item)]):
        heap = heaps.setdefault(int(item[a]), [])
        own = score[a:b]
        least = np.partition(own, -k)[-k] if b - a > k else 0
        least = max(least, heap[0][0] if len(heap) == k else 1)
        for i in np.flatnonzero(own >= least).tolist():
            entry = (int(own[i]), Later(ids[doc[a + i]]))
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif heap[0] < entry:
                heapq.heapreplace(heap, entry)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, item_col: str = "item_id", query_col: str = "text", id_col: str = "doc_id", text_col: str = "text", entries: int = ENTRIES, matches: int = MATCHES) -> DataFrame:
    """item_id, rank, doc_id, score: for each query its k documents of the highest score above 0."""
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    postings = index(docs, id_col, text_col)
    n, total = postings.select(F.explode("lengths").alias("length")).agg(F.count_if(F.col("length") > 0), F.coalesce(F.sum("length"), F.lit(0))).first()
    items = written(queries.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.array_distinct(words_of(F.col(query_col))).alias("terms")), "items")
    asked = written(asked_terms(postings, items, n), "terms")
    blocks, largest = blocks_for(asked, entries)
    schema = f"item long, doc_id {id_type}, score long"

    def search_by(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, heaps, kind = shared.value, {}, pa.null()
            for batch in batches:
                for row in range(len(batch)):
                    segment = {name: batch.column(name)[row].values for name in batch.schema.names}
                    ids, kind = segment["ids"].to_pylist(), segment["ids"].type
                    for found in scores(segment, block, total, n, matches):
                        keep_best(heaps, *found, ids, k)
            rows = [(int(block["items"][i]), entry[1].id, entry[0]) for i, heap in heaps.items() for entry in heap]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), kind, pa.int64()))], ["item", "doc_id", "score"])

        return run

    def found() -> Iterator[DataFrame]:
        small_batches(spark)
        for b in range(blocks):
            rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()
            if len(rows):
                shared = spark.sparkContext.broadcast(block_of(rows))
                yield postings.mapInArrow(search_by(shared), schema)
                shared.destroy()

    best = gathered(spark, found(), schema, "best")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.repartitionByRange("item").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def blocks_for(asked: DataFrame, entries: int) -> tuple[int, int]:
    """Into how many blocks items are dealt by their hash, and the pairs of the largest: as many as it takes for none to be above
    ``entries``, unless it is a single item's."""
    sizes = asked.groupBy("item").count()
    whole = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    blocks = -(-whole[0] // entries)
    while blocks:
        largest = sizes.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks))).agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0]
        if largest <= max(entries, whole[1]):
            return blocks, largest
        blocks *= 2
    return 0, 0
