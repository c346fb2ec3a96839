"""Benchmark passages in documents, by a positional inverted index.

The index is made once from the documents and written: in segments of bounded size, each a row that holds its documents, its
terms, and for each term the places of its tokens in ascending order. A segment holds whole documents, so a phrase never has to
be put together from several segments, a very frequent term is spread over all of them, and no posting is shuffled.

A benchmark item asks for its windows of consecutive words. Long items are cut into overlapping pieces and the pieces are dealt
into blocks of bounded size, which go to the segments one after the other. In a segment a window begins with the posting list of
its rarest term there, each place moved back by the term's offset in the window, and is intersected with the equally moved lists
of its other terms, from the rarest on: what is left are the window's places, exactly. With ``slop`` each term may stand so many
words off its place in the window, on either side, as long as the window's place is in the document; these are the proximity
matches.

Defined cases: a null or empty text has no words, and an item without words no windows. Rows of documents that repeat get a row
each; items that repeat an id are one item with the windows of all its rows. The words of an item without an id are hit, but it
isn't counted. Matches never go beyond a document. Other columns aren't read. Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, gathered, small_batches, written
from .licenses import words_of
from .words import NOT_ALPHANUMERIC, Words, gathered_batches, lists, ranges

#: Places left out between the documents of a segment, so that no match goes from one into the next.
GAP = 256
#: Words of a window; bytes and documents of a segment; words of a piece of an item and of a block of pieces; candidates at once.
WINDOW, SEGMENT, DOCUMENTS, PIECE, BLOCK, CANDIDATES = 10, 8 << 20, 4096, 4096, 1 << 20, 1 << 22
HITS = "row long, item string, start int, end int"


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index, a row for each segment: rows, ids and lengths of documents; terms, sizes of their lists, places."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered_batches(batches, 2, SEGMENT, DOCUMENTS):
            words = Words.of(batch.column(2), NOT_ALPHANUMERIC, lower=True)
            codes, terms = words.codes()
            places = np.argsort(codes, kind="stable")
            places = places + GAP * (np.searchsorted(words.first, places, "right") - 1)
            columns = [
                lists(batch.column(0), pa.int64()), lists(batch.column(1), batch.column(1).type), lists(np.diff(words.first), pa.int32()),
                lists(terms, pa.string()), lists(np.bincount(codes, minlength=len(terms)), pa.int32()), lists(places, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["rows", "ids", "lengths", "terms", "sizes", "places"])

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"rows array<long>, ids array<{id_type.simpleString()}>, lengths array<int>, terms array<string>, sizes array<int>, places array<int>"
    return written(own.mapInArrow(run, schema), "postings", **LARGE_ROWS)


def pieces(bench: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", most: int = PIECE) -> DataFrame:
    """item, words: the words of items, long ones in pieces that share window - 1 words, so that each window is in one of them."""
    own = bench.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)), F.lit(most))
    return own.select("item", "all", F.explode(starts).alias("a")).select("item", F.slice("all", F.col("a") + 1, F.lit(most + window - 1)).alias("words"))


def places_of(windows: np.ndarray, offsets: np.ndarray, within: np.ndarray, keys: np.ndarray, first: np.ndarray, size: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of each match. windows: the segment's number of each term, from the rarest; offsets: where it stands in the
    window; within: how many terms there are; keys: (term, place) of the segment in one number, ascending."""
    counts = size[windows[:, 0]]
    own = np.repeat(np.arange(len(windows)), counts)
    start = (keys[ranges(first[windows[:, 0]], counts)] & 0xFFFFFFFF) - np.repeat(offsets[:, 0], counts)
    if slop:
        shifts = np.arange(-slop, slop + 1)
        own, start = np.repeat(own, len(shifts)), (start[:, None] + shifts).ravel()
    for n in range(1, windows.shape[1]):
        at, term = start + offsets[own, n], windows[own, n] << 32
        low = term | np.maximum(at - slop, 0)
        found = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
        ok = (keys[found] >= low) & (keys[found] <= term + at + slop) | (within[own] <= n)
        own, start = own[ok], start[ok]
    return own, start


def search_segment(segment: dict, block: dict, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window of the block, document of the segment, first word and end in the document) of each match."""
    size, lengths = np.asarray(segment["sizes"], np.int64), np.asarray(segment["lengths"], np.int64)
    first = np.cumsum(size) - size
    keys = (np.repeat(np.arange(len(size), dtype=np.int64), size) << 32) | np.asarray(segment["places"], np.int64)
    known = pc.fill_null(pc.index_in(block["terms"], value_set=segment["terms"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = known[block["windows"]]  # the padding of short windows repeats their first word
    alive = np.flatnonzero((codes >= 0).all(axis=1))
    codes, within = codes[alive], block["within"][alive]
    rarity = np.where(np.arange(codes.shape[1]) < within[:, None], size[codes], np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable")
    codes = np.take_along_axis(codes, order, axis=1)
    begins = np.cumsum(lengths) - lengths + GAP * np.arange(len(lengths))
    cost = np.cumsum(size[codes[:, 0]] * (2 * slop + 1)) if len(codes) else np.empty(0, np.int64)
    parts: list[tuple] = [(np.empty(0, np.int64),) * 4]
    a = 0
    while a < len(codes):
        b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + CANDIDATES, "right")))
        own, start = places_of(codes[a:b], order[a:b], within[a:b], keys, first, size, slop)
        own = own + a
        doc = np.maximum(np.searchsorted(begins, start, "right") - 1, 0)
        start = start - begins[doc]
        fits = (start >= 0) & (start + within[own] <= lengths[doc])
        own, doc, start = own[fits], doc[fits], start[fits]
        parts.append((alive[own], doc, start, start + within[own]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*parts))


def block_of(rows: pa.Table, window: int) -> dict:
    """Pieces (item, words) as arrays: the distinct terms, and a row of their numbers for each window."""
    words = rows.column("words").combine_chunks()
    coded = words.flatten().dictionary_encode()
    codes, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.maximum(size - window + 1, 1)
    start = ranges(np.cumsum(size) - size, count)
    within = np.repeat(np.minimum(size, window), count)
    at = np.arange(window)
    windows = codes[np.where(at < within[:, None], start[:, None] + at, start[:, None])]
    return {"terms": coded.dictionary, "windows": windows, "within": within, "piece": np.repeat(np.arange(len(size)), count), "items": rows.column("item").combine_chunks()}


def covered(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the stretches that matches cover, those that touch made one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    width = int(end.max()) + 2  # stretches of documents are kept apart
    reach = np.maximum.accumulate(end + doc * width)
    fresh = np.concatenate([[True], (start + doc * width)[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(doc) - 1]])
    return doc[fresh], start[fresh], reach[last] - doc[last] * width


def find(postings: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK) -> DataFrame:
    """row, item, start, end: for each document the stretches of words that matches cover (item null), and its items (start null).

    The rows of a document may come from several blocks of items.
    """
    if window + slop >= GAP or window < 1:
        raise ValueError(f"window and slop are below {GAP} together")
    spark = postings.sparkSession
    asked = written(pieces(bench, window, id_col, text_col).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    blocks = -(-(asked.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words)

    def search_by(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            items = np.asarray(block["items"].to_pylist(), object)
            for batch in batches:
                for n in range(len(batch)):
                    segment = {name: batch.column(name)[n].values for name in ("rows", "lengths", "terms", "sizes", "places")}
                    own, doc, start, end = search_segment(segment, block, slop)
                    rows = segment["rows"].to_numpy()
                    d, a, b = covered(doc, start, end)
                    pair = np.unique(doc * len(items) + block["piece"][own])
                    yield pa.RecordBatch.from_arrays([pa.array(rows[d]), pa.nulls(len(d), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["row", "item", "start", "end"])
                    none = pa.nulls(len(pair), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(rows[pair // len(items)]), pa.array(items[pair % len(items)], pa.string()), none, none], ["row", "item", "start", "end"])

        return run

    def found() -> Iterator[DataFrame]:
        small_batches(spark)
        for b in range(blocks):
            rows = asked.filter(F.pmod(F.xxhash64("piece"), F.lit(blocks)) == b).select("item", "words").toArrow()
            if len(rows):
                shared = spark.sparkContext.broadcast(block_of(rows, window))
                yield postings.select("rows", "lengths", "terms", "sizes", "places").mapInArrow(search_by(shared), HITS).filter("start IS NOT NULL OR item IS NOT NULL")
                shared.destroy()

    return gathered(spark, found(), HITS, "contamination")


def stretches(hits: DataFrame) -> DataFrame:
    """row, spans: the stretches of each document in order, those of several blocks made one where they touch."""
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = hits.filter("start IS NOT NULL").withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    island = fresh.withColumn("island", F.sum("fresh").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    whole = island.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def digest(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = 0, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document, and items (array) and spans (array of start, end)."""
    postings = index(docs)
    own = postings.select(F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("ids").alias("doc_id"), F.col("lengths").alias("n_words"))))
    hits = find(postings, bench, window, slop, **options)
    items = hits.filter("item IS NOT NULL").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = own.join(stretches(hits), "row", "left").join(items, "row", "left")
    none = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
    full = joined.select("doc_id", F.col("n_words").cast("long").alias("n_words"), none("spans", "struct<start:int,end:int>"), none("items", "string"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return full.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "items", "spans",
    )
