"""Periodic runs of words: stretches that repeat their first q words at least four times, found by matching aligned blocks.

A run of period q holds, for the power of two B with B <= q < 2B, a block of B words that begins at a multiple of B, and the same
words again q further on. So at every scale B the aligned blocks are the keys of an Aho-Corasick automaton over integer sequences,
which is run over the words. Where a block occurs again at a distance from B up to 2B, the distance is a period that might be:
it is extended word by word to both sides, as far as words that far apart are equal, and what comes out is a run if it is long
enough. Nothing is estimated: block matches only propose.

Scales are gone through from the smallest. Blocks and words are left out where no run of the scale can be: where a pair of words
has no equal within 2B words (in a run every pair has), and deep inside a run of a smaller period, whose multiples are no periods
of their own (two periods that share as many words as both together are multiples of one). So texts that repeat little cost
little, and a text of one word is not extended for each of its multiples. All texts of a batch go through one automaton a scale.

Defined cases: a null or empty text has no words, no runs, and an empty collapsed text. Repeated rows get a row each, other
columns aren't read, an empty table gives no rows. Texts are taken whole, however long; a batch is bounded beyond one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, small_batches
from .words import WHITE_SPACE, Words, gathered_batches, ranges

#: A run has at least so many words, and its period so many times.
LEAST, TIMES = 6, 4
#: Bytes and documents of a batch.
BATCH, DOCUMENTS = 4 << 20, 4096


def nearest_pairs(words: np.ndarray) -> np.ndarray:
    """For each word and the one after it, how far the nearest equal pair is; very far where there is none."""
    far = np.full(len(words), np.iinfo(np.int64).max)
    if len(words) < 2:
        return far
    pair = words[:-1] * (int(words.max()) + 1) + words[1:]
    order = np.argsort(pair, kind="stable")
    gap = np.diff(order)
    same = pair[order[1:]] == pair[order[:-1]]
    for at in (order[1:], order[:-1]):
        far[at[same]] = np.minimum(far[at[same]], gap[same])
    return far


def stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where mask holds."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def block_seeds(words: np.ndarray, blocks: np.ndarray, until: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) wherever one of the blocks of so many words occurs again from size to 2 * size - 1 further on, before until."""
    end = np.minimum(blocks + 3 * size - 1, until)
    reach = np.maximum.accumulate(end)
    fresh = np.concatenate([[True], blocks[1:] > reach[:-1]])
    first, last = blocks[fresh], reach[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(blocks) - 1]])]
    places = ranges(first, last - first)
    # what is searched: the words around the blocks, with a number between that no word has
    breaks = np.cumsum(last - first)[:-1]
    text = np.insert(words[places] + 1, breaks, 0)
    places = np.insert(places, breaks, -1)
    keys = words[ranges(blocks, np.full(len(blocks), size))].reshape(-1, size) + 1
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for n, key in enumerate(map(tuple, keys.tolist())):
        automaton.add_word(key, n)
    automaton.make_automaton()
    found = np.array(list(automaton.iter(tuple(text.tolist()))), np.int64).reshape(-1, 2)
    kind = np.full(len(text) + 2 * size, -1)
    kind[found[:, 0] - size + 1] = found[:, 1]
    at = np.flatnonzero(np.isin(places, blocks))
    seeds = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    padded = np.concatenate([places, np.full(2 * size, -1)])
    step = max(1, (1 << 22) // size)
    for a in range(0, len(at), step):
        to = at[a : a + step, None] + np.arange(size, 2 * size)
        near = (kind[to] == kind[at[a : a + step], None]) & (padded[to] == blocks[a : a + step, None] + np.arange(size, 2 * size))
        n, d = np.nonzero(near)
        seeds.append((blocks[a + n], d + size))
    return tuple(np.concatenate(x) for x in zip(*seeds))


def extended(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The stretch around at whose words equal those a period further on."""
    high, step = at, 64
    while high + period < len(words):
        n = min(step, len(words) - period - high)
        same = words[high : high + n] == words[high + period : high + period + n]
        if not same.all():
            high += int(same.argmin())
            break
        high, step = high + n, step * 2
    low, step = at, 64
    while low > 0:
        n = min(step, low)
        same = words[low - n : low] == words[low - n + period : low + period]
        if not same.all():
            low -= int(same[::-1].argmin())
            break
        low, step = low - n, step * 2
    return low, high


def runs_of(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of a sequence of numbers from 0, no run of which is longer than longest."""
    found: list[tuple[int, int, int]] = []
    near = nearest_pairs(words)
    size = 1
    while max(LEAST, TIMES * size) <= longest:
        a, b = stretches(near < 2 * size)
        long = b - a >= max(LEAST, TIMES * size) - 1
        a, b = a[long], b[long] + 1  # words, not pairs
        if len(a):
            own = -(-a // size)
            count = np.maximum((b - 2 * size) // size - own + 1, 0)
            blocks, until = ranges(own, count) * size, np.repeat(b, count)
            cover = covered_until(found, len(words))
            live = cover[blocks] < blocks + 3 * size - 1
            blocks, until = blocks[live], until[live]
            if len(blocks):
                found += new_runs(words, *block_seeds(words, blocks, until, size), size, cover)
        size *= 2
    rows = np.array(found, np.int64).reshape(-1, 3)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])] if len(rows) else rows


def covered_until(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """For each place the furthest end of the runs that begin there or before."""
    cover = np.zeros(n + 1, np.int64)
    if found:
        rows = np.array(found)
        np.maximum.at(cover, rows[:, 0], rows[:, 1])
    return np.maximum.accumulate(cover)


def new_runs(words: np.ndarray, at: np.ndarray, period: np.ndarray, size: int, cover: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs that seeds extend to. The first block of a run has at least 2 * period + 1 equal words from it on, which is looked at
    in a few places before words are compared one by one."""
    inside = (at + 3 * period < len(words)) & (cover[at] < at + period + size)
    at, period = at[inside], period[inside]
    looked = lambda further: words[at + further] == words[at + further + period]
    likely = looked(size) & looked(period) & looked(2 * period)
    at, period = at[likely], period[likely]
    order = np.lexsort((at, period))
    found, last, until = [], 0, -1
    for x, d in zip(at[order].tolist(), period[order].tolist()):
        if d == last and x < until:
            continue
        low, until = extended(words, x, d)
        last = d
        if until + d - low >= max(LEAST, TIMES * d):
            found.append((low, until + d, d))
    return found


def runs_in(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, rows of (start, end, period) in the document's words) of a batch; each document ends with a number of its own."""
    codes, names = words.codes()
    lengths = np.diff(words.first)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    sequence = np.empty(len(codes) + len(lengths), np.int64)
    sequence[np.arange(len(codes)) + doc] = codes
    sequence[words.first[1:] + np.arange(len(lengths))] = len(names) + np.arange(len(lengths))
    found = runs_of(sequence, int(lengths.max(initial=0)))
    begins = words.first[:-1] + np.arange(len(lengths))
    own = np.searchsorted(begins, found[:, 0], "right") - 1
    found[:, :2] -= begins[own, None]
    return own, found


def collapsed(words: Words, doc: np.ndarray, found: np.ndarray) -> pa.Array:
    """The texts without the words that a run repeats, one space between the others."""
    change = np.zeros(len(words) + 1, np.int64)
    begins = words.first[doc]
    np.add.at(change, begins + found[:, 0] + found[:, 2], 1)
    np.add.at(change, begins + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    first = np.searchsorted(kept, words.first)
    spaced = np.ones(len(kept), np.int64)
    spaced[first[:-1][first[:-1] < first[1:]]] = 0
    size = words.end[kept] - words.start[kept] + spaced
    offsets = np.concatenate([[0], np.cumsum(size)])
    text = words.text[ranges(words.start[kept] - spaced, size)]
    text[offsets[:-1][spaced == 1]] = 0x20
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets[first].astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed; one pass, no shuffle."""
    small_batches(docs.sparkSession, size=BATCH)
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = ["start", "length", "period"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered_batches(batches, 1, BATCH, DOCUMENTS):
            words = Words.of(batch.column(1), WHITE_SPACE, lower=False)
            doc, found = runs_in(words)
            order = np.lexsort((found[:, 2], found[:, 0], doc))
            doc, found = doc[order], found[order]
            rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (found[:, 0], found[:, 1] - found[:, 0], found[:, 2])], fields)
            offsets = np.searchsorted(doc, np.arange(len(batch) + 1))
            columns = [batch.column(0), pa.array(np.diff(words.first), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows), collapsed(words, doc, found)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and hashes of all runs and of the collapsed text; the runs and the text stay beside."""
    ranked = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    printed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = find(docs).withColumn("top", ranked)
    length, period = -F.col("top.shorter"), F.col("top.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), F.sha2(printed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words", "runs",
    )


def with_tails(docs: DataFrame) -> DataFrame:
    """The documents of which crc32 of the id is divisible by 10 with a tail that repeats, as the query's contract has it; other texts,
    and those without an id, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")).otherwise(F.lit(""))

    words = F.filter(F.split(F.coalesce("text", F.lit("")), f"[{WHITE}]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")).alias("text"))
