"""Removal of every byte that a repeated string of ``length`` bytes covers, by comparing suffixes.

A suffix matters here only up to its first ``length`` bytes, its window. The array is sparse: of the suffixes that begin in a
window only the one with the least hash of its first 64 bytes, its token, is in it, so equal windows have equal tokens at equal
places; consecutive windows mostly share their token and travel as one stretch: the suffix's key (its first bytes and, of its
token's hash, 32 bits), a hash of all bytes of the stretch, and where it is.

1. Suffixes are range-partitioned by (key, hash, place) with sampled splitters, so in the order of their leading bytes, and so
   that those which very many documents share are dealt over many tasks; and sorted. Neighbours with one hash are repeated
   whole. Buckets send their first and last group to the driver, two rows each, which compares across the boundaries. Stretches
   whose token stands nowhere else are unique.
2. What is left has a token that others have, in other surroundings. Only there the bytes themselves travel, by token. Each
   bucket sorts the windows of its tokens by multikey quicksort: three-way partitions by eight bytes around a pivot, all
   partitions at once; windows that stand alone leave, those that are equal to the end are repeated.
3. Tokens with more stretches than ``most``, and those that a boundary cuts, are compared another exact way: in pieces of
   ``piece`` windows, whose common bytes are the key and all bytes the tie, range-partitioned and compared like the stretches
   of step 1; and what is left of these window by window, by 128-bit hashes.

Where hashes decide (1 and 3), 96 bits and the leading bytes or 128 bits are equal.

Defined cases: a null or empty text has no bytes. Repeated rows repeat all their windows. A text shorter than ``length`` loses
nothing. Rows without an id are told apart by their text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked_only, marks, small_batches, written

LENGTH, TOKEN = 200, 64
#: Stretches of one token that are sorted in memory; windows sorted at a time; bits of a place within a segment of a text.
RUN, AT_ONCE, PLACE_BITS = 512, 200_000, 24
#: Windows of a piece of a stretch that is compared in pieces.
PIECE = 8

ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BYTES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


def token_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the TOKEN bytes from each place on: of two halves each time, which are hashed already."""
    h, width = BYTES[data], 1
    while width < TOKEN:
        h = (h[:-width] * ODD[0]) ^ (h[width:] * ODD[1])
        h ^= h >> np.uint64(31)
        width *= 2
    return h


def leading(data: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys of the suffixes at these places: four bytes, as signed numbers in their order, and 32 bits of the token's hash."""
    words = np.ndarray((len(data) - 3,), ">u4", np.ascontiguousarray(data), strides=(1,))
    return ((words[at].astype(np.uint64) ^ np.uint64(1 << 31)) << np.uint64(32)) | (hashes[at] & np.uint64(0xFFFFFFFF))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values: of a block's end and the next one's beginning."""
    n = len(values) - width + 1
    blocks = np.concatenate([values, np.full(-len(values) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(raw: bytes, length: int, place_bits: int = PLACE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of each stretch: consecutive windows whose leftmost least hash is one place.

    So no window stands twice in a stretch, even where a text goes round in a short circle.
    """
    segment = 1 << place_bits
    if len(raw) > segment:
        parts = [(a, stretches(raw[a : a + segment], length, place_bits)) for a in range(0, len(raw) - length + 1, segment - length + 1)]
        return tuple(np.concatenate([p[c] + (np.uint64(0), a, 0)[c] for a, p in parts]) for c in range(3))
    data = np.frombuffer(raw, np.uint8)
    hashes, low = token_hashes(data), np.uint64((1 << place_bits) - 1)
    least = sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - TOKEN + 1) & low
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return leading(data, hashes, least[first].astype(np.int64)), first, np.diff(np.r_[first, len(least)])


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


PLACE = ["doc_id", "sig", "first", "size"]
#: A document's key in the bitmaps that keep texts without matches out of shuffles, as SQL.
NODE_SQL = "xxhash64(doc_id, sig)"


def all_stretches(docs: DataFrame, length: int, id_type: str, place_bits: int = PLACE_BITS) -> DataFrame:
    """key, tie (hash of the stretch) and place of every stretch of docs (doc_id, sig, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows, ties = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                token, first, size = stretches(raw, length, place_bits)
                owner.append(np.full(len(token), i))
                rows.append((token, first, size))
                ties += [xxhash.xxh3_64_intdigest(raw[a : a + n + length - 1]) for a, n in zip(first.tolist(), size.tolist())]
            if rows:
                token, first, size = (np.concatenate(c) for c in zip(*rows))
                at = pa.array(np.concatenate(owner))
                columns = [signed(token), signed(np.array(ties, np.uint64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(first.astype(np.int64)), pa.array(size.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "tie", *PLACE])

    return docs.mapInArrow(run, f"key long, tie long, doc_id {id_type}, sig long, first long, size long")


def repeated(rows: DataFrame, id_type: str, material: bool = True, more_place: str = "") -> DataFrame:
    """Of rows (key, tie, place): those whose key and tie another row has (again = true), and, if wanted, one for each tie of
    a key that has several (again = false). Rows are dealt by sampled splitters, sorted and compared with their neighbours."""
    names = ["key", "tie", *PLACE, *([more_place] if more_place else [])]
    fields = f"key long, tie long, doc_id {id_type}, sig long, first long, size long" + (f", {more_place} long" if more_place else "") + ", again boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: pa.RecordBatch, again: bool, edge: int | None = None, n: int = 0) -> pa.RecordBatch:
            more = [pa.array([again] * len(part)), pa.array([edge] * len(part), pa.int64()), pa.array([n] * len(part), pa.int64())]
            return pa.RecordBatch.from_arrays([*part.columns, *more], [*names, "again", "edge", "n"])

        at = 2 * TaskContext.get().partitionId()
        held, n, kin, start = None, 0, False, True  # the first row of the last group, its rows, whether the group before has its key

        def closed(kin_after: bool) -> Iterator[pa.RecordBatch]:
            if n > 1:
                yield out(held, True)
            if material and (kin or kin_after):
                yield out(held, False)
            if start:
                yield out(held, False, at, n)

        for batch in batches:
            if not len(batch):
                continue
            both = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks().to_batches()[0]
            key, tie = both.column(0).to_numpy(), both.column(1).to_numpy()
            new_key = key[1:] != key[:-1]
            first = np.r_[0, np.flatnonzero(new_key | (tie[1:] != tie[:-1])) + 1]
            size = np.diff(np.r_[first, len(key)])
            if held is not None:
                size[0] += n - 1
            kin_of = np.r_[kin if held is not None else False, ~new_key[first[1:] - 1]]
            later = np.ones(len(key), bool)
            later[first] = False
            if later.any():
                yield out(both.filter(pa.array(later)), True)  # every row of a group but its first
            if len(first) > 1:
                held, n, kin = both.slice(0, 1), int(size[0]), bool(kin_of[0])
                yield from closed(bool(kin_of[1]))
                start = False
                inner = slice(1, len(first) - 1)
                often = first[inner][size[inner] > 1]
                if len(often):
                    yield out(both.take(pa.array(often)), True)
                mixed = first[inner][kin_of[inner] | kin_of[2:]] if material else []
                if len(mixed):
                    yield out(both.take(pa.array(mixed)), False)
            held, n, kin = both.slice(int(first[-1]), 1), int(size[-1]), bool(kin_of[-1])
        if held is not None:
            if not start:
                yield out(held, False, at + 1, n)
            yield from closed(False)

    order = ["key", "tie", *PLACE[:3]]
    dealt = rows.select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(dealt.mapInArrow(run, f"{fields}, edge long, n long"), "repeated")
    # two groups of each bucket at most: the first and the last, in order; the first of them is the last too in a bucket of one group
    edges = sorted(found.filter("edge IS NOT NULL").collect(), key=lambda r: r.edge)
    more: list[tuple[Any, ...]] = []
    for a, b in zip(edges, edges[1:]):
        if a.edge // 2 != b.edge // 2 and a.key == b.key:
            for r in (a, b):
                if a.tie == b.tie:
                    more.append((*(r[c] for c in names), True))
                if material:
                    more.append((*(r[c] for c in names), False))
    return found.filter("edge IS NULL").select(*names, "again").union(rows.sparkSession.createDataFrame(more, fields))


def equal_windows(texts: list[bytes], runs: list[int], length: int) -> list[np.ndarray]:
    """For each text which of its windows stand in another text of its run, or elsewhere in it.

    Multikey quicksort: a partition is split into what is less than, equal to and greater than its pivot in the eight bytes at its
    depth, and the equal part goes on eight bytes further; all partitions are split at once.
    """
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    counts = np.array([len(t) - length + 1 for t in texts])
    base = np.cumsum([0, *map(len, texts[:-1])])
    start = np.repeat(base - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    # live: places in the order of the partitions so far; group: their partition, ascending; depth: of each partition
    group, live = np.repeat(np.array(runs, np.int64), counts), np.arange(len(start))
    group = np.cumsum(np.r_[0, group[1:] != group[:-1]])
    depth, same = np.zeros(group[-1] + 1 if len(group) else 0, np.int64), np.zeros(len(start), bool)
    while len(live):
        word = words[start[live] + np.minimum(depth, length - 8)[group]].astype(np.uint64)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, len(live)])
        three = np.sort(word[np.stack([first, first + size // 2, first + size - 1])], axis=0)
        pivot = three[1][group]
        side = (word > pivot).astype(np.int64) - (word < pivot) + 1  # 0 less, 1 equal, 2 greater
        parts = group * 3 + side
        count = np.bincount(parts, minlength=3 * len(first))
        begin = np.cumsum(count) - count
        rank = np.empty(len(live), np.int64)
        for which in range(3):  # the place of each within its part
            own = side == which
            upto = np.cumsum(own)
            rank[own] = (upto - np.r_[0, upto][first][group])[own] - 1
        order = np.empty(len(live), np.int64)
        order[begin[parts] + rank] = np.arange(len(live))
        live, parts = live[order], parts[order]
        deeper = np.repeat(depth, 3) + np.tile([0, 8, 0], len(first))
        done = deeper >= length
        several = count > 1
        same[live[(done & several)[parts]]] = True
        stay = several & ~done
        kept = stay[parts]
        live, group, depth = live[kept], (np.cumsum(stay) - 1)[parts[kept]], deeper[stay]
    return np.split(same, np.cumsum(counts)[:-1])


def by_bytes(docs: DataFrame, mixed: DataFrame, length: int, id_type: str, most: int = RUN, piece: int = PIECE) -> DataFrame:
    """The repeated windows in stretches (key, place) whose token others have, as (doc_id, sig, first, size)."""
    lists = written(mixed.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("key", "first", "size")).alias("own")).withColumn("node", F.expr(NODE_SQL)), "mixed-stretches")
    same = (F.col("d.node") == F.col("l.node")) & F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.sig") == F.col("l.sig"))
    some = marked_only(docs.withColumn("node", F.expr(NODE_SQL)), "node", lists)
    with_text = some.alias("d").join(lists.hint("shuffle_hash").alias("l"), same).select("d.doc_id", "d.sig", "d.text", "l.own")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, (text, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                raw = text.encode("utf-8", "surrogatepass")
                owner += [i] * len(own)
                rows += [(r["key"], r["first"], raw[r["first"] : r["first"] + r["size"] + length - 1]) for r in own]
            if rows:
                key, first, raw = zip(*rows)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(at), batch.column(1).take(at), pa.array(first), pa.array(raw, pa.binary())], ["key", *PLACE[:3], "raw"])

    # repeated rows have the same surroundings, of which one is wanted
    parts = written(with_text.mapInArrow(cut, f"key long, doc_id {id_type}, sig long, first long, raw binary").dropDuplicates(["key", "doc_id", "sig", "first"]), "surroundings")
    order = ["key", *PLACE[:3]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rest", "tie", *PLACE, "parent"]

        def spans(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            keys = table.column(0).to_numpy()
            same = equal_windows(table.column(4).to_pylist(), np.cumsum(np.r_[0, keys[1:] != keys[:-1]]).tolist(), length)
            owner, first, size = [], [], []
            begins = table.column(3).to_pylist()
            for i, (s, begin) in enumerate(zip(same, begins)):
                turns = np.flatnonzero(np.diff(np.r_[False, s, False].astype(np.int8)))
                owner += [i] * (len(turns) // 2)
                first += (turns[::2] + begin).tolist()
                size += (turns[1::2] - turns[::2]).tolist()
            if owner:
                at, null = pa.array(owner), pa.nulls(len(owner), pa.int64())
                yield pa.RecordBatch.from_arrays([null, null, table.column(1).take(at), table.column(2).take(at), pa.array(first), pa.array(size), null], names)

        def pieces(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            owner, keys, ties, firsts, sizes, parents = [], [], [], [], [], []
            for row, (key, begin, raw) in enumerate(zip(part.column(0).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist())):
                n, data = len(raw) - length + 1, np.frombuffer(raw, np.uint8)
                hashes = token_hashes(data)
                at = np.flatnonzero(leading(data, hashes, np.arange(len(hashes))).view(np.int64) == key)
                shift = int(at[0]) % piece if len(at) else 0  # pieces begin at like distances from the token
                points = sorted({0, *range(shift, n, piece), n})
                for a, b in zip(points, points[1:]):
                    owner.append(row)
                    q = a - (a - shift) % piece  # where the piece begins if the stretch doesn't cut it
                    keys.append(xxhash.xxh3_64_intdigest(raw[max(0, q + piece - 1) : q + length]))
                    ties.append(xxhash.xxh3_64_intdigest(raw[a : b - 1 + length]))
                    firsts.append(begin + a)
                    sizes.append(b - a)
                    parents.append(begin)
            at = pa.array(owner)
            columns = [signed(np.array(keys, np.uint64)), signed(np.array(ties, np.uint64)), part.column(1).take(at), part.column(2).take(at), *map(pa.array, (firsts, sizes, parents))]
            yield pa.RecordBatch.from_arrays(columns, names)

        ready: list[pa.RecordBatch] = []
        run: list[pa.RecordBatch] = []
        key, rows, weight, inside = None, 0, 0, False

        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(bounds, bounds[1:]):
                if keys[a] != key:
                    if inside and rows <= most:
                        ready += run
                        weight += sum(r.column(4).nbytes for r in run)
                        if weight > AT_ONCE * 2:
                            yield from spans(ready)
                            ready, weight = [], 0
                    else:
                        for r in run:
                            yield from pieces(r)
                    inside, key, rows, run = key is not None, keys[a], 0, []
                run.append(batch.slice(a, b - a))
                rows += b - a
                if rows > most:  # too many to be held
                    for r in run:
                        yield from pieces(r)
                    run = []
        yield from spans(ready)
        for r in run:
            yield from pieces(r)

    schema = f"rest long, tie long, doc_id {id_type}, sig long, first long, size long, parent long"
    found = written(parts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, schema), "windows")
    rest = found.filter("rest IS NOT NULL").select(F.col("rest").alias("key"), "tie", *PLACE, "parent")
    judged = repeated(rest, id_type, more_place="parent")
    left = judged.filter("NOT again").select(*PLACE, "parent").distinct()
    at = F.col("p.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("p.sig") == F.col("w.sig")) & (F.col("p.first") == F.col("w.parent"))
    single = left.alias("w").join(parts.select(*PLACE[:3], "raw").alias("p"), at).select("w.doc_id", "w.sig", "w.first", "w.size", "w.parent", "p.raw")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, firsts, hashes = [], [], []
            for row, (first, size, parent, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)))):
                for s in range(first, first + size):
                    owner.append(row)
                    firsts.append(s)
                    hashes.append(xxhash.xxh3_128_digest(raw[s - parent : s - parent + length]))
            if owner:
                both, at = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2), pa.array(owner)
                columns = [pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(firsts), pa.array([1] * len(owner))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "tie", *PLACE])

    last = repeated(single.mapInArrow(windows, f"key long, tie long, doc_id {id_type}, sig long, first long, size long"), id_type, material=False)
    again = judged.filter("again").select(*PLACE).union(last.filter("again").select(*PLACE))
    return found.filter("rest IS NULL").select(*PLACE).union(again)


def strip(docs: DataFrame, length: int = LENGTH, most: int = RUN, piece: int = PIECE, place_bits: int = PLACE_BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) for each document."""
    if length < TOKEN:
        raise ValueError(f"windows have {TOKEN} bytes at least")
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("sig"), text.alias("text"))
    long = keyed.filter(F.octet_length("text") >= length)
    # written, as it is read twice: for the splitters, and to be dealt
    found = repeated(written(all_stretches(long, length, id_type, place_bits), "stretches"), id_type)
    mixed = found.filter("NOT again").select("key", *PLACE)
    covered = found.filter("again").select(*PLACE).union(by_bytes(long, mixed, length, id_type, most, piece))
    lists = written(covered.groupBy("doc_id", "sig").agg(F.collect_list(F.struct("first", "size")).alias("own")).withColumn("node", F.expr(NODE_SQL)), "covered")
    same = (F.col("d.node") == F.col("l.node")) & F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.sig") == F.col("l.sig"))
    bitmap, nodes = marks(lists, "node"), keyed.withColumn("node", F.expr(NODE_SQL))
    whole = bitmap.surely_not(nodes, "node").select("doc_id", "text", F.lit(None).cast(lists.schema["own"].dataType).alias("own"))
    cut = bitmap.maybe(nodes, "node").alias("d").join(lists.hint("shuffle_hash").alias("l"), same, "left").select("d.doc_id", "d.text", "l.own")
    joined = whole.union(cut)  # only texts that may lose something are shuffled

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, kept, at, removed, spans, end = text.encode("utf-8", "surrogatepass"), [], 0, 0, 0, -1
                for a, b in sorted((r["first"], r["first"] + r["size"] + length - 1) for r in own or ()):
                    if a > end:
                        spans += 1
                        kept.append(raw[at:a])
                        removed += b - a
                    elif b > end:
                        removed += b - end
                    at = end = max(end, b)
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((len(raw), removed, spans, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(finish, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
