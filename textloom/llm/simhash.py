"""SimHash fingerprints, and groups of them through BK-trees.

A BK-tree's children are keyed by their integer Hamming distance to the parent; a search for everything within a radius r of
a fingerprint at distance d from a node follows only the edges d-r to d+r. The trees are shards: fingerprints that can link
share a shard key, and each shard's tree is built where the sorted shard lies. (A broadcast of the trees would grow with the
corpus, so it isn't used; the shards travel by a range partitioning instead, which deals a large shard over many tasks.)

* ``groups_within`` links 64-bit fingerprints at ``radius`` or fewer differing bits, exactly: of radius + 2 blocks of bits two
  at least are the same in both, so every pair of blocks gives a shard key. Shards over ``SHARD`` fingerprints, and those
  that a task boundary cuts, are linked another exact way: fingerprints within two bits of each other share one that is
  within one bit of both, and at most 65 fingerprints share it.
* ``near_groups`` groups documents whose sets of five-word shingles are alike by 0.8 or more, through wide fingerprints of
  the sets: the shard keys are minimum hashes, of which such sets share most. A BK-tree of a shard's wide fingerprints finds what
  may be alike, and an exact comparison of shingles follows.

Equal fingerprints are one node with the smallest id. Defined cases: a null or empty text has the fingerprint zero and is
linked like any other by ``groups_within``; ``near_groups`` leaves it alone. Repeated rows have equal results. A null id
gets the component of its fingerprint. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest, xxh3_128_digest, xxh64_digest

from .common import WHITE, marked_only, marks, small_batches, written
from .components import components

#: The seed of the hashes of shingles, and the most that a shard has before it is linked the other way.
SEED, SHARD = 42, 1024
#: For runs that are taken whole.
NO_CUT = 1 << 62


def shingles(text: str | None, size: int) -> list[bytes]:
    """Word shingles of a lower-cased (A-Z) text, repeats included; of fewer words the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def majority_bits(digests: np.ndarray) -> bytes:
    """(n, bytes) of hashes -> a bit for each of their bits, set if it is in over half of them."""
    ones = np.zeros(digests.shape[1] * 8, np.int64)
    for a in range(0, len(digests), 65536):
        ones += np.unpackbits(digests[a : a + 65536], axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(digests)).tobytes()


def fingerprint(text: str | None, size: int = 3, seed: int = SEED) -> int:
    """The 64-bit fingerprint as a signed long."""
    own = shingles(text, size)
    if not own:
        return 0
    raw = np.frombuffer(b"".join([xxh64_digest(s, seed) for s in own]), np.uint8).reshape(-1, 8)
    return int.from_bytes(majority_bits(raw), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp for each row; one pass over the texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The index of the value, which gets one of its own unless it is there."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        node = 0
        while True:
            d = (self.values[node] ^ value).bit_count()
            if not d:
                return node
            below = self.children[node].get(d)
            if below is None:
                self.children[node][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            node = below

    def within(self, value: int, radius: int) -> Iterator[tuple[int, int]]:
        """(index, distance) of every value within the radius."""
        open_nodes = [0] if self.values else []
        while open_nodes:
            node = open_nodes.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                yield node, d
            edges = self.children[node]
            if edges:
                open_nodes += [below for key, below in edges.items() if d - radius <= key <= d + radius]


def linked(values: list[int], radius: int) -> list[int]:
    """For each value the first one of its group among these: values within the radius of each other, directly or by steps."""
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: list[int] = []
    for i, value in enumerate(values):
        for node, _ in tree.within(value, radius):
            a, b = find(first[node]), find(i)
            if a != b:
                root[max(a, b)] = min(a, b)
        if tree.add(value) == len(first):
            first.append(i)
    return [find(i) for i in range(len(values))]


def runs(batches: Iterator[pa.RecordBatch], most: int, weight: str | None = None, most_weight: int = NO_CUT) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Runs of at least two rows with one key (column 0) of a sorted partition, and whether a run is whole.

    It isn't where it is the first or last of the partition, or where it was cut because it has more rows than most or a sum of
    a column weight above most_weight, which it exceeds by its last row at most. Runs of one row come only where they aren't whole."""
    held: list[pa.RecordBatch] = []
    size, load, key, first, cut, step = 0, 0, None, True, False, min(64, most)

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        loads = np.cumsum(np.r_[0, batch.column(weight).to_numpy()]) if weight else np.zeros(len(keys) + 1, np.int64)
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if n or key is None or keys[a] != key:
                if held and (size > 1 or first or cut):
                    yield joined(), not (first or cut)
                first = key is None
                held, size, load, key, cut = [], 0, 0, keys[a], False
            if b - a == 1 and n and b < len(keys) and not first:
                continue  # alone, and its neighbours on both sides are here
            c = a
            while c < b:
                heavy = int(np.searchsorted(loads, loads[c] + most_weight - load, "right"))  # the row that makes it too heavy
                d = min(b, c + step, max(c + 1, heavy))
                held.append(batch.slice(c, d - c))
                size, load, c = size + d - c, load + int(loads[d] - loads[c]), d
                if size > most or (size > 1 and load > most_weight):
                    yield joined(), False
                    held, size, load, cut = [], 0, 0, True
    if held:
        yield joined(), False


def tree_links(nodes: DataFrame, radius: int, most: int) -> DataFrame:
    """u, v: links that the trees of whole shards find between nodes (fp, node); and u, rest (its fingerprint) for the nodes of
    shards above most, and of those that a task boundary cuts."""
    blocks = radius + 2
    width = 64 // blocks
    block = [F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(blocks)]
    keys = [F.xxhash64(F.lit(i * blocks + j), block[i], block[j]) for i, j in combinations(range(blocks), 2)]
    keyed = nodes.filter("node IS NOT NULL").select(F.explode(F.array(*keys)).alias("key"), "fp", "node")
    id_type = nodes.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, whole in runs(batches, most):
            node = own.column(2)
            if whole:
                roots = linked([v & (2**64 - 1) for v in own.column(1).to_pylist()], radius)
                at = [i for i, r in enumerate(roots) if i != r]
                if at:
                    to = node.take(pa.array([roots[i] for i in at]))
                    yield pa.RecordBatch.from_arrays([node.take(pa.array(at)), to, pa.nulls(len(at), pa.int64())], ["u", "v", "rest"])
            else:
                yield pa.RecordBatch.from_arrays([node, node, own.column(1)], ["u", "v", "rest"])

    found = keyed.repartitionByRange("key", "fp").sortWithinPartitions("key", "fp").mapInArrow(run, f"u {id_type}, v {id_type}, rest long")
    return written(found, "tree-links")


def groups_within(prints: DataFrame, radius: int = 2, most: int = SHARD) -> DataFrame:
    """fp, component for the fingerprints of prints (doc_id, fp): the smallest id that links of at most radius bits reach."""
    if radius > 2:
        raise ValueError("the exact way for large shards holds up to two bits")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "prints")
    found = tree_links(nodes, radius, most)
    rest = found.filter("rest IS NOT NULL").select(F.col("u").alias("node"), F.col("rest").alias("fp")).distinct()
    around = F.array("fp", *(F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)))
    met = rest.select("node", F.explode(around).alias("shared")).groupBy("shared").agg(F.min("node").alias("v"), F.collect_list("node").alias("all"))
    more = met.filter(F.size("all") > 1).select(F.explode("all").alias("u"), "v")
    comps = components(found.filter("rest IS NULL").select("u", "v").union(more))
    return nodes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, most: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for each row."""
    prints = written(fingerprints(docs, size), "fingerprints")
    found = prints.join(groups_within(prints, radius, most), "fp", "left")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


#: Minimum hashes of a set of shingles, of which each pair is a shard key; bits of its wide fingerprint, how many of them may
#: differ for a pair to be looked at (sets alike by 0.8 differ by 39 on average, very small ones by up to 48; their spread is 6).
MINIMA, WIDE, DIFFER = 6, 256, 80
#: A shard of at most so many rows gets its tree row by row, a larger one level by level.
FEW = 16
#: The most documents of a cell, and the most shingles that they have together (beyond the first few).
ROWS, SHINGLES = 1024, 2_000_000
PAIRS = tuple(combinations(range(MINIMA), 2))
FACTORS = np.random.default_rng(11).integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A sketch as bytes: the wide fingerprint, then the minimum hashes, 32 bits each.
SKETCH = np.dtype([("fp", "u8", (WIDE // 64,)), ("minima", "u4", (MINIMA,))])


def sketch(text: str | None, size: int = 5) -> tuple[bytes, int] | None:
    """The wide fingerprint and the minimum hashes of the set of shingles (SKETCH), and its size; None without words."""
    own = set(shingles(text, size))
    if not own:
        return None
    raw = np.frombuffer(b"".join([xxh3_128_digest(s, 1) + xxh3_128_digest(s, 2) for s in own]), np.uint8).reshape(-1, WIDE // 8)
    low = np.ascontiguousarray(raw[:, :8]).view(np.uint64).ravel()
    minima = []
    for factor in FACTORS:
        mixed = low * factor
        mixed ^= mixed >> np.uint64(29)
        minima.append(int((mixed * FACTORS[0]).min()) & 0xFFFFFFFF)
    return majority_bits(raw) + np.array(minima, "<u4").tobytes(), len(own)


def level_pairs(values: np.ndarray, radius: int, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all values (n, words of 64 bits), no two equal, within the radius, by a BK-tree that is built and searched a level at
    a time, so many values at once. The tree is the one that adding value after value makes."""
    width = values.shape[1] * 64 + 1
    apart = lambda a, b: np.bitwise_count(values[a] ^ values[b]).sum(axis=1, dtype=np.int64)
    waiting, at, edges, below = np.arange(1, len(values)), np.zeros(len(values) - 1, np.int64), [], []
    while len(waiting):
        edge = at * width + apart(waiting, at)
        made, first, of = np.unique(edge, return_index=True, return_inverse=True)
        edges.append(made)
        below.append(waiting[first])
        rest = np.ones(len(waiting), bool)
        rest[first] = False
        waiting, at = waiting[rest], below[-1][of[rest]]
    edge, child = np.concatenate([*edges, np.empty(0, np.int64)]), np.concatenate([*below, np.empty(0, np.int64)])
    order = np.argsort(edge)
    edge, child = edge[order], child[order]
    for a in range(0, len(values), rows):
        asked = np.arange(a, min(a + rows, len(values)))
        node = np.zeros(len(asked), np.int64)
        while len(asked):
            d = apart(asked, node)
            near = d <= radius
            yield asked[near], node[near]
            low = np.searchsorted(edge, node * width + np.maximum(d - radius, 0))
            n = np.searchsorted(edge, node * width + np.minimum(d + radius, width - 1), "right") - low
            steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            asked, node = np.repeat(asked, n), child[np.repeat(low, n) + steps]


def tree_pairs(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all rows of values (n, words of 64 bits) within the radius, each with itself too, by a BK-tree; equal rows are one node."""
    if len(values) > FEW:
        own, of = np.unique(values, axis=0, return_inverse=True)
        of = of.ravel()
        order, n = np.argsort(of, kind="stable"), np.bincount(of)
        start = np.cumsum(n) - n
        for u, v in level_pairs(own, radius):
            # the rows of u, each with the rows of v
            pairs = n[u] * n[v]
            step, v_n = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs), np.repeat(n[v], pairs)
            yield order[np.repeat(start[u], pairs) + step // v_n], order[np.repeat(start[v], pairs) + step % v_n]
        return
    numbers = [int.from_bytes(row.tobytes(), "little") for row in values]
    tree, rows = BKTree(), []
    for i, number in enumerate(numbers):
        node = tree.add(number)
        if node == len(rows):
            rows.append([])
        rows[node].append(i)
    yield tuple(np.array(side) for side in zip(*((i, j) for i, number in enumerate(numbers) for node, _ in tree.within(number, radius) for j in rows[node])))


def with_partner(own: pa.RecordBatch, radius: int, similarity: float) -> np.ndarray:
    """Which rows of a shard (key, pair, sketch, node, n, component) may be alike to another one of another component: those that a
    BK-tree of the shard's wide fingerprints finds within the radius, if sizes and minimum hashes allow it.

    Rows that share several shards are told here only in the first of them."""
    made = np.frombuffer(b"".join(own.column("sketch").to_pylist()), SKETCH)
    fp, minima = np.ascontiguousarray(made["fp"]), np.ascontiguousarray(made["minima"])
    n, component = (own.column(c).to_numpy(zero_copy_only=False) for c in ("n", "component"))
    a, b = PAIRS[own.column("pair")[0].as_py()]
    has = np.zeros(len(fp), bool)
    for i, j in tree_pairs(fp, radius):
        ok = (component[i] != component[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        same = minima[i, : b + 1] == minima[j, : b + 1]
        has[j[same[:, a] & same[:, b] & (same.sum(axis=1) == 2)]] = True
    return has


def _members(keyed: DataFrame, radius: int, similarity: float, most: int, most_weight: int) -> DataFrame:
    """cell, node for the rows of sorted shards that have to be compared with others of their cell, a shard or a part of one;
    and the keys (cut) of shards that aren't compared whole, as a task or a cell holds them only in part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = TaskContext.get().partitionId() << 40
        for own, whole in runs(batches, most, "n", most_weight):
            at = np.flatnonzero(with_partner(own, radius, similarity)) if own.num_rows > 1 else []
            rows = [(cell, node, None) for node in own.column("node").take(pa.array(at, pa.int64())).to_pylist()]
            cell += 1
            if not whole:
                rows.append((None, None, own.column(0)[0].as_py()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["cell", "node", "cut"])

    return written(keyed.mapInArrow(run, "cell long, node long, cut long"), "members-of-cells")


def alike(texts: list[str], size: int, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) between texts whose sets of shingles are alike by so much, of which all such pairs follow in steps."""
    raw = [np.unique(np.frombuffer(b"".join([xxh3_64_digest(s) for s in set(shingles(t, size))]), np.uint64)) for t in texts]
    n = np.array(list(map(len, raw)))
    values, places = np.unique(np.concatenate(raw), return_inverse=True)
    own = np.split(places, np.cumsum(n)[:-1])
    group, held, links = np.arange(len(texts)), np.zeros(len(values), np.int32), []
    for i in range(len(texts)):
        others = np.flatnonzero((group != group[i]) & (np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i])))
        others = others[others > i]
        if not len(others):
            continue
        held[own[i]] = 1
        common = np.add.reduceat(held[np.concatenate([own[j] for j in others])], np.cumsum(n[others]) - n[others])
        held[own[i]] = 0
        for j in others[common >= similarity * (n[i] + n[others] - common)].tolist():
            if group[i] != group[j]:
                links.append((i, j))
                group[group == group[j]] = group[i]
    return links


def _links(docs: DataFrame, members: DataFrame, size: int, similarity: float) -> DataFrame:
    """u, v: links between members (cell, node) of a cell, by the shingles of their texts in docs (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _ in runs(batches, NO_CUT):
            node = own.column(1)
            found = alike(own.column(2).to_pylist(), size, similarity)
            if found:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(side)) for side in zip(*found)], ["u", "v"])

    own = members.filter("node IS NOT NULL").select("cell", "node")
    texts = marked_only(docs, "node", own).groupBy("node").agg(F.first("text").alias("text"))
    cells = texts.join(own, "node").select("cell", "node", "text").repartition("cell").sortWithinPartitions("cell")
    return written(cells.mapInArrow(run, "u long, v long"), "links-of-cells")


def near_groups(docs: DataFrame, radius: int = DIFFER, size: int = 5, similarity: float = 0.8, most: int = ROWS, most_weight: int = SHINGLES) -> DataFrame:
    """node, doc_id, sig, component of every row with words; sig hashes the text, node the id and the text.

    Documents that share a shard and whose fingerprints its BK-tree finds within the radius are compared by their shingles, all of them unless links
    that were found join them already. Shards are compared in cells of bounded size (most rows, most_weight shingles).
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t, size) for t in batch.column(3).to_pylist()]
            at = pa.array([i for i, m in enumerate(made) if m], pa.int64())
            own, n = zip(*(m for m in made if m)) if len(at) else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(own, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "sig", "node", "sketch", "n"])

    sig = F.xxhash64("text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", sig.alias("sig"), F.xxhash64("doc_id", sig).alias("node"), "text")
    sketches = written(rows.mapInArrow(run, f"doc_id {id_type}, sig long, node long, sketch binary, n long"), "sketches")
    classes = written(sketches.groupBy("sketch", "n").agg(F.min("node").alias("class")), "sketch-classes")
    least = [F.substring("sketch", WIDE // 8 + 4 * i + 1, 4) for i in range(MINIMA)]
    keys = F.array(*(F.xxhash64(F.lit(i), least[a], least[b]) for i, (a, b) in enumerate(PAIRS)))
    # most keys are one document's alone, so they go ahead of the rows
    shared = written(classes.select(F.explode(keys).alias("key")).groupBy("key").count().filter("count > 1").select("key"), "shared-keys")
    columns = ["key", "pair", "sketch", "node", "n", "component"]
    node = F.col("class").alias("node")
    keyed = marked_only(classes.select(F.posexplode(keys).alias("pair", "key"), "sketch", node, "n"), "key", shared)
    texts = rows.select("node", "text")

    order = F.xxhash64("key", "node")  # other in each shard, so that parts of shards mix
    dealt = keyed.withColumn("component", F.col("node")).withColumn("order", order).repartitionByRange("key", "order").sortWithinPartitions("key", "order")
    first = _members(dealt.select(*columns), radius, similarity, most, most_weight)
    links = _links(texts, first, size, similarity)
    comps = components(links)

    # shards that weren't compared whole: those outside of the largest component with each other and with it, in blocks
    cut = first.filter("cut IS NOT NULL").select(F.col("cut").alias("key")).distinct()
    rest = keyed.join(cut, "key").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = written(rest.select(*columns), "cut-shards")
    per = rest.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    all_of = per.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max(F.struct("rows", "n", "component")).alias("top"))
    blocks = lambda rows, n: F.greatest(F.ceil(rows / F.lit(max(1, most // 2))), F.ceil(n / F.lit(max(1, most_weight // 2))))
    several = all_of.filter("rows > top.rows").select(
        "key", F.col("top.component").alias("top"), blocks(F.col("rows") - F.col("top.rows"), F.col("n") - F.col("top.n")).alias("outer"), blocks(F.col("top.rows"), F.col("top.n")).alias("inner")
    )
    outside = F.col("component") != F.col("top")
    block = F.pmod(F.xxhash64("node", "key"), F.when(outside, F.col("outer")).otherwise(F.col("inner")))
    count = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    among = F.transform(count("outer"), lambda j: F.xxhash64("key", F.lit(0), F.least("block", j), F.greatest("block", j)))
    across = F.transform(count("inner"), lambda j: F.xxhash64("key", F.lit(1), j, "block"))
    top = F.transform(count("outer"), lambda j: F.xxhash64("key", F.lit(1), "block", j))
    cells = rest.join(several, "key").withColumn("block", block).withColumn("key", F.explode(F.when(outside, F.concat(among, across)).otherwise(top)))
    second = _members(cells.select(*columns).repartition("key").sortWithinPartitions("key"), radius, similarity, NO_CUT, NO_CUT)
    comps = components(links.union(_links(texts, second, size, similarity)))
    found = classes.join(comps, F.col("class") == F.col("node"), "left").select("sketch", "n", F.coalesce("component", "class").alias("component"))
    return written(sketches.join(found, ["sketch", "n"]).select("node", "doc_id", "sig", "component"), "near-groups")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest node; documents without words stay.

    Of rows equal in id and text the one whose JSON has the least hash stays. Nodes are hashes of 64 bits: among 10^10 rows some
    three pairs of strangers are expected to share one, and so to be taken as one group.
    """
    worded = F.coalesce(F.col("text").rlike(f"[^{WHITE}]"), F.lit(False))
    found = near_groups(docs)
    stays = F.col("node") == F.col("component")  # a component's name is its smallest node
    again = found.groupBy("node").count().filter("count > 1").select("node")
    several = marks(found.filter(~stays).select("node").union(again), "node")
    keepers = found.filter(stays).select("node").distinct()
    keyed = docs.filter(worded).select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), "doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("own"))
    # only texts that may go are shuffled, and once: repeated rows are told by the key of the join
    alone = several.surely_not(keyed, "own")
    kept = several.maybe(keyed, "own").join(keepers, F.col("own") == F.col("node"), "left_semi")
    kept = kept.groupBy("own", "doc_id").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row", "doc_id", "own")
    return alone.union(kept).select("row.*").union(docs.filter(~worded))
