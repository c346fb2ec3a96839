import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import components, simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    own = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_tree_equals_brute_force():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(6)]
    assert simhash.linked(values, 2) == plain_groups(values, 2)


@pytest.mark.parametrize("most", [1024, 3])
def test_groups_equal_brute_force(spark, monkeypatch, most):
    other_way = []
    links = simhash.tree_links
    monkeypatch.setattr(simhash, "tree_links", lambda *a: (out := links(*a), other_way.append(out.filter("rest IS NOT NULL").count()))[0])
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    values = [v for b in base for v in [b, b, *(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(8))]]
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    prints = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.fp: r.component for r in simhash.groups_within(prints, most=most).collect()}
    assert (other_way[0] > 200) == (most == 3)  # fingerprints that the other way linked
    assert [got[s] for s in signed] == plain_groups(values, 2)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    prints = [plain_fingerprint(r.text) for r in rows]
    groups = [rows[g].doc_id for g in plain_groups(prints, 2)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (f"{p:016x}", g) for r, p, g in zip(rows, prints, groups)}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(5, None, "a"), (3, "", "b"), (3, "", "b"), (None, "x", "c"), (9, "One two", "d"), (7, "one\ttwo ", "e")], "doc_id long, text string, fp string")
    got = sorted(simhash.near_duplicates(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.component_id) for r in got] == [(3, 3), (3, 3), (5, 3), (7, 7), (9, 7), (None, None)]
    assert got[0].fingerprint == "0" * 16
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 150)}


def test_components_that_do_not_settle(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError, match="settled"):
        components.components(path, most_rounds=2)


def test_rows_equal_in_id_and_text_leave_the_same_one(spark):
    rows = [(1, "a b c d e f", x) for x in ("p", "q", "r")] + [(2, "a b c d e f", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {tuple(map(tuple, simhash.drop_near_duplicates(docs.orderBy(F.rand(seed)).repartition(3)).collect())) for seed in range(3)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1


def jaccard(a, b):
    a, b = (set(simhash.shingles(t, 5)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_groups_of_five_words(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, group = [], []
    for g in range(40):
        base = [word() for _ in range(300)]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(300)] = word()
            texts.append(" ".join(copy))
            group.append(g)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, sig string")
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] == group[j] and jaccard(texts[i], texts[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    assert sorted(root[i] for i in kept) == sorted(set(root))
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_groups_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (4, "c"), (5, " ")], "doc_id long, text string")
    got = sorted((r.doc_id or 0) for r in simhash.drop_near_duplicates(docs).collect())
    assert got in ([0, 1, 2, 4, 5], [1, 2, 3, 4, 5])


def made_words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]


def family(rng, alone, pairs):
    """Texts alike by about 0.72 to each other, but for pairs alike by 0.81."""
    base, texts = made_words(rng, 300), []
    for _ in range(alone):
        texts.append(base + made_words(rng, 57))
    for _ in range(pairs):
        shared = made_words(rng, 20)
        texts += [base + shared + made_words(rng, 37) for _ in range(2)]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def plain_links(texts, similarity=0.8):
    """All pairs of sets that are alike by so much, by counting what is common to each and all others."""
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    number = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    own = [np.array(sorted(map(number.get, x)), np.int64) for x in sets]
    flat, n = np.concatenate(own), np.array(list(map(len, own)))
    starts, held, pairs = np.cumsum(n) - n, np.zeros(len(number), np.int16), []
    for i, mine in enumerate(own):
        held[mine] = 1
        common = np.add.reduceat(held[flat], starts, dtype=np.int64)
        held[mine] = 0
        pairs += [(i, j) for j in np.flatnonzero(common >= similarity * (n[i] + n - common)).tolist() if j > i]
    return pairs


def groups_and_plain(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.near_groups(docs, **options).collect()
    by_component = {}
    for r in found:
        by_component.setdefault(r.component, []).append(r.doc_id)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in plain_links(texts):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    plain = {}
    for i in range(len(texts)):
        plain.setdefault(find(i), []).append(i)
    return sorted(sorted(g) for g in by_component.values()), sorted(plain.values())


def test_pairs_within_a_family_that_is_less_alike(spark):
    got, plain = groups_and_plain(spark, family(random.Random(21), 160, 15))
    assert len(plain) == 175 and got == plain


def counted_members(monkeypatch):
    """Keys of shards that each call leaves for the comparison by blocks."""
    cut, members = [], simhash._members
    monkeypatch.setattr(simhash, "_members", lambda *a: (out := members(*a), cut.append(out.select("cut").distinct().filter("cut IS NOT NULL").count()))[0])
    return cut


@pytest.mark.parametrize(("most", "most_weight"), [(3, 1 << 40), (20, 1 << 40), (1024, 2000)])
def test_shards_that_are_cut_equal_brute_force(spark, monkeypatch, most, most_weight):
    cut = counted_members(monkeypatch)
    rng = random.Random(22)
    copies = family(rng, 1, 0) * 12  # one component over many parts
    copies = [" ".join(t.split()[:-2] + made_words(rng, 2)) for t in copies]
    got, plain = groups_and_plain(spark, family(rng, 60, 10) + copies, most=most, most_weight=most_weight)
    assert len(plain) == 71 and got == plain and cut[0] >= 15


def test_thousands_in_one_shard_equal_brute_force(spark, monkeypatch):
    """5,400 texts alike by 0.7 that share nearly all shards; of 200 of them two each are alike by 0.8 or more."""
    cut = counted_members(monkeypatch)
    rng = random.Random(23)
    base, texts = made_words(rng, 100), []
    for _ in range(5000):
        texts.append(base + made_words(rng, 21))
    for _ in range(200):
        shared = made_words(rng, 9)
        texts += [base + shared + made_words(rng, 12) for _ in range(2)]
    rng.shuffle(texts)
    got, plain = groups_and_plain(spark, [" ".join(t) for t in texts])
    assert cut[0] >= 10 and len(plain) == 5200
    wanted = {tuple(g) for g in plain if len(g) > 1}
    found = {tuple(g) for g in got if len(g) > 1}
    assert not found - wanted and len(found) >= 0.99 * len(wanted)


def edge_pair(seed, shared, own):
    rng = random.Random(seed)
    base = made_words(rng, shared)
    return [" ".join(base + made_words(rng, own)) for _ in range(2)]


def test_fingerprints_almost_equal_are_compared_too(spark):
    got, plain = groups_and_plain(spark, edge_pair(329, 34, 4))  # alike by 0.79, 19 bits differ
    assert got == plain == [[0], [1]]


def test_fingerprints_far_apart_of_sets_that_are_alike(spark):
    got, plain = groups_and_plain(spark, edge_pair(1752, 12, 1))  # alike by 0.8, 59 bits differ
    assert got == plain == [[0, 1]]


def test_runs_are_cut_by_weight_at_every_row():
    keys = [1] * 100 + [2] * 3 + [3] * 50
    heavy = [1] * 40 + [1000] * 5 + [1] * 55 + [1] * 3 + [400] * 50
    batch = pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "n": pa.array(heavy, pa.int64())})
    pieces = [batch.slice(a, 30) for a in range(0, len(batch), 30)]
    found = [(r.column("key")[0].as_py(), r.column("n").to_pylist(), whole) for r, whole in simhash.runs(iter(pieces), 64, "n", 1500)]
    assert sum((n for _, n, _ in found), []) == heavy and all(sum(n[:-1]) <= 1500 and len(n) <= 65 for _, n, _ in found)
    assert [whole for k, _, whole in found if k == 2] == [True] and not any(whole for k, _, whole in found if k != 2)


def test_trees_of_wide_fingerprints_find_what_may_be_alike():
    """The pairs within the radius, from trees that are built row by row or level by level, with equal rows and rows at one distance."""
    rnd = np.random.default_rng(5)
    for n, few, flips in ((1, 1, 0), (2, 2, 9), (12, 4, 40), (16, 16, 70), (17, 5, 40), (90, 9, 60), (200, 150, 45)):
        values = rnd.integers(0, 2**63, (few, 4), dtype=np.uint64)[rnd.integers(0, few, n)]
        for i in range(0, n, 2):
            for bit in rnd.integers(0, 256, flips):
                values[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        near = np.bitwise_count(values[:, None] ^ values).sum(axis=2) <= simhash.DIFFER
        found = [pair for i, j in simhash.tree_pairs(values, simhash.DIFFER) for pair in zip(i.tolist(), j.tolist())]
        assert len(found) == len(set(found)) and set(found) == set(zip(*(side.tolist() for side in np.nonzero(near))))
    apart = np.array([[1 << i, 0, 0, 0] for i in range(40)], np.uint64)  # each below the one before
    assert sum(len(i) for i, _ in simhash.tree_pairs(apart, 1)) == 40 and sum(len(i) for i, _ in simhash.tree_pairs(apart, 2)) == 1600
