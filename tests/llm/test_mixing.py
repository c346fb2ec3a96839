import random

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import mixing


def plain_seats(weights, seats, most):
    own = [0] * len(weights)
    for _ in range(min(seats, sum(most))):
        best = max((w / (2 * n + 1), -i) for i, (w, n) in enumerate(zip(weights, own)) if n < most[i] and w > 0)
        own[-best[1]] += 1
    return own


def test_seats_equal_the_plain_method():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 12)
        weights = [rng.randint(1, 1000) for _ in range(n)]
        seats = rng.randint(0, 300)
        most = [rng.randint(0, 80) for _ in range(n)] if rng.random() < 0.5 else [seats] * n
        assert mixing.sainte_lague(weights, seats, most) == plain_seats(weights, seats, most)


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([0, 10], [3, 1]) == [0.0, 15.0]
    assert mixing.targets([], []) == []


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs).toPandas()
    sources = {r.doc_id: r.source for r in docs.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(sources)
    assert all(r.size == len(texts[r.doc_id].encode().split()) and 0 <= r.taken <= 2 * r.size for r in got.itertuples())
    got["source"] = got.doc_id.map(sources)
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 0.01 * own.target.iloc[0]
    assert mixing.mix(docs.repartition(3)).exceptAll(mixing.mix(docs)).count() == 0


def plain_taken(docs, block=16, seed=9, shard_rows=1000, most_shards=16384):
    """Block by block: the words of every block in the seeded order, and the first blocks of the permutation once more."""
    rows = docs.select("source", "doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("deal"), F.xxhash64(F.lit(seed + 1), "doc_id").alias("order"), "text").collect()
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    size = lambda r: len((r.text or "").encode().split())
    words = [sum(size(r) for r in rows if r.source == s) for s in sources]
    goal = mixing.targets(words, [(3, 1, 2)[i % 3] for i in range(len(sources))])
    shards = []
    for s in sources:
        own = [r for r in rows if r.source == s]
        n = max(1, min(-(-len(own) // shard_rows), most_shards * len(own) // len(rows)))
        shards.append([sorted((r for r in own if r.deal % n == k), key=lambda r: (r.order, r.doc_id)) for k in range(n)])
    blocks = [[-(-sum(map(size, own)) // block) for own in several] for several in shards]
    seats = plain_seats(goal, round(sum(goal) / block), [2 * sum(b) for b in blocks])
    out = {}
    for s, several, b, q in zip(sources, shards, blocks, seats):
        for k, (own, n, got) in enumerate(zip(several, b, plain_seats([sum(map(size, own)) for own in several], q, [2 * n for n in b]))):
            owner = [r.doc_id for r in own for _ in range(size(r))]
            out |= {r.doc_id: 0 for r in own}
            if n:
                factor, shift = mixing.permutation(s, k, n, seed)
                order = sorted(range(n), key=lambda j: (j * factor + shift) % n)
                assert sorted((j * factor + shift) % n for j in range(n)) == list(range(n))
                for times, chosen in ((got // n, order), (1, order[: got % n])):
                    for j in chosen:
                        for doc in owner[j * block : (j + 1) * block]:
                            out[doc] += times
    return out


def test_every_row_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect()} == plain_taken(docs)
    few = docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.lit("hot")))
    assert {r.doc_id: r.taken for r in mixing.mix(few, shard_rows=20).collect()} == plain_taken(few, shard_rows=20)
    many = docs.withColumn("source", F.when(F.col("doc_id") % 2 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 40)))
    assert {r.doc_id: r.taken for r in mixing.mix(many, shard_rows=10, most_shards=16).collect()} == plain_taken(many, shard_rows=10, most_shards=16)


def test_a_hot_source_among_many_is_split(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), "id")).alias("source"))
    sized = rows.select("source", F.xxhash64("id").alias("deal"), F.lit(3).cast("long").alias("size"))
    sources, quotas = mixing.apportioned(sized, shard_rows=1000)
    assert sources.filter("shards > 1").select("source_of", "shards").collect() == [("hot", 20)] and sources.count() == 10_001
    words = [w for source, _, w, _, _ in quotas if source == "hot"]
    assert len(words) == 20 and max(words) < 2 * 3 * 1000


def test_whole_documents_meet_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    goal = {r.source: (r.target, r.source_size) for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").select("source", "target", "source_size").distinct().collect()}
    made = mixing.mixture(docs)
    assert made.columns == docs.columns and made.groupBy("doc_id").count().filter("count > 2").count() == 0
    got = made.groupBy("source").agg(F.sum(mixing.sizes(made)).alias("words")).collect()
    off = {r.source: abs(r.words / goal[r.source][0] - 1) for r in got}
    assert len(off) == len(goal) and max(off.values()) < 0.01, off
    assert mixing.mixture(docs.repartition(7)).select("doc_id", "source").exceptAll(made.select("doc_id", "source")).count() == 0


def test_choice_within_a_shard():
    rng, off = np.random.default_rng(4), []
    for _ in range(200):
        n = int(rng.integers(1, 60))
        sizes = rng.integers(1, 2000, n)
        kinds, picks = np.log2(sizes).astype(int), rng.integers(0, 10**6, n)
        want = int(rng.integers(0, 2 * sizes.sum() + 1))
        total = {k: int(sizes[kinds == k].sum()) for k in kinds.tolist()}
        order = np.lexsort((picks, -kinds))
        rows = [("s", 1, want, int(sizes.sum()), k, total[k], p, s) for k, p, s in zip(kinds[order].tolist(), picks[order].tolist(), sizes[order].tolist())]
        plan = {k: (e, u) for source, _, k, e, u in mixing.choices([("r", 0, 5, 10, 3, 10, 1, 10), *rows]) if source == "s"}
        copies = np.array([plan[k][0] + (plan[k][1] is not None and p <= plan[k][1]) for k, p in zip(kinds.tolist(), picks.tolist())])
        off.append(abs((copies * sizes).sum() - want))
        assert copies.max() <= 2 and off[-1] <= sizes.max() / 2 + 1
    assert np.median(off) < 100


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (2, "a b", ""), (None, "c d e", None)], "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 3), (1, 0), (1, 0), (2, 2)]
    assert mixing.mix(docs.limit(0)).count() == 0
    rows = docs.select(F.col("size").alias("row"), F.lit(1).alias("kind"), F.lit(2).alias("shard"), "doc_id", "text", "source")
    made = mixing.mixture(rows)
    assert made.columns == rows.columns and {r.doc_id for r in made.collect()} <= {2, None}
    assert mixing.mixture(rows.limit(0)).count() == 0 and mixing.mixture(rows.filter("text IS NULL")).count() == 0
