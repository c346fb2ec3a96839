import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import topk


def plain(rows, k=10):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n_own, (q, a) in enumerate(ok):
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for n_b, (i, b) in enumerate(ok) if n_b != n_own and len(b) == len(a))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def got(frame, **options):
    return sorted(tuple(r) for r in topk.search(frame, F.col("vec_id") % 100 == 0, **options).collect())


def test_whole_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert got(frame) == plain([(r.vec_id, r.embedding) for r in frame.collect()])


@pytest.mark.parametrize("options", [{"queries": 1, "components": 150, "sample": 5}, {"queries": 2, "components": 60, "sample": 100}, {}])
def test_blocks_ties_and_signs(spark, options):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(301)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert got(frame, **options) == plain(rows)


def scored_share(vectors, queries, k=10, block=2048):
    best = topk.Best.of(queries, np.full(len(queries), -1), np.full(len(queries), -np.inf))
    for a in range(0, len(vectors), block):
        part = vectors[a : a + block]
        topk.search_block(best, part, np.arange(a, a + len(part)), np.arange(a, a + len(part)), k)
    for q, scores, ids in zip(queries, best.scores, best.ids):
        order = sorted(zip((-(vectors @ q)).tolist(), range(len(vectors))))[:k]
        assert list(zip((-scores).tolist(), ids.tolist())) == order
    return best.scored / best.pairs


def test_share_of_pairs_that_are_scored():
    """The bound stops early where components differ in size or neighbours are near, and never where directions are alike."""
    rng = np.random.default_rng(2)
    alike = rng.normal(size=(16384, 32))
    fading = alike * 0.6 ** np.arange(32)
    centres = rng.normal(size=(8, 32))
    groups = centres[np.sort(rng.integers(0, 8, 16384))] + 0.05 * alike
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    share = {name: scored_share(np.floor(1024 * v), np.floor(1024 * v[::500])) for name, v in {"alike": unit(alike), "fading": fading, "groups": unit(groups)}.items()}
    print("pairs scored:", share)
    assert share["alike"] > 0.9 and share["fading"] < 0.5 and share["groups"] < 0.6


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [1.0, 2.0]), (6, [1.0]), (100, [0.0, 0.0]), (200, []), (300, [1e30, -1e30])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    found = got(frame)
    assert [r for r in found if r[0] == 0][-1][2] == 300 and [r[2] for r in found if r[0] == 100] == [0, 5, 300]
    assert not [r for r in found if r[0] == 200]
    assert topk.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    repeated = [(0, [1.0]), (0, [1.0]), (0, [3.0]), (7, [2.0]), (7, [2.0])]
    assert got(spark.createDataFrame(repeated, "vec_id long, embedding array<double>")) == plain(repeated)
