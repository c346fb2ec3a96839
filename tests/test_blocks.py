import numpy as np

from textloom.operators import vectors as V
from textloom.operators.blocks import Blocks, centres_of, directions


def frame_of(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "chunk_id long, embedding array<float>").repartition(4)


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_search_by_blocks_equals_the_whole_search(spark):
    """On clustered data few blocks are read, on data without clusters perhaps all; the rows are the same."""
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(40, 16))
    clustered = middle[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16))
    shares = {}
    for name, data in (("clustered", clustered), ("even", rng.normal(size=(600, 16)))):
        frame = frame_of(spark, data.astype(np.float32).tolist())
        made = Blocks.of(frame, blocks=48, sample=1000)
        read = []
        for query in (data[5], data[17] * 3, -data[9], rng.normal(size=16)):
            query = query.tolist()
            assert rows(made.search(query, 7)) == rows(V.search(frame, query, 7))
            read.append(len(made.needed(query, 7)) / len(made.known))
        shares[name] = read
    print("share of blocks read:", shares)
    assert max(shares["clustered"][:2]) < 0.2
    passing = frame.filter("chunk_id % 3 = 0").select("chunk_id")
    assert rows(made.search(query, 5, passing)) == rows(V.search(frame.filter("chunk_id % 3 = 0"), query, 5))


def test_odd_vectors(spark):
    vectors = [[1.0, 0.0], [0.0, 0.0], None, [1.0, 0.0, 0.0], [2.0, 0.0], [0.5, 0.5], [], [-1.0, 0.0], [1.0, 0.0]]
    frame = frame_of(spark, vectors)
    made = Blocks.of(frame)
    for query in ([1.0, 0.0], [0.0, 0.0], [0.0, 1.0, 0.0], [-1.0, -1.0], [1.0] * 5):
        assert rows(made.search(query, 4)) == rows(V.search(frame, query, 4))
    few = Blocks.of(frame, sample=1)  # a dimension that the sample doesn't meet
    assert rows(few.search([1.0, 0.0], 4)) == rows(V.search(frame, [1.0, 0.0], 4)) and rows(few.search([1.0, 0.0, 0.0], 4)) == rows(V.search(frame, [1.0, 0.0, 0.0], 4))
    assert rows(Blocks.of(frame.limit(0)).search([1.0, 0.0], 4)) == []


def test_centres():
    unit = directions([[1, 0], [2, 0], [0, 3], [0, 0]])
    assert unit.tolist() == [[1, 0], [1, 0], [0, 1], [0, 0]] and len(centres_of(unit[:3], 9)) == 2
