import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import chunking, opening


def lines(n):
    return "\n".join(f"[{i % 60:02}:{i % 59:02}] line {i}" if i % 3 else f"and more of {i}" for i in range(n))


def plain_segments(text):
    out = []
    for line in (x.strip() for x in text.split("\n")):
        m = re.match(r"\[(\d\d):(\d\d)\]\s*(.*)$", line)
        if m and int(m[1]) <= 59 and int(m[2]) <= 59:
            out.append([(int(m[1]) * 60 + int(m[2])) * 1000, [m[3].strip()] if m[3].strip() else []])
        elif line:
            if not out:
                out.append([0, []])
            out[-1][1].append(line)
    return [(ms, "\n".join(parts)) for ms, parts in out if parts]


def test_segments(spark):
    texts = [lines(50), "before\n\n[00:01] a\n[00:02]\n\n b \nc\n[99:00] no mark\n[00:03] d", "[00:05]\n[00:06] x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: [(s.ms, s.text) for s in r.s] for r in frame.select("k", chunking.segments(F.col("t")).alias("s")).collect()}
    assert got == {k: plain_segments(t) for k, t in enumerate(texts)}


def test_long_transcripts_take_time_in_proportion(spark):
    took = {}
    for n in (1000, 8000, 32000):
        frame = spark.createDataFrame([(n, lines(n))], "k int, t string")
        began = time.time()
        rows = chunking.transcript_chunks(frame, "k", "t").agg(F.count("*"), F.sum("end_ms")).first()
        took[n] = time.time() - began
        assert rows[0] > n / 3
    print("seconds by lines:", took)
    assert took[32000] < 8 * max(took[8000], 1)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_sums(spark, n):
    row = spark.range(1).select(chunking.sums_before(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x) if n else F.array().cast("array<int>"))).first()[0]
    assert row == [i * (i + 1) // 2 for i in range(n)]


def test_ranges_meet_by_bins(spark):
    """One recording with many chunks and many ranges: pairs are near those that overlap, and each is found once."""
    chunks = [("a", i, i * 700, i * 700 + (90_000 if i % 50 == 0 else 900)) for i in range(3000)] + [("a", 9000, 500, 0), ("b", 1, 0, 5)]
    wanted = [("a", i * 1000, i * 1000 + i % 7 * 100) for i in range(2000)] + [("a", 5000, 4000), ("c", 0, 10)]
    c = spark.createDataFrame(chunks, "rel_path string, chunk_id int, start_ms int, end_ms int")
    w = spark.createDataFrame(wanted, "rel_path string, from_ms int, to_ms int")
    last = lambda a, b: a if b <= 0 or b < a else b
    want = sorted((i, f) for p, i, s, e in chunks for q, f, t in wanted if p == q and s <= last(f, t) and f <= last(s, e))
    found = opening.overlapping(c, w, 2000)
    assert sorted((r.chunk_id, r.from_ms) for r in found.collect()) == want
    pairs = opening.binned(c, "start_ms", "end_ms", 2000).join(opening.binned(w, "from_ms", "to_ms", 2000), ["rel_path", "bin"]).count()
    assert pairs < 4 * len(want) < len(chunks) * len(wanted) / 50
