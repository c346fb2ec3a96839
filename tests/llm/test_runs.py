import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import runs
from textloom.llm.words import WHITE_SPACE, Words


def plain(words):
    """(start, length, period) of all runs, by the definition."""
    n, found = len(words), []
    has = lambda a, b, q: all(words[i] == words[i + q] for i in range(a, b - q))
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            b = i + q
            if b - a >= max(6, 4 * q) and not any(has(a, b, p) for p in range(1, q)):
                found.append((a, b - a, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def cut(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def row(doc_id, text):
    words = cut(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(found), *top, top[0] if top[0] is None else 1000 * top[1] // top[2], sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(kept(words, found)))


def got(frame):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return [tuple(r) for r in runs.digest(frame).select(*names).collect()]


def key(rows):
    return sorted(rows, key=str)


repeated = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)).map(lambda x: x[0] * x[1])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(repeated, st.lists(st.integers(0, 5), max_size=5)), max_size=5))
def test_runs_of_numbers(parts):
    words = [w for p in parts for w in p]
    numbers = np.array(words, np.int64)
    assert sorted((a, b - a, q) for a, b, q in runs.runs_of(numbers, len(words)).tolist()) == sorted(plain(words))


def test_batches_of_texts():
    rng = np.random.default_rng(3)
    texts = []
    for n in range(200):
        head, root = rng.integers(0, 4, rng.integers(0, 9)).tolist(), rng.integers(0, 3, rng.integers(1, 20)).tolist()
        texts.append(" \t".join(f"w{x}é" for x in head + root * int(rng.integers(1, 8)) + head))
    texts[3] = None
    words = Words.of(pa.array(texts), WHITE_SPACE, lower=False)
    doc, found = runs.runs_in(words)
    for d, text in enumerate(texts):
        assert sorted((a, b - a, q) for a, b, q in found[doc == d].tolist()) == sorted(plain(cut(text)))
    assert runs.collapsed(words, doc, found).to_pylist() == [" ".join(kept(cut(t), plain(cut(t)))) for t in texts]


def test_long_texts():
    """Work stays near the length of the text where one word, or one passage, fills it."""
    same = np.zeros(300_000, np.int64)
    assert runs.runs_of(same, len(same)).tolist() == [[0, 300_000, 1]]
    passage = np.tile(np.arange(5000), 40)
    assert runs.runs_of(passage, len(passage)).tolist() == [[0, 200_000, 5000]]
    mixed = np.concatenate([np.tile([0, 1], 40_000), np.tile([0, 1, 2], 30_000), np.zeros(9, np.int64)])
    assert sorted((a, b - a, q) for a, b, q in runs.runs_of(mixed[79_960:80_080], 120).tolist()) == sorted(plain(mixed[79_960:80_080].tolist()))
    assert [q for _, _, q in runs.runs_of(mixed, len(mixed)).tolist()] == [2, 3, 1]


def test_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 6000")
    assert key(got(runs.with_tails(docs))) == key([row(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    tails = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    texts = [(0, None), (1, ""), (2, " \t\n"), (3, "a " * 6), (3, "a " * 6), (4, "a " * 5), (5, "x\0y z " * 4), (6, "A a " * 4), (None, "b " * 9), (7, "é ü " * 3000 + "é"), *((i, "one two three four five six seven " * (n + 1)) for n, i in enumerate(tails)), (tails[0], None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"runs": F.lit("clash"), "n_words": F.lit(1), "start": F.lit(2)})
    assert key(got(runs.with_tails(docs))) == key([row(*r) for r in texts])
    assert got(runs.with_tails(docs.limit(0))) == [] and got(docs.limit(0)) == []
