import math
import re
from urllib.parse import unquote

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.llm import lexical


def cut(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]


def plain(docs, items, k=10):
    words = [(d, cut(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    held = {}
    for _, w in words:
        for t in set(w):
            held[t] = held.get(t, 0) + 1
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in held.items()}
    out = []
    for item, text in items:
        terms, scored = set(cut(text)), []
        for d, w in words:
            m = 100 - 90 + 90 * len(w) * n // total if total else 0
            score = sum(weight[t] * (1000000000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms & set(w))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def got(docs, items, **options):
    return sorted((tuple(r) for r in lexical.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_small_table(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert got(docs, items) == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.mark.parametrize("options", [{}, {"k": 3, "entries": 5, "matches": 20}, {"k": 1, "matches": 1}])
def test_ties_blocks_and_ranges(spark, monkeypatch, options):
    """Few words, so that many scores are equal; small blocks, segments and ranges."""
    rng = np.random.default_rng(7)
    make = lambda n: " ".join(rng.choice(list("abcdE"), n))
    docs = [(int(i), make(rng.integers(0, 6))) for i in rng.permutation(150)] + [(3, "a b"), (3, "a b"), (None, "a b"), (1000, None)]
    items = [(i, make(rng.integers(0, 4))) for i in range(15)] + [(1, "c d"), (20, "zzz"), (21, None), (None, "a")]
    monkeypatch.setattr(lexical, "DOCUMENTS", 13)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit("x")}).repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({"terms": F.lit("clash"), "item": F.lit(1)})
    k = options.get("k", 10)
    assert [r for r in got(d, b, **options)] == plain(docs, items, k)


def test_odd_rows(spark):
    docs = [(1, "x " * 50000), (2, None), (3, ""), (4, "X é. É"), (5, "é É x")]
    items = [(1, "x"), (2, "É"), (3, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(d, b) == plain(docs, items)
    assert got(d.limit(0), b) == got(d, b.limit(0)) == got(d.filter("doc_id = 2"), b) == []
    names = d.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert [(r[0], r[1], r[2][1:]) for r in got(names, b)] == [(r[0], r[1], str(r[2])) for r in got(d, b)]


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 32, 5000).astype(np.uint32)
    keys[::3] = keys[0]
    assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()


def test_a_row_group_of_the_index_holds_one_segment(spark):
    """A reader decodes a row group at once, so groups don't grow with what a task writes."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(1_200_000)), lambda i: F.hex(i + F.col("id"))))
    found = lexical.index(spark.range(0, 6, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text")))
    most = [pq.ParquetFile(p.removeprefix("file:")).metadata for p in map(unquote, found.inputFiles())]
    assert found.count() >= 2 and max(m.row_group(g).num_rows for m in most for g in range(m.num_row_groups)) == 1
