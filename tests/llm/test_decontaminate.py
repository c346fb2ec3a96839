import hashlib
import re
from urllib.parse import unquote

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate


def cut(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, window=10, slop=0):
    """Windows looked for at every place of every document."""
    asked = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            asked.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(w) for w in asked}
    out = []
    for doc_id, text in docs:
        w, hit, found = cut(text), set(), set()
        if not slop:
            for n in sizes:
                for i in range(len(w) - n + 1):
                    own = asked.get(tuple(w[i : i + n]))
                    if own:
                        hit |= set(range(i, i + n))
                        found |= own
        else:
            for terms, own in asked.items():
                for s in range(len(w) - len(terms) + 1):
                    if all(t in w[max(0, s + j - slop) : max(0, s + j + slop + 1)] for j, t in enumerate(terms)):
                        hit |= set(range(s, s + len(terms)))
                        found |= own
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc_id, len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(docs, items, **options):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in decontaminate.digest(docs, items, **options).select(*names).collect()), key=str)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(docs, items) == want and sum(r[5] for r in want) > 5


@pytest.mark.parametrize("options", [{}, {"window": 3}, {"window": 3, "slop": 1}, {"window": 4, "slop": 2}, {"window": 3, "block_words": 7}])
def test_few_words(spark, monkeypatch, options):
    """Very frequent terms, repeated terms in a window, many blocks, candidates taken a few at a time."""
    rng = np.random.default_rng(5)
    make = lambda n: " ".join(rng.choice(list("abcdE"), n))
    docs = [(i, make(rng.integers(0, 40))) for i in range(60)] + [(5, "a b c a b c a b c"), (6, "é-É b, C.")]
    items = [(i, make(rng.integers(0, 9))) for i in range(12)] + [(3, "a b c a"), (None, "e e d d"), (99, "é"), (98, None), (97, " . ")]
    monkeypatch.setattr(decontaminate, "CANDIDATES", 50)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "item": F.lit("x"), "start": F.lit(2)}).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("clash"))
    own = {k: v for k, v in options.items() if k != "block_words"}
    assert got(d, b, **options) == plain(docs, items, **own)


def test_pieces_of_long_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 16)
    monkeypatch.setattr(decontaminate.pieces, "__defaults__", (*decontaminate.pieces.__defaults__[:-1], 16))
    words = [f"w{i}" for i in range(200)]
    docs = [(1, " ".join(words)), (2, " ".join(words[50:75])), (3, " ".join(words[50:59])), (4, " ".join(words[190:]))]
    items = [("long", " ".join(words))]
    assert got(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (1, None), (2, ""), (None, "one two"), (3, "one two " * 20000), (4, "One, TWO; one!")]
    items = [(7, "one two"), (8, "two one two"), (8, None), (9, "three")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(d, b) == plain(docs, items)
    assert got(d.limit(0), b) == []
    assert got(d, b.limit(0)) == plain(docs, [])
    with pytest.raises(ValueError):
        decontaminate.digest(d, b, window=250, slop=10)


def test_a_row_group_of_the_index_holds_one_segment(spark):
    """A reader decodes a row group at once, so groups don't grow with what a task writes."""
    docs = spark.range(0, 6, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('one two three four ', 500000)").alias("text"))
    found = decontaminate.index(docs)
    most = [pq.ParquetFile(p.removeprefix("file:")).metadata for p in map(unquote, found.inputFiles())]
    assert found.count() >= 3 and max(m.row_group(g).num_rows for m in most for g in range(m.num_row_groups)) == 1
