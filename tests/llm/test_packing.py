import random
from zlib import crc32

import numpy as np
import pytest

from textloom.llm import packing


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_the_piecewise_method(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs, bins = packing.best_fit(histogram, capacity)
    used = {}
    for n, own in runs.items():
        assert sum(r[1] for r in own) == histogram[n]
        for rank, count, first, per, offset in own:
            for i in range(count):
                used.setdefault(first + i // per, []).append((offset + i % per * n, n))
    assert len(used) == bins
    rooms = []
    for places in used.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        rooms.append(capacity - end)
    assert sorted(rooms) == one_by_one(lengths, capacity)


def test_whole_table(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs).toPandas()
    library = Tokenizer.from_file(packing.default_vocabulary())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(rows.doc_id) == set(texts)
    for doc_id, own in rows.groupby("doc_id"):
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in own.sort_values("piece").itertuples():
            assert r.start == at and r.ids_crc32 == crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 1024
    assert rows.sequence_id.nunique() == len(one_by_one(rows.length.tolist(), 1024))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "a" * 5000, "z")], "doc_id long, text string, length string")
    rows = packing.pack(docs, with_ids=True).collect()
    assert sorted(r.length for r in rows)[:3] == [1, 1, 1]
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(docs.limit(0)).count() == 0
