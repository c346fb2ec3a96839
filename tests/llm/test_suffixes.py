import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import suffixes


def plain(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if n[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def got(frame, **options):
    rows = suffixes.strip(frame, **options).drop("kept").collect()
    return sorted((r.doc_id, tuple(r)[1:]) for r in rows)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(30, 90))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 80)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a : len(p) - rng.randint(0, len(p) // 3)], word()]
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize(("seed", "most", "piece"), [(1, 512, 8), (2, 512, 8), (3, 2, 8), (3, 0, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, most, piece):
    other_way, repeated = [], suffixes.repeated
    monkeypatch.setattr(suffixes, "repeated", lambda rows, *a, **o: (other_way.append(rows.count()) if "more_place" in o else None, repeated(rows, *a, **o))[1])
    texts = corpus(seed) + ["x" * 1500, "ab" * 400, "ab" * 120, "y" * 199, "z" * 200, None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(frame, most=most, piece=piece) == sorted(enumerate(plain(texts)))
    assert len(other_way) == 1 and (other_way[0] > 100 or most == 512)  # pieces that were compared by hashes


def test_long_texts_in_segments(spark):
    texts = [" ".join(corpus(4, 12)), *corpus(4, 12), "abc" * 2000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(frame, place_bits=10) == sorted(enumerate(plain(texts)))
    rows = frame.filter("octet_length(text) >= 200").selectExpr("doc_id", "1L AS sig", "text")
    places = [{(r.doc_id, r.first, r.size) for r in suffixes.all_stretches(rows, 200, "bigint", bits).collect()} for bits in (10, 24)]
    assert places[0] != places[1] and all(f + n <= f - f % 825 + 825 for _, f, n in places[0])  # 1024 bytes have 825 windows


def test_quicksort_of_windows():
    rng = random.Random(5)
    for kind in ("ab", "abcdefgh", "a"):
        for _ in range(20):
            base = "".join(rng.choice(kind) for _ in range(400)).encode()
            texts = [base[a : a + rng.randint(64, 150)] for a in (rng.randint(0, 240) for _ in range(rng.randint(1, 12)))]
            runs = sorted(rng.randint(0, 2) for _ in texts)
            n = Counter((r, t[i : i + 64]) for r, t in zip(runs, texts) for i in range(len(t) - 63))
            want = [[n[r, t[i : i + 64]] > 1 for i in range(len(t) - 63)] for r, t in zip(runs, texts)]
            assert [x.tolist() for x in suffixes.equal_windows(texts, runs, 64)] == want


def test_keys_keep_the_order_of_leading_bytes():
    raw = "".join(random.Random(6).choice("abcé zß") for _ in range(4000)).encode()
    key, _, _ = suffixes.stretches(raw, 200)
    data, hashes = suffixes.np.frombuffer(raw, suffixes.np.uint8), suffixes.token_hashes(suffixes.np.frombuffer(raw, suffixes.np.uint8))
    all_keys = suffixes.leading(data, hashes, suffixes.np.arange(len(hashes)))
    lead = [raw[i : i + 4] for i in suffixes.np.argsort(all_keys.view(suffixes.np.int64), kind="stable")]
    assert lead == sorted(lead) and set(key.tolist()) <= set(all_keys.tolist())


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    assert got(docs) == sorted(zip([r.doc_id for r in rows], plain([r.text for r in rows])))


def test_odd_rows(spark):
    text = corpus(9, 1)[0] * 3
    frame = spark.createDataFrame([(1, text), (1, text), (2, None), (None, "q" * 300)], "doc_id long, text string").withColumn("sig", F.lit(1))
    rows = suffixes.strip(frame).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == sorted([(len(text.encode()),) * 2] * 2 + [(0, 0), (300, 300)])
    assert suffixes.strip(frame.limit(0)).count() == 0
