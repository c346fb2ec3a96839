import zlib

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import langid


def plain_kernel(a, b):
    total = 0
    for n in (1, 2, 3):
        x, y = ({tuple(s[i : i + n]) for i in range(len(s) - n + 1)} for s in (langid.alphabet()[[ord(c) for c in t]].tolist() for t in (a, b)))
        total += len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y)))
    return total / 3


def test_kernel_equals_the_plain_one():
    texts = ["Der Hund läuft.", "the dog runs, the cat", "é", "日本 12", "a"]
    packed = [np.packbits(has).tobytes() for t in texts for has, _ in langid.Presence().of(t)]
    slots, matrix = langid.landmark_matrix(packed)
    assert np.allclose(langid.kernel(texts, slots, matrix), [[plain_kernel(a, b) for b in texts] for a in texts], atol=1e-5)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, t, x, "s") for i, (t, x) in enumerate([(None, "en"), ("", "en"), ("12 !", "de"), ("the dog", "en"), ("der hund", "de"), ("the cat", None)] * 4)] + [(None, "x y", "en", "s")],
        "doc_id long, text string, lang string, score string",
    )
    rows = langid.identify(docs).collect()
    assert len(rows) == 25 and {r.lang_pred for r in rows if r.doc_id is not None and r.doc_id % 6 < 3} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id is not None and r.doc_id % 6 == 3} == {"en"}
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_grams(text):
    signs = [int(langid.alphabet()[ord(c)]) for c in text]
    return [{tuple(signs[i : i + n]) for i in range(len(signs) - n + 1)} for n in langid.ORDERS]


def kernel_of_sets(a, b):
    return sum(len(x & y) / (max(1, len(x)) * max(1, len(y))) ** 0.5 for x, y in zip(a, b)) / len(langid.ORDERS)


def test_predictions_equal_a_plain_ridge_regression(spark):
    """Landmarks, features and regressions anew, by sets of grams and by least squares over rows that penalise the weights."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", langid.held_out().alias("out"), F.xxhash64("doc_id").alias("h")).collect()
    known = [r for r in rows if not r.out and r.lang is not None and r.text]
    langs = sorted({r.lang for r in known})
    landmarks, most_rows, ridge = 24, 200, 1e-3
    least = {}
    for r in known:
        key = r.lang, r.h % (most_rows // len(langs))
        least[key] = min(least.get(key, (r.h, r.doc_id, r.text)), (r.h, r.doc_id, r.text))
    sample, marks = [], []
    for lang in langs:
        own = sorted(v for (k, _), v in least.items() if k == lang)
        sample += [(lang, t) for _, _, t in own]
        marks += [t for _, _, t in own[: landmarks // len(langs)]]
    grams = {t: plain_grams(t) for t in [*marks, *(t for _, t in sample), *(r.text for r in rows if r.text)]}
    kernel = lambda texts: np.array([[kernel_of_sets(grams[t], grams[m]) for m in marks] for t in texts])
    values, vectors = np.linalg.eigh(kernel(marks))
    good = values > 1e-8 * values[-1]
    features = lambda texts: kernel(texts) @ vectors[:, good] / np.sqrt(values[good])
    phi, names = features([t for _, t in sample]), [lang for lang, _ in sample]
    weight = np.array([1 / names.count(x) for x in names])
    weight *= len(weight) / weight.sum()
    goal = np.where(np.array(names)[:, None] == np.array(langs), 1.0, -1.0)
    wide = np.c_[phi, np.ones(len(phi))] * np.sqrt(weight)[:, None]
    penalty = np.c_[np.sqrt(ridge * len(phi)) * np.eye(phi.shape[1]), np.zeros(phi.shape[1])]
    beta = np.linalg.lstsq(np.r_[wide, penalty], np.r_[goal * np.sqrt(weight)[:, None], np.zeros((phi.shape[1], len(langs)))], rcond=None)[0]
    texts = {r.doc_id: r.text for r in rows if r.text and any(c.isalpha() for c in r.text)}
    scores = dict(zip(texts, np.c_[features(list(texts.values())), np.ones(len(texts))] @ beta))
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs, landmarks, most_rows, ridge)).collect()}
    for doc_id, r in got.items():
        if doc_id not in scores:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = np.exp(3 * scores[doc_id])
        p /= p.sum()
        assert abs(r.score - p[langs.index(r.lang_pred)]) < 1e-2 and p.max() - p[langs.index(r.lang_pred)] < 1e-2


def test_every_language_is_learned(spark):
    """More languages than landmarks, a block of regressions at a time; a language of one row is learned too."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 12)) for _ in range(90)]
    rows = [(i, f"{words[i % 89]} {words[i % 89]}", f"l{i % 89}") for i in range(900)] + [(1001, words[89], "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, most_rows=300, most_landmarks=60, block=25)
    assert len(model.langs) == 90 and model.landmarks.shape[1] == 60 and model.weights.shape == (60, 90)
    whole = langid.fit(docs, most_rows=300, most_landmarks=60, block=1000)
    assert np.allclose(model.weights, whole.weights) and np.allclose(model.bias, whole.bias)
    full = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs, most_rows=300)).collect()}
    assert np.mean([full[i] == lang for i, _, lang in rows]) > 0.97 and full[1001] == "rare"


def test_repeated_rows_are_one_row_of_the_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    hot = docs.filter(~langid.held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).orderBy("doc_id").limit(1)
    again = docs.union(hot.crossJoin(spark.range(700)).drop("id"))
    once, often = (langid.fit(d, most_rows=256) for d in (docs, again))
    assert once.langs == often.langs and (once.slots == often.slots).all() and np.allclose(once.weights, often.weights, atol=1e-6)
