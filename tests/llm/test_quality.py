import random
import re

from pyspark.sql import functions as F

from textloom.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)), len(often)


def test_measures_equal_the_plain_ones():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b", "a a a a", "x\n x\nx\n"] + [" ".join(rng.choice(["a", "b", "#c", "é\xa0é", "\n", "d\n", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    assert [quality.measure_text(t) for t in texts] == [plain(t) for t in texts]


def test_policies_and_ablation(spark, sf):
    book = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    rows = quality.apply_policies(book).collect()
    kept = [r for r in rows if not any(rule.failed(r.asDict()) for rule in quality.RULES if rule.name in quality.PRODUCTION.rules)]
    assert sum(r.production_v1 for r in rows) == len(kept)
    for r in quality.ablation(book).collect():
        rule = next(x for x in quality.RULES if x.name == r.rule)
        others = [x for x in quality.RULES if x.name in quality.PRODUCTION.rules and x.name != rule.name]
        passing = [m for m in rows if not any(o.failed(m.asDict()) for o in others)]
        assert r.n_failed == sum(bool(rule.failed(m.asDict())) for m in rows)
        assert r.n_kept_without == len(passing) and r.n_only == sum(bool(rule.failed(m.asDict())) for m in passing)


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.apply(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    long = [r for r in got if r.n_words >= 50]
    assert sum(r.kept == bool(r.quality) for r in long) >= 0.97 * len(long)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a b " * 30), (3, "w%d " * 60)], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality.apply(docs).collect())
    assert got == [(0, 60, True, False), (1, 0, True, False), (1, 0, True, False), (3, 60, True, False)]
    assert quality.apply(docs.limit(0)).count() == 0 and quality.keep(docs).count() == 0
