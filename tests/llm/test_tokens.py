import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_vocabulary())


def texts():
    rng = random.Random(1)
    out = ["", " ", "  a", "a  ", "a\x1cb \x1f c", "\x85\xa0 x", "don't I'LL'll 've", "日本語 テスト１２", "a<|endoftext|>b<|endoftext|>", "a" * 3000, "ab" * 999, "!!!???\n\n\n  x", "é́ ²³¼ ªº", "🙂🙂a", "ǅ Ⅷ ೨", "\0special x\0"]
    out += ["".join(rng.choice("aeths \n'0!éß\x1c 日") for _ in range(rng.randint(1, 200))) for _ in range(500)]
    return out + ["".join(chr(rng.choice([rng.randint(0, 255), rng.randint(0, 0x2FFF)])) for _ in range(rng.randint(1, 80))) for _ in range(300)]


def test_ids_equal_the_library(library):
    got = tokens.Tokens(tokens.default_vocabulary(), ids=True).batch(texts())
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts()]


def test_whole_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in tokens.count_tokens(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)


def test_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tokens, "CACHE", 10)
    counter = tokens.Tokens(tokens.default_vocabulary())
    assert [counter.batch([t])[0] for t in texts()] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts()]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x" * 100000)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.n_bytes) for r in tokens.count_tokens(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 100000)] and tokens.count_tokens(docs.limit(0)).count() == 0
