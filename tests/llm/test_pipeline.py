import re
import zlib

import numpy as np
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import mixing, packing, quality, simhash
from textloom.llm.tokens import default_vocabulary


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, rows, sf)
        assert name == "best_fit_packing" or made.columns == docs.columns
        rows = spark.createDataFrame(made.collect(), made.schema)
        seen.append(rows)
    judged = {r.doc_id for r in quality.apply(docs).filter("kept").collect()}
    assert {r.doc_id for r in seen[0].collect()} == judged
    assert seen[1].select("doc_id").exceptAll(seen[0].select("doc_id")).count() == 0 and seen[1].select("text").distinct().count() == seen[1].count()
    assert seen[2].filter(r"text RLIKE '[a-z0-9]@[a-z0-9]+[.]example[.]com'").count() == 0 and seen[2].count() == seen[1].count()
    assert {r.doc_id for r in seen[4].select("doc_id").distinct().collect()} == {r.doc_id for r in seen[3].collect()}


def test_run_and_empty_table(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_with_clashing_names(spark, sf):
    clash = ("row", "size", "copies", "node", "own", "spans", "taken", "shard", "clean", "words")
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", *(f"doc_id AS {c}" for c in clash))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, rows, sf)
        if name != "best_fit_packing":
            assert made.columns == rows.columns
            rows = spark.createDataFrame(made.collect(), made.schema)
            assert all(r[c] == r.doc_id for r in rows.collect() for c in clash)
    assert made.count() > 0


def test_repeated_and_null_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    odd = rows.union(rows).union(rows.limit(3).selectExpr("NULL", "text", "NULL", "NULL", "NULL")).union(rows.limit(2).selectExpr("doc_id", "NULL", "lang", "source", "n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, sf)
        odd = spark.createDataFrame(made.collect(), made.schema)
    assert odd.count() > 0


def plain_kept(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    again = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    bad = (
        len(words) < 50, 100 * len(again) > 50 * len(words), 10 * len(re.findall("[#*$%&|<>]", text or "")) > 3 * len(words),
        len(lines) >= 4 and 10 * (len(lines) - len(set(lines))) > 5 * len(lines), len("".join(words)) > 30 * len(words),
    )
    return not any(bad)


def test_stages_equal_brute_force(spark, sf):
    """Each stage on what the one before kept, in plain Python, up to the rows that run() returns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.filter("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 10000).withColumn("text", F.concat("text", F.lit(" tail"))))
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["quality_rules"](spark, docs, sf)
    rows = {r.doc_id: r for r in docs.collect()}
    wanted = {i for i, r in rows.items() if plain_kept(r.text)}
    assert {r.doc_id for r in kept.collect()} == wanted

    left = stage["near_dedup"](spark, kept, sf)
    ids = sorted(wanted)
    sets = [set(simhash.shingles(rows[i].text, 5)) for i in ids]
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    stay = [r.doc_id for r in left.collect()]
    assert sorted(root[ids.index(i)] for i in stay) == sorted(set(root)) and len(set(root)) < len(ids)

    clean = spark.createDataFrame(stage["personal_data"](spark, left, sf).collect(), docs.schema)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == set(stay) and not [t for t in texts.values() if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    parts = {i: re.split("<[A-Z]+>", texts[i]) for i in stay}
    assert all(p in rows[i].text for i in stay for p in parts[i])  # nothing but spans was changed

    mixed = stage["mix_sources"](spark, clean, sf).collect()
    size = {i: len(t.encode().split()) for i, t in texts.items()}
    sources = sorted({r.source for r in clean.collect()})
    words = [sum(size[i] for i in texts if rows[i].source == s) for s in sources]
    for s, goal, own in zip(sources, mixing.targets(words, [(3, 1, 2)[i % 3] for i in range(len(sources))]), words):
        docs_of = [size[i] for i in texts if rows[i].source == s]
        assert abs(sum(size[r.doc_id] for r in mixed if r.source == s) - goal) <= max(docs_of) / 2 + 16 and goal <= 2 * own
    copies = np.array([sum(r.doc_id == i for r in mixed) for i in texts])
    assert copies.max() <= 2

    packed = stage["best_fit_packing"](spark, spark.createDataFrame(mixed, docs.schema), sf).collect()
    tokens = tokenizers.Tokenizer.from_file(default_vocabulary())
    pieces = []
    for r in mixed:
        own = np.array([*tokens.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        points = packing.cut_points(len(own), 1024)
        pieces += [(r.doc_id, k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(points, points[1:]))]
    assert sorted(pieces) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    bins = []
    for n in sorted((p[3] for p in pieces), reverse=True):
        fit = min((room for room in bins if room >= n), default=None)
        if fit is None:
            bins.append(1024 - n)
        else:
            bins[bins.index(fit)] -= n
    at = {}
    for r in packed:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(at) == len(bins)
    for own in at.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
