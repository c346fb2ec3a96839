import io
import json
import math
import os
import random
import re
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom import rpc, schemas, session, tools
from textloom.corpus import Backends, Corpus, Settings
from textloom.functions import globs
from textloom.operators import annotations, changes, corpus, listing, retrieval, state
from textloom.operators import vectors as V
from textloom.sources import archives, discover, models, store
from textloom.streaming import worker


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def walked(root, most_bytes, use_ignore_files=True, follow_links=False):
    """A tree folder by folder, in one process: what discovery has to equal."""
    real_root, out, entered, level = os.path.realpath(root), [], {os.path.realpath(root)}, [("", str(root), [])]
    while level:
        below = {}
        for rel, at, rules in level:
            own = os.path.join(at, ".gitignore")
            if use_ignore_files and os.path.isfile(own):
                with open(own) as f:
                    rules = rules + globs.ignore_rules(f.read(), rel)
            for name in os.listdir(at):
                path, own_rel = os.path.join(at, name), f"{rel}/{name}" if rel else name
                real, folder = os.path.realpath(path), os.path.isdir(path)
                if os.path.islink(path) and (not follow_links or not real.startswith(real_root + "/")):
                    continue
                hit = [r for r in rules if (folder or not r["only_folders"]) and re.match(globs.rule_regex(r).replace(r"\z", r"\Z"), own_rel)]
                if (folder and name in discover.SKIPPED_FOLDERS) or (hit and not hit[-1]["negated"]):
                    continue
                if folder:
                    if real not in entered:
                        below[real] = min(below.get(real, (own_rel, path, rules)), (own_rel, path, rules), key=lambda x: x[0])
                elif os.path.isfile(path) and (most_bytes <= 0 or os.path.getsize(path) <= most_bytes):
                    out.append((own_rel, os.path.getsize(path), int(os.path.getmtime(path))))
        entered |= set(below)
        level = list(below.values())
    return sorted(out)


def test_discovery(spark, tmp_path, monkeypatch):
    for name in ("b.txt", "a/x.md", "a/y.log", ".git/config", "node_modules/m.js", "a/sub/z.log", "big.bin", "a/sub/deep/er/q.md", "a/build/out.md", "é/ü.md"):
        put(tmp_path, name, "x" * (100 if name == "big.bin" else 1))
    put(tmp_path, ".gitignore", "*.log\n")
    put(tmp_path, "a/.gitignore", "/build/\n")
    put(tmp_path, "a/sub/.gitignore", "!z.log\n")
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path, tmp_path / "a/sub/up")
    os.symlink(tmp_path / "a/sub/deep", tmp_path / "é/other")
    os.symlink("/etc", tmp_path / "outside")
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling")
    root = str(tmp_path)
    rows = lambda at=root, **o: sorted(tuple(r) for r in discover.listed(spark, at, most_bytes=50, **o).select("rel_path", "size_bytes", "mtime_unix").collect())
    want = walked(root, 50)
    scandir = os.scandir
    monkeypatch.setattr(os, "scandir", lambda *a: pytest.fail("listed on the driver"))
    got = rows()
    monkeypatch.setattr(os, "scandir", scandir)
    assert got == want and [r[0] for r in want] == [".gitignore", "a/.gitignore", "a/sub/.gitignore", "a/sub/deep/er/q.md", "a/sub/z.log", "a/x.md", "b.txt", "é/ü.md"]
    for options in ({"use_ignore_files": False}, {"follow_links": True}, {"use_ignore_files": False, "follow_links": True}):
        assert rows(**options) == walked(root, 50, **options)
    assert rows(f"file://{root}") == want
    monkeypatch.setattr(discover, "mounted", lambda at: None)  # as in file systems that are reached by their address alone
    os.remove(tmp_path / "a/sub/up")
    put(tmp_path, "a/é b/c#d.md", "y")
    stored = discover.listed(spark, f"file://{root}/a", most_bytes=50)
    assert sorted(r.rel_path for r in stored.collect()) == [".gitignore", "sub/.gitignore", "sub/deep/er/q.md", "sub/z.log", "x.md", "y.log", "é b/c#d.md"]
    assert [bytes(r.content) for r in discover.with_content(stored.filter("rel_path = 'é b/c#d.md'")).collect()] == [b"y"]


def test_files_are_read_once_and_archives_once_more(spark, tmp_path, monkeypatch):
    root, log, read = tmp_path / "root", str(tmp_path / "opened"), discover._read
    for n in range(2 * discover.READ_FILES + 1):
        put(root, f"f{n}.md", f"text of {n}")
    put(root, "bundle.zip", zipped(**{"in.md": "inside"}))
    own = Corpus(spark, str(root), f"file://{tmp_path}/state", settings=Settings(snapshot_s=0))
    listed = own.listed().coalesce(1).checkpoint()

    def reading(path):
        with open(log, "a") as f:
            f.write(path.rsplit("/", 1)[-1] + "\n")
        return read(path)

    monkeypatch.setattr(discover, "_read", reading)
    content = {r.rel_path: bytes(r.content) for r in own.files(listed).collect()}
    plain = {f"f{n}.md": f"text of {n}".encode() for n in range(2 * discover.READ_FILES + 1)}
    assert content.pop("bundle.zip/in.md") == b"inside" and content.pop("bundle.zip") and content == plain
    with open(log) as f:
        assert sorted(f.read().split()) == sorted([*plain, "bundle.zip", "bundle.zip"])


def test_archives():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in (("d/a.txt", b"aa"), ("../evil", b"x"), ("b.txt", b"b")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    assert list(archives.members("tar.gz", out.getvalue())) == [("d/a.txt", b"aa"), ("b.txt", b"b")]
    assert list(archives.members("tar.gz", out.getvalue()[:-20]))[:1] in ([("d/a.txt", b"aa")], [])
    assert list(archives.members("zip", zipped(**{"x/y.md": "1", "..x": "2", "n.zip": "3"}))) == [("x/y.md", b"1"), ("n.zip", b"3")]
    assert list(archives.members("zip", b"broken")) == []


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root, at = tmp_path_factory.mktemp("root"), tmp_path_factory.mktemp("state")
    put(root, "docs/readme.md", "The harbour opens at nine. Boats leave from the pier.\n" * 8)
    put(root, "src/main.go", "package main\n\nfunc main() {\n\tprintln(1)\n}\n")
    put(root, "keys.txt", "token = " + "x" * 30)
    put(root, ".hidden/note.txt", "quiet")
    put(root, "talk.mp3", "[00:00] welcome aboard\n[00:05] the pier is closed")
    put(root, "scan.pdf", "page one\fpage two about boats")
    put(root, "bundle.zip", zipped(**{"in.md": "boats in a bundle", "deep.zip": b"zip"}))
    made = Corpus(spark, str(root), f"file://{at}", Backends(generator=models.Echo, voice=lambda text, voice: text.encode()))
    made.scan()
    made.embed()
    return root, made


def test_scan_and_search(made):
    root, own = made
    stats = tools.call(own, "stats")
    assert stats["scanned"] == 9 and stats["total_docs"] == 9 and stats["embedded_ok"] == stats["chunks_total"] == 8
    hits = tools.call(own, "search", {"query": "boats leave from the pier", "k": 3})
    assert hits["index_used"] == "text" and hits["hits"][0]["rel_path"] == "docs/readme.md"
    assert {h["rel_path"] for h in tools.call(own, "search", {"query": "boats", "file_glob": "*.zip/*"})["hits"]} == {"bundle.zip/in.md"}
    assert tools.call(own, "search", {"query": "x", "index": "both"})["index_used"] == "both"
    assert all(h["rel_path"] != "keys.txt" for h in tools.call(own, "search", {"query": "token", "k": 50})["hits"])
    found = tools.call(own, "ask", {"question": "when does the harbour open", "k": 2})
    assert "Sources: " in found["answer"] or "[docs/readme.md]" in found["answer"]
    assert [s["text"] for s in tools.call(own, "transcribe", {"rel_path": "talk.mp3"})["segments"]] == ["welcome aboard", "the pier is closed"]
    assert tools.call(own, "transcribe_and_ask", {"rel_path": "talk.mp3", "question": "is the pier closed"})["citations"][0]["span"]["kind"] == "time"
    assert tools.call(own, "ask_audio", {"question": "pier"})["audio_base64"]


def test_open_and_list(made):
    root, own = made
    assert tools.call(own, "open_file", {"rel_path": "src/main.go", "start_line": 3, "end_line": 4})["content"] == "func main() {\n\tprintln(1)"
    assert tools.call(own, "open_file", {"rel_path": "scan.pdf", "page": 2})["content"] == "page two about boats"
    assert tools.call(own, "open_file", {"rel_path": "talk.mp3", "start_ms": 4000, "end_ms": 5000})["content"].endswith("the pier is closed")
    assert tools.call(own, "open_file", {"rel_path": "keys.txt"})["error"]["code"] == "PERMISSION_DENIED"
    assert tools.call(own, "open_file", {"rel_path": "none"})["error"]["code"] == "FILE_NOT_FOUND"
    listed = tools.call(own, "list_files", {"limit": 2})
    assert listed["total"] == 8 and [f["rel_path"] for f in listed["files"]] == ["bundle.zip", "bundle.zip/deep.zip"]
    assert tools.call(own, "list_files", {"include_hidden": True})["total"] == 9


def test_annotations_changes_and_deletion(made):
    root, own = made
    shown = tools.call(own, "annotate", {"rel_path": "docs/readme.md", "annotation": '{"b": [1, {"c": " x "}], "a": true}'})
    assert shown["preview"] == "a: true\nb[0]: 1\nb[1].c: x"
    own.embed()
    os.remove(root / "talk.mp3")
    put(root, "src/main.go", "package other\n")
    before = {r.rel_path: r.content_hash for r in own.store.read("documents").collect()}
    own.scan()
    after = {r.rel_path: r for r in own.store.read("documents").collect()}
    assert after["talk.mp3"].deleted and after["src/main.go"].content_hash != before["src/main.go"]
    assert own.store.read("chunks").filter("rel_path = 'talk.mp3' AND NOT deleted").count() == 0
    assert own.store.read("chunks").filter("rel_path = 'docs/readme.md' AND embedding_status = 'ok'").count() == 2
    own.embed()
    assert own.store.read("chunks").filter("NOT deleted AND embedding_status <> 'ok'").count() == 0


@pytest.mark.parametrize(
    ("name", "args", "code"),
    [("search", {}, "MISSING_FIELD"), ("search", {"query": "x", "k": 51}, "INVALID_RANGE"), ("search", {"query": "x", "k": 3.5}, "INVALID_FIELD"), ("search", {"query": "x", "z": 1}, "INVALID_FIELD"),
     ("open_file", {"rel_path": "x", "page": 1, "start_ms": 2}, "INVALID_FIELD"), ("nothing", {}, "UNKNOWN_TOOL"), ("list_files", {"limit": 5001}, "INVALID_RANGE")],
)
def test_arguments(made, name, args, code):
    assert tools.call(made[1], name, args)["error"]["code"] == code


def test_golden_counts(spark):
    docs = spark.createDataFrame(
        [("src/main.go", "code", "h", "ok", False), ("docs/readme.md", "md", "h", "skipped", False), ("docs/errors.md", "md", "h", "error", False), ("archive/old.txt", "text", "h", "ok", True)],
        "rel_path string, doc_type string, content_hash string, status string, deleted boolean",
    )
    reps = spark.createDataFrame([(1, False), (2, False)], "rep_id long, deleted boolean")
    chunks = spark.createDataFrame([(1, "ok", False), (2, "pending", False)], "chunk_id long, embedding_status string, deleted boolean")
    got = listing.corpus_stats(docs, reps, chunks).first().asDict()
    assert got == {"scanned": 4, "indexed": 1, "skipped": 1, "deleted": 1, "errors": 1, "total_docs": 3, "representations": 2, "chunks_total": 2, "embedded_ok": 1, "doc_counts": {"code": 1, "md": 2}}


def test_vectors(spark):
    rows = spark.createDataFrame([("text", 1, [1.0, 0.0]), ("text", 2, [0.9, 0.1]), ("text", 3, [0.0, 1.0]), ("text", 4, [1.0, 0.0, 0.0])], schemas.VECTORS)
    assert [r.chunk_id for r in V.search(rows, [1.0, 0.0], 2).collect()] == [1, 2]
    assert V.search(rows, [1.0, 0.0], 10).count() == 3 and V.dimension_mismatches(rows, 2).first()[0] == 1 and V.search(rows.limit(0), [1.0], 5).count() == 0
    new = spark.createDataFrame([("text", 1, [0.0, 1.0], 1), ("text", 1, [0.5, 0.5], 2)], schemas.VECTORS + ", at int")
    assert [r.embedding for r in V.upsert(rows, new).filter("chunk_id = 1").collect()] == [[0.5, 0.5]]
    asked = spark.range(5).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("query"))
    ranked = lambda **o: sorted(tuple(r) for r in V.search_each(rows, asked, 2, **o).collect())
    assert ranked() == ranked(most_queries=2, most_vectors=2) and len(ranked()) == 10


def test_search_each_by_products(spark):
    """Many queries: the rows of all pairs, over ties, halves of the last digit and vectors without a direction; no pair is a row of the plan."""
    rng = random.Random(11)
    kinds = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)] + [[0.0] * 6, [1e-170] * 6, [1e200] * 6, [float("inf")] + [1.0] * 5, [float("nan")] + [1.0] * 5, [None] + [1.0] * 5, [2.0, 1.0], [], None]
    own = [(i, kinds[i % len(kinds)] if i % 3 else [float(rng.randint(-2, 2)) for _ in range(6)]) for i in range(700)]
    # cosines of 0.0000005 and 0.0000015 and their neighbours, to be rounded away from zero
    own += [(1000 + i, [math.sqrt(1 - c * c), c, 0.0]) for i, c in enumerate(x + d for x in (5e-7, 1.5e-6, 2.5e-6) for d in (-1e-16, 0.0, 1e-16))] + [(1100, [0.0, 1.0, 0.0]), (1101, [0.0, -1.0, 0.0])]
    rows = spark.createDataFrame(own, "chunk_id long, embedding array<double>").repartition(3)
    asked = rows.filter("chunk_id % 2 = 0 OR chunk_id > 900").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = rows.crossJoin(asked).filter("size(embedding) = size(query)")
    scored = pairs.select("query_id", "chunk_id", F.round(V.cosine(F.col("embedding"), F.col("query"), V.norm(F.col("embedding")), V.norm(F.col("query"))), V.DIGITS).alias("score"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).filter("rank <= 7")
    listed = lambda df: sorted(map(repr, df.select("query_id", "rank", "chunk_id", "score").collect()))
    want = listed(best)
    assert len(want) > 2000 and listed(V.search_each(rows, asked, 7)) == want and listed(V.search_each(rows, asked, 7, most_queries=100, most_vectors=200)) == want
    for found in (V.search_each(rows, asked, 7), V.search_each(rows, asked, 7, most_queries=100, most_vectors=200)):
        assert "zip_with" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert V.search_each(rows, asked.limit(0), 7).count() == 0 == V.search_each(rows.limit(0), asked, 7).count()


def test_fusion_of_ids_in_both(spark):
    vectors = spark.createDataFrame([("text", 1, [1.0, 0.0]), ("text", 2, [0.8, 0.2]), ("code", 2, [0.9, 0.1]), ("code", 3, [1.0, 0.0])], schemas.VECTORS)
    span = corpus.decoded_span(F.lit("lines"), F.lit(1), F.lit(1))
    meta = spark.createDataFrame([(1, "docs/1.md", "md", "text"), (2, "src/2.go", "code", "text"), (2, "src/2.go", "code", "code"), (3, "src/3.go", "code", "code")], "chunk_id long, rel_path string, doc_type string, index_kind string")
    meta = meta.select("chunk_id", "rel_path", "doc_type", F.lit("raw_text").alias("rep_type"), F.lit("s").alias("snippet"), span.alias("span"), "index_kind")
    hits, used = retrieval.run(vectors, meta, retrieval.Search(index="both"), lambda q, k: [1.0, 0.0])
    got = hits.collect()
    assert used == "both" and [(h.chunk_id, h.score) for h in got] == [(1, 1.0), (3, 1.0), (2, 0.0)]


def test_store(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}")
    assert own.get("a") is None
    own.bootstrap({"a": "1", "b": "2"})
    own.set("a", "9")
    own.bootstrap({"a": "3", "c": "4"})
    assert {r.key: r.value for r in own.read("settings").collect()} == {"a": "9", "b": "2", "c": "4"}
    cache = spark.createDataFrame([("k1", "v1")], "key string, value string")
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "key string")
    got, misses = store.read_through(cache, wanted, "key", "value", lambda d: d.withColumn("value", F.upper("key")))
    assert sorted(r.value for r in got.collect()) == ["K2", "K2", "v1"] and misses.count() == 1
    assert store.read_snapshot(spark, f"{tmp_path}/snap", "n int") is None
    for n in (1, 2):
        store.write_snapshot(spark.range(1).select(F.lit(n).alias("n")), f"{tmp_path}/snap", keep_s=0)
    assert store.read_snapshot(spark, f"{tmp_path}/snap", "n int").n == 2 and len(list((tmp_path / "snap").iterdir())) == 1
    store.append_events(spark.range(2).select(F.lit("x").alias("event")), f"{tmp_path}/events")
    store.append_events(spark.range(1).select(F.lit("y").alias("event")), f"{tmp_path}/events")
    assert spark.read.json(f"{tmp_path}/events").count() == 3


def test_reprocessing_rule(spark):
    rule = lambda *a: spark.range(1).select(changes.needs_work(*(F.lit(x) for x in a[:4]), force=a[4])).first()[0]
    assert [rule("h", "h", "ok", False, False), rule("h", "i", "ok", False, False), rule("", "h", "ok", False, False), rule("h", "h", "error", False, False), rule("h", "h", "ok", True, False), rule("h", "h", "ok", False, True)] == [False, True, True, True, True, True]


def flat_lines(value, at=""):
    if isinstance(value, dict):
        return [x for k in sorted(value) for x in flat_lines(value[k], f"{at}.{k}" if at else k)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in flat_lines(v, f"{at}[{i}]")]
    shown = value.strip() if isinstance(value, str) else json.dumps(value)
    return [f"{at}: {shown}" if at else shown] if shown else []


def test_flatten(spark):
    """Numbers, blanks, keys in order, what is no JSON; then random values up to six deep against plain recursion."""
    cases = {
        '{"z": {"b": [1, 2.50, null]}, "a": " t ", "e": ""}': "a: t\nz.b[0]: 1\nz.b[1]: 2.5\nz.b[2]: null",
        '"x"': "x", "{}": "{}", "no": None, "": None, "null": "null", "42": "42", " [true] ": "[0]: true", '[" ", {"b": [], "a": "\\n"}]': '[" ",{"a":"\\n","b":[]}]',
        "[1e-7, 1.5e-7, 1e25, 12345678.25, 0.000015, -3.0, 1e20]": "[0]: 1e-7\n[1]: 1.5e-7\n[2]: 1e+25\n[3]: 12345678.25\n[4]: 0.000015\n[5]: -3\n[6]: 100000000000000000000",
        "{} x": None, "1 2": None, "[1][2]": None, '"a" "b"': None, "[NaN]": None, "{'a': 1}": None, '["]]}", "\\"[", "\\\\"]': '[0]: ]]}\n[1]: "[\n[2]: \\',
        "[" * 300 + "7" + "]" * 300: "[0]" * 300 + ": 7", "[" * 2000 + "]" * 2000: None,
    }
    rng = random.Random(5)

    def value(deep):
        kind = rng.choice(["s", "n", "b", "o", "a", "o", "a"]) if deep else rng.choice("snb")
        if kind == "o":
            return {rng.choice(["a", "b.c", "é", "\U0001f600", "\uffee", "B", " "]): value(deep - 1) for _ in range(rng.randint(0, 4))}
        if kind == "a":
            return [value(deep - 1) for _ in range(rng.randint(0, 4))]
        return rng.choice(["", " ", "x y", 'q"[\\]{', "é\n1"]) if kind == "s" else rng.choice([0, 7, -12, 2.5, 1000000, 0.125]) if kind == "n" else rng.choice([True, False, None])

    for _ in range(400):
        made = value(rng.randint(0, 6))
        cases[json.dumps(made, ensure_ascii=rng.random() < 0.5)] = "\n".join(flat_lines(made)).strip() or json.dumps(made, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    rows = spark.createDataFrame([*cases.items(), (None, None)], "json string, want string")
    got = rows.select("json", "want", annotations.flatten_json("json").alias("got"))
    assert [(r.json, r.got) for r in got.collect()] == [(r.json, r.want) for r in got.collect()]
    assert not [x for x in ("Python", "Arrow", "Exchange") if x in spark.range(3).select(annotations.flatten_json(F.col("id").cast("string")))._jdf.queryExecution().toString()]


def test_flatten_uses_all_cores(spark, sf):
    """The rows of one file are not one task's."""
    import __spark_entry__ as registered

    assert spark.read.parquet(f"{sf}/events.parquet").rdd.getNumPartitions() == 1
    sizes = registered.queries()["flatten_nested_json"](spark, sf).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 150 and sum(r["count"] for r in sizes) == 1000


def test_spans(spark):
    def coded(**f):
        s = F.struct(*(F.lit(f.get(n, 0 if n != "kind" else "")).alias(n) for n in ("kind", "start_line", "end_line", "page", "start_ms", "end_ms")))
        return spark.range(1).select(corpus.encoded_span(s)).first()[0]

    assert coded(kind="Lines ", start_line=1, end_line=2) == ("lines", 1, 2) and coded(kind="page", page=3) == ("page", 3, 3) and coded(kind="time", end_ms=5) == ("time", 0, 5)
    assert coded(kind="lines", start_line=3, end_line=2) is None and coded(kind="x") is None
    back = spark.range(1).select(corpus.span_json(corpus.decoded_span(F.lit("page"), F.lit(4), F.lit(4)))).first()[0]
    assert back == '{"kind":"page","page":4}'


def test_rate_limits(spark):
    events = spark.createDataFrame([(i, "1.2.3.4", i // 4) for i in range(12)] + [(100 + i, "127.0.0.1", 0) for i in range(5)], "id int, ip string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.allowed for r in state.rate_limited(events, "ip", "ts", 1, 2, "id").collect()}
    bucket = state.Bucket(1, 2)
    assert {i: got[i] for i in range(12)} == {i: bucket.allow(i // 4) for i in range(12)} and all(got[100 + i] for i in range(5))


def flaky():
    """A factory whose class travels by value to the workers."""

    class Flaky:
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            raise models.Transient("busy")

    return Flaky


@pytest.mark.parametrize(("text", "status"), [("fine", "ok"), ("bad", "error"), ("later", "pending")])
def test_embedding_outcomes(spark, text, status):
    frame = spark.createDataFrame([("text", 1, text)], "index_kind string, chunk_id long, text string")
    vectors, results = worker.embed_batch(frame, models.HashedWords if text == "fine" else flaky())
    assert results.first().status == status and vectors.count() == (status == "ok")


def test_streams(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, 0, "a.md", "md", "raw_text", "boats", "h", 1, "text", "pending", "", False)], schemas.CHUNKS)
    chunks.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        worker.embed_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", models.HashedWords, f"{tmp_path}/check").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    events = spark.createDataFrame([(1, "k", 0), (2, "k", 1), (3, "j", 1), (4, "k", 90000), (5, "127.0.0.1", 3), (6, "127.0.0.1", 3)], "id long, key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    events.write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")

    def drained(frame, name, mode):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.table(name).collect()

    assert len(drained(worker.once_stream(stream, "key", "ts"), "once", "append")) == 3
    assert sorted(r.n for r in drained(worker.session_stream(stream, "key", "ts"), "sess", "complete")) == [1, 1, 2, 2]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        limited = drained(worker.rate_limit_stream(stream, "key", "ts", "id", 0.0001, 1), "rates", "append")
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    batch = state.rate_limited(events, "key", "ts", 0.0001, 1, "id").collect()
    assert {r.id: r.allowed for r in limited} == {r.id: r.allowed for r in batch} and sum(r.allowed for r in limited) == 5


def test_segments_are_returned_whole(spark, tmp_path):
    said = " ".join(f"word{i}" for i in range(60))
    put(tmp_path / "root", "long.mp3", f"[00:00] {said}\n[00:09] the end")
    own = Corpus(spark, str(tmp_path / "root"), f"file://{tmp_path}/state", Backends())
    own.scan()
    assert len(said) > 240
    assert [s["text"] for s in tools.call(own, "transcribe", {"rel_path": "long.mp3"})["segments"]] == [said, "the end"]


def test_store_of_two_writers_and_a_crash(spark, tmp_path, monkeypatch):
    one, other = (store.Store(spark, f"file://{tmp_path}") for _ in range(2))
    one.set("n", "1")
    calls = []

    def plus(read):
        n = int(read("settings").filter("key = 'n'").first().value)
        if not calls:
            other.set("n", str(n + 10))  # another writer comes between
        calls.append(n)
        return {"settings": store.Change(spark.createDataFrame([("n", str(n + 1))], schemas.SETTINGS))}

    one.transaction(plus)
    assert calls == [1, 11] and one.get("n") == other.get("n") == "12"
    before = one._numbers()
    for step in ("_written", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(store.Store, step, lambda *a: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(OSError, match="killed"):
                one.set("n", "99")
        assert one._numbers() == before and one.get("n") == "12"
    (tmp_path / "drafts").mkdir(exist_ok=True)
    (tmp_path / "drafts" / "half").write_text('{"settings"')  # what a writer that died left
    one.set("m", "5")
    assert (one.get("n"), one.get("m")) == ("12", "5")
    assert one._publish(one._numbers()[-1], {}) is False  # a number is given once


def spans_of(spark, ids, start=0):
    return spark.createDataFrame([(i, i, "lines", start, 1, "") for i in ids], schemas.SPANS)


def places(own, table="spans"):
    return own._latest()[1][table]["places"]


def test_store_writes_only_the_parts_that_change(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}")
    own.write(spans=spans_of(spark, range(64)))
    first = places(own)
    own.upsert("spans", spans_of(spark, [3], 7))
    second = places(own)
    assert len(first) == 8 and len(set(first.values()) & set(second.values())) == 7
    own.transaction(lambda read: {"spans": store.Change(own.read("spans").limit(0), spark.createDataFrame([(5,), (6,)], "chunk_id long"))})
    assert own.read("spans").count() == 62 and own.read("spans").filter("start = 7").count() == 1
    own.expire(keep=1, readable_s=-5)
    assert own._numbers() == [3] and own.read("spans").count() == 62
    left = {p.name for p in (tmp_path / "spans").iterdir()}
    assert left == {at.split("/")[1] for at in places(own).values()}


def test_store_keeps_its_parts_whatever_it_is_opened_with(spark, tmp_path):
    store.Store(spark, f"file://{tmp_path}", parts=8).write(spans=spans_of(spark, range(40)))
    other = store.Store(spark, f"file:{tmp_path}", parts=5)  # one slash
    other.upsert("spans", spans_of(spark, range(0, 60, 3), 9))
    rows = other.read("spans").collect()
    assert sorted(r.chunk_id for r in rows) == sorted({*range(40), *range(0, 60, 3)}) and {r.start for r in rows if r.chunk_id % 3 == 0} == {9}
    assert other._latest()[1]["spans"]["parts"] == 8 and other._local("x") == f"{tmp_path}/x"
    assert other._publish(other._numbers()[-1], {}) is False


def test_large_parts_are_divided(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}", parts=2, part_bytes=6000)
    own.write(spans=spans_of(spark, range(10)))
    assert own._latest()[1]["spans"]["parts"] == 2
    own.upsert("spans", spans_of(spark, range(5, 2000), 4))
    grown = own._latest()[1]["spans"]["parts"]
    assert grown > 2 and grown & (grown - 1) == 0 and own.read("spans").count() == 2000
    own.upsert("spans", spans_of(spark, [7], 5))
    assert own.read("spans").filter("start = 5").count() == 1 and own.read("spans").count() == 2000


def test_expiry_spares_writers_and_readers(spark, tmp_path):
    own, other = (store.Store(spark, f"file://{tmp_path}") for _ in range(2))
    own.write(spans=spans_of(spark, range(20)))
    old = own.read("spans")

    def slow(read):
        for folder in tmp_path.glob("*/*"):
            os.utime(folder, (time.time() - 4000,) * 2)  # it takes over an hour, and others expire what is old
        other.expire(keep=1)
        return {"spans": store.Change(spans_of(spark, range(20, 30))), "settings": store.Change(spark.createDataFrame([("a", "1")], schemas.SETTINGS))}

    written = store.Store._written

    def then_expire(self, *a):
        made = written(self, *a)
        for folder in tmp_path.glob("*/v_=*"):
            os.utime(folder, (0, 0))
        other.expire(keep=1, readable_s=-5)
        return made

    store.Store._written = then_expire
    try:
        own.transaction(slow)
    finally:
        store.Store._written = written
    assert own.read("spans").count() == 30 and own.get("a") == "1"
    assert old.count() == 20  # a state that was superseded a moment ago can still be read
    (tmp_path / "spans" / "v_=xdead-1").mkdir()
    (tmp_path / "leases" / "dead-1").write_text("")
    own.expire()
    assert (tmp_path / "spans" / "v_=xdead-1").exists()
    os.utime(tmp_path / "leases" / "dead-1", (0, 0))
    own.expire()
    assert not (tmp_path / "spans" / "v_=xdead-1").exists() and not (tmp_path / "leases" / "dead-1").exists()


def test_stores_without_atomic_renames_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "NOT_ATOMIC", ("file",))
    with pytest.raises(ValueError, match="atomic"):
        store.Store(spark, f"file://{tmp_path}")


def test_searches_do_not_shuffle_vectors(spark, tmp_path):
    """Vectors, chunks and spans are buckets of one key: scores meet the chunks where they lie."""
    n = 200
    chunks = spark.createDataFrame([(i, i // 4, i % 4, f"d{i // 4}.md", "md", "raw_text", f"text {i}", "h", 1, "text", "ok", "", False) for i in range(1, n)], schemas.CHUNKS)
    vectors = spark.createDataFrame([("text", i, [float(i % 17), float(i % 5)]) for i in range(1, n)], schemas.VECTORS)
    own = store.Store(spark, f"file://{tmp_path}", parts=4)
    own.write(chunks=chunks, vectors=vectors, spans=spans_of(spark, range(1, n)))
    own.upsert("vectors", spark.createDataFrame([("code", 7, [1.0, 0.0]), ("text", 7, [0.5, 0.25])], schemas.VECTORS))
    search = retrieval.Search(k=5, path_prefix="d1")
    joined = lambda v, c: retrieval.best(v, c, [1.0, 0.5], search, "text")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = joined(*own.bucketed("vectors", "chunks"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
        spans = listing.with_span(*own.bucketed("chunks", "spans"))
        assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()
        plain = joined(own.read("vectors"), own.read("chunks"))
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in plain.collect()] and found.count() == 5
        assert sorted(own.bucketed("vectors")[0].collect()) == sorted(own.read("vectors").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    own.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("textloom_")]


def test_scans_open_what_changed(spark, tmp_path, monkeypatch):
    """One changed file of many is the only one whose bytes are read, and the tables are those of a full scan."""
    root, log = tmp_path / "root", tmp_path / "opened"
    for n in range(30):
        put(root, f"d{n % 3}/f{n}.md", f"text of {n}")
    put(root, "talk.mp3", "[00:00] hello")
    put(root, "bundle.zip", zipped(**{"in.md": "inside", "b.md": "b"}))
    put(root, "other.zip", zipped(**{"x.md": "x"}))
    put(root, "big.md", "y" * 500)
    own = Corpus(spark, str(root), f"file://{tmp_path}/state", settings=Settings(snapshot_s=0))
    read = discover.with_content

    def reading(files):
        with open(log, "a") as f:
            f.writelines(r.rel_path + "\n" for r in files.collect())
        return read(files)

    monkeypatch.setattr(discover, "with_content", reading)
    opened = lambda: sorted(log.read_text().split()) if log.exists() else []
    old = time.time() - 100
    for path in root.rglob("*.*"):
        os.utime(path, (old, old))

    def again():
        log.unlink(missing_ok=True)
        own.scan()
        return opened()

    assert len(again()) == 34
    own.embed()
    assert again() == []
    put(root, "d1/f4.md", "text of another")
    os.remove(root / "d2/f5.md")
    os.remove(root / "other.zip")
    assert again() == ["d1/f4.md"]
    docs = {r.rel_path: r for r in own.store.read("documents").collect()}
    assert docs["d2/f5.md"].deleted and docs["other.zip/x.md"].deleted and not docs["bundle.zip/in.md"].deleted
    full = Corpus(spark, str(root), f"file://{tmp_path}/other", settings=Settings(snapshot_s=0))
    full.scan()
    state = lambda c: sorted((r.rel_path, r.content_hash, r.status) for r in c.store.read("documents").filter("NOT deleted").collect())
    texts = lambda c: sorted((r.chunk_id, r.text) for r in c.store.read("chunks").filter("NOT deleted").collect())
    assert state(own) == state(full) and texts(own) == texts(full)
    assert own.store.read("chunks").filter("NOT deleted AND embedding_status = 'pending'").count() == 1
    own.settings.excludes, own.settings.secret_patterns = ("**/f7.md",), ("inside",)
    assert len(again()) == 31 and own.store.read("documents").filter("rel_path = 'd1/f7.md'").first().deleted
    assert {r.status for r in own.store.read("documents").filter("rel_path = 'bundle.zip/in.md'").collect()} == {"secret_excluded"}


def test_files_that_hold_still(spark):
    doc = lambda path, size, time, status="ok", deleted=False, source="filesystem": (1, path, "md", source, size, time, "h", status, deleted)
    rows = [doc("a", 1, 50), doc("b", 1, 50), doc("c", 1, 50), doc("d", 1, 100), doc("e", 1, 50, "error"), doc("f", 1, 50, "ok", True), doc("g.zip", 1, 50), doc("g.zip/x", 1, 50, "error", False, "archive_member"), doc("h.zip", 1, 50), doc("h.zip/x", 1, 50, "ok", False, "archive_member"), doc("gone", 1, 50)]
    seen = [("a", 1, 50), ("b", 2, 50), ("c", 1, 51), ("d", 1, 100), ("e", 1, 50), ("f", 1, 50), ("g.zip", 1, 50), ("h.zip", 1, 50), ("new", 1, 50)]
    listed = spark.createDataFrame([(p, p, s, t) for p, s, t in seen], discover.FILES)
    still = changes.unmoved(spark.createDataFrame(rows, schemas.DOCUMENTS), listed, 100)
    assert sorted(r.rel_path for r in still.collect()) == ["a", "h.zip"]


def test_scans_go_in_rounds(spark, tmp_path, monkeypatch):
    """Tables, counters and snapshots move while a scan runs; what is missing is told at its end."""
    root = tmp_path / "root"
    for n in range(12):
        put(root, f"f{n}.md", f"text of {n} " * 20)
    own = Corpus(spark, str(root), f"file://{tmp_path}/state", settings=Settings(snapshot_s=0.5, round_bytes=1200))
    moves, taken = [], Corpus.put

    def watched(self, *a, **o):
        taken(self, *a, **o)
        self.write_snapshot()
        shown = tools.call(self, "stats")
        moves.append((shown["indexing"]["progress"]["scanned"], shown["total_docs"], self.last_snapshot()["total_docs"], shown["indexing"]["running"], tools.call(self, "search", {"query": "x"})["indexing_complete"]))

    monkeypatch.setattr(Corpus, "put", watched)
    own.scan()
    assert len(moves) >= 3 and moves == sorted(moves) and moves[0][0] == 0 and 0 < moves[1][0] < 12 and moves[-1][1] == 12
    assert all(total == snap for _, total, snap, _, _ in moves) and {(running, complete) for *_, running, complete in moves} == {(True, False)}
    last = own.last_snapshot()
    assert last["indexing"] == {"running": False, "scanned": 12, "indexed": 12, "skipped": 0, "errors": 0} and last["code_ratio"] == 0.0 and last["doc_counts"] == {"md": 12}
    assert tools.call(own, "ask", {"question": "x"})["indexing_complete"] is True
    os.remove(root / "f3.md")
    own.scan()
    assert [r.rel_path for r in own.store.read("documents").filter("deleted").collect()] == ["f3.md"] and own.progress["scanned"] < 12


def test_statistics_of_what_is_left(spark, tmp_path):
    own = Corpus(spark, str(tmp_path), f"file://{tmp_path}/state")
    docs = [(i, f"f{i}.md", "md", "filesystem", 1, 1, "h", s, False) for i, s in enumerate(("ok", "odd", "skipped"))]
    own.store.write(documents=spark.createDataFrame(docs, schemas.DOCUMENTS))
    shown = tools.call(own, "stats")
    assert not shown["doc_counts_available"] and [shown["indexing"][n] for n in ("scanned", "indexed", "representations", "chunks_total", "embedded_ok")] == [3, 2, -1, -1, -1]
    own.write_snapshot()
    last = own.last_snapshot()
    assert [last[n] for n in ("indexed", "unknown", "representations", "embedded_ok")] == [1, 1, -1, -1]
    for at in (tmp_path / "state" / "manifests").iterdir():
        at.write_text("{")
    assert tools.call(own, "stats")["error"]["code"] == "STORE_CORRUPT"


def recording(log):
    """Factories of recognisers that write a line for each call and fail on what is bad."""

    def pages():
        class Pages:
            def extract(self, path, data):
                with open(log, "a") as f:
                    f.write(path + "\n")
                if b"bad" in data:
                    raise ValueError("unreadable")
                return data.decode().replace("\n", "\r\n")

        return Pages()

    return pages


def test_recognised_texts_are_cached_and_failures_stay_with_their_document(spark, tmp_path):
    log, root = tmp_path / "log", tmp_path / "root"
    put(root, "a.pdf", "same text")
    put(root, "b/copy.pdf", "same text")
    put(root, "broken.pdf", "bad")
    put(root, "c.gif", "not taken")
    put(root, "note.md", "fine")
    own = Corpus(spark, str(root), f"file://{tmp_path}/state", Backends(pages=recording(str(log))))
    own.scan()
    status = lambda: {r.rel_path: r.status for r in own.store.read("documents").collect()}
    assert status() == {"a.pdf": "ok", "b/copy.pdf": "ok", "broken.pdf": "error", "c.gif": "error", "note.md": "ok"}
    assert sorted(log.read_text().split()) in (["a.pdf", "broken.pdf"], ["b/copy.pdf", "broken.pdf"])
    assert own.store.read("representations").filter("rep_type = 'ocr_markdown' AND NOT deleted").count() == 2
    own.scan(force=True)
    assert sorted(set(log.read_text().split()) - {"broken.pdf"}) == [next(x for x in log.read_text().split() if x != "broken.pdf")] and log.read_text().count("copy") + log.read_text().count("a.pdf") == 1
    put(root, "broken.pdf", "good now")
    own.scan()
    assert status()["broken.pdf"] == "ok"
    own.embed()
    assert tools.call(own, "open_file", {"rel_path": "broken.pdf", "page": 1})["content"] == "good now"
    own.settings.cache_bytes = 9
    own.remember("ocr_markdown", spark.createDataFrame([("new", "123456789")], "key string, text string"))
    assert [r.key for r in own.store.read("ocr_cache").collect()] == ["new"]


def test_transcripts_on_demand(spark, tmp_path):
    root, log = tmp_path / "root", tmp_path / "log"
    put(root, "talk.mp3", "[00:00] hello")
    put(root, "none.mp3", "")
    put(root, "broken.mp3", "bad")
    put(root, "note.md", "x")
    made = recording(str(log))

    def speech(language=""):
        own = made()
        if not language:
            return own

        class Told:
            def extract(self, path, data):
                return own.extract(path, data) + f" in {language}"

        return Told()

    own = Corpus(spark, str(root), f"file://{tmp_path}/state", Backends(speech=speech))
    call = lambda **a: tools.call(own, "transcribe", a)
    first = call(rel_path="talk.mp3")
    assert first == {"rel_path": "talk.mp3", "segments": [{"start_ms": 0, "end_ms": 1000, "text": "hello"}], "transcribed": True, "transcribed_now": True, "indexed": True}
    assert own.store.read("documents").first().doc_type == "audio"
    assert call(rel_path="talk.mp3", timestamps=False) == {**first, "segments": [], "transcribed_now": False}
    assert call(rel_path="talk.mp3", retranscribe=True)["transcribed_now"] and log.read_text().count("talk") == 2
    assert call(rel_path="talk.mp3", language="de")["segments"][0]["text"] == "hello in de"
    assert {r.key[64:] for r in own.store.read("transcript_cache").collect()} == {"", "-de"}
    assert call(rel_path="none.mp3") == {"rel_path": "none.mp3", "segments": [], "transcribed": False, "transcribed_now": True, "indexed": False}
    codes = {p: call(rel_path=p)["error"]["code"] for p in ("note.md", "missing.mp3", "../talk.mp3", "broken.mp3")}
    assert codes == {"note.md": "DOC_TYPE_UNSUPPORTED", "missing.mp3": "FILE_NOT_FOUND", "../talk.mp3": "PATH_OUTSIDE_ROOT", "broken.mp3": "TRANSCRIBE_FAILED"}
    own.scan()
    assert log.read_text().count("talk") == 3  # the scan has the transcript from the cache


def test_opening_reads_one_file(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    put(root, "a/b.zip", zipped(**{"in/x.md": "inside", "y.md": "other"}))
    put(root, "large.txt", "x" * 2000)
    put(root, "code.py", "one\ntwo\nthree")
    own = Corpus(spark, str(root), f"file://{tmp_path}/state", settings=Settings(most_bytes=1000))
    monkeypatch.setattr(Corpus, "files", lambda self: pytest.fail("the tree was read"))
    opened = lambda **a: tools.call(own, "open_file", a)
    assert opened(rel_path="a/b.zip/in/x.md")["content"] == "inside"
    assert opened(rel_path="code.py", start_line=2, end_line=3) == {"rel_path": "code.py", "doc_type": "code", "content": "two\nthree", "truncated": False, "span": {"kind": "lines", "start_line": 2, "end_line": 3}}
    assert "span" not in opened(rel_path="code.py")
    codes = [opened(**a)["error"]["code"] for a in ({"rel_path": "a/b.zip/none"}, {"rel_path": "large.txt"}, {"rel_path": "../x"}, {"rel_path": "code.py", "start_line": 2}, {"rel_path": "code.py", "start_line": 3, "end_line": 2}, {"rel_path": ".git/x"})]
    assert codes == ["FILE_NOT_FOUND", "DOC_TYPE_UNSUPPORTED", "PATH_OUTSIDE_ROOT", "INVALID_FIELD", "INVALID_FIELD", "PERMISSION_DENIED"]
    own.settings.local = False
    own.root = f"file://{root}"
    assert opened(rel_path="code.py")["content"] == "one\ntwo\nthree" and opened(rel_path="a/b.zip/y.md")["content"] == "other" and opened(rel_path="no.md")["error"]["code"] == "FILE_NOT_FOUND"


def test_annotations_that_a_model_makes(spark, tmp_path):
    root = tmp_path / "root"
    put(root, "talk.mp3", "[00:00] boats")

    def writer():
        class Writer:
            def generate(self, prompt):
                if "boats" not in prompt:
                    raise models.Transient("busy")
                return 'Sure: {"topic": "boats"} done'

        return Writer()

    own = Corpus(spark, str(root), f"file://{tmp_path}/state", Backends(generator=writer))
    own.scan()
    made = tools.call(own, "annotate", {"rel_path": "talk.mp3", "schema_json": {"type": "object"}})
    assert made["annotation"] == '{"topic": "boats"}' and made["preview"] == "topic: boats"
    cut = tools.call(own, "annotate", {"rel_path": "talk.mp3", "schema_json": {"type": "object"}, "max_chars": 3})
    assert cut["error"] == {"code": "ANNOTATE_FAILED", "message": "busy", "retryable": True}
    assert tools.call(own, "annotate", {"rel_path": "talk.mp3"})["error"]["code"] == "MISSING_FIELD"


def test_deadlines(spark, tmp_path):
    with pytest.raises(TimeoutError), session.deadline(spark, 0.5):
        spark.range(1 << 40).selectExpr("sum(id % 7)").collect()
    with session.deadline(spark, 60):
        assert spark.range(3).count() == 3
    own = Corpus(spark, str(tmp_path), f"file://{tmp_path}/state", settings=Settings(ask_s=1e-4))
    assert tools.call(own, "ask", {"question": "x"})["error"] == {"code": "TIMEOUT", "message": "not done within 0.0001 s", "retryable": True}


def test_requests(made):
    own = rpc.Endpoint(made[1], token="secret", origins=("http://localhost",))
    headers = {"Content-Type": "application/json", "Authorization": "Bearer secret", "Origin": "http://localhost:80"}
    send = lambda method, more=None, **h: own.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, **(more or {})}), {**headers, **h})
    status, answer, back = send("initialize")
    assert status == 200 and answer["result"]["serverInfo"]["name"] == "textloom"
    session_id = {"MCP-Session-Id": back["MCP-Session-Id"]}
    assert {t["name"] for t in send("tools/list", **session_id)[1]["result"]["tools"]} == set(tools.TOOLS)
    called = send("tools/call", {"params": {"name": "list_files", "arguments": {"limit": 1}}}, **session_id)[1]["result"]
    assert called["structuredContent"]["limit"] == 1 and not called["isError"]
    assert send("tools/call", {"params": {"name": "nothing"}}, **session_id)[1]["result"]["isError"]
    assert send("tools/call", {"params": {}}, **session_id)[1]["error"]["code"] == -32602
    assert send("other", **session_id)[1]["error"]["code"] == -32601 and send("tools/list")[0] == 404
    assert own.handle('{"jsonrpc": "2.0", "method": "notifications/initialized"}', {**headers, **session_id}) == (202, None, {})
    assert [own.handle("{}", h)[0] for h in ({}, {**headers, "Authorization": "Bearer no"}, {**headers, "Origin": "http://evil"}, headers)] == [415, 401, 403, 400]
    assert own.handle("no json", headers)[0] == 400 and send("")[0] == 400


def test_counts_without_statistics(spark, made):
    rows = [("a", "md", "OK ", False), ("b", "", "", False), ("c", "code", "Skipped", False), ("d", "md", "error", False), ("e", "md", "ok", True)]
    got = listing.fallback_stats(spark.createDataFrame(rows, "rel_path string, doc_type string, status string, deleted boolean")).first().asDict()
    assert got == {"scanned": 5, "indexed": 2, "skipped": 1, "deleted": 1, "errors": 1, "total_docs": 4, "doc_counts": {"code": 1, "md": 2, "unknown": 1}}
    shown = tools.call(made[1], "stats")
    assert shown["doc_counts_available"] and shown["indexing"]["scanned"] == shown["scanned"] and shown["indexing"]["running"] is False


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://far"

    class Far:
        sparkContext, conf = Context(), spark.conf

    Far.sparkContext._jsc = spark.sparkContext._jsc
    here = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    if here:
        assert session.shared_folder(Far()) == session.shared_folder(spark)
    else:
        with pytest.raises(RuntimeError):
            session.shared_folder(Far())


def test_commands_leave_events(spark, tmp_path, capsys):
    from textloom import cli

    put(tmp_path, "corpus/a.md", "some text")
    (tmp_path / "t.yaml").write_text(f"root: {tmp_path}/corpus\nstate: {tmp_path}/state\n")
    assert cli.main(["--config", str(tmp_path / "t.yaml"), "up"]) == 0
    logged = spark.read.json(f"{tmp_path}/state/events").orderBy("ts", F.desc("event")).collect()
    assert [r.event for r in logged] == ["scan_started", "scan_done"] and json.loads(logged[1].data)["indexed"] == 1
    own = Corpus(spark, f"{tmp_path}/corpus", f"file://{tmp_path}/state")
    own.settle("k", "eip155:1", "100", "settled")
    assert spark.read.json(f"{tmp_path}/state/settlements").first().outcome == "settled"


def test_hashed_words_that_cancel_out_have_unit_length(spark):
    """Two words of one place and opposite signs, and a text that Python sees no word in."""
    model = models.HashedWords()
    first = {}
    for word in (f"w{i}" for i in range(1000)):
        v = model.embed([word])[0]
        place = next(i for i, x in enumerate(v) if x)
        other = first.setdefault((place, -v[place]), word)
        if other != word:
            break
        first[place, v[place]] = word
    lone = f"{word} {first[place, -v[place]]}"
    frame = spark.createDataFrame([(1, "text", lone), (2, "text", "\x1c"), (3, "text", "a b")], "chunk_id long, index_kind string, text string")
    vectors, _ = worker.embed_batch(frame, models.HashedWords)
    norms = vectors.select(F.round(V.dot(F.col("embedding"), F.col("embedding")), 3).alias("n")).collect()
    assert [r.n for r in norms] == [1.0, 1.0, 1.0]


def test_archives_come_to_python_in_small_batches(spark):
    """A worker holds some archives at a time, however many a task has."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")

        @F.pandas_udf("binary")
        def packed(n):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                z.writestr(f"of {len(n)}", "x")
            return n.map(lambda _: buffer.getvalue())

        files = spark.range(0, 300, 1, 1).select(F.concat(F.lit("p"), "id", F.lit(".zip")).alias("rel_path"), packed("id").alias("content"), F.lit(0).cast("long").alias("mtime_unix"))
        sizes = archives.extracted(files).select(F.regexp_extract("rel_path", "of ([0-9]+)", 1).cast("int").alias("n")).collect()
        assert len(sizes) == 300 and max(r.n for r in sizes) <= archives.ARCHIVES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def held(folder):
    return {p for p in folder.rglob("*") if p.is_file()}


def test_scans_leave_no_intermediate_files(spark, tmp_path):
    """What a scan and an embedding compute on the way goes with them, and shuffles go with their queries."""
    from pathlib import Path

    shared = Path(session.shared_folder(spark).removeprefix("file:"))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    root, before, setting = tmp_path / "root", held(shared), spark.conf.get(key)
    for n in range(12):
        put(root, f"d/f{n}.md", f"text {n}\n" * 200)
    put(root, "talk.mp3", "[00:00] hello")
    put(root, "page.pdf", "a page")
    own = Corpus(spark, str(root), f"file://{tmp_path}/state", settings=Settings(snapshot_s=0))
    own.scan()
    own.embed()
    put(root, "d/f3.md", "changed")
    own.scan()
    own.embed()
    assert own.store.read("chunks").filter("NOT deleted AND embedding_status = 'ok'").count() == own.store.read("vectors").join(own.store.read("chunks").filter("NOT deleted"), "chunk_id").count() >= 14
    assert held(shared) <= before
    assert spark.conf.get(key) == setting


def test_brief_shuffles_of_two_threads(spark):
    """The first to end leaves the setting to the other, the last one puts it back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    one, other = session.brief_shuffles(spark), session.brief_shuffles(spark)
    one.__enter__()
    other.__enter__()
    one.__exit__(None, None, None)
    assert spark.conf.get(key) == "true"
    other.__exit__(None, None, None)
    assert spark.conf.get(key) == before


def test_results_meet_texts_in_their_parts(spark, tmp_path):
    """What an embedding came to is put into the chunks where they lie: no text is shuffled, and parts without results stay."""
    own = store.Store(spark, f"file://{tmp_path}")
    blank = {"rep_id": 1, "ordinal": 0, "rel_path": "p", "doc_type": "md", "rep_type": "raw_text", "text": "t", "text_hash": "h", "tokens_est": 1, "index_kind": "text", "embedding_status": "pending", "embedding_error": "", "deleted": False}
    rows = [{**blank, "chunk_id": n, "rep_id": n, "text": f"text {n}"} for n in range(64)]
    own.write(chunks=spark.createDataFrame(rows, schemas.CHUNKS))
    first, plans = places(own, "chunks"), []

    def into(made, results):
        plans.append(changes.mark_embedding(made, results.hint("shuffle_hash")))
        return plans[-1]

    results = spark.createDataFrame([(3, "ok", None), (99, "ok", None), (5, "error", "bad")], "chunk_id long, status string, error string")
    own.transaction(lambda _: {"chunks": store.Change(results, into=into)})
    second = places(own, "chunks")
    touched = {r[0] for r in results.select(own._part("chunks", 8)).distinct().collect()}
    assert {leaf for leaf in first if first[leaf] != second[leaf]} == {f"part_={n}" for n in touched}
    found = {r.chunk_id: (r.text, r.embedding_status, r.embedding_error) for r in own.read("chunks").collect()}
    assert found == {n: (f"text {n}", *{3: ("ok", ""), 5: ("error", "bad")}.get(n, ("pending", ""))) for n in range(64)}
    assert {r.chunk_id for r in own.bucketed("chunks")[0].join(spark.range(64).withColumnRenamed("id", "chunk_id").hint("shuffle_hash"), "chunk_id").collect()} == set(range(64))
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "text" in line] and plan.count("Exchange hash") <= 1


def test_parts_that_were_too_large_go_at_once(spark, tmp_path):
    """A table that is dealt anew doesn't leave what it was dealt from, unless that was published."""
    own = store.Store(spark, f"file://{tmp_path}", parts=2, part_bytes=6000)
    own.write(spans=spans_of(spark, range(2000)))
    assert own._latest()[1]["spans"]["parts"] > 2 and own.read("spans").count() == 2000
    assert {p.name for p in (tmp_path / "spans").iterdir()} == {at.split("/")[1] for at in places(own).values()}
    before = own.read("spans")
    own.upsert("spans", spans_of(spark, range(2000, 30000)))
    assert before.count() == 2000 and own.read("spans").count() == 30000


def test_whole_texts_are_kept_in_small_row_groups(spark, tmp_path):
    """A reader decodes a row group at once, so groups of long texts have few rows."""
    import glob

    import pyarrow.parquet as pq

    long = spark.range(0, 60, 1, 1).select("id", F.expr("repeat(sha2(cast(id AS string), 512), 8000)").alias("text"), F.expr("aggregate(sequence(1, 4000), '', (a, n) -> concat(a, sha2(concat(id, ' ', n), 512)))").alias("mixed"))
    short = spark.range(0, 1000, 1, 1).select("id", F.lit("x").alias("text"), F.lit("y").alias("mixed"))
    with session.steps(spark) as kept:
        for frame, most in ((long, 40), (short, 256)):
            made = kept(frame, **session.TEXT_ROWS)
            files = [f for at in made.inputFiles() for f in glob.glob(at.removeprefix("file://"))]
            groups = [pq.ParquetFile(f).metadata.row_group(n).num_rows for f in files for n in range(pq.ParquetFile(f).metadata.num_row_groups)]
            assert sum(groups) == frame.count() == made.count() and max(groups) <= most


def test_an_answer_without_a_model_keeps_the_space_that_its_snippet_ends_in(spark, tmp_path, monkeypatch):
    """Its SQL takes the first 240 characters as they are; a model's answer is trimmed."""
    snippet = "x" * 239 + " "
    span = {"kind": "lines", "start_line": 1, "end_line": 1, "page": 0, "start_ms": 0, "end_ms": 0}
    hits = spark.createDataFrame([(1, "a/b.txt", "text", "raw_text", 0.5, snippet, span)], schemas.HITS)
    for generator, answer in ((None, f"Question: why?\nTop context:\n- a/b.txt: {snippet}"), (lambda: Said(), "so")):
        own = Corpus(spark, str(tmp_path), f"file://{tmp_path}/state", Backends(generator=generator))
        monkeypatch.setattr(own, "search", lambda search: (hits, "text"))
        assert own.ask("why?")["answer"] == f"{answer}\n\nSources: [a/b.txt]"


class Said:
    def generate(self, prompt):
        return " so "
