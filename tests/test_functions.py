import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import classify, globs, secrets
from textloom.functions import text as T
from textloom.operators import answers, chunking, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "text"),
    [(b"a\nb", "a\nb"), (b"a\r\nb", "a\nb"), (b"a\rb", "a\nb"), (b"a\r\n\r\rb", "a\n\n\nb"), (b"", ""), ("é日".encode(), "é日"), (b"\xff\xfe\x00", "�\0"), (b"a\xffb\xff\xff", "a�b�")],
)
def test_normalize(spark, raw, text):
    assert spark.createDataFrame([(bytearray(raw),)], "c binary").select(T.normalize(F.col("c"))).first()[0] == text


def test_cuts(spark):
    lit = F.lit
    assert one(spark, T.trim(lit(" \t  a b　\n"))) == "a b"
    assert [one(spark, T.truncate(lit("abcdef"), n)) for n in (0, 2, 3, 5, 6)] == ["", "ab", "abc", "ab...", "abcdef"]
    assert one(spark, T.truncate_snippet(lit("  ab  cd "), 4)) == "ab..."
    assert one(spark, T.truncate_question(lit(" "))) == "<empty>" and one(spark, T.truncate_question(lit("é" * 70))) == "é" * 64 + "…"
    assert [one(spark, T.slice_lines(lit("a\nb\nc"), a, b)) for a, b in ((0, 0), (2, 0), (2, 9), (9, 9), (3, 1))] == ["a", "b", "b\nc", "", "c"]
    assert [one(spark, T.slice_page(lit("a\n\f\nb\f"), p)) for p in (0, 2, 3, 4)] == ["a", "b", "", None]
    assert [one(spark, T.slice_page(lit("ab"), p)) for p in (1, 2)] == ["ab", None]
    assert one(spark, T.slice_time(lit("[00:05] a\nx\n00:10 b\n1:00:00 c"), 5000, 10000)) == "[00:05] a\n00:10 b"
    assert one(spark, T.slice_time(lit("x"), 0, 0)) is None and one(spark, T.slice_time(lit("0:01 x"), 5000, 0)) == ""
    assert one(spark, T.json_object_in(lit('so {"a": {"b": 1}} there'))) == '{"a": {"b": 1}}' and one(spark, T.json_object_in(lit("{no}"))) is None
    assert one(spark, T.is_caip2(lit("eip155:8453"))) and not one(spark, T.is_caip2(lit("EIP:1")))


@pytest.mark.parametrize(
    ("path", "kind", "opened"),
    [("a/.env", "ignore", "unknown"), (".env.local", "ignore", "unknown"), ("x/Dockerfile", "code", "unknown"), ("README", "text", "unknown"), ("go.mod", "data", "unknown"), ("a.GO", "code", "code"), ("a.tar.gz", "archive", "unknown"),
     ("a.css", "binary_ignored", "html"), ("a.rst", "md", "text"), ("noext", "binary_ignored", "unknown"), ("a.b/c", "binary_ignored", "unknown"), ("a.ogg", "audio", "unknown")],
)
def test_classification(spark, path, kind, opened):
    assert one(spark, classify.doc_type(F.lit(path))) == kind
    assert one(spark, classify.opened_type(F.lit(path))) == opened


def hit(regex, path):
    return re.match(regex.replace(r"\z", r"\Z").replace("(?s)\\A", "(?s)\\A"), path) is not None


@pytest.mark.parametrize(
    ("compiler", "glob", "yes", "no"),
    [
        (globs.path_match, "*.md", ["a.md", ".md"], ["a/b.md", "a.mdx"]),
        (globs.path_match, "a/[b-d]?.t\\*t", ["a/cx.t*t"], ["a/ex.t*t", "a/c/.t*t", "a/cx.txt"]),
        (globs.path_match, "[^a]", ["b"], ["a", "/", "bb"]),
        (globs.path_match, "[a", [], ["a", "[a"]),
        (globs.segments, "**/.git/**", [".git/x", "a/.git/b/c", ".git"], ["git/x", "a.git/x"]),
        (globs.segments, "build/", ["build/x", "build/a/b", "build"], ["a/build/x"]),
        (globs.segments, "a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["a/xb", "b"]),
        (globs.segments, "**/*.pem", ["x.pem", "a/x.pem"], ["x.pem/a"]),
        (globs.retrieval, "**/*.key", ["x.key", "a/b/x.key"], ["x.keys"]),
        (globs.retrieval, "a/**", ["a/", "a/b/c"], ["a"]),
        (globs.retrieval, "[a]", ["[a]"], ["a"]),
        (globs.store, "*.md", ["a.md", "a/b.md"], ["a.mdx"]),
        (globs.store, "[^a]?", ["bx", "b/"], ["ax", "b"]),
    ],
)
def test_globs(compiler, glob, yes, no):
    assert all(hit(compiler(glob), p) for p in yes) and not any(hit(compiler(glob), p) for p in no)


def test_ignore_rules(spark):
    rules = globs.ignore_rules("# c\n*.log\n!keep.log\n/top\nsub/x\nonly/\n") + globs.ignore_rules("y", "deep")
    wanted = {"a.log": True, "d/a.log": True, "d/keep.log": False, "top": True, "d/top": False, "sub/x": True, "d/sub/x": False, "only": False, "deep/y": True, "deep/d/y": True, "y": False}
    rows = spark.createDataFrame([(p,) for p in wanted], "p string").select("p", globs.ignored(F.col("p"), rules).alias("i"), globs.ignored(F.col("p"), rules, True).alias("f")).collect()
    assert {r.p: r.i for r in rows} == wanted and next(r for r in rows if r.p == "only").f


def test_secrets(spark):
    yes = ["AKIA" + "A" * 16, "aws_secret_access_key = " + "a" * 24, "Authorization: Bearer " + ".".join(["a" * 9] * 3), "token: " + "x" * 20, "sk_" + "a" * 32, "api_" + "A" * 32]
    no = ["the aws secret is out", "token = short", "AKIAshort", "sk_" + "A" * 32]
    assert all(one(spark, secrets.has_secret(F.lit(x))) for x in yes) and not any(one(spark, secrets.has_secret(F.lit(x))) for x in no)
    assert not one(spark, secrets.sample_has_secret(F.lit(" " * secrets.SAMPLE_BYTES + yes[0])))


def test_words_of_secret_patterns_are_in_every_match(spark):
    """Looking for a pattern's words first never loses a match, whatever the case, and patterns without words are matched as they are."""
    k, rnd = "k" * 40, random.Random(3)
    parts = ["AKIA" + "Z" * 16, "akia" + "Z" * 16, f"sk_{k}", f"api_{k}", f"SK_{k}", f"ToKeN: {k}", f"to\u212aen: {k}", f"AWS_secret.Access_KEY={k}", f"sEcRet = {k}", f"secret access key:{k}", f"ID_Token={k}.{k}.{k}", f"Authorization: BEARER {k}.{k}.{k}", "token", "", "İ", "own"]
    texts = [*parts, None, *(" ".join(rnd.choices(parts[-4:] + ["é", "x"], k=3)) + rnd.choice(parts) for _ in range(40))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (secrets.PATTERNS, ("own", " ", *secrets.PATTERNS[2:]), ()):
        plain = F.lit(False)
        for p in patterns:
            plain = plain | F.col("t").rlike(p) if p.strip() else plain
        got = rows.select("t", secrets.has_secret(F.col("t"), patterns).alias("a"), plain.alias("b")).collect()
        assert [(r.t, r.a) for r in got] == [(r.t, r.b) for r in got]
    assert set(secrets.SIGNS) == set(secrets.PATTERNS)


@pytest.mark.parametrize(
    ("query", "code"),
    [("func main() {", True), ("how does it work", False), ("return the value", False), ("what is `x` in main.go", True), ("```print```", True), ("class of 1999", False), ("see app.js [1]", True)],
)
def test_router(spark, query, code):
    assert (retrieval.route(query) == "code") == code == one(spark, T.is_code_query(F.lit(query)))


def plain_windows(text, most, overlap, least):
    out, s = [], 0
    while text:
        e = min(s + most, len(text))
        part = text[s:e]
        if part.strip() and (len(part) >= least or e == len(text)):
            out.append((part, text[:s].count("\n") + 1, text[: e - 1].count("\n") + 1))
        if e == len(text):
            break
        s = e - overlap
    return out


def test_char_windows_equal_a_loop(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \né") for _ in range(rng.randint(0, 700))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.char_windows(F.col("t"), 250, 25, 50).alias("w")).collect()
    for r in rows:
        assert [(w.text, w.start_line, w.end_line) for w in r.w] == plain_windows(texts[r.i], 250, 25, 50)


def test_line_windows_and_pages(spark):
    text = "\n".join(str(i) for i in range(45))
    got = one(spark, chunking.line_windows(F.lit(text), 20, 3))
    assert [(w.start_line, w.end_line) for w in got] == [(1, 20), (18, 37), (35, 45)]
    assert [(p.page, p.text) for p in one(spark, chunking.pages(F.lit(" a \f \n\fb")))] == [(1, "a"), (3, "b")]


@pytest.mark.parametrize(
    ("text", "texts", "starts"),
    [
        ("[00:00] first\n[00:05] second\n[00:10] third", ["first", "second", "third"], [0, 5000, 10000]),
        ("[00:00 missing\n00:00] stray", ["[00:00 missing\n00:00] stray"], [0]),
        ("[01:02:03] good\n00:07 bare\nmore", ["good", "bare\nmore"], [3723000, 7000]),
        ("[00:61] no time\n[60:00] nor this", ["[00:61] no time\n[60:00] nor this"], [0]),
        ("lead\n[00:02]\n\nx", ["lead", "x"], [0, 2000]),
        ("[00:01]\n[00:02]", ["[00:01]\n[00:02]"], [0]),
    ],
)
def test_transcripts(spark, text, texts, starts):
    rows = chunking.transcript_chunks(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("ordinal").collect()
    assert [r.text for r in rows] == texts and [r.start_ms for r in rows] == starts and all(r.end_ms > r.start_ms for r in rows)


def test_long_segments_share_their_time(spark):
    text = "[00:00] " + "word " * 700 + "\n[01:00] tail"
    rows = chunking.transcript_chunks(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("ordinal").collect()
    assert len(rows) > 3 and all(len(r.text) <= 1200 for r in rows) and rows[0].start_ms == 0 and rows[-2].end_ms == 60000 and rows[-1].start_ms == 60000


def test_answers(spark):
    hits = spark.createDataFrame([(1, "a.md", 0.9, " x "), (2, "b.md", 0.8, ""), (3, "a.md", 0.7, "z" * 400)], "chunk_id long, rel_path string, score double, snippet string")
    got = answers.gathered(hits)
    text = got.select(answers.fallback(F.lit("q"), F.col("hits"))).first()[0]
    assert text == "Question: q\nTop context:\n- a.md: x\n- b.md: (no snippet)\n- a.md: " + "z" * 300 + "..."
    prompt = got.select(answers.prompt(F.lit("q"), F.col("hits"), "S", 40)).first()[0]
    assert prompt == "S\n\nQuestion:\nq\n\nContext:\n- [a.md] x\n- [b.md] (no snippet)\n..."[: len("S\n\nQuestion:\nq\n\nContext:\n") + 40] or prompt.startswith("S\n\nQuestion:\nq\n\nContext:\n- [a.md] x\n")
    paths = F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit(" "))
    assert one(spark, answers.attributed(F.lit(" yes [a] "), paths)) == "yes [a]\n\nSources: [b]"
    assert one(spark, answers.attributed(F.lit(" "), paths)) == ""
    assert hits.limit(0).select(F.lit(1)).count() == 0 and answers.gathered(hits.limit(0)).select(answers.fallback(F.lit("q"), F.col("hits"))).first()[0] == answers.NO_CONTEXT


def test_answers_show_a_cut_snippet_as_it_was_cut(spark):
    """A snippet that ends in a space because it was cut there keeps it, as the SQL of the queries has it."""
    cut = "y" * 239 + " "
    hits = spark.createDataFrame([(1, "a.md", 0.9, cut), (2, "b.md", 0.8, " x ")], "chunk_id long, rel_path string, score double, snippet string")
    row = answers.gathered(hits).select(answers.fallback(F.lit("q"), F.col("hits")).alias("fallback"), answers.prompt(F.lit("q"), F.col("hits"), "S").alias("prompt")).first()
    assert row.fallback == f"Question: q\nTop context:\n- a.md: {cut}\n- b.md: x"
    assert row.prompt == f"S\n\nQuestion:\nq\n\nContext:\n- [a.md] {cut}\n- [b.md] x\n"


def test_hits_without_a_path_rank_but_have_no_line(spark):
    """As in the SQL of rag_prompt, where the source or language of a document may be null."""
    hits = spark.createDataFrame([(1, None, 0.9, "x"), (2, "b.md", 0.8, "y"), (3, " ", 0.7, "z"), (4, ".git/x", 0.6, "z")], "chunk_id long, rel_path string, score double, snippet string")
    row = answers.gathered(hits.limit(2)).select(answers.fallback(F.lit("q"), F.col("hits")).alias("fallback"), answers.prompt(F.lit("q"), F.col("hits"), "S").alias("prompt")).first()
    assert row.fallback == "Question: q\nTop context:\n- b.md: y"
    assert row.prompt == "S\n\nQuestion:\nq\n\nContext:\n- [b.md] y\n"
    passing = lambda **filters: [r.chunk_id for r in hits.filter(retrieval.passes(retrieval.Search(**filters))).orderBy("chunk_id").collect()]
    assert passing() == [1, 2] and passing(path_prefix="b") == passing(file_glob="*.md") == [2]
