import re

from pyspark.sql import functions as F

from textloom.functions import globs
from textloom.operators import listing, paging


def test_deep_pages(spark):
    n = 20_000
    rows = spark.range(n).select(F.format_string("%06d", (F.col("id") * 7919) % n).alias("k"), F.repeat(F.lit("x"), 50).alias("v"))
    pages = paging.Pages.of(rows.repartition(6), "k", group_bytes=64 << 10)
    assert pages.total == n
    for offset, limit in ((0, 5), (4990, 30), (n - 10, 50), (n, 5), (12_345, 7000)):
        got = [r.k for r in pages.page(offset, limit).collect()]
        assert got == [f"{i:06}" for i in range(offset, min(offset + limit, n))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        page = pages.page(15_000, 20)
        assert "GreaterThanOrEqual(id_" in page._jdf.queryExecution().executedPlan().toString()
        page.collect()
        read = rows_scanned(page)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 20 <= read < n / 4, read
    assert paging.Pages.of(rows.limit(0), "k").page(0, 5).count() == 0


def rows_scanned(frame):
    """What the scan of a frame that was collected has read."""
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return int(leaf.metrics().get("numOutputRows").get().value())


def test_many_patterns(spark):
    paths = [f"s{a}/d{b}/f{c}.{e}" for a in range(4) for b in range(3) for c in range(6) for e in ("md", "go")] + ["top.md", "s1/.md", "a[b/x.md", None]
    patterns = ["s1/*/f?.md", "s1/d2/*", "*.md", "*/*/f3.go", "s[12]/d0/f1.md", "s2/d1/f[!a].go", "a\\[b/*.md", "**", "s0/d0/f0.md", "*", "s?/d1/*.m[d]", "", None, "./s3/d1/f1.go"]
    patterns += [f"s{i % 5}/d{i % 3}/f{i}*.md" for i in range(2000)]
    p = spark.createDataFrame([(x,) for x in paths], "rel_path string")
    g = spark.createDataFrame(list(enumerate(patterns)), "pattern_id int, glob string")
    for compiler in (globs.path_match, globs.segments):
        want = sorted((i, x) for i, glob in enumerate(patterns) if glob is not None for rx in [re.compile(compiler(glob).replace("\\z", "\\Z"))] for x in paths if x is not None and rx.search(x))
        got = listing.matched_by(p, g, compiler)
        assert sorted((r.pattern_id, r.rel_path) for r in got.collect()) == want


def test_cache_whose_files_are_all_of_one_second(spark):
    """The newest that fit, by time and name; ranges stay small though two thirds of the files share a second."""
    n = 12_000
    rows = [(f"f{i * 7919 % n:05}", i % 13 if i % 50 else None, 1_000_000 + (i % 100 if i % 3 == 0 else 0)) for i in range(n)]
    files = spark.createDataFrame(rows, "name string, size_bytes long, mtime_unix long").withColumn("range", F.lit("x")).repartition(5)
    total, want = 0, set()
    for name, size, time in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True):
        total += size or 0
        if total <= 50_000 and time >= 1_000_050 - 60:
            want.add(name)
    got = listing.cache_kept(files, 1_000_050, 60, 50_000)
    assert got.columns == files.columns
    names = [r.name for r in got.collect()]
    assert len(names) == len(want) and set(names) == want and len(want) > 7000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges as small as these would be joined
    try:
        ranges = listing.in_ranges(files.filter("mtime_unix = 1000000"), F.desc("mtime_unix"), F.desc("name")).groupBy("range_").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in ranges) < n / 4 and len(ranges) >= 4
    assert listing.cache_kept(files.limit(0), 1, 0, 5).count() == 0
    assert listing.cache_kept(files, 1_000_050).count() == n


def test_patterns_that_are_paths_meet_one_path_each(spark):
    """Their anchor is the path, not its folder, whose files each of them would meet; repeated patterns get the same files."""
    assert globs.anchor("src/en/a.md") == ("path", "src/en/a.md") and globs.anchor("a.md") == ("path", "a.md")
    assert globs.anchor("src/en/") == ("folder", "src/en") and globs.anchor("src/en/*.md") == ("folder", "src/en")
    paths = spark.createDataFrame([(p,) for p in ("src/en/a.md", "src/en/b.md", "a.md", "a.md", None)], "rel_path string")
    asked = [(1, "src/en/a.md"), (2, "src/en/a.md"), (3, "a.md"), (4, "src/en/*"), (5, "src/en/*"), (6, None), (7, "src\\\\en/a.md"), (8, "*.md")]
    got = listing.matched_by(paths, spark.createDataFrame(asked, "pattern_id int, glob string"))
    want = [(1, "src/en/a.md"), (2, "src/en/a.md"), (3, "a.md"), (3, "a.md"), *((n, f"src/en/{x}.md") for n in (4, 5) for x in "ab"), (8, "a.md"), (8, "a.md")]
    assert sorted(map(tuple, got.collect())) == want
