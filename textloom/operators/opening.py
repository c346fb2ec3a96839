"""Slices of opened sources: from the metadata of chunks, else from the raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs, secrets
from ..functions import text as T


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two closed ranges meet; an end that is missing or before its start is the start."""
    a_last = F.when((a_end <= 0) | (a_end < a_start), a_start).otherwise(a_end)
    b_last = F.when((b_end <= 0) | (b_end < b_start), b_start).otherwise(b_end)
    return (a_start <= b_last) & (b_start <= a_last)


def _joined(matches: DataFrame, keys: list[str]) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("page", "start_ms", "chunk_id", "snippet")))
    return matches.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["snippet"]), "\n").alias("content"))


def _flat(meta: DataFrame) -> DataFrame:
    return meta.filter(~T.blank(F.col("snippet"))).select("rel_path", "chunk_id", "snippet", "span.kind", "span.page", "span.start_ms", "span.end_ms")


def pages_from_chunks(meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """rel_path, page, content for each wanted (rel_path, page) that chunks have."""
    own = _flat(meta).filter("kind = 'page'").join(wanted.select("rel_path", "page"), ["rel_path", "page"])
    return _joined(own, ["rel_path", "page"])


#: Milliseconds of a bin of time, by which ranges meet before they are compared.
BIN_MS = 60_000


def binned(rows: DataFrame, start: str, end: str, width: int = BIN_MS) -> DataFrame:
    """Each row once for each bin of time that its range has a part in, as bin; first_bin is the first of them."""
    last = F.when((F.col(end) <= 0) | (F.col(end) < F.col(start)), F.col(start)).otherwise(F.col(end))
    number = lambda c: F.floor(c / width)
    return rows.withColumn("first_bin", number(F.col(start))).withColumn("bin", F.explode(F.sequence(number(F.col(start)), number(last))))


def overlapping(chunks: DataFrame, wanted: DataFrame, width: int = BIN_MS) -> DataFrame:
    """chunks (rel_path, start_ms, end_ms, …) with each range (rel_path, from_ms, to_ms) that they overlap: an equi-join on path and
    bin, so that a recording with many chunks and many ranges isn't all pairs. A pair is taken from its first common bin alone.

    Times are ints of milliseconds, so a range has some 36,000 bins at most.
    """
    own = binned(chunks, "start_ms", "end_ms", width).withColumnRenamed("first_bin", "own_first")
    asked = binned(wanted.select("rel_path", "from_ms", "to_ms"), "from_ms", "to_ms", width)
    met = own.join(asked, ["rel_path", "bin"]).filter(F.col("bin") == F.greatest("own_first", "first_bin"))
    return met.filter(overlaps(F.col("start_ms"), F.col("end_ms"), F.col("from_ms"), F.col("to_ms"))).drop("bin", "own_first", "first_bin")


def times_from_chunks(meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """rel_path, from_ms, to_ms, content for each wanted range (rel_path, from_ms, to_ms) that chunks overlap."""
    own = overlapping(_flat(meta).filter("kind = 'time'"), wanted).withColumn("page", F.lit(0))
    return _joined(own, ["rel_path", "from_ms", "to_ms"])


def guarded(docs: DataFrame, excludes: tuple[str, ...] = globs.NEVER_SEARCHED, patterns: tuple[str, ...] = secrets.PATTERNS) -> DataFrame:
    """docs (rel_path, content) with denied: excluded, secret or null."""
    why = F.when(globs.any_of(F.col("rel_path"), excludes, globs.retrieval), "excluded").when(secrets.has_secret(F.col("content"), patterns), "secret")
    return docs.withColumn("denied", why)


def opened(content: Column, most_chars: int, lines: tuple[int, int] | None = None, page: int | None = None, time: tuple[int, int] | None = None) -> Column:
    """struct(text, truncated) of the wanted part."""
    part = content
    if page is not None:
        part = T.slice_page(content, page)
    elif time is not None:
        part = T.slice_time(content, *time)
    elif lines is not None:
        part = T.slice_lines(content, *lines)
    return T.truncate_flag(part, most_chars)
