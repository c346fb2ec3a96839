"""Lists, counts and pending work over the tables of a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import text as T
from ..session import checkpointed
from .corpus import decoded_span


def live(frame: DataFrame) -> DataFrame:
    return frame.filter(~F.col("deleted"))


def by_path(docs: DataFrame, path: str) -> DataFrame:
    return docs.filter(F.col("rel_path") == path)


def matching_files(docs: DataFrame, prefix: str = "", glob: str = "", with_hidden: bool = True) -> DataFrame:
    out = live(docs).filter(globs.store_prefix(F.col("rel_path"), prefix))
    out = out.filter(F.col("rel_path").rlike(globs.store(glob))) if glob else out
    return out if with_hidden else out.filter(~globs.hidden(F.col("rel_path")))


def list_files(docs: DataFrame, prefix: str = "", glob: str = "", limit: int = 200, offset: int = 0, with_hidden: bool = True) -> DataFrame:
    """A page in the order of paths: a top-k for the first pages, never a full sort of rows that aren't asked for."""
    return matching_files(docs, prefix, glob, with_hidden).orderBy("rel_path").offset(offset).limit(limit if limit > 0 else 200)


def matched_by(paths: DataFrame, patterns: DataFrame, compiler: Callable[[str], str] = globs.path_match) -> DataFrame:
    """pattern_id with each row of paths (rel_path, …) that a pattern (pattern_id, glob) matches.

    However many patterns there are, each different glob is looked at once: one without wildcards meets the path that it is, and of
    the others a path meets those alone that share its folders or its ending, both by equi-joins; globs that have neither meet every
    path. What a glob matches then goes to its patterns. Null paths and patterns match nothing.
    """

    @F.pandas_udf("struct<kind:string,value:string,regex:string>")
    def compiled(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(*globs.anchor(g), compiler(g)) for g in part], columns=["kind", "value", "regex"])

    asked = patterns.filter("glob IS NOT NULL").select("pattern_id", F.col("glob").alias("glob_"))
    known = asked.select("glob_").distinct().withColumn("g_", compiled("glob_"))
    literal, wild = known.filter("g_.kind = 'path'"), known.filter("g_.kind <> 'path'")
    own = paths.filter("rel_path IS NOT NULL")
    met = own.withColumn("a_", F.explode(globs.anchors(F.col("rel_path")))).join(wild, (F.col("a_.kind") == F.col("g_.kind")) & (F.col("a_.value") == F.col("g_.value"))).drop("a_")
    met = met.unionByName(own.join(literal, F.col("rel_path") == F.col("g_.value")))
    found = met.filter(F.expr("rel_path RLIKE g_.regex")).drop("g_")
    return found.join(asked, "glob_").select("pattern_id", *paths.columns)


def count_files(docs: DataFrame, prefix: str = "", glob: str = "", with_hidden: bool = True) -> DataFrame:
    return matching_files(docs, prefix, glob, with_hidden).agg(F.count("*").alias("total"))


def chunks_of(chunks: DataFrame, rep_id: int) -> DataFrame:
    return live(chunks).filter(F.col("rep_id") == rep_id).orderBy("ordinal")


def first_spans(spans: DataFrame) -> DataFrame:
    """The span of least id of each chunk: a minimum, combined before the shuffle, in place of numbering rows."""
    least = spans.groupBy("chunk_id").agg(F.min(F.struct("span_id", "span_kind", "start", "end")).alias("s"))
    return least.select("chunk_id", "s.span_kind", "s.start", "s.end")


def with_span(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks with their first span; without one, bare lines. The spans are cut down to the chunks first."""
    own = spans.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    found = chunks.join(first_spans(own), "chunk_id", "left")
    return found.withColumn("span", decoded_span(F.col("span_kind"), F.col("start"), F.col("end"))).drop("span_kind", "start", "end")


def hit_rows(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """What a search returns of a chunk, but the score."""
    rows = with_span(chunks, spans)
    return rows.select("chunk_id", "rel_path", "doc_type", "rep_type", T.snippet(F.col("text")).alias("snippet"), "span", "index_kind")


def pending(chunks: DataFrame, spans: DataFrame, kind: str | None = None, limit: int = 32) -> DataFrame:
    own = live(chunks).filter((F.col("embedding_status") == "pending") & (F.col("chunk_id") > 0))
    own = own.filter(F.col("index_kind") == kind) if kind else own
    page = own.orderBy("chunk_id").limit(limit if limit > 0 else 32)
    return with_span(page, spans).orderBy("chunk_id")


def embedded(chunks: DataFrame, spans: DataFrame, kind: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Metadata of what is embedded; a page of it if a limit is given."""
    own = live(chunks).filter((F.col("embedding_status") == "ok") & (F.col("chunk_id") > 0))
    own = own.filter(F.col("index_kind") == kind) if kind else own
    if limit is not None:
        own = own.orderBy("chunk_id").offset(offset).limit(limit)
    return hit_rows(own, spans)


# counts


def _sum_if(c: Column) -> Column:
    return F.count_if(c)


def doc_counts(docs: DataFrame) -> DataFrame:
    kind = F.when(T.blank(F.col("doc_type")), "unknown").otherwise(F.col("doc_type"))
    return live(docs).groupBy(kind.alias("doc_type")).agg(F.count("*").alias("n"))


def corpus_stats(docs: DataFrame, reps: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: how many documents were seen, indexed, skipped, deleted, failed, and what is live below them."""
    gone, status = F.col("deleted"), F.col("status")
    life = docs.agg(
        F.count("*").alias("scanned"),
        _sum_if(~gone & (status == "ok")).alias("indexed"),
        _sum_if(~gone & (status == "skipped")).alias("skipped"),
        _sum_if(gone).alias("deleted"),
        _sum_if(~gone & (status == "error")).alias("errors"),
        _sum_if(~gone).alias("total_docs"),
    )
    rep = reps.agg(_sum_if(~F.col("deleted")).alias("representations"))
    chunk = chunks.agg(_sum_if(~F.col("deleted")).alias("chunks_total"), _sum_if(~F.col("deleted") & (F.col("embedding_status") == "ok")).alias("embedded_ok"))
    kinds = doc_counts(docs).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_type", "n")))).alias("doc_counts"))
    return life.crossJoin(rep).crossJoin(chunk).crossJoin(kinds)


def observed(docs: DataFrame, into: Observation) -> DataFrame:
    """The same rows; their counters are in the observation once the rows were written, without a pass of their own."""
    status = F.col("status")
    return docs.observe(into, F.count("*").alias("scanned"), F.count_if(status == "ok").alias("indexed"), F.count_if(status.isin("skipped", "secret_excluded")).alias("skipped"), F.count_if(status == "error").alias("errors"))


def fallback_stats(docs: DataFrame) -> DataFrame:
    """The counts of documents for a store that has no statistics: any status but skipped and error counts as indexed."""
    alive, status = ~F.col("deleted"), F.lower(T.trim(F.coalesce(F.col("status"), F.lit(""))))
    kinds = doc_counts(docs).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_type", "n")))).alias("doc_counts"))
    life = docs.agg(
        F.count("*").alias("scanned"),
        _sum_if(alive & ~status.isin("skipped", "error")).alias("indexed"),
        _sum_if(alive & (status == "skipped")).alias("skipped"),
        _sum_if(~alive).alias("deleted"),
        _sum_if(alive & (status == "error")).alias("errors"),
        _sum_if(alive).alias("total_docs"),
    )
    return life.crossJoin(kinds)


def derived_stats(docs: DataFrame) -> DataFrame:
    """What a snapshot has of a store with documents alone: -1 for what they can't tell, and as unknown the statuses that nothing expects."""
    alive, status = ~F.col("deleted"), F.lower(T.trim(F.coalesce(F.col("status"), F.lit(""))))
    expected = {"indexed": ("ok", "indexed"), "skipped": ("skipped",), "errors": ("error",)}
    life = docs.agg(
        F.count("*").alias("scanned"),
        *(_sum_if(alive & status.isin(*of)).alias(name) for name, of in expected.items()),
        _sum_if(alive & ~status.isin("ok", "indexed", "skipped", "error")).alias("unknown"),
        _sum_if(~alive).alias("deleted"),
        _sum_if(alive).alias("total_docs"),
        *(F.lit(-1).cast("long").alias(name) for name in ("representations", "chunks_total", "embedded_ok")),
    )
    kinds = doc_counts(docs).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_type", "n")))).alias("doc_counts"))
    return life.crossJoin(kinds)


def status_counts(docs: DataFrame) -> DataFrame:
    """status, n, example (the first path): statuses that nothing expects are counted by themselves, an empty one as <empty>."""
    s = T.trim(F.coalesce(F.col("status"), F.lit("")))
    low = F.lower(s)
    name = F.when(F.col("deleted"), "deleted").when(low.isin("ok", "indexed"), "indexed").when(low == "skipped", "skipped").when(low == "error", "errors").when(s == "", "<empty>").otherwise(s)
    return docs.groupBy(name.alias("status")).agg(F.count("*").alias("n"), F.min(T.trim(F.col("rel_path"))).alias("example"))


def code_ratio(docs: DataFrame) -> DataFrame:
    counts = live(docs).agg(F.count("*").alias("total"), F.count_if(F.col("doc_type") == "code").alias("code"))
    return counts.select("total", "code", F.when(F.col("total") > 0, F.col("code") / F.col("total")).otherwise(0.0).alias("code_ratio"))


def in_ranges(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows dealt into ranges of an order and kept in the shared folder: range_, and id_ in that order."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id_", F.monotonically_increasing_id())
    return checkpointed(dealt).withColumn("range_", F.shiftright("id_", 33))


def cache_kept(files: DataFrame, now: int, ttl_s: int = 0, max_bytes: int = 0) -> DataFrame:
    """The files that stay: those within the time to live and, of these, the newest that fit the size; an unknown size counts as 0.

    The running size goes over ranges of time and name and then within a range, so no task sees all files, were they all of one second.
    """
    kept = files.filter(F.col("mtime_unix") >= now - ttl_s) if ttl_s > 0 else files
    if max_bytes <= 0:
        return kept
    ranged = in_ranges(kept, F.desc("mtime_unix"), F.desc("name"))
    size = F.sum(F.coalesce(F.col("size_bytes"), F.lit(0)))
    newer = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = ranged.groupBy("range_").agg(size.alias("bytes_")).select("range_", F.coalesce(F.sum("bytes_").over(newer), F.lit(0)).alias("newer_"))
    upto = F.col("newer_") + size.over(Window.partitionBy("range_").orderBy("id_").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(before, "range_").withColumn("upto_", upto).filter(F.col("upto_") <= max_bytes).select(*files.columns)
