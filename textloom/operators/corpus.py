"""From documents with content to representations, chunks and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, secrets
from ..functions import text as T
from . import chunking

#: A representation isn't made of more than so many bytes.
MOST_BYTES = 10 * 1024 * 1024


def stable_id(*parts: Column) -> Column:
    """A positive id from the real key, so that a rerun gives the same."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 63) - 1))


def documents(files: DataFrame, patterns: tuple[str, ...] = secrets.PATTERNS) -> DataFrame:
    """files (rel_path, content, size_bytes, mtime_unix, source_type) -> documents, with their text, and the bytes of media, kept beside for what follows."""
    kind = classify.doc_type(F.col("rel_path"))
    content = T.normalize(F.col("content"))
    status = (
        F.when(kind.isin("ignore", "binary_ignored", "archive"), "skipped")
        .when(F.col("size_bytes") > MOST_BYTES, "error")
        .when(classify.has_raw_text(kind) & secrets.sample_has_secret(content, patterns), "secret_excluded")
        .otherwise("ok")
    )
    return files.select(
        stable_id(F.col("rel_path")).alias("doc_id"),
        "rel_path",
        kind.alias("doc_type"),
        classify.source_type(F.col("source_type")).alias("source_type"),
        "size_bytes",
        "mtime_unix",
        T.sha256(F.col("content")).alias("content_hash"),
        status.alias("status"),
        F.lit(False).alias("deleted"),
        F.when(status == "ok", content).alias("content"),
        F.when((status == "ok") & kind.isin("pdf", "image", "audio"), F.col("content")).alias("raw"),
    )


def representations(docs: DataFrame, created_unix: int = 0) -> DataFrame:
    """One raw text for each document that has text of its own, with the text beside."""
    own = docs.filter((F.col("status") == "ok") & ~F.col("deleted") & classify.has_raw_text(F.col("doc_type")))
    return own.select(
        stable_id(F.col("doc_id"), F.lit("raw_text")).alias("rep_id"),
        "doc_id",
        F.lit("raw_text").alias("rep_type"),
        T.sha256(F.col("content")).alias("rep_hash"),
        F.lit(created_unix).cast("long").alias("created_unix"),
        F.lit(False).alias("deleted"),
        "rel_path",
        "doc_type",
        F.col("content").alias("text"),
    )


def _finish(exploded: DataFrame) -> DataFrame:
    return exploded.select(
        stable_id(F.col("rep_id"), F.col("ordinal").cast("int")).alias("chunk_id"),
        "rep_id",
        F.col("ordinal").cast("int").alias("ordinal"),
        "rel_path",
        "doc_type",
        "rep_type",
        "text",
        T.sha256(F.col("text")).alias("text_hash"),
        F.ceil(F.length("text") / 4).cast("int").alias("tokens_est"),
        classify.index_kind(F.col("doc_type")).alias("index_kind"),
        F.lit("pending").alias("embedding_status"),
        F.lit("").alias("embedding_error"),
        F.lit(False).alias("deleted"),
        "span",
    )


def lines_span(first: Column, last: Column) -> Column:
    return F.struct(F.lit("lines").alias("kind"), first.cast("int").alias("start"), last.cast("int").alias("end"))


def chunks(reps: DataFrame) -> DataFrame:
    """Chunks of raw texts with their span: code by lines, the rest by characters."""
    windows = F.when(F.col("doc_type") == "code", chunking.line_windows(F.col("text"))).otherwise(chunking.char_windows(F.col("text")))
    rows = reps.select("rep_id", "rel_path", "doc_type", "rep_type", F.explode(windows).alias("w"))
    return _finish(rows.select("rep_id", "rel_path", "doc_type", "rep_type", "w.ordinal", "w.text", lines_span(F.col("w.start_line"), F.col("w.end_line")).alias("span")))


def page_chunks(reps: DataFrame) -> DataFrame:
    """Chunks of recognised pages."""
    rows = reps.select("rep_id", "rel_path", "doc_type", "rep_type", F.explode(chunking.pages(F.col("text"))).alias("w"))
    page = F.struct(F.lit("page").alias("kind"), F.col("w.page").alias("start"), F.col("w.page").alias("end"))
    return _finish(rows.select("rep_id", "rel_path", "doc_type", "rep_type", "w.ordinal", "w.text", page.alias("span")))


def time_chunks(reps: DataFrame) -> DataFrame:
    """Chunks of transcripts. The representation's columns travel in the key, so the chunker's rows need no join."""
    keyed = reps.withColumn("rep", F.struct("rep_id", "rel_path", "doc_type", "rep_type"))
    rows = chunking.transcript_chunks(keyed, "rep", "text")
    span = F.struct(F.lit("time").alias("kind"), F.col("start_ms").cast("int").alias("start"), F.col("end_ms").cast("int").alias("end"))
    return _finish(rows.select("rep.rep_id", "rep.rel_path", "rep.doc_type", "rep.rep_type", "ordinal", "text", span.alias("span")))


def split_spans(with_span: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, spans) of rows that carry their span."""
    spans = with_span.select(
        stable_id(F.col("chunk_id"), F.lit("span")).alias("span_id"), "chunk_id", F.col("span.kind").alias("span_kind"), F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.lit(None).cast("string").alias("extra_json")
    )
    return with_span.drop("span"), spans


# spans


def encoded_span(span: Column) -> Column:
    """struct(kind, start, end) of a span, null where it isn't valid."""
    kind = F.lower(T.trim(span["kind"]))
    lines = (span["start_line"] > 0) & (span["end_line"] >= span["start_line"])
    time = (span["start_ms"] >= 0) & (span["end_ms"] >= span["start_ms"])
    as_row = lambda k, a, b: F.struct(F.lit(k).alias("kind"), a.alias("start"), b.alias("end"))
    return (
        F.when((kind == "lines") & lines, as_row("lines", span["start_line"], span["end_line"]))
        .when((kind == "page") & (span["page"] > 0), as_row("page", span["page"], span["page"]))
        .when((kind == "time") & time, as_row("time", span["start_ms"], span["end_ms"]))
    )


def decoded_span(kind: Column, start: Column, end: Column) -> Column:
    """The wide span of a row; rows that aren't valid give bare ``lines``."""
    k = F.lower(T.trim(F.coalesce(kind, F.lit(""))))
    valid = {"lines": (start > 0) & (end >= start), "page": start > 0, "time": (start >= 0) & (end >= start)}
    of = lambda name, c: F.when((k == name) & valid[name], c).otherwise(0).cast("int")
    known = F.when(((k == "page") & valid["page"]) | ((k == "time") & valid["time"]), k).otherwise("lines")
    return F.struct(
        known.alias("kind"), of("lines", start).alias("start_line"), of("lines", end).alias("end_line"), of("page", start).alias("page"), of("time", start).alias("start_ms"), of("time", end).alias("end_ms")
    )


def printed_span(span: Column) -> Column:
    return (
        F.when(span["kind"] == "page", F.concat(F.lit("page:"), span["page"]))
        .when(span["kind"] == "time", F.concat(F.lit("time:"), span["start_ms"], F.lit("-"), span["end_ms"]))
        .otherwise(F.concat(F.lit("lines:"), span["start_line"], F.lit("-"), span["end_line"]))
    )


def span_json(span: Column) -> Column:
    """Only the fields of the span's kind."""
    page = F.to_json(F.struct(span["kind"].alias("kind"), span["page"].alias("page")))
    time = F.to_json(F.struct(span["kind"].alias("kind"), span["start_ms"].alias("start_ms"), span["end_ms"].alias("end_ms")))
    lines = F.to_json(F.struct(F.lit("lines").alias("kind"), span["start_line"].alias("start_line"), span["end_line"].alias("end_line")))
    return F.when(span["kind"] == "page", page).when(span["kind"] == "time", time).otherwise(lines)
