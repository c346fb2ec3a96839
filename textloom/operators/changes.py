"""What changed between a corpus and its sources, and what that does to the tables. Rows are never lost: they get tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def needs_work(old_hash: Column, new_hash: Column, old_status: Column, old_deleted: Column, force: bool = False) -> Column:
    """Whether a document is processed again: it is new, changed, failed or was deleted."""
    changed = old_hash.isNull() | (old_hash == "") | (old_hash != new_hash)
    return F.lit(force) | changed | (F.coalesce(old_status, F.lit("")) == "error") | F.coalesce(old_deleted, F.lit(False))


def changed(stored: DataFrame, found: DataFrame, force: bool = False) -> DataFrame:
    """found, with action: add, update or keep."""
    old = stored.select("rel_path", F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status"), F.col("deleted").alias("old_deleted"))
    joined = found.join(old, "rel_path", "left")
    work = needs_work(F.col("old_hash"), F.col("content_hash"), F.col("old_status"), F.col("old_deleted"), force)
    action = F.when(F.col("old_hash").isNull(), "add").when(work, "update").otherwise("keep")
    return joined.withColumn("action", action).drop("old_hash", "old_status", "old_deleted")


def missing(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Live documents that weren't seen. Members of archives that were seen, and kept unopened, count as seen."""
    return stored.filter(~F.col("deleted")).join(seen.select("rel_path").distinct(), "rel_path", "left_anti")


def with_ancestor(rows: DataFrame) -> DataFrame:
    """Each row once for each path above its own, as ancestor."""
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return rows.filter(F.contains("rel_path", F.lit("/"))).withColumn("ancestor", F.explode(above))


def archive_members(stored: DataFrame, archives: DataFrame) -> DataFrame:
    """Live documents that lie in one of the archives: an equi-join on every ancestor path, not a join on prefixes."""
    rows = with_ancestor(stored.filter(~F.col("deleted")))
    return rows.join(archives.select(F.col("rel_path").alias("ancestor")), "ancestor", "left_semi").drop("ancestor").dropDuplicates(["rel_path"])


def unmoved(stored: DataFrame, listed: DataFrame, since: int) -> DataFrame:
    """rel_path of the listed files whose stored document holds still: same size and time of change, which is before the last scan
    began, and nothing failed. Archives with a member that failed aren't among them, so that it is tried again."""
    failed = F.col("status") == "error"
    live = stored.filter(~F.col("deleted"))
    old = live.filter(~failed & (F.col("source_type") == "filesystem")).select("rel_path", F.col("size_bytes").alias("old_size"), F.col("mtime_unix").alias("old_time"))
    same = (F.col("size_bytes") == F.col("old_size")) & (F.col("mtime_unix") == F.col("old_time")) & (F.col("mtime_unix") < since)
    again = with_ancestor(live.filter(failed & (F.col("source_type") == "archive_member"))).select(F.col("ancestor").alias("rel_path")).distinct()
    return listed.join(old, "rel_path").filter(same).select("rel_path").join(again, "rel_path", "left_anti")


def without(rows: DataFrame, gone: DataFrame, key: str = "rel_path") -> DataFrame:
    """Rows but those of keys that are gone: what an index still holds of documents that were taken away isn't shown."""
    return rows.join(gone.select(key), key, "left_anti")


def tombstone(docs: DataFrame, reps: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents by path, and all that hangs on them, marked as deleted."""
    paths = gone.select("rel_path").distinct().withColumn("gone", F.lit(True))
    flag = lambda frame: frame.withColumn("deleted", F.col("deleted") | F.coalesce(F.col("gone"), F.lit(False))).drop("gone")
    new_docs = flag(docs.join(paths, "rel_path", "left")).select(*docs.columns)
    ids = docs.join(paths, "rel_path", "left_semi").select("doc_id").withColumn("gone", F.lit(True))
    new_reps = flag(reps.join(ids, "doc_id", "left")).select(*reps.columns)
    rep_ids = reps.join(ids.select("doc_id"), "doc_id", "left_semi").select("rep_id").withColumn("gone", F.lit(True))
    new_chunks = flag(chunks.join(rep_ids, "rep_id", "left")).select(*chunks.columns)
    return new_docs, new_reps, new_chunks


def drop_tail(chunks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Chunks from the new length (rep_id, n) of their representation on are marked as deleted."""
    cut = chunks.join(lengths.select("rep_id", "n"), "rep_id", "left")
    return cut.withColumn("deleted", F.col("deleted") | F.coalesce(F.col("ordinal") >= F.col("n"), F.lit(False))).select(*chunks.columns)


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows by key over old ones, all columns replaced."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key isn't there."""
    return old.unionByName(new.select(*old.columns).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def clear_hashes(docs: DataFrame) -> DataFrame:
    """So that everything is processed again."""
    return docs.withColumn("content_hash", F.lit(""))


def mark_embedding(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """results (chunk_id, status, error) put into the chunks."""
    got = results.select("chunk_id", F.col("status").alias("new_status"), F.col("error").alias("new_error"))
    out = chunks.join(got, "chunk_id", "left")
    out = out.withColumn("embedding_status", F.coalesce("new_status", "embedding_status"))
    return out.withColumn("embedding_error", F.when(F.col("new_status").isNotNull(), F.coalesce("new_error", F.lit(""))).otherwise(F.col("embedding_error"))).select(*chunks.columns)


def reusable_vectors(chunks: DataFrame, embedded: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors for pending chunks whose very text has one already (index_kind, chunk_id, embedding).

    The waiting texts are few: the embedded chunks are cut down to those before their vectors are fetched, by id.
    """
    waiting = chunks.filter((F.col("embedding_status") == "pending") & ~F.col("deleted")).select("index_kind", "chunk_id", "text_hash")
    donors = embedded.select("index_kind", "chunk_id", "text_hash").join(waiting.select("index_kind", "text_hash").distinct(), ["index_kind", "text_hash"], "left_semi")
    known = donors.join(vectors, ["index_kind", "chunk_id"]).groupBy("index_kind", "text_hash").agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    return waiting.join(known, ["index_kind", "text_hash"]).select("index_kind", "chunk_id", "embedding")
