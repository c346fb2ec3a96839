"""Continuous embedding of pending chunks, and streaming forms of keyed state."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import changes
from ..operators.state import Bucket, unlimited
from ..session import steps
from ..sources.models import Embedder, embedding
from ..sources.store import Change, Conflict, Store


def embed_batch(chunks: DataFrame, factory: Callable[[], Embedder]) -> tuple[DataFrame, DataFrame]:
    """(vectors, results): transient failures stay pending, others are marked with their error."""
    made = chunks.select("index_kind", "chunk_id", embedding(factory)("text").alias("e"))
    vectors = made.filter("e.embedding IS NOT NULL").select("index_kind", "chunk_id", "e.embedding")
    status = F.when(F.col("e.embedding").isNotNull(), "ok").when(F.col("e.transient"), "pending").otherwise("error")
    return vectors, made.select("chunk_id", status.alias("status"), F.col("e.error").alias("error"))


@dataclass(frozen=True)
class Round:
    """What a round came to: chunks that were embedded, that wait for another try, and that failed for good."""

    ok: int = 0
    waiting: int = 0
    failed: int = 0


def run_once(store: Store, factory: Callable[[], Embedder], limit: int = 0) -> Round:
    """One round over what is pending. Vectors of equal texts are used again; results are written before they are read twice."""
    chunks, vectors = store.bucketed("chunks", "vectors")
    waiting = chunks.filter((F.col("embedding_status") == "pending") & ~F.col("deleted"))
    waiting = waiting.orderBy("chunk_id").limit(limit) if limit else waiting
    known = changes.reusable_vectors(waiting, chunks.filter("embedding_status = 'ok'"), vectors)
    rest = waiting.join(known.select("chunk_id"), "chunk_id", "left_anti")
    made = rest.select("index_kind", "chunk_id", embedding(factory)("text").alias("e")).unionByName(
        known.select("index_kind", "chunk_id", F.struct("embedding", F.lit(None).cast("string").alias("error"), F.lit(False).alias("transient")).alias("e"))
    )
    with steps(store.spark) as kept:
        made = kept(made)  # the model runs once, whatever other writers do
        status = F.when(F.col("e.embedding").isNotNull(), "ok").when(F.col("e.transient"), "pending").otherwise("error")
        results = made.select("chunk_id", status.alias("status"), F.col("e.error").alias("error"))
        new = made.filter("e.embedding IS NOT NULL").select("index_kind", "chunk_id", "e.embedding")
        n = {r.status: r["count"] for r in results.groupBy("status").count().collect()}
        if n:  # the texts stay in their parts: only the results are moved
            store.transaction(lambda _: {"chunks": Change(results, into=lambda old, own: changes.mark_embedding(old, own.hint("shuffle_hash"))), "vectors": Change(new)})
    return Round(n.get("ok", 0), n.get("pending", 0), n.get("error", 0))


#: Chunks of a round, seconds between rounds, and the most that a failing worker waits.
ROUND, POLL_S, MOST_PAUSE_S = 4096, 0.75, 30.0


def run(store: Store, factory: Callable[[], Embedder], stop: threading.Event, limit: int = ROUND, poll_s: float = POLL_S, most_pause_s: float = MOST_PAUSE_S) -> None:
    """Rounds until stop is set: at once while there is work, every poll_s while there is none. While all that a round tries has to wait,
    or other writers are always faster, the pauses double up to most_pause_s. Any other error ends it."""
    pause = poll_s
    while not stop.is_set():
        try:
            done = run_once(store, factory, limit)
        except Conflict:
            done = Round(waiting=1)
        if done.ok or done.failed:
            pause = poll_s
            continue
        stop.wait(pause)
        pause = min(pause * 2, most_pause_s) if done.waiting else poll_s


def embed_stream(spark: SparkSession, source: str, target: str, factory: Callable[[], Embedder], checkpoint: str, every: str | None = None):
    """Chunks that arrive as Parquet files get their vectors appended; a batch that is repeated overwrites its own folder."""
    arriving = spark.readStream.schema(schemas.CHUNKS).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        made = embed_batch(batch.filter("embedding_status = 'pending' AND NOT deleted").dropDuplicates(["chunk_id"]), factory)[0]
        made.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def session_stream(events: DataFrame, key: str, ts: str, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Sessions that only a gap ends; timed.session_stream has those with a lifetime."""
    windows = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("session")).agg(F.count("*").alias("n"))
    return windows.select(key, F.col("session.start").alias("first_ts"), F.col("session.end").alias("ends_at"), "n")


def rate_limit_stream(events: DataFrame, key: str, ts: str, ident: str, rps: float, burst: int) -> DataFrame:
    """ident, allowed for a stream of requests; a key's bucket is its state, which goes after an hour without a request.

    The same keys are free as in the batch form, and they have no state. Buckets expire by processing time, for which a query goes
    on without data; one that is to end (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off.
    """

    def fold(k, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(rps, burst, *state.get) if state.exists else Bucket(rps, burst)
        part = pd.concat(list(parts)).sort_values(["at_", ident])  # what a key has in one batch of the stream
        yield pd.DataFrame({ident: part[ident], "allowed": [bucket.allow(t) for t in part["at_"]]})
        state.update((bucket.tokens, bucket.last))
        state.setTimeoutDuration(3_600_000)

    timed = events.select(ident, key, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at_"))
    id_type = events.schema[ident].dataType.simpleString()
    limited = timed.filter(~unlimited(F.col(key), rps, burst)).groupBy(key)
    judged = limited.applyInPandasWithState(fold, f"{ident} {id_type}, allowed boolean", "tokens double, last double", "append", "ProcessingTimeTimeout")
    return judged.unionByName(timed.filter(unlimited(F.col(key), rps, burst)).select(ident, F.lit(True).alias("allowed")))


def once_stream(calls: DataFrame, key: str, ts: str, ttl: str = "10 minutes") -> DataFrame:
    """The calls that are executed: later ones with a key within the time to live are dropped."""
    return calls.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])
