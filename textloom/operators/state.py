"""Behaviour that keeps state by key: sessions, rate limits, idempotent outcomes. Batch forms; see streaming for streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap_s: int = 24 * 3600) -> DataFrame:
    """key, session, first_ts, last_ts, n: a new session after more than the gap without an event."""
    order = Window.partitionBy(key).orderBy(ts)
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    fresh = F.when(seconds(ts) - F.lag(seconds(ts)).over(order) <= gap_s * 1_000_000, 0).otherwise(1)
    numbered = events.select(key, ts, fresh.alias("fresh")).withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


@dataclass
class Lifetime:
    """A session in microseconds: when it began, was last seen, and how many events it has had."""

    first: int
    last: int
    n: int = 1

    def over(self, gap: int, life: int) -> tuple[int, str]:
        """The last moment at which it holds, and why it ends then; life 0: for as long as events come."""
        idle = self.last + gap
        return (self.first + life, "max-lifetime") if 0 < life and self.first + life < idle else (idle, "inactivity")

    def seen(self, at: int) -> None:
        self.first, self.last, self.n = min(self.first, at), max(self.last, at), self.n + 1


def folded(rows: DataFrame, key: str, order: list[str], schema: str, fold: Callable[[], Callable[[Any, Iterator[tuple]], Iterator[tuple]]]) -> DataFrame:
    """Rows of fold()(key, its rows in order), for what has no closed form: a key's rows are a stream, and never held together.

    All rows of one key go through one task, one after the other, as each depends on those before.
    """
    names = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, made = fold(), []
        stream = (row for part in parts for row in part[names].itertuples(index=False, name=None))
        columns = [field.split(" ")[0] for field in schema.split(", ")]
        for out in by_key(stream, names.index(key), one):
            made.append(out)
            if len(made) >= 4096:
                yield pd.DataFrame(made, columns=columns)
                made = []
        if made:
            yield pd.DataFrame(made, columns=columns)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def by_key(stream: Iterator[tuple], at: int, fold: Callable[[Any, Iterator[tuple]], Iterator[tuple]]) -> Iterator[tuple]:
    for key, own in groupby(stream, lambda row: row[at]):
        yield from fold(key, own)


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def expiring_sessions(events: DataFrame, key: str, ts: str, gap_s: int = 24 * 3600, life_s: int = 0) -> DataFrame:
    """key, session, first_us, last_us, n, reason: sessions end by inactivity, or life_s after they began, whichever is first; the next
    event begins another. Those that still hold at the time of the last of all events have no reason. Events without a key have none."""
    gap, life = gap_s * 1_000_000, life_s * 1_000_000
    timed = events.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), micros(ts).alias("at_"))

    def fold() -> Callable[[Any, Iterator[tuple]], Iterator[tuple]]:
        def run(k: Any, rows: Iterator[tuple]) -> Iterator[tuple]:
            now, number = None, 0
            for _, at in rows:
                if now is not None and at <= now.over(gap, life)[0]:
                    now.seen(at)
                    continue
                if now is not None:
                    yield k, number, now.first, now.last, now.n, now.over(gap, life)[1]
                now, number = Lifetime(at, at), number + 1
            yield k, number, now.first, now.last, now.n, None

        return run

    kind = events.schema[key].dataType.simpleString()
    made = folded(timed, "key", ["at_"], f"key {kind}, session long, first_us long, last_us long, n long, reason string", fold)
    latest = timed.agg(F.max("at_").alias("latest"))
    idle, old = F.col("last_us") + gap, F.col("first_us") + life
    late = F.when((F.lit(life) > 0) & (old < idle), F.when(F.col("latest") > old, "max-lifetime")).when(F.col("latest") > idle, "inactivity")
    return made.crossJoin(F.broadcast(latest)).withColumn("reason", F.coalesce("reason", late)).drop("latest").withColumnRenamed("key", key)


def replays(calls: DataFrame, ttl_s: int) -> DataFrame:
    """calls (call_id, key, ts): which call's outcome each gets. A call is executed if its key has no outcome of at most ttl_s ago."""
    ttl = ttl_s * 1_000_000
    timed = calls.select("key", micros("ts").alias("at_"), "call_id")

    def fold() -> Callable[[Any, Iterator[tuple]], Iterator[tuple]]:
        def run(k: Any, rows: Iterator[tuple]) -> Iterator[tuple]:
            by = since = None
            for _, at, call in rows:
                if since is None or at - since > ttl:
                    by, since = call, at
                yield call, k, by, call != by

        return run

    kind = calls.schema["call_id"].dataType.simpleString()
    return folded(timed, "key", ["at_", "call_id"], f"call_id {kind}, key {calls.schema['key'].dataType.simpleString()}, executed_by {kind}, replayed boolean", fold)


class Bucket:
    """Tokens refill at a rate up to a burst; the first request of a key leaves a burst less one."""

    def __init__(self, rps: float, burst: int, tokens: float | None = None, last: float | None = None):
        self.rps, self.burst, self.tokens, self.last = rps, burst, tokens, last

    def allow(self, now: float) -> bool:
        if self.tokens is None:
            self.tokens, self.last = float(self.burst - 1), now
            return True
        if now > self.last:
            self.tokens = min(float(self.burst), self.tokens + (now - self.last) * self.rps)
        self.last = now
        if self.tokens >= 1:
            self.tokens -= 1
            return True
        return False


def unlimited(key: Column, rps: float, burst: int) -> Column:
    """Whether nothing limits a key: loopback addresses, empty keys, and all of them at a rate or burst of 0."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.lit(rps <= 0 or burst <= 0) | text.isin("", "::1") | text.startswith("127.")


def rate_limited(events: DataFrame, key: str, ts: str, rps: float, burst: int, ident: str) -> DataFrame:
    """ident, key, allowed. A fold has no closed form; a key's events are streamed through its bucket in order, in batches.

    Keys that nothing limits don't go through a bucket, so they don't meet in one task.
    """
    schema = f"{ident} {events.schema[ident].dataType.simpleString()}, {key} {events.schema[key].dataType.simpleString()}, allowed boolean"

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Any = None
        bucket = None
        for part in parts:
            out = []
            for k, t in zip(part[key], part["at_"]):
                if bucket is None or k != own:
                    own, bucket = k, Bucket(rps, burst)
                out.append(bucket.allow(t))
            yield pd.DataFrame({ident: part[ident], key: part[key], "allowed": out})

    timed = events.select(ident, key, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at_"))
    free = unlimited(F.col(key), rps, burst)
    judged = timed.filter(~free).repartition(key).sortWithinPartitions(key, "at_", ident).mapInPandas(fold, schema)
    return judged.unionByName(timed.filter(free).select(ident, key, F.lit(True).alias("allowed")))


def outcomes_kept(outcomes: DataFrame, now: int, ttl_s: int, most: int) -> DataFrame:
    """The outcomes (key, ts) of an idempotency cache that stay: within the time to live, and the newest so many of these."""
    return outcomes.filter(F.col("ts") > now - ttl_s).orderBy(F.desc("ts"), F.desc("key")).limit(most)


def settled_once(calls: DataFrame) -> DataFrame:
    """calls (call_id, key, ts): the first call of a key is executed, later ones get its outcome replayed."""
    first = calls.groupBy("key").agg(F.min(F.struct("ts", "call_id")).alias("f"))
    return calls.join(first, "key").select("call_id", "key", F.col("f.call_id").alias("executed_by"), (F.col("call_id") != F.col("f.call_id")).alias("replayed"))
