"""Keyed state with timers and bounds as streams: sessions that end, and outcomes that are replayed.

State is kept in RocksDB (see ``stateful``), so it isn't bounded by memory, and timers go by the watermark, so a stream that is
run again gives the same rows. Events later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.state import Lifetime, micros

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """The state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Sessions(StatefulProcessor):
    """first_us, last_us, n and the reason of every session that ended."""

    def __init__(self, key: str, gap: int, life: int):
        self.key, self.gap, self.life = key, gap, life

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "first long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = Lifetime(*self.now.get()) if self.now.exists() else None
        ended = []
        for at in sorted(int(t) for part in rows for t in part["at_"]):  # what a key has in one batch of the stream
            if now is not None and at <= now.over(self.gap, self.life)[0]:
                now.seen(at)
                continue
            if now is not None:
                ended.append((*key, now.first, now.last, now.n, now.over(self.gap, self.life)[1]))
            now = Lifetime(at, at)
        self.now.update((now.first, now.last, now.n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now.over(self.gap, self.life)[0] // 1000 + 1)
        if ended:
            yield pd.DataFrame(ended, columns=[self.key, "first_us", "last_us", "n", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.now.exists():
            now = Lifetime(*self.now.get())
            self.now.clear()
            yield pd.DataFrame([(*key, now.first, now.last, now.n, now.over(self.gap, self.life)[1])], columns=[self.key, "first_us", "last_us", "n", "reason"])

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, key: str, ts: str, gap_s: int = 24 * 3600, life_s: int = 0, late: str = "1 hour") -> DataFrame:
    """The sessions of a stream as they end, equal to those of expiring_sessions that have a reason."""
    kind = events.schema[key].dataType.simpleString()
    timed = events.filter(F.col(key).isNotNull()).select(key, F.col(ts).cast("timestamp").alias("ts_"), micros(ts).alias("at_")).withWatermark("ts_", late)
    schema = f"{key} {kind}, first_us long, last_us long, n long, reason string"
    return timed.groupBy(key).transformWithStateInPandas(Sessions(key, gap_s * 1_000_000, life_s * 1_000_000), schema, "append", "EventTime")


class Outcomes(StatefulProcessor):
    """Outcomes by key, of a share of all keys: those older than ttl go, and beyond ``most`` the oldest, of equal age the least key."""

    def __init__(self, ttl: int, most: int, execute: Callable[[str, str], str]):
        self.ttl, self.most, self.execute = ttl, most, execute

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "key string", "at long, call string, outcome string")

    def prune(self, now: int) -> None:
        """Expired outcomes go at their time, whatever calls come."""
        for key, value in list(self.kept.iterator()):
            if now - value[0] > self.ttl:
                self.kept.removeKey(key)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.kept.iterator()} if self.kept.exists() else {}
        calls = sorted((int(r.at_), str(r.call_id), r.key, r.params) for part in rows for r in part.itertuples(index=False))
        out = []
        for at, call, own, params in calls:
            for old in [k for k, v in held.items() if at - v[0] > self.ttl]:
                del held[old]
            found = held.get(own)
            if found is None:
                found = held[own] = (at, call, self.execute(own, params))
                for old in sorted(held, key=lambda k: (held[k][0], k))[: max(0, len(held) - self.most)]:
                    del held[old]
            out.append((call, own, found[1], found[2], found[1] != call))
        if self.kept.exists():
            for (k,) in [tuple(k) for k in self.kept.keys()]:
                if k not in held:
                    self.kept.removeKey((k,))
        for k, v in held.items():
            self.kept.updateValue((k,), v)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer((min(v[0] for v in held.values()) + self.ttl) // 1000 + 1)
        yield pd.DataFrame(out, columns=["call_id", "key", "executed_by", "outcome", "replayed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.prune(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        left = [v[0] for _, v in self.kept.iterator()] if self.kept.exists() else []
        if left:
            self.handle.registerTimer((min(left) + self.ttl) // 1000 + 1)
        return iter([])

    def close(self) -> None:
        pass


def replay_stream(calls: DataFrame, execute: Callable[[str, str], str], ttl_s: int = 600, most: int = 10_000, shards: int = 64, late: str = "1 minute") -> DataFrame:
    """call_id, key, executed_by, outcome, replayed of calls (call_id, key, params, ts): a key's call is executed once and its outcome
    returned to later ones, until it is ttl_s old or among more than ``most`` outcomes the oldest; then it is executed again.

    The keys are dealt into shards, each with its share of the bound. A batch that is run again after a failure executes its calls
    again, so execute has to be safe to repeat, as any call to the outside in a stream.
    """
    timed = calls.select(
        F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), F.col("call_id").cast("string").alias("call_id"), F.col("key").cast("string").alias("key"), F.col("params").cast("string").alias("params"),
        F.col("ts").cast("timestamp").alias("ts_"), micros("ts").alias("at_"),
    )
    schema = "call_id string, key string, executed_by string, outcome string, replayed boolean"
    own = Outcomes(ttl_s * 1_000_000, max(1, most // shards), execute)
    return timed.filter(F.col("key").isNotNull()).withWatermark("ts_", late).groupBy("shard").transformWithStateInPandas(own, schema, "append", "EventTime")
