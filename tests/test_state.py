import threading
import time

import pytest
from pyspark.sql import functions as F

from textloom import rpc, schemas
from textloom.operators import state
from textloom.sources import models, store
from textloom.streaming import timed, worker


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    timed.stateful(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, folder, batches, make):
    """What a stream gives for rows that come in several files, one a batch."""
    frame = None
    for n, rows in enumerate(batches):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        frame = rows
        time.sleep(0.01)
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()]


def test_sessions_end_for_two_reasons(rocks, tmp_path):
    spark = rocks
    seconds = [("a", 0), ("a", 50), ("a", 90), ("a", 130), ("a", 200), ("b", 0), ("b", 61), ("b", 400), (None, 5), ("c", 100), ("c", 160), ("c", 161), ("z", 9000)]
    frame = spark.createDataFrame(seconds, "user string, s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 10**9))
    batch = state.expiring_sessions(frame, "user", "ts", gap_s=60, life_s=120)
    rows = sorted((r.user, r.session, r.first_us // 10**6 - 10**9, r.last_us // 10**6 - 10**9, r.n, r.reason) for r in batch.collect())
    assert rows == [
        ("a", 1, 0, 90, 3, "max-lifetime"), ("a", 2, 130, 130, 1, "inactivity"), ("a", 3, 200, 200, 1, "inactivity"), ("b", 1, 0, 0, 1, "inactivity"), ("b", 2, 61, 61, 1, "inactivity"),
        ("b", 3, 400, 400, 1, "inactivity"), ("c", 1, 100, 161, 3, "max-lifetime"), ("z", 1, 9000, 9000, 1, None),
    ]
    cut = [frame.filter("s < 95 OR user IS NULL"), frame.filter("s BETWEEN 95 AND 250"), frame.filter("s > 250")]
    found = streamed(spark, tmp_path, cut, lambda x: timed.session_stream(x, "user", "ts", 60, 120, late="10 seconds"))
    assert sorted((u, a // 10**6 - 10**9, b // 10**6 - 10**9, n, why) for u, a, b, n, why in found) == [(u, a, b, n, why) for u, _, a, b, n, why in rows if why]
    assert batch.drop("session").count() == 8 and state.expiring_sessions(frame.limit(0), "user", "ts").count() == 0


def plain_replays(calls, ttl, most):
    held, out = {}, []
    for at, call, key, params in sorted(calls):
        held = {k: v for k, v in held.items() if at - v[0] <= ttl}
        if key not in held:
            held[key] = (at, call, f"did {params}")
            for old in sorted(held, key=lambda k: (held[k][0], k))[: max(0, len(held) - most)]:
                del held[old]
            out.append((call, key, call, f"did {params}", False))
        else:
            out.append((call, key, held[key][1], held[key][2], True))
    return sorted(out)


def test_outcomes_are_replayed_until_they_expire(rocks, tmp_path):
    spark = rocks
    calls = [(0, "1", "k", "x"), (5, "2", "k", "x"), (5, "3", "j", "y"), (9, "4", "k", "x"), (10, "5", "k", "x"), (11, "6", "k", "x"), (12, "7", "m", "z"), (13, "8", "n", "w"), (14, "9", "k", "x"), (100, "a", "n", "w")]
    frame = spark.createDataFrame(calls, "s int, call_id string, key string, params string").withColumn("ts", F.timestamp_seconds(F.col("s") + 10**9)).drop("s")
    parts = [frame.filter("call_id IN ('1', '2', '3')"), frame.filter("call_id IN ('4', '5', '6', '7')"), frame.filter("call_id IN ('8', '9', 'a')")]
    make = lambda x: timed.replay_stream(x, lambda key, params: f"did {params}", ttl_s=10, most=2, shards=1, late="20 seconds")
    assert sorted(streamed(spark, tmp_path, parts, make)) == plain_replays(calls, 10, 2)
    by = {r.call_id: (r.executed_by, r.replayed) for r in state.replays(frame, 10).collect()}
    assert by == {c: (e, r) for c, _, e, _, r in plain_replays(calls, 10, 99)} and by["5"] == ("1", True) and by["6"] == ("6", False)


def test_sessions_of_an_endpoint(monkeypatch):
    own, now = rpc.Endpoint(None, mode="none", idle_s=10, most_s=25), [0.0]
    monkeypatch.setattr(time, "time_ns", lambda: int(now[0] * 1e9))
    send = lambda method, **h: own.handle(f'{{"jsonrpc": "2.0", "id": 1, "method": "{method}"}}', {"Content-Type": "application/json", **h})
    ident = {"MCP-Session-Id": send("initialize")[2]["MCP-Session-Id"]}
    seen = []
    for now[0] in (9, 18, 25, 26):
        seen.append(send("tools/list", **ident)[0])
    assert seen == [200, 200, 200, 404]
    ident = {"MCP-Session-Id": send("initialize")[2]["MCP-Session-Id"]}
    now[0] += 11
    assert send("tools/list", **ident)[0] == 404 and own.sessions == {}


def failing(log, until):
    """A factory of embedders that are busy for the first calls, which a file counts."""

    class Busy:
        def embed(self, texts):
            with open(log, "a") as f:
                f.write("x")
            if len(open(log).read()) <= until:
                raise models.Transient("busy")
            return [[1.0] for _ in texts]

    return Busy


def test_a_worker_runs_on(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}/state", parts=2)
    row = lambda i: (i, i, 0, f"{i}.md", "md", "raw_text", f"text {i}", f"h{i}", 1, "text", "pending", "", False)
    own.write(chunks=spark.createDataFrame([row(1)], schemas.CHUNKS))
    stop, pauses = threading.Event(), []
    wait = stop.wait

    def waited(s):
        pauses.append(s)
        if own.read("chunks").filter("embedding_status = 'pending'").isEmpty() and len(pauses) > 4:
            stop.set()
        return wait(0.01)

    stop.wait = waited
    worker.run(own, failing(f"{tmp_path}/log", 12), stop, poll_s=1, most_pause_s=4)
    assert own.read("vectors").count() == 1 and pauses[:2] == [1, 2] and max(pauses) <= 4 and pauses[-1] == 1
    own.upsert("chunks", spark.createDataFrame([row(2)], schemas.CHUNKS))

    def broken():
        raise RuntimeError("no key")

    with pytest.raises(Exception, match="no key"):
        worker.run(own, broken, threading.Event())
