"""Session construction and the shared folder that long jobs write to."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Of each session that has brief shuffles now: how many ask for them, and how its setting was before.
_BRIEF: dict[str, tuple[int, str]] = {}
_BRIEF_LOCK = threading.Lock()

#: Options of steps() for rows with whole texts: row groups of bounded rows and bytes, whose size is looked at after every few rows, as a
#: reader decodes a row group at once.
TEXT_ROWS = {"parquet.block.row.count.limit": "256", "parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16"}


def build_session(app: str = "textloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer.

    Sizes (shuffle partitions, broadcast threshold) are left to the cluster unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # tables of a store whose parts were doubled at different times still join where they lie
        "spark.sql.bucketing.coalesceBucketsInJoin.enabled": "true",
        # of a key that a JSON object has twice the last one counts
        "spark.sql.variant.allowDuplicateKeys": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """The session of tests and of the benchmark."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return build_session(
        master=f"local[{cores}]",
        **{
            "spark.driver.memory": memory,
            "spark.sql.shuffle.partitions": str(partitions),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.host": "127.0.0.1",
        },
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share, or that of setCheckpointDir.

    Where both are unset, a temporary one is made, in a local session only: executors elsewhere wouldn't see it.
    """
    set_one = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (set_one.get() if set_one.isDefined() else None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="textloom-")
        if not _OWN[app]:
            _OWN[app] = folder
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Jobs that this thread starts inside are cancelled after so many seconds, and TimeoutError is raised."""
    context, group, late = spark.sparkContext, uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    context.setJobGroup(group, "deadline", True)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"not done within {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    if late.is_set():
        raise TimeoutError(f"not done within {seconds:g} s")


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame computed once and kept in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """The files of a shuffle go with the query that wrote them, not when the driver's garbage is collected. For queries that run once;
    others are right too, but a second run makes its shuffles again. The last of several threads puts the setting back."""
    key, session = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", str(spark._jsparkSession.sessionUUID())
    with _BRIEF_LOCK:
        n, before = _BRIEF.get(session, (0, spark.conf.get(key)))
        _BRIEF[session] = n + 1, before
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        with _BRIEF_LOCK:
            n, before = _BRIEF.pop(session)
            if n > 1:
                _BRIEF[session] = n - 1, before
            else:
                spark.conf.set(key, before)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Computes frames once, as checkpointed() does, but into compressed files that go when the body ends: what is drawn from them
    has to be written by then. Options are those of the writer."""
    folder = f"{shared_folder(spark)}/textloom/steps-{uuid.uuid4().hex}"

    def kept(frame: DataFrame, **options: str) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        frame.write.options(compression="zstd", **options).parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    try:
        with brief_shuffles(spark):
            yield kept
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 512, size: int = 16 << 20) -> None:
    """Arrow batches of at most so many rows and (beyond one row) bytes, so that a batch of long texts stays small in a Python worker.

    A setting of the session, as plans read it when they run; smaller ones stay.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
