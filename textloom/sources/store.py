"""The tables of a corpus as versioned Parquet folders.

A table is dealt into parts by a hash of a key; the manifest has, for each table, how many parts there are and the folder of
every part. Writing makes new folders for the parts that change and then publishes the next manifest, numbered, by a step that
fails if that number is taken. So readers see the state before or after, a crash in between leaves nothing that is read, and of
two writers one finds out and does its work again. A table whose parts have become large is dealt anew into more of them.

Parts are Spark's buckets of the same key, so tables that are dealt by one key join where they lie (see ``bucketed``).

Files are reached through Hadoop's file systems (where a rename onto an existing name fails, as in HDFS) or, for local folders,
through a link. Object stores whose renames aren't atomic are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..operators import changes
from ..session import brief_shuffles, steps

#: Of each table the number of its parts, and the folder of each part by its name (part_=3, or part_=3/index_kind=text).
Manifest = dict[str, dict[str, Any]]
#: Bytes of a part beyond which a table is dealt into more parts; seconds that an old state, and what a writer left, stay.
PART_BYTES, READABLE_S, ABANDONED_S = 256 << 20, 24 * 3600, 7 * 24 * 3600
#: Object stores on which a rename is a copy, so that two writers could both get a number.
NOT_ATOMIC = ("s3", "s3a", "s3n", "gs", "oss", "cosn", "wasb", "wasbs", "swift")


class Conflict(RuntimeError):
    """Another writer changed a table since it was read."""


@dataclass(frozen=True)
class Change:
    """Rows that replace those of their key, and rows that go: all with a value of the table's part key in ``removed``.

    Or, with ``into``, rows of few columns with the table's part key, and how they are put into the rows of the parts that they touch;
    it leaves every row in its part, so none is dealt anew.
    """

    rows: DataFrame
    removed: DataFrame | None = None
    into: Callable[[DataFrame, DataFrame], DataFrame] | None = None


class Store:
    """parts: into how many parts a new table is dealt; tables that are there keep theirs."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 8, part_bytes: int = PART_BYTES):
        self.spark, self.folder, self.parts, self.part_bytes = spark, folder.rstrip("/"), parts, part_bytes
        _, fs = self._path("")
        self.scheme = str(fs.getUri().getScheme())
        if self.scheme in NOT_ATOMIC:
            raise ValueError(f"a store needs atomic renames, which {self.scheme} hasn't got")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _local(self, name: str) -> str | None:
        """The path of a local file, however its folder is written; None in other file systems."""
        return str(self._path(name)[0].toUri().getPath()) if self.scheme == "file" else None

    def _listed(self, name: str) -> list:
        path, fs = self._path(name)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._listed("manifests")]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def _manifest(self, number: int) -> Manifest:
        path, fs = self._path(f"manifests/{number:012}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _latest(self) -> tuple[int, Manifest]:
        numbers = self._numbers()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {})

    def _publish(self, number: int, manifest: Manifest) -> bool:
        """Whether the manifest got the number; it is written whole before it gets its name."""
        name, draft = f"manifests/{number:012}.json", f"drafts/{uuid.uuid4().hex}"
        path, fs = self._path(draft)
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        target, _ = self._path(name)
        fs.mkdirs(target.getParent())
        local = self._local(name)
        if local is None:
            return bool(fs.rename(path, target))
        try:
            os.link(self._local(draft), local)
        except FileExistsError:
            return False
        finally:
            fs.delete(path, False)
        return True

    def _commit(self, new: Manifest, seen: Manifest | None = None) -> None:
        """Publish new parts of tables over the latest state; Conflict if a table isn't any more as it was seen."""
        while True:
            number, now = self._latest()
            for table in new:
                if seen is not None and now.get(table) != seen.get(table):
                    raise Conflict(table)
            if self._publish(number + 1, {**now, **new}):
                return

    @contextmanager
    def _lease(self, number: int) -> Iterator[str]:
        """An id for folders that are about to be written, and a promise that they and the state they are drawn from stay.

        A writer that dies leaves its lease, and so its folders, for ABANDONED_S.
        """
        ident = uuid.uuid4().hex
        path, fs = self._path(f"leases/{ident}-{number}")
        fs.create(path, False).close()
        try:
            yield ident
        finally:
            fs.delete(path, False)

    def _part(self, table: str, parts: int) -> Column:
        """The number of a row's part, which is that of its bucket too."""
        return F.pmod(F.hash(schemas.PART_KEYS[table]), F.lit(parts)).cast("int")

    def _read(self, table: str, places: Mapping[str, str]) -> DataFrame:
        empty = self.spark.createDataFrame([], schemas.TABLES[table])
        if not places:
            return empty.limit(0)  # so that a plan knows: a join with it moves nothing
        paths = (f"{self.folder}/{p}" for p in sorted(places.values()))
        return self.spark.read.schema(empty.schema).option("basePath", f"{self.folder}/{table}").parquet(*paths).select(*empty.columns)

    def read(self, table: str) -> DataFrame:
        """The current version; a table that was never written is empty."""
        return self._read(table, self._latest()[1].get(table, {}).get("places", {}))

    def has(self, *tables: str) -> bool:
        """Whether all the tables were written."""
        now = self._latest()[1]
        return all(table in now for table in tables)

    def state(self, table: str) -> str:
        """A name of what a table holds now; another once it is written."""
        return json.dumps(self._latest()[1].get(table), sort_keys=True)

    def bucketed(self, *tables: str) -> tuple[DataFrame, ...]:
        """The tables in one state, as tables of the session's catalog that Spark knows the buckets of: a join or a grouping by their
        key needs no shuffle. An entry of the catalog stands for one state of one table, and is only made once."""
        _, now = self._latest()
        return tuple(self._in_catalog(table, now[table]) if table in now else self._read(table, {}) for table in tables)

    def _in_catalog(self, table: str, entry: dict[str, Any], parts: list[int] | None = None) -> DataFrame:
        columns = self.spark.createDataFrame([], schemas.TABLES[table]).schema
        if not entry["places"]:
            return self.spark.createDataFrame([], columns)
        state = hashlib.md5(json.dumps([self.folder, table, entry], sort_keys=True).encode()).hexdigest()
        name, by = f"textloom_{table}_{state}", schemas.PART_FOLDERS.get(table, [])
        if not self.spark.catalog.tableExists(name):
            typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(columns, key=lambda f: f.name in by))
            layout = f"PARTITIONED BY ({', '.join([*by, 'part_'])}) CLUSTERED BY ({schemas.PART_KEYS[table]}) INTO {entry['parts']} BUCKETS"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({typed}, part_ int) USING parquet {layout} LOCATION '{self.folder}/{table}'")
            spec = lambda leaf: ", ".join(f"{k} = '{v}'" for k, v in (x.split("=") for x in leaf.split("/")))
            places = " ".join(f"PARTITION ({spec(leaf)}) LOCATION '{self.folder}/{at}'" for leaf, at in sorted(entry["places"].items()))
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {places}")
        rows = self.spark.table(name)
        return (rows if parts is None else rows.filter(F.col("part_").isin(parts))).select(*columns.names)

    def forget(self) -> None:
        """Take the store's tables out of the session's catalog; their files stay."""
        for t in self.spark.catalog.listTables():
            if t.name.startswith("textloom_") and t.name.removeprefix("textloom_").rpartition("_")[0] in schemas.TABLES:
                self.spark.sql(f"DROP TABLE IF EXISTS {t.name}")

    def _written(self, table: str, frame: DataFrame, parts: int, lease: str, most: int | None = None, dealt: bool = False) -> dict[str, str]:
        """The rows in new folders, a bucket to each part. most: how many of the parts the rows are in; dealt: whether they lie by parts."""
        at = f"{table}/v_=x{lease}-{uuid.uuid4().hex[:8]}"
        columns = self.spark.createDataFrame([], schemas.TABLES[table]).schema
        key, by = schemas.PART_KEYS[table], ["part_", *schemas.PART_FOLDERS.get(table, [])]
        rows = frame.select(*(F.col(f.name).cast(f.dataType) for f in columns)).withColumn("part_", self._part(table, parts))
        if not dealt:
            rows = rows.repartition(parts, key) if most is None else rows.repartition(most, "part_")
        name = f"textloom_writing_{uuid.uuid4().hex}"  # the catalog's writer alone makes buckets
        try:
            with brief_shuffles(self.spark):
                rows.write.format("parquet").options(**({"compression": "zstd"} if table in schemas.TEXTS else {})).partitionBy(*by).bucketBy(parts, key).option("path", f"{self.folder}/{at}").saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        leaves = [""]
        for level in by:
            found = [(leaf, s.getPath().getName()) for leaf in leaves for s in self._listed(f"{at}/{leaf}" if leaf else at)]
            leaves = [f"{leaf}/{n}" if leaf else n for leaf, n in found if n.startswith(f"{level}=")]
        return {leaf: f"{at}/{leaf}" for leaf in leaves}

    def write(self, **tables: DataFrame) -> None:
        """New versions of whole tables, which come into being together."""
        number, now = self._latest()
        with self._lease(number) as lease:
            counts = {name: now.get(name, {}).get("parts", self.parts) for name in tables}
            self._commit({name: self._sized(name, {"parts": counts[name], "places": self._written(name, frame, counts[name], lease)}, lease) for name, frame in tables.items()})

    def _sized(self, table: str, entry: dict[str, Any], lease: str, new: set[str] | None = None) -> dict[str, Any]:
        """The entry, dealt into twice as many parts as often as it takes if one of its new parts has become large. What was written
        for it under this lease, and nobody has seen, goes then."""
        sizes: dict[str, int] = {}
        for leaf, at in entry["places"].items():
            if new is None or leaf in new:
                path, fs = self._path(at)
                part = leaf.split("/")[0]
                sizes[part] = sizes.get(part, 0) + fs.getContentSummary(path).getLength()
        times = -(-max(sizes.values(), default=0) // self.part_bytes)
        if times <= 1:
            return entry
        parts = entry["parts"] << (times - 1).bit_length()
        whole = self._written(table, self._read(table, entry["places"]), parts, lease)
        for at in {"/".join(at.split("/")[:2]) for at in entry["places"].values()}:
            if at.startswith(f"{table}/v_=x{lease}-"):
                path, fs = self._path(at)
                fs.delete(path, True)
        return {"parts": parts, "places": whole}

    def _changed(self, table: str, change: Change, entry: dict[str, Any], lease: str) -> dict[str, Any]:
        """The table's entry with the parts written anew that the change touches, and no others."""
        key, places, count = schemas.PART_KEYS[table], entry["places"], entry["parts"]
        if not places:  # nothing to meet
            made = {} if change.into is not None else self._written(table, change.rows, count, lease)
            return self._sized(table, {"parts": count, "places": made}, lease)
        with steps(self.spark) as kept:
            rows = kept(change.rows if change.into is not None else change.rows.select(*self.spark.createDataFrame([], schemas.TABLES[table]).columns))
            touched = rows.select(key) if change.removed is None else rows.select(key).unionByName(change.removed.select(key))
            parts = {f"part_={r[0]}": r[0] for r in touched.select(self._part(table, count)).distinct().collect()}
            if not parts:
                return entry
            touches = lambda leaf: leaf.split("/")[0] in parts
            if change.into is not None:
                made = self._written(table, change.into(self._in_catalog(table, entry, sorted(parts.values())), rows), count, lease, dealt=True)
            else:
                old = self._read(table, {leaf: at for leaf, at in places.items() if touches(leaf)})
                if change.removed is not None:
                    old = old.join(change.removed.select(key), key, "left_anti")
                made = self._written(table, changes.merge(old, rows, schemas.KEYS[table]), count, lease, len(parts))
        whole = {leaf: at for leaf, at in places.items() if not touches(leaf)} | made
        return self._sized(table, {"parts": count, "places": whole}, lease, set(made))

    def transaction(self, make: Callable[[Callable[[str], DataFrame]], dict[str, Change]], attempts: int = 5) -> None:
        """The changes that ``make`` draws from tables (it gets a reader of one state) come into being at once, or not at all.

        If another writer was faster, they are drawn again from what it left.
        """
        none = {"parts": self.parts, "places": {}}
        for attempt in range(attempts):
            number, seen = self._latest()
            with self._lease(number) as lease:
                made = make(lambda table: self._read(table, seen.get(table, none)["places"]))
                new = {table: self._changed(table, change, seen.get(table, none), lease) for table, change in made.items()}
                try:
                    return self._commit({t: entry for t, entry in new.items() if entry != seen.get(t, none)}, seen)
                except Conflict:
                    if attempt + 1 == attempts:
                        raise

    def upsert(self, table: str, rows: DataFrame) -> None:
        self.transaction(lambda _: {table: Change(rows)})

    def expire(self, keep: int = 16, readable_s: int = READABLE_S, abandoned_s: int = ABANDONED_S) -> None:
        """Forget old states, and folders that nobody needs any more.

        A state goes if it isn't among the newest, was superseded that long ago, and no writer draws from it. A folder goes if no
        state that stays names it and its writer isn't at work, as its lease tells; folders are looked at before leases, and leases
        before states, so one that is published meanwhile is seen.
        """
        folders = [f"{table}/{s.getPath().getName()}" for table in schemas.TABLES for s in self._listed(table)]
        leases = {}
        for status in self._listed("leases"):
            if status.getModificationTime() >= (time.time() - abandoned_s) * 1000:
                ident, _, number = status.getPath().getName().partition("-")
                leases[ident] = int(number)
            else:
                self._path("")[1].delete(status.getPath(), False)
        states = [(int(s.getPath().getName().removesuffix(".json")), s.getModificationTime()) for s in self._listed("manifests") if s.getPath().getName().removesuffix(".json").isdigit()]
        states.sort()
        superseded = {number: after for (number, _), (_, after) in zip(states, states[1:])}
        needed = min(leases.values(), default=states[-1][0] if states else 0)
        old = [n for n, after in superseded.items() if after < (time.time() - readable_s) * 1000 and n < needed and n not in [x for x, _ in states[-keep:]]]
        named = {"/".join(at.split("/")[:2]) for n, _ in states if n not in old for entry in self._manifest(n).values() for at in entry["places"].values()}
        for number in old:
            path, fs = self._path(f"manifests/{number:012}.json")
            fs.delete(path, False)
        for at in folders:
            if at not in named and at.split("v_=x")[-1].split("-")[0] not in leases:
                path, fs = self._path(at)
                fs.delete(path, True)

    def set(self, key: str, value: str) -> None:
        self.upsert("settings", self.spark.createDataFrame([(key, value)], schemas.SETTINGS))

    def get(self, key: str, default: str | None = None) -> str | None:
        row = self.read("settings").filter(F.col("key") == key).first()
        return row.value if row else default

    def bootstrap(self, defaults: dict[str, str]) -> None:
        """Settings that aren't there yet."""
        rows = self.spark.createDataFrame(sorted(defaults.items()), schemas.SETTINGS)
        self.transaction(lambda read: {"settings": Change(rows.join(read("settings").select("key"), "key", "left_anti"))})


def write_snapshot(stats: DataFrame, path: str, keep_s: float = 60) -> None:
    """The statistics of a corpus as one JSON document in a folder, named by its time; others go once they are that old, so that nobody
    is reading them."""
    spark, now = stats.sparkSession, time.time_ns()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    before = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    stats.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{path}/{now:020}")
    for old in before:
        if int(old.getName()) < now - keep_s * 1e9:
            fs.delete(old, True)


def read_snapshot(spark: SparkSession, path: str, schema: StructType | str) -> Row | None:
    """The newest snapshot; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [s.getPath() for s in (fs.listStatus(at) if fs.exists(at) else []) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not whole:
        return None
    newest = max(p.toString() for p in whole)
    return spark.read.text(newest).select(F.from_json("value", schema).alias("s")).select("s.*").first()


def append_events(events: DataFrame, path: str) -> None:
    """Events (ts, level, event, data) or settlements as lines of JSON."""
    events.write.mode("append").json(path)


def read_through(cache: DataFrame, wanted: DataFrame, key: str, value: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results, rows to add to the cache): cached values of ``wanted``, and computed ones for keys that aren't cached, each once."""
    misses = compute(wanted.join(cache.select(key), key, "left_anti").dropDuplicates([key])).select(key, value)
    return wanted.select(key).join(cache.select(key, value).unionByName(misses), key), misses
