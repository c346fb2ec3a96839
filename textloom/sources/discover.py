"""Files of a folder, listed in executors: relative paths, with ignore files, excluded folders, links and a size cap.

The folders of a level are dealt over the cluster and each is listed by one task; the folders that are found there, with the
ignore rules that hold in them, are the next level. So the driver holds no path, and a tree costs a job for each of its levels.

Folders of a mounted file system are listed as such, with links; other addresses through Arrow's file systems, which have none.
Of a folder that several paths lead to (by links) the path with the fewest steps is entered, of these the least, and no other.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs
from ..session import checkpointed

SKIPPED_FOLDERS = (".git", globs.STATE_FOLDER, "node_modules", "vendor", "__pycache__")
MOST_BYTES = 10 * 1024 * 1024
FILES = "rel_path string, path string, size_bytes long, mtime_unix long"
#: What a folder holds. real: where a folder lies once links are followed; rules: the ignore rules that hold in it, as JSON.
ENTRIES = f"{FILES}, folder boolean, real string, rules string"
#: Entries that a task returns at a time.
ENTRY_BATCH = 4096
#: Files, and bytes of them, that are handed on at a time once they are read.
READ_FILES, READ_BYTES = 256, 4 << 20


def mounted(root: str) -> str | None:
    """The path of a folder that every machine has mounted; None for other addresses."""
    return re.sub("^file:/+", "/", root) if "://" not in root or root.startswith("file:") else None


def _inside(root: str, path: str) -> bool:
    return path == root or path.startswith(root.rstrip(os.sep) + os.sep)


def _ignored(rel: str, folder: bool, rules: list[dict]) -> bool:
    out = False
    for r in rules:
        if (folder or not r["only_folders"]) and re.match(globs.rule_regex(r).replace(r"\z", r"\Z"), rel):
            out = not r["negated"]
    return out


def _mounted_entries(real_root: str, at: str, follow_links: bool) -> Iterator[tuple[str, str, bool, int, int, str]]:
    """(name, path, whether a folder, size, mtime, where it lies) of what a mounted folder holds."""
    for entry in os.scandir(at):
        if entry.is_symlink():
            target = os.path.realpath(entry.path)
            if not follow_links or not _inside(real_root, target) or not os.path.exists(target):
                continue
        try:
            info = os.stat(entry.path)
        except FileNotFoundError:  # it went meanwhile
            continue
        folder = os.path.isdir(entry.path)
        if folder or os.path.isfile(entry.path):
            yield entry.name, entry.path, folder, info.st_size, int(info.st_mtime), os.path.realpath(entry.path) if folder else ""


def _stored_entries(at: str) -> Iterator[tuple[str, str, bool, int, int, str]]:
    """The same of a folder of any other file system."""
    files, path = arrow_fs.FileSystem.from_uri(at)
    for info in files.get_file_info(arrow_fs.FileSelector(path)):
        folder, own = info.type == arrow_fs.FileType.Directory, f"{at.rstrip('/')}/{quote(info.base_name)}"
        yield info.base_name, own, folder, info.size or 0, int((info.mtime_ns or 0) // 1_000_000_000), own if folder else ""


def _read(path: str) -> bytes | None:
    """The whole of a file; None if it isn't there any more or can't be read."""
    try:
        if "://" not in path:
            with open(path, "rb") as f:
                return f.read()
        files, own = arrow_fs.FileSystem.from_uri(path)
        with files.open_input_stream(own) as f:
            return f.read()
    except OSError:
        return None


def listed(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES, use_ignore_files: bool = True, follow_links: bool = False, kept: Callable[..., DataFrame] = checkpointed) -> DataFrame:
    """rel_path, path, size_bytes, mtime_unix of the files of a tree; nothing but ignore files is opened. kept: how levels are kept."""
    local = mounted(root)
    real_root = os.path.realpath(local) if local else root

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        names = ["rel_path", "path", "size_bytes", "mtime_unix", "folder", "real", "rules"]
        made: list[tuple] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), kinds)], names)
        for batch in batches:
            for rel, at, passed in zip(*(batch.column(n).to_pylist() for n in ("rel_path", "path", "rules"))):
                rules = json.loads(passed)
                own = _read(f"{at.rstrip('/')}/.gitignore") if use_ignore_files else None
                if own is not None:
                    rules = rules + globs.ignore_rules(own.decode("utf-8", "replace"), rel)
                below = json.dumps(rules)
                for name, path, folder, size, mtime, real in _mounted_entries(real_root, at, follow_links) if local else _stored_entries(at):
                    own_path = f"{rel}/{name}" if rel else name
                    if (folder and name in SKIPPED_FOLDERS) or _ignored(own_path, folder, rules) or (not folder and 0 < most_bytes < size):
                        continue
                    made.append((own_path, path, size, mtime, folder, real, below if folder else None))
                    if len(made) >= ENTRY_BATCH:
                        yield batch_of()
                        made = []
        if made:
            yield batch_of()

    level = spark.createDataFrame([("", local or root, real_root, "[]")], "rel_path string, path string, real string, rules string")
    entered, levels = level.select("real"), []
    while True:
        found = kept(level.repartition(spark.sparkContext.defaultParallelism).mapInArrow(entries, ENTRIES))
        levels.append(found.filter("NOT folder").select("rel_path", "path", "size_bytes", "mtime_unix"))
        level = found.filter("folder").select("rel_path", "path", "real", "rules")
        if follow_links and local:
            fresh = level.join(entered, "real", "left_anti").groupBy("real").agg(F.min(F.struct("rel_path", "path", "rules")).alias("f"))
            level = kept(fresh.select("f.rel_path", "f.path", "real", "f.rules"))
            entered = entered.unionByName(level.select("real"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def with_content(files: DataFrame) -> DataFrame:
    """The content of listed files, read in executors; files that went since are left out. A batch has READ_FILES of them, or fewer
    where they come to READ_BYTES, which its last file exceeds at most."""
    columns = ["rel_path", "content", "size_bytes", "mtime_unix", "source_type"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], columns)
        for batch in batches:
            for rel_path, path, size_bytes, mtime in zip(*(column.to_pylist() for column in batch.columns)):
                content = _read(path)
                if content is None:
                    continue
                held.append((rel_path, content, size_bytes, mtime, "filesystem"))
                size += len(content)
                if len(held) >= READ_FILES or size >= READ_BYTES:
                    yield batch_of()
                    held, size = [], 0
        if held:
            yield batch_of()

    spread = files.select("rel_path", "path", "size_bytes", "mtime_unix").repartition(files.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(read, "rel_path string, content binary, size_bytes long, mtime_unix long, source_type string")
