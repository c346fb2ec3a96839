"""Members of archives as files of their own, below the archive's path."""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

MEMBER_BYTES = 10 * 1024 * 1024
#: The most archives that a Python worker gets at a time, beside the bound on their bytes.
ARCHIVES = 64
#: Endings of archives that are opened.
FORMATS = ((".tar.gz", "tar.gz"), (".tgz", "tar.gz"), (".tar.bz2", "tar.bz2"), (".tar", "tar"), (".zip", "zip"))


def format_of(path: Column) -> Column:
    """null for what isn't opened; other archives keep their row and have no members."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F
    for ending, kind in FORMATS:
        out = out.when(name.endswith(ending), kind)
    return out.otherwise(F.lit(None))


def kind_of(name: str) -> str | None:
    """format_of for one name."""
    return next((kind for ending, kind in FORMATS if name.lower().endswith(ending)), None)


def safe(member: str) -> bool:
    return bool(member) and ".." not in member


def members(kind: str, data: bytes, most_bytes: int = MEMBER_BYTES) -> Iterator[tuple[str, bytes]]:
    """(path in the archive, content); what can't be read any more ends the list, what is unsafe or too large is left out."""
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if info.is_dir() or not safe(info.filename) or info.file_size > most_bytes:
                        continue
                    with z.open(info) as f:
                        content = f.read(most_bytes + 1)
                    if len(content) <= most_bytes:
                        yield info.filename.lstrip("/"), content
            return
        opened = {"tar": io.BytesIO, "tar.gz": lambda d: gzip.GzipFile(fileobj=io.BytesIO(d)), "tar.bz2": lambda d: bz2.BZ2File(io.BytesIO(d))}[kind](data)
        with tarfile.open(fileobj=opened, mode="r|") as t:
            for info in t:
                if info.isreg() and safe(info.name) and info.size <= most_bytes:
                    f = t.extractfile(info)
                    if f is not None:
                        yield info.name.lstrip("/"), f.read()
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, RuntimeError, NotImplementedError):
        return


def extracted(files: DataFrame) -> DataFrame:
    """files (rel_path, content, size_bytes, mtime_unix, …) of archives -> the same columns for their members."""
    small_batches(files.sparkSession, ARCHIVES)
    schema = "rel_path string, content binary, size_bytes long, mtime_unix long, source_type string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                for name, content in members(row.kind, bytes(row.content)):
                    yield pd.DataFrame({"rel_path": [f"{row.rel_path}/{name}"], "content": [content], "size_bytes": [len(content)], "mtime_unix": [row.mtime_unix], "source_type": ["archive_member"]})

    own = files.select("rel_path", "content", "mtime_unix", format_of(F.col("rel_path")).alias("kind")).filter("kind IS NOT NULL")
    return own.mapInPandas(run, schema)


def with_members(files: DataFrame) -> DataFrame:
    return files.select("rel_path", "content", "size_bytes", "mtime_unix", "source_type").unionByName(extracted(files))
