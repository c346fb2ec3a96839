"""Kinds of documents by their paths, and the normalised values of status columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

#: Names and extensions of each kind of document at ingestion.
NAMES = {
    "code": ("dockerfile", "makefile", "jenkinsfile"),
    "text": ("readme", "license", "changelog"),
    "data": ("go.mod", "go.sum", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"),
}
EXTENSIONS = {
    "code": ("go", "rs", "py", "js", "jsx", "ts", "tsx", "java", "c", "cc", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "kt", "kts", "scala", "sh", "bash", "zsh", "sql"),
    "md": ("md", "markdown", "mdx", "rst", "adoc"),
    "text": ("txt", "log", "ini", "cfg", "conf"),
    "data": ("csv", "tsv", "parquet", "json", "jsonl", "xml", "yaml", "yml", "toml"),
    "html": ("html", "htm", "xhtml"),
    "pdf": ("pdf",),
    "image": ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff", "svg"),
    "audio": ("mp3", "wav", "m4a", "flac", "aac", "ogg", "opus"),
    "archive": ("zip", "tar", "gz", "tgz", "bz2", "xz", "7z", "rar"),
}
#: Extensions of each kind when a file is opened.
OPENED = {
    "code": (
        "go", "js", "jsx", "ts", "tsx", "py", "java", "rb", "cpp", "c", "cs", "kt", "kts", "swift", "php", "scala", "rs", "h", "hpp", "hh",
        "m", "mm", "dart", "pl", "pm", "lua", "r", "jl", "hs", "erl", "ex", "exs", "sql", "sh", "zsh", "fish",
    ),
    "html": ("html", "htm", "css"),
    "md": ("md",),
    "text": ("txt", "rst"),
    "pdf": ("pdf",),
    "audio": ("mp3", "wav", "m4a", "flac"),
    "image": ("png", "jpg", "jpeg", "gif", "webp"),
}
RAW_TEXT = ("code", "text", "md", "data", "html")


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def extension(name: Column) -> Column:
    """From the last dot on, without it; empty without a dot."""
    return F.regexp_extract(F.lower(name), r"\.([^.]*)\z", 1)


def doc_type(path: Column) -> Column:
    name = base_name(path)
    ext = extension(name)
    out = F.when((name == ".env") | name.startswith(".env."), "ignore")
    for kind, names in NAMES.items():
        out = out.when(name.isin(*names), kind)
    for kind, extensions in EXTENSIONS.items():
        out = out.when(ext.isin(*extensions), kind)
    return out.otherwise("binary_ignored")


def opened_type(path: Column) -> Column:
    ext = extension(base_name(trim(path)))
    out = F
    for kind, extensions in OPENED.items():
        out = out.when(ext.isin(*extensions), kind)
    return out.otherwise("unknown")


def index_kind(kind: Column) -> Column:
    return F.when(kind == "code", "code").otherwise("text")


def has_raw_text(kind: Column) -> Column:
    return kind.isin(*RAW_TEXT)


def _one_of(c: Column, values: tuple[str, ...], other: str) -> Column:
    v = F.lower(trim(F.coalesce(c, F.lit(""))))
    return F.when(v.isin(*values), v).otherwise(other)


def status(c: Column) -> Column:
    return _one_of(c, ("skipped", "error"), "ok")


def file_status(c: Column) -> Column:
    """The status of a listed file."""
    return status(c)


def source_type(c: Column) -> Column:
    return _one_of(c, ("archive_member",), "filesystem")


def kind_of_index(c: Column) -> Column:
    return _one_of(c, ("code",), "text")


def embedding_status(c: Column) -> Column:
    return _one_of(c, ("ok", "error"), "pending")


def stored_type(c: Column) -> Column:
    t = trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "text").otherwise(t)


def looks_binary(path: Column, content: Column) -> Column:
    return (F.instr(content, "\0") > 0) | (opened_type(path) == "audio")
