"""The tools of a corpus: checked arguments in, a JSON-like answer out."""

from __future__ import annotations

import base64
from dataclasses import dataclass
from typing import Any

from .corpus import Corpus, OutsideRoot, Unsupported
from .functions import globs
from .operators import retrieval
from .sources.models import ModelError


class ToolError(Exception):
    def __init__(self, code: str, message: str, retryable: bool = False):
        super().__init__(message)
        self.code, self.retryable = code, retryable

    def payload(self) -> dict:
        return {"error": {"code": self.code, "message": str(self), "retryable": self.retryable}}


@dataclass(frozen=True)
class Arg:
    kind: type
    default: Any = None
    required: bool = False
    low: int | None = None
    high: int | None = None
    one_of: tuple[str, ...] = ()


def integer(name: str, value: Any) -> int:
    """Whole numbers of JSON; 3.0 is one, 3.5 and true aren't."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value):
        raise ToolError("INVALID_FIELD", f"{name} must be an integer")
    return int(value)


def checked(args: dict[str, Any], spec: dict[str, Arg]) -> dict[str, Any]:
    unknown = sorted(set(args) - set(spec))
    if unknown:
        raise ToolError("INVALID_FIELD", f"unknown argument: {', '.join(unknown)}")
    out = {}
    for name, arg in spec.items():
        value = args.get(name)
        if value is None:
            if arg.required:
                raise ToolError("MISSING_FIELD", f"{name} is required")
            out[name] = arg.default
            continue
        if arg.kind is int:
            value = integer(name, value)
            if (arg.low is not None and value < arg.low) or (arg.high is not None and value > arg.high):
                raise ToolError("INVALID_RANGE", f"{name} must be between {arg.low} and {arg.high}")
        elif not isinstance(value, arg.kind):
            raise ToolError("INVALID_FIELD", f"{name} must be a {arg.kind.__name__}")
        if arg.kind is str and arg.required and not value.strip():
            raise ToolError("MISSING_FIELD", f"{name} is required")
        if arg.one_of and value not in arg.one_of:
            raise ToolError("INVALID_FIELD", f"{name} must be one of {', '.join(arg.one_of)}")
        out[name] = value
    return out


K = Arg(int, retrieval.DEFAULT_K, low=1, high=retrieval.MOST_K)
INDEX = Arg(str, "auto", one_of=("auto", "text", "code", "both"))
FILTERS = {"k": K, "index": INDEX, "path_prefix": Arg(str, ""), "file_glob": Arg(str, ""), "doc_types": Arg(list, None)}
PATH = Arg(str, required=True)
SPECS: dict[str, dict[str, Arg]] = {
    "search": {"query": Arg(str, required=True), **FILTERS},
    "ask": {"question": Arg(str, required=True), "mode": Arg(str, "answer", one_of=("answer", "search_only")), **FILTERS},
    "ask_audio": {"question": Arg(str, required=True), "voice": Arg(str, ""), **FILTERS},
    "transcribe": {"rel_path": PATH, "language": Arg(str, ""), "timestamps": Arg(bool, True), "retranscribe": Arg(bool, False)},
    "annotate": {
        "rel_path": PATH, "annotation": Arg(str, ""), "schema_json": Arg(dict, None), "index_flattened_text": Arg(bool, True), "max_chars": Arg(int, 20000, low=1, high=200000),
    },
    "transcribe_and_ask": {"rel_path": PATH, "question": Arg(str, required=True), "k": K},
    "open_file": {
        "rel_path": PATH, "start_line": Arg(int, None, low=1), "end_line": Arg(int, None, low=1), "page": Arg(int, None, low=1), "start_ms": Arg(int, None, low=0), "end_ms": Arg(int, None, low=0),
        "max_chars": Arg(int, 20000, low=200, high=50000),
    },
    "list_files": {"path_prefix": Arg(str, ""), "glob": Arg(str, ""), "limit": Arg(int, 200, low=1, high=5000), "offset": Arg(int, 0, low=0), "include_hidden": Arg(bool, False)},
    "stats": {},
}


def _search(a: dict[str, Any], query: str) -> retrieval.Search:
    return retrieval.Search(query=query, k=a["k"], index=a["index"], path_prefix=a["path_prefix"], file_glob=a["file_glob"], doc_types=tuple(a["doc_types"] or ()))


def span_payload(span: dict | None) -> dict:
    fields = {"page": ("page",), "time": ("start_ms", "end_ms")}.get((span or {}).get("kind", ""), ("start_line", "end_line"))
    return {"kind": (span or {}).get("kind") or "lines", **{f: (span or {}).get(f) for f in fields}}


def hit_payload(hit: dict) -> dict:
    return {**{f: hit.get(f) for f in ("chunk_id", "rel_path", "doc_type", "rep_type", "score", "snippet") if f in hit}, "span": span_payload(hit.get("span"))}


def search(corpus: Corpus, a: dict) -> dict:
    hits, used = corpus.search(_search(a, a["query"]))
    rows = [hit_payload(r.asDict(recursive=True)) for r in hits.collect()]
    return {"query": a["query"], "k": a["k"], "index_used": used, "hits": rows, "indexing_complete": not corpus.running}


def ask(corpus: Corpus, a: dict) -> dict:
    out = corpus.ask(a["question"], _search(a, a["question"]), generate=a.get("mode", "answer") == "answer")
    return {**out, "citations": [{**c, "span": span_payload(c["span"])} for c in out["citations"]], "hits": [hit_payload(h) for h in out["hits"]], "indexing_complete": not corpus.running}


def ask_audio(corpus: Corpus, a: dict) -> dict:
    if corpus.backends.voice is None:
        raise ToolError("NOT_CONFIGURED", "no voice")
    out = ask(corpus, a)
    return {**out, "audio_base64": base64.b64encode(corpus.backends.voice(out["answer"], a["voice"])).decode()}


def transcribe(corpus: Corpus, a: dict) -> dict:
    with_code = "TRANSCRIBE_FAILED"
    try:
        text, now, indexed = corpus.transcribe(a["rel_path"], a["language"], a["retranscribe"])
    except ModelError as e:
        raise ToolError(with_code, str(e), e.retryable) from e
    segments = corpus.transcript(a["rel_path"]) if a["timestamps"] and indexed else []
    return {"rel_path": a["rel_path"], "segments": segments, "transcribed": bool(text.strip()), "transcribed_now": now, "indexed": indexed}


def annotate(corpus: Corpus, a: dict) -> dict:
    """An annotation that the caller has, or one that a model makes of the document's source text to a schema."""
    if bool(a["annotation"].strip()) == bool(a["schema_json"]):
        raise ToolError("MISSING_FIELD", "one of annotation and schema_json is required")
    try:
        made = a["annotation"] or corpus.generated_annotation(a["rel_path"], a["schema_json"], a["max_chars"])
    except ModelError as e:
        raise ToolError("ANNOTATE_FAILED", str(e), e.retryable) from e
    return {"rel_path": a["rel_path"], "stored": True, "annotation": made, "preview": corpus.annotate(a["rel_path"], made, a["index_flattened_text"])}


def transcribe_and_ask(corpus: Corpus, a: dict) -> dict:
    told = transcribe(corpus, {"rel_path": a["rel_path"], "language": "", "timestamps": True, "retranscribe": False})
    found = ask(corpus, {"question": a["question"], "k": a["k"], "index": "text", "path_prefix": "", "file_glob": globs.escape_literal(a["rel_path"]), "doc_types": None})
    return {**found, **{k: told[k] for k in ("segments", "transcribed", "transcribed_now", "indexed")}}


def part_of(a: dict) -> dict[str, Any]:
    """The part of a source that is asked for: lines, a page or a time, or all of it."""
    groups = {"lines": ("start_line", "end_line"), "page": ("page",), "time": ("start_ms", "end_ms")}
    given = [g for g, names in groups.items() if any(a[n] is not None for n in names)]
    if len(given) > 1:
        raise ToolError("INVALID_FIELD", "lines, page and time exclude each other")
    if not given:
        return {}
    values = [a[n] for n in groups[given[0]]]
    if None in values:
        raise ToolError("INVALID_FIELD", f"both {' and '.join(groups[given[0]])} must be provided")
    if values[-1] < values[0]:
        raise ToolError("INVALID_FIELD", f"{groups[given[0]][0]} must be <= {groups[given[0]][-1]}")
    return {given[0]: values[0] if len(values) == 1 else tuple(values)}


def open_file(corpus: Corpus, a: dict) -> dict:
    part = part_of(a)
    text, truncated = corpus.open(a["rel_path"], a["max_chars"], **part)
    out = {"rel_path": a["rel_path"], "doc_type": corpus.doc_type_of(a["rel_path"]), "content": text, "truncated": truncated}
    shown = {"lines": ("start_line", "end_line"), "page": ("page",), "time": ("start_ms", "end_ms")}
    return out | {"span": {"kind": kind, **{n: a[n] for n in shown[kind]}} for kind in part}


def list_files(corpus: Corpus, a: dict) -> dict:
    page, total = corpus.list(a["path_prefix"], a["glob"], a["limit"], a["offset"], a["include_hidden"])
    rows = page.select("rel_path", "doc_type", "size_bytes", "mtime_unix", "status", "deleted").collect()
    return {"limit": a["limit"], "offset": a["offset"], "total": total, "files": [r.asDict() for r in rows]}


COUNTED = ("scanned", "indexed", "skipped", "deleted", "representations", "chunks_total", "embedded_ok", "errors", "unknown")


def stats(corpus: Corpus, a: dict) -> dict:
    """Counts of the corpus; where the tables below the documents were never written, those of the documents, and -1 for what they
    can't tell. A store that can't be read is an error."""
    try:
        whole = corpus.has_statistics()
        found = corpus.stats() if whole else corpus.document_stats()
    except Exception as e:  # noqa: BLE001  whatever is wrong with it
        raise ToolError("STORE_CORRUPT", "the store can't be read") from e
    indexing = {name: found.get(name, 0 if whole or name == "unknown" else -1) for name in COUNTED}
    moving = {"running": corpus.running, "progress": dict(corpus.progress)}
    return {"root": corpus.root, "state_dir": corpus.store.folder, **found, "doc_counts_available": whole, "indexing": {**moving, **indexing}}


TOOLS = {f.__name__: f for f in (search, ask, ask_audio, transcribe, annotate, transcribe_and_ask, open_file, list_files, stats)}


def schema(name: str) -> dict:
    """The JSON schema of a tool's arguments."""
    kinds = {str: "string", int: "integer", bool: "boolean", list: "array", dict: "object"}
    fields = {}
    for n, arg in SPECS[name].items():
        more = {"minimum": arg.low, "maximum": arg.high, "enum": list(arg.one_of) or None, "default": arg.default}
        fields[n] = {"type": kinds[arg.kind], **{k: v for k, v in more.items() if v is not None}}
    return {"type": "object", "properties": fields, "required": [n for n, a in SPECS[name].items() if a.required], "additionalProperties": False}


def call(corpus: Corpus, name: str, args: dict[str, Any] | None = None) -> dict:
    """The tool's answer, or its error as data."""
    try:
        if name not in TOOLS:
            raise ToolError("UNKNOWN_TOOL", name)
        return TOOLS[name](corpus, checked(args or {}, SPECS[name]))
    except ToolError as e:
        return e.payload()
    except LookupError as e:
        return ToolError("FILE_NOT_FOUND", str(e)).payload()
    except OutsideRoot as e:
        return ToolError("PATH_OUTSIDE_ROOT", str(e)).payload()
    except PermissionError as e:
        return ToolError("PERMISSION_DENIED", str(e)).payload()
    except Unsupported as e:
        return ToolError("DOC_TYPE_UNSUPPORTED", str(e)).payload()
    except TimeoutError as e:
        return ToolError("TIMEOUT", str(e), True).payload()
    except ModelError as e:
        return ToolError("MODEL_FAILED", str(e), e.retryable).payload()
    except Exception:  # noqa: BLE001  a caller learns nothing of the inside
        return ToolError("INTERNAL_ERROR", "internal error", True).payload()
