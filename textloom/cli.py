"""Commands: up (scan and embed), reindex, status, ask, config, version."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from . import __version__, config, tools
from .corpus import Backends, Corpus, Settings
from .operators import corpus as operators
from .session import build_session
from .sources import discover


def opened(conf: config.Config, backends: Backends | None = None) -> Corpus:
    own = Settings(
        excludes=conf.excludes, secret_patterns=conf.secret_patterns, most_bytes=conf.max_file_bytes, use_ignore_files=conf.use_gitignore, follow_links=conf.follow_symlinks,
        system_prompt=conf.system_prompt, context_chars=conf.max_context_chars,
    )
    state = conf.state if "://" in conf.state else f"file://{Path(conf.root, conf.state).resolve()}"
    return Corpus(build_session("textloom-cli"), conf.root, state, backends, own)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    p.add_argument("--config", default="textloom.yaml")
    p.add_argument("--dotenv", default=".env")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("up", "reindex", "status", "version"):
        sub.add_parser(name)
    sub.add_parser("config").add_argument("action", choices=("init", "print"))
    ask = sub.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--k", type=int)
    ask.add_argument("--mode", default="answer")
    ask.add_argument("--index", default="auto")
    ask.add_argument("--path-prefix", default="")
    ask.add_argument("--file-glob", default="")
    ask.add_argument("--doc-types", default="")
    return p


def shown(own: Corpus, out: dict) -> str:
    lines = [out["answer"]] if out["answer"] else []
    for n, hit in enumerate(out["hits"], 1):
        span = hit["span"]
        wide = F.struct(*(F.lit(span.get(f)).alias(f) for f in ("kind", "start_line", "end_line", "page", "start_ms", "end_ms")))
        place = own.spark.range(1).select(operators.printed_span(wide)).first()[0]
        lines.append(f"[{n}] {hit['rel_path']} ({place}) score={hit['score']:.4f}")
    return "\n".join(lines)


def main(argv: list[str] | None = None, backends: Backends | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    conf = config.load(args.config, args.dotenv)
    if args.command == "config":
        if args.action == "print":
            print(config.snapshot(conf, config.sources(args.config, args.dotenv)))
        elif Path(args.config).exists():
            print(f"{args.config} is there already", file=sys.stderr)
            return 1
        else:
            Path(args.config).write_text("root: .\nstate: .textloom\nexcludes:\n  - '**/dist/**'\n", encoding="utf-8")
        return 0
    own = opened(conf, backends)
    if args.command in ("up", "reindex"):
        state = discover.mounted(own.store.folder)
        if state:
            config.save_snapshot(conf, config.sources(args.config, args.dotenv), state)
        own.emit("scan_started", command=args.command)
        try:
            own.scan(force=args.command == "reindex")
            own.embed()
        except Exception as e:
            own.emit("scan_failed", "error", command=args.command, error=str(e))
            raise
        own.emit("scan_done", command=args.command, **own.document_stats())
    if args.command == "ask":
        given = {"question": args.question, "mode": args.mode, "k": args.k or conf.k, "index": args.index, "path_prefix": args.path_prefix, "file_glob": args.file_glob}
        types = [t.strip() for t in args.doc_types.split(",") if t.strip()]
        out = tools.call(own, "ask", given | ({"doc_types": types} if types else {}))
        print(json.dumps(out) if args.json or "error" in out else shown(own, out))
        return int("error" in out)
    print(json.dumps(tools.call(own, "stats")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
