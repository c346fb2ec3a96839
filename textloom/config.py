"""Configuration of a corpus: a small YAML file, a dotenv file, the environment; the environment wins."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path
from typing import Any

PREFIX = "TEXTLOOM_"
SECRET = ("api_key", "token")


@dataclass(frozen=True)
class Config:
    root: str = "."
    state: str = ".textloom"
    excludes: tuple[str, ...] = ()
    secret_patterns: tuple[str, ...] = ()
    max_file_bytes: int = 10 * 1024 * 1024
    use_gitignore: bool = True
    follow_symlinks: bool = False
    system_prompt: str = ""
    max_context_chars: int = 20000
    k: int = 10
    allowed_origins: tuple[str, ...] = ()
    trusted_proxies: tuple[str, ...] = ()
    api_key: str = ""


def scalar(text: str) -> Any:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    known = {"true": True, "false": False, "null": None, "~": None, "": None}
    if text.lower() in known:
        return known[text.lower()]
    try:
        return int(text)
    except ValueError:
        return text


def parse_yaml(raw: str) -> dict[str, Any]:
    """Keys with scalars, inline lists and lists of dashes; anything else is an error that names its line."""
    out: dict[str, Any] = {}
    open_list: str | None = None
    for n, line in enumerate(raw.splitlines(), 1):
        text = line.split(" #", 1)[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not text.strip():
            continue
        if text.lstrip().startswith("- "):
            if open_list is None:
                raise ValueError(f"line {n}: an item without a list")
            out[open_list] = [*(out[open_list] or []), scalar(text.lstrip()[2:])]
            continue
        key, colon, value = text.partition(":")
        if not colon or text[0].isspace():
            raise ValueError(f"line {n}: expected key: value")
        open_list, out[key.strip()] = key.strip(), scalar(value)
    return out


def parse_dotenv(raw: str) -> dict[str, str]:
    out = {}
    for line in raw.splitlines():
        line = line.strip().removeprefix("export ")
        key, equals, value = line.partition("=")
        if equals and key.strip() and not line.startswith("#"):
            out[key.strip()] = str(scalar(value) if value.strip()[:1] in "'\"" else value.split(" #", 1)[0].strip())
    return out


def merged(*lists: Any) -> tuple[str, ...]:
    """Distinct values in their first order; texts are parted by commas."""
    flat = [x.strip() for xs in lists for x in (xs.split(",") if isinstance(xs, str) else xs or ())]
    return tuple(dict.fromkeys(x for x in flat if x))


def _typed(default: Any, value: Any) -> Any:
    if isinstance(default, tuple):
        return merged(value)
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    return int(value) if isinstance(default, int) else "" if value is None else str(value)


def load(path: str | None = None, dotenv: str | None = None, env: Mapping[str, str] | None = None) -> Config:
    """File, then dotenv, then environment; lists of origins and proxies add up, all else is replaced."""
    out = Config()
    names = {f.name: getattr(out, f.name) for f in fields(Config)}
    if path and Path(path).is_file():
        given = parse_yaml(Path(path).read_text(encoding="utf-8"))
        unknown = sorted(set(given) - set(names))
        if unknown:
            raise ValueError(f"unknown setting: {', '.join(unknown)}")
        out = replace(out, **{k: _typed(names[k], v) for k, v in given.items()})
    layers = [parse_dotenv(Path(dotenv).read_text(encoding="utf-8"))] if dotenv and Path(dotenv).is_file() else []
    for layer in (*layers, os.environ if env is None else env):
        for name, default in names.items():
            value = layer.get(PREFIX + name.upper())
            if value is not None:
                more = name in ("allowed_origins", "trusted_proxies")
                out = replace(out, **{name: merged(getattr(out, name), value) if more else _typed(default, value)})
    return out


def sources(path: str | None = None, dotenv: str | None = None, env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Where each secret comes from, of the layers of load() the last that sets it: file, dotenv, or the variable's name."""
    found = dict.fromkeys((f.name for f in fields(Config) if f.name in SECRET), "unset")
    if path and Path(path).is_file():
        found |= {k: "file" for k, v in parse_yaml(Path(path).read_text(encoding="utf-8")).items() if k in found and v}
    if dotenv and Path(dotenv).is_file():
        given = parse_dotenv(Path(dotenv).read_text(encoding="utf-8"))
        found |= {k: "dotenv" for k in found if given.get(PREFIX + k.upper())}
    given = os.environ if env is None else env
    return found | {k: f"env:{PREFIX}{k.upper()}" for k in found if given.get(PREFIX + k.upper())}


def snapshot(config: Config, secrets: Mapping[str, str] | None = None) -> str:
    """The effective settings as JSON; of secrets only where they come from (see sources), or whether they are set."""
    shown = lambda name, value: (secrets or {}).get(name) or ("set" if value else "unset")
    return json.dumps({k: (shown(k, v) if k in SECRET else v) for k, v in asdict(config).items()}, indent=2, sort_keys=True)


def save_snapshot(config: Config, secrets: Mapping[str, str], folder: str) -> str:
    """The snapshot as a file that its owner alone can read; its path."""
    path = Path(folder, "config.snapshot.json")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.touch(0o600)
    path.chmod(0o600)
    path.write_text(snapshot(config, secrets) + "\n", encoding="utf-8")
    return str(path)
