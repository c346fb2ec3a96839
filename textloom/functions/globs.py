"""Three dialects of globs, compiled on the driver into one regular expression each.

* ``path_match``: one path segment a star; ``?``, classes and backslash escapes. A bad pattern matches nothing.
* ``segments``: path_match in each segment, ``**`` for any number of segments; excludes of a scan.
* ``retrieval``: ``**`` for anything, no classes; excludes of a search.
* ``store``: a star crosses slashes, ``?`` is one character, classes; listings.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths that a search never returns and a scan never takes, besides the library's own folder.
STATE_FOLDER = ".textloom"
NEVER_SEARCHED = ("**/.git/**", "**/node_modules/**", f"**/{STATE_FOLDER}/**", "**/.env", "**/*.pem", "**/*.key", "**/id_rsa")
NEVER_SCANNED = (*NEVER_SEARCHED, "**/vendor/**", "**/__pycache__/**")
NOTHING = r"(?!)"


class BadPattern(ValueError):
    pass


def _literal(c: str) -> str:
    return re.escape(c) if not c.isalnum() else c


def _bracket(glob: str, at: int) -> tuple[str, int]:
    """The class that opens at ``at``, as a regular expression that doesn't match a slash, and where it ends."""
    i, body, negated = at + 1, [], False
    if i < len(glob) and glob[i] == "^":
        negated, i = True, i + 1

    def one() -> str:
        nonlocal i
        if i < len(glob) and glob[i] == "\\":
            i += 1
        elif i < len(glob) and glob[i] in "-]":
            raise BadPattern(glob)
        if i >= len(glob):
            raise BadPattern(glob)
        i += 1
        return glob[i - 1]

    while True:
        if i < len(glob) and glob[i] == "]" and body:
            break
        low = high = one()
        if i < len(glob) and glob[i] == "-":
            i += 1
            high = one()
        if low <= high:
            body.append(re.escape(low) if low == high else f"{re.escape(low)}-{re.escape(high)}")
        else:
            body.append("")
    chars = "".join(body)
    if not chars:
        return ("[^/]" if negated else NOTHING), i + 1
    return f"(?!/)[{'^' if negated else ''}{chars}]", i + 1


def path_match_body(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "[":
            text, i = _bracket(glob, i)
            out.append(text)
            continue
        if c == "\\":
            i += 1
            if i >= len(glob):
                raise BadPattern(glob)
            out.append(_literal(glob[i]))
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or _literal(c))
        i += 1
    return "".join(out)


def whole(body: str) -> str:
    return rf"(?s)\A(?:{body})\z"


def path_match(glob: str) -> str:
    try:
        return whole(path_match_body(glob))
    except BadPattern:
        return NOTHING


def segments_body(glob: str) -> str:
    glob = _clean(glob)
    if not glob:
        return NOTHING
    if glob.endswith("/"):
        glob += "**"
    parts = glob.split("/")
    out, need_slash = [], False
    for n, part in enumerate(parts):
        if part == "**":
            if n and parts[n - 1] == "**":
                continue
            last = all(p == "**" for p in parts[n:])
            if last:
                out.append("(?:/.*)?" if need_slash else ".*")
                return "".join(out)
            out.append("(?:/[^/]*)*" if need_slash else "(?:[^/]*/)*")
            continue
        try:
            body = path_match_body(part)
        except BadPattern:
            return NOTHING
        out.append(("/" if need_slash else "") + body)
        need_slash = True
    return "".join(out)


def _clean(path: str) -> str:
    path = path.strip().replace("\\", "/")
    while path.startswith("./"):
        path = path[2:]
    return path.lstrip("/")


def segments(glob: str) -> str:
    return whole(segments_body(glob))


def retrieval(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or _literal(glob[i]))
            i += 1
    return rf"\A{''.join(out)}\z"


def store(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c, end = glob[i], -1
        if c == "[":
            start = i + 1 + (glob[i + 1 : i + 2] == "^")
            end = glob.find("]", start + 1)
            if end < 0:
                return NOTHING
            body = glob[start:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^").replace("]", "\\]")
            out.append(f"[{'^' if start > i + 1 else ''}{body}]")
            i = end + 1
            continue
        out.append({"*": ".*", "?": "."}.get(c) or _literal(c))
        i += 1
    return whole("".join(out))


def any_of(path: Column, globs: Iterable[str], compiler=segments) -> Column:
    """Whether a path matches any of the globs: one alternation, no join."""
    return F.coalesce(path, F.lit("")).rlike("|".join(f"(?:{compiler(g)})" for g in globs) or NOTHING)


def escape_literal(path: str) -> str:
    """A glob that matches this path alone."""
    return re.sub(r"([\\*?\[\]])", r"\\\1", path)


def store_prefix(path: Column, prefix: str) -> Column:
    """A prefix of listings: ASCII case doesn't matter, ``_`` and ``%`` are themselves, a trailing slash is dropped."""
    p = prefix.strip()
    p = p[2:] if p.startswith("./") else p
    p = "/".join(x for x in p.split("/") if x not in ("", "."))
    return F.lower(path).startswith(p.lower()) if p else F.lit(True)


def search_prefix(path: Column, prefix: str) -> Column:
    return path.startswith(prefix) if prefix else F.lit(True)


def hidden(path: Column) -> Column:
    """Whether the first segment starts with a dot."""
    return F.get(F.split(path, "/"), F.lit(0)).startswith(".")


def clean_path(path: Column) -> Column:
    """A relative path in its shortest form, null if it is empty, absolute or leaves its root."""
    p = F.trim(F.coalesce(path, F.lit("")))
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("at"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        ok = acc["ok"] & ~(up & (F.size(acc["at"]) == 0))
        shorter = F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0)))
        return F.struct(ok.alias("ok"), F.when(up, shorter).otherwise(F.concat(acc["at"], F.array(part))).alias("at"))

    found = F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["at"], "/")))
    return F.when(~p.startswith("/"), F.when(found != "", found))


# ignore files


def ignore_rules(text: str, folder: str = "") -> list[dict]:
    """The rules of one ignore file, which hold below its folder."""
    rules = []
    for line in re.split(r"\r\n|\r|\n", text):
        line = line.strip()
        negated = line.startswith("!")
        line = line[1:].strip() if negated else line
        if not line or (line.startswith("#") and not negated):
            continue
        only_folders = line.endswith("/")
        line = line[:-1] if only_folders else line
        if line:
            rules.append({"folder": folder.strip("/"), "glob": line.lstrip("/"), "anchored": "/" in line, "negated": negated, "only_folders": only_folders})
    return rules


def rule_regex(rule: dict) -> str:
    """The paths, from the root, that a rule names."""
    bodies = [segments_body(rule["glob"])]
    if not rule["anchored"]:
        bodies = [segments_body("**/" + rule["glob"])]
    base = re.escape(rule["folder"]) + "/" if rule["folder"] else ""
    return whole(base + "(?:" + "|".join(bodies) + ")")


def ignored(path: Column, rules: list[dict], is_folder: Column | bool = False) -> Column:
    """The last rule that names the path decides."""
    folder = F.lit(is_folder) if isinstance(is_folder, bool) else is_folder
    return reduce(
        lambda acc, r: F.when(path.rlike(rule_regex(r)) & (folder | F.lit(not r["only_folders"])), F.lit(not r["negated"])).otherwise(acc), rules, F.lit(False)
    )


# many patterns at a time


def anchor(glob: str) -> tuple[str, str]:
    """What every path that a glob matches has in common, as (kind, value): the path itself, else the folders that it begins with,
    else how its last segment ends, else nothing."""
    if glob != _clean(glob):  # dialects differ in what they make of it
        return "any", ""
    literal = re.match(r"[^*?\[]*", glob)[0]
    if literal == glob and not glob.endswith("/"):
        return "path", glob
    if "/" in literal:
        return "folder", literal[: literal.rindex("/")]
    ending = re.search(r"\.([A-Za-z0-9_]+)\Z", glob.rsplit("/", 1)[-1])
    return ("ending", ending[1]) if ending else ("any", "")


def anchors(path: Column) -> Column:
    """Every (kind, value) that an anchor of a glob can have in common with a path, but the path itself."""
    parts = F.split(path, "/")
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: pair("folder", F.array_join(F.slice(parts, F.lit(1), n), "/")))
    folders = F.when(F.size(parts) > 1, folders).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    ending = F.regexp_extract(F.element_at(parts, -1), r"\.([A-Za-z0-9_]+)\z", 1)
    return F.concat(folders, F.array(pair("ending", ending), pair("any", F.lit(""))))
