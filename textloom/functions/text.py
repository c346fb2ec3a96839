"""Text expressions that count in code points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: Unicode white space, as a character class.
SPACE = r"[\t\n\x0B\f\r \u0085   -     　]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once; an expression that a lambda names is else computed again wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), rf"{SPACE}+\z", "")


def blank(c: Column) -> Column:
    return trim(F.coalesce(c, F.lit(""))) == ""


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def head(c: Column, n: Column | int) -> Column:
    return F.substring(c, F.lit(1), n if isinstance(n, Column) else F.lit(n))


#: Characters of a snippet.
SNIPPET = 240


def snippet(c: Column, most: int = SNIPPET) -> Column:
    """The first characters of the trimmed text."""
    return head(trim(c), most)


def truncate(c: Column, most: Column | int) -> Column:
    """At most so many characters, the last three of a cut text being dots if there is room for more than them."""
    n = F.lit(most) if isinstance(most, int) else most
    short = F.when(n <= 3, head(c, n)).otherwise(F.concat(head(c, n - 3), F.lit("...")))
    return F.when(n <= 0, "").when(F.length(c) <= n, c).otherwise(short)


def truncate_snippet(c: Column, most: int) -> Column:
    """The trimmed text, cut and followed by three dots if it is longer."""
    t = trim(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(trim(head(t, most)), F.lit("...")))


def truncate_flag(c: Column, most: int) -> Column:
    """struct(text, truncated)."""
    cut = (F.length(c) > most) & F.lit(most > 0)
    return F.struct(F.when(cut, head(c, most)).otherwise(c).alias("text"), cut.alias("truncated"))


def truncate_question(c: Column, most: int = 64) -> Column:
    q = trim(c)
    return F.when(q == "", "<empty>").when(F.length(q) <= most, q).otherwise(F.concat(head(q, most), F.lit("…")))


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def unify_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def salvage(raw: bytes) -> str:
    """Valid UTF-8 as it is; each run of bytes that belong to no character becomes one replacement character."""
    text = raw.decode("utf-8", "surrogateescape")
    out, bad = [], False
    for c in text:
        wrong = "\udc80" <= c <= "\udcff"
        if not wrong or not bad:
            out.append("�" if wrong else c)
        bad = wrong
    return "".join(out)


@F.pandas_udf(StringType())
def _salvaged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda b: None if b is None else salvage(bytes(b)))


def normalize(content: Column) -> Column:
    """Binary to text: valid input stays in the JVM, only the rest goes through Python; line ends become newlines."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(_salvaged(F.when(~F.is_valid_utf8(content.cast("string")), content)))
    return unify_newlines(text)


# slices of an opened file


def slice_lines(c: Column, first: Column | int, last: Column | int) -> Column:
    """Lines first to last from 1, clamped; a last line below the first means the first alone."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    a = F.greatest(first, F.lit(1))

    def part(lines: Column) -> Column:
        b = F.when(last <= 0, a).otherwise(F.greatest(a, F.least(last, F.size(lines))))
        return F.when(a > F.size(lines), "").otherwise(F.array_join(F.slice(lines, a, b - a + 1), "\n"))

    return let(F.split(c, "\n", -1), part)


def slice_page(c: Column, page: Column | int) -> Column:
    """A page of a text whose pages are parted by form feeds; null if there is none such."""
    page = F.greatest(F.lit(page) if isinstance(page, int) else page, F.lit(1))

    def part(pages: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(F.get(pages, page - 1), r"^\n+", ""), r"\n+\z", "")
        return F.when(F.size(pages) > 1, inner).when(page == 1, c)

    return let(F.split(c, "\f", -1), part)


#: Fixed value: a time at the start of a line.
TIME = r"(?d)^[\t\n\f\r ]*\[?(\d{1,2}):(\d{2})(?::(\d{2}))?\]?[\t\n\f\r ]*(.*)\z"


def time_ms(line: Column) -> Column:
    """Milliseconds of the time at the start of a line, without checking ranges; null without one."""
    a, b, c = (F.regexp_extract(line, TIME, i) for i in (1, 2, 3))
    n = lambda x: x.cast("long")
    seconds = F.when(c == "", n(a) * 60 + n(b)).otherwise(n(a) * 3600 + n(b) * 60 + n(F.when(c != "", c)))
    return F.when(line.rlike(TIME), seconds * 1000)


def slice_time(text: Column, start_ms: int, end_ms: int) -> Column:
    """The lines whose time is within the range (open at the end if it is 0); null if no line has a time."""
    timed = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(TIME))
    inside = lambda lines: F.filter(lines, lambda x: (time_ms(x) >= start_ms) & (F.lit(end_ms <= 0) | (time_ms(x) <= end_ms)))
    return let(timed, lambda lines: F.when(F.size(lines) > 0, F.array_join(inside(lines), "\n")))


def json_object_in(raw: Column) -> Column:
    """The text from the first opening to the last closing brace, if it parses as JSON."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def masked_id(c: Column) -> Column:
    """The first four bytes of the hash of a session id, in hex."""
    return head(sha256(c), 8)


def payment_key(signature: Column, params: Column) -> Column:
    return F.concat(signature, F.lit(":"), sha256(params))


def is_caip2(network: Column) -> Column:
    return network.rlike(r"^[a-z0-9]{1,32}:[A-Za-z0-9_-]{1,128}\z")


#: The signs of code in a query.
CODE_SIGNS = (r"\b(func|class|package|import|return|if|for|while|switch|case)\b", r"[(){}\[\];]", "```", "`", r"\.(js|ts|py|go|java|rb|cpp|c|cs|html|css|json|yaml|yml)\b")


def is_code_query(query: Column) -> Column:
    """Two or more signs of code: a keyword, a bracket, a fence, a backtick, a file name."""
    signs = [F.lower(query).rlike(s).cast("int") for s in CODE_SIGNS]
    return sum(signs[1:], signs[0]) >= 2
