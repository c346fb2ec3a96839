"""Secret scans."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Patterns of secrets.
PATTERNS = (
    r"AKIA[0-9A-Z]{16}",
    r"(?i)(?:aws(?:[_\s.]{0,20})?secret(?:[_\s.]*(?:access[_\s.]*)?key)?|secret[_\s.]*access[_\s.]*key)\s*[:=]\s*[0-9A-Za-z/+=]{20,}",
    r"(?i)(?:authorization\s*[:=]\s*bearer\s+|(?:access|id|refresh)_token\s*[:=]\s*)[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"(?i)token\s*[:=]\s*[A-Za-z0-9_.-]{20,}",
    r"sk_[a-z0-9]{32}|api_[A-Za-z0-9]{32}",
)
#: Of each of these patterns the words of which a match has one at least, in any case.
SIGNS = dict(zip(PATTERNS, (("akia",), ("secret",), ("authorization", "_token"), ("token",), ("sk_", "api_"))))
#: A scan looks at so many bytes of a file; an opened file is looked at whole.
SAMPLE_BYTES = 64 * 1024


def has_secret(text: Column, patterns: Iterable[str] = PATTERNS) -> Column:
    """A pattern whose words are known is matched only where the text has one of them, which is told faster."""
    patterns = [p.strip() for p in patterns if p.strip()]

    def told(both: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            found = both["text"].rlike(p)
            if p in SIGNS:
                found = reduce(Column.__or__, (F.contains(both["lower"], F.lit(sign)) for sign in SIGNS[p])) & found
            out = out | found
        return out

    return T.let(text, lambda t: T.let(F.struct(t.alias("text"), F.lower(t).alias("lower")), told))


def sample_has_secret(text: Column, patterns: Iterable[str] = PATTERNS) -> Column:
    """Looks at the first bytes of the content, invalid bytes at the cut replaced."""
    sample = F.substring(text.cast("binary"), F.lit(1), F.lit(SAMPLE_BYTES))
    return has_secret(F.make_valid_utf8(sample.cast("string")), patterns)
