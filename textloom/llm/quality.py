"""Quality rules as a ledger of bits.

Every rule is measured once for every document. The ledger holds the measurements and one long whose bit ``i`` says that
rule ``i`` failed. A policy is a named, versioned set of rule bits; applying one is a bitwise AND, so policies are changed,
compared and ablated on the ledger without reading the texts again.

Defined cases: a null or empty text has no words, fails the rules on length and is rejected. Measurements of texts without
words are 0. Repeated rows get a row each. Columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The characters that count as symbols, and the ASCII white space that parts words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    duplicate = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            often = {w for w, c in Counter(windows).items() if c > 1}
            end = 0  # words before it are counted
            for i, w in enumerate(windows):
                if w in often:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return (n, word_chars, symbols, len(lines), duplicate, repeated)


LONGS = ", ".join(f"{m} long" for m in MEASURES)


def measured(texts: pa.Array) -> list[pa.Array]:
    columns = list(zip(*map(measure_text, texts.to_pylist()))) or [()] * len(MEASURES)
    return [pa.array(c, pa.int64()) for c in columns]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measurements for each document; one pass over the texts, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *measured(batch.column(1))], ["doc_id", *MEASURES])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, {LONGS}")


def measure_beside(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The measurements, and the whole row beside them."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *measured(batch.column(0).field(text_col))], ["row", *MEASURES])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {LONGS}")


@dataclass(frozen=True)
class Rule:
    """``failed`` takes the measurements by name, as columns or as numbers."""

    bit: int
    name: str
    failed: Callable[[Mapping[str, Any]], Any]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...] = field(default_factory=tuple)


#: Bits are never given anew; new rules get new bits.
RULES = (
    Rule(0, "too_few_words", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule(2, "symbol_heavy", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule(3, "duplicate_lines", lambda m: (m["n_lines"] >= 4) & (10 * m["n_dup_lines"] > 5 * m["n_lines"])),
    Rule(4, "long_words", lambda m: m["word_chars"] > 30 * m["n_words"]),
    Rule(5, "short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
)

BASE = Policy("base", 1, ("too_few_words", "repeated_words"))
POLICIES = (BASE, Policy("strict", 1, tuple(r.name for r in RULES)), Policy("production", 1, tuple(r.name for r in RULES if r.name != "short_words")))
PRODUCTION = POLICIES[2]


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return reduce(int.__or__, (bits[name] for name in policy.rules), 0)


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """The bits of the rules that the measurements fail."""
    return reduce(Column.bitwiseOR, [F.when(r.failed({m: F.col(m) for m in MEASURES}), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: every rule evaluated once."""
    return measure(docs, id_col, text_col).withColumn("fail_bits", fail_bits(rules))


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules))) == 0


def apply_policies(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """A boolean column ``<name>_v<version>`` for each policy."""
    return book.select("*", *(passes(p).alias(f"{p.name}_v{p.version}") for p in policies))


def ablation(book: DataFrame, policy: Policy = PRODUCTION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents failing it, failing only it, and what would be kept without it.

    The ledger is first counted by its bits (at most 2 to the number of rules rows, combined before the shuffle).
    """
    whole = mask(policy, rules)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    chosen = [r for r in rules if r.name in policy.rules]
    listed = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen)))
    row = patterns.select("bits", "n", listed.alias("r")).select("bits", "n", "r.rule", "r.bit")
    sum_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return row.groupBy("rule").agg(
        sum_if(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        sum_if(F.col("bits") == F.col("bit")).alias("n_only"),
        sum_if((F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))) == 0).alias("n_kept_without"),
    )


def apply(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The digest: measurements, the base verdict, the verdict of the policy and the bits."""
    book = ledger(docs)
    base = ~passes(BASE)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(policy)).alias("kept"))


def keep(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The rows whose ledger passes the base and the policy; the ledger is made beside the rows, so nothing is joined."""
    book = measure_beside(docs).withColumn("fail_bits", fail_bits())
    return book.filter(passes(BASE) & passes(policy)).select("row.*")
