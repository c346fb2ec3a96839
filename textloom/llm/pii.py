"""Personal data by weak supervision; DataFrame functions only.

Patterns propose spans of each kind. Three labelers vote on every proposed span with 1, -1 or nothing: a format labeler (is
the span well formed beyond its pattern), a gazetteer labeler (known top-level domains, calling codes, card and country
prefixes) and a context labeler (words before the span). Expectation-maximisation over the votes estimates how reliable each
labeler is and how likely each span is personal data; a logistic classifier over the votes and the shape of the span is
trained on those likelihoods and decides about the kinds that the method adds. Kinds of the base stay whatever it decides.

Estimation sees only the counts of vote and shape patterns, at most ``kinds * 27 * 4 * 3`` rows however large the corpus, so
it is plain arithmetic on the driver. The texts are read once; the proposed spans are written to the shared folder.

Spans are in code points, end exclusive, leftmost and non-overlapping within a kind. Defined cases: a null or empty text has
no spans. Repeated rows get a row each; other columns of the input aren't read. An empty table gives no rows. The patterns
are possessive where that is equal, so long runs cost linear time and no stack.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, marks, written

PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Top-level domains, calling codes and country codes of bank accounts that the gazetteer labeler knows.
DOMAINS = "com org net edu gov info io eu de fr es uk us it nl ch at be"
CALLING = "1 7 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 81 82 86 90 91 351 352 353 358"
COUNTRIES = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE"


@dataclass(frozen=True)
class Kind:
    """must: a literal that every match has. valid: drops matches. form, known: the votes of the format and gazetteer labelers."""

    name: str
    pattern: str
    must: str
    valid: Callable[[Column], Column]
    form: Callable[[Column], Column]
    known: Callable[[Column], Column]
    context: str
    against: str = r"(?i)\b(version|release|isbn|page|line|build|order)\W*$"
    base: bool = True


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether 13 to 19 digits pass the check."""

    def passes(d: Column) -> Column:
        value = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")  # noqa: E731  the i-th from the right
        doubled = lambda i: F.when(i % 2 == 0, value(i)).otherwise(2 * value(i) - F.when(value(i) > 4, 9).otherwise(0))
        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0

    return let(digits(m), lambda d: F.when(F.length(d).between(13, 19), passes(d)).otherwise(F.lit(False)))


def vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out if no is None else out.when(no, F.lit(-1))).otherwise(F.lit(0))


def one_of(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


KINDS = (
    Kind(
        "email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True),
        lambda m: vote(m.rlike(r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$"), ~m.rlike(r"\.[A-Za-z]{2,}$")), lambda m: vote(m.rlike(rf"\.{one_of(DOMAINS)}$")),
        r"(?i)\b(e-?mail|contact|write|address|from|to)\W*$",
    ),
    Kind(
        "ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        lambda m: vote(~m.rlike(r"(^|\.)0[0-9]"), m.rlike(r"(^|\.)0[0-9]")), lambda m: vote(m.rlike(r"^(10|172|192)\."), m.rlike(r"^(0|255)\.")),
        r"(?i)\b(ip|host|server|addr|address|from|client)\W*$",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", "", luhn,
        lambda m: vote(digits(m).rlike(r"^[0-9]{15,16}$"), m.rlike(r"--|  ")), lambda m: vote(m.rlike(r"^(4|5[1-5]|3[47]|6011|65|2[2-7])"), m.rlike("^0")),
        r"(?i)\b(card|visa|credit|payment|amex|mastercard)\W*$",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(digits(m)).between(9, 15),
        lambda m: vote(m.rlike(r"^\+[0-9]{1,3}[ (.-]"), m.rlike(r"[.() -]{4}")), lambda m: vote(digits(m).rlike(f"^{one_of(CALLING)}"), m.rlike(r"^\+0")),
        r"(?i)\b(tel|phone|call|mobile|fax|telefon|t[ée]l[ée]phone)\W*$",
    ),
    Kind(
        "secret", r"(?i)\b(?:token|secret|passwd|password|api[_-]?key)\s{0,4}[=:]\s{0,4}[\x22\x27]?[0-9a-z_-]{16,}+", "", lambda m: F.lit(True),
        lambda m: vote(m.rlike(r"[0-9a-fA-F]{16,}$"), ~m.rlike("[0-9]")), lambda m: vote(m.rlike(r"(?i)^(token|api|secret)")), r"[\n;{(]\s*$", base=False,
    ),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", lambda m: F.lit(True),
        lambda m: vote(~m.rlike("^(000|666|9)|-00-|-0000$"), m.rlike("^(000|666|9)|-00-|-0000$")), lambda m: F.lit(0), r"(?i)\b(ssn|social security)\b.{0,12}$", base=False,
    ),
    Kind(
        "iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?\b", "", lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34),
        lambda m: vote(m.rlike("[0-9]{8}"), ~m.rlike("[0-9]{4}")), lambda m: vote(m.rlike(f"^{one_of(COUNTRIES)}"), ~m.rlike(f"^{one_of(COUNTRIES)}")), r"(?i)\b(iban|account|konto|bank)\W*$", base=False,
    ),
)

#: Characters before a span that the context labeler reads; the gap to the last match of the kind bounds them too.
CONTEXT, CHUNK = 48, 256
SPAN = "struct<kind: int, start: bigint, end: bigint, form: int, known: int, context: int, size: int, edge: int>"


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What an array<long> comes to up to each place, in chunks: an array grows by one element at a time only within a chunk."""
    none = F.expr("named_struct('last', cast(null as bigint), 'all', cast(array() as array<bigint>))")

    def along(chunk: Column) -> Column:
        def grow(acc: Column, x: Column) -> Column:
            now = F.when(acc["last"].isNull(), x).otherwise(combine(acc["last"], x))
            return F.struct(now.alias("last"), F.concat(acc["all"], F.array(now)).alias("all"))

        return F.aggregate(chunk, none, grow, lambda acc: acc["all"])

    cut = let(values, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: along(F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))))

    def whole(inner: Column) -> Column:
        ends = along(F.transform(inner, lambda x: F.element_at(x, -1)))
        return F.flatten(let(ends, lambda e: F.transform(inner, lambda x, i: F.transform(x, lambda s: F.when(i == 0, s).otherwise(combine(F.get(e, i - 1), s))))))

    return let(cut, whole)


def spans_of(text: Column, kind: int) -> Column:
    """array<SPAN> of one kind."""
    k = KINDS[kind]
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def votes(m: Column, before: Column, after: Column, end: Column) -> Column:
        context = F.substring(before, F.greatest(F.length(before) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT))
        size = F.floor(F.least(F.length(m), F.lit(40)) / 12).cast("int")  # 0 to 3
        edge = F.when(before.rlike(r"[0-9A-Za-z]$") | after.rlike("^[0-9A-Za-z]"), 2).when(before.rlike(r"\s$|^$"), 0).otherwise(1)
        fields = (F.lit(kind), end - F.length(m), end, k.form(m), k.known(m), vote(context.rlike(k.context), context.rlike(k.against)), size, edge)
        names = ("kind", "start", "end", "form", "known", "context", "size", "edge")
        return F.struct(*(f.alias(n) for f, n in zip(fields, names))).cast(SPAN)

    def located(found: Column) -> Column:
        widths = F.zip_with(found["gaps"], found["all"], lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
        rows = lambda ends: F.transform(
            found["all"], lambda m, i: F.struct(m.alias("m"), F.get(found["gaps"], i).alias("before"), F.get(found["gaps"], i + 1).alias("after"), F.get(ends, i).alias("end"))
        )
        ok = let(running(widths, lambda a, b: a + b), rows)
        return F.transform(F.filter(ok, lambda r: k.valid(r["m"])), lambda r: votes(r["m"], r["before"], r["after"], r["end"]))

    pattern = F.lit(k.pattern)
    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"), F.split(text, k.pattern, -1).alias("gaps"))
    here = (F.contains(text, F.lit(k.must)) if k.must else F.lit(True)) & text.rlike(k.pattern)
    return F.when(here, let(found, located)).otherwise(none)


def propose(docs: DataFrame) -> DataFrame:
    """doc_id, spans: everything that the patterns propose, with its votes and shape."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.concat(*(spans_of(text, k) for k in range(len(KINDS)))).alias("spans"))


FEATURES = (("kind", len(KINDS), 0), ("form", 3, 1), ("known", 3, 1), ("context", 3, 1), ("size", 4, 0), ("edge", 3, 0))


@dataclass(frozen=True)
class Judge:
    """bias and, by feature and value, the weights of the span classifier; reliability: how often a labeler's votes are right."""

    bias: float
    weights: dict[str, list[float]]
    reliability: dict[str, float]


def train(patterns: list[tuple[dict[str, int], int]], rounds: int = 50) -> Judge:
    """From counted patterns: expectation-maximisation over the votes, then the classifier on the likelihoods."""
    labelers = ("form", "known", "context")
    # how often a vote is right; a labeler that doesn't vote tells nothing
    reliability = dict.fromkeys(labelers, 0.8)
    prior = [0.7] * len(KINDS)
    likely = [0.5] * len(patterns)
    for _ in range(rounds):
        for n, (p, _) in enumerate(patterns):
            yes, no = prior[p["kind"]], 1 - prior[p["kind"]]
            for name in labelers:
                if p[name]:
                    right, wrong = reliability[name], 1 - reliability[name]
                    yes, no = yes * (right if p[name] > 0 else wrong), no * (wrong if p[name] > 0 else right)
            likely[n] = yes / (yes + no)
        for name in labelers:
            voted = [(c, y if p[name] > 0 else 1 - y) for (p, c), y in zip(patterns, likely) if p[name]]
            reliability[name] = min(0.99, max(0.55, (8 + sum(c * y for c, y in voted)) / (10 + sum(c for c, _ in voted))))
        for kind in range(len(KINDS)):
            own = [(c, y) for (p, c), y in zip(patterns, likely) if p["kind"] == kind]
            prior[kind] = min(0.95, max(0.05, (14 + sum(c * y for c, y in own)) / (20 + sum(c for c, _ in own))))
    bias, weights = 0.0, {name: [0.0] * size for name, size, _ in FEATURES}
    total = sum(c for _, c in patterns) or 1
    for step in range(400):
        slope, slopes = 0.0, {name: [0.0] * size for name, size, _ in FEATURES}
        for (p, c), y in zip(patterns, likely):
            z = bias + sum(weights[name][p[name] + shift] for name, _, shift in FEATURES)
            g = (1 / (1 + math.exp(-z)) - y) * c / total
            slope += g
            for name, _, shift in FEATURES:
                slopes[name][p[name] + shift] += g
        rate = 4.0 / (1 + step / 100)
        bias -= rate * slope
        for name, size, _ in FEATURES:
            for i in range(size):
                weights[name][i] -= rate * (slopes[name][i] + 1e-4 * weights[name][i])
    return Judge(bias, weights, reliability)


def learn(proposed: DataFrame) -> Judge:
    names = [name for name, _, _ in FEATURES]
    rows = proposed.select(F.explode("spans").alias("s")).groupBy(*(F.col(f"s.{n}").alias(n) for n in names)).count().collect()
    return train(sorted(((({n: r[n] for n in names}), r["count"]) for r in rows), key=lambda x: sorted(x[0].items())))


def accepted(spans: Column, judge: Judge) -> Column:
    """The spans of the base and those that the classifier takes."""
    table = {name: F.array(*map(F.lit, judge.weights[name])) for name, _, _ in FEATURES}
    z = lambda s: reduce(Column.__add__, [F.get(table[name], s[name] + shift) for name, _, shift in FEATURES]) + judge.bias
    return F.filter(spans, lambda s: s["kind"].isin([i for i, k in enumerate(KINDS) if k.base]) | (z(s) > 0))


def spelled(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    proposed = written(propose(docs), "proposed-spans")
    found = proposed.select("doc_id", accepted(F.col("spans"), learn(proposed)).alias("spans"))
    of = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == [k.name for k in KINDS].index(name))).cast("long").alias(f"n_{name}")
    base = F.filter("spans", lambda s: s["kind"].isin([i for i, k in enumerate(KINDS) if k.base]))
    return found.select("doc_id", *(of(k.name) for k in KINDS if k.base), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by the kind of its first span in angle brackets.

    The text is cut into chunks once, and what stays is put together from these, so the time is that of the text.
    """
    names = F.array(*(F.lit(f"<{k.name.upper()}>") for k in KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def part(chunks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
        own = F.array_join(F.slice(chunks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.when(b > a, F.substring(own, (a - first * CHUNK + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

    def replaced(s: Column, ends: Column, chunks: Column) -> Column:
        until = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0).cast("long"))  # noqa: E731  where the spans before i end
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: until(i) <= F.get(s, i)["start"])
        pieces = F.transform(first, lambda i: F.concat(part(chunks, until(i), F.get(s, i)["start"]), F.get(names, F.get(s, i)["kind"])))
        return F.concat(F.array_join(pieces, ""), part(chunks, F.element_at(ends, -1), F.length(text).cast("long")))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    made = let(order, lambda s: let(running(s["end"], F.greatest), lambda ends: let(cut, lambda chunks: replaced(s, ends, chunks))))
    return F.when(F.size(spans) > 0, made).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in their texts, and n_chars (if there) of what is left.

    One pass proposes spans and writes them; masking looks only at texts whose hash is marked as having some.
    """
    spans_in = lambda text: F.concat(*(spans_of(F.coalesce(text, F.lit("")), k) for k in range(len(KINDS))))
    proposed = docs.select(F.xxhash64("text").alias("key"), spans_in(F.col("text")).alias("spans")).filter(F.size("spans") > 0)
    proposed = written(proposed, "proposed-spans")
    judge, several = learn(proposed), marks(proposed, "key")
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.xxhash64("text").alias("key"))
    found = several.maybe(rows, "key").select("row", accepted(spans_in(F.col("row.text")), judge).alias("spans"))
    clean = found.select("row", masked(F.col("row.text"), F.col("spans")).alias("clean"))
    clean = clean.union(several.surely_not(rows, "key").select("row", F.col("row.text").alias("clean")))
    new = {"text": F.col("clean"), "n_chars": F.length("clean")}
    return clean.select(*((new[f.name].cast(f.dataType) if f.name in new else F.col("row")[f.name]).alias(f.name) for f in docs.schema))
