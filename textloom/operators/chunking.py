"""Chunks of texts with the place that they come from, as closed forms over windows of characters and lines.

A window of ``most`` characters starts every ``most - overlap``; the last one reaches the end. Windows without anything but
white space are dropped, and short ones unless they reach the end; what is left is numbered from 0. Each row of the input
explodes into its own chunks: there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TEXT_WINDOW, CODE_WINDOW, TRANSCRIPT_WINDOW = (2500, 250, 200), (200, 30), (1200, 120, 80)


def starts(n: Column, most: int, step: int) -> Column:
    """Where windows over n things start."""
    count = F.greatest(F.lit(0), F.ceil((n - most) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), count), lambda i: i * step)


#: An array grows by one element at a time only within so many, so that running sums stay near linear.
RUN = 256


def sums_before(values: Column) -> Column:
    """For each value the sum of those before it, as longs: in runs of bounded length first, then over the runs."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
    grow = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all"))
    along = lambda run: F.aggregate(run, start, grow)
    starts_ = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(RUN))

    def over(runs: Column) -> Column:
        before = F.aggregate(runs, start, lambda acc, r: F.struct((acc["sum"] + r["sum"]).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all")), lambda acc: acc["all"])
        return T.let(before, lambda b: F.flatten(F.transform(runs, lambda r, i: F.transform(r["all"], lambda x: x + F.get(b, i)))))

    return T.let(values, lambda v: T.let(F.transform(starts_, lambda a: along(F.slice(v, a + 1, F.lit(RUN)))), over))


def char_windows(text: Column, most: int = TEXT_WINDOW[0], overlap: int = TEXT_WINDOW[1], least: int = TEXT_WINDOW[2]) -> Column:
    """array<struct<ordinal, text, start_line, end_line>>

    The text is cut once, into pieces as long as a step; a window is a piece and the beginning of the next one, so the work
    is linear in the text.
    """
    step, n = most - overlap, F.length(text)
    if overlap > step:
        raise ValueError("windows overlap by half at most")
    count = F.greatest(F.lit(0), F.ceil((n - most) / step).cast("int"))

    def windows(cut: Column) -> Column:
        pieces, before = cut["pieces"], cut["before"]
        raw = F.transform(
            F.sequence(F.lit(0), count),
            lambda i: F.struct(
                F.concat(F.get(pieces, i), F.coalesce(F.substring(F.get(pieces, i + 1), F.lit(1), F.lit(overlap)), F.lit(""))).alias("text"),
                (F.get(before, i) + 1).cast("int").alias("line"),
                (i == count).alias("ends"),
            ),
        )
        kept = F.filter(raw, lambda w: (T.trim(w["text"]) != "") & ((F.length(w["text"]) >= least) | w["ends"]))
        inner = lambda w: T.newlines(F.substring(w["text"], F.lit(1), F.length(w["text"]) - 1))
        return F.transform(kept, lambda w, i: F.struct(i.alias("ordinal"), w["text"].alias("text"), w["line"].alias("start_line"), (w["line"] + inner(w)).alias("end_line")))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    lined = T.let(pieces, lambda p: F.struct(p.alias("pieces"), sums_before(F.transform(p, T.newlines)).alias("before")))
    none = F.array().cast("array<struct<ordinal:int,text:string,start_line:int,end_line:int>>")
    return F.when(n > 0, T.let(lined, windows)).otherwise(none)


def line_windows(text: Column, most: int = CODE_WINDOW[0], overlap: int = CODE_WINDOW[1]) -> Column:
    """array<struct<ordinal, text, start_line, end_line>>"""

    def windows(lines: Column) -> Column:
        n = F.size(lines)
        raw = F.transform(
            starts(n, most, most - overlap),
            lambda s: F.struct(F.array_join(F.slice(lines, s + 1, F.lit(most)), "\n").alias("text"), (s + 1).alias("start_line"), F.least(s + most, n).alias("end_line")),
        )
        kept = F.filter(raw, lambda w: T.trim(w["text"]) != "")
        return F.transform(kept, lambda w, i: F.struct(i.alias("ordinal"), w["text"].alias("text"), w["start_line"].alias("start_line"), w["end_line"].alias("end_line")))

    return T.let(F.split(text, "\n", -1), windows)


def pages(text: Column) -> Column:
    """array<struct<ordinal, text, page>> of a text whose pages are parted by form feeds; blank pages are dropped, numbers stay."""
    raw = F.transform(F.split(text, "\f", -1), lambda p, i: F.struct(T.trim(p).alias("text"), (i + 1).alias("page")))
    return F.transform(F.filter(raw, lambda p: p["text"] != ""), lambda p, i: F.struct(i.alias("ordinal"), p["text"].alias("text"), p["page"].alias("page")))


#: A time in brackets, or bare and followed by white space, at the start of a line of a transcript.
BRACKETED = r"(?d)^\[(\d{1,2}):(\d{2})(?::(\d{2}))?\][\t\n\f\r ]*(.*)\z"
BARE = r"(?d)^(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[\t\n\f\r ]+|\z)(.*)\z"


def timestamp(line: Column) -> Column:
    """struct(ms, text) of a trimmed line that starts with a time within its ranges, else null."""

    def of(pattern: str) -> Column:
        def read(p: Column) -> Column:
            n = lambda i: F.coalesce(F.when(p[i] != "", p[i]).cast("long"), F.lit(0))
            short = p[2] == ""
            ms = F.when(short, n(0) * 60 + n(1)).otherwise(n(0) * 3600 + n(1) * 60 + n(2)) * 1000
            ok = F.when(short, (n(0) <= 59) & (n(1) <= 59)).otherwise((n(1) <= 59) & (n(2) <= 59))
            return F.when(ok, F.struct(ms.alias("ms"), T.trim(p[3]).alias("text")))

        return T.let(F.array(*(F.regexp_extract(line, pattern, i) for i in (1, 2, 3, 4))), read)

    return F.when(line.rlike(BRACKETED), of(BRACKETED)).when(line.rlike(BARE), of(BARE))


def speech_ms(text: Column) -> Column:
    """300 ms a word, a second at least."""
    words = F.filter(F.split(text, T.SPACE + "+"), lambda w: w != "")
    return F.greatest(F.lit(1000), F.size(words) * 300).cast("long")


def segments(text: Column) -> Column:
    """array<struct<start_ms, end_ms, text>>: lines belong to the last time before them, text before the first one to 0.

    A segment ends where the next begins, unless that is earlier; then, and for the last, it is as long as it takes to say.
    """
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: T.trim(x))
    lines = F.transform(trimmed, lambda x: F.struct(x.alias("line"), timestamp(x).alias("mark")))

    def cut(all_: Column) -> Column:
        marked = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: F.get(all_, i)["mark"].isNotNull())
        return T.let(marked, lambda at: between(all_, at))

    def between(all_: Column, at: Column) -> Column:
        """What stands before the first mark, and from each mark to the next: every line is looked at once."""
        said = lambda first, until: F.filter(F.transform(F.slice(all_, first + 1, until - first), lambda x: x["line"]), lambda x: x != "")
        joined = lambda ms, parts: F.struct(ms.cast("long").alias("ms"), F.array_join(parts, "\n").alias("text"))
        ends = lambda k: F.coalesce(F.get(at, k), F.size(all_))

        def one(i: Column, k: Column) -> Column:
            mark = F.get(all_, i)["mark"]
            return joined(mark["ms"], F.concat(F.filter(F.array(mark["text"]), lambda x: x != ""), said(i + 1, ends(k + 1))))

        return F.concat(F.array(joined(F.lit(0), said(F.lit(0), ends(F.lit(0))))), F.transform(at, one))

    marked = T.let(lines, cut)
    plain = T.trim(text)
    fallback = F.when(plain != "", F.array(F.struct(F.lit(0).cast("long").alias("ms"), plain.alias("text")))).otherwise(F.array().cast("array<struct<ms:bigint,text:string>>"))
    return T.let(F.filter(marked, lambda s: s["text"] != ""), lambda full: F.when(F.size(full) > 0, full).otherwise(fallback))


def transcript_segments(frame: DataFrame, key: str, text: str) -> DataFrame:
    """key, seg, start_ms, end_ms, text: one row for each segment."""
    found = frame.select(key, segments(F.col(text)).alias("all"))

    def closed(all_: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            after = F.get(all_, i + 1)["ms"]
            end = F.when(after >= s["ms"], after).otherwise(s["ms"] + speech_ms(s["text"]))
            return F.struct(i.alias("seg"), s["ms"].alias("start_ms"), F.greatest(end, s["ms"] + 1).alias("end_ms"), s["text"].alias("text"))

        return F.transform(all_, one)

    return found.select(key, F.inline(closed(F.col("all"))))


def transcript_chunks(frame: DataFrame, key: str, text: str) -> DataFrame:
    """key, ordinal, text, start_ms, end_ms: segments cut into windows that share their time by length.

    The windows of a document are numbered through in the row, so nothing is shuffled.
    """
    found = frame.select(key, segments(F.col(text)).alias("all"))

    def windows(all_: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            after = F.get(all_, i + 1)["ms"]
            end = F.greatest(F.when(after >= s["ms"], after).otherwise(s["ms"] + speech_ms(s["text"])), s["ms"] + 1)
            parts = F.transform(char_windows(s["text"], *TRANSCRIPT_WINDOW), lambda w: w["text"])
            return T.let(F.struct(parts.alias("parts"), (end - s["ms"]).alias("ms")), lambda known: spread(s["ms"], known))

        def spread(begin: Column, known: Column) -> Column:
            lengths = F.transform(known["parts"], lambda p: F.length(p).cast("long"))
            return T.let(F.struct(sums_before(lengths).alias("before"), F.aggregate(lengths, F.lit(0).cast("long"), lambda n, x: n + x).alias("total")), lambda sums: placed(begin, known, sums))

        def placed(begin: Column, known: Column, sums: Column) -> Column:
            at = lambda n: begin + F.floor(known["ms"] * n / sums["total"])

            def place(p: Column, i: Column) -> Column:
                n = F.get(sums["before"], i)
                a = at(n)
                return F.struct(p.alias("text"), a.cast("long").alias("start_ms"), F.greatest(at(n + F.length(p)), a + 1).cast("long").alias("end_ms"))

            return F.transform(known["parts"], place)

        return F.flatten(F.transform(all_, one))

    return found.select(key, F.posexplode(windows(F.col("all"))).alias("ordinal", "c")).select(key, "ordinal", "c.text", "c.start_ms", "c.end_ms")


def rendered(segments_: Column) -> Column:
    """Lines ``[mm:ss] text`` of array<struct<start, text>> with seconds; minutes go beyond 59."""
    two = lambda n: F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    whole = lambda s: F.floor(s["start"]).cast("long")
    spoken = F.filter(segments_, lambda s: ~T.blank(s["text"]))
    return F.array_join(F.transform(spoken, lambda s: F.concat(F.lit("["), two(F.floor(whole(s) / 60)), F.lit(":"), two(whole(s) % 60), F.lit("] "), T.trim(s["text"]))), "\n")
