"""Annotations: nested JSON as a representation, and flattened to lines that are searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking
from .corpus import _finish, lines_span, stable_id

PREVIEW = 240
NODE = "struct<at: string, line: string, value: variant>"


def outline(json: Column) -> Column:
    """How many brackets of a JSON text are open at once, at most (depth), and whether it is one value alone (single)."""
    bare = T.trim(F.regexp_replace(F.regexp_replace(json, r"(?s)\\.", ""), r"\"[^\"]*+\"", "\""))
    zero = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"), F.lit(0).alias("ends"))

    def step(acc: Column, bracket: Column) -> Column:
        now = acc["open"] + F.when(bracket == "", 0).when(bracket.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("open"), F.greatest(acc["most"], now).alias("most"), (acc["ends"] + F.when((now == 0) & (bracket != ""), 1).otherwise(0)).alias("ends"))

    def told(text: Column) -> Column:
        single = text.rlike(r"(?s)^(?:\"|[^\"\s\[\]{},:]+|[\[{].*[\]}])$")
        return F.aggregate(
            F.split(F.regexp_replace(text, r"[^\[\]{}]++", ""), ""), zero, step, lambda acc: F.struct(acc["most"].alias("depth"), (single & (acc["ends"] <= 1)).alias("single"))
        )

    return T.let(bare, told)


def number(value: Column) -> Column:
    """A double in its shortest form: whole numbers without a point, an exponent only below 1e-6 and from 1e21."""
    whole = F.when(F.abs(value) < 1e15, value.cast("long").cast("string")).otherwise(value.cast("string").cast("decimal(38,0)").cast("string"))
    plain = F.when((F.abs(value) >= 1e16) | (value == F.floor(value)), whole).otherwise(F.regexp_replace(value.cast("string").cast("decimal(38,22)").cast("string"), "0+$", ""))
    shown = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0E", "E"), "E([0-9])", "E+$1")
    return F.when(value == 0, "0").when((F.abs(value) >= 1e-6) & (F.abs(value) < 1e21), plain).otherwise(F.lower(shown))


def shown(value: Column) -> Column:
    """What stands for a leaf; empty for a blank string."""

    def of_kind(kind: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        return F.when(kind == "STRING", T.trim(text)).when(kind == "VOID", "null").when(kind == "BOOLEAN", text).otherwise(T.let(F.try_variant_get(value, "$", "double"), number))

    return T.let(F.schema_of_variant(value), of_kind)


def opened(node: Column) -> Column:
    """A node's children in the order of keys; a leaf becomes its line, or nothing if that is blank."""
    at = node["at"]

    def child(path: Column, value: Column) -> Column:
        return F.struct(path.alias("at"), F.lit(None).cast("string").alias("line"), value.alias("value")).cast(NODE)

    def fields(found: Column) -> Column:
        order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)  # noqa: E731  by code points
        return F.transform(F.array_sort(F.map_entries(found), order), lambda e: child(F.when(at == "", e["key"]).otherwise(F.concat(at, F.lit("."), e["key"])), e["value"]))

    def items(found: Column) -> Column:
        return F.transform(found, lambda x, i: child(F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), x))

    def leaf(text: Column) -> Column:
        line = F.when(at == "", text).otherwise(F.concat(at, F.lit(": "), text))
        return F.filter(F.array(F.struct(at.alias("at"), line.alias("line"), F.lit(None).cast("variant").alias("value")).cast(NODE)), lambda _: text != "")

    def inside(found: Column) -> Column:
        return F.when(found["fields"].isNotNull(), fields(found["fields"])).when(found["items"].isNotNull(), items(found["items"])).otherwise(T.let(shown(node["value"]), leaf))

    parts = F.struct(F.try_variant_get(node["value"], "$", "map<string,variant>").alias("fields"), F.try_variant_get(node["value"], "$", "array<variant>").alias("items"))
    return F.when(node["line"].isNotNull(), F.array(node)).otherwise(T.let(parts, inside))


def flatten_json(json: Column | str) -> Column:
    """Lines ``a.b[0]: v`` in the order of keys, blank strings left out; the JSON itself where there is no line.

    All nodes are opened at once, a level in each round, and there are as many rounds as levels, so the work is that of the
    text times its depth, in the row itself: no Python and no shuffle. Null for null and for what isn't one JSON value
    (or is over a thousand deep); an object with a key twice isn't, unless ``spark.sql.variant.allowDuplicateKeys`` is set (``build_session`` does), and then the last one counts.
    """
    json = F.col(json) if isinstance(json, str) else json

    def lines(value: Column, told: Column) -> Column:
        root = F.array(F.struct(F.lit("").alias("at"), F.lit(None).cast("string").alias("line"), value.alias("value")).cast(NODE))
        leaves = F.aggregate(F.sequence(F.lit(0), told["depth"]), root, lambda nodes, _: F.flatten(F.transform(nodes, opened)))
        text = T.trim(F.array_join(F.transform(leaves, lambda n: n["line"]), "\n"))
        return T.let(text, lambda x: F.when(x != "", x).otherwise(F.to_json(value)))

    parsed = F.struct(F.try_parse_json(json).alias("value"), outline(json).alias("outline"))
    return T.let(parsed, lambda p: F.when(p["value"].isNotNull() & p["outline"]["single"], lines(p["value"], p["outline"])))


def store(annotations: DataFrame, indexed: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """annotations (doc_id, rel_path, doc_type, json) -> (representations, chunks with spans, previews)."""
    texts = annotations.withColumn("text", flatten_json("json"))

    def rep(kind: str, content: str) -> DataFrame:
        return texts.select(
            stable_id(F.col("doc_id"), F.lit(kind)).alias("rep_id"), "doc_id", F.lit(kind).alias("rep_type"), T.sha256(F.col(content)).alias("rep_hash"), "rel_path", "doc_type", F.col(content).alias("text")
        )

    reps = rep("annotation_json", "json")
    flat = rep("annotation_text", "text")
    rows = flat.select("rep_id", "rel_path", "doc_type", "rep_type", F.explode(chunking.char_windows(F.col("text"), 1200, 200, 120)).alias("w"))
    chunks = _finish(rows.select("rep_id", "rel_path", "doc_type", "rep_type", "w.ordinal", "w.text", lines_span(F.col("w.start_line"), F.col("w.end_line")).alias("span")))
    chunks = chunks.withColumn("index_kind", F.lit("text"))
    previews = texts.select("doc_id", T.snippet(F.col("text"), PREVIEW).alias("preview"))
    return (reps.unionByName(flat) if indexed else reps), (chunks if indexed else chunks.limit(0)), previews
