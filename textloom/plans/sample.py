"""How the test tables stand in for a corpus: the same expressions in Spark and, as text, in the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import text as T
from ..operators import corpus, listing

ENDINGS = ("md", "txt", "go", "py", "html", "json", "pdf", "mp3", "env", "bin")
STATUS = "CASE doc_id % 11 WHEN 0 THEN 'skipped' WHEN 1 THEN 'error' WHEN 2 THEN '' ELSE 'ok' END"

#: SQL: the documents with a path, a kind, a status and a tombstone.
TYPE_SQL = "CASE doc_id % 10 WHEN 0 THEN 'md' WHEN 1 THEN 'text' WHEN 2 THEN 'code' WHEN 3 THEN 'code' WHEN 4 THEN 'html' WHEN 5 THEN 'data' WHEN 6 THEN 'pdf' WHEN 7 THEN 'audio' ELSE 'binary_ignored' END"
FILES_SQL = f"""
    files AS (SELECT doc_id, coalesce(text, '') AS content,
                     source || '/' || lang || '/doc_' || doc_id || '.' || ['md','txt','go','py','html','json','pdf','mp3','env','bin'][(doc_id % 10 + 1)::INTEGER] AS rel_path,
                     {TYPE_SQL} AS doc_type, {STATUS} AS status, doc_id % 13 = 0 AS deleted, strlen(coalesce(text, '')) AS size_bytes,
                     1700000000 + doc_id * 3600 AS mtime_unix
              FROM documents)"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ending = F.get(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 10).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ending)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content"), path.alias("rel_path"))
    return rows.select(
        "doc_id",
        "content",
        "rel_path",
        classify.doc_type(F.col("rel_path")).alias("doc_type"),
        F.expr(STATUS).alias("status"),
        (F.col("doc_id") % 13 == 0).alias("deleted"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        (F.lit(1700000000) + F.col("doc_id") * 3600).alias("mtime_unix"),
        T.sha256(F.col("content")).alias("content_hash"),
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the live files with raw text; every third is embedded, every eleventh failed."""
    own = files(spark, folder).filter(~F.col("deleted")).withColumn("status", F.lit("ok"))
    reps = corpus.representations(own)
    made = corpus.chunks(reps.withColumn("rep_id", F.col("doc_id"))).withColumn("chunk_id", F.col("rep_id") * 1000 + F.col("ordinal") + 1)
    status = F.when(F.col("chunk_id") % 11 == 0, "error").when(F.col("chunk_id") % 3 == 0, "ok").otherwise("pending")
    return made.withColumn("embedding_status", status)


#: SQL: chunks of text by windows of characters and of code by windows of lines, with the span of each.
SPACE_SQL = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trimmed(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^{SPACE_SQL}+', ''), '{SPACE_SQL}+\z', '')"


CHUNKS_SQL = f"""{FILES_SQL},
    own AS (SELECT doc_id, rel_path, doc_type, content, length(content) AS n, string_split(content, chr(10)) AS lines FROM files
            WHERE NOT deleted AND doc_type IN ('code', 'text', 'md', 'data', 'html')),
    cw AS (SELECT doc_id, rel_path, doc_type, s, least(s + 2500, n) AS e, n, substring(content, s + 1, 2500) AS text, content
           FROM (SELECT *, unnest(range(0, greatest(0, ceil((n - 2500) / 2250.0))::BIGINT + 1)) * 2250 AS s FROM own WHERE doc_type <> 'code' AND n > 0)),
    lw AS (SELECT doc_id, rel_path, doc_type, s, least(s + 200, len(lines)) AS e, array_to_string(lines[(s + 1):(s + 200)], chr(10)) AS text
           FROM (SELECT *, unnest(range(0, greatest(0, ceil((len(lines) - 200) / 170.0))::BIGINT + 1)) * 170 AS s FROM own WHERE doc_type = 'code')),
    w AS (SELECT doc_id, rel_path, doc_type, s, text,
                 1 + length(content[1:s]) - length(replace(content[1:s], chr(10), '')) AS a,
                 1 + length(content[1:(e - 1)]) - length(replace(content[1:(e - 1)], chr(10), '')) AS b
          FROM cw WHERE {trimmed('text')} <> '' AND (length(text) >= 200 OR e = n)
          UNION ALL SELECT doc_id, rel_path, doc_type, s, text, s + 1, e FROM lw WHERE {trimmed('text')} <> ''),
    o AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS ordinal FROM w),
    chunks AS (SELECT doc_id * 1000 + ordinal + 1 AS chunk_id, doc_id AS rep_id, ordinal, rel_path, doc_type, text,
                      CASE WHEN doc_type = 'code' THEN 'code' ELSE 'text' END AS index_kind,
                      CASE WHEN (doc_id * 1000 + ordinal + 1) % 11 = 0 THEN 'error' WHEN (doc_id * 1000 + ordinal + 1) % 3 = 0 THEN 'ok' ELSE 'pending' END AS embedding_status,
                      a::INTEGER AS start_line, b::INTEGER AS end_line FROM o)"""


def split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return corpus.split_spans(chunks(spark, folder))


#: SQL: vectors of the embeddings table; the label's parity is the index. meta: chunk metadata of the document of the same number.
VECTORS_SQL = """
    vectors AS (SELECT vec_id AS chunk_id, CASE WHEN label % 2 = 1 THEN 'code' ELSE 'text' END AS index_kind, embedding FROM embeddings)"""
META_SQL = f"""{FILES_SQL},{VECTORS_SQL},
    meta AS (SELECT chunk_id, index_kind, rel_path, doc_type, {trimmed('content')}[1:240] AS snippet FROM vectors JOIN files ON doc_id = chunk_id WHERE NOT deleted)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") % 2 == 1, "code").otherwise("text").alias("index_kind"), "embedding")


def meta(spark: SparkSession, folder: str) -> DataFrame:
    """hit_rows for the vectors: the chunk of a vector is the document of its number."""
    own = listing.live(files(spark, folder)).select(F.col("doc_id").alias("chunk_id"), "rel_path", "doc_type", T.snippet(F.col("content")).alias("snippet"))
    span = corpus.decoded_span(F.lit("lines"), F.lit(1), F.lit(1))
    kinds = vectors(spark, folder).select("chunk_id", "index_kind")
    return kinds.join(own, "chunk_id").select("chunk_id", "rel_path", "doc_type", F.lit("raw_text").alias("rep_type"), "snippet", span.alias("span"), "index_kind")


def probe(spark: SparkSession, folder: str, vec_id: int = 0) -> list[float]:
    """A query vector, the embedding of one row."""
    row = spark.read.parquet(f"{folder}/embeddings.parquet").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row.embedding) if row else []


#: SQL: transcripts, one for each conversation: a line ``[mm:ss] text`` for each turn, at 7 seconds a turn.
TALKS_SQL = """
    talks AS (SELECT conv_id, string_agg('[' || lpad((turn * 7 // 60)::VARCHAR, 2, '0') || ':' || lpad((turn * 7 % 60)::VARCHAR, 2, '0') || '] ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS body
              FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)"""


def talks(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet").filter("text IS NOT NULL")
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    seconds = F.col("turn") * 7
    line = F.concat(F.lit("["), two(F.floor(seconds / 60)), F.lit(":"), two(seconds % 60), F.lit("] "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"))
