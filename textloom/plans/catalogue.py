"""The registered queries over the reference operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, globs, secrets
from ..functions import text as T
from ..operators import annotations, answers, blocks, changes, chunking, corpus, listing, opening, paging, retrieval, state
from ..operators import vectors as V
from ..streaming import worker
from ..sources import archives
from ..sources.models import HashedWords
from . import sample
from .sample import CHUNKS_SQL, FILES_SQL, META_SQL, TALKS_SQL, VECTORS_SQL, trimmed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# search over vectors

PROBE = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
SCORE = "round(list_cosine_similarity(embedding::DOUBLE[], v), 6)"


@query("cosine_topk", f"WITH {PROBE} SELECT vec_id AS chunk_id, {SCORE} AS score FROM embeddings, q WHERE len(embedding) = len(v) ORDER BY score DESC, chunk_id LIMIT 10")
def cosine_topk(spark, folder):
    return V.search(sample.vectors(spark, folder), sample.probe(spark, folder))


@query(
    "cosine_topk_blocks",
    f"WITH {META_SQL}, {PROBE} SELECT chunk_id, {SCORE} AS score FROM vectors, q WHERE len(embedding) = len(v) AND chunk_id IN (SELECT doc_id FROM files WHERE doc_type <> 'code') ORDER BY score DESC, chunk_id LIMIT 10",
)
def cosine_topk_blocks(spark, folder):
    """The best vectors whose document isn't code, by blocks of like directions."""
    passing = sample.files(spark, folder).filter("doc_type <> 'code'").select(F.col("doc_id").alias("chunk_id"))
    return blocks.Blocks.of(sample.vectors(spark, folder)).search(sample.probe(spark, folder), passing=passing)


FILTERED = retrieval.Search(k=7, index="text", path_prefix="src1", file_glob="src*/*/doc_*[02468].*", doc_types=(" MD", "html"))


@query(
    "cosine_topk_filtered",
    f"""WITH {META_SQL}, {PROBE}
    SELECT chunk_id, rel_path, doc_type, {SCORE} AS score, snippet FROM vectors JOIN meta USING (chunk_id, index_kind), q
    WHERE index_kind = 'text' AND starts_with(rel_path, 'src1') AND regexp_matches(rel_path, '^src[^/]*/[^/]*/doc_[^/]*[02468]\\.[^/]*$')
      AND doc_type IN ('md', 'html') ORDER BY score DESC, chunk_id LIMIT 7""",
)
def cosine_topk_filtered(spark, folder):
    hits, _ = retrieval.run(sample.vectors(spark, folder), sample.meta(spark, folder), FILTERED, lambda text, kind: sample.probe(spark, folder))
    return hits.select("chunk_id", "rel_path", "doc_type", "score", "snippet")


@query(
    "search_both_fused",
    f"""WITH {META_SQL}, {PROBE},
    s AS (SELECT chunk_id, index_kind, rel_path, {SCORE} AS score FROM vectors JOIN meta USING (chunk_id, index_kind), q),
    t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY index_kind ORDER BY score DESC, chunk_id) <= 10),
    n AS (SELECT chunk_id, rel_path, CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 1 END AS score
          FROM t WINDOW p AS (PARTITION BY index_kind))
    SELECT chunk_id, rel_path, round(score, 6) AS score FROM n ORDER BY score DESC, chunk_id LIMIT 10""",
)
def search_both_fused(spark, folder):
    hits, _ = retrieval.run(sample.vectors(spark, folder), sample.meta(spark, folder), retrieval.Search(index="both"), lambda text, kind: sample.probe(spark, folder))
    return hits.select("chunk_id", "rel_path", "score")


@query(
    "cosine_topk_each",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q)
    SELECT query_id, chunk_id, score, row_number() OVER w AS rank FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id) QUALIFY rank <= 10""",
)
def cosine_topk_each(spark, folder):
    own = sample.vectors(spark, folder)
    asked = own.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.search_each(own, asked)


@query("dimension_mismatches", "SELECT count(*) FILTER (WHERE len(embedding) <> 3) AS mismatches FROM embeddings")
def dimension_mismatches(spark, folder):
    return V.dimension_mismatches(sample.vectors(spark, folder), 3)


@query(
    "route_code_query",
    r"""WITH s AS (SELECT item_id, lower(text) AS q FROM benchmark UNION ALL SELECT doc_id, lower(coalesce(text, '')) FROM documents)
    SELECT item_id, regexp_matches(q, '\b(func|class|package|import|return|if|for|while|switch|case)\b')::INT + regexp_matches(q, '[(){}\[\];]')::INT
           + contains(q, '```')::INT + contains(q, '`')::INT + regexp_matches(q, '\.(js|ts|py|go|java|rb|cpp|c|cs|html|css|json|yaml|yml)\b')::INT >= 2 AS is_code FROM s""",
)
def route_code_query(spark, folder):
    asked = table(spark, folder, "benchmark").select("item_id", "text").union(table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit(""))))
    return asked.select("item_id", T.is_code_query(F.col("text")).alias("is_code"))


# classification, hashes, text


@query("classify_doc_type", f"WITH {FILES_SQL} SELECT doc_id, rel_path, doc_type, CASE WHEN doc_type = 'code' THEN 'code' ELSE 'text' END AS index_kind FROM files")
def classify_doc_type(spark, folder):
    return sample.files(spark, folder).select("doc_id", "rel_path", "doc_type", classify.index_kind(F.col("doc_type")).alias("index_kind"))


@query(
    "infer_doc_type",
    f"""WITH {FILES_SQL} SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'md' WHEN 1 THEN 'text' WHEN 2 THEN 'code' WHEN 3 THEN 'code' WHEN 4 THEN 'html' WHEN 6 THEN 'pdf' WHEN 7 THEN 'audio' ELSE 'unknown' END AS opened_type,
    doc_id % 10 = 7 AS looks_binary FROM files""",
)
def infer_doc_type(spark, folder):
    path = F.col("rel_path")
    return sample.files(spark, folder).select("doc_id", classify.opened_type(path).alias("opened_type"), classify.looks_binary(path, F.col("content")).alias("looks_binary"))


@query("content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, sha256(sha256(coalesce(text, '')))[1:8] AS masked FROM documents")
def content_hash(spark, folder):
    return sample.files(spark, folder).select("doc_id", "content_hash", T.masked_id(F.col("content_hash")).alias("masked"))


@query("normalize_text", r"SELECT doc_id, sha256(regexp_replace(replace(coalesce(text, ''), ' ', chr(13)), '\r\n?', chr(10), 'g')) AS normal_hash FROM documents")
def normalize_text(spark, folder):
    content = F.translate(F.col("content"), " ", "\r").cast("binary")
    return sample.files(spark, folder).select("doc_id", T.sha256(T.normalize(content)).alias("normal_hash"))


@query(
    "text_cuts",
    f"""WITH {FILES_SQL}, t AS (SELECT doc_id, content AS c, {trimmed('content')} AS t FROM files)
    SELECT doc_id, t[1:240] AS snippet, CASE WHEN length(c) <= 50 THEN c ELSE c[1:47] || '...' END AS truncated,
           CASE WHEN length(t) <= 300 THEN t ELSE {trimmed('t[1:300]')} || '...' END AS shown,
           CASE WHEN t = '' THEN '<empty>' WHEN length(t) <= 64 THEN t ELSE t[1:64] || '…' END AS question, length(c) > 100 AS cut FROM t""",
)
def text_cuts(spark, folder):
    c = F.col("content")
    return sample.files(spark, folder).select(
        "doc_id", T.snippet(c).alias("snippet"), T.truncate(c, 50).alias("truncated"), T.truncate_snippet(c, 300).alias("shown"), T.truncate_question(c).alias("question"), T.truncate_flag(c, 100)["truncated"].alias("cut")
    )


SECRET_SQL = r"(?i)token\s*=\s*\x22[0-9a-f]{20,}"


@query(
    "secret_scan_status",
    f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN regexp_matches(content, '{SECRET_SQL}') OR regexp_matches(content, 'AKIA[0-9A-Z]{{16}}') OR regexp_matches(content, '(?i)token\\s*[:=]\\s*[A-Za-z0-9_.-]{{20,}}')
       OR regexp_matches(content, 'sk_[a-z0-9]{{32}}|api_[A-Za-z0-9]{{32}}') THEN 'secret_excluded' ELSE 'ok' END AS status FROM files""",
)
def secret_scan_status(spark, folder):
    found = secrets.has_secret(F.col("content"), (*secrets.PATTERNS, SECRET_SQL))
    return sample.files(spark, folder).select("doc_id", F.when(found, "secret_excluded").otherwise("ok").alias("status"))


@query(
    "normalized_columns",
    f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN status IN ('skipped', 'error') THEN status ELSE 'ok' END AS status,
       CASE WHEN doc_id % 3 = 0 THEN 'archive_member' ELSE 'filesystem' END AS source_type, CASE WHEN doc_id % 2 = 0 THEN 'code' ELSE 'text' END AS index_kind FROM files""",
)
def normalized_columns(spark, folder):
    source = F.when(F.col("doc_id") % 3 == 0, " Archive_Member").otherwise("?")
    kind = F.when(F.col("doc_id") % 2 == 0, "CODE ").otherwise(None)
    return sample.files(spark, folder).select("doc_id", classify.status(F.col("status")).alias("status"), classify.source_type(source).alias("source_type"), classify.kind_of_index(kind).alias("index_kind"))


# paths


@query("path_exclude_filter", f"WITH {FILES_SQL} SELECT doc_id, rel_path FROM files WHERE NOT regexp_matches(rel_path, '^(.*/)?fr/.*$|^src1[0-3]/[^/]*/doc_[^/]*\\.md$|^(.*/)?[^/]*\\.env$')")
def path_exclude_filter(spark, folder):
    excludes = ("**/fr/**", "src1[0-3]/*/doc_*.md", "**/*.env")
    return sample.files(spark, folder).filter(~globs.any_of(F.col("rel_path"), excludes)).select("doc_id", "rel_path")


@query(
    "gitignore_filter",
    f"""WITH {FILES_SQL} SELECT doc_id, rel_path,
       CASE WHEN regexp_matches(rel_path, '^src1/') AND NOT regexp_matches(rel_path, 'doc_[^/]*7\\.mp3$') THEN true
            WHEN regexp_matches(rel_path, 'doc_[^/]*7\\.mp3$') THEN false WHEN regexp_matches(rel_path, '\\.(bin|mp3)$') THEN true ELSE false END AS ignored FROM files""",
)
def gitignore_filter(spark, folder):
    rules = globs.ignore_rules("# build\n*.bin\n*.mp3\n/src1/**\n!doc_*7.mp3\nnothing/\n")
    return sample.files(spark, folder).select("doc_id", "rel_path", globs.ignored(F.col("rel_path"), rules).alias("ignored"))


@query("glob_filter_search", f"WITH {FILES_SQL} SELECT rel_path FROM files WHERE regexp_matches(rel_path, '^src[^/]/[^/]*/doc_[^/]*\\.md$')")
def glob_filter_search(spark, folder):
    return sample.files(spark, folder).filter(F.col("rel_path").rlike(globs.path_match("src?/*/doc_*.md"))).select("rel_path")


@query("glob_filter_store", f"WITH {FILES_SQL} SELECT rel_path FROM files WHERE rel_path GLOB 'src[0-4]*/doc_?0.md'")
def glob_filter_store(spark, folder):
    return sample.files(spark, folder).filter(F.col("rel_path").rlike(globs.store("src[0-4]*/doc_?0.md"))).select("rel_path")


@query("prefix_filters", f"WITH {FILES_SQL} SELECT rel_path, starts_with(rel_path, 'SRC1') AS searched, starts_with(lower(rel_path), 'src1/en/doc_') AS listed, starts_with(rel_path, '.') AS hidden FROM files")
def prefix_filters(spark, folder):
    path = F.col("rel_path")
    return sample.files(spark, folder).select("rel_path", globs.search_prefix(path, "SRC1").alias("searched"), globs.store_prefix(path, "./SRC1/en/doc_").alias("listed"), globs.hidden(path).alias("hidden"))


@query("clean_paths", f"WITH {FILES_SQL} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a/' || rel_path WHEN 1 THEN rel_path END AS clean FROM files")
def clean_paths(spark, folder):
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" ./a/b/.././"), "rel_path")).when(F.col("doc_id") % 4 == 1, F.concat("rel_path", F.lit("/"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("/"), "rel_path")).otherwise("a/../../b")
    return sample.files(spark, folder).select("doc_id", globs.clean_path(raw).alias("clean"))


# chunks


@query(
    "chunk_documents",
    f"WITH {CHUNKS_SQL} SELECT chunk_id, rep_id, ordinal, rel_path, index_kind, sha256(text) AS text_hash, ceil(length(text) / 4.0)::INTEGER AS tokens_est, start_line, end_line FROM chunks",
)
def chunk_documents(spark, folder):
    rows = sample.chunks(spark, folder)
    return rows.select("chunk_id", "rep_id", "ordinal", "rel_path", "index_kind", "text_hash", "tokens_est", F.col("span.start").alias("start_line"), F.col("span.end").alias("end_line"))


@query(
    "chunk_pages",
    f"""WITH p AS (SELECT page_id, string_split(replace(html, chr(10), chr(12)), chr(12)) AS parts FROM pages WHERE html IS NOT NULL),
    u AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS page FROM p), t AS (SELECT page_id, page::INTEGER AS page, {trimmed('part')} AS text FROM u)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY page) - 1)::INTEGER AS ordinal, page, sha256(text) AS text_hash FROM t WHERE text <> ''""",
)
def chunk_pages(spark, folder):
    rows = table(spark, folder, "pages").filter("html IS NOT NULL").select("page_id", F.translate("html", "\n", "\f").alias("text"))
    return rows.select("page_id", F.inline(chunking.pages(F.col("text")))).select("page_id", "ordinal", "page", T.sha256(F.col("text")).alias("text_hash"))


SEGMENTS_SQL = f"""{TALKS_SQL},
    lines AS (SELECT conv_id, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM talks),
    marks AS (SELECT conv_id, i, (l[2:3]::INT * 60 + l[5:6]::INT) * 1000 AS ms, {trimmed('l[9:]')} AS text FROM lines WHERE l[2:3]::INT <= 59),
    full_ AS (SELECT conv_id, i, ms, text FROM marks WHERE text <> ''),
    seg AS (SELECT conv_id, (row_number() OVER w - 1)::INTEGER AS seg, ms AS start_ms, lead(ms) OVER w AS after, text,
                   greatest(1000, 300 * len(list_filter(string_split_regex(text, '{sample.SPACE_SQL}+'), lambda x: x <> ''))) AS speech FROM full_ WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
    ends AS (SELECT conv_id, seg, start_ms::BIGINT AS start_ms, greatest(CASE WHEN after >= start_ms THEN after ELSE start_ms + speech END, start_ms + 1)::BIGINT AS end_ms, text FROM seg)"""


@query("transcript_segments", f"WITH {SEGMENTS_SQL} SELECT conv_id, seg, start_ms, end_ms, sha256(text) AS text_hash FROM ends")
def transcript_segments(spark, folder):
    rows = chunking.transcript_segments(sample.talks(spark, folder), "conv_id", "body")
    return rows.select("conv_id", "seg", "start_ms", "end_ms", T.sha256(F.col("text")).alias("text_hash"))


@query(
    "transcript_chunks",
    f"""WITH {SEGMENTS_SQL},
    w AS (SELECT *, length(text) AS n, unnest(range(0, greatest(0, ceil((length(text) - 1200) / 1080.0))::BIGINT + 1)) * 1080 AS s FROM ends),
    p AS (SELECT conv_id, seg, s, start_ms, end_ms, substring(text, s + 1, 1200) AS part FROM w WHERE {trimmed('substring(text, s + 1, 1200)')} <> '' AND (length(substring(text, s + 1, 1200)) >= 80 OR s + 1200 >= n)),
    c AS (SELECT *, sum(length(part)) OVER (PARTITION BY conv_id, seg) AS total, sum(length(part)) OVER (PARTITION BY conv_id, seg ORDER BY s) AS upto FROM p),
    t AS (SELECT conv_id, seg, s, part, (start_ms + (end_ms - start_ms) * (upto - length(part)) // total)::BIGINT AS a, (start_ms + (end_ms - start_ms) * upto // total)::BIGINT AS b FROM c)
    SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY seg, s) - 1)::INTEGER AS ordinal, a AS start_ms, greatest(b, a + 1) AS end_ms, sha256(part) AS text_hash FROM t""",
)
def transcript_chunks(spark, folder):
    rows = chunking.transcript_chunks(sample.talks(spark, folder), "conv_id", "body")
    return rows.select("conv_id", "ordinal", "start_ms", "end_ms", T.sha256(F.col("text")).alias("text_hash"))


@query(
    "rendered_segments",
    """WITH t AS (SELECT conv_id, turn, role, (turn * 90 // 60)::VARCHAR AS m, lpad((turn * 90 % 60)::VARCHAR, 2, '0') AS s FROM conversations)
    SELECT conv_id, string_agg('[' || lpad(m, greatest(2, length(m))::INTEGER, '0') || ':' || s || '] ' || trim(role), chr(10) ORDER BY turn) AS body FROM t GROUP BY conv_id""",
)
def rendered_segments(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", (F.col("turn") * 90.0).alias("start"), F.concat(F.lit(" "), "role").alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("s")).select("conv_id", chunking.rendered(F.col("s")).alias("body"))


# lists, counts, pending work


@query("list_files_page", f"WITH {FILES_SQL} SELECT rel_path, doc_type, status, size_bytes FROM files WHERE NOT deleted AND starts_with(rel_path, 'src') AND rel_path GLOB '*doc_*' ORDER BY rel_path LIMIT 25 OFFSET 10")
def list_files_page(spark, folder):
    return listing.list_files(sample.files(spark, folder), prefix="SRC", glob="*doc_*", limit=25, offset=10).select("rel_path", "doc_type", "status", "size_bytes")


@query("deep_page", f"WITH {FILES_SQL} SELECT rel_path, doc_type FROM files WHERE NOT deleted ORDER BY rel_path LIMIT 30 OFFSET (SELECT count(*) * 9 // 10 FROM files WHERE NOT deleted)")
def deep_page(spark, folder):
    """A page near the end of all live files, by the index of the order."""
    pages = paging.Pages.of(listing.live(sample.files(spark, folder)).select("rel_path", "doc_type"), "rel_path")
    return pages.page(pages.total * 9 // 10, 30)


@query(
    "many_patterns",
    f"""WITH {FILES_SQL}, g AS (SELECT doc_id AS pattern_id, doc_id % 3 AS kind, split_part(rel_path, '/', 1) AS source, doc_id % 100 AS d, rel_path FROM files)
    SELECT pattern_id, f.rel_path FROM g JOIN files f ON CASE kind WHEN 0 THEN regexp_full_match(f.rel_path, g.source || '/[^/]*/doc_' || d || '[^/]*[.]md') WHEN 1 THEN f.rel_path = g.rel_path ELSE regexp_full_match(f.rel_path, '[^/]*/[^/]*/doc_' || d || '[^/][.]go') END""",
)
def many_patterns(spark, folder):
    """A pattern for every document, of three kinds, and the files that each matches."""
    files, kind = sample.files(spark, folder), F.col("doc_id") % 3
    number = (F.col("doc_id") % 100).cast("string")
    glob = F.when(kind == 0, F.concat(F.split("rel_path", "/")[0], F.lit("/*/doc_"), number, F.lit("*.md"))).when(kind == 1, F.col("rel_path")).otherwise(F.concat(F.lit("*/*/doc_"), number, F.lit("?.go")))
    return listing.matched_by(files.select("rel_path"), files.select(F.col("doc_id").alias("pattern_id"), glob.alias("glob")))


@query("list_visible_total", f"WITH {FILES_SQL} SELECT count(*) AS total FROM files WHERE NOT deleted AND NOT starts_with(rel_path, '.') AND rel_path GLOB '*.md'")
def list_visible_total(spark, folder):
    return listing.count_files(sample.files(spark, folder), glob="*.md", with_hidden=False)


@query("document_by_path", f"WITH {FILES_SQL} SELECT doc_id, rel_path, doc_type FROM files WHERE rel_path = (SELECT min(rel_path) FROM files)")
def document_by_path(spark, folder):
    docs = sample.files(spark, folder)
    path = docs.agg(F.min("rel_path")).first()[0]
    return listing.by_path(docs, path).select("doc_id", "rel_path", "doc_type")


@query("doc_counts", f"WITH {FILES_SQL} SELECT doc_type, count(*) AS n FROM files WHERE NOT deleted GROUP BY doc_type")
def doc_counts(spark, folder):
    return listing.doc_counts(sample.files(spark, folder))


@query(
    "corpus_stats",
    f"""WITH {CHUNKS_SQL} SELECT (SELECT count(*) FROM files) AS scanned, (SELECT count(*) FROM files WHERE NOT deleted AND status = 'ok') AS indexed,
       (SELECT count(*) FROM files WHERE NOT deleted AND status = 'skipped') AS skipped, (SELECT count(*) FROM files WHERE deleted) AS deleted, (SELECT count(*) FROM files WHERE NOT deleted AND status = 'error') AS errors,
       (SELECT count(*) FROM files WHERE NOT deleted) AS total_docs, (SELECT count(*) FROM own) AS representations, (SELECT count(*) FROM chunks) AS chunks_total, (SELECT count(*) FROM chunks WHERE embedding_status = 'ok') AS embedded_ok,
       (SELECT string_agg(doc_type || '=' || n, ',' ORDER BY doc_type) FROM (SELECT doc_type, count(*) AS n FROM files WHERE NOT deleted GROUP BY doc_type)) AS doc_counts""",
)
def corpus_stats(spark, folder):
    docs = sample.files(spark, folder)
    reps = corpus.representations(listing.live(docs).withColumn("status", F.lit("ok")))
    stats = listing.corpus_stats(docs, reps, sample.chunks(spark, folder))
    return stats.withColumn("doc_counts", F.array_join(F.transform(F.map_entries("doc_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query(
    "status_counts",
    f"""WITH {FILES_SQL} SELECT CASE WHEN deleted THEN 'deleted' WHEN status = 'ok' THEN 'indexed' WHEN status = 'error' THEN 'errors' WHEN status = '' THEN '<empty>' ELSE status END AS status, count(*) AS n, min(rel_path) AS example FROM files GROUP BY 1""",
)
def status_counts(spark, folder):
    return listing.status_counts(sample.files(spark, folder))


@query("code_ratio", f"WITH {FILES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE doc_type = 'code') AS code, count(*) FILTER (WHERE doc_type = 'code') / count(*)::DOUBLE AS code_ratio FROM files WHERE NOT deleted")
def code_ratio(spark, folder):
    return listing.code_ratio(sample.files(spark, folder))


SPAN_SQL = "'lines:' || start_line || '-' || end_line AS span"


@query("first_span", f"WITH {CHUNKS_SQL} SELECT chunk_id, {SPAN_SQL} FROM chunks")
def first_span(spark, folder):
    chunks, spans = sample.split(spark, folder)
    later = spans.withColumn("span_id", F.lit((1 << 63) - 1)).withColumn("start", F.lit(7)).withColumn("end", F.lit(7))
    return listing.with_span(chunks, spans.union(later)).select("chunk_id", corpus.printed_span(F.col("span")).alias("span"))


@query("pending_chunks", f"WITH {CHUNKS_SQL} SELECT chunk_id, ordinal, index_kind, {SPAN_SQL} FROM chunks WHERE embedding_status = 'pending' AND index_kind = 'text' ORDER BY chunk_id LIMIT 32")
def pending_chunks(spark, folder):
    return listing.pending(*sample.split(spark, folder), kind="text").select("chunk_id", "ordinal", "index_kind", corpus.printed_span(F.col("span")).alias("span"))


@query("embedded_metadata", f"WITH {CHUNKS_SQL} SELECT chunk_id, rel_path, doc_type, {trimmed('text')}[1:240] AS snippet, {SPAN_SQL} FROM chunks WHERE embedding_status = 'ok' ORDER BY chunk_id LIMIT 50 OFFSET 20")
def embedded_metadata(spark, folder):
    rows = listing.embedded(*sample.split(spark, folder), limit=50, offset=20)
    return rows.select("chunk_id", "rel_path", "doc_type", "snippet", corpus.printed_span(F.col("span")).alias("span"))


@query(
    "chunks_by_rep",
    f"WITH {CHUNKS_SQL} SELECT ordinal, chunk_id FROM chunks WHERE rep_id = (SELECT max(rep_id) FROM chunks WHERE ordinal = (SELECT max(ordinal) FROM chunks))",
)
def chunks_by_rep(spark, folder):
    chunks = sample.chunks(spark, folder)
    rep = chunks.agg(F.max(F.struct("ordinal", "rep_id")).alias("m")).select("m.rep_id").first()
    return listing.chunks_of(chunks, rep.rep_id if rep else 0).select("ordinal", "chunk_id")


@query(
    "cache_eviction",
    f"""WITH {FILES_SQL}, k AS (SELECT rel_path AS name, size_bytes, mtime_unix, (SELECT max(mtime_unix) FROM files) AS now FROM files),
    r AS (SELECT name, sum(size_bytes) OVER (ORDER BY mtime_unix DESC, name DESC ROWS UNBOUNDED PRECEDING) AS upto FROM k WHERE mtime_unix >= now - 1000000) SELECT name FROM r WHERE upto <= 300000""",
)
def cache_eviction(spark, folder):
    files = sample.files(spark, folder).select(F.col("rel_path").alias("name"), "size_bytes", "mtime_unix")
    now = files.agg(F.max("mtime_unix")).first()[0] or 0
    return listing.cache_kept(files, now, ttl_s=1_000_000, max_bytes=300_000).select("name")


# changes


def _versions(spark, folder):
    """Stored: documents whose number isn't divisible by 5, with an old hash for every seventh. Found: those not divisible by 3."""
    docs = sample.files(spark, folder)
    stored = docs.filter("doc_id % 5 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")))
    return stored, docs.filter("doc_id % 3 <> 0")


@query("missing_as_deleted", f"WITH {FILES_SQL} SELECT rel_path FROM files s WHERE doc_id % 5 <> 0 AND NOT deleted AND NOT EXISTS (SELECT 1 FROM files f WHERE f.doc_id % 3 <> 0 AND f.rel_path = s.rel_path)")
def missing_as_deleted(spark, folder):
    return changes.missing(*_versions(spark, folder)).select("rel_path")


@query(
    "changed_documents",
    f"""WITH {FILES_SQL} SELECT f.rel_path, CASE WHEN s.doc_id IS NULL THEN 'add' WHEN s.doc_id % 7 = 0 OR s.status = 'error' OR s.deleted THEN 'update' ELSE 'keep' END AS action
    FROM files f LEFT JOIN (SELECT * FROM files WHERE doc_id % 5 <> 0) s ON f.rel_path = s.rel_path WHERE f.doc_id % 3 <> 0""",
)
def changed_documents(spark, folder):
    return changes.changed(*_versions(spark, folder)).select("rel_path", "action")


@query(
    "upsert_merge",
    f"""WITH {FILES_SQL} SELECT rel_path, CASE WHEN doc_id % 3 = 0 AND doc_id % 7 = 0 THEN 'old' ELSE sha256(content) END AS content_hash FROM files WHERE doc_id % 5 <> 0 OR doc_id % 3 <> 0""",
)
def upsert_merge(spark, folder):
    stored, found = _versions(spark, folder)
    return changes.merge(stored, found, ["rel_path"]).select("rel_path", "content_hash")


@query("insert_missing", f"WITH {FILES_SQL} SELECT rel_path, doc_id % 5 <> 0 AS was_there FROM files WHERE doc_id % 5 <> 0 OR doc_id % 3 <> 0")
def insert_missing(spark, folder):
    stored, found = (x.select("rel_path", F.lit(w).alias("was_there")) for x, w in zip(_versions(spark, folder), (True, False)))
    return changes.insert_missing(stored, found, ["rel_path"])


@query(
    "cascade_soft_delete",
    f"""WITH {CHUNKS_SQL}, g AS (SELECT doc_id FROM files WHERE doc_id % 4 = 1)
    SELECT 'chunk' AS kind, chunk_id AS id, rep_id IN (SELECT doc_id FROM g) AS deleted FROM chunks
    UNION ALL SELECT 'rep', doc_id, doc_id IN (SELECT doc_id FROM g) FROM own UNION ALL SELECT 'doc', doc_id, deleted OR doc_id IN (SELECT doc_id FROM g) FROM files""",
)
def cascade_soft_delete(spark, folder):
    docs = sample.files(spark, folder)
    reps = corpus.representations(listing.live(docs).withColumn("status", F.lit("ok"))).withColumn("rep_id", F.col("doc_id"))
    d, r, c = changes.tombstone(docs, reps, sample.chunks(spark, folder), docs.filter("doc_id % 4 = 1"))
    rows = lambda frame, kind, key: frame.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "deleted")
    return rows(c, "chunk", "chunk_id").union(rows(r, "rep", "rep_id")).union(rows(d, "doc", "doc_id"))


@query("drop_tail_chunks", f"WITH {CHUNKS_SQL} SELECT chunk_id, ordinal >= 1 AND rep_id % 2 = 0 AS deleted FROM chunks")
def drop_tail_chunks(spark, folder):
    chunks = sample.chunks(spark, folder)
    lengths = chunks.filter("rep_id % 2 = 0").select("rep_id", F.lit(1).alias("n")).distinct()
    return changes.drop_tail(chunks, lengths).select("chunk_id", "deleted")


@query(
    "mark_embedding",
    f"""WITH {CHUNKS_SQL} SELECT chunk_id, CASE chunk_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE embedding_status END AS embedding_status, CASE WHEN chunk_id % 5 = 1 THEN 'bad' ELSE '' END AS embedding_error FROM chunks""",
)
def mark_embedding(spark, folder):
    chunks = sample.chunks(spark, folder)
    results = chunks.filter("chunk_id % 5 < 2").select("chunk_id", F.when(F.col("chunk_id") % 5 == 0, "ok").otherwise("error").alias("status"), F.when(F.col("chunk_id") % 5 == 1, "bad").alias("error"))
    return changes.mark_embedding(chunks, results).select("chunk_id", "embedding_status", "embedding_error")


@query(
    "chunk_reuse_by_hash",
    f"""WITH {CHUNKS_SQL}, k AS (SELECT index_kind, text, min(chunk_id) AS donor FROM chunks WHERE embedding_status = 'ok' GROUP BY ALL)
    SELECT c.chunk_id, k.donor FROM chunks c JOIN k ON c.index_kind = k.index_kind AND c.text = k.text WHERE c.embedding_status = 'pending'""",
)
def chunk_reuse_by_hash(spark, folder):
    chunks = sample.chunks(spark, folder)
    done = chunks.filter("embedding_status = 'ok'")
    vectors = done.select("index_kind", "chunk_id", F.array(F.col("chunk_id").cast("double")).alias("embedding"))
    return changes.reusable_vectors(chunks, done, vectors).select("chunk_id", F.get("embedding", F.lit(0)).cast("long").alias("donor"))


@query(
    "archive_retention",
    f"WITH {FILES_SQL} SELECT rel_path FROM files WHERE NOT deleted AND (starts_with(rel_path, 'src1/') OR starts_with(rel_path, 'src2/en/'))",
)
def archive_retention(spark, folder):
    archives = spark.createDataFrame([("src1",), ("src2/en",), ("src",)], "rel_path string")
    return changes.archive_members(sample.files(spark, folder), archives).select("rel_path")


@query("evict_documents", f"WITH {META_SQL} SELECT chunk_id FROM meta WHERE chunk_id % 6 <> 0")
def evict_documents(spark, folder):
    meta = sample.meta(spark, folder)
    return changes.without(meta, meta.filter("chunk_id % 6 = 0")).select("chunk_id")


# answers

HITS_SQL = f"""{META_SQL}, {PROBE},
    h AS (SELECT chunk_id, rel_path, snippet, {SCORE} AS score FROM vectors JOIN meta USING (chunk_id, index_kind), q WHERE index_kind = 'text' ORDER BY score DESC, chunk_id LIMIT 10),
    r AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS n, CASE WHEN snippet = '' THEN '(no snippet)' ELSE snippet END AS shown FROM h)"""


def _hits(spark, folder):
    hits, _ = retrieval.run(sample.vectors(spark, folder), sample.meta(spark, folder), retrieval.Search(index="text"), lambda text, kind: sample.probe(spark, folder))
    return answers.gathered(hits)


@query("fallback_answer", f"WITH {HITS_SQL} SELECT 'Question: why?' || chr(10) || 'Top context:' || chr(10) || string_agg('- ' || rel_path || ': ' || shown, chr(10) ORDER BY n) AS answer FROM r WHERE n <= 5")
def fallback_answer(spark, folder):
    return _hits(spark, folder).select(answers.fallback(F.lit("why?"), F.col("hits")).alias("answer"))


@query(
    "rag_prompt",
    f"""WITH {HITS_SQL}, l AS (SELECT n, '- [' || rel_path || '] ' || shown || chr(10) AS line FROM r WHERE n <= 8), b AS (SELECT n, line, 900 - coalesce(sum(length(line)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM l),
    c AS (SELECT n, CASE WHEN room <= 0 THEN '' WHEN length(line) <= room THEN line WHEN room <= 3 THEN line[1:room::BIGINT] ELSE line[1:(room - 3)::BIGINT] || '...' END AS part FROM b)
    SELECT 'Be brief.' || chr(10) || chr(10) || 'Question:' || chr(10) || 'why?' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg(part, '' ORDER BY n) AS prompt FROM c""",
)
def rag_prompt(spark, folder):
    return _hits(spark, folder).select(answers.prompt(F.lit("why?"), F.col("hits"), "Be brief. ", 900).alias("prompt"))


@query(
    "ensure_attributions",
    f"""WITH {HITS_SQL}, a AS (SELECT 'See [' || (SELECT rel_path FROM r WHERE n = 2) || '].' AS answer), m AS (SELECT rel_path, min(n) AS n FROM r GROUP BY rel_path),
    x AS (SELECT '[' || rel_path || ']' AS tag, n FROM m, a WHERE NOT contains(answer, '[' || rel_path || ']') ORDER BY n LIMIT 5)
    SELECT answer || chr(10) || chr(10) || 'Sources: ' || (SELECT string_agg(tag, ', ' ORDER BY n) FROM x) AS answer FROM a""",
)
def ensure_attributions(spark, folder):
    hits = _hits(spark, folder)
    paths = F.transform("hits", lambda h: h["rel_path"])
    return hits.select(answers.attributed(F.concat(F.lit(" See ["), F.get(paths, F.lit(1)), F.lit("].")), F.concat(paths, paths)).alias("answer"))


# opened sources


@query(
    "open_lines",
    f"""WITH {FILES_SQL}, l AS (SELECT doc_id, string_split(content, chr(10)) AS l FROM files) SELECT doc_id, CASE WHEN len(l) < 2 THEN '' ELSE array_to_string(l[2:4], chr(10)) END AS part, array_to_string(l[1:1], chr(10)) AS first FROM l""",
)
def open_lines(spark, folder):
    c = F.col("content")
    return sample.files(spark, folder).select("doc_id", T.slice_lines(c, 2, 4).alias("part"), T.slice_lines(c, -3, 0).alias("first"))


@query(
    "open_page",
    f"""WITH {FILES_SQL}, p AS (SELECT doc_id, replace(content, chr(10) || chr(10), chr(12)) AS c FROM files), s AS (SELECT doc_id, c, string_split(replace(c, chr(10), chr(12)), chr(12)) AS l FROM p)
    SELECT doc_id, CASE WHEN len(l) = 1 THEN NULL WHEN len(l) < 2 THEN NULL ELSE trim(l[2], chr(10)) END AS second, CASE WHEN len(l) = 1 THEN l[1] ELSE trim(l[1], chr(10)) END AS first FROM s""",
)
def open_page(spark, folder):
    c = F.translate(F.replace(F.col("content"), F.lit("\n\n"), F.lit("\f")), "\n", "\f")
    return sample.files(spark, folder).select("doc_id", T.slice_page(c, 2).alias("second"), T.slice_page(c, 0).alias("first"))


@query(
    "open_time",
    f"""WITH {TALKS_SQL}, l AS (SELECT conv_id, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM talks)
    SELECT conv_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE l[2:3]::INT * 60 + l[5:6]::INT BETWEEN 14 AND 28), '') AS part FROM l GROUP BY conv_id""",
)
def open_time(spark, folder):
    return sample.talks(spark, folder).select("conv_id", T.slice_time(F.col("body"), 14_000, 28_000).alias("part"))


@query(
    "overlap_chunks",
    f"""WITH {SEGMENTS_SQL} SELECT conv_id, string_agg({trimmed('text')}[1:240], chr(10) ORDER BY start_ms, seg) AS content FROM ends WHERE start_ms <= 20000 AND end_ms >= 9000 GROUP BY conv_id""",
)
def overlap_chunks(spark, folder):
    rows = chunking.transcript_segments(sample.talks(spark, folder), "conv_id", "body")
    span = corpus.decoded_span(F.lit("time"), F.col("start_ms").cast("int"), F.col("end_ms").cast("int"))
    meta = rows.select(F.col("conv_id").alias("rel_path"), F.col("seg").alias("chunk_id"), T.snippet(F.col("text")).alias("snippet"), span.alias("span"))
    wanted = meta.select("rel_path").distinct().withColumn("from_ms", F.lit(9000)).withColumn("to_ms", F.lit(20000))
    return opening.times_from_chunks(meta, wanted).select(F.col("rel_path").alias("conv_id"), "content")


@query(
    "overlap_many_ranges",
    f"""WITH {SEGMENTS_SQL}, w AS (SELECT DISTINCT conv_id, 7000 * turn - 3000 AS a, 7000 * turn + 5000 * (turn % 30) AS b FROM conversations WHERE turn > 0)
    SELECT conv_id, a::INTEGER AS from_ms, b::INTEGER AS to_ms, count(*) AS n, sum(seg)::BIGINT AS segs FROM w JOIN ends USING (conv_id)
    WHERE start_ms <= CASE WHEN b <= 0 OR b < a THEN a ELSE b END AND end_ms >= a AND {trimmed('text')} <> '' GROUP BY ALL""",
)
def overlap_many_ranges(spark, folder):
    """A range for every turn of a recording, each with the segments that it overlaps."""
    rows = chunking.transcript_segments(sample.talks(spark, folder), "conv_id", "body")
    chunks = rows.filter(T.trim(F.col("text")) != "").select(F.col("conv_id").alias("rel_path"), "seg", F.col("start_ms").cast("int"), F.col("end_ms").cast("int"))
    turns = table(spark, folder, "conversations").filter("turn > 0").select(F.col("conv_id").alias("rel_path"), (F.col("turn") * 7000 - 3000).cast("int").alias("from_ms"), (F.col("turn") * 7000 + F.col("turn") % 30 * 5000).cast("int").alias("to_ms"))
    found = opening.overlapping(chunks, turns.distinct()).groupBy("rel_path", "from_ms", "to_ms").agg(F.count("*").alias("n"), F.sum("seg").alias("segs"))
    return found.withColumnRenamed("rel_path", "conv_id")


@query("flatten_json", "SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS lines FROM events")
def flatten_json(spark, folder):
    return table(spark, folder, "events").select("event_id", annotations.flatten_json("props").alias("lines"))


# keyed state


@query(
    "session_inactivity",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n, epoch(min(ts))::BIGINT AS first_s, epoch(max(ts))::BIGINT AS last_s FROM s GROUP BY ALL""",
)
def session_inactivity(spark, folder):
    rows = state.sessions(table(spark, folder, "events"), "user_id", "ts")
    seconds = lambda c: F.round(F.unix_micros(F.col(c).cast("timestamp")) / 1e6).cast("long")
    return rows.select("user_id", "session", "n", seconds("first_ts").alias("first_s"), seconds("last_ts").alias("last_s"))


@query(
    "token_bucket",
    """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT event_id, user_id, t, i, 4.0::DOUBLE AS tokens, true AS allowed FROM o WHERE i = 1
          UNION ALL SELECT event_id, user_id, t, i, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1
          FROM (SELECT o.event_id, o.user_id, o.t, o.i, least(5.0::DOUBLE, r.tokens + (o.t - r.t) * (1.0::DOUBLE / 3600)) AS have FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
    SELECT event_id, user_id, allowed OR user_id IS NULL AS allowed FROM r""",
)
def token_bucket(spark, folder):
    return state.rate_limited(table(spark, folder, "events"), "user_id", "ts", rps=1 / 3600, burst=5, ident="event_id")


@query(
    "idempotent_outcomes",
    """WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events WHERE true GROUP BY ALL) SELECT e.event_id AS call_id, e.user_id || ':' || e.event_type AS key, f AS executed_by, e.event_id <> f AS replayed FROM events e JOIN f USING (user_id, event_type)""",
)
def idempotent_outcomes(spark, folder):
    calls = table(spark, folder, "events").select(F.col("event_id").alias("call_id"), F.concat("user_id", F.lit(":"), "event_type").alias("key"), F.col("event_id").alias("ts"))
    return state.settled_once(calls)


@query(
    "session_lifetimes",
    """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
    c AS (SELECT 6 * 3600000000::BIGINT AS gap, 24 * 3600000000::BIGINT AS life),
    r AS (SELECT user_id, t, i, t AS first, 1::BIGINT AS session FROM o WHERE i = 1
          UNION ALL SELECT o.user_id, o.t, o.i, CASE WHEN o.t > least(r.t + gap, r.first + life) THEN o.t ELSE r.first END, r.session + CASE WHEN o.t > least(r.t + gap, r.first + life) THEN 1 ELSE 0 END
          FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1, c),
    s AS (SELECT user_id, session, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM r GROUP BY ALL)
    SELECT user_id, session, first_us, last_us, n, CASE WHEN first_us + life < last_us + gap THEN CASE WHEN (SELECT max(t) FROM o) > first_us + life THEN 'max-lifetime' END WHEN (SELECT max(t) FROM o) > last_us + gap THEN 'inactivity' END AS reason FROM s, c""",
)
def session_lifetimes(spark, folder):
    return state.expiring_sessions(table(spark, folder, "events"), "user_id", "ts", gap_s=6 * 3600, life_s=24 * 3600)


@query(
    "settled_within_ttl",
    """WITH RECURSIVE o AS (SELECT event_id, user_id || ':' || event_type AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id || ':' || event_type ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT event_id, key, i, t, event_id AS executed_by FROM o WHERE i = 1
          UNION ALL SELECT o.event_id, o.key, o.i, CASE WHEN o.t - r.t > 43200000000 THEN o.t ELSE r.t END, CASE WHEN o.t - r.t > 43200000000 THEN o.event_id ELSE r.executed_by END
          FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)
    SELECT event_id AS call_id, key, executed_by, event_id <> executed_by AS replayed FROM r""",
)
def settled_within_ttl(spark, folder):
    """A key's calls within half a day of the one that was executed get its outcome."""
    calls = table(spark, folder, "events").select(F.col("event_id").alias("call_id"), F.concat("user_id", F.lit(":"), "event_type").alias("key"), "ts")
    return state.replays(calls.filter("key IS NOT NULL"), 12 * 3600)


@query("outcomes_pruned", "SELECT event_id AS key FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500 ORDER BY event_id DESC LIMIT 200")
def outcomes_pruned(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_id").alias("key"), F.col("event_id").alias("ts"))
    now = rows.agg(F.max("ts")).first()[0] or 0
    return state.outcomes_kept(rows, now, 500, 200).select("key")


@query("embed_pending", f"WITH {CHUNKS_SQL} SELECT index_kind, chunk_id, 64::INTEGER AS dimension, 1.0::DOUBLE AS norm FROM chunks WHERE embedding_status = 'pending'")
def embed_pending(spark, folder):
    chunks = sample.chunks(spark, folder).filter("embedding_status = 'pending'")
    vectors, _ = worker.embed_batch(chunks, HashedWords)
    return vectors.select("index_kind", "chunk_id", F.size("embedding").alias("dimension"), F.round(V.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm"))


# values at the edges


@query(
    "archive_formats",
    f"""WITH {FILES_SQL}, a AS (SELECT doc_id, rel_path || CASE doc_id % 7 WHEN 0 THEN '.zip' WHEN 1 THEN '.TAR.GZ' WHEN 2 THEN '.tgz' WHEN 3 THEN '.tar.bz2' WHEN 4 THEN '.tar' WHEN 5 THEN '.7z' ELSE '.gz' END AS p FROM files)
    SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'zip' WHEN 1 THEN 'tar.gz' WHEN 2 THEN 'tar.gz' WHEN 3 THEN 'tar.bz2' WHEN 4 THEN 'tar' END AS format FROM a""",
)
def archive_formats(spark, folder):
    endings = F.array(*(F.lit(e) for e in (".zip", ".TAR.GZ", ".tgz", ".tar.bz2", ".tar", ".7z", ".gz")))
    path = F.concat("rel_path", F.get(endings, (F.col("doc_id") % 7).cast("int")))
    return sample.files(spark, folder).select("doc_id", archives.format_of(path).alias("format"))


@query("payment_keys", "SELECT event_id, 'sig-' || user_id || ':' || sha256(coalesce(props, '')) AS key FROM events")
def payment_keys(spark, folder):
    rows = table(spark, folder, "events")
    return rows.select("event_id", T.payment_key(F.concat(F.lit("sig-"), "user_id"), F.coalesce("props", F.lit(""))).alias("key"))


@query("json_in_output", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS object FROM events")
def json_in_output(spark, folder):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("none {"), "event_type")).otherwise(F.concat(F.lit("Here it is:\n"), "props", F.lit("\nDone.")))
    return table(spark, folder, "events").select("event_id", T.json_object_in(raw).alias("object"))


@query("network_ids", "SELECT user_id, event_id, event_id % 4 IN (0, 3) AS valid FROM events")
def network_ids(spark, folder):
    kind = F.col("event_id") % 4
    name = F.when(kind == 0, F.concat(F.lit("eip155:"), "user_id")).when(kind == 1, F.concat(F.lit("EIP155:"), "user_id")).when(kind == 2, "event_type").otherwise(F.concat(F.lit("a:"), "event_type"))
    return table(spark, folder, "events").select("user_id", "event_id", T.is_caip2(name).alias("valid"))


@query(
    "span_rendering",
    f"""WITH {CHUNKS_SQL} SELECT chunk_id, CASE chunk_id % 3 WHEN 0 THEN 'page:' || start_line WHEN 1 THEN 'time:' || start_line || '-' || end_line ELSE 'lines:' || start_line || '-' || end_line END AS printed,
       CASE chunk_id % 3 WHEN 0 THEN '{{"kind":"page","page":' || start_line || '}}' WHEN 1 THEN '{{"kind":"time","start_ms":' || start_line || ',"end_ms":' || end_line || '}}'
       ELSE '{{"kind":"lines","start_line":' || start_line || ',"end_line":' || end_line || '}}' END AS json FROM chunks""",
)
def span_rendering(spark, folder):
    rows = sample.chunks(spark, folder)
    kind = F.when(F.col("chunk_id") % 3 == 0, " Page").when(F.col("chunk_id") % 3 == 1, "TIME").otherwise("lines")
    span = corpus.decoded_span(kind, F.col("span.start"), F.col("span.end"))
    return rows.select("chunk_id", corpus.printed_span(span).alias("printed"), corpus.span_json(span).alias("json"))


@query("annotation_chunks", "SELECT 'events/' || event_id AS rel_path, 0::INTEGER AS ordinal, sha256('k: ' || json_extract_string(props, '$.k')) AS text_hash, 'text' AS index_kind FROM events")
def annotation_chunks(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("events/"), "event_id").alias("rel_path"), F.lit("data").alias("doc_type"), F.col("props").alias("json"))
    _, chunks, _ = annotations.store(rows)
    return chunks.select("rel_path", "ordinal", "text_hash", "index_kind")


@query("archive_members")
def archive_members(spark, folder):
    """Every page in a ZIP of its own, opened again."""
    import io
    import zipfile

    @F.pandas_udf("binary")
    def packed(html):
        out = []
        for text in html:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                z.writestr("page.html", text or "")
                z.writestr("../out.html", "x")
            out.append(buffer.getvalue())
        return type(html)(out)

    files = table(spark, folder, "pages").select(F.concat(F.lit("p"), "page_id", F.lit(".zip")).alias("rel_path"), packed("html").alias("content"), F.lit(0).cast("long").alias("mtime_unix"))
    return archives.extracted(files).select("rel_path", "size_bytes", T.sha256(F.col("content")).alias("content_hash"))


ORACLES["archive_members"] = "SELECT 'p' || page_id || '.zip/page.html' AS rel_path, strlen(coalesce(html, ''))::BIGINT AS size_bytes, sha256(coalesce(html, '')) AS content_hash FROM pages"
