"""More registered queries: stores, caches, sinks and the functions at the edges of a corpus, each with its SQL."""

from __future__ import annotations

import io
import tarfile
import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .. import schemas
from ..functions import classify, globs, net, secrets
from ..functions import text as T
from ..operators import annotations, changes, corpus, listing, opening, retrieval
from ..operators import vectors as V
from ..session import shared_folder
from ..sources import archives, store
from . import sample
from .catalogue import query, table
from .sample import CHUNKS_SQL, FILES_SQL, VECTORS_SQL


def _events(spark, folder):
    return table(spark, folder, "events")


@query(
    "flatten_nested_json",
    r"""SELECT event_id, repeat('d[0].', event_id % 6 + 1) || 'e[1]: ' || regexp_replace(((event_id % 100) / 8.0)::VARCHAR, '[.]0$', '') || chr(10) || repeat('d[0].', event_id % 6 + 1) || 'e[2]: null' || chr(10) ||
       repeat('d[0].', event_id % 6 + 1) || 'p.k: ' || json_extract_string(props, '$.k') || chr(10) || repeat('d[0].', event_id % 6 + 1) || 't: ' || event_type || chr(10) || 'u: ' || user_id AS lines FROM events""",
)
def flatten_nested_json(spark, folder):
    """Objects in lists in objects, one to six times. Rows in fewer parts than there are cores are dealt first, as a row takes long."""
    times = (F.col("event_id") % 6 + 1).cast("int")
    inner = F.concat(F.lit('{"t": " '), "event_type", F.lit(' ", "p": '), "props", F.lit(', "e": [" ", '), (F.col("event_id") % 100 / 8).cast("string"), F.lit(", null]}"))
    nested = F.concat(F.repeat(F.lit('{"d": ['), times - 1), F.lit('{"d": ['), inner, F.lit("]}"), F.repeat(F.lit("]}"), times - 1))
    json = F.concat(F.regexp_replace(nested, r"\}$", ', "u": '), "user_id", F.lit("}"))
    rows, cores = _events(spark, folder).select("event_id", "user_id", "event_type", "props"), spark.sparkContext.defaultParallelism
    dealt = rows.repartition(3 * cores, "event_id") if rows.rdd.getNumPartitions() < cores else rows
    return dealt.select("event_id", annotations.flatten_json(json).alias("lines"))


@query(
    "fallback_counts",
    f"""WITH {FILES_SQL} SELECT count(*) AS scanned, count(*) FILTER (WHERE NOT deleted AND status NOT IN ('skipped', 'error')) AS indexed, count(*) FILTER (WHERE NOT deleted AND status = 'skipped') AS skipped,
       count(*) FILTER (WHERE deleted) AS deleted, count(*) FILTER (WHERE NOT deleted AND status = 'error') AS errors, count(*) FILTER (WHERE NOT deleted) AS total_docs,
       (SELECT string_agg(doc_type || '=' || n, ',' ORDER BY doc_type) FROM (SELECT doc_type, count(*) AS n FROM files WHERE NOT deleted GROUP BY doc_type)) AS doc_counts FROM files""",
)
def fallback_counts(spark, folder):
    stats = listing.fallback_stats(sample.files(spark, folder))
    return stats.withColumn("doc_counts", F.array_join(F.transform(F.map_entries("doc_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query(
    "derived_counts",
    f"""WITH {FILES_SQL}, s AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'Indexed ' WHEN 1 THEN 'secret_excluded' ELSE status END AS st FROM files)
    SELECT count(*) AS scanned, count(*) FILTER (WHERE NOT deleted AND st IN ('ok', 'Indexed ')) AS indexed, count(*) FILTER (WHERE NOT deleted AND st = 'skipped') AS skipped,
       count(*) FILTER (WHERE NOT deleted AND st = 'error') AS errors, count(*) FILTER (WHERE NOT deleted AND st IN ('', 'secret_excluded')) AS unknown, count(*) FILTER (WHERE deleted) AS deleted, -1::BIGINT AS representations FROM s""",
)
def derived_counts(spark, folder):
    """A store with documents alone: statuses that nothing expects are unknown."""
    status = F.when(F.col("doc_id") % 4 == 0, "Indexed ").when(F.col("doc_id") % 4 == 1, "secret_excluded").otherwise(F.col("status"))
    return listing.derived_stats(sample.files(spark, folder).withColumn("status", status)).drop("total_docs", "doc_counts", "chunks_total", "embedded_ok")


@query(
    "observed_counts",
    f"""WITH {FILES_SQL} SELECT count(*) AS scanned, count(*) FILTER (WHERE status = 'ok') AS indexed, count(*) FILTER (WHERE status IN ('skipped', 'secret_excluded')) AS skipped, count(*) FILTER (WHERE status = 'error') AS errors FROM files""",
)
def observed_counts(spark, folder):
    """Counters that come with a write, without a pass of their own."""
    counters = Observation("scan")
    listing.observed(sample.files(spark, folder), counters).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([counters.get], "scanned long, indexed long, skipped long, errors long")


@query("listed_status", f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN status IN ('skipped', 'error') THEN status ELSE 'ok' END AS status FROM files")
def listed_status(spark, folder):
    padded = F.concat(F.lit(" "), F.upper("status"), F.lit("  "))
    return sample.files(spark, folder).select("doc_id", classify.file_status(padded).alias("status"))


@query("escaped_glob", "SELECT event_id FROM events WHERE user_id = 7")
def escaped_glob(spark, folder):
    """A path of glob signs, escaped, is a filter that matches itself alone."""
    path = F.concat(F.lit("a[x]*?/\\"), F.col("user_id").cast("string"), F.lit(".md"))
    return _events(spark, folder).filter(path.rlike(globs.path_match(globs.escape_literal("a[x]*?/\\7.md")))).select("event_id")


@query(
    "client_addresses",
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '198.51.100.' || user_id % 200 WHEN user_id % 3 = 1 THEN '203.0.113.' || event_id % 250 ELSE '10.0.0.9' END AS address FROM events""",
)
def client_addresses(spark, folder):
    """Of an untrusted peer its own address, of a trusted proxy the last one forwarded that isn't a proxy, or the proxy's."""
    n = F.col("user_id") % 3
    remote = F.when(n == 0, F.concat(F.lit("198.51.100."), F.col("user_id") % 200, F.lit(":443"))).otherwise("10.0.0.9:80")
    forwarded = F.when(n == 2, "10.1.1.1").otherwise(F.concat(F.lit("1.2.3.4, 203.0.113."), F.col("event_id") % 250, F.lit(", 10.7.0.1")))
    return _events(spark, folder).select("event_id", net.client_ips(("10.0.0.0/8",))(remote, forwarded).alias("address"))


@query(
    "encoded_spans",
    """WITH s AS (SELECT event_id, ['lines', 'page', 'time', 'else'][(event_id % 4 + 1)::INTEGER] AS kind, user_id AS a, event_id % 60 AS b FROM events),
    v AS (SELECT *, CASE kind WHEN 'lines' THEN a > 0 AND b >= a WHEN 'page' THEN a > 0 WHEN 'time' THEN a >= 0 AND b >= a ELSE false END AS ok FROM s)
    SELECT event_id, CASE WHEN ok THEN kind END AS kind, CASE WHEN ok THEN a END AS first, CASE WHEN ok AND kind = 'page' THEN a WHEN ok THEN b END AS last FROM v""",
)
def encoded_spans(spark, folder):
    kind = F.get(F.array(*map(F.lit, (" Lines", "PAGE ", "time", "else"))), (F.col("event_id") % 4).cast("int"))
    a, b = F.col("user_id"), F.col("event_id") % 60
    span = F.struct(kind.alias("kind"), a.alias("start_line"), b.alias("end_line"), a.alias("page"), a.alias("start_ms"), b.alias("end_ms"))
    row = _events(spark, folder).select("event_id", corpus.encoded_span(span).alias("s"))
    return row.select("event_id", "s.kind", F.col("s.start").alias("first"), F.col("s.end").alias("last"))


@query(
    "page_chunks_joined",
    """WITH m AS (SELECT 'f' || user_id AS rel_path, event_id % 5 + 1 AS page, event_id, event_type || event_id AS snippet FROM events WHERE event_id < 5000 AND event_type <> 'click')
    SELECT rel_path, page::INTEGER AS page, string_agg(snippet, chr(10) ORDER BY event_id) AS content FROM m WHERE page = 2 AND rel_path IN (SELECT DISTINCT 'f' || user_id FROM events WHERE user_id % 3 = 0) GROUP BY ALL""",
)
def page_chunks_joined(spark, folder):
    rows = _events(spark, folder).filter("event_id < 5000")
    span = corpus.decoded_span(F.lit("page"), (F.col("event_id") % 5 + 1).cast("int"), (F.col("event_id") % 5 + 1).cast("int"))
    snippet = F.when(F.col("event_type") == "click", " ").otherwise(F.concat("event_type", "event_id"))
    meta = rows.select(F.concat(F.lit("f"), "user_id").alias("rel_path"), F.col("event_id").alias("chunk_id"), snippet.alias("snippet"), span.alias("span"))
    wanted = _events(spark, folder).filter("user_id % 3 = 0").select(F.concat(F.lit("f"), "user_id").alias("rel_path"), F.lit(2).alias("page")).distinct()
    return opening.pages_from_chunks(meta, wanted)


@query("secret_sample", "SELECT doc_id, 65400 + doc_id % 160 + 9 + 20 <= 65536 AS secret FROM documents")
def secret_sample(spark, folder):
    """A scan looks at the first 64 KiB of a file: a token counts if 20 characters of it stand within."""
    content = F.concat(F.repeat(F.lit("x"), (F.lit(65400) + F.col("doc_id") % 160).cast("int")), F.lit(" token = "), F.repeat(F.lit("k"), 40))
    return table(spark, folder, "documents").select("doc_id", secrets.sample_has_secret(content).alias("secret"))


@query("searched_paths", "SELECT event_id FROM events WHERE event_id % 10 IN (6, 7, 8, 9)")
def searched_paths(spark, folder):
    """No hit has a blank path or one that is never searched."""
    paths = ("", " \t", "a/.git/x", ".env", "b/node_modules/c/d.js", "keys/id_rsa", "a/.github/x", "env", "my.pem.md", "node_module/x")
    path = F.get(F.array(*map(F.lit, paths)), (F.col("event_id") % 10).cast("int"))
    rows = _events(spark, folder).select("event_id", path.alias("rel_path"), F.lit("md").alias("doc_type"))
    return rows.filter(retrieval.passes(retrieval.Search())).select("event_id")


@query("cleared_hashes", f"WITH {FILES_SQL} SELECT doc_id, 'update' AS action FROM files")
def cleared_hashes(spark, folder):
    """Without hashes everything is processed again."""
    docs = sample.files(spark, folder)
    return changes.changed(changes.clear_hashes(docs), docs).select("doc_id", "action")


@query(
    "vector_upsert",
    f"""WITH {VECTORS_SQL} SELECT index_kind, chunk_id, CASE WHEN chunk_id % 10 = 0 THEN 2 ELSE round(embedding[1]::DOUBLE, 4) END::DOUBLE AS first, CASE WHEN chunk_id % 10 = 0 THEN 1 ELSE len(embedding) END::INTEGER AS size FROM vectors""",
)
def vector_upsert(spark, folder):
    """Of several new vectors of a chunk the last one wins."""
    old = sample.vectors(spark, folder)
    again = old.filter("chunk_id % 10 = 0").select("index_kind", "chunk_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("at"))
    new = again.withColumn("embedding", F.array(F.col("at").cast("float")))
    return V.upsert(old, new).select("index_kind", "chunk_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first"), F.size("embedding").alias("size"))


@query(
    "chunk_upsert",
    f"""WITH {CHUNKS_SQL} SELECT rep_id, ordinal, CASE WHEN rep_id % 4 = 0 AND ordinal < 2 THEN 'pending' ELSE embedding_status END AS embedding_status, CASE WHEN rep_id % 4 = 0 AND ordinal < 2 THEN 'new' ELSE 'old' END AS text FROM chunks""",
)
def chunk_upsert(spark, folder):
    """Chunks by representation and ordinal: new ones replace old ones and wait for their vectors."""
    old = sample.chunks(spark, folder).select("rep_id", "ordinal", "embedding_status", F.lit("old").alias("text"))
    new = old.filter("rep_id % 4 = 0 AND ordinal < 2").withColumn("embedding_status", F.lit("pending")).withColumn("text", F.lit("new"))
    return changes.merge(old, new, schemas.KEYS["chunks"])


@query("rep_upsert", f"WITH {FILES_SQL} SELECT doc_id, t AS rep_type, CASE WHEN doc_id % 3 = 0 AND t = 'raw_text' THEN 'new' ELSE 'old' END AS rep_hash FROM files, (VALUES ('raw_text'), ('transcript')) AS x(t)")
def rep_upsert(spark, folder):
    docs = sample.files(spark, folder).select("doc_id")
    old = docs.select("doc_id", F.explode(F.array(F.lit("raw_text"), F.lit("transcript"))).alias("rep_type"), F.lit("old").alias("rep_hash"))
    new = docs.filter("doc_id % 3 = 0").select("doc_id", F.lit("raw_text").alias("rep_type"), F.lit("new").alias("rep_hash"))
    return changes.merge(old, new, schemas.KEYS["representations"])


@query(
    "read_through_cache",
    """WITH k AS (SELECT doc_id, sha256(coalesce(text, '')) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
    SELECT k.key, CASE WHEN k.key IN (SELECT key FROM c) THEN 'cached' ELSE 'made ' || k.key[1:8] END AS value, count(*) AS n FROM k GROUP BY ALL""",
)
def read_through_cache(spark, folder):
    """Contents by hash: what the cache has comes from it, the rest is made, each content once."""
    wanted = table(spark, folder, "documents").select("doc_id", T.sha256(F.coalesce("text", F.lit(""))).alias("key"))
    cache = wanted.filter("doc_id % 3 = 0").select("key", F.lit("cached").alias("value")).distinct()
    found, _ = store.read_through(cache, wanted, "key", "value", lambda misses: misses.withColumn("value", F.concat(F.lit("made "), F.substring("key", 1, 8))))
    return found.groupBy("key", "value").agg(F.count("*").alias("n"))


@query(
    "tar_members",
    """SELECT 'p' || page_id || f || '/d/page.html' AS rel_path, strlen(coalesce(html, ''))::BIGINT AS size_bytes, sha256(coalesce(html, '')) AS content_hash FROM pages, (VALUES ('.tar'), ('.tar.gz'), ('.tgz'), ('.tar.bz2')) AS x(f)""",
)
def tar_members(spark, folder):
    """Every page in TAR archives of four endings, opened again; members that lead out are left out."""
    modes = {".tar": "w", ".tar.gz": "w:gz", ".tgz": "w:gz", ".tar.bz2": "w:bz2"}

    @F.pandas_udf("binary")
    def packed(ending, html):
        out = []
        for kind, text in zip(ending, html):
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode=modes[kind]) as t:
                for name, data in (("../out.html", b"x"), ("d/page.html", (text or "").encode())):
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
            out.append(buffer.getvalue())
        return type(html)(out)

    pages = table(spark, folder, "pages").select("page_id", "html", F.explode(F.array(*map(F.lit, modes))).alias("ending"))
    files = pages.select(F.concat(F.lit("p"), "page_id", "ending").alias("rel_path"), packed("ending", "html").alias("content"), F.lit(0).cast("long").alias("mtime_unix"))
    return archives.extracted(files).select("rel_path", "size_bytes", T.sha256(F.col("content")).alias("content_hash"))


@query(
    "store_versions",
    """WITH e AS (SELECT 'u' || user_id AS key, count(*)::VARCHAR AS value FROM events GROUP BY user_id) SELECT key, CASE WHEN key = 'u7' THEN 'set' ELSE value END AS value FROM e UNION ALL SELECT 'extra', 'first'""",
)
def store_versions(spark, folder):
    """Settings written, changed, and started with defaults, as a store in the shared folder gives them back."""
    own = store.Store(spark, f"{shared_folder(spark)}/textloom/store-{uuid.uuid4().hex}")
    counts = _events(spark, folder).groupBy(F.concat(F.lit("u"), "user_id").alias("key")).agg(F.count("*").cast("string").alias("value"))
    own.write(settings=counts)
    own.set("u7", "set")
    own.bootstrap({"u7": "default", "extra": "first"})
    own.bootstrap({"extra": "second"})
    return own.read("settings")


@query("snapshot_round_trip", f"WITH {FILES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE doc_type = 'code') AS code, count(*) FILTER (WHERE doc_type = 'code') / count(*)::DOUBLE AS code_ratio FROM files WHERE NOT deleted")
def snapshot_round_trip(spark, folder):
    at = f"{shared_folder(spark)}/textloom/snapshot-{uuid.uuid4().hex}"
    schema = "total long, code long, code_ratio double"
    store.write_snapshot(listing.code_ratio(sample.files(spark, folder)), at)
    return spark.createDataFrame([store.read_snapshot(spark, at, schema)], schema)


@query("event_log", "SELECT event_type AS event, count(*) * 2 AS n, min(event_id) AS first FROM events GROUP BY 1")
def event_log(spark, folder):
    """Events appended twice to a log of JSON lines, and read."""
    at = f"{shared_folder(spark)}/textloom/events-{uuid.uuid4().hex}"
    rows = _events(spark, folder).select("ts", F.lit("info").alias("level"), F.col("event_type").alias("event"), F.struct("event_id", "user_id").alias("data"))
    for _ in range(2):
        store.append_events(rows, at)
    read = spark.read.schema("ts timestamp, level string, event string, data struct<event_id: long, user_id: long>").json(at)
    return read.groupBy("event").agg(F.count("*").alias("n"), F.min("data.event_id").alias("first"))
