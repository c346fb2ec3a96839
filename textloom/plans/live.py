"""Queries over a corpus that is really there: the documents written as files, scanned, embedded, and asked through its tools.

The corpus is made once for a session and a folder of tables, in the folder that driver and executors share; executors write the
files. It has every document, an ignore file at its root and one in a folder.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tools
from ..corpus import Backends, Corpus, Settings
from ..functions import globs
from ..operators import corpus as operators
from ..operators import listing
from ..session import brief_shuffles, shared_folder
from ..sources import discover
from . import sample
from .catalogue import query
from .sample import CHUNKS_SQL, FILES_SQL, trimmed

IGNORED = {".gitignore": "# one source, whole\n/src19/\n", "src3/.gitignore": "*.html\n"}
_MADE: dict[tuple[str, str], Corpus] = {}

SECRETS = r"""regexp_matches(content[1:65536], 'AKIA[0-9A-Z]{16}|sk_[a-z0-9]{32}|api_[A-Za-z0-9]{32}') OR regexp_matches(content[1:65536], '(?i)token\s*[:=]\s*[A-Za-z0-9_.-]{20,}')
       OR regexp_matches(content[1:65536], '(?i)(?:aws(?:[_\s.]{0,20})?secret(?:[_\s.]*(?:access[_\s.]*)?key)?|secret[_\s.]*access[_\s.]*key)\s*[:=]\s*[0-9A-Za-z/+=]{20,}')
       OR regexp_matches(content[1:65536], '(?i)(?:authorization\s*[:=]\s*bearer\s+|(?:access|id|refresh)_token\s*[:=]\s*)[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}')"""
#: SQL: the files that are found, with the status that a scan gives them; deleted stands for all that has no text in the corpus.
LIVE_FILES = f"""{FILES_SQL.replace("files AS", "all_files AS")},
    found AS (SELECT doc_id, content, rel_path, doc_type, size_bytes FROM all_files WHERE NOT starts_with(rel_path, 'src19/') AND NOT (starts_with(rel_path, 'src3/') AND doc_type = 'html')),
    files AS (SELECT *, status <> 'ok' AS deleted FROM (SELECT *, CASE WHEN doc_type = 'binary_ignored' THEN 'skipped' WHEN doc_type IN ('code', 'text', 'md', 'data', 'html') AND ({SECRETS}) THEN 'secret_excluded' ELSE 'ok' END AS status FROM found))"""
LIVE_CHUNKS = CHUNKS_SQL.replace(FILES_SQL, LIVE_FILES)


def write_files(files: DataFrame, root: str) -> int:
    """rel_path, content as files below a folder, written by all cores; how many."""
    at, cores = discover.mounted(root), files.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = os.path.join(at, path)
                if (parent := os.path.dirname(own)) not in made:
                    os.makedirs(parent, exist_ok=True)
                    made.add(parent)
                with open(own, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    with brief_shuffles(files.sparkSession):
        return files.select("rel_path", "content").repartition(cores).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def made(spark: SparkSession, folder: str) -> Corpus:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MADE or not _MADE[key].store.has("documents"):  # its folder may have been cleared
        base = f"{shared_folder(spark)}/textloom/corpus-{uuid.uuid4().hex}"
        write_files(sample.files(spark, folder).filter("rel_path IS NOT NULL"), f"{base}/root")
        write_files(spark.createDataFrame(list(IGNORED.items()), "rel_path string, content string"), f"{base}/root")
        own = Corpus(spark, f"{base}/root", f"{base}/state", settings=Settings(snapshot_s=0))
        own.scan()
        own.embed()
        own.store.expire(keep=1, readable_s=0)  # nobody has read what it held before it was embedded
        _MADE[key] = own
    return _MADE[key]


@query("live_files", f"WITH {LIVE_FILES} SELECT rel_path, size_bytes::BIGINT AS size_bytes FROM found UNION ALL VALUES ('.gitignore', {len(IGNORED['.gitignore'])}), ('src3/.gitignore', {len(IGNORED['src3/.gitignore'])})")
def live_files(spark, folder):
    return made(spark, folder).listed().select("rel_path", "size_bytes")


DOCUMENTS = f"""SELECT rel_path, doc_type, status, sha256(content) AS content_hash FROM files
    UNION ALL VALUES ('.gitignore', 'binary_ignored', 'skipped', sha256('{IGNORED[".gitignore"]}')), ('src3/.gitignore', 'binary_ignored', 'skipped', sha256('{IGNORED["src3/.gitignore"]}'))"""


@query("live_documents", f"WITH {LIVE_FILES} {DOCUMENTS}")
def live_documents(spark, folder):
    return made(spark, folder).store.read("documents").filter("NOT deleted").select("rel_path", "doc_type", "status", "content_hash")


@query("live_chunks", f"WITH {LIVE_CHUNKS} SELECT rel_path, ordinal, sha256(text) AS text_hash, index_kind, 'ok' AS embedding_status, 'lines:' || start_line || '-' || end_line AS span, true AS has_vector FROM chunks")
def live_chunks(spark, folder):
    """Chunks, spans and vectors, from the buckets that they lie in."""
    chunks, spans, vectors = made(spark, folder).store.bucketed("chunks", "spans", "vectors")
    own = listing.with_span(listing.live(chunks).filter("rep_type = 'raw_text'"), spans)
    joined = own.join(vectors.select("chunk_id", "index_kind", F.lit(True).alias("has_vector")), ["chunk_id", "index_kind"], "left")
    return joined.select("rel_path", "ordinal", "text_hash", "index_kind", "embedding_status", operators.printed_span(F.col("span")).alias("span"), F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


@query("live_pages", f"WITH {LIVE_FILES}, t AS (SELECT rel_path, {trimmed('content')} AS t FROM files WHERE doc_type = 'pdf') SELECT rel_path, 0::INTEGER AS ordinal, sha256(t) AS text_hash, 'page:1' AS span FROM t WHERE t <> ''")
def live_pages(spark, folder):
    """What the recogniser of pages made of the files that it takes."""
    store = made(spark, folder).store
    rows = listing.with_span(listing.live(store.read("chunks")).filter("rep_type = 'ocr_markdown'"), store.read("spans"))
    return rows.select("rel_path", "ordinal", "text_hash", operators.printed_span(F.col("span")).alias("span"))


@query("live_search", f"WITH {LIVE_CHUNKS}, q AS (SELECT min(rel_path) AS p FROM files WHERE NOT deleted AND doc_type = 'md') SELECT rel_path, ordinal FROM chunks, q WHERE rel_path = p")
def live_search(spark, folder):
    """A search that one file alone passes finds all of its chunks."""
    own = made(spark, folder)
    path = own.store.read("documents").filter("NOT deleted AND status = 'ok' AND doc_type = 'md'").agg(F.min("rel_path")).first()[0]
    hits = tools.call(own, "search", {"query": "what is said here", "k": 50, "index": "text", "file_glob": globs.escape_literal(path or "")})["hits"]
    found = spark.createDataFrame([(h["chunk_id"],) for h in hits], "chunk_id long")
    return own.store.read("chunks").join(F.broadcast(found), "chunk_id", "left_semi").select("rel_path", "ordinal")


@query(
    "tool_stats",
    f"""WITH {LIVE_CHUNKS}, d AS ({DOCUMENTS}), n AS (SELECT (SELECT count(*) FROM chunks) + (SELECT count(*) FROM files WHERE doc_type = 'pdf' AND {trimmed('content')} <> '') AS chunks)
    SELECT (SELECT count(*) FROM d) AS scanned, (SELECT count(*) FROM d WHERE status = 'ok') AS indexed, (SELECT count(*) FROM d WHERE status = 'skipped') AS skipped, 0::BIGINT AS deleted, 0::BIGINT AS errors,
       (SELECT count(*) FROM files WHERE NOT deleted) AS representations, (SELECT string_agg(doc_type || '=' || c, ',' ORDER BY doc_type) FROM (SELECT doc_type, count(*) AS c FROM d GROUP BY 1)) AS doc_counts, true AS all_embedded, false AS running""",
)
def tool_stats(spark, folder):
    shown = tools.call(made(spark, folder), "stats")
    counts = ",".join(f"{k}={n}" for k, n in sorted(shown["doc_counts"].items()))
    indexing = shown["indexing"]
    row = [*(indexing[n] for n in ("scanned", "indexed", "skipped", "deleted", "errors", "representations")), counts, indexing["embedded_ok"] == indexing["chunks_total"] > 0, indexing["running"]]
    return spark.createDataFrame([tuple(row)], "scanned long, indexed long, skipped long, deleted long, errors long, representations long, doc_counts string, all_embedded boolean, running boolean")


@query("tool_list_files", f"WITH {LIVE_FILES}, d AS (SELECT * FROM ({DOCUMENTS}) WHERE starts_with(rel_path, 'src1')) SELECT rel_path, doc_type, CASE WHEN status IN ('skipped', 'error') THEN status ELSE 'ok' END AS status, (SELECT count(*) FROM d) AS total FROM d ORDER BY rel_path LIMIT 40 OFFSET 20")
def tool_list_files(spark, folder):
    shown = tools.call(made(spark, folder), "list_files", {"path_prefix": "src1", "limit": 40, "offset": 20})
    return spark.createDataFrame([(f["rel_path"], f["doc_type"], f["status"], shown["total"]) for f in shown["files"]], "rel_path string, doc_type string, status string, total long")


FIRST_OF_KIND = "f AS (SELECT doc_type, min(rel_path) AS rel_path FROM files WHERE NOT deleted AND doc_type IN ('code', 'text', 'md', 'data', 'html') GROUP BY doc_type)"


@query(
    "tool_open_file",
    f"""WITH {LIVE_FILES}, {FIRST_OF_KIND}, l AS (SELECT f.rel_path, string_split(content, chr(10)) AS l FROM f JOIN files USING (rel_path))
    SELECT rel_path, CASE WHEN len(l) < 2 THEN '' ELSE array_to_string(l[2:4], chr(10)) END AS content FROM l WHERE length(array_to_string(l[2:4], chr(10))) <= 20000""",
)
def tool_open_file(spark, folder):
    """Lines 2 to 4 of the first file of each kind that has text."""
    own = made(spark, folder)
    first = own.store.read("documents").filter("NOT deleted AND status = 'ok' AND doc_type IN ('code', 'text', 'md', 'data', 'html')").groupBy("doc_type").agg(F.min("rel_path").alias("rel_path"))
    rows = [(r.rel_path, tools.call(own, "open_file", {"rel_path": r.rel_path, "start_line": 2, "end_line": 4})) for r in first.collect()]
    return spark.createDataFrame([(path, out["content"]) for path, out in rows if not out["truncated"]], "rel_path string, content string")


ANSWER = f"""WITH {LIVE_CHUNKS}, single AS (SELECT rel_path, any_value({trimmed('text')}) AS t FROM chunks WHERE doc_type = 'text' GROUP BY rel_path HAVING count(*) = 1), first AS (SELECT rel_path, t[1:240] AS s FROM single WHERE rel_path = (SELECT min(rel_path) FROM single)),
    given AS (SELECT rel_path AS citation, 'Question: why?' || chr(10) || 'Top context:' || chr(10) || '- ' || rel_path || ': ' || s || chr(10) || chr(10) || 'Sources: [' || rel_path || ']' AS answer FROM first)"""


def asked(own: Corpus, tool: str) -> dict:
    """A question to the first text file of one chunk."""
    single = listing.live(own.store.read("chunks")).filter("doc_type = 'text'").groupBy("rel_path").count().filter("count = 1")
    path = single.agg(F.min("rel_path")).first()[0]
    return tools.call(own, tool, {"question": "why?", "index": "text", "file_glob": globs.escape_literal(path or "")})


@query("tool_ask", f"{ANSWER} SELECT citation, answer, true AS indexing_complete FROM given")
def tool_ask(spark, folder):
    """Answered without a model."""
    out = asked(made(spark, folder), "ask")
    return spark.createDataFrame([(c["rel_path"], out["answer"], out["indexing_complete"]) for c in out["citations"]], "citation string, answer string, indexing_complete boolean")


@query("tool_ask_audio", f"{ANSWER} SELECT citation, answer, upper(hex(encode(answer))) AS voiced FROM given")
def tool_ask_audio(spark, folder):
    """Spoken by a voice that says its text's bytes."""
    own = made(spark, folder)
    out = asked(Corpus(spark, own.root, own.store.folder, Backends(voice=lambda text, voice: text.encode())), "ask_audio")
    return spark.createDataFrame([(c["rel_path"], out["answer"], base64.b64decode(out["audio_base64"]).hex().upper()) for c in out["citations"]], "citation string, answer string, voiced string")


@query(
    "tool_transcribe",
    f"""WITH {LIVE_FILES}, t AS (SELECT rel_path, {trimmed('content')} AS t FROM files WHERE doc_type = 'audio'), q AS (SELECT * FROM t WHERE rel_path = (SELECT min(rel_path) FROM t WHERE length(t) BETWEEN 1 AND 1000))
    SELECT rel_path, 0::BIGINT AS start_ms, greatest(1000, 300 * len(list_filter(string_split_regex(t, '{sample.SPACE_SQL}+'), lambda x: x <> '')))::BIGINT AS end_ms, sha256(t) AS text_hash, false AS made_now FROM q""",
)
def tool_transcribe(spark, folder):
    """The first short recording, whose transcript the scan has made."""
    own = made(spark, folder)
    known = listing.live(own.store.read("chunks")).filter("rep_type = 'transcript'").groupBy("rel_path").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("length"))
    path = known.filter("n = 1 AND length <= 1000").agg(F.min("rel_path")).first()[0]
    out = tools.call(own, "transcribe", {"rel_path": path}) if path else {"segments": []}
    rows = [(path, s["start_ms"], s["end_ms"], s["text"], out["transcribed_now"]) for s in out["segments"]]
    made_of = spark.createDataFrame(rows, "rel_path string, start_ms long, end_ms long, text string, made_now boolean")
    return made_of.select("rel_path", "start_ms", "end_ms", F.sha2("text", 256).alias("text_hash"), "made_now")


@query(
    "tool_annotate",
    f"""WITH {LIVE_FILES}, f AS (SELECT min(rel_path) AS p FROM files WHERE doc_type = 'code' AND NOT deleted) SELECT rel_path, 'lang: ' || split_part(rel_path, '/', 2) || chr(10) || 'of[0]: ' || split_part(rel_path, '/', 1) AS text, 1::BIGINT AS n FROM files, f WHERE rel_path = p""",
)
def tool_annotate(spark, folder):
    """An annotation of the first file of code, in a state of its own."""
    first = made(spark, folder)
    own = Corpus(spark, first.root, f"{first.store.folder}-{uuid.uuid4().hex}")
    own.store.write(documents=first.store.read("documents"))
    path = own.store.read("documents").filter("doc_type = 'code' AND status = 'ok'").agg(F.min("rel_path")).first()[0]
    source, lang, _ = path.split("/")
    tools.call(own, "annotate", {"rel_path": path, "annotation": f'{{"of": ["{source}"], "lang": "{lang}"}}'})
    chunks = own.store.read("chunks")
    return chunks.groupBy("rel_path", "text").agg(F.count("*").alias("n"))
