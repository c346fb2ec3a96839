"""The tables of a corpus."""

from __future__ import annotations

DOCUMENTS = "doc_id long, rel_path string, doc_type string, source_type string, size_bytes long, mtime_unix long, content_hash string, status string, deleted boolean"
REPRESENTATIONS = "rep_id long, doc_id long, rep_type string, rep_hash string, created_unix long, deleted boolean"
CHUNKS = (
    "chunk_id long, rep_id long, ordinal int, rel_path string, doc_type string, rep_type string, text string, text_hash string, "
    "tokens_est int, index_kind string, embedding_status string, embedding_error string, deleted boolean"
)
SPANS = "span_id long, chunk_id long, span_kind string, start int, end int, extra_json string"
VECTORS = "index_kind string, chunk_id long, embedding array<float>"
SETTINGS = "key string, value string"
#: What recognisers made of contents, by hash (and language); mtime_unix is when.
CACHE = "key string, text string, size_bytes long, mtime_unix long"
SPAN = "struct<kind:string,start_line:int,end_line:int,page:int,start_ms:int,end_ms:int>"
HITS = f"chunk_id long, rel_path string, doc_type string, rep_type string, score double, snippet string, span {SPAN}"
KEYS = {"documents": ["rel_path"], "representations": ["doc_id", "rep_type"], "chunks": ["rep_id", "ordinal"], "spans": ["span_id"], "vectors": ["index_kind", "chunk_id"], "settings": ["key"], "ocr_cache": ["key"], "transcript_cache": ["key"]}
#: By what a table is dealt into parts. Chunks, their spans and their vectors are dealt alike, so that they join where they lie.
PART_KEYS = {"documents": "rel_path", "representations": "doc_id", "chunks": "chunk_id", "spans": "chunk_id", "vectors": "chunk_id", "settings": "key", "ocr_cache": "key", "transcript_cache": "key"}
#: By what the parts of a table are divided further.
PART_FOLDERS = {"vectors": ["index_kind"]}
#: Tables with whole texts, which are packed tighter than the session's setting has it.
TEXTS = ("chunks", "ocr_cache", "transcript_cache")
TABLES = {"documents": DOCUMENTS, "representations": REPRESENTATIONS, "chunks": CHUNKS, "spans": SPANS, "vectors": VECTORS, "settings": SETTINGS, "ocr_cache": CACHE, "transcript_cache": CACHE}
