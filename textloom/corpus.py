"""A corpus over a folder of files: scan it, embed what is pending, search it, answer from it."""

from __future__ import annotations

import hashlib
import json
import os
import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as LateError
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import classify, globs, secrets
from .functions import text as T
from .operators import annotations, answers, changes, corpus, listing, opening, paging, retrieval
from .session import TEXT_ROWS, checkpointed, deadline, steps
from .sources import archives, discover, models
from .sources.store import Change, Store, append_events, read_snapshot, write_snapshot
from .streaming import worker


@dataclass
class Backends:
    """Factories of models; the stand-ins need no network."""

    embedder: Callable[[], models.Embedder] = models.HashedWords
    pages: Callable[[], models.Recogniser] = models.PlainText
    speech: Callable[[], models.Recogniser] = models.PlainText
    generator: Callable[[], models.Generator] | None = None
    voice: Callable[[str, str], bytes] | None = None


@dataclass
class Settings:
    """What a corpus is made with; see config for where it comes from."""

    excludes: tuple[str, ...] = ()
    secret_patterns: tuple[str, ...] = ()
    most_bytes: int = corpus.MOST_BYTES
    use_ignore_files: bool = True
    follow_links: bool = False
    system_prompt: str = ""
    context_chars: int = answers.CONTEXT_CHARS
    local: bool = True
    #: Bounds of the caches of recognised texts, 0 for none; seconds that a question and its metadata may take.
    cache_ttl_s: int = 0
    cache_bytes: int = 0
    ask_s: float = 120.0
    preload_s: float = 30.0
    #: Bytes of files that a scan takes in at a time, and how often it writes a snapshot meanwhile (0: never).
    round_bytes: int = 16 << 30
    snapshot_s: float = 5.0
    extra: dict[str, str] = field(default_factory=dict)


class OutsideRoot(PermissionError):
    """A path that leads out of the corpus."""


class Unsupported(ValueError):
    """A document of a kind that isn't handled here."""


#: The caches of recognised texts, by the kind of representation.
CACHES = {"ocr_markdown": "ocr_cache", "transcript": "transcript_cache"}


PROGRESS = ("scanned", "indexed", "skipped", "errors")
#: What the scan of a folder keeps for the next one: when it began, and what it was made with.
SCANNED_AT, SCANNED_WITH = "scanned_at", "scanned_with"


class Corpus:
    def __init__(self, spark: SparkSession, root: str, state: str, backends: Backends | None = None, settings: Settings | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.store, self.backends, self.settings = Store(spark, state), backends or Backends(), settings or Settings()
        self.running = False
        #: What the running scan, or the last one, has come to so far.
        self.progress = dict.fromkeys(PROGRESS, 0)
        self.pages: tuple[tuple | None, paging.Pages | None] = (None, None)

    @property
    def scan_excludes(self) -> tuple[str, ...]:
        return (*globs.NEVER_SCANNED, *self.settings.excludes)

    @property
    def secret_patterns(self) -> tuple[str, ...]:
        return (*secrets.PATTERNS, *self.settings.secret_patterns)

    # scanning

    def listed(self, kept: Callable[..., DataFrame] = checkpointed) -> DataFrame:
        """The files of the corpus, without their content; archives are listed even if their own path is excluded, for their members."""
        own = self.settings
        found = discover.listed(self.spark, self.root, own.most_bytes, own.use_ignore_files, own.follow_links, kept)
        return found.filter(~globs.any_of(F.col("rel_path"), self.scan_excludes) | archives.format_of(F.col("rel_path")).isNotNull())

    def files(self, listed: DataFrame) -> DataFrame:
        """Listed files and members of archives, with content; only archives are read once more, for their members."""
        packed = archives.format_of(F.col("rel_path")).isNotNull()
        plain, found = discover.with_content(listed.filter(~packed)), discover.with_content(listed.filter(packed))
        whole = plain.unionByName(archives.with_members(found))
        return whole.filter(~globs.any_of(F.col("rel_path"), self.scan_excludes))

    def recognise(self, media: DataFrame, kind: str, kept: Callable[..., DataFrame]) -> DataFrame:
        """text and error for documents (rel_path, content_hash, bytes), read through the cache: equal contents are recognised once,
        and what was recognised in an earlier scan isn't again. New texts go into the cache, which is then cut to its bounds."""
        table = CACHES[kind]
        cached = self.store.read(table).select(F.col("key").alias("content_hash"), F.col("text").alias("known"))
        wanted = media.join(cached, "content_hash", "left_anti").dropDuplicates(["content_hash"])
        model = models.recognition(self.backends.speech) if kind == "transcript" else models.recognition(self.backends.pages, models.PAGE_ENDINGS, models.PAGE_BYTES)
        fresh = kept(wanted.select("content_hash", model(F.col("rel_path"), F.col("bytes")).alias("made")), **TEXT_ROWS)
        self.remember(kind, fresh.filter("made.error IS NULL").select(F.col("content_hash").alias("key"), F.col("made.text").alias("text")))
        found = media.select("rel_path", "content_hash").join(fresh, "content_hash", "left").join(cached, "content_hash", "left")
        return found.select("rel_path", F.coalesce("known", "made.text").alias("text"), F.when(F.col("known").isNull(), F.col("made.error")).alias("error"))

    def remember(self, kind: str, texts: DataFrame) -> None:
        """Texts (key, text) into the cache of a kind, which keeps its newest entries within age and size."""
        table, now = CACHES[kind], int(time.time())
        rows = texts.select("key", "text", F.octet_length("text").cast("long").alias("size_bytes"), F.lit(now).cast("long").alias("mtime_unix"))
        if rows.isEmpty():
            return
        self.store.upsert(table, rows)
        if self.settings.cache_ttl_s or self.settings.cache_bytes:

            def evicted(read: Callable[[str], DataFrame]) -> dict[str, Change]:
                own = read(table)
                files = own.select(F.col("key").alias("name"), "size_bytes", "mtime_unix")
                kept = listing.cache_kept(files, now, self.settings.cache_ttl_s, self.settings.cache_bytes).select(F.col("name").alias("key"))
                return {table: Change(own.limit(0), own.select("key").join(kept, "key", "left_anti"))}

            self.store.transaction(evicted)

    def text_of(self, docs: DataFrame, kept: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(representations, failures): raw text, recognised pages and transcripts of changed documents; and the paths that a
        recogniser failed on, with its error."""
        columns = ["rep_id", "doc_id", "rep_type", "rep_hash", "created_unix", "deleted", "rel_path", "doc_type", "text"]
        reps = corpus.representations(docs)
        failures = self.spark.createDataFrame([], "rel_path string, error string")
        media = docs.filter("raw IS NOT NULL").withColumnRenamed("raw", "bytes")
        for kind in CACHES:
            own = media.filter((F.col("doc_type") == "audio") == F.lit(kind == "transcript"))
            made = kept(own.select("rel_path", "doc_id", "doc_type").join(self.recognise(own, kind, kept), "rel_path"), **TEXT_ROWS)
            rows = made.filter("error IS NULL").select(
                corpus.stable_id(F.col("doc_id"), F.lit(kind)).alias("rep_id"), "doc_id", F.lit(kind).alias("rep_type"), T.sha256(F.col("text")).alias("rep_hash"),
                F.lit(0).cast("long").alias("created_unix"), F.lit(False).alias("deleted"), "rel_path", "doc_type", "text",
            )
            reps = reps.select(*columns).unionByName(rows)
            failures = failures.unionByName(made.filter("error IS NOT NULL").select("rel_path", "error"))
        return reps, failures

    def chunked(self, reps: DataFrame, kept: Callable[..., DataFrame]) -> DataFrame:
        own = lambda kind: reps.filter(F.col("rep_type") == kind)
        made = corpus.chunks(own("raw_text")).unionByName(corpus.page_chunks(own("ocr_markdown"))).unionByName(corpus.time_chunks(own("transcript")))
        return kept(made, **TEXT_ROWS)

    def scan(self, force: bool = False) -> None:
        """Bring the tables up to the files.

        The listing comes first, without content. Files whose size and time are those of their stored document, and were before the
        last scan began, are not opened; their documents, and the members of such archives, stay as they are. If the corpus is made
        with other patterns or limits than in the last scan, or force is set, everything is read again. What is left is taken in
        rounds of bounded size; in each, documents, representations, chunks and spans come into being together, and the last one
        marks what is missing. So the tables, and the counters in ``progress``, move while a scan runs, and one that is broken off
        keeps its rounds. In a round the new rows are written once: the models and the reader run a single time, and a lost
        executor doesn't start them again. These files are compressed and go as soon as nothing is drawn from them, the contents
        before the chunks are dealt. A document that a recogniser fails on gets the status error and is tried again by the
        next scan; the others go on.
        """
        self.running, self.progress = True, dict.fromkeys(PROGRESS, 0)
        try:
            with self.snapshots(), steps(self.spark) as kept:
                self._scan(force, kept)
        finally:
            self.running = False
        self.write_snapshot()
        self.store.expire()

    def _scan(self, force: bool, kept: Callable[..., DataFrame]) -> None:
        began, own = int(time.time()), self.settings
        made_with = hashlib.sha256(json.dumps([self.scan_excludes, self.secret_patterns, own.most_bytes, own.use_ignore_files, own.follow_links]).encode()).hexdigest()
        since = int(self.store.get(SCANNED_AT, "0")) if not force and self.store.get(SCANNED_WITH) == made_with else 0
        stored = self.store.read("documents")
        listed = kept(self.listed(kept))
        still = kept(changes.unmoved(stored, listed, since)) if since else stored.limit(0).select("rel_path")
        seen = kept(still.unionByName(changes.archive_members(stored, still).select("rel_path")))
        work = listed.join(still, "rel_path", "left_anti")
        rounds = max(1, -(-(work.agg(F.sum("size_bytes")).first()[0] or 0) // own.round_bytes))
        dealt = kept(work.withColumn("round", F.pmod(F.xxhash64("rel_path"), F.lit(rounds))))
        scanned = self.spark.createDataFrame([(SCANNED_AT, str(began)), (SCANNED_WITH, made_with)], schemas.SETTINGS)
        for n in range(rounds):
            last = n + 1 == rounds
            seen = seen.unionByName(self._round(stored, dealt.filter(F.col("round") == n), force, kept, seen if last else None, scanned if last else None))

    def _round(self, stored: DataFrame, listed: DataFrame, force: bool, kept: Callable[..., DataFrame], seen: DataFrame | None, settings: DataFrame | None) -> DataFrame:
        """Take in listed files; the paths found. With the paths seen in earlier rounds, all that is stored beyond them is missing."""
        counters = Observation()
        known = changes.clear_hashes(stored) if force else stored
        with steps(self.spark) as rows:
            with steps(self.spark) as texts:
                read = listing.observed(corpus.documents(self.files(listed), self.secret_patterns), counters)
                found = texts(changes.changed(known, read, force), **TEXT_ROWS)
                work = found.filter("action <> 'keep'")
                reps, failures = self.text_of(work, texts)
                failed = failures.select("rel_path", F.lit("error").alias("failed"))
                docs = rows(found.join(failed, "rel_path", "left").withColumn("status", F.coalesce("failed", "status")).select(*stored.columns))
                refused = rows(work.filter("status <> 'ok'").select("rel_path").unionByName(failures.select("rel_path")))
                made, reps = self.chunked(reps, rows), rows(reps.drop("text"))
            paths = kept(docs.select("rel_path"))
            gone = lambda now: now.limit(0) if seen is None else changes.missing(now, seen.unionByName(paths))
            self.put(reps, made, lambda now: (docs, gone(now), refused), settings)
        for name in PROGRESS:
            self.progress[name] += counters.get[name]
        return paths

    @contextmanager
    def snapshots(self) -> Iterator[None]:
        """A snapshot at once and then every so many seconds, from a thread of its own, while the body runs."""
        done = threading.Event()

        def write() -> None:
            while not done.is_set():
                self.write_snapshot()
                done.wait(self.settings.snapshot_s)

        thread = threading.Thread(target=write, daemon=True)
        if self.settings.snapshot_s > 0:
            thread.start()
        try:
            yield
        finally:
            done.set()
            if thread.is_alive():
                thread.join()

    def put(self, reps: DataFrame, made: DataFrame, judge: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], settings: DataFrame | None = None) -> None:
        """New representations and chunks, and what judge says of the stored documents: (documents seen, those that are missing, paths
        whose representations go), as the least changes of the tables. settings come into being with them."""
        chunks, spans = corpus.split_spans(made)
        lengths = reps.select("rep_id").join(chunks.groupBy("rep_id").agg(F.max("ordinal").alias("last")), "rep_id", "left").select("rep_id", (F.coalesce("last", F.lit(-1)) + 1).alias("n"))
        gone_now = lambda rows: rows.filter("NOT deleted").withColumn("deleted", F.lit(True))

        def changed(read: Callable[[str], DataFrame]) -> dict[str, Change]:
            docs, old_reps, old_chunks = read("documents"), read("representations"), read("chunks")
            seen, missing, refused = judge(docs)
            paths = missing.select("rel_path").unionByName(refused.select("rel_path")).distinct()
            ids = docs.join(paths, "rel_path", "left_semi").select("doc_id")
            out_reps = old_reps.join(ids, "doc_id", "left_semi").join(reps.select("rep_id"), "rep_id", "left_anti")
            tail = old_chunks.join(lengths, "rep_id").filter("ordinal >= n").select(*old_chunks.columns)
            out_chunks = old_chunks.join(out_reps.select("rep_id"), "rep_id", "left_semi").unionByName(tail)
            new_docs = seen.select(*docs.columns).exceptAll(docs).unionByName(gone_now(missing.select(*docs.columns)))
            new_reps = reps.select(*old_reps.columns).unionByName(gone_now(out_reps.select(*old_reps.columns)))
            return {
                "documents": Change(new_docs), "representations": Change(new_reps),
                "chunks": Change(chunks.select(*old_chunks.columns).unionByName(gone_now(out_chunks))), "spans": Change(spans, chunks.select("chunk_id")),
                **({} if settings is None else {"settings": Change(settings)}),
            }

        self.store.transaction(changed)

    def embed(self, limit: int = 0) -> None:
        worker.run_once(self.store, self.backends.embedder, limit)

    # reading

    def meta(self) -> DataFrame:
        return listing.embedded(self.store.read("chunks"), self.store.read("spans"))

    def emit(self, event: str, level: str = "info", **data) -> None:
        """A line in the corpus's log of events."""
        row = [(int(time.time()), level, event, json.dumps(data, sort_keys=True, default=str))]
        append_events(self.spark.createDataFrame(row, "ts long, level string, event string, data string").coalesce(1), f"{self.store.folder}/events")

    def settle(self, key: str, network: str, amount: str, outcome: str) -> None:
        """A line in the log of settlements."""
        row = [(int(time.time()), key, network, amount, outcome)]
        append_events(self.spark.createDataFrame(row, "ts long, key string, network string, amount string, outcome string").coalesce(1), f"{self.store.folder}/settlements")

    def vector_of(self, text: str, kind: str) -> list[float]:
        return self.backends.embedder().embed([text])[0]

    def search(self, search: retrieval.Search) -> tuple[DataFrame, str]:
        excludes = (*globs.NEVER_SEARCHED, *self.settings.excludes)
        search = retrieval.Search(**{**search.__dict__, "excludes": excludes})
        vectors, chunks, spans = self.store.bucketed("vectors", "chunks", "spans")
        own = listing.live(chunks).filter((F.col("embedding_status") == "ok") & (F.col("chunk_id") > 0))
        detail = lambda ids: listing.hit_rows(own.join(F.broadcast(ids), "chunk_id", "left_semi"), spans)
        return retrieval.run(vectors, own.select("chunk_id", "index_kind", "rel_path", "doc_type"), search, self.vector_of, detail)

    def ask(self, question: str, search: retrieval.Search | None = None, generate: bool = True) -> dict:
        """question, answer, citations, hits. At most MOST_K hits come to the driver; TimeoutError if it takes too long."""
        with deadline(self.spark, self.settings.ask_s):
            return self._ask(question, search, generate)

    def _ask(self, question: str, search: retrieval.Search | None, generate: bool) -> dict:
        search = retrieval.Search(**{**(search or retrieval.Search()).__dict__, "query": question})
        hits, used = self.search(search)
        gathered = answers.gathered(hits)
        q = F.lit(question)
        row = gathered.select(
            "hits",
            answers.citations(F.col("hits")).alias("citations"),
            answers.fallback(q, F.col("hits")).alias("fallback"),
            answers.prompt(q, F.col("hits"), self.settings.system_prompt, self.settings.context_chars).alias("prompt"),
        ).first()
        found = [r.asDict(recursive=True) for r in row.hits]
        for h in found:
            h["score"] = -h.pop("order")
        answer = row.fallback if generate else ""
        if generate and found and self.backends.generator is not None:
            pool = ThreadPoolExecutor(1)
            try:
                answer = pool.submit(models.generated, self.backends.generator, row.prompt).result(self.settings.ask_s) or row.fallback
            except (models.ModelError, LateError):  # a model that fails leaves the answer that needs none
                answer = row.fallback
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        if generate and found:
            paths = F.array(*(F.lit(h["rel_path"]) for h in found))
            answer = self.spark.range(1).select(answers.attributed(F.lit(answer), paths, as_it_is=answer == row.fallback)).first()[0]
        return {
            "question": question,
            "answer": answer,
            "citations": [c.asDict(recursive=True) for c in row.citations],
            "hits": found,
            "index_used": used,
        }

    def content_of(self, rel_path: str) -> bytes:
        """The bytes of one source, by one bounded read of it or of the archive that it lies in; nothing else is opened."""
        most = self.settings.most_bytes
        parts = rel_path.strip().split("/")
        ways = [("/".join(parts[:n]), "/".join(parts[n:])) for n in range(len(parts), 0, -1)]
        for name, member in ways:
            kind = archives.kind_of(name)
            if member and kind is None:
                continue
            data = self._bounded(name, most)
            if data is None:
                continue
            if not member:
                return data
            for inside, content in archives.members(kind, data):
                if inside == member:
                    return content
        raise LookupError(rel_path)

    def _bounded(self, name: str, most: int) -> bytes | None:
        """A file below the root; None if there is none."""
        if not self.settings.local:
            found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*")
            try:
                row = found.load(f"{self.root}/{name}").filter(F.col("length") <= most if most > 0 else F.lit(True)).select("content").first()
            except Exception as e:  # noqa: BLE001  a path that isn't there
                if "PATH_NOT_FOUND" in str(e):
                    return None
                raise
            return bytes(row.content) if row else None
        root, path = os.path.realpath(self.root), os.path.realpath(os.path.join(self.root, name))
        if path != root and not path.startswith(root.rstrip(os.sep) + os.sep):
            raise OutsideRoot(name)
        if not os.path.isfile(path):
            return None
        if 0 < most < os.stat(path).st_size:
            raise Unsupported(f"{name} is larger than {most} bytes")
        with open(path, "rb") as f:
            return f.read()

    def open(self, rel_path: str, most_chars: int = 20000, lines: tuple[int, int] | None = None, page: int | None = None, time: tuple[int, int] | None = None) -> tuple[str, bool]:
        """(text, truncated) of a source or a part of it; LookupError, PermissionError and Unsupported say why not."""
        if self.spark.range(1).select(globs.any_of(F.lit(rel_path), (*globs.NEVER_SEARCHED, *self.settings.excludes), globs.retrieval)).first()[0]:
            raise PermissionError(rel_path)
        if page is not None or time is not None:
            with deadline(self.spark, self.settings.preload_s):
                own = self.store.read("chunks").filter(F.col("rel_path") == rel_path)
                meta = listing.embedded(own, self.store.read("spans"))
                if page is not None:
                    wanted = self.spark.createDataFrame([(rel_path, page)], "rel_path string, page int")
                    row = opening.pages_from_chunks(meta, wanted).first()
                else:
                    wanted = self.spark.createDataFrame([(rel_path, *time)], "rel_path string, from_ms int, to_ms int")
                    row = opening.times_from_chunks(meta, wanted).first()
            if row is not None:
                cut = self.spark.range(1).select(T.truncate_flag(F.lit(row.content), most_chars)).first()[0]
                return cut.text, cut.truncated
        raw = self.spark.createDataFrame([(rel_path, bytearray(self.content_of(rel_path)))], "rel_path string, content binary")
        content = raw.select("rel_path", T.normalize(F.col("content")).alias("content"))
        row = opening.guarded(content, (), self.secret_patterns).select("denied", opening.opened(F.col("content"), most_chars, lines, page, time).alias("o"), classify.looks_binary(F.col("rel_path"), F.col("content")).alias("binary")).first()
        if row.denied:
            raise PermissionError(rel_path)
        if row.binary:
            raise Unsupported(rel_path)
        if row.o.text is None:
            raise LookupError(f"{rel_path}: no such part")
        return row.o.text, row.o.truncated

    def doc_type_of(self, rel_path: str) -> str:
        return self.spark.range(1).select(classify.opened_type(F.lit(rel_path))).first()[0]

    def list(self, prefix: str = "", glob: str = "", limit: int = 200, offset: int = 0, with_hidden: bool = False) -> tuple[DataFrame, int]:
        """A page of the listing and how many files there are. Deep pages come from an index, which is kept until the documents change."""
        state, docs = self.store.state("documents"), self.store.read("documents")
        if offset > paging.SHALLOW:
            key = (state, prefix, glob, with_hidden)
            if self.pages[0] != key:
                self.pages = key, paging.Pages.of(listing.matching_files(docs, prefix, glob, with_hidden), "rel_path", group_bytes=4 << 20)
            page, total = self.pages[1].page(offset, limit), self.pages[1].total
        else:
            page = listing.list_files(docs, prefix, glob, limit, offset, with_hidden)
            total = listing.count_files(docs, prefix, glob, with_hidden).first()[0]
        return page.withColumn("status", classify.file_status(F.col("status"))), total

    def has_statistics(self) -> bool:
        """Whether the tables below the documents were ever written."""
        return self.store.has("representations", "chunks")

    def stats(self) -> dict:
        tables = (self.store.read(t) for t in ("documents", "representations", "chunks"))
        return listing.corpus_stats(*tables).first().asDict(recursive=True)

    def document_stats(self) -> dict:
        """The counts of documents alone, for a store without the tables below them."""
        return listing.fallback_stats(self.store.read("documents")).first().asDict(recursive=True)

    def snapshot(self) -> DataFrame:
        """One row: the statistics, the share of code, and how far a scan has come."""
        docs = self.store.read("documents")
        whole = (docs, self.store.read("representations"), self.store.read("chunks"))
        stats = listing.corpus_stats(*whole).withColumn("unknown", F.lit(0).cast("long")) if self.has_statistics() else listing.derived_stats(docs)
        now = F.struct(F.lit(self.running).alias("running"), *(F.lit(n).cast("long").alias(name) for name, n in self.progress.items()))
        names = ["scanned", "indexed", "skipped", "deleted", "errors", "unknown", "total_docs", "representations", "chunks_total", "embedded_ok", "doc_counts"]
        return stats.select(*names).crossJoin(listing.code_ratio(docs).select("code_ratio")).withColumns({"indexing": now, "ts": F.lit(int(time.time())).cast("long")})

    def write_snapshot(self) -> None:
        write_snapshot(self.snapshot(), f"{self.store.folder}/snapshot")

    def last_snapshot(self) -> dict | None:
        """The snapshot that was written last, if there is one."""
        row = read_snapshot(self.spark, f"{self.store.folder}/snapshot", self.snapshot().schema)
        return None if row is None else row.asDict(recursive=True)

    def live_document(self, rel_path: str):
        return listing.by_path(listing.live(self.store.read("documents")), rel_path).first()

    def source_text(self, rel_path: str) -> str:
        """What an annotation is made from: the transcript of audio, the recognised text of pages and images, else the raw text."""
        doc = self.live_document(rel_path)
        if doc is None:
            raise LookupError(rel_path)
        if doc.doc_type == "audio":
            return self.transcribe(rel_path)[0]
        content = self.content_of(rel_path)
        if doc.doc_type in ("pdf", "image"):
            return self.recognised_one("ocr_markdown", rel_path, content, doc.content_hash)
        return self.spark.createDataFrame([(bytearray(content),)], "c binary").select(T.normalize(F.col("c"))).first()[0]

    def recognised_one(self, kind: str, rel_path: str, content: bytes, key: str, forced: bool = False, factory: Callable[[], models.Recogniser] | None = None) -> str:
        """One content through its cache, without a job for what is there."""
        row = None if forced else self.store.read(CACHES[kind]).filter(F.col("key") == key).first()
        if row is not None:
            return row.text
        pages = kind == "ocr_markdown"
        model = (factory or (self.backends.pages if pages else self.backends.speech))()
        text, error, transient = models.recognised(model, rel_path, content, models.PAGE_ENDINGS if pages else (), models.PAGE_BYTES if pages else 0)
        if text is None:
            raise models.ModelError(error or "", transient)
        self.remember(kind, self.spark.createDataFrame([(key, text)], "key string, text string"))
        return text

    def annotate(self, rel_path: str, annotation_json: str, indexed: bool = True) -> str:
        """Store an annotation of a document; the preview of its flattened text."""
        doc = listing.by_path(listing.live(self.store.read("documents")), rel_path).select("doc_id", "rel_path", "doc_type")
        reps, chunks, previews = annotations.store(doc.withColumn("json", F.lit(annotation_json)), indexed)
        own, spans = corpus.split_spans(chunks)
        row = previews.first()
        if row is None:
            raise LookupError(rel_path)
        new = reps.withColumn("created_unix", F.lit(0)).withColumn("deleted", F.lit(False))
        self.store.transaction(lambda _: {"representations": Change(new), "chunks": Change(own), "spans": Change(spans, own.select("chunk_id"))})
        return row.preview

    def generated_annotation(self, rel_path: str, schema: dict, most_chars: int) -> str:
        """JSON that a model makes of the document's source text to a schema; ModelError if there is none."""
        if self.backends.generator is None:
            raise models.ModelError("no generator")
        text = self.source_text(rel_path)
        if not text.strip():
            raise models.ModelError("no source text available for annotation")
        prompt = "\n\n".join(["Make a JSON object of this document that conforms to the schema. Return the object only.", json.dumps(schema, sort_keys=True), "Document:", text[:most_chars]])
        raw = models.generated(self.backends.generator, prompt)
        found = self.spark.createDataFrame([(raw,)], "raw string").select(T.json_object_in(F.col("raw"))).first()[0]
        if found is None:
            raise models.ModelError("the model returned no JSON object")
        return found

    def transcribe(self, rel_path: str, language: str = "", again: bool = False) -> tuple[str, bool, bool]:
        """(transcript, whether it was made now, whether it is indexed) of an audio document, which needn't have been scanned.

        Transcripts are cached by content, and by language if one is asked for; again makes a new one. A document that isn't
        there yet gets its row first. Naming a language asks for a new transcript, as the recogniser has to be told of it.
        """
        doc = self.live_document(rel_path)
        kind = doc.doc_type if doc is not None else self.spark.range(1).select(classify.doc_type(F.lit(rel_path))).first()[0]
        if kind != "audio":
            raise Unsupported(f"{rel_path} is not audio")
        content = self.content_of(rel_path)
        found = self.spark.createDataFrame([(rel_path, bytearray(content), len(content), self._mtime(rel_path), "filesystem")], "rel_path string, content binary, size_bytes long, mtime_unix long, source_type string")
        seen = checkpointed(corpus.documents(found, ()))
        row = seen.first()
        language = language.strip().lower()
        key = row.content_hash + (f"-{re.sub('[^a-z0-9-]', '', language) or 'unknown'}" if language else "")
        again = again or bool(language)
        cached = not again and not self.store.read(CACHES["transcript"]).filter(F.col("key") == key).isEmpty()
        factory = (lambda: self.backends.speech(language)) if language and takes_language(self.backends.speech) else self.backends.speech
        text = self.recognised_one("transcript", rel_path, content, key, again, factory)
        indexed = bool(text.strip())
        docs = seen.drop("content", "raw")
        known = self.store.read("representations").filter((F.col("doc_id") == row.doc_id) & (F.col("rep_type") == "transcript") & ~F.col("deleted"))
        if indexed and doc is not None and not known.filter(F.col("rep_hash") == T.sha256(F.lit(text))).isEmpty():
            return text, not cached, indexed  # its chunks, and their vectors, are there
        if indexed:
            rep = docs.select(
                corpus.stable_id(F.col("doc_id"), F.lit("transcript")).alias("rep_id"), "doc_id", F.lit("transcript").alias("rep_type"), T.sha256(F.lit(text)).alias("rep_hash"),
                F.lit(0).cast("long").alias("created_unix"), F.lit(False).alias("deleted"), "rel_path", "doc_type", F.lit(text).alias("text"),
            )
            rep = checkpointed(rep)
            self.put(rep, self.chunked(rep, lambda made, **_: checkpointed(made)), lambda stored: (docs, stored.limit(0), stored.limit(0)))
        elif doc is None:
            self.store.upsert("documents", docs)
        return text, not cached, indexed

    def _mtime(self, rel_path: str) -> int:
        path = os.path.join(self.root, rel_path)
        return int(os.stat(path).st_mtime) if self.settings.local and os.path.isfile(path) else 0

    def transcript(self, rel_path: str) -> list[dict]:
        """The segments of a transcribed document, in order."""
        chunks = listing.live(self.store.read("chunks")).filter((F.col("rel_path") == rel_path) & (F.col("rep_type") == "transcript"))
        rows = listing.with_span(chunks, self.store.read("spans")).select("span.start_ms", "span.end_ms", "text").orderBy("start_ms")
        return [r.asDict() for r in rows.collect()]


def takes_language(factory: Callable) -> bool:
    """Whether a factory of recognisers can be told a language."""
    code = getattr(factory, "__code__", None) or getattr(getattr(factory, "__init__", None), "__code__", None)
    return code is not None and "language" in code.co_varnames
