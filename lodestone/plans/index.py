"""Versioned evidence index: incremental sync, atomic publication, readiness and status.

Layout under the index root, one folder per chunker identity::

    <chunk key>/segments/<segment>/chunks                 chunk rows of the sources of one sync
    <chunk key>/segments/<segment>/terms-<key>/postings   (field, term, chunk number, tf) rows by term bucket
    <chunk key>/segments/<segment>/terms-<key>/lengths    number, id, source and lengths per chunk
    <chunk key>/segments/<segment>/vectors-<key>          unit vectors
    <chunk key>/sources/<revision>                        live sources and the segment of each
    <chunk key>/commits/<revision before>.json            the state that follows a revision ("first": none before)
    <chunk key>/CURRENT.json                              a late state, where readers begin

A sync writes only changed sources into a new segment, then publishes by creating the commit that
follows the state it read. Readers see the old or the new state, a failed job publishes nothing, and
of two writers only one can follow a state (a rename without overwrite decides, which is atomic on HDFS and local
disks; an object store needs a committer of its own). Rows of replaced sources are left behind in old segments
and screened out by the sources table, until ``compact`` merges segments of like size into one sorted segment of live rows.
``vacuum`` removes files that no state of the retention time names.

Each state registers its layers: kind, identity, parent, and the corpus, scope and time of the sync that completed
it. A layer of another corpus or scope than the chunks is stale, while others go on serving.
"""

from __future__ import annotations

import functools
import hashlib
import inspect
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import RetrievalError, compact_json
from ..functions.text import chunk_id, content_hash, is_blank, retrieval_text, title_text
from ..operators import chunking, lexical, maintenance, postings as postings_form
from ..functions.segmentation import HanDictionary
from ..operators.structure import structure_ranges
from ..session import BROADCAST_ROW_LIMIT, small_side, spread
from ..sources.embedding import EmbeddingProvider, embed_texts, usage_ledger

# Chunks of a segment for each term bucket, and the most buckets: a task writes one file a bucket, and these shall not be tiny.
BUCKET_CHUNKS, TERM_BUCKETS = 200_000, 64
# Segments of like size that are merged into one.
MERGE_FACTOR = 4
# Term filters reach the scan up to this many terms; beyond, buckets alone prune.
TERM_FILTER = 5_000
POSTING_COLUMNS = "field string, term string, number long, tf int"
TOKENIZER_VERSION = "words-identifiers-han-bigrams-2"  # 2: postings name chunks by number

ChunkerFn = Callable[[DataFrame], DataFrame]
CHUNKERS: dict[str, tuple[str, ChunkerFn]] = {}
# Chunkers whose ranges are an expression of the source's row: its text then meets them without a join.
ROW_CHUNKERS: dict[str, Callable[[], Column]] = {}


def register_chunker(name: str, version: str, fn: ChunkerFn) -> None:
    """Add a chunker: sources (source_id, first_line, text) to line ranges."""
    ROW_CHUNKERS.pop(name, None)
    if not name or not version or not callable(fn):
        raise ValueError("A chunker needs a name, a version and a function")
    CHUNKERS[name] = (version, fn)


def code_of(fn: Callable) -> str:
    """What a chunker's result depends on: bound parameters, its source, and the modules that its names come from."""
    if isinstance(fn, functools.partial):
        bound = [code_of(v) if callable(v) else repr(v) for v in (*fn.args, *fn.keywords.values())]
        return "\n".join([code_of(fn.func), *fn.keywords, *bound])
    plain = fn if hasattr(fn, "__code__") else type(fn).__call__
    try:
        own = inspect.getsource(fn if plain is fn else type(fn))
    except (OSError, TypeError):  # typed into a shell: its byte code stands for it
        code = getattr(plain, "__code__", None)
        own = f"{code.co_code.hex()} {code.co_consts!r} {code.co_names}" if code else f"{type(fn).__module__}.{type(fn).__qualname__}"
    if not hasattr(plain, "__code__"):
        return own
    package = __name__.split(".")[0]
    used = {inspect.getmodule(plain.__globals__.get(name)) for name in plain.__code__.co_names} | {inspect.getmodule(plain)}
    library = sorted((m for m in used if m and m.__name__.split(".")[0] == package and m.__name__ != __name__), key=lambda m: m.__name__)
    return "\n".join([own, *map(inspect.getsource, library)])


def _with_first_line(fn, sources: DataFrame) -> DataFrame:
    return fn(sources, first_line=F.col("first_line"))


def _paragraphs(sources: DataFrame) -> DataFrame:
    return chunking.paragraph_ranges(chunking.source_lines(sources, first_line=F.col("first_line")))


def _whole(sources: DataFrame) -> DataFrame:
    """A source is one chunk; sources without text have none."""
    none = F.lit(None).cast("int")
    return sources.filter(~is_blank("text")).select(
        "source_id", F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line"),
        F.array().cast("array<string>").alias("heading_path"), none.alias("section_start_line"), none.alias("section_end_line"),
    )


def _whole_ranges() -> Column:
    """The range of :func:`_whole` as a list."""
    none = F.lit(None).cast("int")
    values = (F.col("first_line"), F.col("last_line"), F.array().cast("array<string>"), none, none)
    return F.when(~is_blank("text"), F.array(F.struct(*[v.alias(c) for c, v in zip(chunking.RANGE_COLUMNS, values, strict=True)])))


register_chunker("structure", "1", functools.partial(_with_first_line, structure_ranges))
for _size in (1000, 500):
    register_chunker(
        f"heading-{_size}", "1", functools.partial(_with_first_line, functools.partial(chunking.heading_line_ranges, max_chars=_size))
    )
register_chunker("paragraph", "1", _paragraphs)
register_chunker("whole", "1", _whole)
ROW_CHUNKERS["whole"] = _whole_ranges


def _heading_without_bare(sources: DataFrame) -> DataFrame:
    ranges = chunking.heading_line_ranges(sources, first_line=F.col("first_line"))
    return chunking.drop_bare_headings(ranges, chunking.source_lines(sources, first_line=F.col("first_line")))


register_chunker("structural-heading", "1", _heading_without_bare)


def _key(*parts: object) -> str:
    return hashlib.sha256(compact_json([str(p) for p in parts]).encode()).hexdigest()


@dataclass(frozen=True)
class IndexProfile:
    chunker: str = "structure"
    dictionary: tuple[str, ...] = ()
    scope: str = ""
    han: HanDictionary | None = None
    chunk_key: str = field(init=False)
    term_key: str = field(init=False)

    def __post_init__(self) -> None:
        if self.chunker not in CHUNKERS:
            raise RetrievalError("INVALID_REQUEST", f"Unknown chunker: {self.chunker}")
        version, fn = CHUNKERS[self.chunker]
        object.__setattr__(self, "chunk_key", _key(self.chunker, version, code_of(fn)))
        han = [f"han:{self.han.fingerprint}"] if self.han else []
        object.__setattr__(self, "term_key", _key(self.chunk_key, TOKENIZER_VERSION, *self.dictionary, *han))

    def vector_key(self, provider: EmbeddingProvider) -> str:
        return _key(self.chunk_key, provider.fingerprint, provider.dimensions)


class Folder:
    """Small-file access through the Hadoop file system of the index path."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), conf)
        self.fs = self._path(path).getFileSystem(conf)
        self.jvm, self.spark = jvm, spark

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def read(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()["value"]

    def _move_in(self, path: str, text: str, *flags) -> None:
        """Write beside the target, then rename."""
        temporary = f"{path}.{uuid.uuid4().hex}"
        out = self.fs.create(self._path(temporary))
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, len(flags))
        for i, flag in enumerate(flags):
            options[i] = flag
        try:
            self.context.rename(self._path(temporary), self._path(path), options)
        except Exception:
            self.fs.delete(self._path(temporary), False)
            raise

    def replace(self, path: str, text: str) -> None:
        self._move_in(path, text, self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE)

    def create(self, path: str, text: str) -> bool:
        """False if the file exists already; of two writers only one succeeds."""
        try:
            self._move_in(path, text)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def names(self, path: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self._path(path))] if self.exists(path) else []

    def drop(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class EvidenceIndex:
    def __init__(self, spark: SparkSession, root: str, profile: IndexProfile = IndexProfile()):
        self.spark, self.profile = spark, profile
        self.home = f"{root.rstrip('/')}/{profile.chunk_key[:20]}"
        self.folder = Folder(spark, root)

    # --- state ---------------------------------------------------------------------------
    def _commit_after(self, state: dict | None) -> str:
        return f"{self.home}/commits/{state['revision'] if state else 'first'}.json"

    def state(self) -> dict | None:
        """The last commit. CURRENT.json saves the walk from the first one; a commit after it counts all the same."""
        path = f"{self.home}/CURRENT.json"
        state = json.loads(self.folder.read(path)) if self.folder.exists(path) else None
        while self.folder.exists(following := self._commit_after(state)):
            state = json.loads(self.folder.read(following))
        return state

    def require(self, mode: str = "hybrid", vector_key: str | None = None) -> dict:
        """Published state that serves ``mode``; missing or stale layers are errors."""
        state = self.state()
        if state is None:
            raise RetrievalError("INDEX_REQUIRED", f"No index is published under {self.home}", "Build the index: run sync")
        layers = {"terms": self.profile.term_key} if mode != "dense" else {}
        if mode != "bm25":
            if not vector_key:
                raise RetrievalError("MODEL_CONFIG", f"Mode {mode} needs an embedding provider", "Pass a provider or use mode bm25")
            layers["vectors"] = vector_key
        registry = state.get("layers", {})
        expected = registry.get("chunks", {}).get(self.profile.chunk_key)
        rows = {"chunks": expected, **{kind: registry.get(kind, {}).get(key) for kind, key in layers.items()}}
        lacking = sorted(kind for kind, row in rows.items() if row is None)
        if lacking:
            raise RetrievalError("INDEX_REQUIRED", f"The index lacks {' and '.join(lacking)} of this profile", "Build the missing layer: run sync")
        if expected["scope"] != self.profile.scope:
            raise RetrievalError("INDEX_STALE", "The index was built for other folders or patterns", "Run sync with the present scope")
        stale = sorted(kind for kind, row in rows.items() if (row["corpus"], row["scope"]) != (state["corpus"], expected["scope"]))
        if stale:
            raise RetrievalError("INDEX_STALE", f"{' and '.join(stale)} belong to an earlier corpus", "Run sync with this profile")
        return state

    # --- live tables -----------------------------------------------------------------------
    def sources(self, state: dict) -> DataFrame:
        return self.spark.read.parquet(state["sources"])

    def _live(self, state: dict, paths: list[tuple[dict, str]]) -> DataFrame:
        """Rows of the segments; of those with replaced sources only the rows whose live segment they are."""
        clean = dead = None
        for segment, path in paths:
            part = self.spark.read.parquet(path)
            if segment["dead"]:
                part = part.withColumn("segment", F.lit(segment["id"]))
                dead = part if dead is None else dead.unionByName(part)
            else:
                clean = part if clean is None else clean.unionByName(part)
        if dead is not None:
            live = self.sources(state).select("source_id", "segment")
            dead = dead.join(live, ["source_id", "segment"], "left_semi").drop("segment")
        return dead if clean is None else clean if dead is None else clean.unionByName(dead)

    def chunks(self, state: dict) -> DataFrame:
        return self._live(state, [(s, s["chunks"]) for s in state["segments"]]).drop("number", "rule")

    def _live_postings(self, state: dict, segment: dict, key: str) -> DataFrame:
        rows = self.spark.read.parquet(segment["terms"][key] + "/postings")
        if segment["dead"]:
            rows = rows.join(self._numbered_lengths(state, [segment], key).select("number"), "number", "left_semi")
        return rows

    def postings(self, state: dict, terms: list[tuple[str, int]] | None = None) -> DataFrame:
        """Stored postings (chunk number, field, term, tf); of the ``terms`` (term and its hash) of a request, only their buckets and, if few,
        their rows are read."""
        out = None
        for s in state["segments"]:
            rows = self._live_postings(state, s, self.profile.term_key).select("bucket", "number", "field", "term", "tf")
            if terms is not None:
                rows = rows.filter(F.col("bucket").isin(sorted({h % s["buckets"] for _, h in terms})))
                rows = rows.filter(F.col("term").isin([t for t, _ in terms])) if len(terms) <= TERM_FILTER else rows
            out = rows if out is None else out.unionByName(rows)
        return out

    def described_postings(self, state: dict, terms: list[tuple[str, int]] | None = None) -> DataFrame:
        """:meth:`postings` with the id, source and lengths of their chunks."""
        return self.postings(state, terms).join(self._numbered_lengths(state, state["segments"]), "number").drop("number")

    def _numbered_lengths(self, state: dict, segments: list[dict], key: str | None = None) -> DataFrame:
        return self._live(state, [(s, s["terms"][key or self.profile.term_key] + "/lengths") for s in segments])

    def numbered_lengths(self, state: dict) -> DataFrame:
        """Number, id, source and lengths of the live chunks."""
        return self._numbered_lengths(state, state["segments"])

    def lengths(self, state: dict) -> DataFrame:
        return self.numbered_lengths(state).drop("number")

    def vectors(self, state: dict, vector_key: str) -> DataFrame:
        return self._live(state, [(s, s["vectors"][vector_key]) for s in state["segments"]])

    # --- sync ------------------------------------------------------------------------------
    def _write_chunks(self, sources: DataFrame, path: str) -> None:
        keep = ("collection_id", "path", "relative_path", "source_version")
        if self.profile.chunker in ROW_CHUNKERS:
            cut = chunking.cut_listed(sources.withColumn("ranges", ROW_CHUNKERS[self.profile.chunker]()), keep)
        else:
            cut = chunking.cut_text(CHUNKERS[self.profile.chunker][1](sources), sources, keep)
        checked = cut.withColumn("rule", chunking.broken_rule()).drop("lines", "first_line", "last_line")
        rows = checked.withColumn("chunk_id", chunk_id(F.col("source_id"), F.col("start_line"), F.col("end_line"), F.col("text")))
        # Cut once: the rule that a row breaks is written beside it and looked up afterwards.
        rows.withColumn("number", postings_form.chunk_number()).write.mode("errorifexists").option("compression", "zstd").parquet(path)
        broken = self.spark.read.parquet(path).filter(F.col("rule").isNotNull()).select("source_id", "rule").first()
        if broken:
            self.folder.drop(path)
            raise RetrievalError("INVALID_REQUEST", f"{broken['rule']}: {broken['source_id']}")

    def _write_terms(self, chunks: DataFrame, path: str, buckets: int) -> None:
        title = title_text(F.col("path"), F.col("heading_path"))
        table = lexical.term_table(spread(chunks, "number"), title=title, keep=("number",), dictionary=self.profile.dictionary, han=self.profile.han)
        plain, listed = lexical.split_plain(table, ("number",))
        found = postings_form.counted(listed)
        # Texts are read once and nothing is shuffled: each task writes its own files, and lengths are sums of its postings.
        self._write_postings(found if plain is None else found.unionByName(postings_form.counted_plain(plain)), path, buckets, merged=False)
        rows = self.spark.read.schema(POSTING_COLUMNS).parquet(path + "/postings")
        one = lambda name: F.count(F.when(F.col("field") == name, True)).cast("int").alias(f"{name}_len")
        sums = rows.groupBy("number").agg(one("title"), one("body"), F.sum("tf").cast("int").alias("total_len"))
        known = chunks.select("chunk_id", "number", "source_id", "collection_id", "relative_path")
        lengths = known.join(sums, "number", "left").fillna(0, ["title_len", "body_len", "total_len"])
        lengths.select(*known.columns, *sums.columns[1:]).write.mode("errorifexists").parquet(path + "/lengths")

    def _write_postings(self, packed: DataFrame, path: str, buckets: int, merged: bool) -> None:
        keyed = packed.withColumns({"bucket": F.pmod(term_hash(F.col("term")), F.lit(buckets)).cast("int"), "first": F.col("numbers")[0]})
        # Files are sorted by term. Where segments are merged, range partitions split a hot term over several tasks.
        keyed = keyed.repartitionByRange("bucket", "term", "first") if merged else keyed
        arranged = keyed.sortWithinPartitions("bucket", "term", "first")
        postings_form.unpacked(arranged, "bucket").write.mode("errorifexists").partitionBy("bucket").parquet(path + "/postings")

    def _write_vectors(self, chunks: DataFrame, provider: EmbeddingProvider, path: str, stored: list[str]) -> dict:
        """Vectors of ``chunks``; texts whose vectors lie in one of the ``stored`` tables are not embedded again."""
        text = retrieval_text(F.col("path"), F.col("heading_path"), F.col("text"))
        keyed = chunks.withColumn("retrieval_text", text).withColumn("text_hash", content_hash("retrieval_text"))
        fresh = keyed
        if stored:
            known = self.spark.read.parquet(*stored).select("text_hash", "embedding").dropDuplicates(["text_hash"])
            fresh = keyed.join(known.select("text_hash"), "text_hash", "left_anti")
        embed_texts(fresh, provider, "retrieval_text").write.mode("errorifexists").parquet(path + "-texts")
        embedded = self.spark.read.parquet(path + "-texts")
        vectors = embedded.select("text_hash", "embedding")
        if stored:
            vectors = vectors.unionByName(known)
        keyed.select("chunk_id", "source_id", "collection_id", "relative_path", "text_hash").join(vectors, "text_hash").drop(
            "text_hash"
        ).write.mode("errorifexists").parquet(path)
        return usage_ledger(embedded).fillna(0).first().asDict()

    def sync(
        self,
        sources: DataFrame,
        provider: EmbeddingProvider | None = None,
        rescan: Callable[[], DataFrame] | None = None,
        remove_missing: bool = True,
    ) -> dict:
        """Bring the index to the state of ``sources`` (output of ``parse_sources``).

        Unchanged sources keep their rows; only missing term and vector layers are filled.
        ``rescan`` re-reads the sources before publication: a difference aborts the sync.
        """
        revision = new_revision()
        scanned = f"{self.home}/scans/{revision}"
        forget = lambda: self.folder.drop(scanned)
        try:
            # Files are read and parsed once; every later step sees the same sources.
            sources.write.mode("errorifexists").option("compression", "zstd").parquet(scanned)
            return self._sync(self.spark.read.schema(sources.schema).parquet(scanned), revision, provider, rescan, remove_missing, forget)
        finally:
            forget()

    def _sync(self, sources: DataFrame, revision: str, provider, rescan, remove_missing: bool, forget: Callable[[], None]) -> dict:
        columns = ("collection_id", "path", "relative_path", "source_version")
        repeated = maintenance.duplicates(sources, "source_id").first()
        if repeated:
            raise RetrievalError("INVALID_REQUEST", f"Duplicate identity: {repeated['source_id']}")
        started = self.state()
        state = started or {"segments": [], "layers": {}}
        if "sources" in state:
            previous = self.sources(state)
        else:
            previous = sources.select("source_id", *columns).withColumn("segment", F.lit("")).limit(0)
        before = previous.select("source_id", F.col("segment").alias("old_segment"))
        diff = maintenance.snapshot_diff(previous, sources).join(before, "source_id", "left")
        diff.write.mode("errorifexists").parquet(f"{self.home}/sources/{revision}-diff")
        diff = self.spark.read.parquet(f"{self.home}/sources/{revision}-diff")
        counts = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}  # four rows at most
        lost = ["updated", "removed"] if remove_missing else ["updated"]
        # At most one row for each segment.
        dead = {r["old_segment"] for r in diff.filter(F.col("change").isin(lost)).select("old_segment").distinct().collect()}
        segments = [dict(s, terms=dict(s["terms"]), vectors=dict(s["vectors"]), dead=s["dead"] or s["id"] in dead) for s in state["segments"]]
        if counts.get("added", 0) + counts.get("updated", 0):
            base = f"{self.home}/segments/{revision}"
            self._write_chunks(_touched(sources, diff, counts), base + "/chunks")
            segments.append(self._segment(revision))
        current = sources.select("source_id", *columns).join(
            diff.select("source_id", F.when(F.col("change") == "unchanged", F.col("old_segment")).otherwise(F.lit(revision)).alias("segment")),
            "source_id",
        )
        if not remove_missing:
            gone = diff.filter("change = 'removed'").select("source_id")
            current = current.unionByName(previous.select(*current.columns).join(gone, "source_id", "left_semi"))
        current.write.mode("errorifexists").parquet(f"{self.home}/sources/{revision}")
        seen = maintenance.fingerprint(sources, "source_id", *columns).first()["fingerprint"] if rescan is not None else None
        forget()  # the chunks hold the texts from here on
        usage = None
        vector_key = self.profile.vector_key(provider) if provider else None
        for segment in segments:
            base = f"{self.home}/segments/{segment['id']}"
            chunks = self.spark.read.parquet(segment["chunks"])
            if self.profile.term_key not in segment["terms"]:
                path = f"{base}/terms-{self.profile.term_key[:20]}-{revision}"
                self._write_terms(chunks, path, segment["buckets"])
                segment["terms"][self.profile.term_key] = path
            if vector_key and vector_key not in segment["vectors"]:
                path = f"{base}/vectors-{vector_key[:20]}-{revision}"
                stored = [s["vectors"][vector_key] + "-texts" for s in segments if vector_key in s["vectors"]]
                spent = self._write_vectors(chunks, provider, path, stored)
                usage = spent if usage is None else add_usage(usage, spent)
                segment["vectors"][vector_key] = path
        live = self.spark.read.parquet(f"{self.home}/sources/{revision}")
        corpus = maintenance.fingerprint(live, "source_id", *columns).first()["fingerprint"]
        if rescan is not None:
            again = maintenance.fingerprint(rescan(), "source_id", *columns).first()["fingerprint"]
            if again != seen or (remove_missing and again != corpus):
                raise RetrievalError("BUSY", "The source files changed while syncing", "Sync again when nothing writes to the folder")
        removed = counts.get("removed", 0) if remove_missing else 0
        now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        row = {"corpus": corpus, "scope": self.profile.scope, "last_sync": now, "parent": self.profile.chunk_key}
        layers = {kind: dict(rows) for kind, rows in state["layers"].items()}
        done = {"chunks": self.profile.chunk_key, "terms": self.profile.term_key} | ({"vectors": vector_key} if vector_key else {})
        for kind, key in done.items():
            layers.setdefault(kind, {})[key] = row | ({"parent": None} if kind == "chunks" else {})
        self._publish(started, {
            "revision": revision, "corpus": corpus, "sources": f"{self.home}/sources/{revision}", "segments": segments, "layers": layers, "last_sync": now,
        })
        return {
            "status": "ok", "added": counts.get("added", 0), "updated": counts.get("updated", 0), "removed": removed,
            "unchanged": counts.get("unchanged", 0), "usage": usage, "revision": revision,
        }

    def _segment(self, revision: str) -> dict:
        path = f"{self.home}/segments/{revision}/chunks"
        rows = self.spark.read.parquet(path).count()
        return {
            "id": revision, "chunks": path, "rows": rows, "dead": False, "terms": {}, "vectors": {},
            "buckets": min(TERM_BUCKETS, 1 << (rows // BUCKET_CHUNKS).bit_length()),
        }

    def _publish(self, started: dict | None, state: dict) -> None:
        text = json.dumps(state)
        if not self.folder.create(self._commit_after(started), text):
            raise RetrievalError("BUSY", "Another sync was published meanwhile", "Sync again")
        self.folder.replace(f"{self.home}/CURRENT.json", text)

    # --- merging ---------------------------------------------------------------------------
    def compact(self, factor: int = MERGE_FACTOR, everything: bool = False) -> dict:
        """Merge segments of like size into one of live rows, and publish the result as a sync would.

        Segments are tiered by the power of ``factor`` that their chunks reach; a tier of at least ``factor`` segments is merged, so
        each row is rewritten about once for each tier. ``everything`` merges all segments. A layer that a member lacks is
        not merged; a sync with its profile fills it again.
        """
        started = self.state()
        if started is None:
            raise RetrievalError("INDEX_REQUIRED", f"No index is published under {self.home}", "Build the index: run sync")
        members = list(started["segments"]) if everything else _full_tier(started["segments"], factor)
        if len(members) < 2 and not any(s["dead"] for s in members):
            return {"status": "ok", "merged": 0, "segments": len(started["segments"])}
        revision = new_revision()
        base = f"{self.home}/segments/{revision}"
        self._live(started, [(s, s["chunks"]) for s in members]).write.mode("errorifexists").parquet(base + "/chunks")
        merged = self._segment(revision)
        for key in set.intersection(*[set(s["terms"]) for s in members]):
            path = merged["terms"][key] = f"{base}/terms-{key[:20]}-{revision}"
            lengths = self._numbered_lengths(started, members, key)
            lengths.write.mode("errorifexists").parquet(path + "/lengths")
            kept = None
            for s in members:
                rows = self._live_postings(started, s, key).select("number", "field", "term", "tf")
                kept = rows if kept is None else kept.unionByName(rows)
            self._write_postings(postings_form.packed(kept), path, merged["buckets"], merged=True)
        for key in set.intersection(*[set(s["vectors"]) for s in members]):
            path = merged["vectors"][key] = f"{base}/vectors-{key[:20]}-{revision}"
            self._live(started, [(s, s["vectors"][key]) for s in members]).write.mode("errorifexists").parquet(path)
            texts = self.spark.read.parquet(*[s["vectors"][key] + "-texts" for s in members]).select("text_hash", "embedding")
            texts.dropDuplicates(["text_hash"]).write.mode("errorifexists").parquet(path + "-texts")
        ids = [s["id"] for s in members]
        moved = F.when(F.col("segment").isin(ids), F.lit(revision)).otherwise(F.col("segment"))
        self.sources(started).withColumn("segment", moved).write.mode("errorifexists").parquet(f"{self.home}/sources/{revision}")
        left = [s for s in started["segments"] if s["id"] not in ids]
        state = dict(started, revision=revision, sources=f"{self.home}/sources/{revision}", segments=[*left, merged])
        try:
            self._publish(started, state)
        except RetrievalError:
            self.folder.drop(base)
            self.folder.drop(f"{self.home}/sources/{revision}")
            raise
        return {"status": "ok", "merged": len(members), "segments": len(state["segments"])}

    def vacuum(self, retain_seconds: float = 86_400) -> int:
        """Remove segments and source tables that neither the present state nor one replaced within ``retain_seconds`` names.

        Readers that began within that time keep their files. Commits stay: they decide between writers. Younger files stay too, as a sync that is
        still running may own them.
        """
        oldest = time.time() - retain_seconds
        kept = self.state()
        if kept is None:
            return 0
        states, following = [kept], None
        for name in sorted(self.folder.names(f"{self.home}/commits")):
            state = json.loads(self.folder.read(f"{self.home}/commits/{name}"))
            states.append(state)
        # A state was read until the next one came.
        ordered = sorted({s["revision"]: s for s in states}.values(), key=lambda s: s["revision"], reverse=True)
        named: set[str] = set()
        for state in ordered:
            if following is None or revision_time(following) >= oldest:
                named |= {s["id"] for s in state["segments"]} | {state["revision"]}
            following = state["revision"]
        removed = 0
        for kind in ("segments", "sources"):
            for name in self.folder.names(f"{self.home}/{kind}"):
                owner = name.removesuffix("-diff")
                if revision_time(owner) < oldest and (owner not in named or name != owner):
                    self.folder.drop(f"{self.home}/{kind}/{name}")
                    removed += 1
        return removed

    # --- status ----------------------------------------------------------------------------
    def status(self, current: DataFrame | None = None, mode: str = "bm25", vector_key: str | None = None) -> dict:
        """Counts, readiness and, given a scan of the sources, freshness. Writes nothing."""
        state = self.state()
        out: dict = {"ready": True, "last_sync": state and state["last_sync"], "sources": 0, "chunks": 0, "embeddings": 0}
        try:
            self.require(mode, vector_key)
        except RetrievalError as error:
            out.update(ready=False, reason={"code": error.code, "next": error.next_step})
        if state:
            out["sources"] = self.sources(state).count()
            out["chunks"] = self.chunks(state).count()
            if vector_key and all(vector_key in s["vectors"] for s in state["segments"]):
                out["embeddings"] = self.vectors(state, vector_key).count()
        if current is None:
            out["freshness"] = {"state": "unchecked"}
        elif state is None:
            out["freshness"] = {"state": "unknown", "reason": "not synchronized"}
        else:
            try:
                out["freshness"] = maintenance.freshness(self.sources(state), current).first().asDict()
            except Exception as error:  # unreadable sources leave freshness unknown
                out["freshness"] = {"state": "unknown", "reason": str(error)[:500]}
        return out


def _touched(sources: DataFrame, diff: DataFrame, counts: dict[str, int]) -> DataFrame:
    """Added and updated sources; the texts stay where they are if their ids, or those of the others, are few."""
    changed, same = counts.get("added", 0) + counts.get("updated", 0), counts.get("unchanged", 0)
    if not same:
        return sources
    few = min(changed, same) <= BROADCAST_ROW_LIMIT
    kinds, how = (("added", "updated"), "left_semi") if changed <= same else (("unchanged",), "left_anti")
    ids = diff.filter(F.col("change").isin(*kinds)).select("source_id")
    return sources.join(small_side(ids, few), "source_id", how)


def add_usage(a: dict, b: dict) -> dict:
    """Sum of two ledgers; a total that one of them does not know stays unknown."""
    return {k: None if a[k] is None or b[k] is None else a[k] + b[k] for k in a}


def term_hash(term: Column) -> Column:
    return F.xxhash64(term)


def new_revision() -> str:
    return f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"


def revision_time(revision: str) -> float:
    return int(revision.split("-")[0]) / 1000


def _full_tier(segments: list[dict], factor: int) -> list[dict]:
    """The smallest tier that holds ``factor`` segments or more."""
    tiers: dict[int, list[dict]] = {}
    for s in segments:
        tier, bound = 0, factor
        while s["rows"] >= bound:
            tier, bound = tier + 1, bound * factor
        tiers.setdefault(tier, []).append(s)
    return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= factor), [])
