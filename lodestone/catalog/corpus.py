"""Registered queries: lines, chunks, text measures, snapshots and corpus checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, coverage, maintenance as mt
from ..session import BROADCAST_ROW_LIMIT, fits, small_side
from .common import SQL_PASSAGE_SCORES, passages, register, spread, table, units
from .evaluation import SQL_CHUNKS, document_sources, line_chunks, located
from .lexical import BODY_ONLY, passage_lane

_LINES = """with ls as (select doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') as l from documents),
    lines as (select doc_id, unnest(l) as text, generate_subscripts(l, 1) as line_no from ls)"""


@register("source_lines", _LINES + " select doc_id, line_no, text from lines")
def source_lines(spark, sf_dir):
    return chunking.source_lines(document_sources(spark, sf_dir)).select(
        F.col("source_id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "text"
    )


@register(
    "paragraph_chunks",
    _LINES
    + """, b as (select *, not regexp_matches(text, '\\S') as blank from lines),
    s as (select *, case when not blank and coalesce(lag(blank) over (partition by doc_id order by line_no), true) then 1 else 0 end as starts from b),
    r as (select *, sum(starts) over (partition by doc_id order by line_no) as run from s)
    select doc_id, min(line_no) as start_line, max(line_no) as end_line from r where not blank group by doc_id, run""",
)
def paragraph_chunks(spark, sf_dir):
    ranges = chunking.paragraph_ranges(chunking.source_lines(document_sources(spark, sf_dir)))
    return ranges.select(
        F.col("source_id").alias("doc_id"), F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
    )


@register(
    "heading_line_chunks",
    f"with recursive {SQL_CHUNKS} select doc_id, start_line, end_line, length(text) as chars, chunk_id from chunk_ids",
)
def heading_line_chunks(spark, sf_dir):
    """Whole-line chunks of at most 1000 characters with their content ids."""
    return line_chunks(spark, sf_dir).select(
        F.col("source_id").alias("doc_id"), F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"), F.length("text").cast("long").alias("chars"), "chunk_id",
    )


@register("structure_chunks")
def structure_chunks(spark, sf_dir):
    """Structural Markdown chunks of every document."""
    from ..operators.structure import structure_ranges

    return structure_ranges(document_sources(spark, sf_dir)).select(
        F.col("source_id").alias("doc_id"), "start_line", "end_line", F.size("heading_path").alias("depth")
    )


@register(
    "text_measures",
    """select doc_id, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) as utf16,
      length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) + len(regexp_extract_all(text, '[\\x22\\x5C\\x08\\x09\\x0A\\x0C\\x0D]'))
        + 5 * len(regexp_extract_all(text, '[\\x00-\\x07\\x0B\\x0E-\\x1F]')) as escaped,
      1 + length(text) - length(replace(text, chr(10), '')) as end_line,
      1 + length(regexp_extract(text, '[^\\n]*$')) as end_column,
      sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as normalized_hash from documents""",
)
def text_measures(spark, sf_dir):
    """UTF-16 length, JSON-escaped length, preview end and white-space-normalised hash."""
    docs = document_sources(spark, sf_dir)
    line, column = tx.preview_end(F.lit(1), "text")
    return docs.select(
        F.col("source_id").alias("doc_id"), tx.utf16_length("text").cast("long").alias("utf16"),
        tx.escape_cost("text").cast("long").alias("escaped"), line.cast("long").alias("end_line"),
        column.cast("long").alias("end_column"), tx.content_hash(tx.collapse_whitespace("text")).alias("normalized_hash"),
    )


@register(
    "trimmed_line_spans",
    _LINES
    + """, o as (select *, coalesce(sum(length(text) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as off from lines)
    select doc_id, line_no, cast(off + length(text) - length(regexp_replace(text, '^\\s+', '')) as bigint) as "left",
      cast(off + length(regexp_replace(text, '\\s+$', '')) as bigint) as "right" from o where regexp_matches(text, '\\S')""",
)
def trimmed_line_spans(spark, sf_dir):
    spans = coverage.trimmed_line_spans(chunking.source_lines(document_sources(spark, sf_dir)))
    return spans.select(
        F.col("source_id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"),
        F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"),
    )


@register(
    "span_union_coverage",
    """with t as (select e.user_id, min(epoch(ts)) as b, max(epoch(ts)) as f from events e group by user_id),
    s as (select e.user_id, t.b, t.f, epoch(e.ts) as l, epoch(e.ts) + value * 200 as r from events e join t on t.user_id = e.user_id),
    w as (select *, greatest(coalesce(max(r) over (partition by user_id order by l, r rows between unbounded preceding and 1 preceding), b), b) as reach from s)
    select user_id, not bool_or(l > reach and reach < f) and max(greatest(r, b)) >= max(f) as covered from w group by user_id""",
)
def span_union_coverage(spark, sf_dir):
    """Interval union: do a user's activity spans cover first to last event without a gap?"""
    e = table(spark, sf_dir, "events").select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("double").alias("t"), "value")
    seconds = e.withColumn("left", F.col("t") / 1e6).withColumn("right", F.col("t") / 1e6 + F.col("value") * 200)
    bounds = seconds.groupBy("user_id").agg(F.min("left").alias("begin"), F.max("left").alias("finish"))
    return coverage.span_gaps(seconds.join(bounds, "user_id"), ("user_id",))


@register(
    "text_occurrences",
    """select b.item_id, d.doc_id, instr(d.text, b.text) as position,
      case when instr(substr(d.text, instr(d.text, b.text) + 1), b.text) > 0 then 'ambiguous' else 'mapped' end as status
    from benchmark b join documents d on contains(d.text, b.text)""",
)
def text_occurrences(spark, sf_dir):
    """Position of each returned text in its source; a second occurrence makes it ambiguous."""
    found = located(spark, sf_dir)
    again = F.position(F.col("passage"), F.substring(F.col("text"), F.col("offset") + 1, F.length("text")))
    return found.select(
        F.col("passage_id").alias("item_id"), F.col("source_id").alias("doc_id"), F.col("offset").cast("long").alias("position"),
        F.when(again > 0, "ambiguous").otherwise("mapped").alias("status"),
    )


# --- snapshots: labelled documents as the earlier state -----------------------------------
def snapshots(spark, sf_dir):
    """Earlier: labelled documents, those of quality 0 with another text. Now: all but toxic ones."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    shaped = docs.select(
        F.col("doc_id").alias("source_id"), F.col("lang").alias("collection_id"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("source").alias("relative_path"), "text", "quality", "toxic",
    )
    before = shaped.filter(F.col("quality").isNotNull()).withColumn(
        "source_version", tx.content_hash(F.when(F.col("quality") == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    )
    now = shaped.filter(F.coalesce("toxic", F.lit(0)) == 0).withColumn("source_version", tx.content_hash("text"))
    return before.drop("text", "quality", "toxic"), now.drop("text", "quality", "toxic")


_STATES = """with d as (select doc_id, quality, toxic from documents left join labels using (doc_id))"""
_CHANGE = "case when quality is null then 'added' when toxic = 1 then 'removed' when quality = 0 then 'updated' else 'unchanged' end"


@register("snapshot_diff", _STATES + f" select doc_id, {_CHANGE} as change from d")
def snapshot_diff(spark, sf_dir):
    before, now = snapshots(spark, sf_dir)
    return mt.snapshot_diff(before, now).select(F.col("source_id").alias("doc_id"), "change")


@register(
    "freshness",
    _STATES + f""", c as (select {_CHANGE} as change from d)
    select count(*) filter (change = 'added') as added, count(*) filter (change = 'updated') as modified,
      count(*) filter (change = 'removed') as removed, case when count(*) filter (change <> 'unchanged') > 0 then 'changed' else 'unchanged' end as state from c""",
)
def freshness(spark, sf_dir):
    before, now = snapshots(spark, sf_dir)
    return mt.freshness(before, now)


@register(
    "removed_sources",
    _STATES + " select doc_id from d where quality is not null and toxic = 1",
)
def removed_sources(spark, sf_dir):
    before, now = snapshots(spark, sf_dir)
    return mt.missing_layer(before, now, "source_id").select(F.col("source_id").alias("doc_id"))


@register(
    "missing_vectors_anti",
    "select doc_id from documents where not exists (select 1 from embeddings where vec_id = doc_id)",
)
def missing_vectors_anti(spark, sf_dir):
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return mt.missing_layer(table(spark, sf_dir, "documents").select("doc_id"), stored, "doc_id")


@register(
    "embeddings_join",
    """select d.doc_id, d.source, e.label, len(e.embedding) as dimensions from documents d join embeddings e on e.vec_id = d.doc_id""",
)
def embeddings_join(spark, sf_dir):
    """Vectors joined to their chunks, chunks to their sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.size("embedding").cast("long").alias("dimensions"))
    return docs.join(vec, "doc_id")


@register(
    "duplicate_identity",
    "select sha256(text) as source_version, count(*) as occurrences from documents group by 1 having count(*) > 1",
)
def duplicate_identity(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").select(tx.content_hash("text").alias("source_version"))
    return mt.duplicates(docs, "source_version")


@register(
    "last_row_wins",
    """select user_id, event_id, event_type, value from (
      select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1""",
)
def last_row_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return mt.last_row_wins(e, "user_id", F.col("event_id"))


@register("content_hash", "select doc_id, sha256(text) as source_version from documents")
def content_hash(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select("doc_id", tx.content_hash("text").alias("source_version"))


@register(
    "corpus_fingerprint",
    """with h as (select sha256(concat_ws(chr(31), doc_id::varchar, lang, source, sha256(text))) as h from documents),
    s as (select count(*) as rows, """
    + ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::hugeint) as s{i}" for i in range(4))
    + """ from h)
    select rows, sha256(concat_ws(':', rows::varchar, s0::varchar, s1::varchar, s2::varchar, s3::varchar)) as fingerprint from s""",
)
def corpus_fingerprint(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").withColumn("version", tx.content_hash("text"))
    return mt.fingerprint(docs, "doc_id", "lang", "source", "version")


@register(
    "hash_sample",
    """select doc_id, sha256('[20260920,"documents","' || doc_id || '"]') as sample_key from documents order by 2, doc_id::varchar limit 100""",
)
def hash_sample(spark, sf_dir):
    """Deterministic sample of 100 ids (the sampling operator itself)."""
    return mt.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "documents", 100)


@register(
    "manifest_equality",
    _STATES + f""", c as (select {_CHANGE} as change from d)
    select 'left' as side, count(*) filter (change in ('updated', 'removed')) as rows from c
    union all select 'right', count(*) filter (change in ('updated', 'added')) from c""",
)
def manifest_equality(spark, sf_dir):
    before, now = snapshots(spark, sf_dir)
    columns = ["source_id", "source_version"]
    return mt.same_rows(before.select(*columns), now.select(*columns)).groupBy("side").agg(F.count(F.lit(1)).alias("rows"))


@register("unknown_ids", "select distinct vec_id as chunk_id from embeddings where vec_id not in (select doc_id from labels)")
def unknown_ids(spark, sf_dir):
    """Ids of one table that another does not know (subset check)."""
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))
    return mt.unknown_ids(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")), known)


@register(
    "first_files",
    f"""with {SQL_PASSAGE_SCORES},
    f as (select query_id, source, min(rank) as rank from ranked where rank <= 60 group by all)
    select query_id, source, rank from (select *, row_number() over (partition by query_id order by rank, source) as i from f) where i <= 3""",
)
def first_files(spark, sf_dir):
    """First three distinct sources of each result list."""
    lane = passage_lane(spark, sf_dir, BODY_ONLY)
    return mt.first_sources(lane).select("query_id", F.col("source_id").alias("source"), F.col("rank").cast("long").alias("rank"))


@register(
    "index_status",
    """select (select count(distinct source) from documents) as sources, (select count(*) from documents) as chunks,
      (select count(*) from embeddings) as embeddings""",
)
def index_status(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("chunks"))
    return docs.join(F.broadcast(table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("embeddings"))))


@register(
    "candidate_projection",
    f"""with {SQL_PASSAGE_SCORES}
    select r.query_id, r.rank, r.doc_id, d.source, d.lang, d.source || '/' || d.doc_id || '.md' as relative_path, sha256(d.text) as source_version, d.text
    from ranked r join documents d on d.doc_id = r.doc_id where r.rank <= 10""",
)
def candidate_projection(spark, sf_dir):
    """Ids are ranked first; text and source columns are joined only for the returned rows."""
    lane = passage_lane(spark, sf_dir, BODY_ONLY.override({"bm25_candidates": 10}), keep=())
    few = fits(passages(spark, sf_dir), BROADCAST_ROW_LIMIT // 10)  # ten rows a passage
    docs = units(spark, sf_dir)
    return docs.join(small_side(lane, few), "chunk_id").select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"),
        F.col("source_id").alias("source"), F.col("collection_id").alias("lang"), "relative_path",
        tx.content_hash("text").alias("source_version"), "text",
    )
