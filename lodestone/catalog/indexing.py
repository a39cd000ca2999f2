"""Registered queries: an index built from the documents, searched and brought up to date; user dictionaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..errors import RetrievalError
from ..functions.text import LINE_BREAK, content_hash
from ..operators import lexical as lx
from ..plans.index import EvidenceIndex, IndexProfile
from ..session import ensure_checkpoint_dir
from .common import SQL_DOC_TERMS, SQL_PASSAGE_TERMS, passages, register, sql_bm25plus, sql_ordered_tokens, table, units
from .lexical import BODY_ONLY

# Entries of the user dictionary; with a space, so that no ordinary term equals them.
DICTIONARY = ("of the", "in the", "the data")
_NOT_BLANK = "(select * from documents where regexp_matches(text, '\\S'))"


def _sources(documents: DataFrame) -> DataFrame:
    """Documents in the form of parsed source files."""
    text = F.coalesce("text", F.lit(""))
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return documents.select(
        F.col("doc_id").cast("string").alias("source_id"), F.lit(False).alias("has_identity"), F.col("lang").alias("collection_id"),
        path.alias("path"), F.substring(path, 2, 1 << 30).alias("relative_path"), content_hash(text).alias("source_version"),
        F.lit(1).alias("first_line"), F.size(F.split(text, LINE_BREAK, -1)).alias("last_line"), text.alias("text"),
    )


def _fresh_index(spark) -> EvidenceIndex:
    return EvidenceIndex(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}", IndexProfile("whole"))


_INDEX_TOPK = f"""with {SQL_DOC_TERMS}, {SQL_PASSAGE_TERMS},
    scores as (
      select q.query_id, t.doc_id, round(sum({sql_bm25plus()}), 9) as score
      from query_terms q join doc_terms t on t.term = q.term join dfs f on f.term = q.term
      join doc_len l on l.doc_id = t.doc_id cross join corpus c group by all),
    ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scores)
    select query_id, rank, round(score, 6) as score from ranked where rank <= 10""".replace("from documents)", f"from {_NOT_BLANK})")


def _top10(spark, sf_dir, index: EvidenceIndex, state: dict) -> DataFrame:
    lengths = index.numbered_lengths(state)
    lane = lx.lexical_lane(
        None, passages(spark, sf_dir), BODY_ONLY.override({"bm25_candidates": 10}), title=False,
        stats=lx.corpus_stats(lengths), counted=index.postings(state), numbered=lengths,
    )
    return lane.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@register("index_search_topk", _INDEX_TOPK)
def index_search_topk(spark, sf_dir):
    """Ten best scores of every passage, from the stored postings of an index over all documents."""
    index = _fresh_index(spark)
    index.sync(_sources(table(spark, sf_dir, "documents")))
    return _top10(spark, sf_dir, index, index.require("bm25"))


_TOPK = _INDEX_TOPK.replace("select query_id, rank, round(score, 6) as score from ranked", "select query_id, rank, round(score, 6) as score, 1::bigint as segments from ranked")


@register("index_compaction", _TOPK)
def index_compaction(spark, sf_dir):
    """Ten best scores of every passage after three syncs, of more languages each, were merged into one segment."""
    documents = table(spark, sf_dir, "documents")
    index = _fresh_index(spark)
    for known in (F.col("lang").isin("de", "es"), F.col("lang").isin("de", "es", "fr"), F.lit(True)):
        index.sync(_sources(documents.filter(known)))
    index.compact(everything=True)
    state = index.require("bm25")
    return _top10(spark, sf_dir, index, state).withColumn("segments", F.lit(len(state["segments"])).cast("long"))


class SizeEmbeddings:
    """Vectors made of a text's length: a provider that needs no model."""

    fingerprint, dimensions = "size-1", 2

    def embed(self, texts, purpose):
        return [[1.0, float(len(t))] for t in texts], sum(map(len, texts))


@register(
    "layer_readiness",
    """with filled as (select doc_id from documents where regexp_matches(text, '\\S')),
    toxic as (select doc_id from labels where toxic = 1)
    select 'chunks' as layer, count(*) as rows, 'ready' as state from filled
    union all select 'terms', count(*), 'ready' from filled
    union all select 'vectors', (select count(*) from filled anti join toxic using (doc_id)),
      (select case when count(*) > 0 then 'INDEX_STALE' else 'ready' end from documents semi join toxic using (doc_id))""",
)
def layer_readiness(spark, sf_dir):
    """Rows and readiness of each layer after toxic documents came in a sync without the embedding provider."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index, provider = _fresh_index(spark), SizeEmbeddings()
    key = index.profile.vector_key(provider)
    index.sync(_sources(documents.join(labels.filter("toxic = 1"), "doc_id", "left_anti")), provider)
    index.sync(_sources(documents))
    state = index.state()

    def readiness(mode):
        try:
            index.require(mode, key)
        except RetrievalError as error:
            return error.code
        return "ready"

    have = [s["vectors"][key] for s in state["segments"] if key in s["vectors"]]
    layers = [
        ("chunks", index.chunks(state), readiness("bm25")), ("terms", index.lengths(state), readiness("bm25")),
        ("vectors", spark.read.parquet(*have), readiness("dense")),
    ]
    out = None
    for name, rows, ready in layers:
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("layer"), "rows", F.lit(ready).alias("state"))
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "index_resync_counts",
    """with toxic as (select distinct doc_id from labels where toxic = 1), poor as (select distinct doc_id from labels where quality = 0),
    d as (select doc_id, regexp_matches(coalesce(text, ''), '\\S') as filled, doc_id in (select doc_id from toxic) as t,
          doc_id in (select doc_id from poor) as p, doc_id in (select doc_id from labels where doc_id is not null) as labelled from documents)
    select count_if(t and not p) as added, count_if(not t and not p and not labelled) as updated, count_if(p and not t) as removed,
      count_if(not t and not p and labelled) as unchanged, count_if(not p) as sources, count_if(not p and (filled or not labelled)) as chunks from d""",
)
def index_resync_counts(spark, sf_dir):
    """Changes of a second sync: toxic documents come, documents of low quality go, and unlabelled ones got a line more."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = _fresh_index(spark)
    index.sync(_sources(documents.join(labels.filter("toxic = 1"), "doc_id", "left_anti")))
    known = labels.select("doc_id", F.lit(True).alias("labelled")).distinct()
    edited = documents.join(known, "doc_id", "left").withColumn(
        "text", F.when(F.col("labelled"), F.col("text")).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit("\nreviewed")))
    )
    done = index.sync(_sources(edited.join(labels.filter("quality = 0"), "doc_id", "left_anti")))
    state = index.require("bm25")
    names = ("added", "updated", "removed", "unchanged")
    counts = index.sources(state).agg(F.count(F.lit(1)).alias("sources")).join(index.chunks(state).agg(F.count(F.lit(1)).alias("chunks")))
    return counts.select(*[F.lit(done[n]).cast("long").alias(n) for n in names], "sources", "chunks")


_ENTRIES = ", ".join(f"({i}, '{entry}')" for i, entry in enumerate(DICTIONARY))


@register(
    "dictionary_terms",
    f"""with entries(i, term) as (values {_ENTRIES}),
    q as (select item_id, lower(text) as text, len(list_distinct({sql_ordered_tokens('text')})) as known from benchmark),
    hits as (select e.term, known + row_number() over (partition by item_id order by e.i) as place from q join entries e on contains(q.text, e.term))
    select term, (select count(*) from documents where contains(lower(text), e.term)) as documents,
      (select count(*) from hits h where h.term = e.term and place <= {lx.QUERY_TERM_CAP}) as queries from entries e""",
)
def dictionary_terms(spark, sf_dir):
    """Documents and passages that hold an entry of the user dictionary as a term."""
    entries = spark.createDataFrame([(e,) for e in DICTIONARY], "term string")
    count = lambda terms, name: terms.join(F.broadcast(entries), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias(name))
    indexed = lx.term_table(units(spark, sf_dir), dictionary=DICTIONARY)
    documents = count(indexed.select("chunk_id", F.explode(F.array_distinct("body_terms")).alias("term")), "documents")
    queries = count(lx.query_terms(passages(spark, sf_dir), dictionary=DICTIONARY), "queries")
    return entries.join(documents, "term", "left").join(queries, "term", "left").fillna(0)
