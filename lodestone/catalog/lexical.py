"""Registered queries: lexical lane."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RetrievalOptions
from ..operators import lexical as lx
from .common import (
    SQL_DOC_TERMS, SQL_PASSAGE_SCORES, SQL_PASSAGE_TERMS, passages, register, sql_bm25plus, sql_tokens,
    table, units,
)

BODY_ONLY = RetrievalOptions(title_weight=0.0)


def document_terms(spark, sf_dir, keep=("source_id",)):
    return lx.term_table(units(spark, sf_dir), keep=keep)


def passage_lane(spark, sf_dir, options=BODY_ONLY, keep=("source_id",), **kw):
    return lx.lexical_lane(
        document_terms(spark, sf_dir, keep), passages(spark, sf_dir), options, keep=keep, title=False, **kw
    )




@register(
    "bm25_topk",
    f"""with {SQL_PASSAGE_SCORES}
    select query_id, rank, doc_id, source, round(score, 6) as score from ranked where rank <= 10""",
)
def bm25_topk(spark, sf_dir):
    """Top 10 documents of every benchmark passage by BM25+."""
    lane = passage_lane(spark, sf_dir, BODY_ONLY.override({"bm25_candidates": 10}))
    return lane.select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"),
        F.col("source_id").alias("source"), F.round("score", 6).alias("score"),
    )


@register(
    "bm25_batch_queries",
    f"""with {SQL_PASSAGE_SCORES}
    select query_id, count(*) as candidates, max(score) as best, min(rank) as first_rank,
           sum(case when rank <= 10 then score else 0e0 end) as top10_score
    from ranked where rank <= 60 group by query_id""".replace("max(score)", "round(max(score), 6)").replace(
        "sum(case when rank <= 10 then score else 0e0 end)",
        "round(sum(case when rank <= 10 then score else 0e0 end), 6)",
    ),
)
def bm25_batch_queries(spark, sf_dir):
    lane = passage_lane(spark, sf_dir)
    return lane.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.round(F.max("score"), 6).alias("best"),
        F.min("rank").cast("long").alias("first_rank"),
        F.round(F.sum(F.when(F.col("rank") <= 10, F.col("score")).otherwise(0.0)), 6).alias("top10_score"),
    )


@register(
    "bm25_parameter_sweep",
    f"""with {SQL_DOC_TERMS}, {SQL_PASSAGE_TERMS},
    params(arm, k, b, d) as (values ('default', 1.2e0, 0.7e0, 0.5e0), ('lower_k', 0.84e0, 0.7e0, 0.5e0), ('lower_b', 1.2e0, 0.49e0, 0.5e0)),
    scores as (
      select arm, q.query_id, t.doc_id, round(sum({sql_bm25plus(k='p.k', b='p.b', d='p.d')}), 9) as score
      from params p, query_terms q join doc_terms t on t.term = q.term join dfs f on f.term = q.term
      join doc_len l on l.doc_id = t.doc_id cross join corpus c group by all),
    ranked as (select *, row_number() over (partition by arm, query_id order by score desc, doc_id) as rank from scores)
    select arm, query_id, doc_id, rank, round(score, 6) as score from ranked where rank <= 5""",
)
def bm25_parameter_sweep(spark, sf_dir):
    """The three published parameter arms, each over the whole corpus."""
    out, terms, asked = None, document_terms(spark, sf_dir, ()), passages(spark, sf_dir)
    matched = lx.match(terms, asked, title=False)  # one pass over the texts for all arms
    for arm, k, b, d in (("default", 1.2, 0.7, 0.5), ("lower_k", 0.84, 0.7, 0.5), ("lower_b", 1.2, 0.49, 0.5)):
        options = BODY_ONLY.override({"bm25_k": k, "bm25_b": b, "bm25_d": d, "bm25_candidates": 5})
        lane = lx.lexical_lane(terms, asked, options, title=False, matched=matched).select(
            F.lit(arm).alias("arm"), "query_id", F.col("chunk_id").alias("doc_id"),
            F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"),
        )
        out = lane if out is None else out.unionByName(lane)
    return out


_FTS = """with {terms}, {queries},
    scores as (
      select q.query_id, t.doc_id, round(sum({idf} * (t.tf * 2.2e0) / (t.tf + 1.2e0 * (0.25e0 + 0.75e0 * l.total_len / c.avg_total))), 9) as score
      from query_terms q join doc_terms t on t.term = q.term join dfs f on f.term = q.term
      join doc_len l on l.doc_id = t.doc_id cross join corpus c group by all),
    ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scores)"""
_CLAMPED = "greatest(ln((c.n_docs - f.df + 0.5e0) / (f.df + 0.5e0)), 1e-6)"
_SHIFTED = "ln(1e0 + (c.n_docs - f.df + 0.5e0) / (f.df + 0.5e0))"


@register(
    "bm25_fts_topk",
    _FTS.format(terms=SQL_DOC_TERMS, queries=SQL_PASSAGE_TERMS, idf=_CLAMPED)
    + " select query_id, rank, doc_id, round(score, 6) as score from ranked where rank <= 10",
)
def bm25_fts_topk(spark, sf_dir):
    options = RetrievalOptions(lexical_engine="fts", bm25_candidates=10)
    lane = passage_lane(spark, sf_dir, options)
    return lane.select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"),
        F.round("score", 6).alias("score"),
    )


@register(
    "bm25_fts_shifted_idf",
    _FTS.format(terms=SQL_DOC_TERMS, queries=SQL_PASSAGE_TERMS, idf=_SHIFTED)
    + " select query_id, rank, doc_id, round(score, 6) as score from ranked where rank <= 10",
)
def bm25_fts_shifted_idf(spark, sf_dir):
    options = RetrievalOptions(lexical_engine="fts", bm25_candidates=10)
    lane = passage_lane(spark, sf_dir, options, idf_variant="shifted")
    return lane.select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").alias("doc_id"),
        F.round("score", 6).alias("score"),
    )


@register(
    "idf_variants",
    f"""with {SQL_DOC_TERMS}
    select f.term, f.df, round({_CLAMPED}, 6) as clamped, round({_SHIFTED}, 6) as shifted from dfs f cross join corpus c""",
)
def idf_variants(spark, sf_dir):
    terms = document_terms(spark, sf_dir, ())
    stats = lx.corpus_stats(terms)
    return lx.term_frequencies(terms).join(F.broadcast(stats)).select(
        "term", "df",
        F.round(lx.bm25_idf(F.col("df"), F.col("n_docs"), "clamped"), 6).alias("clamped"),
        F.round(lx.bm25_idf(F.col("df"), F.col("n_docs"), "shifted"), 6).alias("shifted"),
    )


@register(
    "term_stats",
    f"with {SQL_DOC_TERMS} select term, count(*) as df, cast(sum(tf) as bigint) as occurrences from doc_terms group by term",
)
def term_stats(spark, sf_dir):
    return lx.term_frequencies(document_terms(spark, sf_dir, ()))


@register(
    "doc_lengths",
    f"with {SQL_DOC_TERMS} select doc_id, cast(dl as bigint) as distinct_terms, cast(total_len as bigint) as total_terms from doc_len",
)
def doc_lengths(spark, sf_dir):
    return document_terms(spark, sf_dir, ()).select(
        F.col("chunk_id").alias("doc_id"), F.col("body_len").cast("long").alias("distinct_terms"),
        F.col("total_len").cast("long").alias("total_terms"),
    )


@register(
    "corpus_statistics",
    f"with {SQL_DOC_TERMS} select n_docs, round(avg_dl, 6) as avg_distinct, round(avg_total, 6) as avg_total from corpus",
)
def corpus_statistics(spark, sf_dir):
    return lx.corpus_stats(document_terms(spark, sf_dir, ())).select(
        "n_docs", F.round("avg_body", 6).alias("avg_distinct"), F.round("avg_total", 6).alias("avg_total")
    )


@register(
    "query_terms_capped",
    f"with {SQL_PASSAGE_TERMS} select query_id, term from query_terms",
)
def query_terms_capped(spark, sf_dir):
    return lx.query_terms(passages(spark, sf_dir)).select("query_id", "term")


@register(
    "filtered_lexical_lane",
    f"""with {SQL_PASSAGE_SCORES},
    screened as (select *, row_number() over (partition by query_id order by score desc, doc_id) as lane_rank
                 from scores where lang in ('fr', 'de') and starts_with(source || '/', 'src1'))
    select query_id, doc_id, lane_rank, round(score, 6) as score from screened where lane_rank <= 10""",
)
def filtered_lexical_lane(spark, sf_dir):
    """Scope filter before the cap, corpus statistics over everything."""
    options = BODY_ONLY.override({"bm25_candidates": 10})
    allowed = F.col("collection_id").isin("fr", "de") & F.col("relative_path").startswith("src1")
    lane = passage_lane(
        spark, sf_dir, options, keep=("source_id", "collection_id", "relative_path"), allowed=allowed
    )
    return lane.select(
        "query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("lane_rank"),
        F.round("score", 6).alias("score"),
    )


_PAGE_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@register(
    "bm25_title_boost",
    f"""with toks as (select page_id, {sql_tokens(_PAGE_TITLE)} as tt, {sql_tokens('html')} as bt from pages),
    lens as (select page_id, len(list_distinct(tt)) as tl, len(list_distinct(bt)) as bl from toks),
    corpus as (select count(*) as n, avg(tl) as avg_t, avg(bl) as avg_b from lens),
    post as (select page_id, 'title' as field, term, count(*) as tf from (select page_id, unnest(tt) as term from toks) group by all
             union all
             select page_id, 'body', term, count(*) from (select page_id, unnest(bt) as term from toks) group by all),
    dfs as (select field, term, count(*) as df from post group by all),
    {SQL_PASSAGE_TERMS},
    scores as (
      select q.query_id, p.page_id,
        round(sum(case when p.field = 'title' then 2e0 else 1e0 end * {sql_bm25plus(tf='p.tf', df='f.df', n='c.n', length="(case when p.field = 'title' then l.tl else l.bl end)", average="(case when p.field = 'title' then c.avg_t else c.avg_b end)")}), 9) as score
      from query_terms q join post p on p.term = q.term join dfs f on f.term = p.term and f.field = p.field
      join lens l on l.page_id = p.page_id cross join corpus c group by all),
    ranked as (select *, row_number() over (partition by query_id order by score desc, page_id) as rank from scores)
    select query_id, page_id, rank, round(score, 6) as score from ranked where rank <= 10""",
)
def bm25_title_boost(spark, sf_dir):
    """Two weighted fields: page title (weight 2) and page body."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("chunk_id"), F.col("html").alias("text"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
    )
    terms = lx.term_table(pages, title=F.col("title"))
    lane = lx.lexical_lane(terms, passages(spark, sf_dir), RetrievalOptions(bm25_candidates=10))
    return lane.select(
        "query_id", F.col("chunk_id").alias("page_id"), F.col("rank").cast("long").alias("rank"),
        F.round("score", 6).alias("score"),
    )
