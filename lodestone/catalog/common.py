"""Shared inputs of the registered queries and shared fragments of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as retrieval units: a document is a chunk, its ``source`` is the source."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("collection_id"),
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("relative_path"),
        "text",
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- SQL fragments ---------------------------------------------------------------------
_A = r"[\p{L}\p{M}]+(?:[''’.·‧][\p{L}\p{M}]+)*"
_B = r"\p{N}+(?:[''’.,;]\p{N}+)*"
SQL_WORD = rf"_*(?:{_A}|{_B})(?:_|{_A}|{_B})*"
SQL_IDENT = r"[A-Za-z][A-Za-z0-9_.$-]*"


def sql_tokens(text: str) -> str:
    """List of index terms of a SQL text expression."""
    joined = f"array_to_string(regexp_extract_all({text}, '{SQL_IDENT}'), ' ')"
    camel = (
        f"regexp_replace(regexp_replace({joined}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), "
        f"'([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    )
    return (
        f"list_concat(list_concat(regexp_extract_all(lower({text}), '{SQL_WORD}'), "
        f"list_filter(string_split(lower({joined}), ' '), lambda x: x <> '')), "
        f"regexp_extract_all(lower({camel}), '[a-z0-9]+'))"
    )


def sql_ordered_tokens(text: str) -> str:
    camel = (
        "regexp_replace(regexp_replace(x, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), "
        "'([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    )
    return (
        f"list_concat(regexp_extract_all(lower({text}), '{SQL_WORD}'), "
        f"flatten(list_transform(regexp_extract_all({text}, '{SQL_IDENT}'), "
        f"lambda x: list_concat([lower(x)], regexp_extract_all(lower({camel}), '[a-z0-9]+')))))"
    )


def sql_query_terms(source: str, key: str, text: str = "text") -> str:
    """(query_id, term): first 128 distinct terms in order."""
    return f"""
      select query_id, term from (
        select query_id, term, row_number() over (partition by query_id order by pos) as rn
        from (select query_id, term, min(pos) as pos
              from (select query_id, unnest(toks) as term, generate_subscripts(toks, 1) as pos
                    from (select {key} as query_id, {sql_ordered_tokens(text)} as toks from {source}))
              group by query_id, term))
      where rn <= 128"""


SQL_DOC_TERMS = f"""
  doc_tokens as materialized (select doc_id, source, lang, {sql_tokens('text')} as toks from documents),
  doc_terms as materialized (select doc_id, source, lang, term, count(*) as tf
                from (select doc_id, source, lang, unnest(toks) as term from doc_tokens) group by all),
  doc_len as materialized (select doc_id, len(list_distinct(toks)) as dl, len(toks) as total_len from doc_tokens),
  corpus as (select count(*) as n_docs, avg(dl) as avg_dl, avg(total_len) as avg_total from doc_len),
  dfs as materialized (select term, count(*) as df from doc_terms group by term)"""

SQL_PASSAGE_TERMS = f"query_terms as materialized ({sql_query_terms('benchmark', 'item_id')})"


def sql_bm25plus(tf="t.tf", df="f.df", n="c.n_docs", length="l.dl", average="c.avg_dl", k="1.2", b="0.7", d="0.5") -> str:
    return (
        f"ln(1e0 + ({n} - {df} + 0.5e0) / ({df} + 0.5e0)) * (cast({d} as double) + {tf} * (cast({k} as double) + 1e0) / "
        f"({tf} + cast({k} as double) * (1e0 - cast({b} as double) + cast({b} as double) * {length} / {average})))"
    )


SQL_PASSAGE_SCORES = f"""
  {SQL_DOC_TERMS},
  {SQL_PASSAGE_TERMS},
  scores as materialized (
    select q.query_id, t.doc_id, t.source, t.lang, round(sum({sql_bm25plus()}), 9) as score
    from query_terms q join doc_terms t on t.term = q.term join dfs f on f.term = q.term
    join doc_len l on l.doc_id = t.doc_id cross join corpus c
    group by all),
  ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scores)"""


# --- Hybrid queries: every passage paired with the centroid vector of label item_id mod 10.
# Documents and vectors carry no foreign key; vec_id = doc_id is this catalog's convention.
LABELS = 10

SQL_CENTROIDS = """
  cells as (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings),
  centroids as (select label, list(m order by i) as v from (select label, i, avg(x) as m from cells group by all) group by label)"""

SQL_HYBRID = f"""
  {SQL_PASSAGE_SCORES},
  lexical_lane as materialized (select query_id, doc_id, rank, score from ranked where rank <= 60),
  {SQL_CENTROIDS},
  dense_sims as materialized (
    select b.item_id as query_id, e.vec_id as doc_id,
           round(list_cosine_similarity(c.v, e.embedding::double[]), 9) as similarity
    from benchmark b join centroids c on c.label = b.item_id % {LABELS} cross join embeddings e),
  dense_ranked as (select *, row_number() over (partition by query_id order by similarity desc, doc_id) as rank
                   from dense_sims where similarity >= 0.3),
  dense_lane as materialized (select * from dense_ranked where rank <= 60),
  fused as (
    select coalesce(l.query_id, d.query_id) as query_id, coalesce(l.doc_id, d.doc_id) as doc_id,
           round(coalesce(0.5e0 / (10 + l.rank), 0) + coalesce(1e0 / (10 + d.rank), 0), 12) as score,
           l.rank as bm25_rank, d.rank as dense_rank, d.similarity
    from lexical_lane l full outer join dense_lane d on l.query_id = d.query_id and l.doc_id = d.doc_id),
  fused_ranked as materialized (
    select *, row_number() over (partition by query_id order by score desc, doc_id) as position from fused where score > 0)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("chunk_id"), "embedding", "label"
    )
