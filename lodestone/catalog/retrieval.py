"""Registered queries: filters, dense lane, fusion, variants and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RetrievalOptions, SearchFilters
from ..functions.vectors import unit_vector
from ..operators import dense, fusion, lexical as lx, selection
from .common import (
    LABELS, SQL_CENTROIDS, SQL_DOC_TERMS, SQL_HYBRID, SQL_PASSAGE_SCORES, passages, register,
    sql_bm25plus, sql_query_terms, table, units, vectors,
)
from .lexical import BODY_ONLY, document_terms, passage_lane


# --- filters ---------------------------------------------------------------------------
def _filtered(spark, sf_dir, filters):
    docs = units(spark, sf_dir)
    return docs.filter(selection.scope(filters)).select(
        F.col("chunk_id").alias("doc_id"), F.col("source_id").alias("source"),
        F.col("collection_id").alias("lang"), "relative_path",
    )


_PATHS = "select doc_id, source, lang, source || '/' || doc_id || '.md' as relative_path from documents"


@register("filter_source_in", f"select * from ({_PATHS}) where source in ('src1', 'src7') and lang in ('en', 'es')")
def filter_source_in(spark, sf_dir):
    return _filtered(spark, sf_dir, SearchFilters(collections=("en", "es"), source_ids=("src1", "src7")))


@register(
    "filter_empty_list",
    "select (select count(*) from documents where false) as matching, (select count(*) from documents) as unfiltered",
)
def filter_empty_list(spark, sf_dir):
    """An empty list selects nothing; an absent one everything."""
    docs = units(spark, sf_dir)
    nothing = selection.scope(SearchFilters(source_ids=()))
    return docs.agg(
        F.sum(F.when(nothing, 1).otherwise(0)).cast("long").alias("matching"),
        F.count(F.lit(1)).alias("unfiltered"),
    )


@register("filter_path_prefix", f"select * from ({_PATHS}) where starts_with(relative_path, 'src1/')")
def filter_path_prefix(spark, sf_dir):
    """The prefix is literal, not a pattern."""
    return _filtered(spark, sf_dir, SearchFilters(path_prefix="src1/"))


# --- dense lane ------------------------------------------------------------------------
def centroid_queries(spark, sf_dir):
    centroids = dense.label_centroids(vectors(spark, sf_dir))
    return centroids.select(F.col("label").cast("long").alias("query_id"), "embedding")


def hybrid_queries(spark, sf_dir):
    centroids = centroid_queries(spark, sf_dir).withColumnRenamed("query_id", "label")
    items = passages(spark, sf_dir).withColumn("label", F.col("query_id") % LABELS)
    return items.join(centroids, "label").select("query_id", "text", "embedding")


_SELF = """with sims as (
      select a.vec_id as query_id, b.vec_id as doc_id,
             round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as similarity
      from embeddings a cross join embeddings b),
    ranked as (select *, row_number() over (partition by query_id order by similarity desc, doc_id) as rank from sims {where})"""


@register(
    "dense_topk",
    f"""with {SQL_CENTROIDS},
    sims as (select c.label as query_id, e.vec_id as doc_id, round(list_cosine_similarity(c.v, e.embedding::double[]), 9) as similarity
             from centroids c cross join embeddings e),
    ranked as (select *, row_number() over (partition by query_id order by similarity desc, doc_id) as rank from sims where similarity >= 0.3)
    select cast(query_id as bigint) as query_id, doc_id, rank, round(similarity, 6) as similarity from ranked where rank <= 60""",
)
def dense_topk(spark, sf_dir):
    """Top 60 vectors of every label centroid above the default similarity floor."""
    lane = dense.dense_lane(vectors(spark, sf_dir), centroid_queries(spark, sf_dir))
    return lane.select(
        "query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"),
        F.round("similarity", 6).alias("similarity"),
    )


@register(
    "dense_batch_topk",
    _SELF.format(where="")
    + " select query_id, doc_id, rank, round(similarity, 6) as similarity from ranked where rank <= 10",
)
def dense_batch_topk(spark, sf_dir):
    """Ten nearest vectors of every vector."""
    corpus = vectors(spark, sf_dir)
    queries = corpus.select(F.col("chunk_id").alias("query_id"), "embedding")
    options = RetrievalOptions(dense_candidates=10, min_dense_similarity=-1.0)
    return dense.dense_lane(corpus, queries, options).select(
        "query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"),
        F.round("similarity", 6).alias("similarity"),
    )


@register(
    "dense_threshold",
    _SELF.format(where="where similarity >= 0.5")
    + " select query_id, count(*) as candidates, round(min(similarity), 6) as weakest from ranked where rank <= 60 group by query_id",
)
def dense_threshold(spark, sf_dir):
    corpus = vectors(spark, sf_dir)
    queries = corpus.select(F.col("chunk_id").alias("query_id"), "embedding")
    lane = dense.dense_lane(corpus, queries, RetrievalOptions(min_dense_similarity=0.5))
    return lane.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.round(F.min("similarity"), 6).alias("weakest")
    )


@register(
    "dense_filtered_lane",
    f"""with {SQL_CENTROIDS},
    sims as (select c.label as query_id, e.vec_id as doc_id, round(list_cosine_similarity(c.v, e.embedding::double[]), 9) as similarity
             from centroids c cross join embeddings e join documents d on d.doc_id = e.vec_id where d.lang = 'en'),
    ranked as (select *, row_number() over (partition by query_id order by similarity desc, doc_id) as rank from sims where similarity >= 0.3)
    select cast(query_id as bigint) as query_id, doc_id, rank, round(similarity, 6) as similarity from ranked where rank <= 20""",
)
def dense_filtered_lane(spark, sf_dir):
    """Collection filter joined in before the candidate cap."""
    scope = selection.scope(SearchFilters(collections=("en",)))
    allowed = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("lang").alias("collection_id")
    ).filter(scope)
    corpus = vectors(spark, sf_dir).join(allowed, "chunk_id", "left_semi")
    lane = dense.dense_lane(corpus, centroid_queries(spark, sf_dir), RetrievalOptions(dense_candidates=20))
    return lane.select(
        "query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"),
        F.round("similarity", 6).alias("similarity"),
    )


@register(
    "vector_normalize",
    """with s as (select vec_id, embedding::double[] as v, list_max(list_transform(embedding::double[], lambda x: abs(x))) as m from embeddings),
    u as (select vec_id, v, list_transform(v, lambda x: x / m) as w from s),
    n as (select vec_id, w, sqrt(list_sum(list_transform(w, lambda x: x * x))) as norm from u)
    select vec_id, round(((w[1] / norm)::float)::double, 6) as first_value, round(((w[len(w)] / norm)::float)::double, 6) as last_value,
           round(list_sum(list_transform(w, lambda x: (x / norm) * (x / norm))), 6) as squared_norm from n""",
)
def vector_normalize(spark, sf_dir):
    unit = vectors(spark, sf_dir).select("chunk_id", unit_vector("embedding", 64).alias("u"))
    squares = F.aggregate("u", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return unit.select(
        F.col("chunk_id").alias("vec_id"), F.round(F.col("u")[0].cast("double"), 6).alias("first_value"),
        F.round(F.element_at("u", -1).cast("double"), 6).alias("last_value"),
        F.round(squares, 6).alias("squared_norm"),
    )


# --- fusion ----------------------------------------------------------------------------
def hybrid_pool(spark, sf_dir, options=BODY_ONLY):
    """Fused candidate pool of every passage (lexical text lane, centroid vector lane)."""
    lexical = fusion.tag_lane(passage_lane(spark, sf_dir, options, keep=()), "bm25")
    near = dense.dense_lane(
        vectors(spark, sf_dir), hybrid_queries(spark, sf_dir).drop("text"), options
    )
    lanes = lexical.unionByName(fusion.tag_lane(near, "dense"))
    return fusion.rank_fused(fusion.fuse(lanes, options))


_POOL_COLUMNS = """query_id, doc_id, position, round(score, 6) as score, bm25_rank, dense_rank, round(similarity, 6) as similarity"""


def _pool_rows(pool):
    return pool.select(
        "query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("position"),
        F.round("score", 6).alias("score"), F.col("bm25_rank").cast("long").alias("bm25_rank"),
        F.col("dense_rank").cast("long").alias("dense_rank"), F.round("similarity", 6).alias("similarity"),
    )


@register("rrf_hybrid", f"with {SQL_HYBRID} select {_POOL_COLUMNS} from fused_ranked")
def rrf_hybrid(spark, sf_dir):
    return _pool_rows(hybrid_pool(spark, sf_dir))


@register(
    "rrf_single_lane_weight",
    f"""with {SQL_HYBRID}
    select query_id, doc_id, rank as position, round(1e0 / (10 + rank), 6) as score from dense_lane""",
)
def rrf_single_lane_weight(spark, sf_dir):
    """Dense mode: the lane counts with weight 1, not with its configured weight."""
    options = RetrievalOptions(mode="dense", dense_weight=0.25)
    near = dense.dense_lane(vectors(spark, sf_dir), hybrid_queries(spark, sf_dir).drop("text"), options)
    pool = fusion.rank_fused(fusion.fuse(fusion.tag_lane(near, "dense"), options))
    return pool.select(
        "query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("position"),
        F.round("score", 6).alias("score"),
    )


@register(
    "rrf_reweight_sweep",
    f"""with {SQL_HYBRID},
    arms(bw, k) as (values (0e0, 10), (0.1e0, 10), (0.25e0, 30), (0.5e0, 5)),
    scored as (select bw, k, query_id, doc_id, round(coalesce(bw / (k + bm25_rank), 0) + coalesce(1e0 / (k + dense_rank), 0), 12) as s
               from fused_ranked cross join arms),
    again as (select *, row_number() over (partition by bw, k, query_id order by s desc, doc_id) as position from scored where s > 0)
    select bw as bm25_weight, cast(k as double) as rrf_k, query_id, doc_id, position, round(s, 6) as score from again where position <= 10""",
)
def rrf_reweight_sweep(spark, sf_dir):
    arms = [(0.0, 1.0, 10), (0.1, 1.0, 10), (0.25, 1.0, 30), (0.5, 1.0, 5)]
    swept = fusion.reweight(hybrid_pool(spark, sf_dir).drop("score", "rank"), arms)
    return swept.filter("rank <= 10").select(
        "bm25_weight", "rrf_k", "query_id", F.col("chunk_id").alias("doc_id"),
        F.col("rank").cast("long").alias("position"), F.round("score", 6).alias("score"),
    )


@register(
    "lane_projection",
    f"""with {SQL_HYBRID}
    select 'bm25' as lane, query_id, doc_id, bm25_rank as rank from fused_ranked where bm25_rank is not null
    union all select 'dense', query_id, doc_id, dense_rank from fused_ranked where dense_rank is not null""",
)
def lane_projection(spark, sf_dir):
    pool = hybrid_pool(spark, sf_dir)
    rows = None
    for lane in ("bm25", "dense"):
        one = fusion.lane_projection(pool, lane).select(
            F.lit(lane).alias("lane"), "query_id", F.col("chunk_id").alias("doc_id"),
            F.col("rank").cast("long").alias("rank"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@register(
    "candidate_pool_depth",
    f"""with {SQL_HYBRID},
    relevant as (select doc_id from labels where quality = 1),
    marked as (select f.*, r.doc_id is not null as rel from fused_ranked f left join relevant r using (doc_id))
    select query_id, cast(sum(case when rel and position <= 10 then 1 else 0 end) as bigint) as top10,
      cast(sum(case when rel and position <= 20 then 1 else 0 end) as bigint) as top20,
      cast(sum(case when rel and position <= 50 then 1 else 0 end) as bigint) as top50,
      cast(sum(case when rel then 1 else 0 end) as bigint) as pool,
      cast(sum(case when rel and dense_rank is not null then 1 else 0 end) as bigint) as dense_pool,
      cast(sum(case when rel and bm25_rank is not null then 1 else 0 end) as bigint) as bm25_pool
    from marked group by query_id""",
)
def candidate_pool_depth(spark, sf_dir):
    from ..operators.metrics import pool_depth

    relevant = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    return pool_depth(hybrid_pool(spark, sf_dir), relevant)


@register(
    "candidate_pool_recall",
    f"""with {SQL_HYBRID},
    wanted as materialized (select item_id as query_id, doc_id from benchmark join labels on labels.doc_id % 10 = item_id % 10 where quality = 1 group by all),
    marked as (select w.query_id, f.position, f.dense_rank, f.bm25_rank from wanted w left join fused_ranked f on f.query_id = w.query_id and f.doc_id = w.doc_id)
    select query_id, count(*) as relevant, round(count(*) filter (position <= 10) / count(*)::double, 6) as top10, round(count(*) filter (position <= 20) / count(*)::double, 6) as top20,
      round(count(*) filter (position <= 50) / count(*)::double, 6) as top50, round(count(position) / count(*)::double, 6) as pool,
      round(count(dense_rank) / count(*)::double, 6) as dense_pool, round(count(bm25_rank) / count(*)::double, 6) as bm25_pool from marked group by query_id""",
)
def candidate_pool_recall(spark, sf_dir):
    """Share of each passage's relevant documents (good ones whose last digit is the passage's) in bands and lanes of its pool."""
    from ..operators.metrics import pool_recall

    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 10).alias("digit"))
    asked = passages(spark, sf_dir).select("query_id", (F.col("query_id") % 10).alias("digit"))
    recall = pool_recall(hybrid_pool(spark, sf_dir), good.join(asked, "digit").select("query_id", "chunk_id"))
    return recall.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in recall.dtypes])




@register(
    "variant_merge",
    f"""with {SQL_DOC_TERMS},
    expressions as (select item_id * 4 + 0 as query_id, text from benchmark
                    union all select item_id * 4 + 1, split_part(text, '.', 1) from benchmark
                    union all select item_id * 4 + 2, split_part(text, '.', 2) from benchmark),
    distinct_expressions as (select query_id // 4 as item, text, min(query_id) as query_id from expressions group by 1, 2),
    query_terms as materialized ({sql_query_terms('distinct_expressions', 'query_id')}),
    scores as (select q.query_id, t.doc_id, round(sum({sql_bm25plus()}), 9) as score
      from query_terms q join doc_terms t on t.term = q.term join dfs f on f.term = q.term
      join doc_len l on l.doc_id = t.doc_id cross join corpus c group by all),
    ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scores),
    n as (select item, count(*) as n_expr from distinct_expressions group by item),
    merged as (select r.query_id // 4 as item, doc_id, sum(1e0 / (10 + rank)) as s, min(rank) as bm25_rank from ranked r where rank <= 60 group by all)
    select m.item as query_id, doc_id, bm25_rank, round(s / n_expr, 6) as score from merged m join n on n.item = m.item""",
)
def variant_merge(spark, sf_dir):
    """Each passage with two alternative wordings, scored apart and merged."""
    base = passages(spark, sf_dir)
    sentence = lambda i: F.split_part("text", F.lit("."), F.lit(i))
    wordings = F.array_distinct(F.array("text", sentence(1), sentence(2)))
    expressions = base.select("query_id", F.posexplode(wordings).alias("expr", "text"))
    options = RetrievalOptions(mode="bm25", title_weight=0.0)
    keys = ("query_id", "expr")
    lane = lx.lexical_lane(document_terms(spark, sf_dir, ()), expressions, options, keys=keys, title=False)
    merged = fusion.merge_variants(fusion.fuse(fusion.tag_lane(lane, "bm25"), options, keys), expressions)
    return merged.select(
        "query_id", F.col("chunk_id").alias("doc_id"), F.col("bm25_rank").cast("long").alias("bm25_rank"),
        F.round("score", 6).alias("score"),
    )


# --- selection: passages form requests of eight subquestions -----------------------------
SUBQUESTIONS = 8


def request_candidates(spark, sf_dir):
    lane = passage_lane(spark, sf_dir)
    return lane.select(
        F.expr(f"query_id div {SUBQUESTIONS}").alias("request_id"), (F.col("query_id") % SUBQUESTIONS).alias("ordinal"),
        "query_id", "rank", "chunk_id", "source_id", "score",
    )


_WALK = f"""with {SQL_PASSAGE_SCORES},
    cand as (select query_id // {SUBQUESTIONS} as request_id, query_id % {SUBQUESTIONS} as ordinal, query_id, rank, doc_id, source from ranked where rank <= 60),
    visit as (select *, row_number() over (partition by request_id order by rank, ordinal) as visit from cand),
    firsts as (select *, row_number() over (partition by request_id, doc_id order by visit) as nth from visit),
    opened as (select *, row_number() over (partition by request_id, source order by visit) as in_source from firsts where nth = 1),
    numbered as (select *, row_number() over (partition by request_id order by visit) as position from opened where in_source <= 2),
    chosen as materialized (select * from numbered where position <= 20),
    filled as (select request_id, max(visit) as last from chosen where position = 20 group by request_id),
    outcomes as (
      select v.*, case when c.visit = v.visit then 'selected' when c.doc_id is not null then 'duplicate'
                       when v.visit > f.last then 'topk' else 'source_limit' end as outcome
      from visit v left join chosen c on c.request_id = v.request_id and c.doc_id = v.doc_id
      left join filled f on f.request_id = v.request_id)"""


def _outcomes(spark, sf_dir):
    return selection.select_chunks(request_candidates(spark, sf_dir), topk=20, per_source=2)


@register("round_robin_pack", _WALK + " select request_id, position, query_id, doc_id, source from chosen")
def round_robin_pack(spark, sf_dir):
    return selection.selected_only(_outcomes(spark, sf_dir)).select(
        "request_id", F.col("position").cast("long").alias("position"), "query_id",
        F.col("chunk_id").alias("doc_id"), F.col("source_id").alias("source"),
    )


@register(
    "exclusion_counters",
    _WALK
    + """ select request_id, count(*) filter (outcome = 'selected') as selected, count(*) filter (outcome = 'duplicate') as duplicate,
    count(*) filter (outcome = 'topk') as topk, count(*) filter (outcome = 'source_limit') as source_limit from outcomes group by request_id""",
)
def exclusion_counters(spark, sf_dir):
    return selection.exclusion_counters(_outcomes(spark, sf_dir))


@register(
    "source_cap_topk",
    _WALK
    + """, per as (select request_id, source, count(*) as n from chosen group by all)
    select request_id, cast(sum(n) as bigint) as chunks, count(*) as distinct_sources, round(max(n) / sum(n), 6) as max_source_occupancy from per group by request_id""",
)
def source_cap_topk(spark, sf_dir):
    occupancy = selection.source_occupancy(selection.selected_only(_outcomes(spark, sf_dir)))
    return occupancy.withColumn("max_source_occupancy", F.round("max_source_occupancy", 6))


@register(
    "matched_query_ids",
    _WALK
    + """ select c.request_id, c.doc_id, string_agg(distinct cast(v.query_id as varchar), ',' order by cast(v.query_id as varchar)) as matched
    from chosen c join visit v on v.request_id = c.request_id and v.doc_id = c.doc_id group by all""",
)
def matched_query_ids(spark, sf_dir):
    candidates = request_candidates(spark, sf_dir)
    chosen = selection.selected_only(selection.select_chunks(candidates, topk=20, per_source=2))
    matched = selection.matched_queries(candidates)
    return chosen.select("request_id", "chunk_id").join(matched, ["request_id", "chunk_id"]).select(
        "request_id", F.col("chunk_id").alias("doc_id"),
        F.array_join(F.array_sort(F.transform("matched_query_ids", lambda q: q.cast("string"))), ",").alias("matched"),
    )


@register(
    "query_reports",
    _WALK
    + """ select b.item_id // 8 as request_id, b.item_id as query_id, count(v.doc_id) as candidates, count(c.doc_id) as returned,
      case when count(v.doc_id) > 0 then 'ok' else 'empty' end as status,
      case when count(v.doc_id) = 0 then 'no_candidates' when count(c.doc_id) = 0 then 'limits' end as empty_reason
    from benchmark b left join visit v on v.query_id = b.item_id
    left join chosen c on c.request_id = v.request_id and c.doc_id = v.doc_id group by b.item_id""",
)
def query_reports(spark, sf_dir):
    candidates = request_candidates(spark, sf_dir)
    outcomes = selection.select_chunks(candidates, topk=20, per_source=2)
    asked = passages(spark, sf_dir).select(
        F.expr(f"query_id div {SUBQUESTIONS}").alias("request_id"), "query_id"
    )
    return selection.query_reports(candidates, outcomes, asked)


@register(
    "limit_flags",
    _WALK
    + """, n as (select request_id, count(*) filter (outcome = 'topk') as t, count(*) filter (outcome = 'source_limit') as s from outcomes group by request_id)
    select request_id, concat_ws(',', case when s > 0 then 'source_limit' end, case when t > 0 then 'topk' end) as limits from n""",
)
def limit_flags(spark, sf_dir):
    counters = selection.exclusion_counters(_outcomes(spark, sf_dir))
    return counters.select("request_id", F.array_join(selection.limit_flags(), ",").alias("limits"))


_TURNS = f"""with {SQL_DOC_TERMS},
    turns as (select conv_id, turn, conv_id * 100 + turn as qid, text from conversations where role = 'user'),
    query_terms as materialized ({sql_query_terms('turns', 'qid')}),
    scores as (select q.query_id, t.doc_id, t.source, round(sum({sql_bm25plus()}), 9) as score
      from query_terms q join doc_terms t on t.term = q.term join dfs f on f.term = q.term
      join doc_len l on l.doc_id = t.doc_id cross join corpus c group by all),
    ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scores),
    cand as (select query_id // 100 as request_id, query_id % 100 as ordinal, query_id, rank, doc_id, source from ranked where rank <= 20),
    visit as (select *, row_number() over (partition by request_id order by rank, ordinal) as visit from cand),
    firsts as (select *, row_number() over (partition by request_id, doc_id order by visit) as nth from visit),
    opened as (select *, row_number() over (partition by request_id, source order by visit) as in_source from firsts where nth = 1),
    numbered as (select *, row_number() over (partition by request_id order by visit) as position from opened where in_source <= 6)
    select request_id as conv_id, ordinal as turn, position, doc_id from numbered where position <= 10"""


@register("conversation_multi_query", _TURNS)
def conversation_multi_query(spark, sf_dir):
    """Every conversation is a request whose user turns are its subquestions."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    keys = ("conv_id", "turn")
    options = BODY_ONLY.override({"bm25_candidates": 20})
    lane = lx.lexical_lane(
        document_terms(spark, sf_dir), turns, options, keys=keys, keep=("source_id",), title=False
    )
    candidates = lane.withColumns({"ordinal": F.col("turn"), "query_id": F.col("turn")})
    chosen = selection.select_chunks(candidates, topk=10, per_source=6, request=("conv_id",))
    return selection.selected_only(chosen).select(
        "conv_id", F.col("ordinal").alias("turn"), F.col("position").cast("long").alias("position"),
        F.col("chunk_id").alias("doc_id"),
    )


# --- packing ----------------------------------------------------------------------------
def _packed(spark, sf_dir, mode):
    from ..functions.text import content_hash
    from ..operators.packing import pack_responses

    options = RetrievalOptions(packing_mode=mode, topk=20, max_chunks_per_source=2, max_context_chars=20000)
    candidates = request_candidates(spark, sf_dir).select(
        "request_id", "ordinal", F.col("query_id").cast("string").alias("query_id"), "rank", "chunk_id", "source_id",
        "score", F.col("rank").alias("bm25_rank"), F.lit(None).cast("int").alias("dense_rank"),
        F.lit(None).cast("double").alias("similarity"),
    )
    docs = units(spark, sf_dir)
    evidence = docs.select(
        "chunk_id", "text", F.array("collection_id").alias("heading_path"), F.lit(1).alias("start_line"),
        F.size(F.split("text", "\n")).alias("end_line"), F.lit(None).cast("int").alias("section_start_line"),
        F.lit(None).cast("int").alias("section_end_line"), "source_id", "collection_id",
        F.concat(F.lit("/corpus/"), "relative_path").alias("path"), "relative_path",
        content_hash("text").alias("source_version"),
    )
    asked = passages(spark, sf_dir).select(
        F.expr(f"query_id div {SUBQUESTIONS}").alias("request_id"), (F.col("query_id") % SUBQUESTIONS).alias("ordinal"),
        F.col("query_id").cast("string").alias("query_id"), F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("error"), F.lit(60).alias("bm25"), F.lit(0).alias("dense"),
    )
    packed = pack_responses(candidates, evidence, asked, options)
    return packed.select(
        "request_id", "status", "response_chars", "returned", "truncated", F.col("excluded.budget").alias("budget_skips")
    )


@register("preview_pack")
def preview_pack(spark, sf_dir):
    """Budgeted previews for every request of eight passages."""
    return _packed(spark, sf_dir, "preview")


@register("whole_pack")
def whole_pack(spark, sf_dir):
    """Whole documents only, within the same budget."""
    return _packed(spark, sf_dir, "whole")
