"""Registered queries: facts, coverage, ranking metrics, order statistics, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RetrievalOptions
from ..operators import chunking, coverage, dense, lexical as lx, metrics
from ..operators.bootstrap import paired_bootstrap
from ..session import BROADCAST_ROW_LIMIT, cut_lineage, fits, small_side, stored
from .common import (
    SQL_CENTROIDS, SQL_HYBRID, SQL_PASSAGE_SCORES, SQL_PASSAGE_TERMS, passages, register, sql_bm25plus,
    sql_tokens, spread, table, vectors,
)
from .lexical import _CLAMPED, BODY_ONLY, document_terms, passage_lane
from .retrieval import centroid_queries, hybrid_pool

# --- facts: passages located in documents ------------------------------------------------
SQL_LOCATED = """
  located as materialized (
    select b.item_id as query_id, d.doc_id, b.text as passage, d.text, instr(d.text, b.text) as pos
    from benchmark b join documents d on contains(d.text, b.text)),
  anchors as materialized (
    select query_id, doc_id,
      length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), chr(10), '')) + 1 as start_line,
      length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), chr(10), ''))
        + length(passage) - length(replace(passage, chr(10), '')) + 1 as end_line
    from located)"""


def located(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("source_id"), "text")
    wanted = passages(spark, sf_dir).withColumnRenamed("query_id", "passage_id")
    # Few rows, read several times by each evaluation below.
    return cut_lineage(coverage.locate_passages(docs, wanted))


def fact_anchors(spark, sf_dir):
    return coverage.line_anchors(located(spark, sf_dir)).withColumnRenamed("passage_id", "fact_id")


@register(
    "fact_anchors",
    f"with {SQL_LOCATED} select query_id as fact_id, doc_id, start_line, end_line from anchors",
)
def fact_anchor_rows(spark, sf_dir):
    """Line ranges of the documents that hold each passage verbatim."""
    return fact_anchors(spark, sf_dir).select(
        "fact_id", F.col("source_id").alias("doc_id"), F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
    )


# A fact belongs to the first document that holds its passage.
_DOC_COVER = f"""with {SQL_PASSAGE_SCORES}, {SQL_LOCATED},
    facts as (select query_id, min(doc_id) as doc_id from located group by query_id),
    returned as materialized (select query_id, doc_id, source, rank from ranked where rank <= 10),
    rows as materialized (
      select b.item_id as query_id, f.doc_id is null as no_answer, case when f.doc_id is null then 0 else 1 end as expected,
        (select count(*) from returned r where r.query_id = b.item_id and r.doc_id = f.doc_id) as covered,
        (select count(*) from returned r where r.query_id = b.item_id) as returned,
        coalesce((select max(1e0 / r.rank) from returned r where r.query_id = b.item_id and r.doc_id = f.doc_id), 0e0) as rr,
        (select count(distinct r.source) from returned r where r.query_id = b.item_id) as distinct_sources,
        (select max(n) * 1e0 / sum(n) from (select count(*) as n from returned r where r.query_id = b.item_id group by r.source)) as occupancy,
        (select sum(length(d.text)) from returned r join documents d on d.doc_id = r.doc_id where r.query_id = b.item_id) as chars,
        case when b.item_id % 2 = 0 then 'even' else 'odd' end as type
      from benchmark b left join facts f on f.query_id = b.item_id)"""


def evaluation_rows(spark, sf_dir):
    """One row per passage: what a top-10 BM25+ request over documents returned and covered."""
    docs = table(spark, sf_dir, "documents")
    lane = passage_lane(spark, sf_dir, BODY_ONLY.override({"bm25_candidates": 10})).withColumnRenamed("source_id", "source")
    few = fits(passages(spark, sf_dir), BROADCAST_ROW_LIMIT // 10)  # ten rows a passage meet the texts where they lie
    pieces = cut_lineage(
        docs.select(F.col("doc_id").alias("chunk_id"), "text").join(small_side(lane, few), "chunk_id").withColumn("source_id", F.col("chunk_id"))
    )
    found = located(spark, sf_dir)
    facts = found.groupBy("passage_id").agg(F.min("source_id").alias("source_id"), F.min("passage").alias("text")).withColumnRenamed(
        "passage_id", "fact_id"
    )
    required = facts.select(F.col("fact_id").alias("query_id"), "fact_id")
    covered = coverage.substring_coverage(pieces, facts, required).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("expected"), metrics.count_if(F.col("covered")).alias("covered")
    )
    first = (
        pieces.join(facts.select(F.col("fact_id").alias("query_id"), "source_id", F.col("text").alias("fact_text")), ["query_id", "source_id"])
        .filter(F.col("text").contains(F.col("fact_text")))
        .groupBy("query_id").agg((F.lit(1.0) / F.min("rank")).alias("rr"))
    )
    per_source = pieces.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    returned = per_source.groupBy("query_id").agg(
        F.sum("n").alias("returned"), F.count(F.lit(1)).alias("distinct_sources"),
        (F.max("n") / F.sum("n")).alias("max_source_occupancy"), F.sum("chars").alias("chars"),
    )
    rows = passages(spark, sf_dir).select("query_id").join(covered, "query_id", "left").join(first, "query_id", "left").join(returned, "query_id", "left")
    return rows.select(
        "query_id", F.col("expected").isNull().alias("no_answer"), F.coalesce("expected", F.lit(0)).alias("expected"),
        F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("returned", F.lit(0)).alias("returned"),
        F.coalesce("rr", F.lit(0.0)).alias("rr"), F.coalesce("distinct_sources", F.lit(0)).alias("distinct_sources"),
        "max_source_occupancy", F.coalesce("chars", F.lit(0)).alias("chars"),
        F.when(F.coalesce("returned", F.lit(0)) > 0, "ok").otherwise("empty").alias("status"),
        F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("type"),
    )


@register(
    "short_passages",
    """with p as (select item_id * 2 as passage_id, split_part(text, ' ', 1) as passage from benchmark
      union all select item_id * 2 + 1, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) from benchmark)
    select p.passage_id, count(*) as documents, min(d.doc_id) as first_doc from p join documents d on contains(d.text, p.passage) group by 1""",
)
def short_passages(spark, sf_dir):
    """Documents that hold the first word, or the first two words, of each benchmark passage."""
    words = F.split("text", " ")
    first, second = F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    rows = table(spark, sf_dir, "benchmark").select(
        F.posexplode(F.array(first, F.concat(first, F.lit(" "), second))).alias("k", "text"), "item_id"
    )
    wanted = rows.select((F.col("item_id") * 2 + F.col("k")).alias("passage_id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    found = coverage.locate_passages(docs, wanted)
    return found.groupBy("passage_id").agg(F.count(F.lit(1)).alias("documents"), F.min("source_id").alias("first_doc"))


@register(
    "fact_coverage",
    _DOC_COVER + " select query_id, no_answer, cast(expected as bigint) as expected, covered, returned, round(rr, 6) as rr from rows",
)
def fact_coverage(spark, sf_dir):
    return evaluation_rows(spark, sf_dir).select(
        "query_id", "no_answer", F.col("expected").cast("long").alias("expected"), "covered", "returned", F.round("rr", 6).alias("rr")
    )


_SUMMARY = """count(*) as queries, count(*) filter (not no_answer) as answerable,
      cast(sum(case when no_answer then 0 else covered end) as bigint) as facts_covered,
      cast(sum(case when no_answer then 0 else expected end) as bigint) as facts_expected,
      count(*) filter (not no_answer and covered > 0) as any_fact_hits, count(*) filter (not no_answer and covered = expected) as complete,
      count(*) filter (no_answer and returned > 0) as no_answer_nonempty, cast(0 as bigint) as failures,
      round(avg(rr) filter (not no_answer), 6) as mean_rr, round(avg(distinct_sources), 6) as mean_distinct_sources,
      round(avg(occupancy), 6) as mean_max_source_occupancy, cast(sum(chars) as bigint) as context_chars"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register(
    "evaluation_percentiles",
    _DOC_COVER
    + """, ordered as (select type, chars, row_number() over (partition by type order by chars) as i, count(chars) over (partition by type) as n from rows where chars is not null),
    ps(p) as (values (0.5e0), (0.95e0))
    select type, p, chars::double as quantile, n as "values" from ordered cross join ps where i = greatest(1, ceil(n * p))""",
)
def evaluation_percentiles(spark, sf_dir):
    """Median and 95th percentile of the characters that requests returned, by question type."""
    return metrics.order_statistics(evaluation_rows(spark, sf_dir), "chars", [0.5, 0.95], ("type",))


@register("complete_evidence", _DOC_COVER + f" select {_SUMMARY} from rows")
def complete_evidence(spark, sf_dir):
    """Roll-up of the evaluation rows, no-answer questions kept apart."""
    return _rounded(metrics.run_summary(evaluation_rows(spark, sf_dir)))


@register("summary_by_type", _DOC_COVER + f" select type, {_SUMMARY} from rows group by type")
def summary_by_type(spark, sf_dir):
    return _rounded(metrics.run_summary(evaluation_rows(spark, sf_dir), ("type",)))


@register(
    "no_answer_nonempty",
    _DOC_COVER + " select count(*) filter (no_answer) as no_answer, count(*) filter (no_answer and returned > 0) as nonempty from rows",
)
def no_answer_nonempty(spark, sf_dir):
    return evaluation_rows(spark, sf_dir).agg(
        metrics.count_if(F.col("no_answer")).alias("no_answer"),
        metrics.count_if(F.col("no_answer") & (F.col("returned") > 0)).alias("nonempty"),
    )


# --- line-anchored evaluation over line chunks --------------------------------------------
SQL_CHUNKS = """
  split_lines as materialized (
    select doc_id, unnest(ls) as text, generate_subscripts(ls, 1) as n
    from (select doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') as ls from documents)),
  walk as (
    with recursive w as (
      select doc_id, n, length(text) + 1 as used, 1 as part from split_lines where n = 1
      union all
      select s.doc_id, s.n, case when w.used + length(s.text) + 1 > 1000 then length(s.text) + 1 else w.used + length(s.text) + 1 end,
             w.part + case when w.used + length(s.text) + 1 > 1000 then 1 else 0 end
      from w join split_lines s on s.doc_id = w.doc_id and s.n = w.n + 1)
    select * from w),
  ranges as materialized (
    select w.doc_id, w.part, min(w.n) as start_line, max(w.n) as end_line
    from walk w join split_lines s on s.doc_id = w.doc_id and s.n = w.n
    where regexp_matches(s.text, '\\S') group by all),
  chunks as materialized (
    select r.doc_id, r.start_line, r.end_line, string_agg(s.text, chr(10) order by s.n) as text
    from ranges r join split_lines s on s.doc_id = r.doc_id and s.n between r.start_line and r.end_line group by all),
  chunk_ids as materialized (
    select *, sha256(json_array(doc_id::varchar, start_line, end_line, text)::varchar) as chunk_id from chunks)"""


def document_sources(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("source_id"), "text")


def line_chunks(spark, sf_dir):
    """Documents cut into runs of whole lines of at most 1000 characters, with chunk ids."""
    return chunking.heading_line_chunks(document_sources(spark, sf_dir), 1000)


_CHUNK_RUN = f"""with recursive {SQL_CHUNKS.replace('with recursive w as', 'with recursive w as')}, {SQL_LOCATED}, {SQL_PASSAGE_TERMS},
  ctoks as materialized (select chunk_id, doc_id, start_line, {sql_tokens('text')} as toks from chunk_ids),
  cterms as materialized (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(toks) as term from ctoks) group by all),
  clen as materialized (select chunk_id, len(list_distinct(toks)) as dl from ctoks),
  corpus as (select count(*) as n_docs, avg(dl) as avg_dl from clen),
  dfs as materialized (select term, count(*) as df from cterms group by term),
  cscores as (select q.query_id, t.chunk_id, round(sum({sql_bm25plus()}), 9) as score
     from query_terms q join cterms t on t.term = q.term join dfs f on f.term = q.term join clen l on l.chunk_id = t.chunk_id cross join corpus c group by all),
  cranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from cscores),
  pieces as materialized (select r.query_id, r.rank, c.* from cranked r join chunk_ids c on c.chunk_id = r.chunk_id where r.rank <= 10),
  anchor_lines as (select a.query_id as fact_id, a.doc_id, a.start_line, s.n, s.text from anchors a join split_lines s
     on s.doc_id = a.doc_id and s.n between a.start_line and a.end_line where regexp_matches(s.text, '\\S')),
  line_seen as (select al.*, (select min(p.rank) from pieces p where p.query_id = al.fact_id and p.doc_id = al.doc_id
     and al.n between p.start_line and p.end_line) as rank from anchor_lines al),
  anchor_rank as (select fact_id, doc_id, start_line, case when count(*) = count(rank) then max(rank) end as rank from line_seen group by all),
  fact_rank as materialized (select fact_id as query_id, min(rank) as rank from anchor_rank group by fact_id),
  alone as (select a.query_id, min(p.rank) as rank from anchors a join pieces p on p.query_id = a.query_id and p.doc_id = a.doc_id
     where not exists (select 1 from anchor_lines al where al.fact_id = a.query_id and al.doc_id = a.doc_id and al.start_line = a.start_line
                       and not al.n between p.start_line and p.end_line) group by a.query_id),
  source_rank as (select a.query_id, a.doc_id, min(p.rank) as rank from (select distinct query_id, doc_id from anchors) a
     left join pieces p on p.query_id = a.query_id and p.doc_id = a.doc_id group by all)"""


def chunk_run(spark, sf_dir):
    """Top-10 line chunks per passage with text, plus the anchors and lines to judge them."""
    chunks = stored(line_chunks(spark, sf_dir), "line-chunks")
    terms = lx.term_table(chunks)
    lane = lx.lexical_lane(terms, passages(spark, sf_dir), BODY_ONLY.override({"bm25_candidates": 10}), title=False)
    few = fits(passages(spark, sf_dir), BROADCAST_ROW_LIMIT // 10)
    pieces = cut_lineage(
        chunks.select("chunk_id", "source_id", "start_line", "end_line", "text").join(small_side(lane, few), "chunk_id")
    )
    anchors = cut_lineage(fact_anchors(spark, sf_dir))
    held = anchors.select("source_id").distinct()  # lines are looked up in the sources that hold a fact only
    holding = document_sources(spark, sf_dir).join(small_side(held, fits(held, BROADCAST_ROW_LIMIT)), "source_id", "left_semi")
    lines = chunking.source_lines(holding)
    required = anchors.select(F.col("fact_id").alias("query_id"), "fact_id").distinct()
    return pieces, anchors, lines, required


@register("line_anchor_coverage", _CHUNK_RUN + " select query_id, rank is not null as covered, rank from fact_rank")
def line_anchor_coverage(spark, sf_dir):
    pieces, anchors, lines, required = chunk_run(spark, sf_dir)
    ranks = coverage.line_coverage(pieces, anchors, lines, required)
    return ranks.select("query_id", F.col("rank").isNotNull().alias("covered"), F.col("rank").cast("long").alias("rank"))


@register(
    "prefix_first_fact_rank",
    _CHUNK_RUN
    + """ select b.item_id as query_id, min(f.rank) as first_rank, round(coalesce(1e0 / min(f.rank), 0), 6) as rr
    from benchmark b join fact_rank f on f.query_id = b.item_id group by b.item_id""",
)
def prefix_first_fact_rank(spark, sf_dir):
    pieces, anchors, lines, required = chunk_run(spark, sf_dir)
    ranks = coverage.line_coverage(pieces, anchors, lines, required).groupBy("query_id").agg(F.min("rank").alias("r"))
    return ranks.select(
        "query_id", F.col("r").cast("long").alias("first_rank"),
        F.round(F.coalesce(F.lit(1.0) / F.col("r"), F.lit(0.0)), 6).alias("rr"),
    )


@register(
    "hit_mrr_recall_at_k",
    _CHUNK_RUN
    + """, ks(k) as (values (1), (3), (5), (10)),
    f as (select query_id, k, count(*) as facts, count(*) filter (rank <= k) as covered, min(rank) as first from fact_rank cross join ks group by all),
    s as (select query_id, k, count(*) as sources, count(*) filter (rank <= k) as scov, min(rank) as sfirst from source_rank cross join ks group by all),
    r as (select f.*, s.sources, s.scov, s.sfirst, a.rank as single from f join s on s.query_id = f.query_id and s.k = f.k left join alone a on a.query_id = f.query_id)
    select k, count(*) as answerable, count(*) filter (single <= k) as single_hits,
      round(avg(case when single <= k then 1e0 / single else 0 end), 6) as single_mrr, count(*) filter (covered > 0) as any_hits,
      cast(sum(covered) as bigint) as facts_covered, round(sum(covered) / sum(facts), 6) as fact_recall_micro,
      round(avg(covered / facts), 6) as fact_recall_macro, count(*) filter (covered = facts) as complete,
      round(avg(case when first <= k then 1e0 / first else 0 end), 6) as prefix_mrr, count(*) filter (scov > 0) as source_hits,
      round(sum(scov) / sum(sources), 6) as source_recall_micro, round(avg(scov / sources), 6) as source_recall_macro,
      round(avg(case when sfirst <= k then 1e0 / sfirst else 0 end), 6) as source_mrr
    from r group by k""",
)
def hit_mrr_recall_at_k(spark, sf_dir):
    """The @K roll-up for K in 1, 3, 5, 10 over answerable passages."""
    pieces, anchors, lines, required = chunk_run(spark, sf_dir)
    facts = coverage.line_coverage(pieces, anchors, lines, required)
    single = metrics.single_piece_rank(pieces, anchors, lines, required)
    relevant = anchors.select(F.col("fact_id").alias("query_id"), "source_id").distinct()
    seen = pieces.groupBy("query_id", "source_id").agg(F.min("rank").alias("rank"))
    sources = relevant.join(seen, ["query_id", "source_id"], "left")
    questions = required.select("query_id").distinct().withColumn("no_answer", F.lit(False))
    return _rounded(metrics.depth_summary(metrics.question_scores(questions, facts, single, sources)))


# --- ranking metrics: relevance by label, graded by document quality ------------------------
SQL_LABEL_RUN = f"""with {SQL_CENTROIDS},
    sims as (select cast(c.label as bigint) as query_id, e.vec_id as doc_id, round(list_cosine_similarity(c.v, e.embedding::double[]), 9) as similarity
             from centroids c cross join embeddings e),
    run as materialized (select * from (select *, row_number() over (partition by query_id order by similarity desc, doc_id) as rank from sims where similarity >= 0.3) where rank <= 60),
    qrels as materialized (select cast(e.label as bigint) as query_id, e.vec_id as doc_id, 1 + coalesce(l.quality, 0) as rel from embeddings e left join labels l on l.doc_id = e.vec_id)"""


def label_run(spark, sf_dir):
    run = dense.dense_lane(vectors(spark, sf_dir), centroid_queries(spark, sf_dir))
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    qrels = vectors(spark, sf_dir).join(quality, "chunk_id", "left").select(
        F.col("label").cast("long").alias("query_id"), "chunk_id", (F.lit(1) + F.coalesce("quality", F.lit(0))).alias("rel")
    )
    return run, qrels


@register(
    "ranking_metrics",
    SQL_LABEL_RUN
    + """, ideal as (select query_id, sum(rel / log2(i + 1)) as ideal from (select *, row_number() over (partition by query_id order by rel desc, doc_id) as i from qrels) where i <= 10 group by query_id),
    total as (select query_id, count(*) as n from qrels group by query_id),
    hits as (select r.query_id, r.rank, q.rel from run r join qrels q on q.query_id = r.query_id and q.doc_id = r.doc_id where r.rank <= 50)
    select t.query_id, round(coalesce(sum(case when rank <= 10 then rel / log2(rank + 1) end) / any_value(ideal), 0), 6) as ndcg,
      round(count(*) filter (rank <= 10) / any_value(n), 6) as recall, round(count(rank) / any_value(n), 6) as recall_deep,
      round(coalesce(1e0 / min(case when rank <= 10 then rank end), 0), 6) as mrr, cast(max(case when rank <= 10 then 1 else 0 end) as integer) as hit
    from total t join ideal i on i.query_id = t.query_id left join hits h on h.query_id = t.query_id group by t.query_id""",
)
def ranking_metrics(spark, sf_dir):
    """nDCG@10, recall@10 and @50, MRR@10 and hit@10 of the label centroid queries."""
    run, qrels = label_run(spark, sf_dir)
    return _rounded(metrics.ranking_metrics(run, qrels, qrels.select("query_id").distinct()))


def label_nuggets(spark, sf_dir):
    """Nuggets of a label query: the languages of its documents."""
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("nugget_id"))
    _, qrels = label_run(spark, sf_dir)
    return qrels.join(lang, "chunk_id")


def _sql_coverage(k: int) -> str:
    return SQL_LABEL_RUN + f""", nuggets as (select q.query_id, q.doc_id, d.lang from qrels q join documents d on d.doc_id = q.doc_id)
    select n.query_id, round(count(distinct case when r.doc_id is not null then n.lang end) / count(distinct n.lang), 6) as coverage
    from nuggets n left join run r on r.query_id = n.query_id and r.doc_id = n.doc_id and r.rank <= {k} group by n.query_id"""


@register("nugget_coverage", _sql_coverage(10))
def nugget_coverage(spark, sf_dir):
    run, _ = label_run(spark, sf_dir)
    return _rounded(metrics.nugget_coverage(run, label_nuggets(spark, sf_dir), 10))


@register("nugget_coverage_at_20", _sql_coverage(20))
def nugget_coverage_at_20(spark, sf_dir):
    run, _ = label_run(spark, sf_dir)
    return _rounded(metrics.nugget_coverage(run, label_nuggets(spark, sf_dir), 20))


# A document has one language, so the greedy ideal order is that of the sorted gains.
@register(
    "alpha_ndcg",
    SQL_LABEL_RUN
    + """, nuggets as materialized (select q.query_id, q.doc_id, d.lang from qrels q join documents d on d.doc_id = q.doc_id),
    worth as (select query_id, pow(0.5e0, row_number() over (partition by query_id, lang order by doc_id) - 1) as g from nuggets),
    ideal as (select query_id, sum(g / log2(i + 1)) as ideal from (select *, row_number() over (partition by query_id order by g desc) as i from worth) where i <= 10 group by query_id),
    gains as (select r.query_id, r.rank, pow(0.5e0, row_number() over (partition by r.query_id, n.lang order by r.rank) - 1) as g
      from run r join nuggets n on n.query_id = r.query_id and n.doc_id = r.doc_id where r.rank <= 10),
    gain as (select query_id, sum(g / log2(rank + 1)) as gain from gains group by query_id)
    select i.query_id, round(coalesce(gain / ideal, 0), 6) as alpha_ndcg from ideal i left join gain using (query_id)""",
)
def alpha_ndcg(spark, sf_dir):
    """Nuggets are languages; longer nugget sets are checked against a brute force in the tests."""
    run, _ = label_run(spark, sf_dir)
    return _rounded(metrics.alpha_ndcg(run, label_nuggets(spark, sf_dir)))


@register(
    "mode_contrast",
    f"""with {SQL_HYBRID},
    qrels as (select doc_id from labels where quality = 1),
    dense as (select d.query_id, count(*) filter (q.doc_id is not null) / 10e0 as m from dense_lane d left join qrels q using (doc_id) where rank <= 10 group by d.query_id),
    hyb as (select f.query_id, count(*) filter (q.doc_id is not null) / 10e0 as m from fused_ranked f left join qrels q using (doc_id) where position <= 10 group by f.query_id)
    select count(*) as questions, round(avg(h.m - d.m), 6) as delta, count(*) filter (h.m - d.m > 1e-12) as wins,
      count(*) filter (h.m - d.m < -1e-12) as losses, count(*) filter (abs(h.m - d.m) <= 1e-12) as ties
    from hyb h join dense d on d.query_id = h.query_id""",
)
def mode_contrast(spark, sf_dir):
    """Hybrid minus dense precision@10 of good documents, from one frozen hybrid pool."""
    pool = cut_lineage(hybrid_pool(spark, sf_dir))
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("chunk_id"), F.lit(1).alias("good"))

    def precision(rank):
        return pool.filter(F.col(rank) <= 10).join(good, "chunk_id", "left").groupBy("query_id").agg(
            (metrics.count_if(F.col("good") == 1) / F.lit(10.0)).alias("m")
        )

    return _rounded(metrics.paired_outcomes(precision("rank"), precision("dense_rank"), "m"))


# --- order statistics ---------------------------------------------------------------------
def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", "value")


@register(
    "nearest_rank_percentiles",
    """with r as (select event_type, value, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events),
    ps(p) as (values (0.5e0), (0.95e0), (0.99e0))
    select event_type, p, value as quantile, n as "values" from r cross join ps where i = greatest(1, ceil(n * p))""",
)
def nearest_rank_percentiles(spark, sf_dir):
    return metrics.order_statistics(_events(spark, sf_dir), "value", [0.5, 0.95, 0.99], ("event_type",))


@register(
    "linear_quantiles",
    """with ps(p) as (values (0.025e0), (0.5e0), (0.975e0))
    select p, round(case when p = 0.025e0 then quantile_cont(value, 0.025) when p = 0.5e0 then quantile_cont(value, 0.5) else quantile_cont(value, 0.975) end, 6) as quantile,
      count(value) as "values" from events cross join ps group by p""",
)
def linear_quantiles(spark, sf_dir):
    return _rounded(metrics.order_statistics(_events(spark, sf_dir), "value", [0.025, 0.5, 0.975], kind="linear"))


@register("median_by_type", "select event_type, round(median(value), 6) as median from events group by event_type")
def median_by_type(spark, sf_dir):
    m = metrics.order_statistics(_events(spark, sf_dir), "value", [0.5], ("event_type",), "linear")
    return m.select("event_type", F.round("quantile", 6).alias("median"))


# --- paired comparison: BM25+ against field-weighted BM25, first two results each ----------
def engine_pairs(spark, sf_dir):
    found = located(spark, sf_dir).select(F.col("passage_id").alias("query_id"), F.col("source_id").alias("chunk_id"))
    matched = lx.match(document_terms(spark, sf_dir, ()), passages(spark, sf_dir), title=False)  # both engines score the same matches

    def covered(options):
        return passage_lane(spark, sf_dir, options, keep=(), matched=matched).join(found, ["query_id", "chunk_id"]).groupBy("query_id").agg(
            F.count(F.lit(1)).alias("covered")
        )

    base = covered(RetrievalOptions(lexical_engine="fts", bm25_candidates=2)).withColumnRenamed("covered", "b_covered")
    cand = covered(BODY_ONLY.override({"bm25_candidates": 2})).withColumnRenamed("covered", "c_covered")
    expected = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    rows = passages(spark, sf_dir).select("query_id")
    for side in (expected, base, cand):
        rows = rows.join(side, "query_id", "left")
    return rows.fillna(0).withColumns({"ord": F.col("query_id"), "grp": F.expr("query_id div 2")})


_PAIRS = f"""with {SQL_PASSAGE_SCORES}, {SQL_LOCATED},
    fts_scores as (select q.query_id, t.doc_id, round(sum({_CLAMPED} * (t.tf * 2.2e0) / (t.tf + 1.2e0 * (0.25e0 + 0.75e0 * l.total_len / c.avg_total))), 9) as score
      from query_terms q join doc_terms t on t.term = q.term join dfs f on f.term = q.term join doc_len l on l.doc_id = t.doc_id cross join corpus c group by all),
    fts as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from fts_scores) where rank <= 2),
    plus as (select * from ranked where rank <= 2),
    pairs as materialized (
      select b.item_id as query_id, b.item_id // 2 as grp, (select count(*) from located l where l.query_id = b.item_id) as expected,
        (select count(*) from located l join fts f on f.query_id = l.query_id and f.doc_id = l.doc_id where l.query_id = b.item_id) as b_covered,
        (select count(*) from located l join plus f on f.query_id = l.query_id and f.doc_id = l.doc_id where l.query_id = b.item_id) as c_covered
      from benchmark b)"""


@register(
    "paired_win_loss_tie",
    _PAIRS
    + """ select count(*) as questions, round(avg(c_covered - b_covered), 6) as delta, count(*) filter (c_covered > b_covered) as wins,
    count(*) filter (c_covered < b_covered) as losses, count(*) filter (c_covered = b_covered) as ties from pairs""",
)
def paired_win_loss_tie(spark, sf_dir):
    pairs = cut_lineage(engine_pairs(spark, sf_dir))
    return _rounded(metrics.paired_outcomes(
        pairs.select("query_id", F.col("c_covered").cast("double").alias("m")),
        pairs.select("query_id", F.col("b_covered").cast("double").alias("m")), "m",
    ))


_M = "4294967295"


def _mul(a: str, b: str) -> str:
    return f"((((((({a}) >> 16) * ({b})) & 65535) << 16) + (({a}) & 65535) * ({b})) & {_M})"


@register(
    "paired_cluster_bootstrap",
    _PAIRS
    + f""", totals as (
      select grp, min(query_id) as first, sum(expected)::bigint as expected, sum(b_covered)::bigint as b, sum(c_covered)::bigint as c,
        count(*) filter (expected > 0) as answerable, count(*) filter (expected > 0 and b_covered = expected) as bc,
        count(*) filter (expected > 0 and c_covered = expected) as cc
      from pairs group by grp having count(*) filter (expected > 0) > 0),
    slots as materialized (select *, row_number() over (order by first) - 1 as slot, count(*) over () as g from totals),
    numbers as (select unnest(range(0, 10000 * (select count(*) from slots))) as id),
    s0 as (select id, (20260916 + {_mul('id + 1', '1831565813')}) & {_M} as s from numbers),
    s1 as (select id, {_mul('xor(s, s >> 15)', 's | 1')} as t from s0),
    s2 as (select id, xor(t, (t + {_mul('xor(t, t >> 7)', 't | 61')}) & {_M}) as t from s1),
    s3 as (select id, xor(t, t >> 14)::double / 4294967296e0 as u from s2),
    picks as (select id // (select count(*) from slots) as resample, floor(u * (select count(*) from slots))::bigint as slot from s3),
    deltas as materialized (
      select resample, sum(c) / sum(expected) - sum(b) / sum(expected) as fd, sum(cc) / sum(answerable) - sum(bc) / sum(answerable) as cd
      from picks join slots using (slot) group by resample),
    answered as (select * from pairs where expected > 0)
    select 'fact_coverage' as metric, (select count(*) from pairs) as questions, (select count(*) from answered) as answerable,
      (select count(distinct grp) from pairs) as groups, round((select sum(b_covered) / sum(expected) from pairs), 6) as baseline,
      round((select sum(c_covered) / sum(expected) from pairs), 6) as candidate,
      round((select sum(c_covered) / sum(expected) - sum(b_covered) / sum(expected) from pairs), 6) as delta,
      round(quantile_cont(fd, 0.025), 6) as low, round(quantile_cont(fd, 0.975), 6) as high, count(*) as valid_resamples from deltas
    union all
    select 'complete_evidence', (select count(*) from pairs), (select count(*) from answered), (select count(distinct grp) from pairs),
      round((select avg(case when b_covered = expected then 1e0 else 0e0 end) from answered), 6),
      round((select avg(case when c_covered = expected then 1e0 else 0e0 end) from answered), 6),
      round((select avg(case when c_covered = expected then 1e0 else 0e0 end) - avg(case when b_covered = expected then 1e0 else 0e0 end) from answered), 6),
      round(quantile_cont(cd, 0.025), 6), round(quantile_cont(cd, 0.975), 6), count(*) from deltas""",
)
def paired_cluster_bootstrap(spark, sf_dir):
    return _rounded(paired_bootstrap(cut_lineage(engine_pairs(spark, sf_dir))))


@register(
    "evidence_f1",
    """with predicted as (select d.source as q, d.text from documents d join labels l on l.doc_id = d.doc_id where l.quality = 1),
    gold as (select d.source as q, d.lang as a, case when l.toxic = 1 or l.quality = 1 then d.text end as text from documents d left join labels l on l.doc_id = d.doc_id),
    np as (select q, count(*) as n from predicted group by q), ng as (select q, a, count(text) as n from gold group by all),
    hits as (select g.q, g.a, count(*) as n from (select distinct * from gold where text is not null) g join (select distinct * from predicted) p on p.q = g.q and p.text = g.text group by all)
    select ng.q as query_id, round(max(case when coalesce(np.n, 0) + ng.n = 0 then 1e0 else 2e0 * coalesce(hits.n, 0) / (coalesce(np.n, 0) + ng.n) end), 6) as evidence_f1
    from ng left join np on np.q = ng.q left join hits on hits.q = ng.q and hits.a = ng.a group by ng.q""",
)
def evidence_f1(spark, sf_dir):
    """Paragraph F1 with documents as paragraphs: good ones predicted, one annotation per language."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    predicted = docs.filter("quality = 1").select(F.col("source").alias("query_id"), "text")
    gold = docs.select(
        F.col("source").alias("query_id"), F.col("lang").alias("annotation_id"),
        F.when((F.col("toxic") == 1) | (F.col("quality") == 1), F.col("text")).alias("text"),
    )
    return _rounded(metrics.evidence_f1(predicted, gold))
