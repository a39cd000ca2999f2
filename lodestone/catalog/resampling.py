"""Registered queries: intervals by resampling queries and clusters, and all question types in one job."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import bootstrap, metrics
from ..session import cut_lineage
from .common import SQL_HYBRID, register, table
from .evaluation import _PAIRS, _mul, _M, _rounded, engine_pairs
from .retrieval import hybrid_pool

_B64, _B128 = 1 << 64, 1 << 128
# Fixed value: multiplier of the published 128-bit generator.
PCG_MULTIPLIER = 0x2360ED051FC65DA44385DF649FCCF645
DOUBLINGS = 20


def sql_pcg_draws(seed: int, n: str, iterations: int) -> str:
    """CTEs up to ``draws`` (resample, slot): the generator's stream by doubling, 128-bit numbers as two halves.

    ``n``: SQL of the number of slots. Serves up to 2^21 raw values.
    """
    state = np.random.PCG64(seed).state["state"]
    a, c = PCG_MULTIPLIER, state["inc"]
    first = (state["state"] * a + c) % _B128
    big = lambda x: f"{x}::uhugeint"
    parts = [f"p0 as (select 0 as i, {big(first >> 64)} as hi, {big(first % _B64)} as lo)"]
    for k in range(DOUBLINGS):
        ah, al, ch, cl = a >> 64, a % _B64, c >> 64, c % _B64
        parts.append(f"""p{k + 1} as materialized (select * from p{k} union all select i, (ll // {big(_B64)} + (hi * {big(al)}) % {big(_B64)} + (lo * {big(ah)}) % {big(_B64)} + {big(ch)} + low // {big(_B64)}) % {big(_B64)}, low % {big(_B64)}
      from (select i + {1 << k} as i, hi, lo, lo * {big(al)} as ll, (lo * {big(al)}) % {big(_B64)} + {big(cl)} as low from p{k} where i + {1 << k} < (select raw from need)))""")
        a, c = a * a % _B128, (c * a + c) % _B128
    powers = ", ".join(big(1 << k) for k in range(65))
    return f"""
    need as (select {n} as n, ({iterations} * {n} + 2000) // 2 as raw),
    {', '.join(parts)},
    mixed as (select i, xor(hi::ubigint, lo::ubigint)::uhugeint as v, (hi // {big(1 << 58)})::int as rot from p{DOUBLINGS}),
    outs as (select i, v // [{powers}][rot + 1] + (v * [{powers}][65 - rot]) % {big(_B64)} as o from mixed),
    raws as (select 2 * i as j, (o % {big(1 << 32)})::bigint as r from outs union all select 2 * i + 1, (o % {big(_B64)} // {big(1 << 32)})::bigint from outs),
    fair as (select row_number() over (order by j) - 1 as number, (r::hugeint * n // 4294967296)::bigint as slot, n
      from raws, need where (r::hugeint * n) % 4294967296 >= (4294967296 - n) % n),
    draws as (select number // n as resample, slot from fair where number < {iterations} * n)"""


_PRECISION = (("p10", 10), ("p1", 1))


@register(
    "query_bootstrap_ci",
    f"""with {SQL_HYBRID},
    qrels as (select doc_id from labels where quality = 1),
    dense_p as (select query_id, {', '.join(f"count(*) filter (rank <= {k} and q.doc_id is not null) / {k}e0 as {m}" for m, k in _PRECISION)}
      from dense_lane d left join qrels q using (doc_id) where rank <= 10 group by query_id),
    hybrid_p as (select query_id, {', '.join(f"count(*) filter (position <= {k} and q.doc_id is not null) / {k}e0 as {m}" for m, k in _PRECISION)}
      from fused_ranked f left join qrels q using (doc_id) where position <= 10 group by query_id),
    deltas as materialized (select row_number() over (order by query_id) - 1 as slot, {', '.join(f"h.{m} - d.{m} as {m}" for m, _ in _PRECISION)} from hybrid_p h join dense_p d using (query_id)),
    {sql_pcg_draws(bootstrap.PCG_SEED, "(select count(*) from deltas)", bootstrap.DEFAULT_ITERATIONS)},
    means as materialized (select resample, {', '.join(f"sum({m}) / (select n from need) as {m}" for m, _ in _PRECISION)} from draws join deltas using (slot) group by resample)"""
    + " union all ".join(
        f""" select '{m}' as metric, count(*) as questions, round(avg({m}), 6) as delta, count(*) filter ({m} > 1e-12) as wins, count(*) filter ({m} < -1e-12) as losses,
      count(*) filter (abs({m}) <= 1e-12) as ties, round((select quantile_cont({m}, 0.025) from means), 6) as low, round((select quantile_cont({m}, 0.975) from means), 6) as high from deltas"""
        for m, _ in _PRECISION
    ),
)
def query_bootstrap_ci(spark, sf_dir):
    """Hybrid minus dense precision of good documents at 10 and 1, with intervals over resampled passages."""
    pool = cut_lineage(hybrid_pool(spark, sf_dir))
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("chunk_id"), F.lit(1).alias("good"))

    def precision(rank, side):
        found = pool.filter(F.col(rank) <= 10).join(good, "chunk_id", "left")
        return found.groupBy("query_id").agg(*[
            (metrics.count_if((F.col(rank) <= k) & (F.col("good") == 1)) / F.lit(float(k))).alias(f"{side}_{m}") for m, k in _PRECISION
        ])

    rows = precision("rank", "a").join(precision("dense_rank", "b"), "query_id").withColumnRenamed("query_id", "ord")
    return _rounded(bootstrap.query_bootstrap(rows, [m for m, _ in _PRECISION]))


_RATIOS = {"coverage": ("c_covered", "expected"), "baseline_coverage": ("b_covered", "expected")}


@register(
    "ratio_bootstrap_ci",
    _PAIRS
    + f""", clusters as materialized (
      select row_number() over (order by min(query_id)) - 1 as slot, sum(c_covered)::double as c_covered, sum(b_covered)::double as b_covered, sum(expected)::double as expected
      from pairs group by grp),
    {sql_pcg_draws(bootstrap.PCG_SEED, "(select count(*) from clusters)", bootstrap.DEFAULT_ITERATIONS)},
    values_ as materialized (select resample, sum(expected) as below, sum(c_covered) as coverage, sum(b_covered) as baseline_coverage from draws join clusters using (slot) group by resample)"""
    + " union all ".join(
        f""" select '{m}' as metric, count(*) as clusters, round(coalesce(sum({top}) / nullif(sum({below}), 0), 0), 6) as value,
      round((select quantile_cont(coalesce({m} / nullif(below, 0), 0), 0.025) from values_), 6) as low,
      round((select quantile_cont(coalesce({m} / nullif(below, 0), 0), 0.975) from values_), 6) as high from clusters"""
        for m, (top, below) in _RATIOS.items()
    ),
)
def ratio_bootstrap_ci(spark, sf_dir):
    """Covered over expected facts of both engines, whole groups of passages resampled."""
    clusters = engine_pairs(spark, sf_dir).groupBy("grp").agg(F.min("ord").alias("ord"), *[F.sum(c).alias(c) for c in ("c_covered", "b_covered", "expected")])
    return _rounded(bootstrap.ratio_bootstrap(clusters, _RATIOS))


_SCOPED = """scoped as materialized (
      select 'all' as scope, * from pairs union all select 'type:' || (query_id % 3), * from pairs)"""


@register(
    "bootstrap_by_type",
    _PAIRS
    + f""", {_SCOPED},
    totals as (
      select scope, grp, min(query_id) as first, sum(expected)::bigint as expected, sum(b_covered)::bigint as b, sum(c_covered)::bigint as c,
        count(*) filter (expected > 0) as answerable, count(*) filter (expected > 0 and b_covered = expected) as bc,
        count(*) filter (expected > 0 and c_covered = expected) as cc
      from scoped group by all having count(*) filter (expected > 0) > 0),
    slots as materialized (select *, row_number() over (partition by scope order by first) - 1 as slot, count(*) over (partition by scope) as g from totals),
    numbers as (select scope, g, unnest(range(0, 10000 * g)) as id from (select distinct scope, g from slots where g > 1)),
    s0 as (select scope, g, id, (20260916 + {_mul('id + 1', '1831565813')}) & {_M} as s from numbers),
    s1 as (select scope, g, id, {_mul('xor(s, s >> 15)', 's | 1')} as t from s0),
    s2 as (select scope, g, id, xor(t, (t + {_mul('xor(t, t >> 7)', 't | 61')}) & {_M}) as t from s1),
    s3 as (select scope, g, id, xor(t, t >> 14)::double / 4294967296e0 as u from s2),
    picks as (select scope, id // g as resample, floor(u * g)::bigint as slot from s3),
    deltas as materialized (
      select scope, resample, sum(c) / sum(expected) - sum(b) / sum(expected) as fd, sum(cc) / sum(answerable) - sum(bc) / sum(answerable) as cd
      from picks join slots using (scope, slot) group by all),
    bounds as (
      select scope, 'fact_coverage' as metric, quantile_cont(fd, 0.025) as low, quantile_cont(fd, 0.975) as high, count(*) as valid from deltas group by scope
      union all select scope, 'complete_evidence', quantile_cont(cd, 0.025), quantile_cont(cd, 0.975), count(*) from deltas group by scope),
    seen as (
      select scope, count(*) as questions, count(*) filter (expected > 0) as answerable, count(distinct grp) as groups,
        sum(b_covered) / nullif(sum(expected), 0) as bf, sum(c_covered) / nullif(sum(expected), 0) as cf,
        avg(case when expected > 0 then (b_covered = expected)::int end) as bq, avg(case when expected > 0 then (c_covered = expected)::int end) as cq
      from scoped group by scope),
    listed as (select scope, questions, answerable, groups, 'fact_coverage' as metric, bf as baseline, cf as candidate from seen
      union all select scope, questions, answerable, groups, 'complete_evidence', bq, cq from seen)
    select l.scope, metric, questions, answerable, groups, round(baseline, 6) as baseline, round(candidate, 6) as candidate, round(candidate - baseline, 6) as delta,
      round(low, 6) as low, round(high, 6) as high, coalesce(valid, 0) as valid_resamples from listed l left join bounds using (scope, metric)""",
)
def bootstrap_by_type(spark, sf_dir):
    """Paired comparison of two engines over all passages and over three types of them, one resampling job."""
    pairs = engine_pairs(spark, sf_dir)
    kind = F.concat(F.lit("type:"), F.expr("query_id % 3").cast("string"))
    return _rounded(bootstrap.scoped_bootstrap(cut_lineage(pairs.withColumn("scope", F.explode(F.array(F.lit("all"), kind))))))
