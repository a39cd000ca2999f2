"""Reciprocal-rank fusion of lanes, variant merging and re-weighting of frozen ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import RetrievalOptions

FUSED_DIGITS = 12


def tag_lane(ranked: DataFrame, lane: str) -> DataFrame:
    """A ranked lane in the common shape used by :func:`fuse`."""
    similarity = F.col("similarity") if "similarity" in ranked.columns else F.lit(None).cast("double")
    return ranked.withColumns({"lane": F.lit(lane), "similarity": similarity}).drop("score")


def fuse(
    lanes: DataFrame,
    options: RetrievalOptions = RetrievalOptions(),
    keys: tuple[str, ...] = ("query_id",),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Σ weight / (rrf_k + rank) per chunk over its lanes; chunks without positive score go.

    A union plus one aggregation replaces a full outer join of the lanes.
    """
    is_lex = F.col("lane") == "bm25"
    weight = F.when(is_lex, F.lit(options.lane_weight("bm25"))).otherwise(F.lit(options.lane_weight("dense")))
    fused = lanes.groupBy(*keys, "chunk_id", *keep).agg(
        F.round(F.sum(weight / (F.lit(float(options.rrf_k)) + F.col("rank"))), FUSED_DIGITS).alias("score"),
        F.min(F.when(is_lex, F.col("rank"))).alias("bm25_rank"),
        F.min(F.when(~is_lex, F.col("rank"))).alias("dense_rank"),
        F.max("similarity").alias("similarity"),
    )
    return fused.filter(F.col("score") > 0)


def merge_variants(
    fused: DataFrame, expressions: DataFrame, keys: tuple[str, ...] = ("query_id",), keep: tuple[str, ...] = ()
) -> DataFrame:
    """One candidate list per query from its expressions.

    The score is the sum over expressions divided by their number, so an expression that
    misses a chunk counts as zero; ranks keep their minimum, similarity its maximum.
    ``expressions`` has one row per (query, expression).
    """
    n = expressions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_expressions"))
    return (
        fused.groupBy(*keys, "chunk_id", *keep)
        .agg(
            F.sum("score").alias("total"), F.min("bm25_rank").alias("bm25_rank"),
            F.min("dense_rank").alias("dense_rank"), F.max("similarity").alias("similarity"),
        )
        .join(n, list(keys))
        .withColumn("score", F.round(F.col("total") / F.col("n_expressions"), FUSED_DIGITS))
        .drop("total", "n_expressions")
    )


def rank_fused(fused: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Position by fused score then chunk id; the pool per query is bounded by the lane caps."""
    w = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("chunk_id"))
    return fused.withColumn("rank", F.row_number().over(w))


def reweight(frozen: DataFrame, arms: list[tuple[float, float, int]], keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Recompute fusion from frozen lane ranks for several (lexical, dense, k) settings.

    The arms are a literal array on each candidate row, so the sweep is one narrow pass.
    """
    grid = F.array(
        *[F.struct(F.lit(float(a)).alias("bm25_weight"), F.lit(float(b)).alias("dense_weight"), F.lit(float(k)).alias("rrf_k")) for a, b, k in arms]
    )
    rows = frozen.withColumn("arm", F.explode(grid)).select("*", "arm.*").drop("arm")

    def part(weight: str, rank: str):
        return F.coalesce(F.col(weight) / (F.col("rrf_k") + F.col(rank)), F.lit(0.0))

    scored = rows.withColumn(
        "score", F.round(part("bm25_weight", "bm25_rank") + part("dense_weight", "dense_rank"), FUSED_DIGITS)
    )
    return rank_fused(scored.filter(F.col("score") > 0), (*keys, "bm25_weight", "dense_weight", "rrf_k"))


def lane_projection(fused: DataFrame, lane: str, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Recover one lane's own order from a hybrid union."""
    column = f"{lane}_rank"
    return fused.filter(F.col(column).isNotNull()).select(*keys, "chunk_id", F.col(column).alias("rank"))


def broken_projections(projection: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Queries whose lane ranks are not exactly 1..n without repeats."""
    return (
        projection.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("chunks"),
            F.countDistinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"),
        )
        .filter(
            (F.col("chunks") != F.col("n")) | (F.col("ranks") != F.col("n"))
            | (F.col("low") != 1) | (F.col("high") != F.col("n"))
        )
    )
