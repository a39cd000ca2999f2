"""Dense lane: exact cosine top-N of many query vectors over all chunk vectors.

The scan is exhaustive, as required, but no query-by-chunk pair is ever materialised as a
row: tasks multiply vector blocks and keep only the best N per query, so what leaves a task
is at most queries × N rows whatever its input size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import RetrievalOptions
from ..session import cut_lineage
from .lexical import top_candidates

SIMILARITY_DIGITS = 9
# Query floats one task may hold (128 MB as double precision).
QUERY_FLOAT_LIMIT = 16_000_000
# Floats of the vectors of one block that meets a block of queries, and bytes of scores made at once.
CHUNK_FLOAT_LIMIT = 8_000_000
TILE_BYTES = 32 << 20


def _unit_rows(vectors) -> np.ndarray:
    block = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return block / np.linalg.norm(block, axis=1, keepdims=True)


def _best(frame: pd.DataFrame, n: int) -> pd.DataFrame:
    ordered = frame.sort_values(["q", "similarity", "chunk_id"], ascending=[True, False, True], kind="stable")
    return ordered.groupby("q", sort=False).head(n)


def _tile_best(sims: np.ndarray, n: int, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the scores of one tile that may be among a query's best ``n``; ties with the n-th stay."""
    usable = np.isfinite(sims) if floor is None else sims >= floor
    if sims.shape[1] > n:
        nth = np.partition(np.where(usable, sims, -np.inf), sims.shape[1] - n, axis=1)[:, sims.shape[1] - n]
        usable &= sims >= nth[:, None]
    return np.nonzero(usable)


def _block_best(block: pd.DataFrame, queries: np.ndarray, n: int, floor: float | None, tile_bytes: int | None = None) -> pd.DataFrame:
    """Best ``n`` chunks of one block for every query; equal scores go to the lower id.

    Scores are made in tiles of queries × chunks of at most ``tile_bytes``; each tile leaves its best, and those are merged.
    """
    vectors, rest = _unit_rows(block["embedding"]), block.drop(columns="embedding")
    cells = max(1, (tile_bytes or TILE_BYTES) // 8)
    wide = min(len(queries), max(1, int(cells**0.5)))
    deep = max(1, cells // wide)
    parts = []
    for low in range(0, len(queries), wide):
        best = None
        for at in range(0, len(vectors), deep):
            sims = np.round(queries[low : low + wide] @ vectors[at : at + deep].T, SIMILARITY_DIGITS)
            q, row = _tile_best(sims, n, floor)
            found = rest.iloc[row + at].reset_index(drop=True)
            found["q"], found["similarity"] = q + low, sims[q, row]
            best = _best(found if best is None else pd.concat([best, found]), n)
        parts.append(best)
    return pd.concat(parts) if len(parts) != 1 else parts[0]


def _numbers(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def dense_scores(
    vectors: DataFrame,
    queries: DataFrame,
    n: int,
    min_similarity: float | None = None,
    keys: tuple[str, ...] = ("query_id",),
    keep: tuple[str, ...] = (),
    query_float_limit: int = QUERY_FLOAT_LIMIT,
    chunk_float_limit: int = CHUNK_FLOAT_LIMIT,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """Per task, the best ``n`` chunks of each query: (keys, chunk_id, keep, similarity)."""
    spark = vectors.sparkSession
    queries = cut_lineage(queries.select(*keys, "embedding"))  # read again below
    shape = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    width = max(1, shape["d"] or 1)
    limit = max(1, query_float_limit // width)
    schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in queries.select(*keys).schema.fields]
        + [f"{f.name} {f.dataType.simpleString()}" for f in vectors.select("chunk_id", *keep).schema.fields]
        + ["similarity double"]
    )
    out_columns = [*keys, "chunk_id", *keep, "similarity"]
    wanted = vectors.select("chunk_id", *keep, "embedding")

    if shape["n"] <= limit:
        frame = queries.select(*keys, "embedding").toPandas()  # at most ``limit`` rows, just checked
        if frame.empty:
            return spark.createDataFrame([], schema)
        shared = spark.sparkContext.broadcast((frame[list(keys)], _unit_rows(frame["embedding"])))

        def scan(blocks):
            names, matrix = shared.value
            best = None
            for block in blocks:
                if len(block):
                    found = _block_best(block, matrix, n, min_similarity, tile_bytes)
                    best = found if best is None else _best(pd.concat([best, found]), n)
            if best is not None:
                for key in keys:
                    best[key] = names[key].to_numpy()[best["q"]]
                yield best[out_columns]

        return wanted.mapInPandas(scan, schema)

    # Too many queries for one task: cut both sides into blocks and meet them pairwise.
    query_blocks = math.ceil(shape["n"] / limit)
    chunk_blocks = max(1, math.ceil(vectors.count() * width / chunk_float_limit))
    left = queries.select(
        *[F.col(k).alias(f"key_{k}") for k in keys], F.col("embedding").alias("query_vector"),
        F.pmod(F.xxhash64(*keys), F.lit(query_blocks)).alias("qb"),
        F.explode(_numbers(chunk_blocks)).alias("cb"),
    )
    right = wanted.withColumns(
        {"cb": F.pmod(F.xxhash64("chunk_id"), F.lit(chunk_blocks))}
    ).withColumn("qb", F.explode(_numbers(query_blocks)))

    def meet(query_frame: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if query_frame.empty or block.empty:
            return pd.DataFrame({c: [] for c in out_columns})
        best = _block_best(
            block.drop(columns=["qb", "cb"]).reset_index(drop=True), _unit_rows(query_frame["query_vector"]),
            n, min_similarity, tile_bytes,
        )
        for key in keys:
            best[key] = query_frame[f"key_{key}"].to_numpy()[best["q"]]
        return best[out_columns]

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(meet, schema)


def dense_lane(
    vectors: DataFrame, queries: DataFrame, options: RetrievalOptions = RetrievalOptions(), **kw
) -> DataFrame:
    """Nearest chunks per query above the similarity floor, ranked by similarity then id."""
    keys = kw.get("keys", ("query_id",))
    found = dense_scores(vectors, queries, options.dense_candidates, options.min_dense_similarity, **kw)
    return top_candidates(found, options.dense_candidates, keys, by="similarity")


def label_centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector of every label, element by element (map-side combined)."""
    cells = vectors.select(label, F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One entry per dimension: bounded by the embedding size, not by the data.
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy(label).agg(F.transform(ordered, lambda e: e["x"]).alias("embedding"))
