"""Snapshots of a corpus: diffs, missing layers, fingerprints, samples and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SOURCE_COLUMNS = ("collection_id", "path", "relative_path", "source_version")


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str = "source_id", compare: tuple[str, ...] = SOURCE_COLUMNS) -> DataFrame:
    """Every source with its change: added, updated, unchanged or removed."""
    same = None
    for column in compare:
        equal = F.col(f"p.{column}").eqNullSafe(F.col(f"c.{column}"))
        same = equal if same is None else same & equal
    p = previous.select(key, *compare, F.lit(True).alias("there")).alias("p")
    c = current.select(key, *compare, F.lit(True).alias("there")).alias("c")
    change = (
        F.when(F.col("p.there").isNull(), "added").when(F.col("c.there").isNull(), "removed")
        .when(same, "unchanged").otherwise("updated")
    )
    return p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"), "full_outer").select(
        F.coalesce(F.col(f"c.{key}"), F.col(f"p.{key}")).alias(key), change.alias("change")
    )


def freshness(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Added, modified and removed files by (collection, path), one row."""
    keys = ["collection_id", "path"]
    p = previous.select(*keys, F.col("source_version").alias("old"))
    c = current.select(*keys, F.col("source_version").alias("new"))
    both = p.join(c, keys, "full_outer")
    counts = both.agg(
        F.count(F.when(F.col("old").isNull(), 1)).alias("added"),
        F.count(F.when(F.col("old") != F.col("new"), 1)).alias("modified"),
        F.count(F.when(F.col("new").isNull(), 1)).alias("removed"),
    )
    changed = F.col("added") + F.col("modified") + F.col("removed") > 0
    return counts.withColumn("state", F.when(changed, "changed").otherwise("unchanged"))


def missing_layer(chunks: DataFrame, layer: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that the term or vector layer does not hold yet."""
    return chunks.join(layer.select(key), key, "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def last_row_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Final row per key. An aggregate, so a key with very many rows is combined map-side."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return picked.select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """Order-independent identity of a set of rows: one row (rows, fingerprint).

    Each row is hashed; four 60-bit slices of the hashes are summed exactly and hashed again
    with the row count. Everything combines map-side, so nothing grows with the corpus.
    """
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    digest = df.select(F.sha2(text.cast("binary"), 256).alias("h"))
    slices = [
        F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
        for i in range(4)
    ]
    sums = digest.agg(F.count(F.lit(1)).alias("rows"), *[s.alias(f"s{i}") for i, s in enumerate(slices)])
    joined = F.concat_ws(":", F.col("rows").cast("string"), *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)])
    return sums.select("rows", F.sha2(joined.cast("binary"), 256).alias("fingerprint"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows found on one side only, duplicates counted; empty means equal manifests."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right"))
    )


def unknown_ids(rows: DataFrame, known: DataFrame, key: str = "chunk_id") -> DataFrame:
    return rows.select(key).distinct().join(known.select(key), key, "left_anti")


def hash_sample(df: DataFrame, key: str, scope: str, n: int, seed: int = 20260920) -> DataFrame:
    """``n`` rows in the order of sha256 of the JSON array [seed, scope, id]; a global top-n."""
    payload = F.concat(F.lit(f'[{seed},"{scope}","'), F.col(key).cast("string"), F.lit('"]'))
    return df.withColumn("sample_key", F.sha2(payload.cast("binary"), 256)).orderBy(
        "sample_key", F.col(key).cast("string")
    ).limit(n)


def first_sources(results: DataFrame, n: int = 3, request: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """First ``n`` distinct sources of each ranked list."""
    firsts = results.groupBy(*request, "source_id").agg(F.min("rank").alias("rank"))
    w = W.partitionBy(*request).orderBy("rank", "source_id")
    return firsts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
