"""Tables in the shared folder, size-checked broadcasts and column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.session import ensure_checkpoint_dir

# Rows of a broadcast build side; callers keep its rows below about 200 bytes.
BROADCAST_ROWS = 200_000

ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: later jobs read finished files that every executor can reach, so a lost
    executor repeats nothing that came before.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lodestone-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete the folder of a ``shared_table`` that nothing reads any more."""
    files = table.inputFiles()
    folder = files[0].rsplit("/", 1)[0] if files else ""
    if "/lodestone-" in folder:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pin_partitions(spark: SparkSession) -> None:
    """From now on files are cut into the same partitions by every job, whatever executors come and go: row numbers hold."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def reads_files(df: DataFrame) -> bool:
    """Whether ``df`` is a table of files as it lies there, so that each job meets its rows in the same order."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def fixed_rows(df: DataFrame, label: str) -> DataFrame:
    """``df``, or what it gives now as a stored table, so that row numbers hold over several jobs."""
    pin_partitions(df.sparkSession)
    return df if reads_files(df) else shared_table(df, label)


def small_or_plain(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a stored table of at most ``rows`` rows, otherwise the table as it is
    (a shuffle join, whose hot keys adaptive execution splits)."""
    return F.broadcast(table) if table.count() <= rows else table


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null or blank text."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(plain, " "), "")


def without_space(text: Column) -> Column:
    return F.translate(text, ASCII_SPACE, "")
