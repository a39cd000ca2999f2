"""JSON-lines records and tar members in, write-once results out."""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import glob_regex, open_system


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records split at LF only; blank lines are skipped, a malformed record fails the job."""
    lines = spark.read.option("lineSep", "\n").text(path).filter(F.col("value").rlike(r"\S"))
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("r")).select("r.*")


def _file_name(path: str) -> str:
    """Spark's escaped address of a file as one that Arrow opens."""
    return path if path.startswith("/") else re.sub(r"^file:/+", "/", path)


def tar_index(spark: SparkSession, *paths: str) -> DataFrame:
    """(archive, member, start, length) of the plain files in uncompressed tar archives.

    A task reads only the headers of an archive, from one to the next; contents are skipped.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("path").to_pylist():
                system, name = open_system(_file_name(archive))
                names, starts, sizes = [], [], []
                with system.open_input_file(name) as file, tarfile.open(fileobj=file, mode="r:") as tar:
                    for member in tar:
                        if member.isreg():
                            names.append(member.name)
                            starts.append(member.offset_data)
                            sizes.append(member.size)
                        tar.members = []  # a long archive is not kept in memory
                columns = [pa.array([archive] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["archive", "member", "start", "length"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(list(paths)).select("path")
    return files.repartition(max(1, files.count())).mapInArrow(emit, "archive string, member string, start long, length long")


def read_tar(spark: SparkSession, *paths: str, members: str = "**", stretch_bytes: int = 32 << 20) -> DataFrame:
    """(archive, member, content) of the members whose name fits the glob ``members``.

    Members are dealt by archive and stretch of it, so one archive is read by as many tasks as it has stretches.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, own = None, None
        for batch in batches:
            for archive, member, start, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "start", "length"))):
                if archive != own:
                    system, name = open_system(_file_name(archive))
                    opened, own = system.open_input_file(name), archive
                content = opened.read_at(length, start)
                if len(content) != length:
                    raise ValueError(f"{archive} ends inside {member}")
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([member]), pa.array([content], pa.binary())], names=["archive", "member", "content"])

    index = tar_index(spark, *paths).filter(F.col("member").rlike(glob_regex(members)))
    dealt = index.repartition("archive", F.floor(F.col("start") / stretch_bytes)).sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(emit, "archive string, member string, content binary")


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result that must not exist yet; the output committer publishes it whole."""
    df.write.mode("errorifexists").format(fmt).save(path)


def corpus_manifest(sources: DataFrame) -> DataFrame:
    """(collection_id, path, sha256) of every source, in order."""
    return sources.select("collection_id", F.col("relative_path").alias("path"), F.col("source_version").alias("sha256")).orderBy(
        "collection_id", "path"
    )
