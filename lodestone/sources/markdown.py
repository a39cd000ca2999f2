"""Markdown directories as DataFrames: scan, strict decoding, frontmatter, identities."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.functions import pandas_udf

from ..config import UUID_V4
from ..functions.text import LINE_BREAK, SPACE, strip_space
from .files import MarkdownFiles, glob_regex

MAX_FILE_BYTES = 10 * 1024 * 1024
IDENTITY_KEY = "source_id"
_FENCE_END = rf"^(---|\.\.\.)[{SPACE}]*$"


def in_scope(relative: Column, include: Sequence[str] | None, exclude: Sequence[str] | None) -> Column:
    """Markdown file, matching any include and no exclude pattern.

    Without an exclude list, entries whose name starts with a dot and ``node_modules``
    folders are left out.
    """
    keep = relative.rlike(r"(?i)\.md$")
    if include is not None:
        hits = [relative.rlike(glob_regex(p)) for p in include] or [F.lit(False)]
        any_hit = hits[0]
        for hit in hits[1:]:
            any_hit = any_hit | hit
        keep = keep & any_hit
    if exclude is None:
        keep = keep & ~relative.rlike(r"(^|/)\.") & ~relative.rlike(r"(^|/)node_modules/")
    for pattern in exclude or ():
        keep = keep & ~relative.rlike(glob_regex(pattern))
    return keep


def scan_markdown(
    spark: SparkSession,
    root: str,
    collection_id: str,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    max_file_bytes: int = MAX_FILE_BYTES,
    stream: bool = False,
) -> DataFrame:
    """(collection_id, path, relative_path, raw, source_version, modified): one row per Markdown file below ``root``.

    Files come from the ``markdown_files`` data source: listed folder by folder, symbolic links skipped, read by
    many tasks. A stream uses Spark's own file source, which never lists names that begin with "_" or ".".
    A file above the limit or with invalid UTF-8 fails the job.
    """
    if stream:
        scoped = _streamed(spark, root.rstrip("/"), include, exclude)
    else:
        spark.dataSource.register(MarkdownFiles)
        options = {"root": root, "maxFileBytes": str(max_file_bytes), "scope": json.dumps({"include": include, "exclude": exclude})}
        scoped = spark.read.format(MarkdownFiles.name()).options(**options).load()
    too_big = F.raise_error(F.concat(F.lit("Source exceeds max_file_bytes: "), F.col("path")))
    broken = F.raise_error(F.concat(F.lit("Source is not valid UTF-8: "), F.col("path")))
    text = F.col("content").cast("string")
    checked = (
        F.when(F.col("length") > max_file_bytes, too_big)
        .when(~F.is_valid_utf8(text), broken)
        .otherwise(text)
    )
    return scoped.select(
        F.lit(collection_id).alias("collection_id"), "path", "relative_path", checked.alias("raw"),
        F.sha2("content", 256).alias("source_version"), "modified",
    )


def _streamed(spark: SparkSession, base: str, include: Sequence[str] | None, exclude: Sequence[str] | None) -> DataFrame:
    files = (
        spark.readStream.schema("path string, modificationTime timestamp, length long, content binary")
        .format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(base)
    )
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:(//)?", ""), r"^/+", "/")
    plain_base = re.sub(r"^[a-z0-9]+:(//)?", "", base)
    relative = F.substring(path, F.lit(len(plain_base) + 2), F.length(path))
    return files.select(
        path.alias("path"), relative.alias("relative_path"), F.col("modificationTime").alias("modified"), "length", "content"
    ).filter(in_scope(F.col("relative_path"), include, exclude))


def _identity_of(yaml_text: str, key: str) -> str | None:
    import yaml

    class UniqueKeys(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            names = [self.construct_object(k, deep=True) for k, _ in node.value]
            if len(set(map(str, names))) != len(names):
                raise ValueError("Invalid YAML frontmatter: duplicate key")
            return super().construct_mapping(node, deep)

    try:
        value = yaml.load(yaml_text, UniqueKeys)
    except yaml.YAMLError as error:
        raise ValueError(f"Invalid YAML frontmatter: {error}") from None
    if value is None:
        return None
    if not isinstance(value, dict):
        raise ValueError("Frontmatter must be a mapping")
    if key not in value:
        return None
    if not isinstance(value[key], str) or not re.match(UUID_V4, value[key]):
        raise ValueError(f"{key} must be a UUID v4 string")
    return value[key].lower()


def parse_sources(files: DataFrame, identity_key: str = IDENTITY_KEY) -> DataFrame:
    """Sources with identity, first body line and body text.

    The frontmatter ends at the first later line ``---`` or ``...``; line numbers count the
    whole file. Only frontmatter text crosses into Python. A file without identity gets a
    stable one from its collection and relative path; files are never changed here.
    """

    @pandas_udf(T.StringType())
    def identity(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: None if b is None else _identity_of(b, identity_key))

    rows = F.split(F.regexp_replace("raw", "^\\uFEFF", ""), LINE_BREAK, -1)
    opened = files.withColumn("rows", rows).withColumn("has_front", strip_space(F.get("rows", F.lit(0))) == "---")
    ends = F.array_position(
        F.transform("rows", lambda line, i: (i > 0) & line.rlike(_FENCE_END)), F.lit(True)
    )
    closed = opened.withColumn("front_end", F.when(F.col("has_front"), ends).otherwise(F.lit(0)))
    unclosed = F.raise_error(F.concat(F.lit("Frontmatter has no closing line (Unclosed block): "), F.col("path")))
    block = F.when(
        F.col("has_front"),
        F.when(F.col("front_end") == 0, unclosed).otherwise(
            F.concat_ws("\n", F.slice("rows", F.lit(2), F.greatest(F.col("front_end") - 2, F.lit(0)).cast("int")))
        ),
    )
    h = F.sha2(F.concat_ws("\u001f", "collection_id", "relative_path").cast("binary"), 256)
    derived = F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )
    body = F.slice("rows", (F.col("front_end") + 1).cast("int"), F.greatest(F.size("rows"), F.lit(1)))
    return closed.withColumn("own_id", identity(block)).select(
        F.coalesce("own_id", derived).alias("source_id"), F.col("own_id").isNotNull().alias("has_identity"),
        "collection_id", "path", "relative_path", "source_version", "modified",
        (F.col("front_end") + 1).cast("int").alias("first_line"), F.size("rows").alias("last_line"),
        F.concat_ws("\n", body).alias("text"),
    )


def with_identity(raw: str, new_id: str, key: str = IDENTITY_KEY) -> str:
    """File text with an identity added: new block, flow mapping or block mapping."""
    bom = "\ufeff" if raw.startswith("\ufeff") else ""
    text = raw[len(bom) :]
    found = re.search(LINE_BREAK, raw)
    eol = found.group() if found else "\n"
    lines = re.split(f"({LINE_BREAK})", text)  # texts at even positions, breaks at odd ones
    entry = f"{key}: {new_id}"
    if lines[0].strip() != "---":
        return f"{bom}---{eol}{entry}{eol}---{eol}{text}"
    close = next((i for i in range(2, len(lines), 2) if re.match(_FENCE_END, lines[i])), None)
    if close is None:
        raise ValueError("Frontmatter has no closing line (Unclosed block)")
    head = "".join(lines[2:close])
    first = re.search(r"^[ \t]*(?![ \t#\r\n])", head, re.MULTILINE)
    start = first.end() if first else 0
    if head[start : start + 1] == "{":
        rest = head[start + 1 :]
        comma = "" if rest.lstrip().startswith("}") else ", "
        new_head = head[: start + 1] + entry + comma + rest
    else:
        indent = first.group() if first else ""
        new_head = f"{head}{indent}{entry}{eol}"
    return bom + "".join(lines[:2]) + new_head + "".join(lines[close:])


def write_identity(path: str, key: str = IDENTITY_KEY, max_file_bytes: int = MAX_FILE_BYTES) -> str:
    """Give a local file an identity. Runs on the driver only and replaces the file atomically."""
    if os.path.islink(path) or not os.path.isfile(path):
        raise ValueError("An identity can be written to a plain file only")
    with open(path, "rb") as handle:
        before = handle.read()
    raw = before.decode("utf-8")
    new_id = str(uuid.uuid4())
    updated = with_identity(raw, new_id, key).encode("utf-8")
    if len(updated) > max_file_bytes:
        raise ValueError(f"{path} with its identity is larger than max_file_bytes ({max_file_bytes})")
    lines = re.split(LINE_BREAK, updated.decode("utf-8").lstrip("\ufeff"))
    close = next(i for i in range(1, len(lines)) if re.match(_FENCE_END, lines[i]))
    if _identity_of("\n".join(lines[1:close]), key) != new_id:
        raise ValueError(f"The frontmatter of {path} does not give the new identity back")
    handle, temporary = tempfile.mkstemp(prefix=".identity-", dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(updated)
        os.chmod(temporary, os.stat(path).st_mode & 0o7777)
        with open(path, "rb") as again:
            if again.read() != before:
                raise ValueError(f"{path} was edited meanwhile; nothing was written")
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)
    return new_id
