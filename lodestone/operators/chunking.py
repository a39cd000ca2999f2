"""Chunkers: line tables, paragraphs, heading sections and structural chunks.

A chunker yields line ranges only; chunk text is always cut from the source lines
afterwards (:func:`attach_text`), so no chunker can alter quoted evidence. One source is
bounded by the file-size limit, hence so is every window and group keyed by source.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.functions import pandas_udf

from ..functions.text import LINE_BREAK, SPACE, is_blank, strip_space, utf16_length

FENCE = r"^ {0,3}(`{3,}|~{3,})(.*)$"
HEADING = rf"^ {{0,3}}(#{{1,6}})[ \t]+(.+?)[{SPACE}]*$"
MAX_HEADINGS = 20
MAX_RANGES = 100_000

RANGE_COLUMNS = ("start_line", "end_line", "heading_path", "section_start_line", "section_end_line")


def source_lines(sources: DataFrame, text: str = "text", first_line: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, line_no, text): lines numbered from 1, or from ``first_line``."""
    start = F.lit(1) if first_line is None else first_line
    return sources.select(
        "source_id", *keep, start.alias("_first"), F.posexplode(F.split(text, LINE_BREAK, -1)).alias("_pos", "text")
    ).select("source_id", *keep, (F.col("_pos") + F.col("_first")).cast("int").alias("line_no"), "text")


def paragraph_ranges(lines: DataFrame) -> DataFrame:
    """Maximal runs of non-blank lines, without headings."""
    w = W.partitionBy("source_id").orderBy("line_no")
    marked = lines.withColumn("blank", is_blank(F.col("text")))
    starts = (~F.col("blank")) & F.coalesce(F.lag("blank").over(w), F.lit(True))
    runs = marked.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(w))
    return (
        runs.filter(~F.col("blank"))
        .groupBy("source_id", "run")
        .agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))
        .select(
            "source_id", "start_line", "end_line", F.array().cast("array<string>").alias("heading_path"),
            F.lit(None).cast("int").alias("section_start_line"), F.lit(None).cast("int").alias("section_end_line"),
        )
    )


@pandas_udf(T.ArrayType(T.BooleanType()))
def _inside_fence(markers: pd.Series) -> pd.Series:
    """Per line, whether it lies inside a fence opened above. A marker is "`~" run + rest."""

    def walk(rows):
        if rows is None:
            return None
        inside, char, width = [], None, 0
        for marker in rows:
            inside.append(char is not None)
            if not marker:
                continue
            run = len(marker) - len(marker.lstrip(marker[0]))
            if char is None:
                char, width = marker[0], run
            elif marker[0] == char and run >= width and not marker[run:].strip():
                char = None
        return inside

    return markers.map(walk)


def fenced_lines(sources: DataFrame, first_line: Column | None = None, strict_opener: bool = False) -> DataFrame:
    """Lines with ``in_fence`` (an enclosing fence was opened on an earlier line).

    ``strict_opener`` refuses a backtick fence whose info string contains a backtick.
    """
    split = sources.select(
        "source_id", (F.lit(1) if first_line is None else first_line).alias("first_line"),
        F.split("text", LINE_BREAK, -1).alias("rows"),
    )

    def marker(line: Column) -> Column:
        found = F.regexp_extract(line, FENCE, 1)
        rest = F.regexp_extract(line, FENCE, 2)
        if strict_opener:
            found = F.when(found.startswith("`") & rest.contains("`"), "").otherwise(found)
        return F.when(found != "", F.concat(found, rest)).otherwise("")

    # Only sources that contain a marker cross into Python, and then only their markers.
    markers = F.when(
        F.exists("rows", lambda x: x.rlike(r"^ {0,3}(`{3}|~{3})")), F.transform("rows", marker)
    )
    flagged = split.withColumn("fence", _inside_fence(markers))
    return flagged.select(
        "source_id", "first_line", "fence", F.posexplode("rows").alias("i", "text")
    ).select(
        "source_id", (F.col("i") + F.col("first_line")).cast("int").alias("line_no"), "text",
        F.coalesce(F.get("fence", F.col("i")), F.lit(False)).alias("in_fence"),
    )


def heading_stack(lines: DataFrame, level: Column, title: Column) -> DataFrame:
    """Open headings at each line: a heading closes those of its own and deeper levels."""
    w = W.partitionBy("source_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = lines.withColumns({"level": level, "title": title})
    latest = {
        f"h{k}": F.last(
            F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True
        ).over(w)
        for k in range(1, 7)
    }
    marked = marked.withColumns(latest)
    path, above = [], F.lit(0)
    for k in range(1, 7):
        at = F.coalesce(F.col(f"h{k}.line_no"), F.lit(0))
        path.append(F.when((at > above) & (F.col(f"h{k}.title") != ""), F.col(f"h{k}.title")))
        above = F.greatest(above, at)
    return marked.withColumn("heading_path", F.array_compact(F.array(*path))).drop(*latest)


# The same patterns for Python, where ``.`` and ``$`` know fewer line ends than in Java.
_END = "(?=[\u0085\u2028\u2029]?\\Z)"
_FENCE, _HEADING, _CLOSING, _EDGES = (
    re.compile(p.replace(".", "[^\n\r\u0085\u2028\u2029]").replace("$", _END))
    for p in (FENCE, HEADING, rf"[ \t]+#+[{SPACE}]*$", f"^[{SPACE}]+|[{SPACE}]+$")
)
_BREAK, _INK = re.compile(LINE_BREAK), re.compile(f"[^{SPACE}]")
# Texts of which chunks leave a task at once.
CUT_BYTES = 1 << 22


def _sections_of(lines: list[str], first: int) -> Iterator[tuple[int, int, list[str]]]:
    """Begin and end (exclusive) of each section of a source's lines and the headings open in it; fences hide headings."""
    latest: list[tuple[int, str]] = [(0, "")] * 7
    begin, path, char, width = 0, [], "", 0
    for i, line in enumerate(lines):
        fence = _FENCE.search(line) if "```" in line or "~~~" in line else None
        heading = None if char or "#" not in line else _HEADING.search(line)
        if fence and not char:
            char, width = fence[1][0], len(fence[1])
        elif fence and fence[1][0] == char:
            marker = fence[1] + fence[2]
            run = len(marker) - len(marker.lstrip(char))
            char = "" if run >= width and not marker[run:].strip() else char
        if heading:
            if i > begin:
                yield begin, i, path
            latest[len(heading[1])] = (first + i, _EDGES.sub("", _CLOSING.sub("", heading[2])))
            begin, path, above = i, [], 0
            for at, title in latest[1:]:
                if at > above and title:
                    path.append(title)
                above = max(above, at)
    yield begin, len(lines), path


def _heading_chunks(text: str, first: int, limit: int) -> Iterator[tuple]:
    """Range columns and text of the chunks of one source."""
    lines = _BREAK.split(text) if "\r" in text else text.split("\n")
    for begin, end, path in _sections_of(lines, first):
        low, high, used = None, begin, 0
        for i in range(begin, end + 1):
            line = lines[i] if i < end else ""
            size = 1 + (len(line) if line.isascii() else len(line.encode("utf-16-le", "surrogatepass")) // 2)
            if i == end or (i > begin and used + size > limit and used):
                if low is not None:
                    yield first + low, first + high, path, first + begin, first + end - 1, "\n".join(lines[low : high + 1])
                low, used = None, 0
            used += size
            if _INK.search(line):
                low, high = i if low is None else low, i


def _quoted(text: str) -> str:
    """As :func:`~lodestone.functions.text.json_quote`, which leaves U+0000 alone."""
    return '"' + "\0".join(json.dumps(part, ensure_ascii=False)[1:-1] for part in text.split("\0")) + '"'


def heading_line_chunks(sources: DataFrame, max_chars: int = 1000, first_line: Column | None = None) -> DataFrame:
    """Sections under ATX headings, cut into runs of whole lines of at most ``max_chars``: source_id, range columns, text, chunk_id.

    Each line costs its UTF-16 length plus one; a longer single line stays whole; blank
    edges are trimmed. A source is cut in the task that holds it. The id is that of :func:`~lodestone.functions.text.chunk_id`.
    """
    if not 64 <= max_chars <= 100_000:
        raise ValueError("max_chars must lie in [64, 100000]")
    whole = sources.select("source_id", F.col("source_id").cast("string").alias("name"), (F.lit(1) if first_line is None else first_line).cast("int").alias("first_line"), "text").filter(
        F.col("text").isNotNull() & F.col("source_id").isNotNull()
    )
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string(), pa.string())
    names = [*RANGE_COLUMNS, "text", "chunk_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, found, held = [], [], 0
            texts, firsts, sources = batch.column("text"), batch.column("first_line").to_pylist(), batch.column("name").to_pylist()
            for row in range(batch.num_rows):
                text = texts[row].as_py()
                source = _quoted(sources[row])
                for chunk in _heading_chunks(text, firsts[row], max_chars):
                    payload = f"[{source},{chunk[0]},{chunk[1]},{_quoted(chunk[5])}]"
                    found.append((*chunk, hashlib.sha256(payload.encode()).hexdigest()))
                    owners.append(row)
                held += len(text)
                if found and (held >= CUT_BYTES or row + 1 == batch.num_rows):
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column("source_id").take(pa.array(owners)), *columns], names=["source_id", *names])
                    owners, found, held = [], [], 0

    schema = f"source_id {dict(sources.dtypes)['source_id']}, start_line int, end_line int, heading_path array<string>, section_start_line int, section_end_line int, text string, chunk_id string"
    return whole.mapInArrow(cut, schema)


def heading_line_ranges(sources: DataFrame, max_chars: int = 1000, first_line: Column | None = None) -> DataFrame:
    """The ranges of :func:`heading_line_chunks`."""
    return heading_line_chunks(sources, max_chars, first_line).drop("text", "chunk_id")


def drop_bare_headings(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """Remove chunks of headings alone whose next chunk lies under the same heading."""
    bare = (
        ranges.join(lines, "source_id")
        .filter(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
        .groupBy("source_id", "start_line", "end_line")
        .agg(F.min((is_blank(F.col("text")) | F.col("text").rlike(r"^ {0,3}#{1,6}[ \t]+")).cast("int")).alias("bare"))
    )
    w = W.partitionBy("source_id").orderBy("start_line")
    depth = F.size("heading_path")
    following = ranges.withColumn("next_path", F.lead("heading_path").over(w)).join(
        bare, ["source_id", "start_line", "end_line"]
    )
    under = (F.size("next_path") > depth) & (F.slice("next_path", 1, F.greatest(depth, F.lit(1))) == F.col("heading_path"))
    root = (F.size("next_path") > 0) & (depth == 0)
    folded = (F.col("bare") == 1) & F.coalesce(under | root, F.lit(False))
    return following.filter(~folded).select("source_id", *RANGE_COLUMNS)


def attach_text(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """Cut chunk text from the source lines by range.

    Ranges are exploded to their lines and met by an equi-join on (source, line), so no
    range join is needed and a large source spreads over many tasks.
    """
    wanted = ranges.withColumn("line_no", F.explode(F.sequence("start_line", "end_line")))
    joined = wanted.join(lines.select("source_id", "line_no", "text"), ["source_id", "line_no"])
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return joined.groupBy("source_id", "start_line", "end_line").agg(
        F.concat_ws("\n", F.transform(rows, lambda r: r["text"])).alias("text"),
        F.count(F.lit(1)).alias("lines"),
        *[F.first(c).alias(c) for c in RANGE_COLUMNS[2:]],
    )


def cut_text(ranges: DataFrame, sources: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`attach_text`, with first and last line and the ``keep`` columns of the source: a source's ranges meet its text once.

    Lines outside the source are not counted in ``lines``. One source is bounded by the file-size limit.
    """
    listed = ranges.groupBy("source_id").agg(F.collect_list(F.struct(*RANGE_COLUMNS)).alias("ranges"))
    return cut_listed(sources.join(listed, "source_id"), keep)


def cut_listed(sources: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`cut_text`, of sources that hold their ``ranges`` as a list."""
    met = sources.select("source_id", *keep, "first_line", "last_line", F.col("text").alias("_text"), "ranges")

    def piece(rows: Column, r: Column) -> Column:
        low = F.greatest(r["start_line"] - F.col("first_line") + 1, F.lit(1))
        high = F.least(r["end_line"] - F.col("first_line") + 1, F.size(rows))
        own = F.slice(rows, low, F.greatest(high - low + 1, F.lit(0)))
        return F.struct(*[r[c].alias(c) for c in RANGE_COLUMNS], F.array_join(own, "\n").alias("text"), F.size(own).cast("long").alias("lines"))

    rows = F.transform(F.array(F.split("_text", LINE_BREAK, -1)), lambda lines: F.transform("ranges", lambda r: piece(lines, r)))
    return met.select("source_id", *keep, "first_line", "last_line", F.inline(F.get(rows, F.lit(0))))


def broken_rule() -> Column:
    """The rule of the chunker contract that a chunk with its source's first and last line breaks, or null."""
    c = F.col
    inside = (c("section_start_line") <= c("start_line")) & (c("section_end_line") >= c("end_line"))
    both = c("section_start_line").isNull() == c("section_end_line").isNull()
    available = (c("section_start_line") >= c("first_line")) & (c("section_end_line") <= c("last_line"))
    return (
        F.when((c("end_line") < c("start_line")) | (c("start_line") < 1), "Invalid chunk range")
        .when(c("lines") != c("end_line") - c("start_line") + 1, "Chunk crosses unavailable or frontmatter lines")
        .when(is_blank(c("text")), "Empty chunk")
        .when(~both, "Both section bounds are required")
        .when(c("section_start_line").isNotNull() & ~(inside & available), "Invalid section bounds")
        .when((F.size("heading_path") > MAX_HEADINGS) | F.exists("heading_path", lambda h: utf16_length(h) > 2000), "Heading path too long")
        .when(
            F.exists("heading_path", lambda h: F.lower(h).contains(F.lower(c("source_id").cast("string")))),
            "Identity in chunk headings",
        )
    )


def invalid_ranges(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks that break the chunker contract, with the broken rule.

    ``chunks`` come from :func:`attach_text`; ``sources`` gives first and last line numbers.
    """
    return chunks.join(sources.select("source_id", "first_line", "last_line"), "source_id").withColumn(
        "rule", broken_rule()
    ).filter(F.col("rule").isNotNull())
