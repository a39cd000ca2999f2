"""Returned text back to spans of its source, with the headings that a parser repeated before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import SPACE, strip_space, utf16_length
from .chunking import fenced_lines

HEADING = r"^ {0,3}(#{1,6})[ \t]"
_LEADING = rf"^[{SPACE}]*#{{1,6}}[{SPACE}]"


def heading_rows(sources: DataFrame) -> DataFrame:
    """(source_id, headings): each source's headings outside fences in text order, as (offset, end, level, text) in UTF-16 units.

    Bounded by the size of one source.
    """
    lines = fenced_lines(sources.select("source_id", "text"))
    from pyspark.sql import Window as W

    before = W.partitionBy("source_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    placed = lines.withColumns({"width": utf16_length("text")}).withColumn("offset", F.coalesce(F.sum(F.col("width") + 1).over(before), F.lit(0)))
    found = placed.filter(~F.col("in_fence") & F.col("text").rlike(HEADING))
    row = F.struct(
        "offset", (F.col("offset") + F.col("width")).alias("end"), F.length(F.regexp_extract("text", HEADING, 1)).alias("level"), strip_space("text").alias("text")
    )
    return found.groupBy("source_id").agg(F.array_sort(F.collect_list(row)).alias("headings"))


def _open_headings(headings: Column, start: Column) -> Column:
    """Stack of headings at ``start``: each closes those of its own and deeper levels."""
    empty = F.array().cast("array<struct<offset:bigint,end:bigint,level:int,text:string>>")
    return F.aggregate(
        F.filter(headings, lambda h: h["end"] < start), empty,
        lambda stack, h: F.concat(F.filter(stack, lambda s: s["level"] < h["level"]), F.array(h)),
    )


def map_returned_text(returned: DataFrame, sources: DataFrame) -> DataFrame:
    """``returned`` (source_id, text, ...) with status and spans, which are (start, end) in UTF-16 units of the source's text.

    The trimmed text is sought as a whole, then without its first heading line, its first two and so on; the first form that occurs counts.
    ``mapped``: it occurs once, and omitted headings are open there. ``ambiguous``: it occurs again. ``unmapped``: no form
    occurs. ``unmapped-heading``: an omitted heading is not open. ``empty``: nothing but white space.
    Sources whose text no row asks for are not read into the join; without a source a text is unmapped.
    """
    wanted = returned.withColumn("trimmed", strip_space(F.coalesce("text", F.lit(""))))
    rows = F.split("trimmed", "\n", -1)
    leading = F.aggregate(
        F.transform(rows, lambda r: r.rlike(_LEADING)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("going")),
        lambda s, hit: F.struct((s["n"] + (s["going"] & hit).cast("int")).alias("n"), (s["going"] & hit).alias("going")),
    )["n"]
    wanted = wanted.withColumns({"rows": rows, "leading": leading})

    def form(cut: Column) -> Column:
        rest = strip_space(F.array_join(F.slice("rows", cut + 1, F.greatest(F.size("rows") - cut, F.lit(0))), "\n"))
        return F.struct(cut.alias("cut"), rest.alias("rest"), F.when(rest != "", F.position(rest, F.col("source_text"))).otherwise(0).alias("at"))

    texts = sources.select("source_id", F.col("text").alias("source_text"))
    joined = wanted.join(texts, "source_id", "left").withColumn("source_text", F.coalesce("source_text", F.lit("")))
    forms = F.transform(F.sequence(F.lit(0), F.col("leading")), form)
    joined = joined.withColumn("found", F.try_element_at(F.filter(forms, lambda x: x["at"] > 0), F.lit(1)))
    again = F.position(F.col("found.rest"), F.substring(F.col("source_text"), F.col("found.at") + 1, F.length("source_text"))) > 0
    start = utf16_length(F.substring(F.col("source_text"), F.lit(1), F.col("found.at") - 1)).cast("long")
    located = joined.withColumns({"again": again, "start": start, "length": utf16_length("found.rest").cast("long")}).drop("source_text")
    stacks = located.join(heading_rows(sources.join(returned.select("source_id").distinct(), "source_id", "left_semi")), "source_id", "left")
    open_ = _open_headings(F.coalesce("headings", F.array().cast("array<struct<offset:bigint,end:bigint,level:int,text:string>>")), F.col("start"))
    stacks = stacks.withColumn("open", F.when(F.col("found.cut") > 0, open_))
    prefixes = F.transform(F.slice("rows", F.lit(1), F.greatest(F.col("found.cut"), F.lit(1))), lambda r: F.try_element_at(F.filter("open", lambda h: h["text"] == strip_space(r)), F.lit(1)))
    stacks = stacks.withColumn("prefixes", F.when(F.col("found.cut") > 0, prefixes).otherwise(F.array().cast("array<struct<offset:bigint,end:bigint,level:int,text:string>>")))
    status = (
        F.when(F.col("trimmed") == "", "empty").when(F.col("found").isNull(), "unmapped").when(F.col("again"), "ambiguous")
        .when(F.exists("prefixes", lambda p: p.isNull()), "unmapped-heading").otherwise("mapped")
    )
    own = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("length")).alias("end")))
    spans = F.array_sort(F.concat(own, F.transform("prefixes", lambda p: F.struct(p["offset"].alias("start"), p["end"].alias("end")))))
    return stacks.withColumn("status", status).select(
        *returned.columns, "status", F.when(F.col("status") == "mapped", spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans")
    )
