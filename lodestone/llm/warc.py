"""WARC archives of web pages: index first, then byte-range reads.

Writing. The index comes first, from lengths and digests alone: one archive for each input partition, with the offset, length, URL
and payload digest of its records. Then the pages are read once more in the same partitions; a task meets the index rows of its
own archive, checks each digest, and Spark's text writer, whose line separator is the two line ends after a record, writes the
archive as one file. So payloads are never shuffled; a lost task is written again, a failed job leaves nothing.

Reading. Selected index rows are dealt by archive and stretch of it, and sorted by offset. A task joins records that
lie at most ``MAX_GAP`` bytes apart into one read of at most ``READ_BYTES`` (one longer record is read alone), through the file
system of the archive's address, and parses the records from those bytes.

Of rows with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest page_id (nulls last, then by row
number) is a response, the others revisit it: a record of that type has no payload, but its digest and the response's record
id. Smaller payloads are all responses. Payload digests are bare SHA-256 in the index, with their algorithm in the record.

Null html: an empty payload. Null url: no target field; line ends in a URL are written as ``%0D`` and ``%0A``. Null page_id: no
such field. Repeated rows are records of their own. An empty table gives an empty index and no archive. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.session import ensure_checkpoint_dir

from .shared import fixed_rows, shared_table

MIN_REVISIT = 100
MAX_GAP = 64 << 10
READ_BYTES = 8 << 20
END = "\r\n\r\n"
INDEX = ("archive", "start", "length", "page_id", "url", "digest", "payload_bytes", "type", "record_id", "refers_to_record")

LAYOUT = "archive long, start long, length long, page_id long, url string, digest string, payload_bytes long, type string, record_id string, refers_to_record string"


def _record_id(row: Column, label: str) -> Column:
    digest = F.sha2(F.concat(F.lit(label + ":"), row.cast("string")), 256)
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in at]))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field that is null is left out."""
    return F.concat_ws("", *[F.concat(F.lit(name + ": "), value, F.lit("\r\n")) for name, value in fields])


def build_index(pages: DataFrame, label: str, least: int = MIN_REVISIT) -> DataFrame:
    """Index rows of ``pages`` (row, page_id, url, html), with the text ``head`` that precedes each payload; payloads are only measured."""
    html = F.coalesce("html", F.lit(""))
    seen = pages.select("row", F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    seen = shared_table(seen, "measured")
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row", "url")
    groups = seen.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first")).where("copies > 1")
    joined = seen.join(groups, ["digest", "payload_bytes"], "left")
    again = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    target = lambda url: F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"),
        _lines(("Content-Type", F.lit("text/html; charset=UTF-8")), ("Content-Length", F.col("payload_bytes").cast("string"))), F.lit("\r\n"),
    )
    rows = joined.withColumn("again", again).withColumn("http", http).withColumn(
        "refers_to_record", F.when(F.col("again"), _record_id(F.col("first.row"), label))
    )
    body = F.octet_length("http") + F.when(F.col("again"), F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _lines(
            ("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
            ("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
            ("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
            ("WARC-Target-URI", target(F.col("url"))),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_record"), F.lit(">"))),
            ("WARC-Refers-To-Target-URI", F.when(F.col("again"), target(F.col("first.url")))),
            ("X-Page-ID", F.col("page_id").cast("string")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.col("body").cast("string")),
        ),
        F.lit("\r\n"), F.col("http"),
    )
    rows = rows.withColumn("record_id", _record_id(F.col("row"), label)).withColumn("body", body.cast("long")).withColumn("head", head)
    size = F.octet_length("head") + F.when(F.col("again"), F.lit(0)).otherwise(F.col("payload_bytes")) + len(END)
    # The upper bits of a row number are its input partition.
    rows = rows.withColumn("length", size.cast("long")).withColumn("archive", F.shiftright("row", 33))
    before = Window.partitionBy("archive").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn("type", F.when(F.col("again"), "revisit").otherwise("response")).select(
        *INDEX, "row", "head"
    )


class Archives:
    """Archives and their index: file, archive, start, length, page_id, url, digest, payload_bytes, type, record_id, refers_to_record."""

    def __init__(self, index: DataFrame) -> None:
        self.index = index

    def read(self, selected: DataFrame | None = None, max_gap: int = MAX_GAP, read_bytes: int = READ_BYTES, keep_payload: bool = False) -> DataFrame:
        """Records of the index rows ``selected`` (all, if not given), parsed from the archives' bytes.

        page_id, url, type, record_id, refers_to_record, digest (as the record states it), payload_bytes and payload_sha256 (of the bytes read;
        null for revisits), payload (null unless ``keep_payload``).
        """
        rows = (self.index if selected is None else selected).select("file", "start", "length")
        stretch = F.floor(F.col("start") / (4 * read_bytes))
        dealt = rows.repartition("file", stretch).sortWithinPartitions("file", "start")
        schema = "page_id long, url string, type string, record_id string, refers_to_record string, digest string, payload_bytes long, payload_sha256 string, payload binary"
        return dealt.mapInArrow(_reader(max_gap, read_bytes, keep_payload), schema)


def _writer(index_path: str):
    """Text of each record of a task, in the order of its index rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        table, at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column("row")
            if table is None:
                system, folder = fs.FileSystem.from_uri(f"{index_path}/archive={row[0].as_py() >> 33}")
                table = dataset.dataset(folder, filesystem=system, format="parquet").to_table(columns=["row", "head", "type", "digest"]).sort_by("row")
            own = table.slice(at, batch.num_rows).combine_chunks()
            at += batch.num_rows
            html = pc.fill_null(batch.column("html"), "")
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in html.to_pylist()]
            if own.column("row").to_pylist() != row.to_pylist() or own.column("digest").to_pylist() != digests:
                raise ValueError("the pages differ between the index and the archive")
            payload = pc.if_else(pc.equal(own.column("type"), "response"), html, "")
            value = pc.binary_join_element_wise(own.column("head"), payload, "")
            yield pa.RecordBatch.from_arrays([value.combine_chunks() if isinstance(value, pa.ChunkedArray) else value], names=["value"])

    return emit


def write_archives(pages: DataFrame, path: str, least: int = MIN_REVISIT) -> Archives:
    """Write ``pages`` (page_id, url, html) below ``path`` as WARC files, index first.

    ``pages`` are read twice; if they are not a table of files, they are stored first.
    """
    spark = pages.sparkSession
    numbered = fixed_rows(pages, "pages").select("page_id", "url", "html").withColumn("row", F.monotonically_increasing_id())
    build_index(numbered, path, least).write.partitionBy("archive").parquet(f"{path}/layout")
    numbered.select("row", "html").mapInArrow(_writer(f"{path}/layout"), "value string").write.option("lineSep", END).text(f"{path}/archives")
    layout = spark.read.schema(LAYOUT).parquet(f"{path}/layout")
    files = spark.read.format("binaryFile").load(f"{path}/archives").select(F.col("path").alias("file"))
    files = files.withColumn("archive", F.regexp_extract("file", r"/part-(\d+)-[^/]*$", 1).cast("long"))
    return Archives(shared_table(layout.join(files, "archive").select("file", *INDEX), "warc-index"))


def _parse(raw: bytes, keep_payload: bool) -> tuple:
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if len(block) != size + len(END) or not raw.endswith(END.encode()):
        raise ValueError(f"record {fields.get('WARC-Record-ID')} does not have its stated length")
    payload = block[:size].partition(b"\r\n\r\n")[2]
    full = fields["WARC-Type"] == "response"
    bare = lambda name: fields[name][1:-1] if name in fields else None
    return (
        int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, fields.get("WARC-Target-URI"), fields["WARC-Type"], bare("WARC-Record-ID"), bare("WARC-Refers-To"),
        fields["WARC-Payload-Digest"].removeprefix("sha256:"), len(payload) if full else None, hashlib.sha256(payload).hexdigest() if full else None,
        payload if keep_payload and full else None,
    )


def coalesced(records: Iterator[tuple[str, int, int]], max_gap: int, read_bytes: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(file, records) of each read: sorted ``records`` (file, start, length) with small gaps, together of bounded size."""
    own, held = None, []
    for file, start, length in records:
        if held and (file != own or start - sum(held[-1]) > max_gap or start + length - held[0][0] > read_bytes):
            yield own, held
            held = []
        own = file
        held.append((start, length))
    if held:
        yield own, held


def _reader(max_gap: int, read_bytes: int, keep_payload: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened, name = None, None
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        columns = ("page_id", "url", "type", "record_id", "refers_to_record", "digest", "payload_bytes", "payload_sha256", "payload")
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file", "start", "length"))))
        for file, held in coalesced(rows, max_gap, read_bytes):
            if file != name:
                if opened:
                    opened.close()
                system, where = fs.FileSystem.from_uri(file)
                opened, name = system.open_input_file(where), file
            low = held[0][0]
            raw = opened.read_at(sum(held[-1]) - low, low)
            found = [_parse(raw[s - low : s - low + n], keep_payload) for s, n in held]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=list(columns))

    return emit


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with payload_bytes and payload_sha256 of revisits taken from the response they refer to, and its page_id as refers_to."""
    table = shared_table(records.select("page_id", "type", "record_id", "refers_to_record", "payload_bytes", "payload_sha256", "digest"), "warc-records")
    first = table.where("type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_sha256").alias("full_sha256")
    )
    plain = table.where("type = 'response'").select("page_id", "payload_bytes", F.col("payload_sha256").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "digest")
    again = table.where("type = 'revisit'").join(first, "refers_to_record").select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_sha256").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "digest"
    )
    wrong = F.raise_error(F.concat(F.lit("payload of another digest than stated: "), F.col("digest")))
    return plain.unionByName(again).withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("digest"), F.col("payload_digest")).otherwise(wrong)).drop("digest")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from archives of ``pages`` in the shared folder."""
    path = f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/lodestone-{uuid.uuid4().hex}/warc"
    return resolved(write_archives(pages, path).read())
