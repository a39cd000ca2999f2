"""Order MinHash document fingerprints, and their likeness to an edited and to the next document.

k-mers are spans of ``k`` words (a text of fewer words is one k-mer), numbered by occurrence. Each of
``m`` hash functions selects the ``l`` smallest numbered k-mers, puts them back into text order and hashes the
tuple of k-mers: one component. Two texts agree in a component only if they share those k-mers in the
same order, so rearranged or rewritten texts lose likeness that plain MinHash would keep.

Null text: empty; a text without words has the component 0 everywhere, and is like itself only. Equal texts
have equal fingerprints. Documents follow each other by descending doc_id (null last, repeated ids by text);
after the last comes the first. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import mix, span_hashes, word_arrays

M = 64
TUPLE = 2
KMER = 2
BUCKET_BYTES = 8 << 20
CHUNK = 8192
_LOWEST = -(1 << 63)


def _coefficients(m: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:m] | np.uint64(1), seeds[m:]


def numbered_kmers(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-mer hashes in text order, and hashes of (k-mer, occurrence number)."""
    kmers = span_hashes(values, k) if len(values) >= k else span_hashes(values, max(len(values), 1))
    if not len(kmers):
        return kmers, kmers
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    heads = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    at = np.arange(len(kmers))
    number = np.empty(len(kmers), dtype=np.uint64)
    number[order] = (at - at[heads][np.cumsum(heads) - 1]).astype(np.uint64)
    return kmers, mix(kmers ^ mix(number + np.uint64(1)))


def signature(values: np.ndarray, m: int = M, l: int = TUPLE, k: int = KMER) -> np.ndarray:  # noqa: E741
    """m components (uint32) of a text given by its word hashes."""
    kmers, numbered = numbered_kmers(values, k)
    if not len(kmers):
        return np.zeros(m, dtype=np.uint32)
    scale, shift = _coefficients(m)
    best_value = np.zeros((m, 0), dtype=np.uint64)
    best_at = np.zeros((m, 0), dtype=np.int64)
    for base in range(0, len(numbered), CHUNK):  # a long text keeps only its smallest so far
        table = numbered[base : base + CHUNK][None, :] * scale[:, None]
        table += shift[:, None]
        table ^= table >> np.uint64(32)
        take = min(l, table.shape[1])
        rows = np.arange(m)
        at, value = [], []
        for i in range(take):
            low = table.argmin(axis=1)
            at.append(low + base)
            value.append(table[rows, low])
            if i + 1 < take:
                table[rows, low] = np.uint64(0xFFFFFFFFFFFFFFFF)
        value, at = np.column_stack([best_value, *value]), np.column_stack([best_at, *at])
        pick = np.argsort(value, axis=1, kind="stable")[:, :l]
        best_value, best_at = np.take_along_axis(value, pick, 1), np.take_along_axis(at, pick, 1)
    best_at.sort(axis=1)  # text order
    out = np.full(m, 0x243F6A8885A308D3, dtype=np.uint64)
    for i in range(best_at.shape[1]):
        out = mix((out * np.uint64(0x9E3779B97F4A7C15)) ^ kmers[best_at[:, i]])
    return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _print(text: str, m: int, l: int, k: int) -> np.ndarray:  # noqa: E741
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    values = word_arrays(data, np.array([0, len(data)]))[0]
    return signature(values, m, l, k)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, m: int = M, l: int = TUPLE, k: int = KMER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:  # noqa: E741
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint (hex), near_edited, near_next.

    Texts move once: buckets are ranges of doc_id, and the first document of each bucket also goes to the
    end of the bucket before it, so every document meets the next one inside a task. The driver holds two numbers
    per bucket of about ``bucket_bytes``.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"), F.col("text"))
    volume = ids.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).first()["b"] or 0
    buckets = int(max(1, volume // bucket_bytes))
    bounds: list[int] = []
    if buckets > 1:
        steps = [i / buckets for i in range(1, buckets)]
        found = ids.agg(F.percentile_approx("id", steps, max(10_000, 20 * buckets)).alias("q")).first()["q"]
        bounds = sorted(set(found or []))
    firsts_in: list[tuple[int, int]] = sorted(
        (r["b"], r["top"]) for r in ids.select("id").mapInArrow(_bucket_tops(bounds), "b int, top long")
        .groupBy("b").agg(F.max("top").alias("top")).collect()
    )
    # The first document of a bucket also ends the bucket of higher ids; the very first one ends the lowest.
    sent = {top: firsts_in[(i + 1) % len(firsts_in)][0] for i, (_, top) in enumerate(firsts_in)}
    shared_sent, shared_bounds = spark.sparkContext.broadcast(sent), spark.sparkContext.broadcast(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, tops = np.array(shared_bounds.value, dtype=np.int64), shared_sent.value
        for batch in batches:
            key = batch.column("id").to_numpy()
            own = np.searchsorted(cuts, key, side="left").astype(np.int32)
            extra = [i for i, x in enumerate(key.tolist()) if x in tops]
            zero = pa.array(np.zeros(len(key), dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array(own), zero, batch.column("id"), batch.column("doc_id"), batch.column("text")],
                                             names=["bucket", "guest", "id", "doc_id", "text"])
            if extra:
                part = batch.take(pa.array(extra))
                to = np.array([tops[int(key[i])] for i in extra], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to), pa.array(np.ones(len(extra), dtype=bool)), part.column("id"), part.column("doc_id"), part.column("text")],
                    names=["bucket", "guest", "id", "doc_id", "text"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # document that waits for the next one
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")]
            out = []
            for bucket, guest, doc, text in zip(*cols):
                text = text or ""
                if guest and held is None:
                    continue  # further rows with the id of the next bucket's first document
                print_ = _print(text, m, l, k)
                if held is not None:
                    out.append(_row(held, text, print_, m, l, k))
                held = None if guest else (doc, text, print_)
            if out:
                yield _rows(out)

    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"))
    kind = dict(docs.dtypes)["doc_id"]
    dealt = rows.mapInArrow(deal, f"bucket int, guest boolean, id long, doc_id {kind}, text string")
    spread = dealt.repartitionById(max(1, buckets), "bucket") if len(bounds) else dealt.repartition(1)
    ordered = spread.sortWithinPartitions("bucket", "guest", F.col("id").desc(), F.coalesce("text", F.lit("")))
    return ordered.mapInArrow(
        walk,
        "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _bucket_tops(bounds: list[int]):
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(bounds, dtype=np.int64)
        best: dict[int, int] = {}
        for batch in batches:
            key = batch.column("id").to_numpy()
            own = np.searchsorted(cuts, key, side="left")
            for b in np.unique(own).tolist():
                best[b] = max(best.get(b, _LOWEST), int(key[own == b].max()))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["b", "top"])

    return tops


def _hex(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def _row(held, following: str, next_print: np.ndarray, m: int, l: int, k: int) -> tuple:  # noqa: E741
    doc, text, own = held
    edited = _edited(text, following)
    changed = own if edited == text else _print(edited, m, l, k)
    return doc, len(text), edited, _hex(own), _hex(changed), likeness(own, changed), likeness(own, next_print)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
