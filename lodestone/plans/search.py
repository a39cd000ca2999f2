"""Batch search over a published index: all requests of a batch run as one job."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..config import RetrievalOptions, SearchRequest, parse_request
from ..operators import dense, fusion, lexical
from ..operators.packing import pack_responses
from ..operators.selection import scope
from ..sources.embedding import EmbeddingProvider
from .index import EvidenceIndex, term_hash

KEYS = ("request_id", "query_id", "expr")
PER_QUERY = ("request_id", "query_id")
_EXPRESSION_SCHEMA = "request_id long, ordinal int, query_id string, expr int, text string"


def _expressions(requests: list[tuple[int, SearchRequest]]) -> list[tuple]:
    """At most 8 queries × 4 wordings per validated request."""
    return [
        (number, ordinal, spec.query_id, expr, text)
        for number, request in requests
        for ordinal, spec in enumerate(request.queries)
        for expr, text in enumerate(spec.expressions)
    ]


class SearchEngine:
    def __init__(
        self,
        index: EvidenceIndex,
        provider: EmbeddingProvider | None = None,
        options: RetrievalOptions = RetrievalOptions(),
        collections: set[str] | None = None,
    ):
        self.index, self.provider, self.options, self.collections = index, provider, options, collections
        self.spark = index.spark

    def _embed_queries(self, rows: list[tuple]) -> tuple[DataFrame | None, dict[tuple, tuple[str, str]]]:
        """Vectors of the expressions that could be embedded, and what failed per query.

        One call for the batch; only if it fails are texts tried one by one, so that a bad
        text does not take the other queries down.
        """
        from ..functions.vectors import require_unit_vector

        vector: dict[str, list[float]] = {}
        failed: dict[str, str] = {}
        texts = list(dict.fromkeys(r[4] for r in rows))
        try:
            if self.provider is None:
                raise ValueError("Embedding provider unavailable")
            size = getattr(self.provider, "batch_size", len(texts) or 1)
            for at in range(0, len(texts), size):
                part = texts[at : at + size]
                vector.update(zip(part, self.provider.embed(part, "query")[0]))
        except (ValueError, OSError) as broken:
            vector = {}
            for text in texts:
                try:
                    if self.provider is None:
                        raise broken
                    vector[text] = self.provider.embed([text], "query")[0][0]
                except (ValueError, OSError) as failure:
                    failed[text] = str(failure)
        for text, values in list(vector.items()):
            norm = math.hypot(*values)
            if not math.isfinite(norm) or norm == 0:
                failed[text] = "Embedding vector is zero or not finite"
                del vector[text]
        problems: dict[tuple, tuple[str, str]] = {}
        for request, _, query, _, _ in rows:
            own = [r[4] for r in rows if (r[0], r[2]) == (request, query)]
            messages = list(dict.fromkeys(failed[t] for t in own if t in failed))
            if messages:
                lost = "error" if all(t in failed for t in own) else "partial_failure"
                problems[(request, query)] = (lost, "; ".join(messages))
        usable = [(r[0], r[2], r[3], [float(x) for x in vector[r[4]]]) for r in rows if r[4] in vector]
        if not usable:
            return None, problems
        frame = self.spark.createDataFrame(usable, "request_id long, query_id string, expr int, v array<double>")
        return frame.select(*KEYS, require_unit_vector("v", self.provider.dimensions).alias("embedding")), problems

    def _candidates(self, state: dict, requests: list[tuple[int, SearchRequest]]):
        """Ranked candidates per query, with the lane counts and the dense failures."""
        filters, options = requests[0][1].filters, requests[0][1].options
        rows = _expressions(requests)
        expressions = self.spark.createDataFrame(rows, _EXPRESSION_SCHEMA)
        allowed = scope(filters)
        keep = ("source_id", "collection_id", "relative_path")
        lanes, problems = None, {}
        if options.mode != "dense":
            # Bounded by 4,096 terms per request: the driver may know the terms to read.
            dictionary, han = self.index.profile.dictionary, self.index.profile.han
            wanted = lexical.query_terms(expressions, keys=KEYS, dictionary=dictionary, han=han)
            terms = [(r["term"], r["h"]) for r in wanted.select("term", term_hash(F.col("term")).alias("h")).distinct().collect()]
            lengths = self.index.numbered_lengths(state)
            stats = lexical.corpus_stats(lengths)
            ranked = lexical.lexical_lane(
                None, expressions, options, keys=KEYS, keep=keep, allowed=allowed, stats=stats,
                counted=self.index.postings(state, terms), numbered=lengths, chunks=lengths, dictionary=dictionary, han=han,
            )
            lanes = fusion.tag_lane(ranked, "bm25")
        if options.mode != "bm25":
            queries, problems = self._embed_queries(rows)
            if queries is not None:
                corpus = self.index.vectors(state, self.index.profile.vector_key(self.provider))
                corpus = corpus if allowed is None else corpus.filter(allowed)
                near = fusion.tag_lane(dense.dense_lane(corpus, queries, options, keys=KEYS, keep=keep), "dense")
                lanes = near if lanes is None else lanes.unionByName(near.select(*lanes.columns))
        if lanes is None:
            empty = "request_id long, query_id string, chunk_id string, source_id string, score double, bm25_rank int, dense_rank int, similarity double, rank int"
            merged = self.spark.createDataFrame([], empty)
        else:
            keep_source = ("source_id",)
            fused = fusion.fuse(lanes, options, KEYS, keep_source)
            merged = fusion.rank_fused(fusion.merge_variants(fused, expressions, PER_QUERY, keep_source), PER_QUERY)
        ordinals = expressions.select(*PER_QUERY, "ordinal").distinct()
        counts = None if lanes is None else lanes.groupBy(*PER_QUERY).agg(
            F.sum((F.col("lane") == "bm25").cast("int")).alias("bm25"), F.sum((F.col("lane") == "dense").cast("int")).alias("dense")
        )
        return merged.join(F.broadcast(ordinals), list(PER_QUERY)), ordinals, counts, problems

    def search(self, requests: Sequence[dict[str, Any]], uuid_ids: bool = True) -> DataFrame:
        """One packed response per request; requests with the same scope and options share a job."""
        parsed = [(i, parse_request(r, self.options, self.collections, uuid_ids)) for i, r in enumerate(requests)]
        groups: dict[tuple, list[tuple[int, SearchRequest]]] = {}
        for number, request in parsed:
            groups.setdefault((request.filters, request.options, request.diagnostics), []).append((number, request))
        out = None
        for (_, options, diagnostics), members in groups.items():
            key = self.index.profile.vector_key(self.provider) if self.provider else None
            mode = options.mode if options.mode == "bm25" or self.provider else "bm25"
            state = self.index.require(mode, key)
            candidates, ordinals, counts, problems = self._candidates(state, members)
            failures = self.spark.createDataFrame(
                [(r, q, lost if options.mode == "dense" else "partial_failure", text) for (r, q), (lost, text) in problems.items()],
                "request_id long, query_id string, failed string, error string",
            )
            asked = ordinals.join(F.broadcast(failures), list(PER_QUERY), "left")
            if counts is None:
                asked = asked.withColumns({"bm25": F.lit(0), "dense": F.lit(0)})
            else:
                asked = asked.join(counts, list(PER_QUERY), "left").fillna(0, ["bm25", "dense"])
            asked = asked.withColumn(
                "status",
                F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("bm25") + F.col("dense") > 0, "ok").otherwise("empty"),
            )
            evidence = self.index.chunks(state)
            packed = pack_responses(candidates, evidence, asked, options, diagnostics)
            out = packed if out is None else out.unionByName(packed)
        return out
