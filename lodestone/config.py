"""Retrieval options, filters and request validation (driver side)."""

from __future__ import annotations

import dataclasses
import math
import re
from dataclasses import dataclass
from typing import Any

from .errors import RetrievalError

UUID_V4 = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"

# Option name -> (kind, lowest, highest) or allowed words.
_CHOICES = {
    "mode": ("hybrid", "bm25", "dense"),
    "packing_mode": ("preview", "whole"),
    "lexical_engine": ("bm25plus", "fts"),
}
_RANGES = {
    "bm25_k": (float, 0.0, 100.0),
    "bm25_b": (float, 0.0, 1.0),
    "bm25_d": (float, 0.0, 100.0),
    "topk": (int, 1, 100),
    "max_results": (int, 1, 100),
    "max_chunks_per_source": (int, 1, 100),
    "bm25_candidates": (int, 1, 1000),
    "dense_candidates": (int, 1, 1000),
    "rrf_k": (int, 1, 1000),
    "title_weight": (float, 0.0, 20.0),
    "bm25_weight": (float, 0.0, 10.0),
    "dense_weight": (float, 0.0, 10.0),
    "max_context_chars": (int, 256, 100000),
    "min_dense_similarity": (float, -1.0, 1.0),
}
MIN_CONTEXT_CHARS = _RANGES["max_context_chars"][1]
# Names of the two lexical engines' underlying libraries, accepted as synonyms.
_ENGINE_SYNONYMS = {"minisearch": "bm25plus", "sqlite": "fts"}
_OPTION_SYNONYMS = {"minisearch_k": "bm25_k", "minisearch_b": "bm25_b", "minisearch_d": "bm25_d"}


@dataclass(frozen=True)
class RetrievalOptions:
    mode: str = "hybrid"
    packing_mode: str = "preview"
    lexical_engine: str = "bm25plus"
    bm25_k: float = 1.2
    bm25_b: float = 0.7
    bm25_d: float = 0.5
    topk: int = 10
    max_results: int = 20
    max_chunks_per_source: int = 6
    bm25_candidates: int = 60
    dense_candidates: int = 60
    rrf_k: int = 10
    title_weight: float = 2.0
    bm25_weight: float = 0.5
    dense_weight: float = 1.0
    max_context_chars: int = 20000
    min_dense_similarity: float = 0.3

    def __post_init__(self) -> None:
        for name, allowed in _CHOICES.items():
            if getattr(self, name) not in allowed:
                raise RetrievalError("INVALID_REQUEST", f"{name} must be one of {allowed}")
        for name, (kind, low, high) in _RANGES.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise RetrievalError("INVALID_REQUEST", f"{name} must be a number")
            if not math.isfinite(value) or (kind is int and value != int(value)):
                raise RetrievalError("INVALID_REQUEST", f"{name} must be a finite {kind.__name__}")
            if not low <= value <= high or (name == "bm25_k" and value == 0):
                raise RetrievalError("INVALID_REQUEST", f"{name} must lie in [{low}, {high}]")
        if self.bm25_weight + self.dense_weight <= 0:
            raise RetrievalError("INVALID_REQUEST", "At least one retrieval weight must be positive")
        if self.topk > self.max_results:
            raise RetrievalError("INVALID_REQUEST", "topk must not exceed max_results")

    def override(self, changes: dict[str, Any] | None) -> "RetrievalOptions":
        """Request overrides on top of these options; unknown keys and max_results are refused."""
        clean: dict[str, Any] = {}
        for key, value in (changes or {}).items():
            key = _OPTION_SYNONYMS.get(key, key)
            if key == "max_results" or key not in {f.name for f in dataclasses.fields(self)}:
                raise RetrievalError("INVALID_REQUEST", f"Unknown override: {key}")
            clean[key] = _ENGINE_SYNONYMS.get(value, value) if key == "lexical_engine" else value
        return dataclasses.replace(self, **clean)

    def lane_weight(self, lane: str) -> float:
        """A lane alone counts 1; configured weights apply only when both lanes run."""
        if self.mode != "hybrid":
            return 1.0
        return self.bm25_weight if lane == "bm25" else self.dense_weight

    @property
    def lanes(self) -> tuple[str, ...]:
        return ("bm25", "dense") if self.mode == "hybrid" else (self.mode,)


@dataclass(frozen=True)
class SearchFilters:
    """Absent list = no predicate; empty list selects nothing."""

    collections: tuple[str, ...] | None = None
    source_ids: tuple[str, ...] | None = None
    path_prefix: str | None = None

    @property
    def any(self) -> bool:
        return (
            self.collections is not None
            or self.source_ids is not None
            or self.path_prefix is not None
        )


def _reject(code: str, message: str) -> None:
    raise RetrievalError(code, message)


def parse_filters(
    raw: dict[str, Any] | None, known_collections: set[str] | None = None, uuid_ids: bool = True
) -> SearchFilters:
    raw = dict(raw or {})
    extra = set(raw) - {"collections", "source_ids", "path_prefix"}
    if extra:
        _reject("INVALID_REQUEST", f"Unknown filter: {sorted(extra)}")
    collections, ids, prefix = (raw.get(k) for k in ("collections", "source_ids", "path_prefix"))
    if collections is not None:
        if len(collections) > 32 or any(not 1 <= len(c) <= 100 for c in collections):
            _reject("INVALID_REQUEST", "collections: at most 32 names of 1-100 characters")
        unknown = [c for c in collections if known_collections is not None and c not in known_collections]
        if unknown:
            _reject("INVALID_COLLECTION", "Unknown collection ID: " + ", ".join(unknown))
    if ids is not None:
        if len(ids) > 100 or (uuid_ids and any(not re.match(UUID_V4, i) for i in ids)):
            _reject("INVALID_REQUEST", "source_ids: at most 100 version 4 UUIDs")
        ids = [i.lower() for i in ids] if uuid_ids else ids
    if prefix is not None:
        prefix = prefix.replace("\\", "/")
        if len(prefix) > 1000:
            _reject("INVALID_REQUEST", "path_prefix is limited to 1000 characters")
        if re.match(r"(?i)^(?:[a-z]:|/)", prefix) or ".." in prefix.split("/"):
            _reject("INVALID_PATH_PREFIX", "path_prefix must be relative to a collection root")
    return SearchFilters(
        None if collections is None else tuple(collections),
        None if ids is None else tuple(ids),
        prefix,
    )


@dataclass(frozen=True)
class QuerySpec:
    query_id: str
    text: str
    variants: tuple[str, ...] = ()

    @property
    def expressions(self) -> list[str]:
        return list(dict.fromkeys([self.text, *self.variants]))


@dataclass(frozen=True)
class SearchRequest:
    queries: tuple[QuerySpec, ...]
    filters: SearchFilters
    options: RetrievalOptions
    diagnostics: bool = False


def _query_text(value: Any) -> str:
    text = value.strip() if isinstance(value, str) else ""
    if not 1 <= len(text) <= 2000:
        _reject("INVALID_REQUEST", "query text must have 1-2000 characters")
    return text


def parse_request(
    raw: dict[str, Any],
    base: RetrievalOptions | None = None,
    known_collections: set[str] | None = None,
    uuid_ids: bool = True,
) -> SearchRequest:
    """Validate a search request: one ``query`` or 1-8 ``queries`` with unique ids."""
    extra = set(raw) - {"query", "queries", "filters", "overrides", "diagnostics"}
    if extra:
        _reject("INVALID_REQUEST", f"Unknown request field: {sorted(extra)}")
    if ("query" in raw) == ("queries" in raw):
        _reject("INVALID_REQUEST", "Provide exactly one of query or queries")
    if "query" in raw:
        specs = [QuerySpec("q0", _query_text(raw["query"]))]
    else:
        if not 1 <= len(raw["queries"]) <= 8:
            _reject("INVALID_REQUEST", "queries must have 1-8 entries")
        specs = []
        for q in raw["queries"]:
            qid = str(q.get("query_id", "")).strip()
            variants = q.get("variants", [])
            if set(q) - {"query_id", "text", "variants"} or not 1 <= len(qid) <= 64 or len(variants) > 3:
                _reject("INVALID_REQUEST", "invalid query specification")
            specs.append(QuerySpec(qid, _query_text(q.get("text")), tuple(map(_query_text, variants))))
        if len({s.query_id for s in specs}) != len(specs):
            _reject("INVALID_REQUEST", "query_id values must be unique")
    return SearchRequest(
        tuple(specs),
        parse_filters(raw.get("filters"), known_collections, uuid_ids),
        (base or RetrievalOptions()).override(raw.get("overrides")),
        bool(raw.get("diagnostics", False)),
    )
