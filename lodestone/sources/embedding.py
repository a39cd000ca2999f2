"""Embedding providers: contract, HTTP client and the job that embeds distinct texts once."""

from __future__ import annotations

import hashlib
import http.client
import json
import math
import os
import re
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..errors import compact_json
from ..functions.text import content_hash, utf16_length
from ..functions.vectors import require_unit_vector


class EmbeddingProvider(Protocol):
    fingerprint: str
    dimensions: int

    def embed(self, texts: Sequence[str], purpose: str) -> tuple[list[list[float]], int | None]:
        """Vectors in input order and the reported token count, if any."""


def ordered_vectors(body: object, count: int, dimensions: int) -> list[list[float]]:
    """Vectors of a response in input order; indexes must be complete and unique."""
    rows = body.get("data") if isinstance(body, dict) else None
    if not isinstance(rows, list):
        raise ValueError("Invalid embedding API response")
    placed: dict[int, list[float]] = {}
    for row in rows:
        index = row.get("index") if isinstance(row, dict) else None
        if not isinstance(index, int) or not 0 <= index < count or index in placed:
            raise ValueError("Invalid embedding response index")
        placed[index] = row.get("embedding")
    if len(placed) != count:
        raise ValueError("Embedding response count mismatch")
    for vector in placed.values():
        numbers = isinstance(vector, list) and all(isinstance(x, (int, float)) and math.isfinite(x) for x in vector)
        if not numbers or len(vector) != dimensions:
            raise ValueError("Embedding response has invalid dimensions or values")
    return [placed[i] for i in range(count)]


@dataclass(frozen=True)
class HttpEmbeddings:
    """Provider for an HTTP endpoint ``{base_url}/embeddings``. Picklable: runs inside tasks."""

    base_url: str
    model: str
    dimensions: int
    api_key_env: str
    batch_size: int = 8
    timeout_ms: int = 30_000
    document_prefix: str = ""
    query_prefix: str = ""
    send_dimensions: bool = True

    def __post_init__(self) -> None:
        if not re.match(r"^https?://[^/@?#]+(/[^?#]*)?$", self.base_url):
            raise ValueError("base_url must be HTTP(S) without credentials, query or fragment")
        if not 1 <= self.dimensions <= 8192 or not 1 <= self.batch_size <= 128:
            raise ValueError("dimensions must lie in 1-8192 and batch_size in 1-128")

    @property
    def endpoint(self) -> str:
        return self.base_url.rstrip("/") + "/embeddings"

    @property
    def fingerprint(self) -> str:
        identity = [
            "unit-float32", self.endpoint, self.model, self.dimensions, self.send_dimensions, self.document_prefix, self.query_prefix,
        ]
        return hashlib.sha256(compact_json(identity).encode()).hexdigest()

    def embed(self, texts: Sequence[str], purpose: str) -> tuple[list[list[float]], int | None]:
        key = os.environ.get(self.api_key_env)
        if not key:
            raise ValueError(f"Embedding key missing: set environment variable {self.api_key_env}")
        prefix = self.query_prefix if purpose == "query" else self.document_prefix
        payload = {"model": self.model, "input": [prefix + t for t in texts], "encoding_format": "float"}
        if self.send_dimensions:
            payload["dimensions"] = self.dimensions
        request = urllib.request.Request(
            self.endpoint, json.dumps(payload).encode(),
            {"content-type": "application/json", "authorization": f"Bearer {key}"},
        )
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_ms / 1000) as reply:
                body = json.load(reply)
        except urllib.error.HTTPError as error:
            raise ValueError(f"Embedding API HTTP {error.code}; check endpoint, model and key") from None
        except (OSError, http.client.HTTPException) as error:  # refused, unresolved, timed out or cut off
            raise ValueError(f"Embedding API not reachable: {error}") from None
        except ValueError:
            raise ValueError("Embedding API reply is not JSON") from None
        usage = body.get("usage") if isinstance(body, dict) else None
        tokens = usage.get("total_tokens") if isinstance(usage, dict) else None
        known = isinstance(tokens, int) and tokens >= 0
        return ordered_vectors(body, len(texts), self.dimensions), tokens if known else None


def embed_texts(
    df: DataFrame, provider: EmbeddingProvider, text: str = "text", purpose: str = "document", batch_size: int = 8
) -> DataFrame:
    """(text_hash, embedding, request, tokens, chars) for every distinct text.

    Texts are deduplicated before any call. The caller must write or checkpoint the result
    before using it, so a retried task is the only way a text is sent twice.
    """
    distinct = df.select(F.col(text).alias("text")).distinct().withColumn("text_hash", content_hash("text"))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                found, tokens = provider.embed(part["text"].tolist(), purpose)
                if len(found) != len(part):
                    raise ValueError("Embedding response count mismatch")
                yield pd.DataFrame(
                    {
                        "text_hash": part["text_hash"].to_numpy(), "text": part["text"].to_numpy(), "vector": found,
                        "request": str(uuid.uuid4()), "tokens": pd.Series([tokens] * len(part), dtype="Int64").to_numpy(dtype=object),
                    }
                )

    raw = distinct.select("text_hash", "text").mapInPandas(
        call, "text_hash string, text string, vector array<double>, request string, tokens long"
    )
    return raw.select(
        "text_hash", require_unit_vector("vector", provider.dimensions).alias("embedding"), "request", "tokens",
        utf16_length("text").alias("chars"),
    )


def usage_ledger(embedded: DataFrame) -> DataFrame:
    """Requests, texts, characters and tokens; tokens are null if any request omitted them."""
    per_request = embedded.groupBy("request").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("chars").alias("chars"), F.max("tokens").alias("tokens")
    )
    return per_request.agg(
        F.count(F.lit(1)).alias("requests"), F.sum("texts").alias("texts"), F.sum("chars").alias("input_chars"),
        F.when(F.count("tokens") == F.count(F.lit(1)), F.sum("tokens")).alias("reported_tokens"),
    )
