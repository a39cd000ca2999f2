"""Continuous ingestion: new Markdown files are synced into the index as they arrive.

Each micro-batch is one ordinary incremental sync, so a replayed batch finds its sources
unchanged and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintenance import last_row_wins
from ..plans.index import EvidenceIndex
from ..sources.embedding import EmbeddingProvider
from ..sources.markdown import parse_sources, scan_markdown


def stream_markdown(
    index: EvidenceIndex,
    root: str,
    collection_id: str,
    checkpoint: str,
    provider: EmbeddingProvider | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a file stream over ``root``; by default it takes what is there and stops."""
    files = scan_markdown(index.spark, root, collection_id, stream=True)

    def sync_batch(batch: DataFrame, _: int) -> None:
        # Of two files with one identity the one written last counts.
        latest = last_row_wins(parse_sources(batch), "source_id", F.struct("modified", "path"))
        index.sync(latest, provider, remove_missing=False)

    return (
        files.writeStream.foreachBatch(sync_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
