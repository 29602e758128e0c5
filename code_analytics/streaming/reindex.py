"""Incremental re-indexing from a stream of changed files.

Each micro-batch is merged into a stored index, and the manifest that publishes the merged rows names the batch. A batch that
comes again after a crash is therefore applied once: before the commit it is merged anew from the same version, after it, it is
skipped. Within a batch the last change of a file wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes
from ..sources.tables import VersionedTable

CHANGES = "repo string, file_path string, status string, content string, at timestamp"


def merge_batches(index: VersionedTable, stream: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch (repo, file_path, status, content, at) into the index."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("repo", "file_path").agg(F.max_by(F.struct("status", "content"), F.struct("at", "status")).alias("c")).select("repo", "file_path", "c.*")
        changes.merge_stored(index, last.select("repo", "file_path", "status"), last.where("status <> 'deleted'").select("repo", "file_path", "content"), (stream, batch_id))

    return merge


def reindex(stream: DataFrame, index: VersionedTable, checkpoint: str, name: str = "reindex") -> StreamingQuery:
    """Runs over what the stream has now and ends."""
    return stream.writeStream.foreachBatch(merge_batches(index, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
