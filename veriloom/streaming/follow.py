"""Incremental ingest: a stream of the files that have grown, which feeds the store.

The stream's offset has the bytes of each file that were taken, so a file that grows
under its path is seen again, and after a restart only what is new.  The store decides
what of a file is new by each session's last stored line, so a batch that runs again adds
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veriloom.sources.store import Store
from veriloom.streaming.transcripts import growing


def follow(spark: SparkSession, root: str, store: Store, checkpoint: str, repo: str | None = None, settled: float = 60, **trigger) -> StreamingQuery:
    """Starts the stream over ``root``/*/*.jsonl; ``trigger`` as in DataStreamWriter.trigger."""

    def add(batch: DataFrame, number: int) -> None:
        files = sorted(r[0] for r in batch.select("file").distinct().collect())  # names of the files that grew
        store.ingest(files, repo)

    names = growing(spark, root, names="true", settled=str(settled))
    return names.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
