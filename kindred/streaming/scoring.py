"""An extension: score records as they arrive against a fixed set of targets, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kindred.plans.pipeline import LinkageConfig, candidates


def link_stream(records: DataFrame, targets: DataFrame, config: LinkageConfig, path: str, checkpoint: str, blocks: Callable[..., DataFrame] = candidates, **trigger) -> StreamingQuery:
    """Append every batch's candidates to the Parquet folder ``path``; a batch that runs again replaces its own folder."""

    def batch(frame: DataFrame, number: int) -> None:
        blocks(frame, targets, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
