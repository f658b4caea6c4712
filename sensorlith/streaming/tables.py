"""Streams that keep tables: each batch replaces its keys, so a batch run twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sensorlith.operators.upserts import upsert_table
from sensorlith.streaming.runs import drain_batches


def keep_tables(
    documents: DataFrame, tables: dict[str, tuple], root: str, checkpoint: str
) -> StreamingQuery:
    """``tables`` maps a table name to (documents → rows, key columns) or (…, columns by which the newest row wins)."""

    def handle(batch: DataFrame, _: int) -> None:
        batch.persist()
        for name, (rows, keys, *newest) in tables.items():
            upsert_table(f"{root}/{name}", rows(batch), keys, *newest)
        batch.unpersist()

    return drain_batches(documents, handle, checkpoint)
