"""Starting streams over files and reading what they wrote."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from sensorlith.session import work_path


def folder_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive; the limit keeps a batch, and so the state's input, small under overload."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; running it again with the same checkpoint goes on with new files."""
    q = started(stream, out, checkpoint, mode)
    q.awaitTermination()
    return q


def started(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """The stream, running over what is there."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


PARTITIONS_CONF = "spark.sql.shuffle.partitions"
#: rows that go to Python at once. The whole state of a key goes along each time, so many calls would repeat it
ROWS_CONF, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 200_000


@contextmanager
def bounded(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Streams that start within have their state in no more partitions than this, and give Python many rows at once; the session gets
    its own settings back."""
    usual = {} if partitions is None else {c: spark.conf.get(c) for c in (PARTITIONS_CONF, ROWS_CONF)}
    try:
        if usual and partitions < int(usual[PARTITIONS_CONF]):
            spark.conf.set(PARTITIONS_CONF, str(partitions))
        if usual and 0 < int(usual[ROWS_CONF]) < ROWS:
            spark.conf.set(ROWS_CONF, str(ROWS))
        yield
    finally:
        for name, value in usual.items():
            spark.conf.set(name, value)


def replay(
    pieces: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str, mode: str = "append", closing: DataFrame | None = None, partitions: int | None = None
) -> DataFrame:
    """Feed the pieces to a stream one after the other, as files that arrive, and read its output.

    ``closing`` comes last: rows that end the sources, or one of a time so late that the watermark passes all others.
    ``partitions`` is for pieces of narrow rows that do not grow with the input: each batch opens the state of every
    partition, so as many as a whole table's shuffle needs would cost more than the rows.
    """
    spark = pieces[0].sparkSession
    root = work_path(spark, name)
    for piece in [*pieces, *([closing.select(*pieces[0].columns)] if closing is not None else [])]:
        piece.write.mode("append").parquet(f"{root}/in")
        with bounded(spark, partitions):
            drain(build(folder_stream(spark, f"{root}/in", pieces[0].schema)), f"{root}/out", f"{root}/checkpoint", mode)
    return spark.read.parquet(f"{root}/out")


def closing_row(df: DataFrame, **values: Column) -> DataFrame:
    """One row with the columns of ``df``: the given values, null for the rest."""
    blank = {f.name: values.get(f.name, F.lit(None)).cast(f.dataType) for f in df.schema}
    return df.sparkSession.range(1).select(*[v.alias(n) for n, v in blank.items()])


def budget(progress: list[dict], seconds_per_row: float) -> list[dict]:
    """Per batch: rows, milliseconds, and the share of real time the batch used up."""
    out = []
    for p in progress:
        rows, ms = p["numInputRows"], p["durationMs"].get("triggerExecution", 0)
        real_ms = rows * seconds_per_row * 1000.0
        out.append({"batch_id": p["batchId"], "rows": rows, "duration_ms": ms, "utilisation": ms / real_ms if real_ms else None})
    return out


BUDGET = "batch_id long, input_rows long, batch_ms long, ms_per_row double, rows_per_second double"


class BudgetListener(StreamingQueryListener):
    """Keeps what the session's streams report while it listens."""

    def __init__(self) -> None:
        self.progress: list = []
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        """Nothing has been read yet."""

    def onQueryIdle(self, event) -> None:
        """Nothing was read."""

    def onQueryProgress(self, event) -> None:
        self.progress.append(event.progress)

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.runId))

    def rows(self, run_id: str) -> list[tuple]:
        """A row for each batch of one stream that had input: what it read and what time it took."""
        out = {}
        for p in self.progress:
            if str(p.runId) == run_id and p.numInputRows:
                ms = int(p.durationMs.get("triggerExecution", 0))
                out[p.batchId] = (p.batchId, p.numInputRows, ms, ms / p.numInputRows, float(p.processedRowsPerSecond))
        return sorted(out.values())


def drain_with_budget(spark: SparkSession, start: Callable[[], StreamingQuery], wait_s: float = 120.0) -> DataFrame:
    """Run a stream that ends by itself and give the budget rows of its batches (``BUDGET``). Reports come in after the batches, so
    the report of the end is awaited."""
    listener = BudgetListener()
    spark.streams.addListener(listener)
    try:
        query = start()
        run_id = str(query.runId)
        query.awaitTermination()
        give_up = time.monotonic() + wait_s
        while run_id not in listener.ended and time.monotonic() < give_up:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame(listener.rows(run_id), BUDGET)
