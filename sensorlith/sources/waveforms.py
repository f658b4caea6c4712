"""Waveform files as signal blocks."""

from __future__ import annotations

import io
import struct
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sensorlith.plans.signals import DOUBLES, iter_blocks, pcm_to_float
from sensorlith.session import ship

#: bytes that opening a file counts as, so that a task of short files is no longer than one of long ones
OPEN_BYTES = 32 << 10
#: tasks at most, unless each of them has TASK_BYTES to read: more than that take several parts in a row
MOST_TASKS, TASK_BYTES = 256, 32 << 20
#: rows that are handed on at once
BATCH_ROWS = 1024

#: samples by their bytes
KINDS = {1: np.dtype("u1"), 2: np.dtype("<i2"), 4: np.dtype("<i4")}

BLOCKS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("rate_hz", T.IntegerType()),
        T.StructField("block_idx", T.LongType()),
        T.StructField("samples", DOUBLES),
    ]
)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """A single file or all .wav files below a folder, one row each."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)


def decode(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, one channel within about ±1) of an uncompressed file of 1, 2 or 4 bytes per sample."""
    with wave.open(io.BytesIO(content)) as f:
        raw = np.frombuffer(f.readframes(f.getnframes()), dtype=KINDS[f.getsampwidth()])
        if f.getnchannels() > 1:
            raw = raw.reshape(-1, f.getnchannels())
        return f.getframerate(), pcm_to_float(raw)


def blocks(files: DataFrame, block: int = 1024) -> DataFrame:
    """Decode files (path, content) into block rows, a file at a time, handing blocks on in small batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rate, x = decode(content)
                rows = []
                for i, samples in iter_blocks(x, block):
                    rows.append((path, rate, i, samples))
                    if len(rows) == 1024:
                        yield pd.DataFrame(rows, columns=BLOCKS.names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=BLOCKS.names)

    return files.select("path", "content").mapInPandas(run, BLOCKS)


# --- files as a data source: parts of files side by side, and files written by tasks ---------


def header(file) -> tuple[int, int, int, int, int]:
    """(channels, bytes per sample, rate, first byte and length of the samples) of an open uncompressed file."""
    riff, _, kind = struct.unpack("<4sI4s", file.read(12))
    if riff != b"RIFF" or kind != b"WAVE":
        raise ValueError("not a waveform file")
    channels = width = rate = 0
    while True:
        name, size = struct.unpack("<4sI", file.read(8))
        if name == b"data":
            return channels, width, rate, file.tell(), size
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            width = bits // 8
            size -= 16
        file.seek(file.tell() + size + size % 2)


@dataclass
class FileParts(InputPartition):
    """(file, number of the part, of how many) of one task."""

    parts: list[tuple[str, int, int]]


class WaveformSource(DataSource):
    """Reads ``path`` (a .wav file or all below a folder) as rows of ``block`` samples, and writes rows of PCM samples as files.

    A part of about ``part_bytes`` is a piece of a long file or several short ones. A task reads one, or several in a row where
    there are more than ``MOST_TASKS``. Only its own bytes of a file and the header are read.
    """

    @classmethod
    def name(cls) -> str:
        return "sensorlith_waveform"

    def schema(self) -> T.StructType:
        return BLOCKS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WaveformReader(self.options["path"], int(self.options.get("block", 1024)), int(self.options.get("part_bytes", 32 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WaveformWriter(self.options["path"])


class WaveformReader(DataSourceReader):
    def __init__(self, path: str, block: int, part_bytes: int) -> None:
        self.path, self.block, self.part_bytes = path, block, part_bytes

    def partitions(self) -> list[FileParts]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out, room, total = [], 0, 0
        for info in sorted((f for f in files if f.type == fs.FileType.File and f.path.endswith(".wav")), key=lambda f: f.path):
            of = max(1, -(-info.size // self.part_bytes))
            total += info.size
            for k in range(of):
                size = max(info.size if of == 1 else self.part_bytes, min(OPEN_BYTES, self.part_bytes))
                if not out or room < size:
                    out.append(FileParts([]))
                    room = self.part_bytes
                out[-1].parts.append((info.path, k, of))
                room -= size
        each = -(-len(out) // max(MOST_TASKS, total // TASK_BYTES))
        return [FileParts([p for part in out[i : i + each] for p in part.parts]) for i in range(0, len(out), each or 1)] or [FileParts([])]

    def read(self, partition: FileParts) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        waiting, rows = [], 0
        for path, k, of in partition.parts:
            with store.open_input_file(path) as file:
                channels, width, rate, first, size = header(file)
                frame = channels * width
                blocks = -(-(min(size, file.size() - first) // frame) // self.block)
                each = -(-blocks // of)
                for low in range(k * each, min((k + 1) * each, blocks), 256):
                    high = min(low + 256, (k + 1) * each, blocks)
                    file.seek(first + low * self.block * frame)
                    data = file.read(min((high - low) * self.block * frame, first + size - file.tell()))
                    raw = np.frombuffer(data[: len(data) // frame * frame], KINDS[width]).reshape(-1, channels)
                    waiting.append((path, rate, low, pcm_to_float(raw)))
                    rows += high - low
                    if rows >= BATCH_ROWS or len(waiting[-1][3]) * 2 >= 256 * self.block:
                        yield _block_rows(waiting, self.block)
                        waiting, rows = [], 0
        if waiting:
            yield _block_rows(waiting, self.block)


def _block_rows(stretches: list[tuple[str, int, int, np.ndarray]], block: int) -> pa.RecordBatch:
    """Stretches (file, rate, number of the first block, samples) as block rows; only the last block of a stretch is shorter."""
    counts = [-(-len(x) // block) for _, _, _, x in stretches]
    lengths = np.concatenate([np.minimum(block, len(x) - np.arange(0, len(x), block)) for _, _, _, x in stretches])
    samples = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.concatenate([x for _, _, _, x in stretches]), pa.float64()))
    paths = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(stretches)), counts), pa.int32()), [path for path, _, _, _ in stretches]).dictionary_decode()
    numbers = np.concatenate([low + np.arange(n) for (_, _, low, _), n in zip(stretches, counts)])
    return pa.RecordBatch.from_arrays([paths, pa.array(np.repeat([rate for _, rate, _, _ in stretches], counts), pa.int32()), pa.array(numbers, pa.int64()), samples], names=BLOCKS.names)


class WaveformWriter(DataSourceArrowWriter):
    """Rows (name, rate_hz, channels, width, pcm: whole numbers, channels in turn) as files ``name``.wav.

    A file gets its name when it is whole, so a task that is lost leaves no half file under a name, and one that runs twice writes
    the same. The mark of success comes last.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            plain = (batch[c].to_pylist() for c in ("name", "rate_hz", "channels", "width"))
            for name, rate, channels, width, pcm in zip(*plain, batch["pcm"]):
                content = io.BytesIO()
                with wave.open(content, "wb") as f:
                    f.setnchannels(channels)
                    f.setsampwidth(width)
                    f.setframerate(rate)
                    f.writeframes(pcm.values.cast(pa.from_numpy_dtype(KINDS[width])).to_numpy().tobytes())
                draft = f"{root}/_{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(content.getvalue())
                store.move(draft, f"{root}/{name}.wav")
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files without a mark of success are written again by the next try."""


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WaveformSource)


def read_files(spark: SparkSession, path: str, block: int = 1024, part_bytes: int = 32 << 20) -> DataFrame:
    register(spark)
    return spark.read.format(WaveformSource.name()).option("path", path).option("block", block).option("part_bytes", part_bytes).load()


def write_files(rows: DataFrame, path: str) -> None:
    """``rows``: name, rate_hz, channels, width (bytes per sample) and pcm."""
    register(rows.sparkSession)
    rows.write.format(WaveformSource.name()).option("path", path).mode("append").save()
