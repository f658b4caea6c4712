"""Many text files: tasks write them under names of their own, list their own folders and read stretches of files.

Spark's writer makes a folder for each value that is to be in a path, and the driver renames them one by one; its reader lists all files
at the driver and counts each as four megabytes. Both take the longest where each of a million keys has a file of its own.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlith.session import ship

#: folders that files are dealt out to by their names
FOLDERS = 64
#: tasks that read, for each core; bytes of a file that are read in one go
READ_TASKS, PART_BYTES = 4, 32 << 20
#: bytes that are read, and lines that are handed on, at once
BLOCK_BYTES, BATCH_LINES = 4 << 20, 1 << 16
#: what a path shows in another form, as Spark's file paths do
_QUOTED = re.compile(r'[ "%<>\\^`{|}\[\]#?\x00-\x1f]')


def write_lines(rows: DataFrame, path: str, header: str | None = None) -> None:
    """Rows (file, line) as files of these names, without a slash, in ``FOLDERS`` folders below ``path``.

    A file gets its name when it is whole, so a lost task leaves no half file under a name. A file is written as its rows come."""
    spark = rows.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        made: set[str] = set()
        name = out = draft = final = None
        count = 0

        def close() -> None:
            if out is not None:
                out.close()
                store.move(draft, final)

        for batch in batches:
            names, lines = batch["file"].to_pylist(), batch["line"].to_pylist()
            at = 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if names[at] != name:
                    close()
                    name, count = names[at], count + 1
                    folder = f"{root}/{zlib.crc32(name.encode()) % FOLDERS:02d}"
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    draft, final = f"{folder}/_{uuid.uuid4().hex}", f"{folder}/{name}"
                    out = store.open_output_stream(draft)
                    if header is not None:
                        out.write(f"{header}\n".encode())
                out.write("".join(f"{x}\n" for x in lines[at:end]).encode())
                at = end
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([count], pa.int64())})

    dealt = rows.select("file", "line").repartition("file").sortWithinPartitions("file")
    dealt.mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()


def _shown(info: fs.FileInfo) -> bool:
    return not info.base_name.startswith(("_", "."))


def _below(store: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
    """The files below a folder, without hidden ones."""
    for info in store.get_file_info(fs.FileSelector(folder)):
        if _shown(info):
            if info.type == fs.FileType.Directory:
                yield from _below(store, info.path)
            elif info.type == fs.FileType.File:
                yield info


def read_lines(spark: SparkSession, path: str, pattern: str, glob: str = "*", header: bool = False) -> DataFrame:
    """The lines that are not blank of the files below a folder, or of one file, whose path matches ``pattern``, and its named groups; with
    ``header`` without the first line of each file. The driver lists the upper folders only."""
    named = re.compile(pattern)
    groups = list(named.groupindex)
    ship(spark)
    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(root)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    units = [found]
    while 0 < len(units) < FOLDERS and any(u.type == fs.FileType.Directory for u in units):
        units = [x for u in units for x in ((i for i in store.get_file_info(fs.FileSelector(u.path)) if _shown(i)) if u.type == fs.FileType.Directory else [u])]
    prefix = path[: path.index(root)] if root in path else ""
    told = pa.table({"unit": pa.array([u.path for u in units], pa.string())})

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for unit in batch["unit"].to_pylist():
                info = store.get_file_info(unit)
                out: list[tuple[str, int, int]] = []
                for file in _below(store, unit) if info.type == fs.FileType.Directory else [info]:
                    if fnmatchcase(file.base_name, glob):
                        out += [(file.path, at, min(at + PART_BYTES, file.size)) for at in range(0, file.size, PART_BYTES)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))] if out else [pa.array([], k) for k in (pa.string(), pa.int64(), pa.int64())], ["path", "at", "upto"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        said: list[tuple[str, ...]] = []
        counts: list[int] = []
        waiting: list[bytes] = []

        def flush() -> pa.RecordBatch:
            at = pa.array([k for k, n in enumerate(counts) for _ in range(n)], pa.int32())
            columns = [pa.DictionaryArray.from_arrays(at, pa.array([x[g] for x in said], pa.string())).dictionary_decode() for g in range(len(groups))]
            batch = pa.RecordBatch.from_arrays([*columns, pa.array([x.decode("utf-8", "replace") for x in waiting], pa.string())], [*groups, "line"])
            for x in (said, counts, waiting):
                x.clear()
            return batch

        for batch in batches:
            for file, at, upto in zip(*(batch[c].to_pylist() for c in ("path", "at", "upto"))):
                found = named.search(prefix + _QUOTED.sub(lambda m: f"%{ord(m[0]):02X}", file))
                if found is None:
                    continue
                skip = header and at == 0
                for lines in _lines(store, file, at, upto):
                    lines = [x for x in lines if x.strip()]
                    if skip and lines:
                        lines, skip = lines[1:], False
                    said.append(tuple(found[g] for g in groups))
                    counts.append(len(lines))
                    waiting += lines
                    if len(waiting) >= BATCH_LINES:
                        yield flush()
        if waiting:
            yield flush()

    tasks = READ_TASKS * spark.sparkContext.defaultParallelism
    listed = spark.createDataFrame(told, "unit string").repartition(min(tasks, max(1, len(units)))).mapInArrow(parts, "path string, at long, upto long")
    return listed.repartition(tasks).mapInArrow(read, ", ".join(f"{n} string" for n in [*groups, "line"]))


def _lines(store: fs.FileSystem, file: str, at: int, upto: int) -> Iterator[list[bytes]]:
    """The lines that begin in a stretch of a file, some at a time."""
    with store.open_input_file(file) as source:
        source.seek(max(0, at - 1))
        rest, place, inside = b"", max(0, at - 1), at == 0
        while block := source.read(min(BLOCK_BYTES, max(upto - place, 1 << 16))):
            begin = place - len(rest)
            place += len(block)
            rest += block
            if not inside:  # the line that the stretch before began
                end = rest.find(b"\n")
                if end < 0:
                    rest = b""
                    if place >= upto:
                        return
                    continue
                begin, rest, inside = begin + end + 1, rest[end + 1 :], True
            if place >= upto:  # the last line may go on behind the stretch
                if begin >= upto:
                    return
                end = rest.find(b"\n", upto - 1 - begin)
                if end >= 0:
                    yield rest[: end + 1].splitlines()
                    return
            elif (end := rest.rfind(b"\n")) >= 0:
                yield rest[: end + 1].splitlines()
                rest = rest[end + 1 :]
        if inside and rest:
            yield rest.splitlines()
