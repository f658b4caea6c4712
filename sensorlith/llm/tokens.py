"""Token ids of documents in wavelet-matrix shards (see ``wavelet``).

Documents are dealt out in ranges of ids; a task encodes its range in order and writes a file whenever it has
``shard_tokens`` ids. Every file has a name of its own for each attempt of a task; the list of files that the finished
tasks return is written as a table and says which files count, so lost executors and repeated tasks do no harm.

Results in special cases: null and empty texts have the end id alone; null ids come last; rows that repeat an id
stand next to each other, by a hash of their text; extra columns are not read; an empty table writes no file.
Files go to a folder that ``pyarrow.fs`` can open: a shared mount or an object store.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlith.llm.chunks import _NO_ID, id_array
from sensorlith.llm.frames import stored
from sensorlith.llm.wavelet import Shard, build
from sensorlith.session import work_path

END_ID = 1
SHARD_TOKENS = 2 << 20
CACHED_WORDS = 400_000

#: words of these characters are split and encoded the same way with and without their surroundings
_PLAIN = re.compile(r"[a-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_characters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def drops_space(spec: dict) -> bool:
    """Whether a tokenizer drops white space and lower-cases, so that words can be encoded one by one."""
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = (split.get("pattern") or {}).get("Regex", "")
    return steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") is True and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Encoder:
    """Ids of texts as packed little-endian numbers. Where the tokenizer drops white space, a bounded table keeps
    the ids of words and their parts, so that common words are encoded once in a worker."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word = drops_space(json.loads(spec))
        self.model, self.shown = self.tokenizer.model, _byte_characters()
        self.words: dict[str, bytes] = _Table(self._word)
        self.parts: dict[str, bytes] = _Table(self._part)

    def __call__(self, text: str) -> bytes:
        if not self.by_word or "<|" in text:  # special tokens are looked for in the text as it stands
            return self._whole(text)
        try:
            text.encode("latin-1")
            text = text.lower()  # one letter for one, and in normal form: as the tokenizer does it
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))

    def forget(self) -> None:
        """Free the tables: a worker that has encoded runs other operators next."""
        self.words.clear()
        self.parts.clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(word)))
        return self._whole(word) if word else b""

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
        return np.array([t.id for t in self.model.tokenize(shown)], self.kind).tobytes()


class _Table(dict):
    """Values by key, made when first asked for; starts anew when full."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[key] = self.make(key)
        return value


@lru_cache(maxsize=1)
def _encoder(spec: str) -> Encoder:
    """One for each worker: workers are used again by later tasks."""
    return Encoder(spec)


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all texts, in ascending order of ids, and write them; (part, number, path, documents, tokens, bytes) of each file.

    ``tokenizer`` is the path of a tokenizers file at the driver."""
    spark = docs.sparkSession
    folder = folder or work_path(spark, "tokens")
    with open(tokenizer, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = _encoder(spec.value), TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        end = np.array([end_id], encode.kind).tobytes()
        part, number = context.partitionId(), 0
        ids: list[int] = []
        codes: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            first = np.concatenate([[0], np.cumsum([len(c) // encode.kind.itemsize for c in codes])])
            data = build(np.frombuffer(b"".join(codes), encode.kind), np.array(ids, np.int64), first)
            path = f"{root}/{part:06d}-{number:06d}-{context.taskAttemptId()}.tokens"
            with store.open_output_stream(path) as out:
                out.write(data)
            row = {"part": part, "number": number, "path": path, "documents": len(ids), "tokens": int(first[-1]), "bytes": len(data)}
            number, size = number + 1, 0
            ids.clear()
            codes.clear()
            return pa.RecordBatch.from_pylist([row])

        try:
            for batch in batches:
                for i, text in zip(batch["doc_id"].fill_null(_NO_ID).to_pylist(), batch["text"]):
                    code = encode(text.as_py() or "") + end
                    ids.append(i)
                    codes.append(code)
                    size += len(code) // encode.kind.itemsize
                    if size >= shard_tokens:
                        yield flush()
            if ids:
                yield flush()
        finally:
            encode.forget()

    return stored(rows.mapInArrow(run, "part long, number long, path string, documents long, tokens long, bytes long"), "shards")


def read_documents(shards: DataFrame, folder_of: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 for each document in the files.

    ``folder_of``: any address in the store of the files, which says how to open them."""
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    in_part = Window.partitionBy("part").orderBy("number")
    files = shards.withColumn("first", F.sum("tokens").over(in_part) - F.col("tokens")).join(parts, "part").select("path", (F.col("before") + F.col("first")).alias("start"))
    files = files.repartition(max(1, shards.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder_of)
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                with store.open_input_file(path) as file:
                    shard = Shard(file)
                    ids, first, doc_ids = shard.all().astype("<u4"), shard.first, shard.doc_ids
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [id_array(doc_ids), pa.array(first[:-1] + start, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

