"""Prefix trie of conversations: which openings are shared, by how many, and what sharing them saves.

A node is a distinct sequence of first turns. Turns are compared by the MD5 of role and text, so a conversation is a
string of 16-byte digests. The conversations are sorted by these strings over range partitions (equal ones by id, so
that thousands of copies are dealt out too). Each partition then runs a union-find over its sorted neighbours:

* An edge joins two neighbours and has the number of turns that they share. Edges are taken in descending order of it.
* A component climbs, turn by turn, to the depth of the edge; every step closes a node without a branch. Where two
  components meet, they become one: that is a branching node.
* What lies on the path of a partition's first or last conversation may go on in the next partition and stays open: the
  partition's forest is contracted to these two paths, each node with the sums of what has been closed below it.

The contracted paths of ``MERGED`` partitions in a row are neighbours again and run through the same union-find, until one group is
left. So no task holds more than a partition, or two paths of each of ``MERGED`` partitions.

Results in special cases: a null role or text is empty; a null turn comes first; turns with one number go by
their digest; rows that repeat a turn are turns of their own; rows with a null id belong to no conversation; an empty
table has no nodes, not even a root; extra columns are not read. The digests of one conversation fit in a task.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlith.llm.frames import stored
from sensorlith.session import work_path

DIGEST = 16
PART_BYTES = 16 << 20
MERGED = 64
_WORD = r"[^\x20\x09-\x0D]+"
_ROOT = bytes(DIGEST)
_OUT = "kind int, part long, side int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path binary, words binary, held binary, ends string"
_NODE, _PATH, _ENDS, _OPEN = range(4)
NOBODY = np.iinfo(np.int64).max


def turns_in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): digest and number of words of each conversation's turns, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(_WORD)).cast("long")
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), words.alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def with_openings(convs: DataFrame, source: Column, length: Column, most: int) -> DataFrame:
    """The conversations with their first ``length`` turns (at most ``most``) replaced by those of the conversation ``source``: all it has if
    fewer, none if there is none."""
    rows = convs.withColumn("source", source).withColumn("h", length.cast("int"))
    first = convs.select(F.col("conv_id").alias("source"), F.slice("turns", 1, most).alias("opening"))
    none = F.array().cast("array<struct<digest:string,words:bigint>>")
    opening = F.coalesce(F.slice(F.col("opening"), F.lit(1), F.col("h")), none)
    rest = F.slice(F.col("turns"), F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.join(first, "source", "left").select("conv_id", F.concat(opening, rest).alias("turns"))


@dataclass
class Item:
    """A sorted path: a conversation, or a contracted path with what is held at its nodes (conversations, smallest
    id, children, leaves, saved tokens of what was closed there)."""

    path: bytes
    words: np.ndarray
    conv_id: int | None = None
    held: np.ndarray | None = None

    @property
    def depth(self) -> int:
        return len(self.path) // DIGEST

    def node_ids(self) -> list[bytes]:
        """An id of each node on the path, the root first."""
        out = [_ROOT]
        for d in range(self.depth):
            out.append(hashlib.md5(out[-1] + self.path[d * DIGEST : (d + 1) * DIGEST]).digest())
        return out


def shared_turns(a: Item, b: Item) -> int:
    least = min(a.depth, b.depth)
    if a.path[: least * DIGEST] == b.path[: least * DIGEST]:
        return least
    x, y = (np.frombuffer(i.path, "V16", least) for i in (a, b))
    return int(np.argmax(x != y))


@dataclass
class Component:
    """Neighbours that share ``top`` turns; the sums are of all that is closed below that node, or ends at it."""

    top: int
    item: int
    first: bool
    last: bool
    n_convs: int = 0
    conv_id: int = NOBODY
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    rows: list[int] = field(default_factory=list)  # closed nodes right below
    ends: deque[int] = field(default_factory=deque)
    contracted: list[int] = field(default_factory=list)

    def add(self, n_convs: int, conv_id: int, n_children: int, n_leaves: int, saved: int) -> None:
        self.n_convs += n_convs
        self.conv_id = min(self.conv_id, conv_id)
        self.n_children += n_children
        self.n_leaves += n_leaves
        self.saved += saved

    def sums(self) -> tuple[int, int, int, int, int]:
        return self.n_convs, self.conv_id, self.n_children, self.n_leaves, self.saved


class Forest:
    """The union-find over one partition's sorted paths. ``whole``: there are no other partitions, nothing stays open."""

    def __init__(self, items: list[Item], whole: bool, named: bool) -> None:
        self.items, self.whole = items, whole
        last = len(items) - 1
        self.ids = {i: x.node_ids() for i, x in enumerate(items) if named or i in (0, last)}
        self.named = named
        self.nodes: list[list] = []
        self.ends: list[tuple[bytes, deque[int]]] = []
        self.left, self.right = (np.zeros((items[i].depth + 1, 5), np.int64) for i in (0, last))
        self.left[:, 1] = self.right[:, 1] = NOBODY
        self.parent = list(range(len(items)))
        self.of = [self._alone(i) for i in range(len(items))]
        shared = np.fromiter((shared_turns(a, b) for a, b in zip(items, items[1:])), np.int64, last)
        for edge in np.argsort(-shared, kind="stable").tolist():
            self._join(self._root(edge), self._root(edge + 1), int(shared[edge]))
        top = self.of[self._root(0)]
        while top.top > 0:
            self._climb(top)
        self._climb(top)

    def _alone(self, i: int) -> Component:
        item = self.items[i]
        c = Component(item.depth, i, i == 0, i == len(self.items) - 1)
        if item.conv_id is not None:
            c.add(1, item.conv_id, 0, 0, 0)
            c.ends.append(item.conv_id)
        if item.held is not None:
            c.contracted = [i]
            c.add(*item.held[item.depth].tolist())
        return c

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _join(self, a: int, b: int, depth: int) -> None:
        """``a`` lies before ``b``: the members that end at their common node stay in order."""
        x, y = self.of[a], self.of[b]
        for c in (x, y):
            while c.top > depth:
                self._climb(c)
        x.add(*y.sums())
        x.first, x.last = x.first or y.first, x.last or y.last
        for name in ("rows", "contracted"):
            few, many = sorted((getattr(x, name), getattr(y, name)), key=len)
            many.extend(few)
            setattr(x, name, many)
        if len(x.ends) < len(y.ends):
            y.ends.extendleft(reversed(x.ends))
            x.ends = y.ends
        else:
            x.ends.extend(y.ends)
        self.parent[b] = a

    def _climb(self, c: Component) -> None:
        """Close the node at the top, or leave it open, and go on at its parent."""
        d = c.top
        if (c.first or c.last) and not self.whole:
            (self.left if c.first else self.right)[d] = c.sums()
            at = self.ids[0 if c.first else len(self.items) - 1][d]
            for r in c.rows:
                self.nodes[r][1] = at
            if c.ends:
                self.ends.append((at, c.ends))
            c.n_convs, c.conv_id, c.n_children, c.n_leaves, c.saved, c.rows = 0, NOBODY, 0, 0, 0, []
        else:
            if d:
                c.saved += (c.n_convs - 1) * int(self.items[c.item].words[d - 1])
            c.n_leaves = c.n_leaves if c.n_children else 1
            for r in c.rows:
                self.nodes[r][3] = c.conv_id
            ends = None if self.named else hashlib.sha256(",".join(map(str, c.ends)).encode()).hexdigest()
            self.nodes.append([self.ids[c.item][d] if self.named else None, None, c.conv_id, None, d, c.n_convs, c.n_children, c.n_leaves, c.saved, ends])
            c.rows, c.n_children = [len(self.nodes) - 1], 1
        c.ends, c.top = deque(), d - 1
        if d:
            for i in c.contracted:
                c.add(*self.items[i].held[d - 1].tolist())

    def paths(self) -> list[tuple[int, Item]]:
        """The contracted forest: the first path, and the last one where it is another."""
        out = [(0, Item(self.items[0].path, self.items[0].words, None, self.left))]
        if self.items[-1].path != self.items[0].path:
            out.append((1, Item(self.items[-1].path, self.items[-1].words, None, self.right)))
        return out

    def table(self, part: int) -> pa.Table:
        kind = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("side", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("path", pa.binary()), ("words", pa.binary()), ("held", pa.binary()), ("ends", pa.string())])
        names = ("node", "parent", "conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        columns = dict(zip(names, zip(*self.nodes))) if self.nodes else {}
        blank = len(self.nodes)
        found = [pa.table({f.name: pa.array(columns.get(f.name, {"kind": [_NODE] * blank, "part": [part] * blank}.get(f.name, [None] * blank)), f.type) for f in kind})]
        if not self.whole:
            rest = [{"kind": _PATH, "part": part, "side": side, "path": x.path, "words": x.words.astype(np.int64).tobytes(), "held": x.held.tobytes()} for side, x in self.paths()]
            rest += [{"kind": _ENDS, "part": part, "node": at, "ends": ",".join(map(str, ids))} for at, ids in self.ends]
            rest += [{"kind": _OPEN, "part": part, "node": at} for at in {r[1] for r in self.nodes} - {None}]
            found.append(pa.Table.from_pylist(rest, kind))
        return pa.concat_tables(found)


def _contracted(paths: pa.Table) -> list[Item]:
    rows = sorted(paths.select(["part", "side", "path", "words", "held"]).to_pylist(), key=lambda r: (r["part"], r["side"]))
    return [Item(r["path"], np.frombuffer(r["words"], np.int64), None, np.frombuffer(r["held"], np.int64).reshape(-1, 5)) for r in rows]


def _merging(whole: bool) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    def merge(group: tuple[pa.Scalar, ...], paths: pa.Table) -> pa.Table:
        return Forest(_contracted(paths), whole, named=True).table(group[0].as_py())

    return merge


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = work_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(_OUT).parquet(path)


def _streamed_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of members in several partitions: their ids come in order, and are hashed piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"node": pa.array([node] if node is not None else [], pa.binary()), "digest": pa.array([state.hexdigest()] if node is not None else [], pa.string())})

        for batch in batches:
            for at, text in zip(batch["node"].to_pylist(), batch["ends"].to_pylist()):
                if at != node:
                    yield done()
                    node, state = at, hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
        yield done()

    return ends.select("node", "part", "ends").repartition("node").sortWithinPartitions("node", "part").mapInArrow(run, "node binary, digest string")


def prefix_trie(convs: DataFrame, part_bytes: int = PART_BYTES, merged: int = MERGED) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, turns: digest and words): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (words of the subtree that members beyond the first repeat) and
    ends_sha256 (of the ids of the conversations that end at the node, joined by commas)."""
    spark = convs.sparkSession
    path = work_path(spark, "conversations")
    convs.select("conv_id", F.unhex(F.array_join(F.col("turns")["digest"], "")).alias("path"), F.col("turns")["words"].alias("words")).write.parquet(path)
    rows = spark.read.parquet(path)
    size = rows.agg(F.sum(F.length("path") + 24)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))

    def first_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = []
        for batch in batches:
            columns = (batch["path"].to_pylist(), batch["words"].to_pylist(), batch["conv_id"].to_pylist())
            items += [Item(p, np.array(w, np.int64), i) for p, w, i in zip(*columns)]
        if items:
            yield from Forest(items, whole=False, named=False).table(TaskContext.get().partitionId()).to_batches(max_chunksize=50_000)

    dealt = rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    rounds = [_written(dealt.mapInArrow(first_forests, _OUT), "trie")]
    parts = max(parts, rounds[0].where(f"kind = {_PATH}").agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // merged)
        merge = _merging(whole=parts == 1)
        groups = rounds[-1].where(f"kind = {_PATH}").withColumn("group", F.floor(F.col("part") / merged)).drop("kind")
        rounds.append(_written(groups.groupBy("group").applyInArrow(merge, _OUT), "trie"))
    nodes = [r.where(f"kind = {_NODE}") for r in rounds]
    upper = nodes[1]
    for n in nodes[2:]:
        upper = upper.unionByName(n)
    digests = stored(_streamed_digests(rounds[0].where(f"kind = {_ENDS}")), "ends")
    out = None
    for at, (r, n) in enumerate(zip(rounds, nodes)):
        # a partition's open nodes with their smallest member: as many rows as there are open paths, in each partition
        opened = r.where(f"kind = {_OPEN}").select("part", F.col("node").alias("parent")).join(upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("found")), "parent")
        below = n.where("parent IS NOT NULL").drop("parent_conv_id").join(opened, ["part", "parent"]).withColumnRenamed("found", "parent_conv_id")
        n = n.where("parent IS NULL").unionByName(below)
        if at:
            n = n.join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())))
        n = n.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        out = n if out is None else out.unionByName(n)
    return out
