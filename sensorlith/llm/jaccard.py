"""Jaccard self-join of documents on word shingles, by T-occurrence search with DivideSkip.

Two documents link when their sets of ``length``-word shingles have ``100 * |A & B| >= percent * |A | B|``.
Equal sets are one class and are represented once. What is left runs in three steps:

1. The sliced count-min sketch (see ``chunks``) says how many documents hold a shingle, never too few. A
   shingle of one document is an inverted list of length one and joins nothing. A document needs at least
   ``percent`` of its shingles in longer lists; the others are done.
2. A partner must share one of the ``n - T + 1`` rarest shingles of a document with ``n``, where ``T`` is the
   least overlap that links. Only these short lists are posted. In a few rounds each document is compared with one
   partner from another group that its lists propose, and groups that link are joined after each round. At last
   every pair of a list that still lies in two groups is taken, unless it was compared or the list's shingle comes too
   late in one of them to be the rarest that the two share. So a group of thousands of copies costs a few
   comparisons each, and no link between two groups is lost.
3. A cell holds a centre and up to ``CELL`` documents. There DivideSkip finds those with the required overlap: the
   short inverted lists over the documents are merged with a heap, the long ones are probed by binary search.

Results in special cases: null and empty texts have an empty set and link with nothing; a text of fewer words
than a shingle has its whole sequence as one; null ids have no component and link with nothing; rows that
repeat an id are documents of their own that carry the same id; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sensorlith.llm.chunks import _NO_ID, Chunk, id_array, levels, read_chunk, sketch_counts, slice_bits, write_chunks
from sensorlith.llm.components import components
from sensorlith.llm.frames import bucketed, discard, stored
from sensorlith.llm.words import Words, mix, shingles

CELL = 256
SHORT_LIST = 8
_SETS = "doc_id long, text_hash long, n long, fp1 long, fp2 long, kept binary, prefix binary, places binary"


def least_overlap(n: int | np.ndarray, m: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least ``i`` with ``100 i >= percent (n + m - i)``."""
    return -(-percent * (n + m) // (100 + percent))


def least_within(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of ``n`` with any set it links with: a part of it of ``percent``."""
    return -(-percent * n // 100)


class Sets:
    """Shingle sets of a chunk's documents, and the chunk's distinct shingles with their document counts."""

    def __init__(self, chunk: Chunk, length: int) -> None:
        self.ids, self.texts = chunk
        texts = self.texts
        self.owner, self.value = shingles(Words(texts, lower=True), length)
        self.n = np.bincount(self.owner, minlength=len(texts))
        self.distinct, self.counts = np.unique(self.value, return_counts=True)

    def fingerprints(self) -> list[np.ndarray]:
        """Two sums of mixed shingles: equal for equal sets."""
        out = []
        for salt in (1, 2):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.value + np.uint64(salt << 40)))])
            at = np.searchsorted(self.owner, np.arange(len(self.n) + 1))
            out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
        return out


def shingle_sets(docs: DataFrame, length: int, percent: int) -> DataFrame:
    """A row for each document. ``kept``: its sorted shingles that other documents may hold, ``prefix``: the rarest
    of them that a partner must share one of; both null where too few are left to link."""
    chunks = write_chunks(docs, in_buckets=True)
    bits = slice_bits(chunks)

    def keys(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        s = Sets(chunk, length)
        return s.distinct, s.counts

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Sets(read_chunk(left["docs"][0].as_py()) if left.num_rows else (np.zeros(0, np.int64), []), length)
        level = levels(right)[np.searchsorted(s.distinct, s.value)] if len(s.value) else np.zeros(0, np.uint8)
        order = np.lexsort((s.value, level, s.owner))
        shared = np.bincount(s.owner, level > 0, len(s.n)).astype(np.int64)
        least = least_within(s.n, percent)
        at = np.searchsorted(s.owner, np.arange(len(s.n) + 1))
        kept, prefix, places = [], [], []
        for i in range(len(s.n)):
            if not s.n[i] or shared[i] < least[i] or s.ids[i] == _NO_ID:
                for column in (kept, prefix, places):
                    column.append(None)
                continue
            a, b = at[i], at[i + 1]
            kept.append(s.value[a:b][level[a:b] > 0].tobytes())
            rare = order[a : a + s.n[i] - least[i] + 1]
            posted = np.flatnonzero(level[rare] > 0)
            prefix.append(s.value[rare[posted]].tobytes())
            places.append(posted.astype(np.int64).tobytes())
        one, two = s.fingerprints()
        text_hash = np.array([xxhash.xxh64_intdigest(t, 42) for t in s.texts], np.uint64).view(np.int64)
        return pa.table({"doc_id": id_array(s.ids), "text_hash": text_hash, "n": s.n.astype(np.int64), "fp1": one, "fp2": two, "kept": pa.array(kept, pa.binary()), "prefix": pa.array(prefix, pa.binary()), "places": pa.array(places, pa.binary())})

    counts = sketch_counts(chunks, keys, bits)
    sets = stored(chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(fill, _SETS), "sets")
    discard(chunks)
    return sets


def divide_skip(query: np.ndarray, members: list[np.ndarray], need: int, mu: float = 0.01) -> dict[int, int]:
    """Overlaps of the members that share at least ``need`` values with the query; all are sorted arrays.

    Of the inverted lists, the ``L`` longest are left for binary search: whoever has ``need`` values is at least
    ``need - L`` times in the others, which a heap merges."""
    if need <= 0 or not members or not len(query):
        return {}
    value = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    at = np.searchsorted(query, value)
    hit = (at < len(query)) & (query[np.minimum(at, len(query) - 1)] == value)
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    bounds = np.searchsorted(at, np.arange(len(query) + 1))
    length = np.diff(bounds)
    by_length = np.argsort(-length, kind="stable")
    longest = int(length.max(initial=0))
    skip = min(need - 1, int(need / (mu * math.log(longest + 1) + 1)))
    found: dict[int, int] = {}
    for member in heapq.merge(*(owner[bounds[k] : bounds[k + 1]].tolist() for k in by_length[skip:] if length[k])):
        found[member] = found.get(member, 0) + 1
    left = {m: c for m, c in found.items() if c >= need - skip}
    if left and skip:
        candidates = np.fromiter(left, np.int64, len(left))
        lists = np.sort(by_length[:skip])
        posted = at * len(members) + owner  # ascending: each list is a run of it, and is searched as such
        probe = (lists[:, None] * len(members) + candidates[None, :]).ravel()
        place = np.searchsorted(posted, probe)
        there = (place < len(posted)) & (posted[np.minimum(place, len(posted) - 1)] == probe)
        for m, c in zip(candidates.tolist(), there.reshape(len(lists), -1).sum(axis=0).tolist()):
            left[m] += c
    return {m: c for m, c in left.items() if c >= need}


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (id, centre) pairs that link. A centre's documents are dealt out to cells of about ``CELL``."""
    sized = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("k"))
    dealt = pairs.join(sized, "centre").select("centre", F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / CELL)).alias("cell"), "id")
    centres = dealt.select("centre", "cell").distinct().select("centre", "cell", F.col("centre").alias("id"), F.lit(0).alias("role"))
    rows = dealt.withColumn("role", F.lit(1)).unionByName(centres).join(sets.select("id", "n", "kept"), "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, query, members, n = None, None, [], []

        def done() -> list[tuple[int, int]]:
            if query is None or not members:
                return []
            sizes = [m for _, m in n]
            need = least_overlap(query[0], min(sizes), percent)
            found = divide_skip(query[1], members, need)
            return [(n[m][0], cell[0]) for m, c in found.items() if c >= least_overlap(query[0], sizes[m], percent)]

        out: list[tuple[int, int]] = []
        for batch in batches:
            for centre, number, i, size, kept, role in zip(*(batch[c].to_pylist() for c in ("centre", "cell", "id", "n", "kept", "role"))):
                if (centre, number) != cell:
                    out += done()
                    cell, query, members, n = (centre, number), None, [], []
                if role == 0:
                    query = (size, np.frombuffer(kept, np.uint64))
                else:
                    members.append(np.frombuffer(kept, np.uint64))
                    n.append((i, size))
            yield _pairs(out)
            out = []
        yield _pairs(done())

    dealt_out = rows.repartition("centre", "cell").sortWithinPartitions("centre", "cell", "role", "id")
    return dealt_out.mapInArrow(search, "id long, centre long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"id": pa.array([a for a, _ in rows], pa.int64()), "centre": pa.array([b for _, b in rows], pa.int64())})


def _near(n: Column, m: Column, percent: int) -> Column:
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (n > 0)


def _first_shared(percent: int) -> Column:
    """Whether a shared shingle may be the rarest that two linked sets share: from its place on, each set must
    still have the overlap that links. So late places in long lists, which any two copies of a text share, pair nothing."""
    least = F.ceil((F.col("n") + F.col("m")) * percent / F.lit(100 + percent))
    return (F.col("n") - F.col("place") >= least) & (F.col("m") - F.col("centre_place") >= least)


def representatives(sets: DataFrame) -> DataFrame:
    """One row for each set that may link, with its smallest doc_id, in buckets of the set's id. Equal sets hold the
    same ``kept``, ``prefix`` and ``places``: one of them leaves its task, and whole sets are dealt out only here."""
    rows = sets.where("prefix IS NOT NULL").select(F.xxhash64("fp1", "fp2", "n").alias("id"), "doc_id", F.struct("doc_id", "n", "kept", "prefix", "places").alias("row"))
    return bucketed(rows.groupBy("id").agg(F.min_by("row", "doc_id").alias("row")).select("id", "row.*"), "representatives", "id")


def linked_classes(reps: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the class representatives that link with another class."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x, np.int64) for x in batch["prefix"].to_pylist()]
            sizes = [len(x) for x in lists]
            yield pa.RecordBatch.from_pydict({
                "shingle": np.concatenate([np.zeros(0, np.int64), *lists]), "place": np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in batch["places"].to_pylist())]), "id": np.repeat(batch["id"].to_numpy(), sizes), "n": np.repeat(batch["n"].to_numpy(), sizes),
            })

    posted = reps.select("id", "n", "prefix", "places").mapInArrow(post, "shingle long, place long, id long, n long")
    lists = posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    posts = stored(posted.join(lists, "shingle"), "posts")
    parts, compared = reps.select("id", F.col("id").alias("part")), None
    for turn, propose in enumerate((_to_centre, _chained, _in_short_lists, _chained, _everyone)):
        if turn == 0:  # all are groups of their own, so that every list is open
            rows = posts.withColumn("part", F.col("id"))
        else:
            rows = posts.join(parts, "id")
            open_lists = rows.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("shingle")
            rows = stored(rows.join(open_lists, "shingle"), "open")
            discard(posts)
            posts = rows.drop("part")
        pairs = propose(rows, turn).where("part <> centre_part").where(_near(F.col("n"), F.col("m"), percent))
        if propose is _everyone:
            pairs = pairs.where(_first_shared(percent)).select("id", "centre").distinct()
        else:  # each document takes the partner that the most lists propose
            pairs = pairs.groupBy("id", "centre").agg(F.count(F.lit(1)).alias("shared"))
            pairs = pairs.groupBy("id").agg(F.max_by("centre", F.struct("shared", "centre")).alias("centre"))
        pairs = pairs.select("id", "centre", F.least("id", "centre").alias("low"), F.greatest("id", "centre").alias("high"))
        if compared is not None:
            pairs = pairs.join(compared, ["low", "high"], "left_anti")
        pairs = stored(pairs, "pairs")
        compared = pairs.select("low", "high") if compared is None else compared.unionByName(pairs.select("low", "high"))
        found = _verified(pairs, reps, percent)
        links = found.join(parts, "id").select(F.col("part").alias("a"), "centre").join(parts.select(F.col("id").alias("centre"), F.col("part").alias("b")), "centre")
        merged = components(links.select("a", "b")).select(F.col("id").alias("part"), "component")
        parts = stored(parts.join(merged, "part", "left").select("id", F.coalesce("component", "part").alias("part")), "parts")
    # components go by the smallest document id in the end
    named = reps.select("id", "doc_id").join(parts, "id")
    smallest = named.groupBy("part").agg(F.min("doc_id").alias("smallest"))
    named = stored(named.join(smallest, "part").select("doc_id", F.col("smallest").alias("component")), "linked")
    discard(posts)
    discard(reps)
    return named


def _other(rows: DataFrame) -> list[Column]:
    return [F.col("id").alias("centre"), F.col("n").alias("m"), F.col("part").alias("centre_part")]


def _to_centre(rows: DataFrame, turn: int) -> DataFrame:
    """Everyone in a list with the one that is in the most and longest lists for its size: the likeliest source of copies."""
    central = rows.groupBy("id").agg((F.sum("k") / F.max("n")).alias("central"))
    ranked = rows.join(central, "id")
    centre = ranked.groupBy("shingle").agg(F.max(F.struct("central", "id", "n", "part")).alias("c"))
    return rows.join(centre.select("shingle", F.col("c.id").alias("centre"), F.col("c.n").alias("m"), F.col("c.part").alias("centre_part")), "shingle")


def _in_short_lists(rows: DataFrame, turn: int) -> DataFrame:
    """All pairs of lists of at most ``SHORT_LIST`` documents."""
    short = rows.where(F.col("k") <= SHORT_LIST)
    return short.join(short.select("shingle", *_other(short)), "shingle")


def _chained(rows: DataFrame, turn: int) -> DataFrame:
    """In each list, the pairs where one group's documents end and the next one's begin, in an order that changes each turn."""
    order = Window.partitionBy("shingle").orderBy(F.xxhash64("part", F.lit(turn)), "part", F.xxhash64("id", F.lit(turn)), "id")
    return rows.withColumn("last", F.lag(F.struct(*_other(rows))).over(order)).select("shingle", "id", "n", "part", "last.*")


def _everyone(rows: DataFrame, turn: int) -> DataFrame:
    """All pairs of lists that still lie in several groups."""
    return rows.join(rows.select("shingle", F.col("place").alias("centre_place"), *_other(rows)), "shingle").where("id > centre")


def similar_documents(docs: DataFrame, length: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id (smallest id that links reach)
    and class_size for each row of ``docs``; an empty set is a class of its own."""
    sets = shingle_sets(docs, length, percent)
    reps = representatives(sets)
    wide, sets = sets, stored(sets.drop("kept", "prefix", "places"), "classes")
    discard(wide)
    linked = linked_classes(reps, percent)
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    classes = classes.join(linked.groupBy(F.col("doc_id").alias("class_id")).agg(F.min("component").alias("component")), "class_id", "left")
    rows = sets.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "n", "fp1", "fp2").join(classes, ["fp1", "fp2", "n"], "left")
    some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return rows.select(
        "doc_id", "text_hash", "n_shingles", F.when(some, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(some, F.coalesce("component", "class_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(some, F.col("class_size")).otherwise(F.lit(1).cast("long")).alias("class_size"),
    )


def keep_one_each(docs: DataFrame, length: int = 5, percent: int = 75) -> DataFrame:
    """One document of each component, of smallest id (if rows repeat that id, one of them), with the columns of
    ``docs``. Documents without shingles or without an id all stay."""
    found = similar_documents(docs.select("doc_id", "text"), length, percent).where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("component_id", "first")
    marks = found.select("doc_id", "text_hash", "component_id").distinct().join(first, "component_id")
    marks = marks.select("doc_id", "text_hash", F.struct("doc_id", "text_hash").eqNullSafe(F.col("first")).alias("wins"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = rows.join(marks, ["doc_id", "text_hash"], "left")
    number = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("doc_id"))
    return rows.withColumn("number", number).where("wins IS NULL OR (wins AND number = 1)").select("row.*")
