"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors of one label link when their cosine reaches a threshold. Every pair of tiles that can hold a link is compared:

1. Equal vectors of a label are one class and are compared once.
2. A rotation to principal components, fitted on a bounded sample, puts the dimensions with most spread first. It only orders the
   work: any rotation gives the same links.
3. Classes are sorted by label and the cells of their first components, and cut into tiles of bounded size. A tile knows the range of
   its vectors in the leading components. Tiles meet when these ranges leave room for a link.
4. Two tiles accumulate products of the leading components first. What the rest can add is at most the product of the
   suffix norms; a pair whose bound cannot reach the threshold is dropped, and a tile without pairs is done. What stays is decided by the
   cosine of the original vectors in double precision.
5. A pair of tiles gives the number of links of each class and a spanning forest of the links, so a group of thousands
   of near copies brings no more rows than it has members for each tile that they meet.

Results in special cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or a
null id, link with nothing; vectors of different dimension never link; rows that repeat an id are vectors of
their own; a row with a null id has no component; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlith.llm.components import components
from sensorlith.llm.frames import bounded_sample, discard, stored

#: a tile's vectors take about so many bytes
TILE_BYTES = 1 << 20
#: components in a tile's ranges, and products taken before the first test
LEADING = 8
SAMPLE_BYTES = 4 << 20
PARTNERS = 8
STRIP = 512
SLACK = 1e-9
_TILE = "tile long, label string, width int, low array<double>, high array<double>, ids binary, sizes binary, vectors binary"


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled by powers of two first, so that squares neither overflow nor vanish."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def principal_axes(x: np.ndarray) -> np.ndarray:
    """Columns are directions, by falling mean square of the rows' components."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def reach(threshold: float) -> float:
    """The largest distance of two unit vectors whose cosine reaches the threshold."""
    return float(np.sqrt(max(2 - 2 * threshold, 0)))


class Tile:
    def __init__(self, ids: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, axes: np.ndarray | None) -> None:
        self.ids, self.sizes = ids, sizes
        self.unit = unit(vectors)
        self.turned = self.unit @ axes if axes is not None else self.unit
        square = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        #: norm of the components from each on
        self.rest = np.sqrt(np.column_stack([square, np.zeros(len(ids))]))


def links_between(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in ``a`` and ``b`` of all pairs whose cosine reaches the threshold; in a tile with itself each pair once."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start in range(0, len(a.ids), STRIP):
        rows, columns = np.arange(start, min(start + STRIP, len(a.ids))), np.arange(start if a is b else 0, len(b.ids))
        found.append(_strip(a, b, rows, columns, threshold))
    i, j = (np.concatenate(x) for x in zip(*found))
    return (i[i < j], j[i < j]) if a is b else (i, j)


def _strip(a: Tile, b: Tile, rows: np.ndarray, columns: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Products of more and more leading components, of the rows and columns that still have a pair in reach."""
    width, at, step = a.turned.shape[1], 0, LEADING
    product = np.zeros((len(rows), len(columns)))
    while True:
        end = min(at + step, width)
        product += a.turned[rows, at:end] @ b.turned[columns, at:end].T
        alive = product + a.rest[rows, end][:, None] * b.rest[columns, end] >= threshold - SLACK
        keep_rows, keep_columns = alive.any(axis=1), alive.any(axis=0)
        if not keep_rows.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, columns = rows[keep_rows], columns[keep_columns]
        product, alive = product[keep_rows][:, keep_columns], alive[keep_rows][:, keep_columns]
        at, step = end, 2 * step
        if at == width or alive.mean() < 0.02:
            break
    i, j = np.nonzero(alive)
    if at == width:  # the original components decide wherever rounding could
        sure = product[i, j] > threshold + SLACK
        i, j = rows[i], columns[j]
        sure[~sure] = _cosines(a, b, i[~sure], j[~sure]) >= threshold
        return i[sure], j[sure]
    i, j = rows[i], columns[j]
    linked = _cosines(a, b, i, j) >= threshold
    return i[linked], j[linked]


def _cosines(a: Tile, b: Tile, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for k in range(0, len(i), 1 << 14):
        out[k : k + (1 << 14)] = np.einsum("ij,ij->i", a.unit[i[k : k + (1 << 14)]], b.unit[j[k : k + (1 << 14)]])
    return out


def forest(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the smallest that the links reach."""
    low = np.arange(size)
    while True:
        x, y = low[i], low[j]
        apart = x != y
        if not apart.any():
            return low
        np.minimum.at(low, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (low[low] != low).any():
            low = low[low]


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows by fingerprint, and the distinct vectors of each label."""
    key = [F.col("label").cast("string").alias("label"), F.xxhash64("embedding").alias("one"), F.xxhash64(F.lit(1), "embedding").alias("two")]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("takes_part", usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    members = rows.select("vec_id", *key, "takes_part")
    part = rows.where("takes_part").select("vec_id", *key, "embedding")
    classes = part.groupBy("label", "one", "two").agg(F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding"))
    return members, stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")


def _axes(classes: DataFrame) -> np.ndarray | None:
    """Principal components of a bounded sample of the vectors of the most frequent dimension."""
    widths = classes.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    if widths is None:
        return None
    chosen = bounded_sample(classes.where(F.size("embedding") == widths.width).select("id", "one"), "one", max(widths.width, SAMPLE_BYTES // (8 * widths.width)))
    rows = classes.join(F.broadcast(chosen.select("id")), "id").orderBy("id").select("embedding").collect()
    return principal_axes(unit(np.array([r.embedding for r in rows], float)))


def _tiles(classes: DataFrame, axes: np.ndarray | None, threshold: float, tile_bytes: int) -> DataFrame:
    """Tiles of neighbours: classes in the order of label and cells of the leading components."""
    spark = classes.sparkSession
    cell = max(reach(threshold), 1e-3)

    def turned(x: np.ndarray) -> np.ndarray:
        x = unit(x)
        return x @ axes if axes is not None and len(axes) == x.shape[1] else x

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.diff(batch["embedding"].offsets.to_numpy())
            for width in np.unique(widths).tolist():
                rows = batch.filter(pa.array(widths == width))
                x = rows["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                lead = turned(x)[:, :3]
                lead = np.column_stack([lead, np.zeros((len(lead), 3 - lead.shape[1]))])
                cells = np.floor(lead[:, :2] / cell).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows["label"], pa.array(np.full(len(x), width, np.int32)), pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(lead[:, 2]), rows["id"], rows["size"], pa.array([v.tobytes() for v in x], pa.binary())], ["label", "width", "first", "second", "third", "id", "size", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_, of = TaskContext.get().partitionId() << 32, [], None

        def done() -> pa.RecordBatch:
            nonlocal number
            x = np.frombuffer(b"".join(r["vector"] for r in open_)).reshape(len(open_), -1)
            lead = turned(x)[:, :LEADING]
            row = {"tile": number, "label": of[0], "width": of[1], "low": lead.min(axis=0).tolist(), "high": lead.max(axis=0).tolist(), "ids": np.array([r["id"] for r in open_], np.int64).tobytes(), "sizes": np.array([r["size"] for r in open_], np.int64).tobytes(), "vectors": x.tobytes()}
            number += 1
            return pa.RecordBatch.from_pylist([row], pa.schema([("tile", pa.int64()), ("label", pa.string()), ("width", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), *((k, pa.binary()) for k in ("ids", "sizes", "vectors"))]))

        for batch in batches:
            for r in batch.to_pylist():
                if open_ and ((r["label"], r["width"]) != of or len(open_) * 8 * of[1] >= tile_bytes):
                    yield done()
                    open_ = []
                of = r["label"], r["width"]
                open_.append(r)
        if open_:
            yield done()

    placed = classes.select("label", "id", "size", "embedding").mapInArrow(place, "label string, width int, first int, second int, third double, id long, size long, vector binary")
    placed = stored(placed, "placed")
    size = placed.agg(F.sum(F.col("width").cast("long") * 8)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (32 * tile_bytes)))
    order = ["label", "width", "first", "second", "third", "id"]
    tiles = stored(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, _TILE), "tiles")
    discard(placed)
    return tiles


def _meeting(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of tiles, each with itself too, whose ranges in the leading components are near enough for a link.
    Tiles meet in the cells of the first component; both ends of a link are in one cell or in neighbouring ones."""
    cell = max(reach(threshold), 1e-3)
    number = lambda x: F.floor(F.col(x)[0] / cell)
    heads = tiles.select("tile", "label", "width", "low", "high")
    left = heads.select(F.col("tile").alias("a"), "label", "width", F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(number("low") - 1, number("high") + 1)).alias("cell"))
    right = heads.select(F.col("tile").alias("b"), "label", "width", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(number("low"), number("high"))).alias("cell"))
    one, two = (F.transform(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y")), lambda z: F.greatest(z["x"] - z["y"], F.lit(0.0))) for x, y in (("low_b", "high_a"), ("low_a", "high_b")))
    apart = F.aggregate(F.zip_with(one, two, lambda x, y: (x + y) * (x + y)), F.lit(0.0), lambda s, x: s + x)
    pairs = left.join(right, ["label", "width", "cell"]).where("a <= b").where(apart <= reach(threshold) ** 2 + SLACK)
    return pairs.select("a", "b").distinct()


def _compared(tiles: DataFrame, axes: np.ndarray | None, threshold: float) -> DataFrame:
    """(id, other, links): with ``other`` null, links of a class that one pair of tiles found; else an edge of a spanning forest."""
    pairs = stored(_meeting(tiles, threshold), "tile-pairs")
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / PARTNERS)).alias("share"))
    content = ["width", "ids", "sizes", "vectors"]
    partners = dealt.join(tiles.select(F.col("tile").alias("b"), *content), "b").select("a", "share", F.lit(1).alias("role"), "b", *content)
    centres = dealt.select("a", "share").distinct().join(tiles.select(F.col("tile").alias("a"), *content), "a").select("a", "share", F.lit(0).alias("role"), F.col("a").alias("b"), *content)
    sent = tiles.sparkSession.sparkContext.broadcast(axes)

    def tile_of(r: dict) -> Tile:
        axes = sent.value if sent.value is not None and len(sent.value) == r["width"] else None
        return Tile(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, r["width"]), axes)

    def rows_of(ids: list[np.ndarray], others: list[np.ndarray | None], links: list[np.ndarray | None]) -> pa.RecordBatch:
        n = [len(x) for x in ids]
        none = [pa.nulls(k, pa.int64()) for k in n]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x, pa.int64()) if x is not None else none[k] for k, x in enumerate(c)]) for c in (ids, others, links)], ["id", "other", "links"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, at = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["role"] == 0:
                    centre, at = tile_of(r), r["a"]
                    continue
                other = centre if r["b"] == at else tile_of(r)
                i, j = links_between(centre, other, threshold)
                if not len(i):
                    continue
                n, m = len(centre.ids), len(other.ids)
                links_i, links_j = np.bincount(i, other.sizes[j], n).astype(np.int64), np.bincount(j, centre.sizes[i], m).astype(np.int64)
                ids = centre.ids if other is centre else np.concatenate([centre.ids, other.ids])
                low = forest(len(ids), i, j if other is centre else j + n)
                tied = np.flatnonzero(low != np.arange(len(low)))
                some_i, some_j = np.flatnonzero(links_i), np.flatnonzero(links_j)
                yield rows_of([centre.ids[some_i], other.ids[some_j], ids[tied]], [None, None, ids[low[tied]]], [links_i[some_i], links_j[some_j], None])

    rows = partners.unionByName(centres).repartition("a", "share").sortWithinPartitions("a", "share", "role", "b")
    return stored(rows.mapInArrow(compare, "id long, other long, links long"), "links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """vec_id, n_links (other rows of the same label with a cosine of at least ``threshold``), component_id (smallest vec_id that links
    reach) and kept (whether that is the row's own) for each row of ``vectors`` (vec_id, embedding, label)."""
    members, classes = _classes(vectors)
    axes = _axes(classes)
    tiles = _tiles(classes, axes, threshold, tile_bytes)
    found = _compared(tiles, axes, threshold)
    links = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    merged = stored(components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))), "merged")
    classes = classes.drop("embedding").join(links, "id", "left").join(merged, "id", "left").withColumn("component", F.coalesce("component", "id"))
    classes = stored(classes, "linked-classes")
    smallest = classes.groupBy("component").agg(F.min("smallest").alias("component_id"))
    known = classes.join(smallest, "component").select("label", "one", "two", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("takes_part"))
    rows = members.join(known, ["label", "one", "two", "takes_part"], "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
