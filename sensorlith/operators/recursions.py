"""Recursive estimators per series, as Spark jobs that also cut long series into parts.

``run_scan``: the recursion's step is written as an element of an associative operation
(affine map, Gaussian filtering element, unit quaternion), and the first row of a series as
one that forgets what came before. Whole series are hashed over the tasks, sorted, and
streamed through in Arrow batches, so that a task holds one batch at a time and small
series share it. A series that is cut into parts is composed part by part, the parts in
order (one small row per part), and each part is then streamed again from what enters it.

State machines with few states have one too: a row is the table of what each state becomes (``table_compose``).

``run_fold``: for recursions without such a form. Parts run side by side from no state. A part that its
predecessor leaves in another state than it was entered with runs again, but only up to the rows at which both runs
are in the same state: from there on nothing changes. Recursions that forget meet after few rows, so the
second run is short and leaves the part as it was. Others repeat until nothing changes any more; the result is that of one pass in order,
to twelve digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlith.operators.series import PART, Series
from sensorlith.session import cut, written

Element = tuple[np.ndarray, ...]
BLOCK = 64


@dataclass(frozen=True)
class Scan:
    """``elements`` gives arrays with one leading entry per row.

    ``emit`` turns the composed ones into rows; it also gets the element that entered the part.
    """

    elements: Callable[[pd.DataFrame], Element]
    compose: Callable[[Element, Element], Element]
    identity: Element
    emit: Callable[[Element, pd.DataFrame, Element], pd.DataFrame]


def prefix(elements: Element, compose: Callable, identity: Element) -> Element:
    """Compositions of entries 0..i for every i, block-wise on arrays."""
    n = len(elements[0])
    if n <= 1:
        return elements
    length = min(BLOCK, n)
    blocks = -(-n // length)
    padded = []
    for e, one in zip(elements, identity):
        tail = np.broadcast_to(one, (blocks * length - n, *one.shape))
        padded.append(np.concatenate([e, tail]).reshape(blocks, length, *one.shape))
    running = [tuple(p[:, 0] for p in padded)]
    for j in range(1, length):
        running.append(compose(running[-1], tuple(p[:, j] for p in padded)))
    if blocks > 1:
        totals = prefix(running[-1], compose, identity)
        entry = tuple(np.concatenate([one[None], t[:-1]]) for one, t in zip(identity, totals))
        running = [compose(entry, r) for r in running]
    return tuple(np.stack(col, axis=1).reshape(blocks * length, *one.shape)[:n] for col, one in zip(zip(*running), identity))


def _flat(element: Element, row: int) -> list[float]:
    return np.concatenate([np.ravel(e[row]) for e in element]).tolist()


def _unflat(values: Sequence[float], identity: Element) -> Element:
    out, at, values = [], 0, np.asarray(values, dtype=float)
    for one in identity:
        out.append(values[at : at + one.size].reshape(1, *one.shape))
        at += one.size
    return tuple(out)


def tasks(df: DataFrame) -> int:
    """How many tasks Python work is dealt out to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def run_scan(s: Series, scan: Scan, schema: T.StructType) -> DataFrame:
    """``schema`` lists what ``emit`` returns, after the key columns."""
    order, keys = list(s.order), list(s.keys)
    out = T.StructType(_fields(s.df, keys) + schema.fields)
    names = [f.name for f in schema.fields]

    nothing = tuple(e[None] for e in scan.identity)

    def rows(pdf: pd.DataFrame, entering: Element) -> tuple[pd.DataFrame, Element]:
        composed = prefix(scan.elements(pdf), scan.compose, scan.identity)
        composed = scan.compose(tuple(np.broadcast_to(e, c.shape) for e, c in zip(entering, composed)), composed)
        emitted = scan.emit(composed, pdf, entering)
        for k in keys:
            if k not in emitted:
                emitted[k] = pdf[k].to_numpy()
        return emitted[[*keys, *names]], tuple(c[-1:] for c in composed)

    if not s.cut_up:

        def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = nothing
            for pdf in batches:
                if len(pdf):
                    emitted, state = rows(pdf.reset_index(drop=True), state)
                    yield emitted

        # The partition count is given, so that it is not merged down to the few tasks a small shuffle would get.
        return s.df.repartition(tasks(s.df), *keys).sortWithinPartitions(*keys, *order).mapInPandas(stream, out)

    # Parts follow each other in (key, order), and a series' first row forgets what came before it, so all
    # parts together are one long sequence: what enters a part is the composition of all parts before it.
    element = T.ArrayType(T.DoubleType())
    summary = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("_entry", element)])
    sequence = [PART, "_row", *keys, *order]

    def part_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, state = None, nothing
        for pdf in batches:
            for number, rows_of_part in pdf.groupby(PART, sort=True):
                if number != part:
                    if part is not None:
                        yield pd.DataFrame({PART: [part], "_entry": [_flat(state, 0)]})
                    part, state = number, nothing
                composed = prefix(scan.elements(rows_of_part.reset_index(drop=True)), scan.compose, scan.identity)
                state = scan.compose(state, tuple(c[-1:] for c in composed))
        if part is not None:
            yield pd.DataFrame({PART: [part], "_entry": [_flat(state, 0)]})

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, entries = pdf.sort_values(PART), nothing, []
        for values in pdf["_entry"]:
            entries.append(_flat(state, 0))
            state = scan.compose(state, _unflat(values, scan.identity))
        return pdf.assign(_entry=entries)

    def stream_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each part is led by a row that holds what enters it."""
        state = nothing
        for pdf in batches:
            heads = np.flatnonzero(pdf["_row"].to_numpy() == 0)
            bounds = [0, *heads.tolist(), len(pdf)]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                piece = pdf.iloc[lo:hi]
                if len(piece) and piece["_row"].iloc[0] == 0:
                    state = _unflat(piece["_entry"].iloc[0], scan.identity)
                    piece = piece.iloc[1:]
                if len(piece):
                    piece = piece.reset_index(drop=True)
                    piece = piece.astype({k: v for k, v in kinds.items() if piece[k].notna().all()})
                    emitted, state = rows(piece, state)
                    yield emitted

    data = s.df.withColumn("_row", F.lit(1))
    totals = (
        data.repartition(s.parts, PART).sortWithinPartitions(*sequence).mapInPandas(part_totals, summary)
    )
    entries = cut(totals.groupBy().applyInPandas(enter, summary))
    # A leading row has null data, which would turn whole-number columns into fractions on the way.
    kinds = {f.name: {"bigint": "int64", "int": "int32", "boolean": "bool"}[f.dataType.simpleString()] for f in s.df.schema
             if f.dataType.simpleString() in ("bigint", "int", "boolean") and f.name not in (PART, "_row")}
    led = data.unionByName(entries.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    return led.repartition(s.parts, PART).sortWithinPartitions(*sequence).mapInPandas(stream_parts, out)


Fold = Callable[[pd.DataFrame, "list[float] | None"], "tuple[pd.DataFrame, list[float]]"]
#: rows after which the states of two runs are compared
MARK = 256
#: states this near count as one: a mean that forgets comes as close as rounding lets it, and may stay one last bit away
SAME = 1e-12


def _run_again(pdf: pd.DataFrame, fold: Fold, state: list[float] | None, marks: dict[int, list[float]]) -> pd.DataFrame:
    """What the fold gives, with the number of the last row of its piece (``_pos``), and a row with the state after each piece. It stops
    where the last run had the same state."""
    out = []
    for a in range(0, len(pdf), MARK):
        piece = pdf.iloc[a : a + MARK].reset_index(drop=True)
        emitted, state = fold(piece, state)
        state = [float(x) for x in state]
        end = a + len(piece) - 1
        n = len(emitted)
        if not n:  # a row for the state alone
            emitted = emitted.astype(object).reindex([0])
        out.append(emitted.assign(_pos=end, _state=[None] * max(n - 1, 0) + [state], _given=n > 0))
        if end in marks and np.allclose(state, marks[end], rtol=SAME, atol=SAME * 1e-3, equal_nan=True):
            break
    return pd.concat(out, ignore_index=True)


def _null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns, a null being equal to a null; the right side's copies are dropped."""
    other = {n: f"_r_{n}" for n in names}
    right = right.withColumnsRenamed(other)
    on = F.lit(True)
    for n, o in other.items():
        on = on & F.col(n).eqNullSafe(F.col(o))
    return left.join(right, on, how).drop(*other.values())


def _streamed(s: Series, fold: Fold, out: T.StructType) -> DataFrame:
    """The fold over series that lie whole in a task. Many short ones share a batch; what leaves a batch enters the next one."""
    keys = list(s.keys)
    # whole numbers travel as text: beside a null they would become fractions
    kinds = {k: s.df.schema[k].dataType for k in keys if isinstance(s.df.schema[k].dataType, T.IntegralType)}
    sent = T.StructType([T.StructField(f.name, T.StringType()) if f.name in kinds else f for f in out])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            for k in keys:
                values, empty = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
                new[1:] |= (values[1:] != values[:-1]) & ~(empty[1:] & empty[:-1])
            bounds = [0, *np.flatnonzero(new).tolist(), len(pdf)]
            found, at = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                key = [None if pd.isna(v) else v for v in (pdf[k].iat[lo] for k in keys)]
                if key != last:
                    last, state = key, None
                emitted, state = fold(pdf.iloc[lo:hi].reset_index(drop=True), state)
                if len(emitted):
                    found.append(emitted)
                    at.append(np.full(len(emitted), lo))
            if found:
                rows = pd.concat(found, ignore_index=True)
                for k in keys:
                    rows[k] = pdf[k].to_numpy()[np.concatenate(at)]
                yield rows[out.names]

    order = [F.col(o).asc_nulls_last() for o in s.order]
    rows = s.df.repartition(tasks(s.df), *keys).withColumns({k: F.col(k).cast("string") for k in kinds})
    done = rows.sortWithinPartitions(*keys, *order).mapInPandas(stream, sent)
    return done.withColumns({k: F.col(k).cast(kind) for k, kind in kinds.items()})


def run_fold(s: Series, fold: Fold, schema: T.StructType, guess: Callable[[pd.DataFrame], list[float]] | None = None) -> DataFrame:
    """``fold(rows in order, entering state or None)`` returns (output rows, as many as it likes, leaving state). ``guess`` may give a state from a part's first
    rows from which its first run sooner meets the right one; the result does not depend on it."""
    order, keys = list(s.order), list(s.keys)
    out = T.StructType(_fields(s.df, keys) + schema.fields)
    names = [f.name for f in schema.fields]

    def sorted_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(order, kind="stable").reset_index(drop=True)

    def keyed(rows: pd.DataFrame, pdf: pd.DataFrame, columns: Sequence[str]) -> pd.DataFrame:
        rows = rows.copy()
        for k in columns:
            rows[k] = pdf[k].iloc[0]
        return rows

    if not s.cut_up:
        return _streamed(s, fold, out)

    group = [*keys, PART]
    state_type = T.ArrayType(T.DoubleType())
    version = T.StructType([*_fields(s.df, group), *schema.fields, T.StructField("_pos", T.LongType()), T.StructField("_state", state_type), T.StructField("_given", T.BooleanType())])
    columns = [f.name for f in version]

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = sorted_rows(pdf)
        later = pdf[PART].iloc[0] > pdf["_begins"].iloc[0]  # never true of a series within one part
        state = guess(pdf.head(MARK)) if guess is not None and later else None
        return keyed(_run_again(pdf.drop(columns="_begins"), fold, state, {}), pdf, group)[columns]

    def again(pdf: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        pdf = sorted_rows(pdf)
        known = {int(p): list(x) for p, x in zip(marks["_pos"], marks["_state"])}
        return keyed(_run_again(pdf.drop(columns="_entry"), fold, list(pdf["_entry"].iloc[0]), known), pdf, group)[columns]

    spans = s.df.groupBy(*keys).agg(F.min(PART).alias("_begins"), F.max(PART).alias("_ends")).where("_begins < _ends").drop("_ends")
    begun = _null_safe(s.df, F.broadcast(spans), keys, "left")  # fewer series than parts go on in another part
    versions = [written(begun.groupBy(*group).applyInPandas(first, version), "fold")]
    marks, lengths = versions[0].where("_state IS NOT NULL").select(*group, "_pos", "_state"), []
    by_key = Window.partitionBy(*keys)
    # series within one part are done; of the others a part holds two at most
    parts = cut(marks.groupBy(*group).agg(F.max_by("_state", "_pos").alias("_leaving")).withColumn("_parts", F.count(F.lit(1)).over(by_key)).where("_parts > 1"))
    used = parts.select(*group, F.lit(None).cast(state_type).alias("_used"))
    while True:
        entries = parts.withColumn("_entry", F.lag("_leaving").over(by_key.orderBy(PART)))
        todo = cut(_null_safe(entries, used, group, "inner").where("_entry IS NOT NULL AND NOT (_entry <=> _used)").select(*group, "_entry"))
        if todo.isEmpty():
            break
        few = F.broadcast(todo)  # at most two rows for each part
        rows = _null_safe(s.df, few, group, "inner")
        old = _null_safe(marks, few, group, "left_semi")
        versions.append(written(rows.groupBy(*group).cogroup(old.groupBy(*group)).applyInPandas(again, version), "fold"))
        length = cut(versions[-1].groupBy(*group).agg((F.max("_pos") + 1).alias("_length")))
        lengths.append(length)
        new = versions[-1].where("_state IS NOT NULL").select(*group, "_pos", "_state")
        marks = cut(_null_safe(marks, F.broadcast(length), group, "left").where("_pos >= coalesce(_length, 0)").drop("_length").unionByName(new))
        used = cut(entries.select(*group, F.col("_entry").alias("_used")))
        leaving = marks.groupBy(*group).agg(F.max_by("_state", "_pos").alias("_leaving"))
        parts = cut(_null_safe(leaving, F.broadcast(used.select(*group)), group, "left_semi"))
    result = None
    for number, rows in enumerate(versions):
        later = lengths[number:]
        if later:  # what later runs have done anew
            over = later[0]
            for length in later[1:]:
                over = over.unionByName(length)
            over = over.groupBy(*group).agg(F.max("_length").alias("_length"))
            rows = _null_safe(rows, F.broadcast(over), group, "left").where("_pos >= coalesce(_length, 0)")
        rows = rows.where("_given").select(*keys, *names)
        result = rows if result is None else result.unionByName(rows)
    return result


# --- state machines with few states ---------------------------------------------------------


def table_compose(first: Element, then: Element) -> Element:
    """Tables of what each state becomes, by number; a table whose entries are all equal forgets what came before."""
    return (np.take_along_axis(then[0], first[0].astype(int), axis=-1),)


def table_identity(states: int) -> Element:
    return (np.arange(states, dtype=float),)


# --- affine maps: x -> a x + b, one per channel -------------------------------------------


def affine_compose(first: Element, then: Element) -> Element:
    return first[0] * then[0], then[0] * first[1] + then[1]


def affine_identity(channels: int) -> Element:
    return np.ones(channels), np.zeros(channels)


def blend_elements(alpha: np.ndarray, step: np.ndarray, reference: np.ndarray, first: np.ndarray) -> Element:
    """x <- alpha (x + step) + (1 − alpha) reference; the first row of a series is its reference."""
    start = first[:, None]
    a = np.where(start, 0.0, alpha)
    return a, np.where(start, reference, alpha * step + (1.0 - alpha) * reference)


# --- linear Gaussian filters with two states ----------------------------------------------


def _inverse2(m: np.ndarray) -> np.ndarray:
    a, b, c, d = m[..., 0, 0], m[..., 0, 1], m[..., 1, 0], m[..., 1, 1]
    det = a * d - b * c
    return np.stack([np.stack([d, -b], -1), np.stack([-c, a], -1)], -2) / det[..., None, None]


def _mv(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("...ij,...j->...i", m, v)


def _t(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def gaussian_compose(first: Element, then: Element) -> Element:
    """Composition of filtering elements (A, b, C, eta, J); a prior is (0, mean, covariance, 0, 0)."""
    a1, b1, c1, e1, j1 = first
    a2, b2, c2, e2, j2 = then
    mix = a2 @ _inverse2(np.eye(2) + c1 @ j2)
    back = _t(a1) @ _inverse2(np.eye(2) + j2 @ c1)
    return (
        mix @ a1,
        _mv(mix, b1 + _mv(c1, e2)) + b2,
        mix @ c1 @ _t(a2) + c2,
        _mv(back, e2 - _mv(j2, b1)) + e1,
        back @ j2 @ a1 + j1,
    )


def gaussian_identity(batch: tuple[int, ...] = ()) -> Element:
    zero, eye = np.zeros((*batch, 2, 2)), np.broadcast_to(np.eye(2), (*batch, 2, 2)).copy()
    vec = np.zeros((*batch, 2))
    return eye, vec, zero, vec.copy(), zero.copy()


def predict_element(f: np.ndarray, u: np.ndarray, q: np.ndarray) -> Element:
    """x <- F x + u + noise(Q), nothing measured."""
    return f, u, q, np.zeros_like(u), np.zeros_like(f)


def measure_element(h: np.ndarray, z: np.ndarray, r: np.ndarray, seen: np.ndarray) -> Element:
    """One scalar measurement z = h·x + noise(r); rows not ``seen`` leave the state alone."""
    shape = (*z.shape, 2, 2)
    w = np.where(seen, 1.0 / r, 0.0)
    info = h[..., :, None] * h[..., None, :] * w[..., None, None]
    vec = h * (w * np.where(seen, z, 0.0))[..., None]
    eye = np.broadcast_to(np.eye(2), shape)
    return eye, np.zeros((*z.shape, 2)), np.zeros(shape), vec, np.broadcast_to(info, shape)


def with_prior(elements: Element, first: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> Element:
    """Put the prior before the step of each row marked ``first``."""
    if not first.any():
        return elements
    at = np.flatnonzero(first)
    picked = tuple(e[at] for e in elements)
    shape = picked[0].shape
    prior = (
        np.zeros(shape),
        np.broadcast_to(mean[at], picked[1].shape),
        np.broadcast_to(covariance, shape),
        np.zeros(picked[1].shape),
        np.zeros(shape),
    )
    started = gaussian_compose(prior, picked)
    out = []
    for e, v in zip(elements, started):
        e = np.array(e, dtype=float)
        e[at] = v
        out.append(e)
    return tuple(out)


# --- rotations -----------------------------------------------------------------------------


def product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Quaternion product p ⊗ q, brought to length one."""
    pw, pv, qw, qv = p[..., :1], p[..., 1:], q[..., :1], q[..., 1:]
    w = pw * qw - np.sum(pv * qv, axis=-1, keepdims=True)
    out = np.concatenate([w, pw * qv + qw * pv + np.cross(pv, qv)], axis=-1)
    return out / np.linalg.norm(out, axis=-1, keepdims=True)


def rotation_compose(first: Element, then: Element) -> Element:
    """(rotation, starts anew): one that starts anew forgets what came before."""
    anew = then[1] > 0
    return np.where(anew[..., None], then[0], product(first[0], then[0])), np.maximum(first[1], then[1])


def rotation_identity() -> Element:
    return np.array([1.0, 0.0, 0.0, 0.0]), np.array(0.0)


def rotation_steps(rates: np.ndarray, dt: np.ndarray) -> np.ndarray:
    turn = rates * dt[:, None]
    angle = np.linalg.norm(turn, axis=1)
    share = np.where(angle > 0, np.sin(angle / 2.0) / np.where(angle > 0, angle, 1.0), 0.0)
    return np.concatenate([np.cos(angle / 2.0)[:, None], turn * share[:, None]], axis=1)


def rotation_from_euler(roll: np.ndarray, pitch: np.ndarray, yaw: float = 0.0) -> np.ndarray:
    """Yaw, then pitch, then roll, as a product of three turns."""
    def about(axis: int, angle: np.ndarray) -> np.ndarray:
        q = np.zeros((len(angle), 4))
        q[:, 0], q[:, axis] = np.cos(angle / 2.0), np.sin(angle / 2.0)
        return q

    z = about(3, np.full(len(roll), yaw))
    return product(product(z, about(2, pitch)), about(1, roll))
