"""Segments of equal labels, cleaned of tiny ones in one go through them.

A pass gives each tiny segment a neighbour's label, as the segments stand before the pass, and joins equal neighbours after it. A
segment's new label needs the one before and the one after it, and a joined segment is known when the next one has another label.
So a pass holds three segments, whatever the length of the series, and several passes run one behind the other
on the same stream. What they hold is the state of a fold, which long series run through in parts.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlith.operators.recursions import run_fold
from sensorlith.operators.series import arrange, shift

Segment = tuple[float, float, float, float]  # label number, start, end, rows
_NONE = (np.nan,) * 4


class Pass:
    """One pass over segments that come one by one."""

    def __init__(self, min_sec: float, protected: Collection[int], state: Sequence[float] | None = None) -> None:
        self.min_sec, self.protected = min_sec, protected
        held = [_NONE] * 3 if state is None else [tuple(state[i : i + 4]) for i in (0, 4, 8)]
        self.before, self.now, self.joined = (None if np.isnan(x[0]) else x for x in held)

    def state(self) -> list[float]:
        return [float(v) for x in (self.before, self.now, self.joined) for v in (x or _NONE)]

    def push(self, segment: Segment | None, step: float) -> Iterator[Segment]:
        """Segments that are now known; None ends the series."""
        if self.now is not None:
            yield from self._decide(segment, step)
        self.before, self.now = self.now, segment
        if segment is None:
            if self.joined is not None:
                yield self.joined
            self.before = self.now = self.joined = None

    def _decide(self, after: Segment | None, step: float) -> Iterator[Segment]:
        label, start, end, rows = self.now
        length = lambda s: s[2] - s[1] + step
        if length(self.now) < self.min_sec and label not in self.protected:
            if self.before is None:
                label = label if after is None else after[0]
            elif after is None or self.before[0] == after[0] or length(self.before) >= length(after):
                label = self.before[0]
            else:
                label = after[0]
        if self.joined is not None and self.joined[0] == label:
            self.joined = (label, self.joined[1], end, self.joined[3] + rows)
        else:
            if self.joined is not None:
                yield self.joined
            self.joined = (label, start, end, rows)


def without_tiny(segments: DataFrame, keys: Sequence[str], labels: Sequence[str], protected: Collection[str], min_sec: float, passes: int, probe: DataFrame | None = None) -> DataFrame:
    """``segments`` (label, start_time_sec, end_time_sec, sample_count, step) after the passes: equal neighbours give a tiny segment its
    label, else the longer one, else the earlier one; a series' first or last segment takes its only neighbour. ``probe`` as in ``arrange``."""
    known = list(labels)
    kept = {known.index(p) for p in protected}
    coded = segments.withColumn("_label", F.array_position(F.array(*[F.lit(x) for x in known]), F.col("label")) - 1).drop("label")
    s = shift(arrange(coded, keys, ["start_time_sec"], probe), {"_after": F.struct("start_time_sec")}, by=-1)
    s = s.with_df(s.df.withColumn("_last", F.col("_after").isNull()).drop("_after"))

    def fold(pdf: pd.DataFrame, state: list[float] | None) -> tuple[pd.DataFrame, list[float]]:
        chain = [Pass(min_sec, kept, None if state is None else state[12 * i : 12 * (i + 1)]) for i in range(passes)]
        out: list[Segment] = []

        def feed(at: int, segment: Segment | None, step: float) -> None:
            if at == passes:
                if segment is not None:
                    out.append(segment)
                return
            for x in chain[at].push(segment, step):
                feed(at + 1, x, step)
            if segment is None:
                feed(at + 1, None, step)

        for label, start, end, rows, step, last in zip(*(pdf[n].tolist() for n in ("_label", "start_time_sec", "end_time_sec", "sample_count", "step", "_last"))):
            feed(0, (float(label), start, end, float(rows)), step)
            if last:
                feed(0, None, step)
        names = ("_label", "start_time_sec", "end_time_sec", "sample_count")
        columns = np.array(out, np.float64).reshape(-1, 4).T
        rows = pd.DataFrame({n: v if n.endswith("_sec") else v.astype(np.int64) for n, v in zip(names, columns)})
        return rows, [v for p in chain for v in p.state()]

    schema = T.StructType([T.StructField("_label", T.LongType()), T.StructField("start_time_sec", T.DoubleType()), T.StructField("end_time_sec", T.DoubleType()), T.StructField("sample_count", T.LongType())])
    merged = run_fold(s, fold, schema)
    return merged.withColumn("label", F.get(F.array(*[F.lit(x) for x in known]), F.col("_label").cast("int"))).drop("_label")
