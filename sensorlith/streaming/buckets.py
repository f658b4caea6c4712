"""Many keys of a stream in one state: a bucket's rows are columns of numbers, worked on at once and not key by key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

#: keys share so many states; a call of Python costs milliseconds whatever it is given, so a batch makes no more calls than this
BUCKETS = 256
NULL_BUCKET = -1


def bucketed(df: DataFrame, key: str, buckets: int) -> GroupedData:
    """Rows grouped by a hash of the key. Null keys have a group of their own, so that the others' column keeps its type."""
    bucket = F.when(F.col(key).isNull(), F.lit(NULL_BUCKET)).otherwise(F.pmod(F.hash(key), F.lit(buckets)))
    return df.withColumn("_bucket", bucket).groupBy("_bucket")


class Keys:
    """The keys of a bucket, by number in the order in which they came."""

    def __init__(self, bucket: int, known: list) -> None:
        self.known, self._null = list(known), bucket == NULL_BUCKET

    def numbers(self, column: pd.Series) -> np.ndarray:
        """The number of each row's key; new keys get the next ones."""
        if self._null:
            self.known = [None] if len(column) else self.known
            return np.zeros(len(column), dtype=np.int64)
        both = pd.concat([pd.Series(self.known, dtype=column.dtype), column], ignore_index=True)
        numbers, uniques = pd.factorize(both, use_na_sentinel=False)
        old = len(self.known)
        self.known = uniques.tolist()
        return numbers[old:]

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The keys of these numbers."""
        return pd.Series(self.known, dtype=None if self.known else object).to_numpy()[numbers]


def starts(numbers: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its key, of rows in order of the keys."""
    first = np.ones(len(numbers), dtype=bool)
    first[1:] = numbers[1:] != numbers[:-1]
    return first


def ends(numbers: np.ndarray) -> np.ndarray:
    """Whether a row is the last of its key, of rows in order of the keys."""
    last = np.ones(len(numbers), dtype=bool)
    last[:-1] = numbers[1:] != numbers[:-1]
    return last


def newest(mask: np.ndarray) -> np.ndarray:
    """For each row the last row up to it for which the mask holds; -1 without one."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1)) if len(mask) else np.zeros(0, dtype=np.int64)


def grown(values: np.ndarray, n: int, fill: float) -> np.ndarray:
    """The values of the known keys, and ``fill`` for those that are new."""
    return np.concatenate([values, np.full(n - len(values), fill, dtype=values.dtype)])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as steps from one to the next, each in as few bytes as the largest needs."""
    steps = np.diff(np.asarray(values, dtype=np.int64), prepend=np.int64(0))
    low, high = (int(steps.min()), int(steps.max())) if len(steps) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=f"<i{data[0]}", offset=1), dtype=np.int64)


class Ranges:
    """Whole numbers seen of each key, as sorted ranges that neither overlap nor touch: as many as the log has gaps."""

    def __init__(self, lows, highs, keys=None) -> None:
        self.lows, self.highs = np.asarray(lows, dtype=np.int64), np.asarray(highs, dtype=np.int64)
        self.keys = np.zeros(len(self.lows), dtype=np.int64) if keys is None else keys

    def add(self, value: int) -> bool:
        """Whether the number is new."""
        return bool(self.add_all(np.zeros(1, dtype=np.int64), np.array([value], dtype=np.int64))[0])

    def add_all(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Whether each number is new to its key; of equal ones the first is."""
        order = np.lexsort((values, keys))
        k, v = keys[order], values[order]
        fresh = starts(k)
        fresh[1:] |= v[1:] != v[:-1]
        # a number lies in the last range that begins at or below it, if in any
        all_keys, lows = np.concatenate([self.keys, k]), np.concatenate([self.lows, v])
        merged = np.lexsort((lows, all_keys))
        old = len(self.lows)
        below = np.empty(len(merged), dtype=np.int64)
        below[merged] = np.maximum.accumulate(np.where(merged < old, merged, -1)) if len(merged) else merged
        below = below[old:]
        if old:
            fresh &= (below < 0) | (self.keys[below] != k) | (self.highs[below] < v)
        new = np.empty(len(values), dtype=bool)
        new[order] = fresh
        kept = merged[np.concatenate([np.ones(old, dtype=bool), fresh])[merged]]
        all_keys, lows, highs = all_keys[kept], lows[kept], np.concatenate([self.highs, v])[kept]
        begins = starts(all_keys)
        begins[1:] |= lows[1:] != highs[:-1] + 1
        self.keys, self.lows = all_keys[begins], lows[begins]
        self.highs = highs[np.append(begins[1:], True)] if len(highs) else highs
        return new

    def highest(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys with numbers, and the highest of each."""
        last = ends(self.keys)
        return self.keys[last], self.highs[last]
