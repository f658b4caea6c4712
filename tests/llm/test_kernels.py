"""Hashing, sketches, wavelet matrices and T-occurrence search against plain Python."""

from __future__ import annotations

import io
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorlith.llm import chunks, jaccard, mixture, words
from sensorlith.llm.wavelet import Shard, build

TEXT = st.text(alphabet="aBc é\n\t\x1c.x", max_size=60)


def plain(text: bytes) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", text)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5), st.booleans(), st.sampled_from([16, 1 << 20]))
def test_words_and_sequences(texts, lower, block):
    was, words.BLOCK = words.BLOCK, block
    try:
        w = words.Words([t.encode() for t in texts], lower=lower)
    finally:
        words.BLOCK = was
    split = [plain(t.encode()) for t in texts]
    flat = [x.lower() if lower else x for s in split for x in s]
    assert w.counts.tolist() == [len(s) for s in split]
    assert [w.data[a:b] for a, b in zip(w.starts, w.ends)] == [x for s in split for x in s]
    for n in (1, 2, 3, 5, 20):
        named: dict[tuple, int] = {}
        for i, h in enumerate(words.sequences(w.hashes, n).tolist()):
            assert named.setdefault(tuple(flat[i : i + n]), h) == h
        assert len(set(named.values())) == len(named)
    owner, _ = words.shingles(w, 5)
    for i, s in enumerate(split):
        s = [x.lower() if lower else x for x in s]
        assert (owner == i).sum() == (len({tuple(s[j : j + 5]) for j in range(max(1, len(s) - 4))}) if s else 0)


def test_gaps_round_trip():
    cells = np.sort(np.random.default_rng(1).integers(0, 1 << 26, 3000))
    assert (chunks._cells(chunks._gaps(cells)) == cells).all()
    assert len(chunks._cells(chunks._gaps(np.zeros(0, np.int64)))) == 0


@pytest.mark.parametrize("n,most", [(0, 5), (1, 1), (7, 2), (9000, 300), (60_000, 49_408), (20_000, 70_000)])
def test_wavelet_matrix(n, most):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n) - 1, most - 1).astype(np.int64)
    shard = Shard(io.BytesIO(build(ids, np.array([3, 9]), np.array([0, n // 2, n]))))
    assert (shard.all() == ids).all() and shard.first.tolist() == [0, n // 2, n] and shard.doc_ids.tolist() == [3, 9]
    for i in r.integers(0, max(n, 1), 30) if n else ():
        assert shard.access(int(i)) == ids[i]
    for token in {*ids[:20].tolist(), most + 5}:
        a, b = sorted(r.integers(0, n + 1, 2).tolist())
        assert shard.count(token, a, b) == (ids[a:b] == token).sum()
        places = np.flatnonzero(ids == token)
        if len(places):
            k = int(r.integers(0, len(places)))
            assert shard.locate(token, k) == places[k]
    with pytest.raises(IndexError):
        shard.access(n)


def test_wavelet_reads_only_blocks_it_needs():
    ids = np.random.default_rng(2).integers(0, 1 << 15, 1_500_000)
    data = build(ids, np.array([1]), np.array([0, len(ids)]))

    class Counting(io.BytesIO):
        got = 0

        def read(self, size=-1):
            self.got += size
            return super().read(size)

    file = Counting(data)
    assert Shard(file).access(700_000) == ids[700_000]
    assert file.got < len(data) * 0.6


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30), st.lists(st.sets(st.integers(0, 40), max_size=35), max_size=12), st.sets(st.integers(0, 40), max_size=35))
def test_divide_skip(need, members, query):
    arrays = [np.array(sorted(m), np.uint64) for m in members]
    found = jaccard.divide_skip(np.array(sorted(query), np.uint64), arrays, need)
    assert found == {i: len(m & query) for i, m in enumerate(members) if len(m & query) >= need}


def test_least_overlap():
    for n in range(1, 40):
        for m in range(1, 40):
            least = next(i for i in range(n + m + 1) if 100 * i >= 75 * (n + m - i))
            assert jaccard.least_overlap(n, m, 75) == least


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 1000):
        rows = spark.range(n).select(mixture.permuted(mixture.F.col("id"), mixture.F.lit(n).cast("long"), mixture.F.lit(3), mixture.F.lit(1)).alias("p"))
        got = [r.p for r in rows.collect()]
        assert sorted(got) == list(range(n))
        assert n < 1000 or sum(abs(p - i) for i, p in enumerate(got)) > n * n / 5


def test_sketch_never_undercounts(spark):
    random.seed(5)
    docs = spark.createDataFrame([(i, " ".join(random.choice("abcdefgh") for _ in range(random.randint(0, 40)))) for i in range(60)], "doc_id long, text string").repartition(7)
    made = chunks.write_chunks(docs)

    def keys(chunk):
        w = words.Words(chunk[1])
        return np.unique(words.sequences(w.hashes, 2)[words.starts_within(w, 2)], return_counts=True)

    bits = chunks.slice_bits(made)
    rows = chunks.sketch_counts(made, keys, bits).toPandas()
    total: dict[int, int] = {}
    parts = {r.chunk: keys(chunks.read_chunk(r.docs)) for r in made.collect()}
    for key, count in parts.values():
        for k, c in zip(key.tolist(), count.tolist()):
            total[k] = total.get(k, 0) + c
    for number, (key, _) in parts.items():
        level = b"".join(r.level for r in rows[rows.chunk == number].sort_values("slice").itertuples())
        assert len(level) == len(key)
        assert all(2 ** ((v + 1) / chunks.LEVELS) > total[k] for v, k in zip(level, key.tolist()))
        assert sum(2 ** (v / chunks.LEVELS) > total[k] + 1e-9 for v, k in zip(level, key.tolist())) <= 1
