"""Periodic runs against a comparison of all periods."""

from __future__ import annotations

import hashlib
import re
from zlib import crc32

import numpy as np
import pytest

from sensorlith.llm import periods
from sensorlith.llm.queries import LLM_QUERIES, _planted

SF = "/root/testdata/sf0.001"


def brute(words):
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    out = {}
    for q in range(1, len(w) // 4 + 1):
        same = np.zeros(len(w) - q + 2, bool)
        same[1:-1] = w[:-q] == w[q:]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[0::2].tolist(), (edges[1::2] + q).tolist()):
            if b - a >= max(6, 4 * q):
                out.setdefault((a, b), q)
    return sorted((a, b, q) for (a, b), q in out.items())


def repeated(r):
    parts = [np.zeros(0, int)]
    for _ in range(r.integers(0, 5)):
        base = r.integers(0, r.integers(1, 5), r.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 31, 32, 33, 60, 130]))
        if r.random() < 0.4:  # a region of small periods within the longer one
            base = np.append(np.resize(r.integers(0, 3, r.integers(1, 4)), 40)[: len(base)], r.integers(0, 3))
        parts += [np.resize(base, int(len(base) * r.uniform(0.5, 7))), r.integers(0, 4, r.integers(0, 10))]
    return [b"w%d" % x for x in np.concatenate(parts)]


def test_all_runs_are_found():
    r, total = np.random.default_rng(5), 0
    for _ in range(300):
        texts = [repeated(r) for _ in range(r.integers(1, 6))]
        for words, found in zip(texts, periods.runs_of(texts)):
            assert [tuple(x) for x in found.tolist()] == brute(words)
            total += len(found)
    assert total > 1000


def test_selected_positions_depend_on_their_context():
    r = np.random.default_rng(2)
    w = np.concatenate([r.integers(0, 50, 400), np.resize([7, 8], 90), r.integers(0, 50, 300)])
    w = np.concatenate([w, w[100:600]])
    ids, scale = periods.mix(w.astype(np.uint64)), 1
    while scale < 16:
        ids = periods.mix(ids[:-scale] * np.uint64(0x9E3779B97F4A7C15) + ids[scale:])
        scale *= 2
    chosen = set(periods.synchronising_set(ids, periods.highly_periodic(periods.small_periods(w, 8), len(ids), scale), scale).tolist())
    for i in range(100, 600 - 2 * scale):
        assert (i in chosen) == (i - 100 + 790 in chosen)
    gaps = [i for i in range(len(w) - 3 * scale) if not chosen & set(range(i, i + scale))]
    assert gaps and all(len(set(w[i : i + 3 * scale - 1].tolist())) <= 2 for i in gaps)


@pytest.mark.parametrize("n", [40_000])
def test_long_texts(n):
    r = np.random.default_rng(3)
    base = [b"%d" % x for x in r.integers(0, 9, n // 5)]
    words = [b"a", *(base * 5), b"z", *[b"x"] * 500]
    assert [tuple(x) for x in periods.runs_of([words])[0].tolist()] == brute(words)


def digests(rows):
    out = []
    for i, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        h = None if i is None else crc32(str(i).encode())
        if h is not None and h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(len(words))]
        runs = brute(words)
        gone = {k for a, b, q in runs for k in range(a + q, b)}
        best = max(runs, key=lambda x: ((x[1] - x[0]) / x[2], -x[0], -x[2]), default=None)
        top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        sha = lambda x: hashlib.sha256(x).hexdigest()
        lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs).encode()
        out.append((i, len(runs), *top, sha(lines), sha(b" ".join(x for k, x in enumerate(words) if k not in gone))))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_query_against_all_periods(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = ordered(LLM_QUERIES["op12_periodic_runs"](spark, SF).collect())
    assert got == ordered(digests(docs))
    assert sum(r[1] for r in got) > 10


def test_odd_documents(spark, messy, nothing):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert ordered(periods.run_digests(messy, _planted).collect()) == ordered(digests(rows))
    assert periods.run_digests(nothing).count() == 0
    # rows that repeat an id, and texts of one word
    df = spark.createDataFrame([(1, "a b " * 6), (1, "c " * 6), (None, "c " * 5), (2, "x"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in periods.periodic_runs(df).collect()}
    assert got == {(1, "a b"): [(0, 12, 2)], (1, "c"): [(0, 6, 1)], (None, "c c c c c"): [], (2, "x"): [], (3, ""): []}
