"""The prefix trie against all prefixes, in one partition and across many."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from sensorlith.llm import tries

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def all_prefixes(convs):
    """``convs``: id to list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        yield node
        for x in children[node]:
            yield from below(x)

    rows = []
    for node, ids in members.items():
        subtree = list(below(node))
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in subtree if x)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(node))))
        rows.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), sum(not children[x] for x in subtree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def random_conversations(seed, n):
    random.seed(seed)
    pool = [[("user", random.choice(["hello there", "a", "", "long question about it"])) for _ in range(random.randint(0, 7))] for _ in range(n // 4)]
    convs = {}
    for c in range(n):
        turns = list(random.choice(pool))
        if random.random() < 0.5:
            turns = turns[: random.randint(0, len(turns))] + [("assistant", random.choice(["yes no", "x y z"])) for _ in range(random.randint(0, 3))]
        convs[c * 3 - 20] = turns
    return convs


def as_rows(spark, convs):
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("part_bytes, merged", [(16 << 20, 64), (300, 2), (2000, 3)])
def test_trie_across_partitions(spark, part_bytes, merged):
    convs = {c: t for c, t in random_conversations(4, 240).items() if t}
    got = collected(tries.prefix_trie(tries.turns_in_order(as_rows(spark, convs)), part_bytes, merged))
    assert got == all_prefixes(convs)


def test_one_opening_and_one_conversation_for_most(spark):
    convs = {c: [("u", "same start"), ("a", "b c")] + [("u", f"turn {c % 5}")] * (c % 3) for c in range(300)}
    convs |= {1000 + c: [("u", "same start")] for c in range(200)}
    got = collected(tries.prefix_trie(tries.turns_in_order(as_rows(spark, convs).repartition(7)), 500, 4))
    assert got == all_prefixes(convs)


def test_forest_in_memory():
    """The union-find of one partition that is the whole."""
    convs = random_conversations(9, 120)
    items = []
    for c, turns in convs.items():
        path = b"".join(hashlib.md5(repr(t).encode()).digest() for t in turns)
        items.append(tries.Item(path, tries.np.array([len(t[1].split()) for t in turns], "i8"), c))
    items.sort(key=lambda x: (x.path, x.conv_id))
    table = tries.Forest(items, whole=True, named=False).table(0)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in table.to_pylist()), key=str) == all_prefixes(convs)


def test_openings_and_odd_rows(spark):
    rows = [(20, 1, "u", "a b"), (20, None, None, "first"), (20, 2, "a", None), (21, 1, "u", "own"), (21, 1, "u", "own"), (43, 5, "u", "no source"), (None, 1, "u", "nobody's"), (25, 1, "u", "x"), (25, 2, "u", "y"), (25, 3, "u", "z"), (25, 4, "u", "w")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("turns", F.lit("clash")).withColumn("source", F.lit(1)).repartition(3)
    own = {20: [("", "first"), ("u", "a b"), ("a", "")], 21: [("u", "own")] * 2, 43: [("u", "no source")], 25: [("u", x) for x in "xyzw"]}
    h = {c: crc32(str(c).encode()) % 4 for c in own}
    rebuilt = {c: own.get(c - c % 20, [])[: h[c]] + t[h[c] :] for c, t in own.items()}
    opened = tries.with_openings(tries.turns_in_order(df), F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string")) % 4, 3)
    assert collected(tries.prefix_trie(opened)) == all_prefixes(rebuilt)
    assert tries.prefix_trie(tries.turns_in_order(df.limit(0))).count() == 0


def test_long_conversation(spark):
    convs = {1: [("u", f"t{k}") for k in range(3000)], 2: [("u", f"t{k}") for k in range(2500)], 3: [("u", f"t{k}") for k in range(10)] + [("u", "else")]}
    got = tries.prefix_trie(tries.turns_in_order(as_rows(spark, convs)), 1 << 10, 2).agg(F.count("*"), F.sum("n_convs"), F.max("n_leaves"), F.max("saved_tokens")).first()
    assert tuple(got) == (3002, 3001 + 2501 + 12, 2, 2500 + 10)
