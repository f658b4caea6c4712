"""Operators on documents against brute force, and their defined results in odd cases."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sensorlith.llm import decontaminate, jaccard, language, licences, mixture, quality, repeats, tokens, toxicity
from sensorlith.llm.frames import bucket_of
from sensorlith.session import work_path

SF = "/root/testdata/sf0.001"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# -- Jaccard join


def shingle_set(text):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in split(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return [(doc, len(sets[i]), low[root(i)] if doc is not None else None) for i, (doc, _) in enumerate(rows)]


def test_jaccard_join(spark, messy, nothing):
    got = jaccard.similar_documents(messy).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(components_of(rows_of(messy)), key=key)
    assert jaccard.similar_documents(nothing).count() == 0


def test_jaccard_join_of_chains_and_shared_passages(spark):
    """Neighbours link, ends don't; many documents share a passage without linking."""
    r = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in r.integers(0, 5000, n)]
    base, passage, docs = word(200), word(60), []
    for i in range(40):
        docs.append((1000 + i, " ".join(base)))
        base = base[:]
        for k in r.integers(0, 200, 4):
            base[k] = f"x{i}_{k}"
    for i in range(60):
        docs.append((2000 + i, " ".join(word(90) + passage)))
    for i in range(30):
        docs.append((3000 + i, " ".join(passage[: 55 + i % 3])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()}
    assert got == set(components_of(docs))


def test_jaccard_join_leaves_wide_rows_in_their_buckets(spark, monkeypatch):
    """Neither texts nor whole sets are shuffled to meet counts and pairs, also where nothing is broadcast."""
    r = np.random.default_rng(5)
    docs = []
    for i in range(30):
        words = [f"w{x}" for x in r.integers(0, 5000, 120)]
        docs += [(500 - i, " ".join(words)), (i, " ".join(words)), (i, " ".join(words)), (1000 + i, " ".join([*words[:100], *(f"x{i}_{k}" for k in range(20))])), (2000 + i, " ".join(words[:60]))]
    plans = {"sets": [], "pairs": []}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    stored, verified = jaccard.stored, jaccard._verified

    def storing(df, name):
        if name == "sets":
            plans["sets"].append(plan(df))
        return stored(df, name)

    def verifying(*args):
        plans["pairs"].append(plan(found := verified(*args)))
        return found

    monkeypatch.setattr(jaccard, "stored", storing)
    monkeypatch.setattr(jaccard, "_verified", verifying)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        got = jaccard.similar_documents(df).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(components_of(docs))
    assert len(plans["sets"]) == 1 and len(plans["pairs"]) == 5
    for name, column in (("sets", "docs"), ("pairs", "kept")):
        for text in plans[name]:
            scans = [x for x in text.splitlines() if "FileScan" in x and column in x.split("Batched")[0]]
            assert any("Bucketed: true" in x for x in scans)  # the planner reads buckets as such only where that spares a shuffle
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("chunks_", "representatives_"))]


def test_keep_one_each(spark, messy, nothing):
    kept = jaccard.keep_one_each(messy)
    assert kept.columns == messy.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    rows = rows_of(messy)
    best, stay = {}, Counter()
    for (doc, text), (_, n, component) in zip(rows, components_of(rows)):
        if doc is None or not n:
            stay[doc, text] += 1
        elif component not in best or doc < best[component][0]:
            best[component] = (doc, text)
    have = Counter(got)
    for doc, text in stay:
        assert have[doc, text] == stay[doc, text]
    assert Counter(d for d, t in got if d is not None and split(t)) == Counter(d for d, _ in best.values())
    assert jaccard.keep_one_each(nothing).count() == 0


# -- repeated windows


def without_repeats(rows, length):
    first, out = {}, []
    order = lambda d: (d is None, d or 0)
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, (order(doc), i)), (order(doc), i))
    for doc, text in rows:
        w = split(text)
        gone = {i + j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < (order(doc), i) for j in range(length)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("length", [3, 20])
def test_without_repeats(messy, nothing, length):
    got = repeats.without_repeats(messy, length)
    assert Counter(map(tuple, got.collect())) == Counter(without_repeats(rows_of(messy), length))
    assert repeats.without_repeats(nothing, length).count() == 0


# -- decontamination


def test_decontamination(spark, messy, nothing):
    r = np.random.default_rng(2)
    word = lambda n: [f"t{x}" for x in r.integers(0, 10**6, n)]
    items = [word(n) for n in (40, 25, 14, 9, 3, 60)]
    changed = items[0][:]
    for k in (5, 13, 22, 30):
        changed[k] = "other"
    docs = [
        (1, " ".join(word(30) + items[0] + word(10)), [0]),
        (2, " ".join(word(30) + changed + word(10)).upper(), [0]),
        (3, " ".join(word(100)), []),
        (4, " ".join(items[0][:10] + word(20)), []),
        (5, " ".join(word(3) + items[2] + word(3) + items[3]), [2, 3]),
        (6, " ".join(items[4] + word(20)), []),
        (7, " ".join(word(50) + items[5][10:32] + word(4)), [5]),
    ]
    tests = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(None, None), (8, "")], "item_id long, text string")
    df = spark.createDataFrame([(d, t) for d, t, _ in docs], "doc_id long, text string")
    got = decontaminate.contaminated(df, tests).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == sorted((d, i) for d, _, of in docs for i in of)
    one = next(x for x in got if x.doc_id == 2)
    assert (one.matched >= 16, one.compared, one.doc_start - one.item_start) == (True, 20, 30)
    kept = decontaminate.keep_clean(df, tests)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {3, 4, 6}
    many = decontaminate.BLOCK_BYTES
    try:
        decontaminate.BLOCK_BYTES = 100
        assert sorted((x.doc_id, x.item_id) for x in decontaminate.contaminated(df, tests).collect()) == sorted((x.doc_id, x.item_id) for x in got)
        assert {x.doc_id for x in decontaminate.keep_clean(df, tests).collect()} == {3, 4, 6}
    finally:
        decontaminate.BLOCK_BYTES = many
    assert decontaminate.contaminated(messy, tests).count() == 0
    assert sorted(decontaminate.keep_clean(messy, tests).select("number").collect()) == sorted(messy.select("number").collect())
    assert decontaminate.contaminated(nothing, tests).count() == 0
    assert decontaminate.contaminated(df, tests.limit(0)).count() == 0 and decontaminate.keep_clean(df, tests.limit(0)).count() == 7


@pytest.mark.parametrize("size", [*range(5, 21), 33])
def test_decontamination_finds_every_placement(size):
    """Whichever words the threshold lets a passage replace, it is found; with one more replaced it is not."""
    width = min(size, 20)
    item = [f"w{k}" for k in range(size)]
    items = decontaminate.Items.of([0], [" ".join(item).encode()], 20, 80)
    start = (size - width) // 2
    for more in (0, 1):
        texts = []
        for gone in combinations(range(width), width // 5 + more):
            passage = ["x" if k in gone else w for k, w in enumerate(item[start : start + width])]
            texts.append(" ".join(["a", "b", *passage, "c"]).encode())
        for at in range(0, len(texts), 5000):
            part = texts[at : at + 5000]
            found = items.found(decontaminate.Words(part, lower=True), 20, 80)
            assert [(t, m, c) for t, _, m, c, _, _ in found] == ([] if more else [(t, width - width // 5, width) for t in range(len(part))])


# -- tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_shards(spark, messy, nothing, name):
    from tokenizers import Tokenizer

    tokenizer, folder = Tokenizer.from_file(public_tokenizers.path(name)), work_path(spark, "tokens-test")
    shards = tokens.write_shards(messy, public_tokenizers.path(name), folder, shard_tokens=700)
    got = [tuple(r) for r in tokens.read_documents(shards, folder).collect()]
    assert shards.count() > 3
    rows = rows_of(messy)
    ids = {t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in rows}
    assert Counter((d, n, crc) for d, _, n, crc in got) == Counter((d, len(ids[t]), zlib.crc32(ids[t].tobytes())) for d, t in rows)
    at = 0
    for d, start, n, _ in sorted(got, key=lambda x: x[1]):
        assert start == at
        at += n
    order = [d if d is not None else 1 << 62 for d, *_ in sorted(got, key=lambda x: x[1])]
    assert order == sorted(order)
    assert tokens.read_documents(tokens.write_shards(nothing, public_tokenizers.path(name), folder), folder).count() == 0


def test_encoder_by_word():
    import random

    from tokenizers import Tokenizer

    random.seed(3)
    spec = open(public_tokenizers.path("word_bpe_49k.json")).read()
    whole, encode = Tokenizer.from_str(spec), tokens.Encoder(spec)
    assert encode.by_word
    letters = "aBcÀÉéßøÿÖ'`´́ \x85\x1c\x1d  ΣσİıﬁÅ가١Ⅷ½²ª123.,!?<|>\n\t\r  'stvemlld’«€😀"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 14))) for _ in range(6000)]
    for text in [*texts, "<|endoftext|>", "a <|startoftext|>b", "it's I'LL we'Re", "ΑΣ ΑΣ", "<|"]:
        assert np.frombuffer(encode(text), encode.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_encoder_looks_for_special_tokens_in_the_text_as_it_stands():
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("word_bpe_49k.json")).read()
    whole, encode = Tokenizer.from_str(spec), tokens.Encoder(spec)
    for text in ("<|ENDOFTEXT|>", "a <|EndOfText|> b", "É<|STARTOFTEXT|>", "<|endoftext|> A <|EndOfText|>", "Σ <|ENDOFTEXT|>"):
        assert np.frombuffer(encode(text), encode.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_token_tasks_free_their_tables(spark, messy):
    """Workers are used again: what encoded must not keep its words beside what another operator needs."""
    tokens.write_shards(messy, public_tokenizers.path("word_bpe_49k.json"), work_path(spark, "tokens-test"))

    def held(batches):
        import gc

        yield from ()
        for batch in batches:
            of = [x for x in gc.get_objects() if type(x).__name__ == "_Table"]
            yield batch.from_pydict({"n": [sum(map(len, of))]})

    assert {r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()} == {0}
    assert toxicity.SAMPLE_DOCUMENTS == 12_000


# -- mixture


def filled(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, left, rest, out = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), set(names), {}
    while rest:
        share = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        rest -= set(over)
    return out


def test_mixture(spark, messy, nothing):
    got = mixture.mix(messy, block=16, shard_slots=64).collect()
    rows = [(r.doc_id, r.source, len(split(r.text))) for r in messy.collect()]
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter(rows)
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    target = filled(sizes)
    for s in sizes:
        of = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] for r in of)
        assert abs(sum(r.taken for r in of) - target[s]) <= 0.5
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    again = mixture.mix(messy.repartition(5), block=16, shard_slots=64).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixture.mix(nothing).count() == 0
    assert all(r.target == 0 and r.taken == 0 for r in mixture.mix(messy.withColumn("text", F.lit(" "))).collect())


def test_mixed_documents_hold_what_was_taken(messy, nothing):
    taken = Counter()
    for r in mixture.mix(messy, block=16, shard_slots=64).collect():
        taken[r.doc_id, r.source] += r.taken
    out = mixture.mixed(messy, block=16, shard_slots=64)
    assert out.columns == messy.columns
    words, texts = Counter(), {r.number: r.text for r in messy.collect()}
    for r in out.collect():
        words[r.doc_id, r.source] += len(split(r.text))
        assert r.n_chars == len(r.text) and set(split(r.text)) <= set(split(texts[r.number]))
    assert +words == +taken
    assert mixture.mixed(nothing).count() == 0


# -- licences


def test_licences(spark, messy, nothing):
    s = licences.SENTENCES
    header = [s["apache-header"], s["apache-may-not"], s["apache-copy"]]
    docs = [
        (1, "Some text. " + s["mit-notice"].upper() + " More text", {("MIT", 1, 1, 1)}),
        (2, "a\n" + "\n".join(header) + "\nend", {("Apache-2.0", 1, 3, 3)}),
        (3, "a\n" + "\n".join([header[0], "x", "y", header[1], header[2]]), {("Apache-2.0", 1, 5, 3)}),
        (4, "\n".join([header[0], "x", "y", "z", header[1], header[2]]), {("Apache-2.0", 0, 0, 1)}),
        (5, "\n".join(reversed(header)), {("Apache-2.0", 2, 2, 1)}),
        (6, "All   rights -- reserved!\n\nAll rights reserved.", {("LicenseRef-all-rights-reserved", 0, 0, 1), ("LicenseRef-all-rights-reserved", 1, 1, 1)}),
        (7, "all rights, but not reserved", set()),
        (8, "x\n" + s["gpl-free"] + ": " + s["gpl3-or-later"], {("GPL-3.0-or-later", 1, 2, 2)}),
        (None, s["cc-by-4-notice"], {("CC-BY-4.0", 0, 0, 1)}),
        (9, None, set()),
    ]
    df = spark.createDataFrame([(d, t) for d, t, _ in docs], "doc_id long, text string").withColumn("rule", F.lit("clash"))
    got = {tuple(r) for r in licences.scan(df).collect()}
    assert got == {(d, *x) for d, _, of in docs for x in of}
    assert licences.scan(messy).count() == 0 and licences.scan(nothing).count() == 0
    assert licences.scan(df.unionByName(df)).count() == 2 * len(got)


def test_known_sentences_normalise_to_one(spark):
    """A known sentence must come out of a text as one sentence, the way the table spells it."""
    rows = spark.createDataFrame(list(licences.SENTENCES.items()), "name string, text string")
    for r in rows.select("name", licences.identified(F.col("text")).alias("found")).collect():
        assert [x.id for x in r.found] == [r.name], r.name


def test_wrapped_licences(spark, messy):
    """Sentences over several lines, as real files have them, with comment marks, and what must not be joined."""
    import textwrap

    s = licences.SENTENCES
    wrap = lambda x, width=60, mark="": textwrap.fill(x, width, initial_indent=mark, subsequent_indent=mark, break_long_words=False)
    lines = lambda *names: sum(wrap(s[n]).count("\n") + 1 for n in names)
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + "\n\n".join(wrap(s[n]) + e for n, e in (("mit-grant", ":"), ("mit-condition", ""), ("as-is", "")))
    apache = " * Copyright 2020 Some One\n *\n * Licensed under the Apache License, Version\n * 2.0 (the \"License\");\n * you may not use this file except in\n * compliance with the License.\n * You may obtain a copy\n * of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n *"
    gpl = wrap("This program is free software: " + s["gpl3-or-later"], 60, "# ") + "\r\n#\r\n" + wrap(s["gpl-hope"] + "; without more", 60, "# ")
    bsd = wrap(s["bsd-redistribution"] + ":") + "\n\n1. " + wrap(s["bsd-source"]) + "\n2. " + wrap(s["bsd-binary"]) + "\n3. " + wrap(s["bsd-endorse"]) + "\n"
    docs = [
        (1, mit, {("MIT", 2, 1 + lines("mit-grant", "mit-condition", "as-is"), 3)}),
        (2, apache, {("Apache-2.0", 1, 7, 4)}),
        (3, gpl, {("GPL-3.0-or-later", 0, gpl.count("\n") - 1 + 1, 3)}),
        (4, bsd, {("BSD-3-Clause", 0, 2 + lines("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"), 4)}),
        (5, "\n".join(s["mit-notice"].split()), {("MIT", 0, 4, 1)}),
        (6, "Released under\n\nthe MIT License.", set()),
        (7, "Released under. the MIT License.", set()),
        (8, "It was released under\nthe MIT License.", set()),
        (9, "Released under\nthe MIT License of old", set()),
        (10, "text\nAll rights\nreserved", {("LicenseRef-all-rights-reserved", 1, 2, 1)}),
    ]
    df = spark.createDataFrame([(d, t) for d, t, _ in docs], "doc_id long, text string")
    got = {tuple(r) for r in licences.scan(df).collect()}
    assert got == {(d, *x) for d, _, of in docs for x in of}


def test_licences_of_rows_with_equal_and_null_ids(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\")."
    texts = [f"{apache}\nmore text\n", "plain\n\nAll rights reserved.\n"]
    for ids in ((1, 1), (None, None), (1, 2)):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(2)
        alone = [r.licence for t in texts for r in licences.scan(spark.createDataFrame([(7, t)], "doc_id long, text string")).collect()]
        assert sorted(r.licence for r in licences.scan(df).collect()) == sorted(alone) and "LicenseRef-all-rights-reserved" in alone


# -- classifiers


def test_toxicity(spark, messy, nothing):
    r = np.random.default_rng(6)
    word = lambda n: [f"{x:05d}" for x in r.integers(0, 300, n)]
    docs, labels = [], []
    for i in range(900):
        sentences = [" ".join(word(8)) + "." for _ in range(5)]
        if i % 4 == 0:
            bad = sentences[i % 5].split()
            bad[3] = ["vile", "nasty"][i % 8 // 4]
            sentences[i % 5] = " ".join(bad)
        docs.append((i, " ".join(sentences)))
        labels.append((i, int(i % 4 == 0)))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(df, known)
    got = toxicity.score(df, model).withColumn("held", bucket_of("doc_id", 5) == 0).collect()
    held = [x for x in got if x.held]
    assert len(got) == 900 and np.mean([(x.score >= 0.5) == (x.doc_id % 4 == 0) for x in held]) > 0.95
    for x in held:
        if x.doc_id % 4 == 0 and x.offending:
            worst = max(x.offending, key=lambda o: o.score)
            assert worst.sentence == x.doc_id % 5
            assert re.search("vile|nasty", docs[x.doc_id][1].encode()[worst.start : worst.end].decode())
    kept = toxicity.keep_clean(df.withColumn("score", F.lit("clash")), model)
    assert kept.columns == ["doc_id", "text", "score"] and {x.doc_id for x in kept.collect()} == {x.doc_id for x in got if x.score < 0.5}
    odd = toxicity.score(messy, model).collect()
    assert len(odd) == messy.count() and all(0 <= x.score <= 1 for x in odd)
    assert all(x.score == 0 and not x.offending for x in odd if x.doc_id in (90, 91, 92))
    assert toxicity.score(nothing, model).count() == 0
    blank = toxicity.learn(df, known.where("toxic = 0"))
    assert all(x.score < 1e-6 for x in toxicity.score(df, blank).collect())
    assert toxicity.learn(nothing, known.limit(0)).bias < -50


def test_noisy_or_of_sentences():
    f = toxicity.Features([b"One bad. Two good\nthree", b"", b"bad bad bad"])
    assert np.diff(f.first).tolist() == [3, 0, 1]
    p = np.array([0.5, 0.1, 0.2, 0.3])
    np.testing.assert_allclose(1 - np.exp(f.noisy_or(p)), [1 - 0.5 * 0.9 * 0.8, 0, 0.3])
    model = toxicity.ToxicityModel(np.zeros(1 << toxicity.BUCKET_BITS, np.float32), -1.0)
    assert len(model.sentences(toxicity.Features([b""]))) == 0


def test_language_sets(spark, messy, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs, bucket_of("doc_id", 3) != 1)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(bucket_of("doc_id", 3) == 1)
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    clean = docs.where("length(text) > 400").toPandas().groupby("lang").text.first()
    both = spark.createDataFrame([(1, clean["de"][:400] + " " + clean["fr"][:380]), (2, clean["en"]), (3, "123 !!"), (4, None), (5, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identify(both, model).collect()}
    assert {x.lang for x in found[1].languages} == {"de", "fr"} and abs(sum(x.share for x in found[1].languages) - 1) < 1e-6
    assert [x.lang for x in found[2].languages] == ["en"] and found[2].score > 0.99
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (3, 4, 5))
    assert language.identify(messy, model).count() == messy.count() and language.identify(nothing, model).count() == 0
    none = language.learn(docs, F.lit(False))
    assert {r.lang_pred for r in language.identify(both, none).collect()} == {"und"}


def test_language_sets_of_long_texts():
    """A language of a very small share stays if the likelihood gains more from it than the penalty."""
    teach = [b"abab baba abba", b"xyxy yxyx xyyx", b"cdcd dcdc cddc"]
    counts = np.stack([np.bincount(language.Grams([t]).grams, minlength=1 << language.GRAM_BITS) for t in teach], axis=1)
    model = language.LanguageModel(["aa", "bb", "cc"], np.log((counts + 0.01) / (counts + 0.01).sum(axis=0)))
    texts = [b"abab " * 20_000 + b"xyxy " * 60, b"abab " * 20_000, b"abab " * 100 + b"cdcd " * 100, b""]
    share, active = model.proportions(language.Grams(texts))
    assert active.tolist() == [[True, True, False], [True, False, False], [True, False, True], [False] * 3]
    assert abs(share[0, 1] - 60 / 20_060) < 1e-3


def test_quality(spark, messy, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where(bucket_of("doc_id", 5) == 0)
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in got.collect()]) > 0.95
    odd = quality.score(messy, model).collect()
    assert len(odd) == messy.count() and all(0 < r.score < 1 for r in odd)
    assert quality.score(nothing, model).count() == 0
    plain = quality.learn(docs, labels.limit(0))
    assert all(abs(r.evidence - 0.5) < 1e-9 for r in quality.score(messy, plain).collect())


def test_posteriors_shrink_small_sites(spark):
    r = np.random.default_rng(9)
    rows = [(f"site{s}", f"part{p}", float(np.clip(m + r.normal(0, 0.1), 0.01, 0.99))) for s, m in enumerate(r.uniform(0.2, 0.8, 30)) for p in range(2) for _ in range(1 if s == 0 else 40)]
    rows += [(None, None, 0.9)]
    got = {(x.site, x.part): x for x in quality.posteriors(spark.createDataFrame(rows, "site string, part string, evidence double")).collect()}
    prior = np.mean([e for *_, e in rows])
    means = {k: np.mean([e for s, p, e in rows if (s, p) == k]) for k in got}
    for k, x in got.items():
        assert abs(x.prior - prior) < 1e-9
        low, high = sorted((x.site_posterior, means[k]))
        assert low - 1e-9 <= x.part_posterior <= high + 1e-9
    site = {s: np.mean([e for t, _, e in rows if t == s]) for s in ("site0", "site5")}
    pull = {s: abs(got[s, "part0"].site_posterior - m) / abs(prior - m) for s, m in site.items()}
    assert pull["site0"] > 5 * pull["site5"]
