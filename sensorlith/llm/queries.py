"""The registered queries of the operators for training data, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from zlib import crc32

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlith.llm import cosines, decontaminate, jaccard, language, licences, mixture, neighbours, periods, quality, repeats, tokens, toxicity, tries
from sensorlith.llm.frames import bucket_of
from sensorlith.session import prepare, work_path

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        LLM_QUERIES[name] = run
        if oracle:
            LLM_ORACLES[name] = oracle
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by sentences; the model has seen no held-out label."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    worst = F.array_max(F.transform("offending", lambda x: F.struct(x["score"], x["sentence"])))
    return scored.select(
        "doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"), worst["sentence"].alias("worst_sentence"),
    )  # fmt: skip


@_query(
    "op2_ngram_jaccard",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id""",
)
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@_query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for hosts, their languages for paths: documents have no address."""
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "evidence", "site_posterior", "part_posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query("op4_token_ids")
def op4_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    folder = work_path(spark, "tokens")
    shards = tokens.write_shards(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), folder)
    return tokens.read_documents(shards, folder)


@_query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.Index(vectors).search(vectors.where("vec_id % 20 = 0"), 20)


@_query("op7_source_mixture")
def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_table(spark, sf_dir, "documents")).drop("source")


@_query(
    "op8_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE r > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _licence_sql() -> str:
    """The same scan in SQL, over the same fixed sentences and rules."""
    text = lambda x: "'" + x.replace("'", "''") + "'"  # noqa: E731
    known = ", ".join(f"({text(licences._normal(s))}, {text(n)})" for n, s in licences.SENTENCES.items())
    rules = ", ".join(f"({text(n)}, [{', '.join(map(text, r))}])" for n, of in licences.RULES.items() for r in of)
    return rf"""
WITH k(norm, id) AS (VALUES {known}), r(licence, rule) AS (VALUES {rules}),
rr AS (SELECT licence, rule, unnest(rule) AS id, unnest(range(len(rule))) AS i FROM r),
d AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.!?;:]+[ 	
]+', chr(10), 'g'), '[^a-z0-9
]+', ' ', 'g'), ' ?
[ 
]*') AS s FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(s) AS t, unnest(range(len(s))) AS place FROM d),
f AS (SELECT doc_id, place, id, row_number() OVER w AS p, place - lag(place) OVER w AS gap FROM x JOIN k ON trim(t) = norm WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
m AS (SELECT a.doc_id, rr.licence, min(b.place) AS first_sentence, max(b.place) AS last_sentence, count(*) AS sentences
      FROM f a JOIN rr o ON o.i = 0 AND o.id = a.id JOIN rr ON rr.licence = o.licence AND rr.rule = o.rule
      JOIN f b ON b.doc_id = a.doc_id AND b.p = a.p + rr.i AND b.id = rr.id AND (rr.i = 0 OR b.gap <= {licences.GAP + 1})
      GROUP BY a.doc_id, a.p, rr.licence, rr.rule HAVING count(*) = len(rr.rule))
SELECT doc_id, licence, first_sentence::INTEGER AS first_sentence, last_sentence::INTEGER AS last_sentence, sentences::INTEGER AS sentences FROM m
WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.first_sentence <= m.first_sentence AND o.last_sentence >= m.last_sentence AND o.sentences > m.sentences)"""


@_query("op9_licence_scan", _licence_sql())
def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


@_query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs, bucket_of("doc_id", 3) != 1))
    return found.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", F.transform("languages", lambda x: x["lang"]).alias("languages"))


#: crc32 of the decimal of a number, byte by byte and bit by bit
_CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""


@_query(
    "op11_conversation_trie",
    rf"""
WITH d AS (SELECT conv_id, turn, md5(length(role)::VARCHAR || ':' || role || text) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
t AS (SELECT conv_id, d, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS p FROM d),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS src, {_CRC_SQL.format("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, p, d, w FROM c JOIN t ON t.conv_id = src AND p <= h UNION ALL SELECT c.conv_id, p, d, w FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
s AS (SELECT c.conv_id, coalesce(string_agg(d, '' ORDER BY p), '') AS path, list(w ORDER BY p) AS ws, count(p) AS k FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
x AS (SELECT conv_id, path, ws, unnest(range(k + 1)) AS depth FROM s),
n AS (SELECT left(path, 32 * depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END) AS w FROM x GROUP BY ALL),
k AS (SELECT left(node, 32 * (depth - 1)) AS node, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
o AS (SELECT node, depth, (n_convs - 1) * w AS saved, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf FROM n LEFT JOIN k USING (node)),
u AS (SELECT left(node, 32 * a) AS node, sum(saved) AS saved, sum(leaf) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS a FROM o) GROUP BY 1),
e AS (SELECT path AS node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM s GROUP BY path)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n JOIN u USING (node) LEFT JOIN k USING (node) LEFT JOIN e USING (node) LEFT JOIN n q ON n.depth > 0 AND q.node = left(n.node, 32 * (n.depth - 1))""",
)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that begin with up to three turns of the first one of their twenty."""
    convs = tries.turns_in_order(_table(spark, sf_dir, "conversations"))
    opened = tries.with_openings(convs, F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string")) % 4, 3)
    return tries.prefix_trie(opened)


def _planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the documents, words that repeat from a place on: which original word stands at each place."""
    h = None if doc_id is None else crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


@_query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which repeat their last part."""
    return periods.run_digests(_table(spark, sf_dir, "documents"), _planted)


@_query(
    "op13_embedding_dedup",
    """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(x) > 0
  AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS low FROM r GROUP BY a), k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, least(v.vec_id, c.low) AS component_id, v.vec_id <= coalesce(c.low, v.vec_id) AS kept
FROM v LEFT JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)""",
)
def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosines.near_duplicates(_table(spark, sf_dir, "embeddings"))
