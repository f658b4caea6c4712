"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, its documents one after another, are cut into blocks of ``block`` words. Output shards of
``shard_slots`` slots draw their source counts from the multinomial of the target shares, one pseudorandom number
for each slot. The slots of a source are numbered through all shards; slot ``j`` takes block ``perm(j mod n)`` of
the source's ``n`` blocks, where ``perm`` is a pseudorandom permutation for each source and round (swap-or-not: it
needs no table and works for any ``n``). Slots and documents' pieces meet in a join by block number.

Draws that go beyond a source's target are left out, and a last shard settles what the draws left open, so that
each source gives the words of its target to the word: its last slot takes part of a block.

Nothing is ordered in one task but the table of sources: documents get their place in the source through buckets
of documents, and a source of any share is spread over them.

Results in special cases: a null source is a source of its own, the last one; null texts and those without
words have size 0 and are never taken; repeated rows are documents of their own (ties in the order within a
source go by a hash of the text); null ids come first; if all sizes are 0, all targets are. Extra columns are
not read by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlith.llm.frames import stored

WEIGHTS = (5, 2, 1)
SEED = 20_011
ROUNDS = 24
_KEY = ["doc_id", "source", "text_hash"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts: Column | int) -> Column:
    return F.xxhash64(F.lit(SEED), *(F.lit(p) if isinstance(p, int) else p for p in parts))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 .. n-1 that ``key`` chooses."""

    def swap(at: Column, turn: Column) -> Column:
        partner = F.pmod(F.pmod(_hash(*key, turn), n) - at, n)
        return F.when(F.pmod(_hash(*key, turn, F.greatest(at, partner)), F.lit(2)) == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap)


def targets(sizes: DataFrame, total_share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, sid, source_size, target. Sources by code point, null last, weigh ``weights`` again and again and share
    ``total_share`` of all words; no target is above ``most`` times its source, the rest goes to the others by weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(most))
    # sources reach their limit in the order of limit / weight; a level between two of these ratios fills the rest
    ratio = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("goal", F.sum("source_size").over(every) * F.lit(total_share))
    rows = rows.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    rows = rows.withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("goal") - F.col("full")) / F.col("left"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    rows = rows.withColumn("level", F.min_by(fits, F.when(fits.isNotNull(), F.col("most") / F.col("weight"))).over(every))
    target = F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "sid", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


class Plan:
    """Which words of which documents the mix takes."""

    def __init__(self, docs: DataFrame, block: int = 256, shard_slots: int = 16_384, bucket_rows: int = 20_000) -> None:
        self.block, self.shard_slots = block, shard_slots
        sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
        sized = stored(sized, "sizes")
        buckets = max(1, 1 << int(sized.count() // bucket_rows).bit_length())
        self.sources = stored(targets(sized), "sources")
        sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
        sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        to_here = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("first", F.sum("words").over(to_here) - F.col("words")).drop("words")
        sums = sums.join(self.sources, sums["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        in_bucket = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
        sized = sized.withColumn("place", F.coalesce(F.sum("size").over(in_bucket), F.lit(0).cast("long")))
        there = sized["source"].eqNullSafe(sums["source"]) & (sized["bucket"] == sums["bucket"])
        #: documents with the place of their first word in the source
        self.docs = sized.join(sums, there).select(sized["doc_id"], sized["source"], "text_hash", "size", "sid", "source_size", "target", (F.col("place") + F.col("first")).alias("place"))

    def slots(self) -> DataFrame:
        """sid, block (its number), times (round from 0), take (words of it): a row for each slot that takes words."""
        size = F.lit(self.block)
        s = self.sources.where("source_size > 0 AND target > 0")
        s = s.withColumn("blocks", F.ceil(F.col("source_size") / size)).withColumn("quota", F.round("target").cast("long"))
        s = s.withColumn("whole", F.expr("quota div source_size")).withColumn("rest", F.col("quota") % F.col("source_size"))
        # one slot more than the rest needs if all blocks were whole: the short last block may be among them
        s = s.withColumn("needed", F.col("whole") * F.col("blocks") + F.least("blocks", F.ceil(F.col("rest") / size) + F.when(F.col("rest") > 0, 1).otherwise(0)))
        every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        share = F.col("needed") / F.sum("needed").over(every)
        s = s.withColumn("high", F.sum(share).over(Window.orderBy("sid"))).withColumn("low", F.lag("high", 1, 0.0).over(Window.orderBy("sid")))
        s = s.withColumn("high", F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), F.lit(1.0)).otherwise(F.col("high")))
        s = stored(s, "quotas")
        slots = s.agg(F.sum("needed")).first()[0] or 0
        shards = -(-slots // self.shard_slots)
        # multinomial draws: a number in 0 .. 1 falls into one source's part; both are joined by a grid cell
        spark, grid = s.sparkSession, 1 << 12
        draw = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(self.shard_slots - 1))).alias("slot"))
        draw = draw.withColumn("u", F.shiftrightunsigned(_hash(F.col("shard"), F.col("slot")), 11) / F.lit(float(1 << 53)))
        draw = draw.withColumn("cell", F.floor(F.col("u") * grid))
        parts = s.select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * grid), F.least(F.floor(F.col("high") * grid), F.lit(grid - 1)))).alias("cell"))
        drawn = draw.join(parts, "cell").where("u >= low AND u < high").groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("count"))
        drawn = stored(drawn, "draws")
        by_shard = Window.partitionBy("sid").orderBy("shard")
        runs = drawn.withColumn("first", F.sum("count").over(by_shard) - F.col("count")).join(s.select("sid", "needed"), "sid")
        runs = runs.select("sid", "first", F.least(F.col("first") + F.col("count"), F.col("needed")).alias("end"))
        settled = s.join(drawn.groupBy("sid").agg(F.sum("count").alias("drawn")), "sid", "left")
        settled = settled.select("sid", F.coalesce("drawn", F.lit(0).cast("long")).alias("first"), F.col("needed").alias("end"))
        runs = runs.unionByName(settled).where("first < end").repartition(max(1, min(shards, 4096)), "sid", "first")
        j = runs.select("sid", F.explode(F.expr("sequence(first, end - 1)")).alias("j")).join(s, "sid")
        j = j.withColumn("times", F.expr("j div blocks"))
        j = j.withColumn("block", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("sid"), F.col("times")))
        j = stored(j.select("sid", "j", "times", "block", "blocks", "whole", "rest", "source_size"), "slots")
        # in the last round, words before a slot: whole blocks, less what the short block lacks
        lacks = F.col("blocks") * size - F.col("source_size")
        short = j.where("times = whole AND block = blocks - 1").groupBy("sid").agg(F.min(F.col("j") % F.col("blocks")).alias("short_at"))
        j = j.join(short, "sid", "left").withColumn("k", F.col("j") % F.col("blocks"))
        length = size - F.when(F.col("block") == F.col("blocks") - 1, lacks).otherwise(0)
        done = F.col("k") * size - F.when(F.col("short_at") < F.col("k"), lacks).otherwise(0)
        take = F.when(F.col("times") < F.col("whole"), length).otherwise(F.greatest(F.least(length, F.col("rest") - done), F.lit(0)))
        return j.select("sid", "block", "times", "whole", take.alias("take")).where("take > 0")

    def pieces(self) -> DataFrame:
        """Documents' pieces with the slots that take their block: begin and length of the piece in the document, and in ``got``
        how many of its words the slot takes."""
        size = F.lit(self.block)
        last = F.col("place") + F.col("size") - 1
        cut = self.docs.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("place") / size), F.floor(last / size)))))
        start = F.greatest(F.col("place"), F.col("block") * size)
        end = F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * size)
        cut = cut.select(*self.docs.columns, "block", (start - F.col("place")).alias("begin"), (end - start).alias("length"), (start - F.col("block") * size).alias("in_block"))
        rows = cut.join(self.slots().hint("merge"), ["sid", "block"], "left")  # both grow with the words
        return rows.withColumn("got", F.greatest(F.least(F.col("length"), F.coalesce("take", F.lit(0)) - F.col("in_block")), F.lit(0)))


def mix(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, source, size, source_size, target (both of the source) and taken (words, repeats counted) for each document."""
    rows = Plan(docs, **sizes).pieces()
    rows = rows.groupBy("sid", "place", "doc_id", "source", "text_hash", "size", "source_size", "target").agg(F.sum("got").alias("taken"), F.count(F.lit(1)).alias("n"))
    # documents without words share their place: a row each
    rows = rows.withColumn("row", F.explode(F.when(F.col("size") > 0, F.array(F.lit(1))).otherwise(F.array_repeat(F.lit(1), F.col("n").cast("int")))))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed(docs: DataFrame, **sizes: int) -> DataFrame:
    """The documents that the mix takes, with their columns: ``text`` as often as it is taken whole, one after another
    in lines of their own, then the words of a last part, joined by spaces; ``n_chars`` follows."""
    rows = Plan(docs, **sizes).pieces().where("got > 0")
    part = F.when(F.col("times") == F.col("whole"), F.struct("begin", F.col("got").alias("length")))
    taken = rows.groupBy("sid", "place", *_KEY, "size", "whole").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    same = Window.partitionBy(*_KEY).orderBy(F.lit(1))
    taken = taken.withColumn("number", F.row_number().over(same)).select(*(F.col(k).alias(f"t_{k}") for k in [*_KEY, "number"]), "whole", "parts")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = rows.withColumn("number", F.row_number().over(same))
    on = F.col("number") == F.col("t_number")
    for k in _KEY:
        on = on & F.col(k).eqNullSafe(F.col(f"t_{k}"))
    rows = rows.join(taken, on)
    words = F.filter(F.split("doc.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p["begin"] + 1).cast("int"), p["length"].cast("int")))), " ")
    copies = F.array_repeat(F.col("doc.text"), F.col("whole").cast("int"))
    rows = rows.withColumn("text", F.array_join(F.concat(copies, F.when(F.size("parts") > 0, F.array(cut)).otherwise(F.array().cast("array<string>"))), "\n"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*(new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns))
