"""Operator 9: mixing sources to target weights by block permutation.

The words of a source, document after document, form a stream that is cut into
blocks of ``block_words``.  Every output slot draws its source, so a shard's
source counts are multinomial; counts beyond a source's quota are cut and
missing ones settled in one last shard.  Slot ``j`` of a source takes block
``perm(j mod n)`` of epoch ``j div n``, where ``perm`` is a keyed swap-or-not
permutation, and blocks are joined to document segments by their index.

DataFrame functions only.  Null and empty texts have size 0 and are never
taken; the null source is a source of its own, ranked last.  Repeated rows are
packed like any others; empty tables give empty results; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import stored, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
BLOCK_WORDS = 64
SLOTS_PER_SHARD = 4096
#: Slots that one task makes.
SLOTS_PER_TASK = 65_536
ROUNDS = 16
SEED = 20240607
#: Documents of a source are laid out bucket after bucket, so that no task sums a whole source.
DOCS_PER_BUCKET = 5000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to sources with rank, weight and target; the table has one row a source.

    Level filling: target = min(most * size, weight * level), where the targets
    sum to ``share`` of all sizes.  This is where resharing the excess by weight ends.
    """
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("source_id", F.row_number().over(by_rank) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("goal") - F.col("capped")) / F.col("rest"))
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("capped"), F.col("level")))).over(everything)["level"])
    return s.select("source_id", "source", "source_size", "weight", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def permuted(index, n, key, rounds=ROUNDS):
    """Keyed permutation of 0..n-1 (swap or not): each round reflects the index or leaves it."""
    def step(x, r):
        other = F.pmod(F.xxhash64(key, r) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index, step)


def layout(docs: DataFrame) -> DataFrame:
    """Adds ``start``, the place of a document's first word in its source's stream.

    ``docs`` has _source_id, doc_id, size, _tie.  Sums run within buckets of
    about DOCS_PER_BUCKET documents, then over the buckets.
    """
    count = docs.groupBy("_source_id").count()
    buckets = count.select(F.max("count").alias("n")).first()["n"] or 1
    n = max(1, -(-buckets // DOCS_PER_BUCKET))
    docs = docs.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_tie"), F.lit(n)))
    sums = docs.groupBy("_source_id", "_bucket").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("_source_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_source_id", "_bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_source_id", "_bucket").orderBy("doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    return docs.join(sums, ["_source_id", "_bucket"]).withColumn("start", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("_bucket", "_base")


def slots(sources: DataFrame, block_words=BLOCK_WORDS, per_shard=SLOTS_PER_SHARD, seed=SEED) -> DataFrame:
    """(shard, source_id, slot, block, words): which block fills each slot and how many of its words."""
    spark = sources.sparkSession
    b = F.lit(block_words)
    s = sources.filter("source_size > 0").withColumn("goal", F.round("target").cast("long"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / b))
    s = s.withColumn("epochs", F.floor(F.col("goal") / F.col("source_size")))
    s = s.withColumn("last", F.col("goal") - F.col("epochs") * F.col("source_size"))
    s = s.withColumn("quota", F.col("epochs") * F.col("blocks") + F.ceil(F.col("last") / b))
    before = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("low", F.coalesce(F.sum("quota").over(before), F.lit(0)))
    s = s.select("source_id", "source_size", "blocks", "epochs", "last", "quota", "low", (F.col("low") + F.col("quota")).alias("high")).filter("quota > 0")
    total = int(s.agg(F.sum("quota")).first()[0] or 0)
    shards = -(-total // per_shard)
    # a slot's draw falls into one source's interval; both sides meet on a piece of the range
    piece = max(1, -(-total // 1024))
    pieces = s.select("source_id", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / piece), F.floor((F.col("high") - 1) / piece))).alias("piece"))
    draws = spark.range(total).select((F.col("id") / per_shard).cast("long").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("draw"))
    draws = draws.withColumn("piece", F.floor(F.col("draw") / piece))
    drawn = draws.join(pieces, "piece").filter("draw >= low AND draw < high").groupBy("shard", "source_id").agg(F.count("*").alias("n"))
    running = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("first", F.coalesce(F.sum("n").over(running), F.lit(0)))
    got = drawn.groupBy("source_id").agg(F.sum("n").alias("got"))
    left = s.join(got, "source_id", "left").select("source_id", "quota", F.coalesce("got", F.lit(0)).alias("got")).filter("got < quota")
    left = left.select(F.lit(shards).cast("long").alias("shard"), "source_id", (F.col("quota") - F.col("got")).alias("n"), F.col("got").alias("first"))
    counts = drawn.select("shard", "source_id", "n", "first").unionByName(left).join(s, "source_id")
    counts = counts.withColumn("n", F.least("n", F.col("quota") - F.col("first"))).filter("n > 0")
    # settled counts may be long: cut them so that no row spreads over more than a shard's slots
    counts = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / per_shard))))
    counts = counts.withColumn("first", F.col("first") + F.col("part") * per_shard).withColumn("n", F.least(F.col("n") - F.col("part") * per_shard, F.lit(per_shard)))
    # a source's shards come from one window; slots and permutations are made by as many tasks as they need
    counts = counts.repartition(max(1, -(-total // SLOTS_PER_TASK)), "source_id", "shard", "part")
    each = counts.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    each = each.withColumn("place", F.pmod("slot", "blocks")).withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")))
    # the last, shorter block of a source keeps its place, which makes the words of any first slots known
    whole = F.col("blocks") - 1
    block = F.when(F.col("place") < whole, permuted(F.col("place"), F.greatest(whole, F.lit(1)), F.hash(F.lit(seed), "source_id", "epoch"))).otherwise(F.col("place"))
    used = F.when(F.col("epoch") < F.col("epochs"), b).otherwise(F.least(b, F.col("last") - F.col("place") * b))
    return each.select("shard", "source_id", "slot", block.alias("block"), used.cast("long").alias("words"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS, block_words=BLOCK_WORDS, per_shard=SLOTS_PER_SHARD, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with size, source_size, target and taken; the mix itself).

    The mix has a row for each piece of a document in a slot: shard, slot,
    source, doc_id, first_word, n_words.
    """
    sized = stored(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("_tie")), "mixing-sizes")
    sources = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mixing-sources")
    known = sources.select(F.col("source_id").alias("_source_id"), F.col("source").alias("_source"), "source_size", "target")
    placed = layout(sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source_size", "target"))
    placed = stored(placed.withColumn("_row", F.monotonically_increasing_id()), "mixing-layout")
    b = F.lit(block_words)
    parts = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
    parts = parts.select("_row", "doc_id", "source", F.col("_source_id").alias("source_id"), "block", "start", F.greatest(F.col("start") - F.col("block") * b, F.lit(0)).alias("from"), F.least(F.col("start") + F.col("size") - F.col("block") * b, b).alias("to"))
    # slots are spread from few rows, which must not be taken for few slots and sent to all tasks
    mix = parts.hint("merge").join(slots(sources, block_words, per_shard, seed), ["source_id", "block"])
    mix = mix.withColumn("n_words", F.least("to", "words") - F.col("from")).filter("n_words > 0")
    mix = mix.select("_row", "shard", "slot", "source", "doc_id", (F.col("block") * b + F.col("from") - F.col("start")).alias("first_word"), "n_words")
    took = mix.groupBy("_row").agg(F.sum("n_words").alias("taken"))
    out = placed.join(took, "_row", "left").join(known, "_source_id")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"), mix.drop("_row")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))[0]
