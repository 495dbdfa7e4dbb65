"""Operator 5: benchmark decontamination by size-partitioned MinHash containment.

Test items are partitioned by the logarithm of their number of shingles.  Each
partition has its sketch size and the matches that make a candidate: an item's
sketch is its least shingle hashes, and an item of which a document contains
the share ``CONTAINMENT`` has each of them there with that probability.
Candidates are verified by the exact number of shared five-word shingles, so
short items are found inside documents of any length.

DataFrame functions only.  Words are lower-case runs of letters and digits.  A
text of one to four words has one shingle, all its words; null and empty texts
have none and neither contain nor are contained.  Repeated shingles count once,
rows that repeat a doc_id or item_id are one document or item with the shingles
of all; null ids never match.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import stored, table

WIDTH = 5
CONTAINMENT = 0.8
#: (items with fewer shingles than this, sketch size, matches that make a candidate)
PARTITIONS = ((32, 16, 1), (256, 20, 2), (2048, 24, 2), (math.inf, 32, 3))
#: Rows of sketches, item shingles or ids (about 24 bytes each) that are sent to all tasks; more are joined by a shuffle.
MOST_BROADCAST = 500_000


def few(df: DataFrame, n: int) -> DataFrame:
    """The rows to be joined, sent to all tasks if there are at most MOST_BROADCAST of them."""
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def shingle_words(text):
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def shingles(words, width: int = WIDTH):
    """Hashes of all shingles of a column of words, repeated ones included."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(n >= width, each).when(n > 0, F.array(F.xxhash64(F.array_join(words, " "), F.lit(width)))).otherwise(F.array().cast("array<bigint>"))


def sketches(items: DataFrame) -> DataFrame:
    """item_id, shingles (distinct), size, least hashes and matches of a candidate."""
    w = items.filter("item_id IS NOT NULL").select("item_id", shingle_words(F.col("text")).alias("w"))
    # rows that repeat an id become one item with the shingles of all
    s = w.select("item_id", F.explode(shingles(F.col("w"))).alias("h")).groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("shingles"))
    s = s.withColumn("size", F.size("shingles"))
    sketch, needs = F.lit(PARTITIONS[-1][1]), F.lit(PARTITIONS[-1][2])
    for below, k, r in reversed(PARTITIONS[:-1]):
        sketch, needs = F.when(F.col("size") < below, F.lit(k)).otherwise(sketch), F.when(F.col("size") < below, F.lit(r)).otherwise(needs)
    return s.withColumn("sketch", F.slice("shingles", F.lit(1), sketch)).withColumn("needs", F.least(needs, F.col("size")))


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shingles of the item, n_shared, for each item of which the document holds the share ``containment``."""
    index = stored(sketches(items), "benchmark-sketches")
    n_sketch, n_shingles = index.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    least = few(index.select("item_id", "needs", F.explode("sketch").alias("h")), n_sketch)
    whole = few(index.select("item_id", "size", F.explode("shingles").alias("h")), n_shingles)
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    own = lambda t: t.select("doc_id", shingle_words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(shingles(F.col("w")))).alias("h"))
    seen = texts.select("doc_id", shingle_words(F.col("text")).alias("w")).select("doc_id", F.explode(shingles(F.col("w"))).alias("h"))
    # repeated shingles of a document may make a candidate more, which the exact count leaves out
    pairs = stored(seen.join(least, "h").groupBy("doc_id", "item_id", "needs").count().filter(F.col("count") >= F.col("needs")).select("doc_id", "item_id"), "benchmark-candidates")
    asked = stored(pairs.select("doc_id").distinct(), "benchmark-asked")
    # only the texts of candidates are read again; shingles of document and item meet row by row
    held = own(texts.join(few(asked, asked.count()), "doc_id", "left_semi")).distinct()
    wanted = pairs.join(whole, "item_id")
    shared = wanted.join(held, ["doc_id", "h"]).groupBy("doc_id", "item_id", F.col("size").cast("long").alias("n_shingles")).agg(F.count("*").alias("n_shared"))
    return shared.filter(F.col("n_shared") >= F.col("n_shingles") * containment)


def remove_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that contain no item; rows without a doc_id stay."""
    gone = stored(contained_items(docs, items, containment).select("doc_id").distinct(), "benchmark-gone")
    return docs.join(few(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
iw AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN w[1] <> '' THEN ['= ' || array_to_string(w, ' ')] ELSE [] END) AS s FROM dw),
i_s AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN w[1] <> '' THEN ['= ' || array_to_string(w, ' ')] ELSE [] END) AS s FROM iw),
n AS (SELECT item_id, count(*) AS n_shingles FROM i_s GROUP BY item_id)
SELECT doc_id, item_id, n_shingles::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared
FROM ds JOIN i_s USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= n_shingles * 0.8
"""
