"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import forget, stored

#: Neighbours of a node that one task takes; the edges of larger hubs are dealt over several.
NEIGHBOURS = 50_000


def _least(edges: DataFrame, hubs: int) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    if hubs > 1:
        least = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(hubs - 1))))
        edges = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(hubs)).cast("int"))
    return edges.join(least, ["u", "_s"] if hubs > 1 else ["u"]).select("u", "v", F.least("u", "_m").alias("m"))


def _hubs(edges: DataFrame) -> int:
    """Into how many parts the largest hub has to be dealt."""
    most = max(edges.groupBy(c).count().agg(F.max("count")).first()[0] or 0 for c in ("u", "v"))
    return -(-most // NEIGHBOURS)


def components(links: DataFrame) -> DataFrame:
    """Links (u, v) of longs to (node, component); the component is its least node.

    Each step is written to the shared folder and its predecessor deleted; the
    number of steps grows with the logarithm of the longest path.
    """
    edges = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    mark, hubs = None, _hubs(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, hubs).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _least(large, hubs)
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, edges = edges, stored(out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "components")
        forget(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
        hubs = _hubs(edges)
