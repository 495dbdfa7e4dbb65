"""Graph traversal (TRV-01, TRV-02, TRV-04 to TRV-08, GRA-11).

Where the longest path is known, as between the kinds of the provenance model, a
closure is a chain of joins.  Other graphs are walked level by level until no
node is new; each level is written to the shared checkpoint folder, which cuts
the lineage and survives lost executors.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps after which a walk is given up with an error.
MOST_STEPS = 1000


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strataflow-"))
    return df.checkpoint()


def descendants(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node): all nodes below, or those within ``depth`` steps; repeated nodes are dropped at every step."""
    if depth is None:
        return closure(edges, start)
    hop = edges.select(F.col("src").alias("node"), "dst").distinct()
    frontier = start.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    levels = []
    for _ in range(depth):
        frontier = frontier.join(hop, "node").select("start", F.col("dst").alias("node")).distinct()
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.distinct()


def ancestors(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    return descendants(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, depth)


def closure(edges: DataFrame, start: DataFrame | None = None, most: int = MOST_STEPS) -> DataFrame:
    """(start, node) for any graph, cyclic ones too; the start is included only if a cycle leads back."""
    hop = edges.select(F.col("src").alias("node"), "dst").distinct()
    seeds = edges.select(F.col("src").alias("id")).distinct() if start is None else start.select("id").distinct()
    reached = new = checkpointed(seeds.join(hop, F.col("id") == F.col("node")).select(F.col("id").alias("start"), F.col("dst").alias("node")).distinct())
    for _ in range(most):
        new = checkpointed(new.join(hop, "node").select("start", F.col("dst").alias("node")).distinct().join(reached, ["start", "node"], "left_anti"))
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
    raise ValueError(f"paths of over {most} steps")


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle: what is left when nodes without incoming or outgoing edges are peeled off."""
    left = edges.select("src", "dst").distinct()
    while True:
        inner = left.select(F.col("src").alias("id")).intersect(left.select(F.col("dst").alias("id")))
        kept = checkpointed(left.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        n, before = kept.count(), left.count()
        left = kept
        if n == before or n == 0:
            return left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()


def newest_parent(edges: DataFrame, seq: DataFrame) -> DataFrame:
    """(dst, src): of several parents the newest by seq, those without one last, then the least id (TRV-02)."""
    w = Window.partitionBy("dst").orderBy(F.col("seq").desc_nulls_last(), "src")
    return edges.join(seq, edges["src"] == seq["id"], "left").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("dst", "src")


def upstream_paths(edges: DataFrame, start: DataFrame, goal: DataFrame, seq: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """(id, path): shortest path up to a goal node, origin first; among equals the newest origin."""
    up = edges.select(F.col("dst").alias("at"), F.col("src").alias("next")).distinct()
    rank = seq.select(F.col("id").alias("at"), "seq")
    goals = goal.select(F.col("id").alias("at"), F.lit(True).alias("goal"))
    paths = start.select("id", F.col("id").alias("at"), F.array("id").alias("path"))
    done = [start.select("id", F.array("id").alias("path")).limit(0)]
    for step in range(most + 1):
        w = Window.partitionBy("id").orderBy(F.col("seq").desc_nulls_last(), "at")
        level = checkpointed(paths.join(goals, "at", "left").join(rank, "at", "left"))
        if level.isEmpty():
            break
        if step == most:
            raise ValueError(f"paths of over {most} steps")
        hit = level.filter("goal").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("id", "path")
        done.append(hit)
        seen = Window.partitionBy("id", "at").orderBy(F.col("path"))
        paths = level.join(hit.select("id"), "id", "left_anti").join(up, "at").filter(~F.array_contains("path", F.col("next")))
        paths = paths.select("id", F.col("next").alias("at"), F.array_prepend("path", F.col("next")).alias("path"))
        paths = paths.withColumn("_n", F.row_number().over(seen)).filter("_n = 1").drop("_n")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def blast_radius(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """For each start: sorted images and containers (repeated labels kept), sorted distinct services."""
    kinds = nodes.select(F.col("id").alias("node"), "kind", "label")
    reach = descendants(edges, start).join(kinds, "node")
    of = lambda kind: F.when(F.col("kind") == kind, F.col("label"))
    found = reach.groupBy("start").agg(F.array_sort(F.collect_list(of("image"))).alias("images"), F.array_sort(F.collect_set(of("deployment"))).alias("services"), F.array_sort(F.collect_list(of("container"))).alias("containers"))
    out = start.select(F.col("id").alias("start")).distinct().join(found, "start", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("start").alias("id"), *[F.coalesce(c, none).alias(c) for c in ("images", "services", "containers")])


def layer_blast_radius(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """Blast radius of the first layer whose digest begins so; fails if there is none."""
    layer = nodes.filter((F.col("kind") == "layer") & F.col("digest").startswith(prefix)).orderBy("seq", "id").limit(1)
    if layer.isEmpty():
        raise KeyError(prefix)
    return blast_radius(nodes, edges, layer)


def origin_story(findings: DataFrame, nodes: DataFrame, edges: DataFrame, seq: DataFrame, query: str) -> DataFrame:
    """Findings by CVE, id or package name with commit, its builds and blast radius."""
    names = nodes.select(F.col("id").alias("node_id"), "name")
    q = F.lit(query.lower())
    hits = findings.join(names, "node_id", "left").filter((F.lower(F.coalesce("cve", F.lit(""))) == q) | (F.lower("id") == q) | (F.lower("name") == q))
    parents = newest_parent(edges.filter(F.col("rel").isin("introduced", "modifies")), seq).select(F.col("dst").alias("node_id"), F.col("src").alias("commit_id"))
    builds = edges.filter("rel = 'built_by'").groupBy(F.col("src").alias("commit_id")).agg(F.array_sort(F.collect_list("dst")).alias("builds"))
    radius = blast_radius(nodes, edges, hits.select(F.col("node_id").alias("id"))).withColumnRenamed("id", "node_id")
    return hits.join(parents, "node_id", "left").join(builds, "commit_id", "left").join(radius, "node_id", "left")


def shared_layers(edges: DataFrame) -> DataFrame:
    """Layers of several images."""
    n = edges.filter("rel = 'layer_of'").groupBy(F.col("src").alias("layer")).agg(F.countDistinct("dst").alias("n_images"))
    return n.filter("n_images > 1")
