"""Exports: graph JSON, Cypher, policy input, Markdown (SNK-02 to SNK-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = {"commit": "Commit", "file": "File", "dependency": "Dependency", "build": "Build", "layer": "Layer", "image": "Image", "deployment": "Deployment", "container": "Container"}


def graph_nodes_json(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON line for each node, with its number of findings."""
    n = findings.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("findings"))
    attrs = [c for c in nodes.columns if c not in ("id", "kind", "label", "seq")]
    out = nodes.join(n, "id", "left")
    return out.select("id", F.to_json(F.struct("id", "kind", "label", F.struct(*attrs).alias("attrs") if attrs else F.lit(None).alias("attrs"), F.coalesce("findings", F.lit(0)).alias("findings"))).alias("value"))


def graph_edges_json(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct("src", "dst", "rel")).alias("value"))


def _text(c):
    return F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))


def cypher(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """(part, value): statements that rebuild the graph, to be run by part."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("kind"))
    head = nodes.sparkSession.createDataFrame([(0, "CREATE CONSTRAINT artifact_id IF NOT EXISTS FOR (n:Artifact) REQUIRE n.id IS UNIQUE;")], "part int, value string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("MERGE (n:Artifact:"), label, F.lit(" {id: "), _text(F.col("id")), F.lit("}) SET n.`kind` = "), _text(F.col("kind")), F.lit(", n.`label` = "), _text(F.col("label")), F.lit(";")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit("MATCH (a:Artifact {id: "), _text(F.col("src")), F.lit("}), (b:Artifact {id: "), _text(F.col("dst")), F.lit("}) MERGE (a)-[:"), F.upper("rel"), F.lit("]->(b);")).alias("value"))
    f = findings.select(F.lit(3).alias("part"), F.concat(F.lit("MATCH (a:Artifact {id: "), _text(F.col("node_id")), F.lit("}) MERGE (f:Finding {id: "), _text(F.col("id")), F.lit("}) SET f.severity = "), _text(F.col("severity")), F.lit(", f.cve = "), _text(F.col("cve")), F.lit(", f.reachable = "), F.coalesce(F.col("reachable").cast("string"), F.lit("null")), F.lit(" MERGE (f)-[:AFFECTS]->(a);")).alias("value"))
    return head.unionByName(n).unionByName(e).unionByName(f)


def policy_input(run) -> DataFrame:
    """One JSON document of a run (strataflow.operators.graph.Collected) for an external policy engine."""
    from strataflow.operators.graph import first_per

    gather = lambda df, *cols: df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("x"))
    parts = [gather(run.rejected, "env_idx", "reject_reason").withColumnRenamed("x", "rejected"), gather(run.missing_stages(), "stage").withColumnRenamed("x", "missing_stages"),
             gather(run.findings, "id", "node_id", "source", "severity", "title", "cve", "reachable").withColumnRenamed("x", "findings"),
             gather(first_per(run.unmatched, "id"), "id", "cve", "package", "version", "source", "severity").withColumnRenamed("x", "unmatched")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out.select(F.to_json(F.struct("rejected", "missing_stages", "findings", "unmatched"), {"ignoreNullFields": "false"}).alias("value"))


def review_comment(decision: DataFrame) -> DataFrame:
    """Markdown of a decision (verdict, reasons)."""
    line = lambda r: F.concat(F.lit("- **["), r["verdict"], F.lit("] "), r["rule"], F.lit("**: "), F.coalesce(r["msg"], r["finding"], F.lit("")))
    body = F.when(F.size("reasons") == 0, F.lit("No policy violations.")).otherwise(F.array_join(F.transform("reasons", line), "\n"))
    return decision.select(F.concat(F.lit("## Provenance gate: "), F.upper("verdict"), F.lit("\n\n"), body).alias("value"))
