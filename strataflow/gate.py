"""The gate from envelopes to a verdict (SNK-11) and its command line (SNK-07)."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.names import squat_normalize
from strataflow.operators import enrich, export, policy, traverse, typosquat
from strataflow.operators.graph import Collected, collect_events
from strataflow.sources.envelopes import load_envelopes, trust_from_environment, verify


@dataclass
class GateResult:
    run: Collected
    decision: DataFrame


def run_gate(envelopes: DataFrame, trusted: dict[str, bytes], popular: DataFrame | None = None, denied: DataFrame | None = None, static_report: DataFrame | None = None, rules=None) -> GateResult:
    """Verify, build the graph, enrich and decide; the decision is lazy."""
    run = collect_events(verify(envelopes, trusted))
    deps = run.nodes.filter("kind = 'dependency'")
    found = run.findings
    if popular is not None or denied is not None:
        names = deps.filter("ecosystem = 'pypi'").select("name").distinct()
        none = found.sparkSession.createDataFrame([], "name string, score double")
        squats = typosquat.best_matches(names, popular).select("name", "score") if popular is not None else none
        risks = enrich.name_risk(names, denied if denied is not None else none, none, squats).withColumn("ecosystem", F.lit("pypi"))
        hits = enrich.risk_findings(deps, risks)
        extra = hits.select("id", "node_id", "source", "severity", F.concat(F.lit("suspicious name, risk "), F.col("risk").cast("string")).alias("title"), F.lit(None).cast("string").alias("cve"), F.array().cast("array<string>").alias("evidence"), F.lit(1 << 60).cast("long").alias("seq"), F.lit(None).cast("boolean").alias("reachable"))
        found = found.unionByName(extra)
    modules = deps.filter("import_name IS NOT NULL").select(F.col("id").alias("node_id"), "import_name")
    seen = enrich.runtime_reachability(found.filter("source <> 'risk'"), run.edges, modules, run.runtime)
    if static_report is not None:
        seen = enrich.merge_static(seen, static_report)
    run = replace(run, findings=traverse.checkpointed(seen.unionByName(found.filter("source = 'risk'"))))
    return GateResult(run, policy.decide(policy.reasons(run, rules)))


def backtrack(result: GateResult, query: str) -> DataFrame:
    nodes = result.run.nodes
    return traverse.origin_story(result.run.findings, nodes, result.run.edges, nodes.select("id", F.col("commit_seq").alias("seq")), query)


def main(argv: list[str] | None = None) -> int:
    """gate, backtrack, blast, cypher and comment over an envelope file; 0 passed, 1 blocked, 2 failed."""
    parser = argparse.ArgumentParser(prog="strataflow")
    parser.add_argument("command", choices=("gate", "backtrack", "blast", "cypher", "comment"))
    parser.add_argument("events")
    parser.add_argument("--query", default="")
    parser.add_argument("--trust", action="append", default=[], metavar="KEYID=VARIABLE")
    parser.add_argument("--popular", help="text file of names, most popular first")
    a = parser.parse_args(argv)
    try:
        spark = SparkSession.builder.getOrCreate()
        trusted = trust_from_environment(dict(t.split("=", 1) for t in a.trust))
        popular = None
        if a.popular:
            lines = spark.read.text(a.popular, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("rank", "name"))
            popular = lines.select(squat_normalize(F.col("name")).alias("name"), F.col("rank").cast("long")).filter("name <> ''")
        result = run_gate(load_envelopes(spark, a.events, lenient=True), trusted, popular)
        run = result.run
        if a.command in ("gate", "comment"):
            row = result.decision.first()
            text = export.review_comment(result.decision).first()[0] if a.command == "comment" else f"{row['verdict']}: {len(row['reasons'])} reasons"
            print(text)
            return int(row["verdict"] == "block")
        out = {"backtrack": lambda: backtrack(result, a.query), "blast": lambda: traverse.blast_radius(run.nodes, run.edges, run.nodes.filter((F.col("id") == a.query) | (F.col("label") == a.query))), "cypher": lambda: export.cypher(run.nodes, run.edges, run.findings).orderBy("part", "value").select("value")}[a.command]()
        for line in out.toJSON().toLocalIterator() if a.command != "cypher" else (r["value"] for r in out.toLocalIterator()):
            print(line)
        return 0
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
