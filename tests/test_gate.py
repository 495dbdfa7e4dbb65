import json

import pytest
from pyspark.sql import functions as F

from strataflow.gate import backtrack, run_gate
from strataflow.operators import export, policy, traverse
from strataflow.operators.graph import unknown_endpoints
from strataflow.sources import synth
from strataflow.sources.envelopes import NoTrustRoot, concat_envelopes, load_envelopes, to_dsse, verify, write_envelopes

TRUST = {synth.KEYID: synth.KEY}


@pytest.fixture(scope="module")
def popular(spark):
    return spark.createDataFrame([("sqlalchemy", 0), ("click", 1), ("cryptography", 2), ("requests", 3)], "name string, rank long")


RESULTS = {}


def gate(spark, name, popular):
    if name not in RESULTS:
        RESULTS[name] = run_gate(synth.envelopes(spark, synth.SAMPLES[name]), TRUST, popular if name == "lookalike" else None)
    return RESULTS[name]


@pytest.mark.parametrize(("name", "verdict"), [("quiet", "pass"), ("lookalike", "block"), ("exposed", "block"), ("dormant", "warn"), ("edited", "block"), ("omitted", "block")])
def test_scenarios(spark, popular, name, verdict):
    result = gate(spark, name, popular)
    row = result.decision.first()
    assert row["verdict"] == verdict
    text = " ".join(str(r["msg"]) for r in row["reasons"])
    if name == "quiet":
        assert not row["reasons"]
    if name == "edited":
        assert "signature mismatch" in text
    if name == "omitted":
        assert "missing stage scan" in text
    if name == "dormant":
        assert result.run.findings.filter("cve IS NOT NULL").select("reachable").first()[0] is False


def test_origin_and_blast_radius(spark, popular):
    result = gate(spark, "exposed", popular)
    story = backtrack(result, "CVE-2099-1001").first()
    assert story["reachable"] is True and story["services"] == ["billing", "mail", "shop"] and len(story["builds"]) == 3
    commit = result.run.nodes.filter(F.col("id") == story["commit_id"]).first()
    assert commit["pr"] == 103
    assert unknown_endpoints(result.run.nodes, result.run.edges).isEmpty()
    paths = traverse.upstream_paths(result.run.edges, result.run.findings.select(F.col("node_id").alias("id")).distinct(), result.run.nodes.filter("kind = 'commit'"), result.run.nodes.select("id", F.col("commit_seq").alias("seq"))).first()
    assert paths["path"][0] == story["commit_id"]


def test_sql_rules_agree(spark, popular):
    run = gate(spark, "exposed", popular).run
    for name, df in (("findings", run.findings), ("unmatched", run.unmatched), ("rejected", run.rejected), ("missing", run.missing_stages())):
        df.createOrReplaceTempView(name)
    by_sql = sorted(tuple(r) for r in spark.sql(policy.SQL_RULES).collect())
    by_rules = sorted(tuple(r) for r in policy.reasons(run).select("rule", "verdict", "finding").collect())
    assert by_sql == by_rules and by_sql


def test_exports(spark, popular):
    result = gate(spark, "exposed", popular)
    run = result.run
    nodes = [json.loads(r["value"]) for r in export.graph_nodes_json(run.nodes, run.findings).collect()]
    assert sum(n["findings"] for n in nodes) == run.findings.count()
    doc = json.loads(export.policy_input(run).first()[0])
    assert doc["findings"] and doc["missing_stages"] == []
    assert "BLOCK" in export.review_comment(result.decision).first()[0]
    assert export.cypher(run.nodes, run.edges, run.findings).filter("part = 2").count() == run.edges.count()


def test_envelope_files(spark, tmp_path):
    env = synth.envelopes(spark, synth.SAMPLES["quiet"])
    write_envelopes(env, str(tmp_path / "plain"))
    again = load_envelopes(spark, str(tmp_path / "plain"))
    assert again.orderBy("env_idx").select("payload", "sig").collect() == env.orderBy("env_idx").select("payload", "sig").collect()
    dsse = [json.loads(r["value"]) for r in to_dsse(env).collect()]
    (tmp_path / "dsse.json").write_text(json.dumps([*dsse, {"payload_type": "x", "payload": 5, "keyid": "k", "sig": ""}, "odd"]))
    mixed = load_envelopes(spark, str(tmp_path / "dsse.json"), lenient=True)
    seen = verify(mixed, TRUST)
    assert seen.filter("reject_reason IS NULL").count() == len(dsse)
    assert sorted(r[0] for r in seen.filter("reject_reason IS NOT NULL").select("reject_reason").collect())[0].startswith("malformed envelope")
    with pytest.raises(Exception, match="malformed envelope"):
        load_envelopes(spark, str(tmp_path / "dsse.json")).collect()
    with pytest.raises(NoTrustRoot):
        verify(env, {})
    assert verify(env, {"other": b"k"}).filter("reject_reason LIKE 'untrusted%'").count() == env.count()
    both = concat_envelopes(env, env)
    assert both.select("env_idx").distinct().count() == 2 * env.count()


def test_generic_traversal(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = {tuple(r) for r in traverse.closure(edges).collect()}
    assert ("a", "a") in got and ("a", "d") in got and ("x", "y") in got and ("x", "x") not in got
    assert {r[0] for r in traverse.cycle_nodes(edges).collect()} == {"a", "b", "c"}


def test_walks_go_to_the_end(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(12)], "src string, dst string")
    start = spark.createDataFrame([("n00",), ("n05",)], "id string")
    assert traverse.descendants(edges, start).count() == 12 + 7
    assert traverse.ancestors(edges, spark.createDataFrame([("n12",)], "id string")).count() == 12
    seq = spark.createDataFrame([("n00", 1)], "id string, seq long")
    goal, last = spark.createDataFrame([("n00",)], "id string"), spark.createDataFrame([("n12",)], "id string")
    assert len(traverse.upstream_paths(edges, last, goal, seq).first()["path"]) == 13
    with pytest.raises(ValueError, match="over 4 steps"):
        traverse.upstream_paths(edges, last, goal, seq, 4)
    assert traverse.upstream_paths(edges, last.limit(0), goal, seq).count() == 0
    nodes = spark.createDataFrame([("n11", "image", "i"), ("n12", "container", "c")], "id string, kind string, label string")
    assert traverse.blast_radius(nodes, edges, start.limit(1)).first()["containers"] == ["c"]


def test_made_releases(spark):
    release = synth.made_release(4, 23)
    events = synth.release_events(spark, release)
    assert events.groupBy("stage").count().filter("stage <> 'commit' AND count <> 4").isEmpty() and events.count() == 17
    assert events.select("env_idx").distinct().count() == 17
    build = json.loads(events.filter("stage = 'build'").first()["payload"])
    assert len(build["payload"]["sbom"]["artifacts"]) == 23 and list(build) == sorted(build)
