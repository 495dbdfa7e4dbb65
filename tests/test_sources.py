import json
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from strataflow.operators import enrich, history, reach
from strataflow.sources import git, lists, lockfiles, reports

LOCKS = {
    "requirements.txt": ("a==1.0 # why\n# b==2\n-r other\nB_c[x]===3.1 ; python_version\na == 2.0\n", [("b-c", "3.1"), ("a", "2.0")]),
    "poetry.lock": ('[[package]]\nname = "A.B"\nversion = "1"\n[package.x]\nversion = "9"\n[[package]]\nversion = "2"\nname = "c"\n', [("a-b", "1"), ("c", "2")]),
    "package-lock.json": ('{\n  "packages": {\n    "": {\n      "version": "0"\n    },\n    "node_modules/@S/X": {\n      "version": "1.0.0"\n    },\n    "node_modules/y/node_modules/z": {\n      "version": "2.0.0"\n    }\n  }\n}', [("@s/x", "1.0.0"), ("z", "2.0.0")]),
    "npm-shrinkwrap.json": (json.dumps({"dependencies": {"A": {"version": "1", "dependencies": {"b": {"version": "2"}}}, "c": {"version": "3"}}}), [("a", "1"), ("b", "2"), ("c", "3")]),
    "yarn.lock": ('# c\n"@s/x@^1", "@s/x@^1.1":\n  version "1.2.0"\n  resolved "u"\n\n__metadata:\n  version: 6\n\n"w@workspace:.":\n  version: 0.0.0-use.local\n\nz@npm:2:\n  version: 2.1.0\n', [("@s/x", "1.2.0"), ("z", "2.1.0")]),
    "pnpm-lock.yaml": ("lockfileVersion: 5\npackages:\n\n  /a/1.0.0_b@2:\n    x: 1\n  '@s/y@2.0.0(z@1)':\n    x: 1\n  file:local:\n    x: 1\nother:\n  /q/9.0.0:\n", [("a", "1.0.0"), ("@s/y", "2.0.0")]),
    "go.mod": ("module m\nrequire x.com/a v1.0.0 // indirect\nrequire (\n\ty.org/b v0.2.0\n\tnodots v1.0.0\n)\nreplace (\n\tq.com/z v1.0.0\n)\n", [("x.com/a", "v1.0.0"), ("y.org/b", "v0.2.0")]),
    "go.sum": ("m.com/a v1.9.0 h1:x\nm.com/a v1.10.0 h1:y\nm.com/a v1.11.0/go.mod h1:z\n", [("m.com/a", "v1.10.0")]),
    "Cargo.lock": ('[[package]]\nname = "Serde"\nversion = "1.0.1"\n', [("serde", "1.0.1")]),
}


@pytest.mark.parametrize("name", LOCKS)
def test_lock_formats(name):
    text, want = LOCKS[name]
    assert [p[:2] for p in lockfiles.read_pins(f"x/{name}", text)] == want


def test_lock_edge_cases(spark):
    assert lockfiles.read_pins("package-lock.json", "{broken") == [] and lockfiles.read_pins("yarn.lock", None) == []
    rows = [(i, n, t) for i, (n, (t, _)) in enumerate(LOCKS.items())] + [(99, "go.mod", None)]
    df = spark.createDataFrame(rows, "id int, path string, text string")
    got = lockfiles.pins(df).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {i: len(w) for i, (_, w) in enumerate(LOCKS.values())}
    built_in = {tuple(r) for r in lockfiles.requirement_pins(df.filter("id = 0"), "id").select("name", "version", "line").collect()}
    assert built_in == {(n, v, line) for n, v, line, _ in lockfiles.read_pins("requirements.txt", LOCKS["requirements.txt"][0])}


def test_via_annotations(spark):
    text = "a==1\n    # via\n    #   b\n    #   -r base.in\nb==2  # via c, d\nc==3\n    # via -r base.in\n"
    df = spark.createDataFrame([("r.txt", text)], "path string, text string")
    edges = lockfiles.via_graph(df)
    assert {(r.child, r.parent) for r in edges.collect()} == {("a", "b"), ("a", "-r base.in"), ("b", "c"), ("b", "d"), ("c", "-r base.in")}
    assert {r[0] for r in lockfiles.direct_dependencies(edges).collect()} == {"a", "c"}


def test_reports(spark, tmp_path):
    (tmp_path / "syft.json").write_text(json.dumps({"source": {"type": "image", "metadata": {"imageID": "sha256:i"}}, "artifacts": [{"name": "A", "version": "1", "purl": "pkg:pypi/A@1?x=y", "locations": [{"layerID": "L", "path": "/p"}, {}]}, {"name": "n", "version": "1"}, {"name": "b", "version": "1", "purl": "bad"}]}))
    got = reports.syft_packages(spark, str(tmp_path / "syft.json")).collect()
    assert [(r.purl, r.layers, r.image_digest) for r in got] == [("pkg:pypi/a@1", ["L"], "sha256:i")]
    (tmp_path / "cdx.json").write_text(json.dumps({"components": [{"name": "a", "version": "1", "purl": "pkg:npm/a@1", "components": [{"name": "b", "version": "2", "purl": "pkg:npm/b@2"}]}]}))
    assert {r.name for r in reports.cyclonedx_packages(spark, str(tmp_path / "cdx.json")).collect()} == {"a", "b"}
    (tmp_path / "trivy.json").write_text(json.dumps({"Results": [{"Type": "alpine", "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "p", "InstalledVersion": "1"}]}, {"Type": "x"}]}))
    row = reports.trivy_findings(spark, str(tmp_path / "trivy.json")).collect()
    assert [(r.Ecosystem, r.Severity, r.Title) for r in row] == [("apk", "UNKNOWN", "CVE-1")]
    sarif = {"runs": [{"tool": {"driver": {"name": "t", "rules": [{"id": "R1", "properties": {"security-severity": "9.1"}}, {"id": "R2", "defaultConfiguration": {"level": "note"}}]}}, "results": [
        {"ruleId": "R1", "message": {"text": "one\ntwo"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "file:///src/a.py"}}}]}, {"ruleId": "R2", "message": {"text": "x"}}, {"ruleId": "R3", "level": "error", "message": {"text": "y"}}, {"ruleId": "R1", "kind": "pass", "message": {"text": "z"}}]}]}
    (tmp_path / "s.sarif").write_text(json.dumps(sarif))
    got = reports.sarif_findings(spark, str(tmp_path / "s.sarif")).collect()
    assert [(r.severity, r.title) for r in got] == [("critical", "one"), ("low", "x"), ("high", "y")] and got[0].file == "src/a.py"


def test_advisory_dump(spark, tmp_path):
    record = {"id": "GHSA-1", "aliases": ["CVE-2"], "affected": [{"package": {"name": "p", "ecosystem": "PyPI"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2.0"}]}]}]}
    with zipfile.ZipFile(tmp_path / "PyPI-all.zip", "w") as z:
        z.writestr("GHSA-1.json", json.dumps(record))
        z.writestr("readme.txt", "x")
    rows = lists.advisory_rows(lists.advisories(spark, str(tmp_path / "PyPI-all.zip")))
    adv = enrich.ranges_of(rows).withColumn("versions", F.array().cast("array<string>"))
    deps = spark.createDataFrame([("p", "1.10"), ("p", "2.0"), ("p", "bad!"), ("p", "2.0rc1"), ("q", "1")], "name string, version string")
    assert {r.version for r in enrich.match_advisories(deps, adv, "PEP440").collect()} == {"1.10", "2.0rc1"}


def test_git_history(spark, tmp_path):
    repo = tmp_path / "repo"
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    repo.mkdir()
    run("init", "-q")
    for i, text in enumerate(("a==1\n", "a==2\n", "a==1\n", "a==1\nb==3\n")):
        (repo / "requirements.txt").write_text(text)
        run("add", ".")
        run("commit", "-qm", f"c{i}")
    log = git.manifest_history(spark, [str(repo)], "requirements.txt")
    assert [r.subject for r in log.orderBy("pos").collect()] == ["c0", "c1", "c2", "c3"]
    pins = lockfiles.pins(log.select("repo", "pos", "sha", "path", "text"))
    commits = log.select("repo", "pos", "sha")
    intro = history.introducers_asof(history.pin_changes(pins, commits), commits, pins, history.snapshots(commits, 1000).filter("pos = 3"))
    by_pos = {r.sha: r.pos for r in commits.collect()}
    assert {r.name: by_pos[r.sha] for r in intro.collect()} == {"a": 2, "b": 3}
    blame = git.manifest_history(spark, [str(repo)], "requirements.txt", table="blame")
    last = pins.filter("pos = 3").drop("sha")
    assert {r.name: by_pos[r.sha] for r in git.blame_introducers(last, blame).collect()} == {"a": 2, "b": 3}
    assert by_pos[git.pickaxe_newest(log, F.lit("b==3")).first().sha] == 3 and by_pos[git.pickaxe_first(log, r"^a==2").first().sha] == 1


def test_static_reachability(spark):
    files = spark.createDataFrame([("app/a.py", "import yaml.nodes\nfrom django.conf import settings\nimportlib.import_module('celery')\n"), ("x/../b.py", "import os"), ("setup.cfg", "plugin = gunicorn"), ("app/bad.py", "def (")], "path string, text string")
    code = git.source_files(files, prefixes=("app/",))
    modules = reach.app_imports(code)
    assert {r.module for r in modules.collect()} >= {"yaml", "yaml.nodes", "django.conf.settings", "celery"}
    dists = spark.createDataFrame([("pyyaml",), ("django",), ("sqlparse",), ("gunicorn",), ("orphan",), ("child",)], "dist string")
    names = dists.select("dist", F.explode(reach.import_names(F.col("dist"))).alias("import_name"))
    found = names.join(modules.select(F.col("module").alias("import_name")), "import_name", "left_semi").select("dist", F.lit("imported").alias("tier")).distinct()
    tiers = found.unionByName(reach.entrypoint_hits(files, names).select("dist", F.lit("entrypoint").alias("tier"))).unionByName(reach.implied(modules, files).select("dist", F.lit("implied").alias("tier")))
    edges = spark.createDataFrame([("child", "gunicorn")], "child string, parent string")
    got = {r.dist: r.status for r in enrich.static_reachability(dists, edges, tiers, True).collect()}
    assert got == {"pyyaml": "imported", "django": "imported", "sqlparse": "implied", "gunicorn": "entrypoint", "child": "transitive", "orphan": "unreached"}


def test_labels(spark):
    df = spark.createDataFrame([(1, "Bump requests from 2.0 to 2.1.0 (#12)"), (2, "Bumps `a` from v1 to 2. Updates b from 1.0 to 1.1"), (3, "Revert x")], "id int, message string")
    assert {tuple(r) for r in history.bump_labels(df, "id").collect()} == {(1, "requests", "2.0", "2.1.0"), (2, "a", "1", "2"), (2, "b", "1.0", "1.1")}
    assert [r[0] for r in df.orderBy("id").select(history.pull_request(F.col("message"))).collect()] == [12, None, None]
    labels = spark.createDataFrame([(1, "r", 1, "a", "2"), (2, "r", 1, "zz", "1"), (3, "r", 1, "b", "1")], "label_id int, repo string, pos long, name string, version string")
    pins = spark.createDataFrame([("r", 0, "b", "1"), ("r", 1, "a", "2.0"), ("r", 1, "b", "1")], "repo string, pos long, name string, version string")
    assert {r.label_id: (r.version, r.excluded) for r in history.resolve_labels(labels, pins).collect()} == {1: ("2.0", None), 2: (None, "not_in_lock"), 3: ("1", "already_present")}


def test_reports_of_several_files(spark, tmp_path):
    def sarif(score):
        rule = {"id": "R1", "properties": {"security-severity": score}}
        return {"runs": [{"tool": {"driver": {"name": "t", "rules": [rule]}}, "results": [{"ruleId": "R1", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f"f{score}"}}}]}]}]}

    (tmp_path / "s").mkdir()
    for score in ("9.5", "1.0"):
        (tmp_path / "s" / f"{score}.json").write_text(json.dumps(sarif(score)))
    assert {(r.file, r.severity) for r in reports.sarif_findings(spark, str(tmp_path / "s")).collect()} == {("f9.5", "critical"), ("f1.0", "low")}
    nested = {"name": "c100", "version": "1", "purl": "pkg:npm/c100@1"}
    for i in range(99, 0, -1):
        nested = {"name": f"c{i}", "version": "1", "purl": f"pkg:npm/c{i}@1", "components": [nested]}
    (tmp_path / "c.json").write_text(json.dumps({"components": [nested]}))
    assert reports.cyclonedx_packages(spark, str(tmp_path / "c.json")).count() == 100
    v = lambda purl: {"VulnerabilityID": "CVE-1", "PkgName": "a", "InstalledVersion": "1", "PkgIdentifier": {"PURL": purl}}
    (tmp_path / "t.json").write_text(json.dumps({"Results": [{"Type": "pip", "Vulnerabilities": [v("not a purl"), v("pkg:pypi/a@1")]}]}))
    assert {r.PURL for r in reports.trivy_findings(spark, str(tmp_path / "t.json")).collect()} == {None, "pkg:pypi/a@1"}
    image = {"type": "image", "metadata": {"imageID": "sha256:i", "manifestDigest": "sha256:m"}}
    (tmp_path / "y.json").write_text(json.dumps({"source": image, "artifacts": [{"name": "a", "version": "1", "purl": "pkg:pypi/a@1"}]}))
    assert reports.syft_packages(spark, str(tmp_path / "y.json")).first()["image_digest"] == "sha256:i"


def test_lock_files_of_several_ages():
    read = lambda name, text: [p[:2] for p in lockfiles.read_pins(name, text)]
    assert read("pnpm-lock.yaml", "packages:\n  /@a/b/1.0.0:\n    x: 1\n  /c@2.0.0(d@3):\n    x: 1\n  registry.npmjs.org/e/1.0.0:\n    x: 1\n  file:f:\n    x: 1\n") == [("@a/b", "1.0.0"), ("c", "2.0.0")]
    assert read("yarn.lock", '"l@link:./l":\n  version "1.0.0"\n\n"p@patch:p@npm%3A1.0.0#x":\n  version: 1.0.0\n\na@^1, a@^2:\n  version "2.0.0"\n  dependencies:\n    version "9"\n') == [("p", "1.0.0"), ("a", "2.0.0")]
    go = "module m.io/x\n\ngo 1.21\n\nrequire a.io/b v1.0.0 // indirect\n\nrequire (\n\tc.io/d v2.0.0\n\ta.io/b v1.1.0\n)\n\nreplace (\n\tc.io/d v2.0.0 => e.io/f v3.0.0\n)\nexclude g.io/h v4.0.0\n"
    assert lockfiles.go_mod(go) == [("c.io/d", "v2.0.0", 7, 7), ("a.io/b", "v1.1.0", 8, 8)]
    assert read("go.sum", "a.io/b v1.9.0 h1:x\na.io/b v1.10.0 h1:y\na.io/b v1.11.0/go.mod h1:z\n") == [("a.io/b", "v1.10.0")]
    assert lockfiles.read_pins("package-lock.json", '{\n  "packages": {\n    "node_modules/a": {\n      "version": "1.0.0",\n      "dependencies": {\n        "version": "x"\n      }\n    }\n  }\n}') == [("a", "1.0.0", 3, 2)]
    assert read("package-lock.json", '{"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2"}}}}}') == [("a", "1"), ("b", "2")]
