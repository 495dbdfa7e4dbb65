"""Event-sourced graph construction (GRA-01 to GRA-10, GRA-12).

Verified stage events become node, edge and finding rows, one branch a stage.
Every row carries ``seq``, its place in (stage order, envelope index, position),
which decides first-wins and last-wins merges; nothing relies on row order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.identity import canonical_list, canonical_purl, digest, json_string, normalize_name, purl
from strataflow.functions.severity import severity
from strataflow.operators.traverse import checkpointed

#: Order of stages, and those that a complete run needs.
STAGES = ("commit", "sast", "build", "scan", "deploy", "runtime")
REQUIRED = ("commit", "build", "scan")

_PACKAGE = "struct<name:string,version:string,ecosystem:string,purl:string,import_name:string,locations:array<struct<layerID:string,path:string>>>"
_IMAGE = "struct<name:string,digest:string,repo_digests:array<string>,layers:array<struct<digest:string,size:bigint,created_by:string>>>"
_VULN = "struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,Severity:string,Title:string,PURL:string,Ecosystem:string,LayerDiffID:string>"
PAYLOADS = {
    "commit": f"sha string, author string, pr bigint, message string, seq bigint, timestamp bigint, files array<string>, deps_added array<{_PACKAGE}>, deps_removed array<struct<name:string,version:string>>",
    "sast": "commit string, tool string, findings array<struct<file:string,rule:string,severity:string,title:string>>",
    "build": f"build_id string, commit string, tool string, image {_IMAGE}, sbom struct<artifacts:array<{_PACKAGE}>>",
    "scan": f"tool string, artifact string, Results array<struct<Target:string,Class:string,Type:string,Vulnerabilities:array<{_VULN}>>>",
    "deploy": "service string, image_digest string, containers array<string>",
    "runtime": "container string, loaded_modules array<string>",
}
#: The field without which an event of the stage is rejected.
NEEDED = {"commit": "sha", "sast": "commit", "build": "build_id", "scan": "Results", "deploy": "image_digest", "runtime": "container"}
ATTRIBUTES = {
    "sha": "string", "author": "string", "pr": "bigint", "message": "string", "run_id": "string", "commit_seq": "bigint", "timestamp": "bigint", "deps_removed": "array<string>",
    "path": "string", "name": "string", "version": "string", "purl": "string", "ecosystem": "string", "import_name": "string", "tool": "string",
    "digest": "string", "repo_digests": "array<string>", "created_by": "string", "service": "string",
}


@dataclass
class Collected:
    """Tables of one run; nodes, edges and findings stand in the checkpoint folder."""

    nodes: DataFrame
    edges: DataFrame
    findings: DataFrame
    unmatched: DataFrame
    rejected: DataFrame
    stages_seen: DataFrame
    runtime: DataFrame

    def missing_stages(self) -> DataFrame:
        spark = self.nodes.sparkSession
        return spark.createDataFrame([(s,) for s in REQUIRED], "stage string").join(self.stages_seen, "stage", "left_anti")


def _id(kind: str, c: Column) -> Column:
    return digest(kind, json_string(c))


def _node(kind: str, node_id: Column, label: Column, **written: Column) -> list[Column]:
    """Columns of a node row; ``written`` names the attributes this row sets, NULLs included."""
    values = [(written[a].cast(t) if a in written else F.lit(None).cast(t)).alias(a) for a, t in ATTRIBUTES.items()]
    return [node_id.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), "seq", F.array(*map(F.lit, written)).cast("array<string>").alias("written"), *values]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def merge_nodes(rows: DataFrame) -> DataFrame:
    """Label and kind of the first writer, each attribute of the last writer that set it, even to NULL."""
    last = lambda a: F.max_by(F.struct(F.col(a).alias("v")), F.when(F.array_contains("written", a), F.col("seq")))["v"].alias(a)
    return rows.groupBy("id").agg(F.min_by("kind", "seq").alias("kind"), F.min_by("label", "seq").alias("label"), F.min("seq").alias("seq"), *[last(a) for a in ATTRIBUTES])


def first_per(rows: DataFrame, *key: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("seq")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def match_packages(vulns: DataFrame, deps: DataFrame) -> DataFrame:
    """Adds dep_id to scanner rows (GRA-05).

    A purl decides alone.  Otherwise a unique (ecosystem, normalised name,
    version) counts, or a unique (name, version) if no ecosystem is given.
    """
    has_purl = F.coalesce(F.col("PURL") != "", F.lit(False))
    eco = F.lower(F.coalesce(F.col("Ecosystem"), F.lit("")))
    keyed = vulns.withColumns({
        "_purl_id": F.when(has_purl, digest("dependency", json_string(canonical_purl(F.col("PURL"))))),
        "_eco": F.when(eco != "", eco).otherwise("*"),
        "_name": F.when(eco != "", F.lower(normalize_name(F.col("PkgName"), eco))).otherwise(F.lower("PkgName")),
    })
    d = deps.select("id", F.coalesce("ecosystem", F.lit("")).alias("e"), F.coalesce("name", F.lit("")).alias("n"), F.coalesce("version", F.lit("")).alias("v"))
    own = d.select("id", F.col("e").alias("_eco"), F.lower(normalize_name(F.col("n"), F.when(F.col("e") == "", "pypi").otherwise(F.col("e")))).alias("_name"), F.col("v").alias("InstalledVersion"))
    every = d.select("id", F.lit("*").alias("_eco"), F.lower("n").alias("_name"), F.col("v").alias("InstalledVersion"))
    index = own.union(every).groupBy("_eco", "_name", "InstalledVersion").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).filter("_low = _high").drop("_high")
    ids = d.select(F.col("id").alias("_purl_id"), F.col("id").alias("_by_purl")).distinct()
    out = keyed.join(ids, "_purl_id", "left").join(index, ["_eco", "_name", "InstalledVersion"], "left")
    return out.withColumn("dep_id", F.when(has_purl, F.col("_by_purl")).otherwise(F.col("_low"))).drop("_purl_id", "_by_purl", "_low", "_eco", "_name")


def collect_events(verified: DataFrame) -> Collected:
    """``verified``: env_idx, stage, run_id, payload (JSON), reject_reason (NULL if accepted)."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.lit(0)), F.lit(99))
    e = verified.withColumn("base", (order.cast("long") * (1 << 32) + F.col("env_idx")) * (1 << 20))
    unknown = F.when(~F.col("stage").isin(*STAGES), F.concat(F.lit("unknown stage "), F.col("stage")))
    e = e.withColumn("reject_reason", F.coalesce("reject_reason", unknown))
    e = checkpointed(e)  # every branch reads it, and none plans the checks of signatures again
    ok = e.filter("reject_reason IS NULL")
    rejected = [e.filter("reject_reason IS NOT NULL").select("env_idx", "reject_reason")]
    parts, node, edge, finding = {}, [], [], []
    for stage, schema in PAYLOADS.items():
        p = ok.filter(F.col("stage") == stage).withColumn("p", F.from_json("payload", schema))
        fine = F.col(f"p.{NEEDED[stage]}").isNotNull()
        rejected.append(p.filter(~fine).select("env_idx", F.lit(f"{stage} event without {NEEDED[stage]}").alias("reject_reason")))
        parts[stage] = p.filter(fine).select("env_idx", "run_id", F.col("base").alias("seq"), "p.*") if stage != "commit" else p.filter(fine).select("env_idx", "run_id", F.col("base").alias("seq"), F.col("p.seq").alias("commit_seq"), *[f"p.{x.split()[0]}" for x in ("sha", "author", "pr", "message", "timestamp", "files", "deps_added", "deps_removed")])
    def add(rows, src, dst, rel):
        edge.append(rows.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel")))

    # commits
    c = parts["commit"]
    cid = _id("commit", F.col("sha"))
    removed = F.transform(F.coalesce("deps_removed", F.array()), lambda d: F.concat(d["name"], F.lit("=="), d["version"]))
    node.append(c.select(*_node("commit", cid, F.left("sha", F.lit(12)), sha=F.col("sha"), author=F.col("author"), pr=F.col("pr"), message=F.coalesce("message", F.lit("")), run_id=F.col("run_id"), commit_seq=F.col("commit_seq"), timestamp=F.col("timestamp"), deps_removed=removed)))
    commits = c.select(cid.alias("commit_id")).distinct()
    files = c.select("sha", "seq", F.posexplode("files").alias("k", "path")).withColumn("seq", F.col("seq") + 1 + F.col("k"))
    fid = digest("file", canonical_list(F.col("sha"), F.col("path")))
    node.append(files.select(*_node("file", fid, F.col("path"), path=F.col("path"))))
    add(files, cid, fid, "modifies")
    added = c.select("sha", "seq", F.posexplode("deps_added").alias("k", "d")).withColumn("seq", F.col("seq") + (1 << 19) + F.col("k"))
    eco = F.coalesce("d.ecosystem", F.lit("pypi"))
    pu = F.when(F.coalesce(F.col("d.purl"), F.lit("")) != "", canonical_purl(F.col("d.purl"))).otherwise(purl(F.col("d.name"), F.col("d.version"), eco))
    added = added.withColumns({"pu": pu, "eco": eco}).filter("pu IS NOT NULL")
    did = digest("dependency", json_string(canonical_purl(F.col("pu"))))
    title = F.concat(F.col("d.name"), F.lit("=="), F.col("d.version"))
    node.append(added.select(*_node("dependency", did, title, name=F.col("d.name"), version=F.col("d.version"), purl=F.col("pu"), ecosystem=F.col("eco"))))
    add(added, cid, did, "introduced")

    # builds
    b = parts["build"]
    bid = _id("build", F.col("build_id"))
    node.append(b.select(*_node("build", bid, F.col("build_id"), run_id=F.col("run_id"), tool=F.col("tool"))))
    add(b.withColumn("commit_id", _id("commit", F.col("commit"))).join(commits, "commit_id", "left_semi"), F.col("commit_id"), bid, "built_by")
    im = b.filter("image.digest IS NOT NULL AND image.digest <> ''")
    iid = _id("image", F.col("image.digest"))
    name = F.coalesce(F.nullif(F.col("image.name"), F.lit("")), F.left("image.digest", F.lit(19)))
    node.append(im.withColumn("seq", F.col("seq") + 1).select(*_node("image", iid, name, digest=F.col("image.digest"), repo_digests=F.coalesce("image.repo_digests", F.array().cast("array<string>")))))
    add(im, bid, iid, "produced")
    images = im.select(iid.alias("image_id"), "image.digest").distinct()
    layers = im.select("seq", iid.alias("image_id"), F.posexplode("image.layers").alias("k", "l")).withColumn("seq", F.col("seq") + 2 + F.col("k"))
    lid = _id("layer", F.col("l.digest"))
    node.append(layers.select(*_node("layer", lid, F.left("l.digest", F.lit(19)), digest=F.col("l.digest"), created_by=F.coalesce("l.created_by", F.lit("")))))
    add(layers, lid, F.col("image_id"), "layer_of")
    known = F.transform(F.coalesce("image.layers", F.array()), lambda x: x["digest"])
    arts = b.select("seq", bid.alias("build_id"), F.when(F.coalesce(F.col("image.digest"), F.lit("")) != "", iid).alias("image_id"), known.alias("known"), F.posexplode("sbom.artifacts").alias("k", "d")).withColumn("seq", F.col("seq") + (1 << 19) + F.col("k"))
    pu = F.coalesce(F.nullif(F.col("d.purl"), F.lit("")), purl(F.col("d.name"), F.col("d.version"), F.lit("pypi")))
    arts = arts.withColumn("pu", canonical_purl(pu)).filter("pu IS NOT NULL")
    eco = F.regexp_extract("pu", "^pkg:([^/]+)/", 1)
    module = F.coalesce(F.nullif(F.col("d.import_name"), F.lit("")), F.replace(F.lower("d.name"), F.lit("-"), F.lit("_")))
    did = digest("dependency", json_string(F.col("pu")))
    both = {"name": F.col("d.name"), "version": F.col("d.version"), "purl": F.col("pu"), "ecosystem": eco}
    node.append(arts.filter(eco == "pypi").select(*_node("dependency", did, title, **both, import_name=module)))
    node.append(arts.filter(eco != "pypi").select(*_node("dependency", did, title, **both)))
    located = F.array_intersect(F.transform(F.coalesce("d.locations", F.array()), lambda x: x["layerID"]), F.col("known"))
    into = F.when(F.size(located) > 0, F.transform(located, lambda x: _id("layer", x))).otherwise(F.array(F.coalesce("image_id", "build_id")))
    add(arts.withColumn("to", F.explode(into)), did, F.col("to"), "installed_in")

    # source findings; the event's index keeps those of several reports apart
    s = parts["sast"].withColumnRenamed("commit", "sha").select("env_idx", "run_id", "seq", "sha", F.posexplode("findings").alias("k", "f")).withColumn("seq", F.col("seq") + F.col("k"))
    fid = digest("file", canonical_list(F.col("sha"), F.col("f.file")))
    node.append(s.select(*_node("file", fid, F.col("f.file"), path=F.col("f.file"))))
    add(s.withColumn("commit_id", cid).join(commits, "commit_id", "left_semi"), F.col("commit_id"), fid, "modifies")
    none = F.array().cast("array<string>")
    finding.append(s.select(F.concat(F.lit("sast-"), F.col("run_id"), F.lit("-"), F.col("env_idx").cast("string"), F.lit("-"), F.col("k").cast("string")).alias("id"), fid.alias("node_id"), F.lit("sast").alias("source"), severity(F.col("f.severity")).alias("severity"), F.concat(F.col("f.rule"), F.lit(": "), F.col("f.title")).alias("title"), F.lit(None).cast("string").alias("cve"), none.alias("evidence"), "seq"))

    nodes = checkpointed(merge_nodes(_union(node)))  # scans match against it
    # scans
    v = parts["scan"].select(F.coalesce("tool", F.lit("trivy")).alias("tool"), "seq", F.posexplode("Results").alias("r", "x"))
    v = v.select("tool", (F.col("seq") + F.col("r") * (1 << 10)).alias("seq"), F.posexplode("x.Vulnerabilities").alias("k", "v")).select("tool", (F.col("seq") + F.col("k")).alias("seq"), "v.*")
    v = checkpointed(match_packages(v, nodes.filter("kind = 'dependency'")))
    sev = severity(F.coalesce("Severity", F.lit("medium")))
    title = F.coalesce("Title", "VulnerabilityID")
    fixed = F.when(F.coalesce("FixedVersion", F.lit("")) != "", F.concat(F.lit("fixed in "), F.col("FixedVersion")))
    layer = F.when(F.coalesce("LayerDiffID", F.lit("")) != "", F.concat(F.lit("layer "), F.left("LayerDiffID", F.lit(19))))
    hit = v.filter("dep_id IS NOT NULL")
    finding.append(hit.select(F.concat("VulnerabilityID", F.lit("@"), "dep_id").alias("id"), F.col("dep_id").alias("node_id"), F.col("tool").alias("source"), sev.alias("severity"), title.alias("title"), F.col("VulnerabilityID").alias("cve"), F.array_compact(F.array(fixed, layer)).alias("evidence"), "seq"))
    lost = v.filter("dep_id IS NULL").select(F.concat("VulnerabilityID", F.lit("@"), "PkgName", F.lit("@"), "InstalledVersion").alias("id"), F.col("VulnerabilityID").alias("cve"), F.col("PkgName").alias("package"), F.col("InstalledVersion").alias("version"), F.col("Ecosystem").alias("ecosystem"), F.col("PURL").alias("purl"), F.col("tool").alias("source"), sev.alias("severity"), title.alias("title"), "seq")
    findings = checkpointed(first_per(_union(finding), "id").withColumn("reachable", F.lit(None).cast("boolean")))

    # deployments of known images
    d = parts["deploy"].withColumn("image_id", _id("image", F.col("image_digest")))
    rejected.append(d.join(images, "image_id", "left_anti").select("env_idx", F.concat(F.lit("deploy of unknown image "), F.col("image_digest"), F.lit(" (no build provenance)")).alias("reject_reason")))
    d = d.join(images.select("image_id").distinct(), "image_id", "left_semi")
    pid = digest("deployment", canonical_list(F.col("service"), F.col("image_digest")))
    run = d.select("service", "image_digest", "seq", pid.alias("deployment_id"), F.posexplode("containers").alias("k", "container")).withColumn("seq", F.col("seq") + 1 + F.col("k"))
    tid = _id("container", F.col("container"))
    late = [d.select(*_node("deployment", pid, F.col("service"), service=F.col("service"))), run.select(*_node("container", tid, F.col("container"), service=F.col("service")))]
    add(d, F.col("image_id"), pid, "deployed_as")
    add(run, F.col("deployment_id"), tid, "runs")
    nodes = checkpointed(nodes.unionByName(merge_nodes(_union(late))))
    runtime = parts["runtime"].select(tid.alias("container_id"), F.explode_outer("loaded_modules").alias("m")).groupBy("container_id").agg(F.collect_set(F.lower("m")).alias("modules"))
    seen = ok.select("stage").distinct()
    return Collected(nodes, checkpointed(_union(edge).distinct()), findings, checkpointed(lost), _union(rejected), seen, runtime)


def unknown_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node; empty for a sound graph."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")).distinct()


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))
