"""Risk and reachability enrichment, advisory joins (JON-01 to JON-08, RCH-02 to RCH-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions.severity import own_severity, score_severity
from strataflow.functions.versions import fold_events, in_ranges, pep440_key, semver_key
from strataflow.operators.traverse import checkpointed, descendants

_KEYED = {"SEMVER": semver_key, "PEP440": pep440_key}


def propagate_severity(advisories: DataFrame) -> DataFrame:
    """Adds ``severity``: an advisory's own, else that of its first alias that has one (JON-02).

    ``advisories``: ordinal, osv_id, aliases, label, severities, withdrawn.
    """
    live = advisories.filter("withdrawn IS NULL").withColumn("_own", own_severity(F.col("label"), F.col("severities")))
    rated = live.filter("_own IS NOT NULL")
    by_id = rated.select(F.col("osv_id").alias("key"), F.lit(0).alias("level"), "ordinal", "_own")
    by_alias = rated.select(F.explode("aliases").alias("key"), F.lit(1).alias("level"), "ordinal", "_own")
    known = by_id.union(by_alias).groupBy("key").agg(F.min_by("_own", F.struct("level", "ordinal")).alias("found"))
    out = live.join(known.withColumnRenamed("key", "osv_id").withColumnRenamed("found", "_id_found"), "osv_id", "left")
    named = live.select("osv_id", "ordinal", F.posexplode("aliases").alias("k", "key")).join(known, "key").groupBy("osv_id", "ordinal").agg(F.min_by("found", "k").alias("_alias_found"))
    out = out.join(named, ["osv_id", "ordinal"], "left")
    return out.withColumn("severity", F.coalesce("_id_found", "_alias_found")).drop("_own", "_id_found", "_alias_found")


def match_advisories(deps: DataFrame, advisories: DataFrame, order: str = "SEMVER") -> DataFrame:
    """Dependencies (name, version) hit by advisories (name, osv_id, versions, ranges of introduced, fixed, last).

    Equi-join on the name; an explicit version list wins and ranges count only
    without one.  Keys of SemVer are built in, those of PEP 440 are computed once
    for each distinct version.
    """
    key = _KEYED[order]
    free = lambda r: r["introduced"].isNull() | (r["introduced"] == "0")
    if order == "SEMVER":
        bounds = F.transform("ranges", lambda r: F.struct(free(r).alias("low_any"), key(r["introduced"]).alias("low"), F.when(r["fixed"].isNotNull(), key(r["fixed"])).alias("fixed"), F.when(r["last"].isNotNull(), key(r["last"])).alias("last"), F.lit(False).alias("bad")))
        keyed = advisories.withColumn("_bounds", bounds)
        d = deps.withColumn("_key", key(F.col("version")))
    else:
        each = advisories.select("osv_id", "name", F.posexplode_outer("ranges").alias("k", "r"))
        each = each.withColumns({"low": key(F.when(~free(F.col("r")), F.col("r.introduced"))), "fixed": key(F.col("r.fixed")), "last": key(F.col("r.last")), "low_any": free(F.col("r"))})
        bad = (~F.col("low_any") & F.col("low").isNull()) | (F.col("r.fixed").isNotNull() & F.col("fixed").isNull()) | (F.col("r.last").isNotNull() & F.col("last").isNull())
        each = each.filter("k IS NOT NULL").groupBy("osv_id", "name").agg(F.array_sort(F.collect_list(F.struct("k", "low_any", "low", "fixed", "last", bad.alias("bad")))).alias("_bounds"))
        keyed = advisories.join(each, ["osv_id", "name"], "left")
        versions = deps.select("version").distinct().withColumn("_key", key(F.col("version")))
        d = deps.join(versions, "version", "left")
    listed = F.coalesce(F.size("versions"), F.lit(0)) > 0
    hit = F.when(listed, F.array_contains("versions", F.col("version"))).otherwise(in_ranges(F.col("_key"), F.col("_bounds")))
    return d.join(keyed, "name").filter(hit).drop("_key", "_bounds").dropDuplicates(["name", "version", "osv_id"])


def scan_rows(matches: DataFrame) -> DataFrame:
    """Scanner-shaped rows of advisory matches (JON-03)."""
    fixes = F.array_distinct(F.filter(F.transform("ranges", lambda r: r["fixed"]), lambda x: x.isNotNull()))
    return matches.select(F.col("osv_id").alias("VulnerabilityID"), F.col("name").alias("PkgName"), F.col("version").alias("InstalledVersion"), F.nullif(F.array_join(fixes, ", "), F.lit("")).alias("FixedVersion"), F.coalesce("severity", F.lit("MEDIUM")).alias("Severity"))


def ranges_of(affected_events: DataFrame) -> DataFrame:
    """(osv_id, name, type, events) to (osv_id, name, ranges); GIT ranges are left out."""
    rows = affected_events.filter("type <> 'GIT'").withColumn("r", fold_events(F.col("events")))
    return rows.groupBy("osv_id", "name").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def risk_findings(deps: DataFrame, risks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Findings of dependencies whose name scores the threshold or more (JON-04); names are scored once."""
    hit = deps.join(risks.select("ecosystem", "name", "risk"), ["ecosystem", "name"]).filter(F.col("risk") >= threshold)
    return hit.select(F.concat(F.lit("risk@"), F.col("id")).alias("id"), F.col("id").alias("node_id"), F.lit("risk").alias("source"), F.when(F.col("risk") >= 0.8, "critical").otherwise("high").alias("severity"), "risk")


def name_risk(names: DataFrame, denied: DataFrame, malicious: DataFrame, squats: DataFrame) -> DataFrame:
    """(name, risk, reason): deny list, then malicious packages, then the similarity score (JON-05)."""
    flag = lambda df, n: df.select("name", F.lit(True).alias(n)).distinct()
    rows = names.select("name").distinct().join(flag(denied, "_deny"), "name", "left").join(flag(malicious, "_mal"), "name", "left").join(squats.select("name", "score"), "name", "left")
    return rows.select("name", F.when(F.col("_deny") | F.col("_mal"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("risk"), F.when(F.col("_deny"), "denylist").when(F.col("_mal"), "malicious").when(F.col("score") > 0, "typosquat").alias("reason"))


def api_risk(score, decision):
    """Risk of a scoring service's answer: score in percent, raised to the floor of its decision."""
    floor = F.when(decision == "block", 0.9).when(decision.isin("review", "warn"), 0.5).otherwise(0.0)
    return F.greatest(F.least(score / 100, F.lit(1.0)), floor)


def runtime_reachability(findings: DataFrame, edges: DataFrame, modules: DataFrame, runtime: DataFrame, lower_both: bool = False) -> DataFrame:
    """Adds ``reachable``: loaded in an observed container downstream, known not to be, or NULL (JON-06).

    ``modules`` (node_id, import_name); ``runtime`` (container_id, modules).  The
    import name is compared as it is with lower-case modules unless ``lower_both``.
    """
    starts = findings.select(F.col("node_id").alias("id")).distinct()
    loads = runtime.select(F.col("container_id").alias("node"), "modules")
    name = F.lower("import_name") if lower_both else F.col("import_name")
    seen = descendants(edges, starts).join(loads, "node").join(modules.select(F.col("node_id").alias("start"), "import_name"), "start")
    seen = seen.groupBy(F.col("start").alias("node_id")).agg(F.bool_or(F.coalesce(F.array_contains("modules", name), F.lit(False))).alias("reachable"))
    return findings.drop("reachable").join(seen, "node_id", "left")


def merge_static(findings: DataFrame, report: DataFrame) -> DataFrame:
    """Fills unknown reachability from a static report (node_id, status); runtime wins (JON-07)."""
    known = report.select("node_id", F.when(F.col("status") == "unreached", False).when(F.col("status") != "unknown", True).alias("_static"))
    return findings.join(known, "node_id", "left").withColumn("reachable", F.coalesce("reachable", "_static")).drop("_static")


def static_reachability(dists: DataFrame, edges: DataFrame, evidence: DataFrame, has_via: bool) -> DataFrame:
    """Tiers of distributions: imported, entrypoint, implied, transitive, referenced, unreached or unknown (RCH-04).

    ``dists`` (dist); ``edges`` (child, parent) from annotations; ``evidence``
    (dist, tier) with the tiers found directly.  Reached parents reach their
    children until nothing changes, before and after the referenced tier.
    """
    def spread(reached):
        new = reached
        while True:
            new = edges.join(new.select(F.col("dist").alias("parent")), "parent").groupBy(F.col("child").alias("dist")).agg(F.min("parent").alias("evidence")).join(reached, "dist", "left_anti")
            new = checkpointed(new.select("dist", F.lit("transitive").alias("status"), "evidence"))
            if new.isEmpty():
                return reached
            reached = checkpointed(reached.unionByName(new))

    order = F.array_position(F.array(*map(F.lit, ("imported", "entrypoint", "implied"))), F.col("tier"))
    first = evidence.filter("tier <> 'referenced'").groupBy("dist").agg(F.min_by("tier", order).alias("status"), F.min("tier").alias("evidence"))
    reached = spread(checkpointed(first.join(dists, "dist", "left_semi")))
    again = evidence.filter("tier = 'referenced'").select("dist", F.lit("referenced").alias("status"), F.lit("referenced").alias("evidence")).distinct().join(dists, "dist", "left_semi").join(reached, "dist", "left_anti")
    reached = spread(checkpointed(reached.unionByName(again)))
    return dists.select("dist").distinct().join(reached, "dist", "left").withColumn("status", F.coalesce("status", F.lit("unreached" if has_via else "unknown")))


def identity_convergence(rows: DataFrame, deps: DataFrame) -> DataFrame:
    """Share of scanner rows that meet a dependency by name and version, raw purl and canonical purl (JON-08)."""
    out = rows
    for n, key in (("naive", ["name", "version"]), ("raw", ["purl"]), ("canonical", ["canonical"])):
        out = out.join(deps.select(*key).distinct().withColumn(f"_{n}", F.lit(1)), key, "left")
    return out.agg(*[F.bround(F.avg(F.coalesce(f"_{n}", F.lit(0))), 6).alias(n) for n in ("naive", "raw", "canonical")])


def banded(score):
    return score_severity(score)
