"""Tool reports as rows (SRC-03 to SRC-06): SBOMs, vulnerability scans, source findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.identity import canonical_purl
from strataflow.operators.traverse import checkpointed

# Ecosystem of a scanner's result type.
RESULT_TYPES = {
    "alpine": "apk", "wolfi": "apk", "chainguard": "apk", "debian": "deb", "ubuntu": "deb", "redhat": "rpm", "centos": "rpm", "rocky": "rpm",
    "alma": "rpm", "amazon": "rpm", "oracle": "rpm", "fedora": "rpm", "photon": "rpm", "cbl-mariner": "rpm", "azurelinux": "rpm",
    "suse linux enterprise server": "rpm", "opensuse.leap": "rpm", "opensuse.tumbleweed": "rpm", "python-pkg": "pypi", "pip": "pypi",
    "pipenv": "pypi", "poetry": "pypi", "uv": "pypi", "npm": "npm", "yarn": "npm", "pnpm": "npm", "node-pkg": "npm", "bun": "npm",
    "gomod": "golang", "gobinary": "golang", "cargo": "cargo", "rust-binary": "cargo", "bundler": "gem", "gemspec": "gem", "nuget": "nuget",
    "dotnet-core": "nuget", "packages-props": "nuget", "jar": "maven", "pom": "maven", "gradle": "maven", "sbt": "maven", "composer": "composer",
    "composer-vendor": "composer", "conan": "conan", "cocoapods": "cocoapods", "swift": "swift", "pub": "pub", "hex": "hex", "conda-pkg": "conda",
}

_SYFT = (
    "descriptor struct<version:string>, source struct<type:string,name:string,metadata:struct<userInput:string,imageID:string,manifestDigest:string,repoDigests:array<string>,layers:array<struct<digest:string,size:bigint>>>>, "
    "artifacts array<struct<name:string,version:string,type:string,purl:string,locations:array<struct<path:string,layerID:string>>>>"
)
_TRIVY = (
    "ArtifactName string, Metadata struct<ImageID:string,DiffIDs:array<string>>, Results array<struct<Target:string,Class:string,Type:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,"
    "FixedVersion:string,Severity:string,Title:string,PkgIdentifier:struct<PURL:string>,Layer:struct<DiffID:string>>>>>"
)
_RULE = "struct<id:string,defaultConfiguration:struct<level:string>,properties:struct<`security-severity`:string>>"
_SARIF = (
    f"runs array<struct<tool:struct<driver:struct<name:string,rules:array<{_RULE}>>>,results:array<struct<ruleId:string,rule:struct<id:string>,kind:string,level:string,message:struct<text:string>,"
    "properties:struct<`security-severity`:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>>>>"
)


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def syft_packages(spark: SparkSession, path: str) -> DataFrame:
    """image_digest, name, version, purl, layers: packages with a valid purl and a version."""
    d = _documents(spark, path, _SYFT)
    image = F.when((F.col("source.type") == "image") | F.col("source.metadata.imageID").isNotNull(), F.coalesce("source.metadata.imageID", "source.metadata.manifestDigest"))
    a = d.select(image.alias("image_digest"), F.explode("artifacts").alias("a"))
    found = F.filter("a.locations", lambda x: x["layerID"].isNotNull() | x["path"].isNotNull())
    rows = a.select("image_digest", "a.name", "a.version", canonical_purl(F.col("a.purl")).alias("purl"), F.array_distinct(F.array_compact(F.transform(found, lambda x: x["layerID"]))).alias("layers"))
    return rows.filter("purl IS NOT NULL AND version IS NOT NULL")


def cyclonedx_packages(spark: SparkSession, path: str) -> DataFrame:
    """name, version, purl of components nested to any depth, read level by level."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    levels = []
    while True:
        inner = F.try_variant_get("v", "$.components", "array<variant>")
        doc = checkpointed(doc.select(F.explode(inner).alias("v")))  # each level is written, so plans stay small however deep
        if doc.isEmpty():
            break
        get = lambda f: F.try_variant_get("v", f"$.{f}", "string")
        levels.append(doc.select(get("name").alias("name"), get("version").alias("version"), canonical_purl(get("purl")).alias("purl")))
    if not levels:
        return spark.createDataFrame([], "name string, version string, purl string")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.filter("purl IS NOT NULL AND version IS NOT NULL")


def trivy_findings(spark: SparkSession, path: str) -> DataFrame:
    """One row for each result and vulnerability, in the shape that scans take."""
    d = _documents(spark, path, _TRIVY).select(F.explode("Results").alias("r")).select(F.lower(F.trim("r.Type")).alias("type"), F.explode("r.Vulnerabilities").alias("v"))
    kinds = F.create_map(*[F.lit(x) for kv in RESULT_TYPES.items() for x in kv])
    given = F.col("v.PkgIdentifier.PURL")
    purl = F.when(canonical_purl(given).isNotNull(), given)  # an invalid one is none, so names and versions are matched
    eco = F.coalesce(F.when(purl.startswith("pkg:"), F.lower(F.regexp_extract(purl, "^pkg:([^/]+)", 1))), F.try_element_at(kinds, F.coalesce("type", F.lit(""))))
    return d.select("v.VulnerabilityID", "v.PkgName", "v.InstalledVersion", "v.FixedVersion", F.coalesce("v.Severity", F.lit("UNKNOWN")).alias("Severity"), F.coalesce("v.Title", "v.VulnerabilityID").alias("Title"), purl.alias("PURL"), eco.alias("Ecosystem"), F.col("v.Layer.DiffID").alias("LayerDiffID"))


def sarif_findings(spark: SparkSession, path: str) -> DataFrame:
    """file, rule, severity, title of failed results; the severity comes from the result, else its rule."""
    runs = _documents(spark, path, _SARIF).select(F.col("_metadata.file_path").alias("source"), F.posexplode("runs").alias("at", "r")).withColumn("run", F.struct("source", "at"))
    rules = runs.select("run", F.explode("r.tool.driver.rules").alias("u")).select("run", F.col("u.id").alias("rule"), F.col("u.properties.security-severity").alias("rule_score"), F.col("u.defaultConfiguration.level").alias("rule_level")).dropDuplicates(["run", "rule"])
    results = runs.select("run", F.posexplode("r.results").alias("seq", "x")).filter("x.kind IS NULL OR x.kind = 'fail'")
    results = results.withColumn("rule", F.coalesce("x.ruleId", "x.rule.id")).join(rules, ["run", "rule"], "left")
    score = F.coalesce(F.col("x.properties.security-severity").try_cast("double"), F.col("rule_score").try_cast("double"))
    level = F.coalesce("x.level", "rule_level", F.lit("warning"))
    sev = F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score.isNotNull(), "low").when(level == "error", "high").when(level == "warning", "medium").otherwise("low")
    uri = F.get(F.col("x.locations"), F.lit(0))["physicalLocation"]["artifactLocation"]["uri"]
    file = F.regexp_replace(F.regexp_replace(uri, "^file://", ""), "^/+", "")
    return results.select(file.alias("file"), "rule", sev.alias("severity"), F.left(F.substring_index(F.trim("x.message.text"), "\n", 1), F.lit(200)).alias("title"))


def first_layer(packages: DataFrame) -> DataFrame:
    """(purl, layer): of the layers that hold a package (purl, layer, layer_idx) the first (SRC-16)."""
    return packages.groupBy("purl").agg(F.min_by("layer", "layer_idx").alias("layer"))
