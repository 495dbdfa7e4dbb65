"""Git histories as a data source, and queries over their tables (SRC-09 to SRC-13).

``spark.read.format("git_manifest").option("repos", ...).option("manifest", ...)``
reads one partition for each repository; git must be on the executors' path.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "repo string, pos bigint, sha string, author string, ts bigint, subject string, path string, text string"
_BLAME = "repo string, rev string, line int, sha string, text string"


def _git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=600)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def manifest_log(repo: str, manifest: str, rev: str = "HEAD"):
    """(sha, author, ts, subject, path) of the commits that touched a manifest, oldest first, through renames."""
    log = _git(repo, "log", "--first-parent", "--follow", "--name-only", "--format=%x01%H%x02%ae%x02%ct%x02%s", rev, "--", manifest)
    found = []
    for entry in log.split("\x01")[1:]:
        head, _, names = entry.partition("\n")
        sha, author, ts, subject = head.split("\x02", 3)
        paths = [n for n in names.split("\n") if n]
        found.append((sha, author, int(ts), subject, paths[-1] if paths else manifest))
    return found[::-1]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(r) for r in self.options["repos"].split(",")]

    def read(self, partition):
        repo, manifest, rev = partition.value, self.options["manifest"], self.options.get("rev", "HEAD")
        if self.options.get("table") == "blame":
            out = _git(repo, "blame", "--line-porcelain", rev, "--", manifest)
            sha, line = "", 0
            for text in out.split("\n"):
                if text.startswith("\t"):
                    yield (repo, rev, line, sha, text[1:])
                    line += 1
                elif len(text) > 41 and text[40] == " " and all(c in "0123456789abcdef" for c in text[:40]):
                    sha = text[:40]
            return
        for pos, (sha, author, ts, subject, path) in enumerate(manifest_log(repo, manifest, rev)):
            yield (repo, pos, sha, author, ts, subject, path, _git(repo, "show", f"{sha}:{path}"))


class GitManifest(DataSource):
    @classmethod
    def name(cls):
        return "git_manifest"

    def schema(self):
        return _BLAME if self.options.get("table") == "blame" else _SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))


def manifest_history(spark: SparkSession, repos: list[str], manifest: str, **options: str) -> DataFrame:
    spark.dataSource.register(GitManifest)
    return spark.read.format("git_manifest").options(repos=",".join(repos), manifest=manifest, **options).load()


def blame_introducers(pins: DataFrame, blame: DataFrame) -> DataFrame:
    """repo, name, version, sha of the line that holds each pin (SRC-11): an equi-join on the line."""
    return pins.join(blame.select("repo", "line", "sha"), ["repo", "line"]).select("repo", "name", "version", "sha")


def pickaxe_newest(history: DataFrame, token) -> DataFrame:
    """repo, sha of the newest commit that changed how often a text occurs."""
    w = Window.partitionBy("repo").orderBy("pos")
    n = F.size(F.split("text", F.concat(F.lit(r"\Q"), token, F.lit(r"\E")))) - 1
    rows = history.withColumn("n", n).withColumn("was", F.coalesce(F.lag("n").over(w), F.lit(0))).filter("n <> was")
    return rows.groupBy("repo").agg(F.max_by("sha", "pos").alias("sha"))


def pickaxe_first(history: DataFrame, pattern: str) -> DataFrame:
    """repo, sha of the oldest commit with an added or removed line that matches."""
    w = Window.partitionBy("repo").orderBy("pos")
    lines = F.split("text", "\n")
    rows = history.withColumn("lines", lines).withColumn("was", F.coalesce(F.lag("lines").over(w), F.array().cast("array<string>")))
    changed = F.concat(F.array_except("lines", "was"), F.array_except("was", "lines"))
    return rows.filter(F.exists(changed, lambda x: x.rlike(f"(?i){pattern}"))).groupBy("repo").agg(F.min_by("sha", "pos").alias("sha"))


def safe_path(path):
    """Relative, without a parent step or backslash."""
    return ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ~F.contains(path, F.lit("\\"))


def source_files(files: DataFrame, prefixes=(), suffixes=(".py",), names=(), anywhere=()) -> DataFrame:
    """Files (path, text) of a snapshot by prefix and suffix, top-level name, or name pattern anywhere (SRC-13)."""
    p = F.col("path")
    inside = F.lit(not prefixes)
    for x in prefixes:
        inside = inside | p.startswith(x)
    ends = F.lit(not suffixes)
    for x in suffixes:
        ends = ends | p.endswith(x)
    base = F.substring_index(p, "/", -1)
    other = F.lit(False)
    for x in anywhere:
        other = other | base.rlike("^" + x.replace(".", r"\.").replace("*", ".*") + "$")
    return files.filter(safe_path(p) & ((inside & ends) | p.isin(*names) | other))
