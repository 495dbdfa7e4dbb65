"""Popularity lists and advisory dumps (SRC-07, SRC-14, AGG-06)."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ADVISORY = (
    "id string, aliases array<string>, withdrawn string, published string, summary string, details string, severity array<struct<type:string,score:string>>, database_specific struct<severity:string>, "
    "affected array<struct<package:struct<name:string,ecosystem:string,purl:string>,versions:array<string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
)


def ranked(names: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """name, rank from 0 of a list of names by a falling count; the list is as long as a registry's top list."""
    out = names.withColumn("rank", (F.row_number().over(Window.orderBy(F.col(by).desc(), "name")) - 1).cast("long")).select("name", "rank")
    return out.filter(F.col("rank") < n) if n else out


def top_projects(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """A JSON file with rows of project and download_count."""
    rows = spark.read.schema("rows array<struct<project:string,download_count:bigint>>").json(path, multiLine=True).select(F.inline("rows"))
    return ranked(rows.select(F.col("project").alias("name"), "download_count"), "download_count", n)


def top_script_names(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Quoted names, one a line of a script file, in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "t"))
    names = lines.select("line", F.regexp_extract("t", r"^\s*'([^']+)',?\s*$", 1).alias("name")).filter("name <> ''")
    return ranked(names.select("name", (-F.col("line")).alias("score")), "score", n)


def _members(batches):
    for batch in batches:
        for content in batch.column("content"):
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                for name in z.namelist():
                    if name.endswith(".json"):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([z.read(name).decode("utf-8", "replace")])], ["member", "value"])


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """Records of zipped JSON dumps, one task for each zip file, with their ordinal."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(_members, "member string, value string").withColumn("r", F.from_json("value", ADVISORY))
    return rows.select("member", "r.*")


def advisory_rows(records: DataFrame) -> DataFrame:
    """osv_id, ecosystem, name, versions, events and type: one row for each affected range."""
    a = records.filter("withdrawn IS NULL").select(F.col("id").alias("osv_id"), F.explode("affected").alias("a"))
    a = a.select("osv_id", F.lower("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("name"), "a.versions", F.explode_outer("a.ranges").alias("r"))
    return a.select("osv_id", "ecosystem", "name", "versions", F.col("r.type").alias("type"), F.col("r.events").alias("events"))


def malicious_labels(records: DataFrame, mention) -> DataFrame:
    """name, typosquat, published: of equal names any mention and the first date (AGG-06)."""
    return records.groupBy("name").agg(F.bool_or(mention).alias("typosquat"), F.min("published").alias("published"))
