"""Envelopes as a stream: verified without state, findings dropped when repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.sources.envelopes import verify

SCHEMA = "env_idx bigint, payload_type string, payload string, keyid string, sig string, at timestamp"


def read_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).json(folder)


def verified_stream(envelopes: DataFrame, trusted: dict[str, bytes]) -> DataFrame:
    rows = envelopes.withColumn("parse_error", F.when(F.col("payload").isNull() | F.col("sig").isNull(), "missing field"))
    return verify(rows, trusted)


def new_findings(findings: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Findings (id, at, ...) seen for the first time; ids are remembered for ``delay``."""
    return findings.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def severity_windows(findings: DataFrame, size: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Findings of each severity in windows of event time."""
    return findings.withWatermark("at", delay).groupBy(F.window("at", size), "severity").agg(F.count("*").alias("n"))
