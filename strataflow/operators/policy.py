"""Policy rules and verdict (AGG-01 to AGG-03, SET-05).

A rule takes the gate's tables and returns reason rows; rules are kept in a
list, and users may pass their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions.severity import severity_rank, verdict_of_rank, verdict_rank
from strataflow.operators.graph import Collected, first_per

#: Tools whose findings count as scanner findings.
SCANNERS = ("trivy", "grype", "osv")
RULES: list[Callable[[Collected], DataFrame]] = []
_COLUMNS = ("rule", "verdict", "finding", "msg", "seq")


def rule(f):
    RULES.append(f)
    return f


def _reasons(rows: DataFrame, name: str, verdict, finding, msg) -> DataFrame:
    return rows.withColumns({"rule": F.lit(name), "verdict": verdict, "finding": finding, "msg": msg}).filter("verdict IS NOT NULL").select(*_COLUMNS)


@rule
def provenance_integrity(run: Collected) -> DataFrame:
    none = F.lit(None).cast("string")
    bad = _reasons(run.rejected.withColumn("seq", F.col("env_idx").cast("long")), "provenance_integrity", F.lit("block"), none, F.concat(F.lit("envelope "), F.col("env_idx").cast("string"), F.lit(": "), F.col("reject_reason")))
    gone = _reasons(run.missing_stages().withColumn("seq", F.lit(1 << 40).cast("long")), "provenance_integrity", F.lit("block"), none, F.concat(F.lit("missing stage "), F.col("stage")))
    return bad.unionByName(gone)


@rule
def malicious_dependency(run: Collected) -> DataFrame:
    rows = run.findings.filter("source = 'risk'")
    return _reasons(rows, "malicious_dependency", F.when(F.col("severity") == "critical", "block").otherwise("warn"), F.col("id"), F.col("title"))


@rule
def vulnerable_dependency(run: Collected) -> DataFrame:
    rows = run.findings.filter(F.col("source").isin(*SCANNERS))
    rank = severity_rank(F.col("severity"))
    unreached = F.col("reachable").eqNullSafe(F.lit(False))
    return _reasons(rows, "vulnerable_dependency", F.when(rank >= 2, F.when(unreached, "warn").otherwise("block")).when(rank == 1, "warn"), F.col("id"), F.col("title"))


@rule
def unattributed_finding(run: Collected) -> DataFrame:
    rows = first_per(run.unmatched.filter(F.col("source").isin(*SCANNERS)), "id")
    return _reasons(rows, "unattributed_finding", F.when(severity_rank(F.col("severity")) >= 2, "block").otherwise("warn"), F.col("id"), F.col("title"))


@rule
def sast(run: Collected) -> DataFrame:
    rank = severity_rank(F.col("severity"))
    return _reasons(run.findings.filter("source = 'sast'"), "sast", F.when(rank >= 2, "block").when(rank == 1, "warn"), F.col("id"), F.col("title"))


def reasons(run: Collected, rules=None) -> DataFrame:
    """All reasons with ``rule_no``; an empty list of rules gives none."""
    chosen = RULES if rules is None else rules
    frames = [f(run).withColumn("rule_no", F.lit(k)) for k, f in enumerate(chosen)]
    if not frames:
        return run.findings.sparkSession.createDataFrame([], "rule string, verdict string, finding string, msg string, seq long, rule_no int")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def decide(rows: DataFrame) -> DataFrame:
    """One row: the gravest verdict (pass without reasons) and the reasons in order of rule and finding."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rule_no", "seq", "finding", "rule", "verdict", "msg"))), lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"), r["finding"].alias("finding"), r["msg"].alias("msg")))
    return rows.agg(verdict_of_rank(F.coalesce(F.max(verdict_rank(F.col("verdict"))), F.lit(0))).alias("verdict"), ordered.alias("reasons"))


def tally(rows: DataFrame) -> DataFrame:
    """verdict, n_reasons, n_block: the decision of ``decide`` without its list, so nothing is collected."""
    return rows.agg(verdict_of_rank(F.coalesce(F.max(verdict_rank(F.col("verdict"))), F.lit(0))).alias("verdict"), F.count("*").alias("n_reasons"), F.count_if(F.col("verdict") == "block").alias("n_block"))


#: The same rules in SQL, over views findings, unmatched, rejected and missing; for parity tests.
SQL_RULES = """
SELECT 'provenance_integrity' AS rule, 'block' AS verdict, CAST(NULL AS STRING) AS finding FROM rejected
UNION ALL SELECT 'provenance_integrity', 'block', NULL FROM missing
UNION ALL SELECT 'malicious_dependency', CASE WHEN severity = 'critical' THEN 'block' ELSE 'warn' END, id FROM findings WHERE source = 'risk'
UNION ALL SELECT 'vulnerable_dependency', CASE WHEN severity = 'medium' OR reachable <=> false THEN 'warn' ELSE 'block' END, id
  FROM findings WHERE source IN ('trivy', 'grype', 'osv') AND severity <> 'low'
UNION ALL SELECT DISTINCT 'unattributed_finding', FIRST_VALUE(CASE WHEN severity IN ('high', 'critical') THEN 'block' ELSE 'warn' END) OVER (PARTITION BY id ORDER BY seq), id
  FROM unmatched WHERE source IN ('trivy', 'grype', 'osv')
UNION ALL SELECT 'sast', CASE WHEN severity = 'medium' THEN 'warn' ELSE 'block' END, id FROM findings WHERE source = 'sast' AND severity <> 'low'
"""
