"""Operator 6: rule bitmask ledger.

Every rule is evaluated once for each document; the ledger is a table that keeps
the failure bits beside the measurements and the version of the rules.  A policy is a version and a mask of rules, so
new policies and ablations read the ledger and never the texts.

Null, empty and blank texts have no words: they fail ``few_words`` only.
Repeated rows get a row each; an empty table gives an empty ledger; the texts
are measured whole, however long; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import stored, table

#: Rule by bit: a column expression that is true on failure.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "exclamations": "2 * n_bangs > n_words",
    "capitals": "2 * n_capitals > word_chars",
}
#: Changes with the rules; ledgers of other rule sets aren't read.
RULE_SET = "1"
BASE = ("few_words", "repeated_windows")
#: Versioned policies; the last is the one in force.
POLICIES = {"1": BASE, "2": tuple(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals")

_SPACE = b" \t\n\r\x0b\x0c"
_CAPITALS = bytes(range(65, 91))


def mask(rules) -> int:
    rules = set(rules)
    return sum(1 << i for i, name in enumerate(RULES) if name in rules)


def repeat_words(ws: list[bytes]) -> int:
    """Words inside three-word windows that the text has at least twice."""
    if len(ws) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in ws], np.int64)
    pair = a[:-2] * len(ids) + a[1:-1]
    if len(ids) ** 3 >= 1 << 63:
        pair = np.unique(pair, return_inverse=True)[1]
    _, window, count = np.unique(pair * len(ids) + a[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    inside = np.zeros(len(a), bool)
    for k in range(3):
        inside[k : len(a) - 2 + k] |= again
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    b = (text or "").encode("utf-8", "replace")
    ws = b.split()
    lines = [x for x in b.split(b"\n") if x.strip(_SPACE)] if b"\n" in b else b.split(b"\n")[: bool(ws)]
    without = lambda chars: len(b) - len(b.translate(None, chars))
    return (len(ws), len(text or "") - without(_SPACE), without(b"#*$%&|<>"), len(lines) - len(set(lines)), repeat_words(ws), len(lines), without(b"!"), without(_CAPITALS))


def _measured(batches):
    for batch in batches:
        rows = [measure(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *MEASURES])


def ledger(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, measurements, ``failed`` (the bits of the rules that failed) and rule_set, stored at ``path`` (None: in the shared folder)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_measured, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    rows = rows.withColumn("failed", failed).withColumn("rule_set", F.lit(RULE_SET))
    if path is None:
        return stored(rows, "quality-ledger")
    rows.write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path).filter(F.col("rule_set") == RULE_SET)


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: failures, and documents that only this rule rejects."""
    active = mask(POLICIES[version])
    by_bits = rows.groupBy(F.col("failed").bitwiseAND(F.lit(active)).alias("failed")).count()
    each = by_bits.select("failed", "count", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).alias("bit")) for i, n in enumerate(RULES) if n in POLICIES[version]])).alias("r"))
    hit = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy("r.rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("count"))), F.lit(0)).alias("n_only_this"),
    )


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), list(POLICIES)[-1])
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, i, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, len(ws) AS n FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
x AS (SELECT r, i, i + 2 <= n AND count(*) OVER (PARTITION BY r, i + 2 <= n, w1, w2, w3) > 1 AS again FROM w),
y AS (SELECT r, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM x),
rep AS (SELECT r, count(*) FILTER (inside) AS n_repeat_words FROM y GROUP BY r),
li AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM li WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_bangs > n_words OR 2 * n_capitals > word_chars) AS kept
FROM m
"""
