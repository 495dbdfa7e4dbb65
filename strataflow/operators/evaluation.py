"""Evaluation analytics: confusion metrics, intervals, bootstrap, agreement (AGG-04 to AGG-13)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(c, digits: int = 4):
    return F.bround(c, digits)


def ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, flagged, truth, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn of each group."""
    return rows.groupBy(*by).agg(F.count_if(flagged & truth).alias("tp"), F.count_if(flagged & ~truth).alias("fp"), F.count_if(~flagged & truth).alias("fn"), F.count_if(~flagged & ~truth).alias("tn"))


def metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, false positive rate and precision at two prevalences.

    The last two start from the rounded recall and rate.
    """
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    out = counts.withColumns({"_p": ratio(tp, tp + fp), "_r": ratio(tp, tp + fn)})
    out = out.withColumns({"precision": rounded(F.col("_p")), "recall": rounded(F.col("_r")), "f1": rounded(ratio(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r"))), "fpr": rounded(ratio(fp, fp + tn), 6)})
    for label, share in (("precision_at_1pct", 0.01), ("precision_at_01pct", 0.001)):
        hit, miss = F.col("recall") * share, F.col("fpr") * (1 - share)
        out = out.withColumn(label, rounded(ratio(hit, hit + miss)))
    return out.drop("_p", "_r")


def thresholds() -> list[float]:
    return [round(0.3 + 0.02 * k, 2) for k in range(35)]


def threshold_sweep(rows: DataFrame, score: str, truth, at: list[float] | None = None) -> DataFrame:
    """Metrics at each threshold of a fixed short list.

    Rows are first counted by the number of thresholds they reach, so the rows
    themselves are read once and never multiplied.
    """
    at = sorted(at or thresholds())
    reached = F.size(F.filter(F.array(*map(F.lit, at)), lambda t: F.col(score) >= t)).alias("reached")
    counts = rows.groupBy(reached).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    sums = [F.struct(F.lit(t).alias("threshold"), F.sum(F.when(F.col("reached") > k, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("reached") > k, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("reached") <= k, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(F.col("reached") <= k, F.col("neg")).otherwise(0)).alias("tn")) for k, t in enumerate(at)]
    return metrics(counts.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*").filter("tp IS NOT NULL"))


def operating_point(sweep: DataFrame, most_fpr: float = 0.02) -> DataFrame:
    """The threshold of the best F1 among those with few false positives; the higher of equals."""
    return sweep.filter(F.col("fpr") <= most_fpr).orderBy(F.col("f1").desc(), F.col("threshold").desc()).limit(1)


def wilson(k, n, z: float = 1.96):
    """Struct (low, high) of the Wilson interval."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct(rounded(F.greatest(mid - half, F.lit(0.0))).alias("low"), rounded(F.least(mid + half, F.lit(1.0))).alias("high")))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    if p >= 1:
        return 1.0
    return min(1.0, math.fsum(math.exp(_log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1)))


def _solve(f) -> float:
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) else (low, mid)
    return (low + high) / 2


def clopper_pearson_bounds(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    low = 0.0 if k == 0 else _solve(lambda p: binomial_tail(k, n, p) < alpha / 2)
    high = 1.0 if k == n else _solve(lambda p: 1 - binomial_tail(k + 1, n, p) > alpha / 2)
    return low, high


def exact_lower(k: int, n: int, alpha: float = 0.05) -> float:
    """One-sided exact lower bound."""
    return 0.0 if k == 0 else _solve(lambda p: binomial_tail(k, n, p) < alpha)


@F.pandas_udf(T.StructType().add("low", "double").add("high", "double"))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Exact interval; for rows that are aggregates already."""
    return pd.DataFrame([[round(x, 4) for x in clopper_pearson_bounds(int(a), int(b))] for a, b in zip(k, n)], columns=["low", "high"])


def mcnemar_p(only_a: int, only_b: int) -> float | None:
    n = only_a + only_b
    if not n:
        return None
    p = min(1.0, 2 * (1 - binomial_tail(min(only_a, only_b) + 1, n, 0.5)))
    return float(f"{p:.3g}")


@F.pandas_udf(T.DoubleType())
def mcnemar(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(a), int(b)) for a, b in zip(only_a, only_b)], dtype="float64")


def paired_table(rows: DataFrame, a, b, by: list[str] = ()) -> DataFrame:
    """both, only_a, only_b, neither of two flags."""
    return rows.groupBy(*by).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


def cluster_bootstrap(rows: DataFrame, cluster: str, correct: str, total: str, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """(low, high): percentile interval of sum(correct) / sum(total), clusters drawn with replacement.

    Clusters are summed first; in each round they get Poisson weights from a hash
    of round and cluster, so every round is a sum and clusters are never gathered.
    """
    sums = rows.select(F.col(cluster).alias("_key"), F.col(correct).alias("_correct"), F.col(total).alias("_total")).groupBy("_key").agg(F.sum("_correct").alias("_c"), F.sum("_total").alias("_t"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("_key"), F.col("round")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    limits, p, edge = [], math.exp(-1), 0.0
    for k in range(8):
        edge += p / math.factorial(k)
        limits.append(edge)
    weight = F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < u))
    each = sums.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("w", weight)
    means = each.groupBy("round").agg((F.sum(F.col("_c") * F.col("w")) / F.nullif(F.sum(F.col("_t") * F.col("w")), F.lit(0))).alias("m")).filter("m IS NOT NULL")
    s = means.agg(F.array_sort(F.collect_list("m")).alias("s")).withColumn("n", F.size("s"))
    at = lambda i: F.get("s", i.cast("int"))
    return s.select(at(F.floor(F.col("n") * 0.025)).alias("low"), at(F.greatest(F.floor(F.col("n") * 0.975) - 1, F.lit(0))).alias("high"))


def seeded_bootstrap(values: np.ndarray, rounds: int = 2000, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of a mean; indices int(.025 B) and int(.975 B) - 1 of the sorted means."""
    rng = np.random.default_rng(seed)
    means = np.sort(rng.multinomial(len(values), np.full(len(values), 1 / len(values)), rounds) @ values / len(values))
    return float(means[int(0.025 * rounds)]), float(means[int(0.975 * rounds) - 1])


def grouped_summary(rows: DataFrame, sets: list[str], correct: str, total: str) -> DataFrame:
    """Sums and share over a rollup of the columns: pooled, by ecosystem, by repository."""
    return rows.rollup(*sets).agg(F.sum(correct).alias("correct"), F.sum(total).alias("total")).withColumn("share", rounded(F.col("correct") / F.col("total"), 6))


def set_agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of both, of their intersection and union, Jaccard."""
    flags = a.select(key).distinct().withColumn("in_a", F.lit(True)).join(b.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    out = flags.agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count_if(both).alias("n_both"), F.count("*").alias("n_union"))
    return out.withColumn("jaccard", rounded(F.col("n_both") / F.col("n_union"), 6))
