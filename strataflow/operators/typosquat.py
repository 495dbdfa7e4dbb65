"""Typosquat detection as a similarity join (TYP-01 to TYP-06).

Popular names become an index of derived keys; every technique is an equi-join
of distinct names with one key column, followed by a residual check where the
key alone doesn't decide.  Names are scored once each, however often they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.functions.names import AFFIXES, deglyph, deletions, osa_at_most_one, osa_distance, sorted_tokens, squash, squat_normalize, tokens

# Base score of each technique, in the order in which candidates are considered.
BASE = {"separator": 0.95, "homoglyph": 0.9, "typo1": 0.85, "typo2": 0.65, "reorder": 0.8, "combosquat": 0.6, "suffix": 0.7, "brandjack": 0.45}
BRAND_RANK, BRAND_LENGTH = 300, 5


def reference_index(popular: DataFrame) -> DataFrame:
    """(target, rank and key columns) of ranked popular names; the best rank of equal names counts."""
    p = popular.select(squat_normalize(F.col("name")).alias("target"), "rank").groupBy("target").agg(F.min("rank").alias("rank"))
    sq = squash(F.col("target"))
    return p.withColumns({"squashed": sq, "glyphs": deglyph(sq), "token_key": sorted_tokens(F.col("target")), "n_tokens": F.size(tokens(F.col("target")))})


def _first(index: DataFrame, key: str) -> DataFrame:
    """The best ranked target of each key."""
    return index.groupBy(key).agg(F.min_by(F.struct("target", "rank"), "rank").alias("t")).select(key, "t.*")


def candidates(names: DataFrame, index: DataFrame, enabled=tuple(BASE)) -> DataFrame:
    """(name, target, rank, technique) of distinct names that aren't popular themselves."""
    n = names.select("name").distinct().withColumn("norm", squat_normalize(F.col("name")))
    n = n.join(index.select(F.col("target").alias("norm")), "norm", "left_anti")
    sq = squash(F.col("name"))
    n = n.withColumns({"squashed": sq, "glyphs": deglyph(sq), "token_key": sorted_tokens(F.col("norm")), "parts": tokens(F.col("norm"))})
    found = []

    def take(rows, technique):
        if technique in enabled:
            found.append(rows.select("name", "target", "rank", F.lit(technique).alias("technique")))

    take(n.join(_first(index, "squashed"), "squashed").filter("norm <> target"), "separator")
    take(n.filter("glyphs <> squashed").join(_first(index, "glyphs"), "glyphs").filter("norm <> target"), "homoglyph")
    if {"typo1", "typo2"} & set(enabled):
        long = F.length("norm") >= 9
        mine = n.filter(F.length("norm") >= 4).select("name", "norm", F.explode(F.when(long, deletions(F.col("norm"), 2)).otherwise(deletions(F.col("norm")))).alias("key"))
        keys = index.filter(F.length("target") >= 4).select("target", "rank", F.explode(F.when(F.length("target") >= 9, deletions(F.col("target"), 2)).otherwise(deletions(F.col("target")))).alias("key"))
        met = mine.join(keys, "key").filter(F.abs(F.length("norm") - F.length("target")) <= 2).select("name", "norm", "target", "rank").distinct()
        one = osa_at_most_one(F.col("norm"), F.col("target"))
        take(met.filter(one), "typo1")
        if "typo2" in enabled:
            both = met.filter((F.length("norm") >= 9) & (F.length("target") >= 9) & ~one)
            take(both.withColumn("d", osa_distance("norm", "target")).filter("d = 2"), "typo2")
    take(n.filter(F.size("parts") >= 2).join(_first(index.filter("n_tokens >= 2"), "token_key"), "token_key").filter("norm <> target"), "reorder")
    if "combosquat" in enabled:
        size = F.size("parts")
        runs = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(i, size), lambda j: F.struct(i.alias("i"), j.alias("j")))))
        each = n.filter(size >= 2).withColumn("r", F.explode(runs)).filter((F.col("r.j") - F.col("r.i") + 1) < F.size("parts"))
        core = F.array_join(F.slice("parts", F.col("r.i"), F.col("r.j") - F.col("r.i") + 1), "-")
        rest = F.concat(F.slice("parts", F.lit(1), F.col("r.i") - 1), F.slice("parts", F.col("r.j") + 1, F.size("parts")))
        each = each.filter(F.forall(rest, lambda x: x.isin(*AFFIXES))).select("name", core.alias("target")).filter(F.length("target") >= 4).distinct()
        take(each.join(index.select("target", "rank"), "target"), "combosquat")
    if "suffix" in enabled:
        cut = n.withColumn("core", F.regexp_replace("norm", "[0-9-]*$", "")).filter("core <> norm AND core <> ''")
        exact = cut.join(index.select("target", "rank"), F.col("core") == F.col("target"))
        near = cut.join(index.select(F.col("target").alias("core")), "core", "left_anti").filter(F.length("core") >= 4).select("name", "core", F.explode(deletions(F.col("core"))).alias("key"))
        keys = index.filter(F.length("target") >= 4).filter(~F.col("target").rlike("[0-9]$")).select("target", "rank", F.explode(deletions(F.col("target"))).alias("key"))
        close = near.join(keys, "key").filter(osa_at_most_one(F.col("core"), F.col("target")))
        take(exact.select("name", "target", "rank").union(close.select("name", "target", "rank")).distinct(), "suffix")
    brands = index.filter((F.col("rank") < BRAND_RANK) & (F.length("target") >= BRAND_LENGTH)).select("target", "rank")
    take(n.filter(F.size("parts") >= 2).select("name", F.explode("parts").alias("target")).distinct().join(brands, "target"), "brandjack")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def score(rows: DataFrame) -> DataFrame:
    """Adds the score of each candidate."""
    base = F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv])[F.col("technique")]
    n = F.length("target")
    short = F.when(F.col("technique") != "typo1", 1.0).when(n == 4, 0.7).when(n == 5, 0.8).when(n == 6, 0.9).when(n > 6, 1.0).otherwise(0.6)
    return rows.withColumn("score", F.round(base * (1 - 0.1 * F.log10(1 + F.col("rank"))) * short, 4))


def best_matches(names: DataFrame, popular: DataFrame, enabled=tuple(BASE)) -> DataFrame:
    """(name, target, technique, score): the best candidate of each name; names without one are left out."""
    order = F.array_position(F.array(*map(F.lit, BASE)), F.col("technique"))
    w = Window.partitionBy("name").orderBy(F.col("score").desc(), "rank", order, "target")
    rows = score(candidates(names, reference_index(popular), enabled))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("name", "target", "technique", "score")


def edit_baseline(names: DataFrame, popular: DataFrame) -> DataFrame:
    return best_matches(names, popular, ("typo1",))


def levenshtein_baseline(names: DataFrame, popular: DataFrame, least: int = 5) -> DataFrame:
    """(name, target): names one edit from a popular name of at least five characters."""
    p = popular.select(F.lower("name").alias("target")).filter(F.length("target") >= least).distinct()
    n = names.select("name", F.lower("name").alias("norm")).distinct().join(p.withColumnRenamed("target", "norm"), "norm", "left_anti")
    mine = n.select("name", "norm", F.explode(deletions(F.col("norm"))).alias("key"))
    met = mine.join(p.select("target", F.explode(deletions(F.col("target"))).alias("key")), "key").select("name", "norm", "target").distinct()
    return met.filter(F.levenshtein("norm", "target", 1) >= 0).select("name", "target")


def variants(name):
    """Array of (kind, variant) by dropping, doubling, swapping and replacing characters and words."""
    n = F.length(name)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    piece = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("variant"))
    left, char, right = (lambda i: F.left(name, i - 1)), (lambda i: F.substring(name, i, F.lit(1))), (lambda i: F.substring(name, i + 1, n))
    omitted = F.transform(at, lambda i: piece("omitted", F.concat(left(i), right(i))))
    repeated = F.transform(F.filter(at, lambda i: char(i) == F.substring(name, i + 1, F.lit(1))), lambda i: piece("repeated", F.concat(left(i), right(i))))
    swapped = F.transform(F.filter(at, lambda i: i < n), lambda i: piece("swapped", F.concat(left(i), F.substring(name, i + 1, F.lit(1)), char(i), F.substring(name, i + 2, n))))
    version = F.array(piece("version", F.regexp_replace(name, "[-_.]?[0-9]+$", "")))
    words = F.split(name, "[-_.]")
    turned = F.array(piece("swapped_words", F.array_join(F.reverse(words), "-")))
    return F.array_distinct(F.concat(omitted, repeated, swapped, version, turned))


def variant_baseline(names: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, target, kind): names of which a variant is popular."""
    p = popular.select(F.lower("name").alias("target")).distinct()
    n = names.select(F.lower("name").alias("name")).distinct().join(p.withColumnRenamed("target", "name"), "name", "left_anti")
    each = n.select("name", F.explode(variants(F.col("name"))).alias("v")).select("name", F.col("v.kind").alias("kind"), F.col("v.variant").alias("target"))
    return each.join(p, "target").select("name", "target", "kind").distinct()
