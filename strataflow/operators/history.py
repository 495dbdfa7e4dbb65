"""Manifest history: diffs, sequences, runs, as-of attribution, samples (WIN-01 to WIN-11, TRV-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIN = ("repo", "name", "version")


def _each_once(pins: DataFrame, *more: str) -> DataFrame:
    """Distinct (repo, name, version, pos) with before and after, the pin's next positions; found in the one sort that windows over them need anyway."""
    w = Window.partitionBy(*PIN).orderBy("pos")
    seen = pins.select(*PIN, "pos", *more).withColumn("before", F.lag("pos").over(w)).filter(~F.col("before").eqNullSafe(F.col("pos")))
    return seen.withColumns({"before": F.lag("pos").over(w), "after": F.lead("pos").over(w)})


def starts() -> Column:
    return ~F.col("before").eqNullSafe(F.col("pos") - 1)


def ends() -> Column:
    return ~F.col("after").eqNullSafe(F.col("pos") + 1)


def pin_changes(pins: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, pos, name, version, op): what each commit added to and removed from its predecessor's pins.

    One window over each pin's own positions; no snapshot is built.
    """
    seen = _each_once(pins)
    last = commits.groupBy("repo").agg(F.max("pos").alias("last"))
    added = seen.filter(starts()).select("repo", "pos", "name", "version", F.lit("added").alias("op"))
    ended = seen.filter(ends()).join(last, "repo").filter(F.col("pos") < F.col("last"))
    return added.unionByName(ended.select("repo", (F.col("pos") + 1).alias("pos"), "name", "version", F.lit("removed").alias("op")))


def commit_sequence(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Changing commits numbered from 0 within their repository."""
    changed = changes.select("repo", "pos").distinct()
    w = Window.partitionBy("repo").orderBy("pos")
    return commits.join(changed, ["repo", "pos"]).withColumn("seq", (F.row_number().over(w) - 1).cast("long")).select("repo", "pos", "sha", "seq")


def pin_runs(pins: DataFrame) -> DataFrame:
    """(repo, name, version, first_pos, last_pos): unbroken runs of a pin."""
    w = Window.partitionBy(*PIN).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    runs = _each_once(pins).withColumn("first_pos", F.last(F.when(starts(), F.col("pos")), ignorenulls=True).over(w))
    return runs.filter(ends()).select(*PIN, "first_pos", F.col("pos").alias("last_pos"))


def re_bumps(changes: DataFrame) -> DataFrame:
    """Added pins that an earlier commit had added before."""
    w = Window.partitionBy(*PIN).orderBy("pos")
    return changes.filter("op = 'added'").withColumn("first_pos", F.first("pos").over(w)).filter("first_pos < pos").select(*PIN, "pos", "first_pos")


def places(n: Column, k: int) -> Column:
    """``k`` evenly spaced positions among ``n``, distinct."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(max(1, k - 1))).cast("long")))


def snapshots(commits: DataFrame, k: int) -> DataFrame:
    """(repo, pos): ``k`` evenly spaced positions of each repository, distinct."""
    n = commits.groupBy("repo").agg((F.max("pos") + 1).alias("n"))
    return n.select("repo", F.explode(places(F.col("n"), k)).alias("pos"))


def introducers_held(pins: DataFrame, newest: bool = True) -> DataFrame:
    """(repo, snapshot, name, version, commit): as ``introducers_asof``, of pins that know their ``commit`` and whether it is a snapshot (``taken``).

    One window over each pin's own positions; changes are not joined to snapshots.
    """
    w = Window.partitionBy(*PIN).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    pick = F.last if newest else F.first
    found = _each_once(pins.dropna(subset=list(PIN)), "commit", "taken").withColumn("commit", pick(F.when(starts(), F.col("commit")), ignorenulls=True).over(w))
    return found.filter("taken").select("repo", F.col("pos").alias("snapshot"), "name", "version", "commit")


def introducers_asof(changes: DataFrame, commits: DataFrame, pins: DataFrame, at: DataFrame, newest: bool = True) -> DataFrame:
    """For each pin of each snapshot, the newest (or first) commit up to it that added the pin."""
    held = pins.select(*PIN, "pos").distinct().join(at, ["repo", "pos"]).withColumnRenamed("pos", "snapshot")
    added = changes.filter("op = 'added'").select(*PIN, "pos").join(commits.select("repo", "pos", "sha"), ["repo", "pos"])
    pick = F.max_by if newest else F.min_by
    found = held.join(added, list(PIN)).filter("pos <= snapshot")
    return found.groupBy(*PIN, "snapshot").agg(pick("sha", "pos").alias("sha"))


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: str = "") -> DataFrame:
    """The first ``n`` rows of each stratum by hash of the key: the same rows on every run and engine."""
    w = Window.partitionBy(*strata).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def is_test(name):
    """Hash split: test if the SHA-256 is even."""
    return F.right(F.sha2(name, 256), F.lit(1)).isin(*"02468ace")


def newest_runs(runs: DataFrame, store: str, created: str, keep: int = 32) -> DataFrame:
    """The ``keep`` newest rows of each store."""
    w = Window.partitionBy(store).orderBy(F.col(created).desc(), F.col("run_id").desc())
    return runs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def hunk_lines(lines: DataFrame, by: str, mention, before: int = 2, after: int = 3) -> DataFrame:
    """Lines from ``before`` lines above to ``after`` lines below a mention."""
    w = Window.partitionBy(by).orderBy("line").rowsBetween(-after, before)
    return lines.withColumn("_near", F.max(mention.cast("int")).over(w)).filter("_near = 1").drop("_near")


def rewrite_kind(subject):
    """First kind of history rewrite that a commit subject names."""
    return (
        F.when(subject.rlike(r"(?i)\brevert"), "revert")
        .when(subject.rlike(r"(?i)\b(downgrade|roll ?back|pin back)\b"), "downgrade")
        .when(subject.rlike(r"(?i)\b(regenerate|re-?lock|refresh|rebuild)\b"), "regenerate")
        .when(subject.rlike(r"(?i)\b(merge)\b"), "merge")
        .otherwise("other")
    )


def pull_request(message):
    """(#n) at the end of the first line, or of a merge commit; NULL without one."""
    line = F.trim(F.substring_index(message, "\n", 1))
    return F.coalesce(F.nullif(F.regexp_extract(line, r"\(#(\d+)\)$", 1), F.lit("")), F.nullif(F.regexp_extract(message, r"^Merge pull request #(\d+)", 1), F.lit(""))).cast("long")


def bump_labels(subjects: DataFrame, key: str, text: str = "message") -> DataFrame:
    """(key, name, old_version, new_version): bumps that a message states, one row each."""
    pattern = r"(?i)(?:bump|update|upgrade)s?\s+`?([A-Za-z0-9@/._-]+)`?\s+(?:requirement\s+)?from\s+`?v?=*([0-9][^\s`]*)`?\s+to\s+`?v?=*([0-9][^\s`,]*)`?"
    each = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "old"), (3, "new"))])
    rows = subjects.select(key, F.explode(each).alias("b"))
    return rows.select(key, F.lower("b.name").alias("name"), F.col("b.old").alias("old_version"), F.regexp_replace("b.new", r"[.,;)]+$", "").alias("new_version")).distinct()


def strata(labels: DataFrame, added: DataFrame, again: DataFrame, per_name: DataFrame) -> DataFrame:
    """Stratum of each bump label: revert, re_bump, grouped, multi_version or single_package.

    ``labels`` (repo, pos, name, version, subject); the other tables say what was
    added again and how many versions of a name a commit holds.
    """
    w = Window.partitionBy("repo", "pos")
    rows = labels.withColumn("n_labels", F.count("*").over(w))
    rows = rows.join(again.select("repo", "pos", "name", "version", F.lit(True).alias("again")).distinct(), ["repo", "pos", "name", "version"], "left")
    rows = rows.join(per_name.select("repo", "pos", "name", "n_versions"), ["repo", "pos", "name"], "left")
    kind = (
        F.when(rewrite_kind(F.col("subject")) == "revert", "revert")
        .when(F.coalesce("again", F.lit(False)), "re_bump")
        .when(F.col("n_labels") > 1, "grouped")
        .when(F.coalesce("n_versions", F.lit(0)) > 1, "multi_version")
        .otherwise("single_package")
    )
    return rows.select("repo", "pos", "name", "version", kind.alias("stratum"))


def resolve_labels(labels: DataFrame, pins: DataFrame) -> DataFrame:
    """Each label (label_id, repo, pos, name, version) to the pin it means, or why it can't be used (WIN-06).

    A name matches as such, else as the end of a path; versions match exactly or as a beginning.
    """
    held = pins.select("repo", "pos", F.col("name").alias("pin"), F.col("version").alias("pin_version")).distinct()
    near = labels.join(held, ["repo", "pos"]).filter((F.col("pin") == F.col("name")) | F.endswith(F.col("pin"), F.concat(F.lit("/"), F.col("name"))))
    exact = F.col("pin") == F.col("name")
    best = near.withColumn("exact", F.max(exact.cast("int")).over(Window.partitionBy("label_id"))).filter(exact | (F.col("exact") == 0))
    names = best.groupBy("label_id").agg(F.countDistinct("pin").alias("names"), F.max(F.when((F.col("pin_version") == F.col("version")) | F.startswith(F.col("pin_version"), F.concat(F.col("version"), F.lit("."))), F.struct("pin", "pin_version"))).alias("pin"))
    rows = labels.join(names, "label_id", "left")
    parent = held.select("repo", (F.col("pos") + 1).alias("pos"), F.col("pin").alias("_p"), F.col("pin_version").alias("_v"), F.lit(True).alias("had"))
    rows = rows.join(parent, (rows["repo"] == parent["repo"]) & (rows["pos"] == parent["pos"]) & (rows["pin.pin"] == parent["_p"]) & (rows["pin.pin_version"] == parent["_v"]), "left").drop(parent["repo"], parent["pos"])
    why = F.when(F.col("names") > 1, "ambiguous_name").when(F.col("pin").isNull(), "not_in_lock").when(F.coalesce("had", F.lit(False)), "already_present")
    return rows.select("label_id", F.col("pin.pin").alias("name"), F.col("pin.pin_version").alias("version"), why.alias("excluded"))
