"""Version order keys and range predicates (EXP-10 to EXP-13)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "struct<kind:int,num:decimal(38,0),str:string>"


def semver_key(v):
    """A struct that orders SemVer strings: three numbers, release after pre-release, identifiers."""
    bare = F.regexp_replace(F.substring_index(v, "+", 1), "^v+", "")
    core = F.split(F.substring_index(bare, "-", 1), r"\.")
    number = lambda i: F.when(F.get(core, F.lit(i)).rlike("^[0-9]+$"), F.get(core, F.lit(i)).try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))
    pre = F.when(F.instr(bare, "-") > 0, F.substring(bare, F.instr(bare, "-") + 1, F.length(bare))).otherwise(F.lit(""))

    def identifier(x):
        digits = x.rlike("^[0-9]+$")
        return F.struct(F.when(digits, 0).otherwise(1).alias("kind"), F.when(digits, x.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("num"), F.when(digits, F.lit("")).otherwise(x).alias("str"))

    parts = F.when(pre == "", F.array().cast(f"array<{PART}>")).otherwise(F.transform(F.split(pre, "[.-]"), identifier))
    return F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"), F.when(pre == "", 1).otherwise(0).alias("release"), parts.alias("pre"))


_PEP440 = re.compile(
    r"^\s*v?(?:(?P<epoch>\d+)!)?(?P<release>\d+(?:\.\d+)*)(?:[-_.]?(?P<pre>alpha|beta|preview|pre|rc|a|b|c)[-_.]?(?P<pren>\d*))?"
    r"(?:-(?P<post1>\d+)|[-_.]?(?P<post>post|rev|r)[-_.]?(?P<postn>\d*))?(?:[-_.]?(?P<dev>dev)[-_.]?(?P<devn>\d*))?"
    r"(?:\+(?P<local>[a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$", re.I)  # fmt: skip
_PRE = {"alpha": "a", "a": "a", "beta": "b", "b": "b", "c": "rc", "rc": "rc", "pre": "rc", "preview": "rc"}


def pep440_text(version: str | None) -> str | None:
    """A string whose plain order is the PEP 440 order; None if the version isn't one."""
    m = _PEP440.match(version) if version is not None else None
    if not m:
        return None
    number = lambda s: f"{len(str(int(s or 0))):03d}{int(s or 0)}"  # noqa: E731  longer numbers are larger
    release = [int(x) for x in m["release"].split(".")]
    while len(release) > 1 and release[-1] == 0:
        release.pop()
    is_post, is_dev = bool(m["post"] or m["post1"]), bool(m["dev"])
    if m["pre"]:
        pre = f"1{_PRE[m['pre'].lower()]:<2}{number(m['pren'])}"
    else:
        pre = "0" if is_dev and not is_post else "2"
    post = f"1{number(m['post1'] or m['postn'])}" if is_post else "0"
    dev = f"0{number(m['devn'])}" if is_dev else "1"
    local = "0" if not m["local"] else "1" + "".join(f"2{number(x)}" if x.isdigit() else f"1{x.lower()}\x01" for x in re.split("[-_.]", m["local"])) + "\x00"
    return "|".join((number(m["epoch"]), "".join("1" + number(x) for x in release) + "0", pre, post, dev, local))


@F.pandas_udf(T.StringType())
def pep440_key(versions: pd.Series) -> pd.Series:
    return versions.map(pep440_text)


def in_ranges(key, ranges, unbounded_low="low_any"):
    """Whether ``key`` lies in a range of the array.

    Ranges are structs (low_any boolean, low, fixed, last) of order keys, where
    a missing bound is NULL; ``bad`` is set if a bound isn't a version.  They are
    tried in order: one that matches decides, and a bad bound reached first ends
    the search without a match.
    """
    def step(state, r):
        inside = (r[unbounded_low] | (key >= r["low"])) & (r["fixed"].isNull() | (key < r["fixed"])) & (r["last"].isNull() | (key <= r["last"]))
        return F.when(state != 0, state).when(r["bad"], F.lit(-1)).when(F.coalesce(inside, F.lit(False)), F.lit(1)).otherwise(state)

    return F.when(key.isNull() | ranges.isNull(), F.lit(False)).otherwise(F.aggregate(ranges, F.lit(0), step) == 1)


def fold_events(events):
    """OSV range events (introduced, fixed, last_affected) to (introduced, fixed, last) triples."""
    triple = "struct<introduced:string,fixed:string,last:string>"
    state = f"struct<low:string,open:boolean,out:array<{triple}>>"

    def emit(acc, fixed, last):
        made = F.struct(acc["low"].alias("introduced"), fixed.cast("string").alias("fixed"), last.cast("string").alias("last"))
        return F.struct(F.lit(None).cast("string").alias("low"), F.lit(False).alias("open"), F.concat(acc["out"], F.array(made)).alias("out")).cast(state)

    def step(acc, e):
        begun = F.struct(e["introduced"].alias("low"), F.lit(True).alias("open"), acc["out"].alias("out")).cast(state)
        return (
            F.when(e["introduced"].isNotNull(), begun)
            .when(e["fixed"].isNotNull(), emit(acc, e["fixed"], F.lit(None)))
            .when(e["last_affected"].isNotNull(), emit(acc, F.lit(None), e["last_affected"]))
            .otherwise(acc)
        )

    zero = F.struct(F.lit(None).cast("string").alias("low"), F.lit(False).alias("open"), F.array().cast(f"array<{triple}>").alias("out")).cast(state)
    return F.aggregate(events, zero, step, lambda acc: F.when(acc["open"], emit(acc, F.lit(None), F.lit(None))["out"]).otherwise(acc["out"]))


def malicious_affects(version, versions, ranges, in_any):
    """Fails closed: without data, listed, in an unbounded range, or not comparable means affected."""
    nothing = (F.coalesce(F.size(versions), F.lit(0)) <= 0) & (F.coalesce(F.size(ranges), F.lit(0)) <= 0)
    free = F.coalesce(F.exists(ranges, lambda r: (r["introduced"].isNull() | (r["introduced"] == "0")) & r["fixed"].isNull() & r["last"].isNull()), F.lit(False))
    return nothing | F.coalesce(F.array_contains(versions, version), F.lit(False)) | free | F.coalesce(in_any, F.lit(True))
