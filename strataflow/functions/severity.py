"""Severity and verdict order, CVSS scores, advisory names (EXP-07 to EXP-09, EXP-14, EXP-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions.identity import let

# Severities and verdicts in rising order, advisory labels, CVSS v3 weights.
SEVERITIES = ("low", "medium", "high", "critical")
VERDICTS = ("pass", "warn", "block")
LABELS = {"LOW": "LOW", "MODERATE": "MEDIUM", "MEDIUM": "MEDIUM", "HIGH": "HIGH", "CRITICAL": "CRITICAL"}
WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "CIA": {"H": 0.56, "L": 0.22, "N": 0.0},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_CHANGED": {"N": 0.85, "L": 0.68, "H": 0.5},
}


def severity(s):
    """Lower-case severity; unknown ones are medium."""
    low = F.lower(s)
    return F.when(low.isin(*SEVERITIES), low).otherwise(F.lit("medium"))


def severity_rank(s):
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(s)), F.lit(0)) - 1, F.lit(1)).cast("int")


def verdict_rank(v):
    return (F.array_position(F.array(*map(F.lit, VERDICTS)), v) - 1).cast("int")


def verdict_of_rank(rank):
    return F.element_at(F.array(*map(F.lit, VERDICTS)), (rank + 1).cast("int"))


def score_severity(score):
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def cvss3_base(vector):
    """Base score of a CVSS v3 vector; NULL if it can't be read."""
    table = {k: F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) for k, t in WEIGHTS.items()}
    parsed = F.str_to_map(F.substring(vector, F.instr(vector, "/") + 1, F.length(vector)), F.lit("/"), F.lit(":"))

    def weights(m):
        of = lambda metric, t: F.try_element_at(table[t], F.try_element_at(m, F.lit(metric)))
        changed = F.try_element_at(m, F.lit("S")) == "C"
        return F.struct(
            F.try_element_at(m, F.lit("S")).alias("scope"),
            (1 - (1 - of("C", "CIA")) * (1 - of("I", "CIA")) * (1 - of("A", "CIA"))).alias("iss"),
            (8.22 * of("AV", "AV") * of("AC", "AC") * F.when(changed, of("PR", "PR_CHANGED")).otherwise(of("PR", "PR")) * of("UI", "UI")).alias("ease"),
        )

    def impact(w):
        i = F.when(w["scope"] == "C", 7.52 * (w["iss"] - 0.029) - 3.25 * F.pow(w["iss"] - 0.02, F.lit(15))).otherwise(6.42 * w["iss"])
        return F.struct(w["scope"].alias("scope"), i.alias("impact"), w["ease"].alias("ease"))

    def whole(x):
        total = x["impact"] + x["ease"]
        raw = F.least(F.when(x["scope"] == "C", 1.08 * total).otherwise(total), F.lit(10.0))
        return F.struct(x["scope"].isin("U", "C").alias("known"), x["impact"].alias("impact"), F.bround(raw * 100000).cast("long").alias("n"))

    def up(x):
        n = x["n"]
        score = F.when(n % 10000 == 0, n / 100000.0).otherwise((F.floor(n / 10000) + 1) / 10.0)
        return F.when(x["known"] & n.isNotNull(), F.when(x["impact"] <= 0, F.lit(0.0)).otherwise(score))

    return let(let(let(let(parsed, weights), impact), whole), up)


def own_severity(label, severities):
    """The database's label, else the band of the first CVSS v3 score; upper case or NULL."""
    named = F.lit(None).cast("string")
    for k, v in LABELS.items():
        named = F.when(F.upper(label) == k, F.lit(v)).otherwise(named)
    scores = F.filter(F.transform(F.filter(severities, lambda s: s["type"].startswith("CVSS_V3")), lambda s: cvss3_base(s["score"])), lambda x: x.isNotNull())
    first = let(scores, lambda found: F.when(F.size(found) > 0, F.upper(score_severity(F.get(found, F.lit(0))))))
    return F.coalesce(named, first)


def advisory_cve(osv_id, aliases):
    """The first CVE among the aliases, else the id."""
    return F.coalesce(F.get(F.filter(aliases, lambda x: x.startswith("CVE-")), F.lit(0)), osv_id)


def mentions_typosquat(text):
    return text.rlike(r"(?i)typo-?squat|impersonat|masquerad|combosquat")


def actionable(rank, reachable, least: int = 2):
    """High or critical, and not known to be unreachable (unknown counts)."""
    return (rank >= least) & ~reachable.eqNullSafe(F.lit(False))
