"""Identity expressions: canonical JSON, digests, package names and purls (EXP-01 to EXP-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

_LOWER_ONLY = ("npm", "deb", "apk", "gem", "cargo", "nuget", "rpm")


def let(value, body):
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def _escaped(ch):
    """One character outside printable ASCII as JSON escapes it, by UTF-16 units."""
    code = F.ascii(ch)
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    low = code - 0x10000
    out = F.when(code > 0xFFFF, F.concat(unit(F.shiftright(low, 10) + 0xD800), unit(low.bitwiseAND(F.lit(0x3FF)) + 0xDC00))).otherwise(unit(code))
    for n, letter in _SHORT.items():
        out = F.when(code == n, F.lit("\\" + letter)).otherwise(out)
    return F.when((code >= 32) & (code <= 126), ch).otherwise(out)


def json_string(c):
    """A string as canonical JSON with ASCII escapes."""
    def quoted(x):
        safe = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        other = F.array_join(F.transform(F.regexp_extract_all(safe, F.lit("(?s)."), F.lit(0)), _escaped), "")
        return F.concat(F.lit('"'), F.when(x.rlike(r"^[ -~]*$"), safe).otherwise(other), F.lit('"'))

    return let(F.col(c) if isinstance(c, str) else c, quoted)


def canonical_list(*columns):
    """Canonical JSON of an array of strings."""
    return F.concat(F.lit("["), F.concat_ws(",", *[json_string(c) for c in columns]), F.lit("]"))


def digest(kind: str, canonical):
    """kind:sha256: and the first half of the hash of the canonical identity."""
    return F.concat(F.lit(f"{kind}:sha256:"), F.left(F.sha2(canonical, 256), F.lit(32)))


def ascii_digest(kind: str, c):
    """Digest of one string known to be plain ASCII without quotes or backslashes; stays in generated code."""
    return digest(kind, F.concat(F.lit('"'), c, F.lit('"')))


def normalize_name(name, ecosystem):
    """A package name as its ecosystem compares names."""
    n, eco = F.trim(name), F.lower(ecosystem)
    return (
        F.when(eco == "pypi", F.regexp_replace(F.lower(n), "[-_.]+", "-"))
        .when(eco.isin(*_LOWER_ONLY), F.lower(n))
        .otherwise(n)
    )


def _quoted(c, safe: str = ""):
    """Percent-encoding as in RFC 3986."""
    q = F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    for s, code in (("@", "%40"), ("/", "%2F")):
        if s in safe:
            q = F.replace(q, F.lit(code), F.lit(s))
    return q


def _unquoted(c):
    # a plus sign is no space here
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def purl(name, version, ecosystem, namespace=None):
    eco = F.lower(ecosystem)
    ns = F.lit("") if namespace is None else F.coalesce(F.when(namespace != "", F.concat(F.lower(namespace), F.lit("/"))), F.lit(""))
    return F.concat(F.lit("pkg:"), eco, F.lit("/"), ns, _quoted(normalize_name(name, eco), "@/"), F.lit("@"), version)


def canonical_purl(p):
    """Without qualifiers and subpath, type and namespace in lower case, name normalised; NULL if not a purl."""
    def split(x):
        bare = F.substring_index(F.substring_index(x, "#", 1), "?", 1)
        return F.struct(F.lower(F.regexp_extract(bare, "^pkg:([^/]*)", 1)).alias("kind"), F.regexp_extract(bare, "^pkg:[^/]*/(.*)$", 1).alias("path"), x.startswith("pkg:").alias("fine"))

    def versioned(x):
        has = F.instr(x["path"], "@") > 0
        version = F.when(has, F.substring_index(x["path"], "@", -1)).otherwise(F.lit(""))
        names = F.when(has, F.regexp_extract(x["path"], "^(.*)@[^@]*$", 1)).otherwise(x["path"])
        return F.struct(x["kind"].alias("kind"), F.transform(F.split(names, "/"), _unquoted).alias("parts"), version.alias("version"), x["fine"].alias("fine"))

    def build(x):
        name = _quoted(normalize_name(F.element_at(x["parts"], -1), x["kind"]))
        spaces = F.transform(F.slice(x["parts"], F.lit(1), F.size(x["parts"]) - 1), F.lower)
        version = F.when(x["version"] != "", F.concat(F.lit("@"), _unquoted(x["version"]))).otherwise(F.lit(""))
        return F.when(x["fine"], F.concat(F.lit("pkg:"), x["kind"], F.lit("/"), F.concat_ws("/", spaces, name), version))

    return let(let(let(p, split), versioned), build)


def dependency_id(p):
    return digest("dependency", json_string(canonical_purl(p)))
