import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from strataflow.functions import ed25519, identity, names, severity, signing, versions
from strataflow.functions.ed25519 import ORDER, PrivateKey, PublicKey
from strataflow.operators import reach


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_canonical_purls(spark):
    rows = [("pkg:deb/debian/libssl3@3.0.11-1~deb12u2?arch=amd64",), ("pkg:PyPI/Django_Filter@1.0",), ("pkg:npm/%40types/Node@18.0.0#x",), ("pkg:pypi/plain",), ("no purl",), (None,)]
    want = ["pkg:deb/debian/libssl3@3.0.11-1~deb12u2", "pkg:pypi/django-filter@1.0", "pkg:npm/@types/node@18.0.0", "pkg:pypi/plain", None, None]
    assert column(spark, rows, "p string", identity.canonical_purl(F.col("p"))) == want


def test_digest_is_sha256_of_canonical_json(spark):
    for text in ("abc", 'a"b\\c', "naïve", "", "tab\there\x7f", "😀x"):
        want = "commit:sha256:" + hashlib.sha256(json.dumps(text).encode()).hexdigest()[:32]
        assert column(spark, [(text,)], "c string", identity.digest("commit", identity.json_string("c"))) == [want]


def test_semver_order(spark):
    ordered = ["1.0.0-alpha", "1.0.0-beta.2", "1.0.0-beta.11", "v1.0.0", "1.9.9", "v1.10.0+build", "2"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ordered)][::-1], "i int, v string")
    assert [r.v for r in df.orderBy(versions.semver_key(F.col("v"))).collect()] == ordered


def test_pep440_order():
    ordered = ["1.0.dev1", "1.0a1.dev1", "1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0", "1.0+abc", "1.0+5", "1.0.post1.dev2", "1.0.post1", "1.0.1", "1.2", "1.10", "1!0.1"]
    keys = [versions.pep440_text(v) for v in ordered]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert versions.pep440_text("1.0") == versions.pep440_text("v1.0.0") and versions.pep440_text("not a version") is None


def test_ranges_decide_in_order(spark):
    span = "struct<low_any:boolean,low:int,fixed:int,last:int,bad:boolean>"
    rows = [(5, [(False, 1, 6, None, False)]), (6, [(False, 1, 6, None, False)]), (6, [(True, None, None, 6, False)]), (5, [(False, None, None, None, True), (True, None, None, None, False)]), (5, [(True, None, None, None, False), (False, None, None, None, True)]), (5, []), (None, [(True, None, None, None, False)])]
    assert column(spark, rows, f"k int, r array<{span}>", versions.in_ranges(F.col("k"), F.col("r"))) == [True, False, True, False, True, False, False]


def test_event_fold(spark):
    event = "array<struct<introduced:string,fixed:string,last_affected:string>>"
    rows = [([("0", None, None), (None, "1.2", None), ("2.0", None, None), (None, None, "2.5"), ("3.0", None, None)],)]
    got = column(spark, rows, f"e {event}", versions.fold_events(F.col("e")))[0]
    assert [tuple(x) for x in got] == [("0", "1.2", None), ("2.0", None, "2.5"), ("3.0", None, None)]


@pytest.mark.parametrize(("vector", "score"), [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.0/AV:L/AC:H/PR:L/UI:N/S:U/C:N/I:N/A:N", 0.0), ("garbage", None)])
def test_cvss(spark, vector, score):
    assert column(spark, [(vector,)], "v string", severity.cvss3_base(F.col("v"))) == [score]


def test_severity_order(spark):
    assert column(spark, [("LOW",), ("critical",), ("odd",), (None,)], "s string", severity.severity_rank(F.col("s"))) == [0, 3, 1, 1]
    flags = [(3, None), (3, False), (1, True), (2, True)]
    assert column(spark, flags, "r int, x boolean", severity.actionable(F.col("r"), F.col("x"))) == [True, False, False, True]


def test_distances(spark):
    pairs = [("abcd", "abdc", 1), ("abc", "xyz", 3), ("same", "same", 0), ("ca", "abc", 3), ("requests", "request", 1)]
    assert [names.osa(a, b) for a, b, _ in pairs] == [d for *_, d in pairs]
    got = column(spark, [p[:2] for p in pairs], "a string, b string", names.osa_at_most_one(F.col("a"), F.col("b")))
    assert got == [d <= 1 for *_, d in pairs]
    assert column(spark, [p[:2] for p in pairs], "a string, b string", names.osa_distance("a", "b")) == [d for *_, d in pairs]


def test_deletions_and_edit_kind(spark):
    assert set(column(spark, [("abca",)], "s string", names.deletions(F.col("s")))[0]) == {"abca", "bca", "aca", "aba", "abc"}
    rows = [("abdc", "abcd"), ("requesta", "requests"), ("requestz", "request"), ("reqests", "requests"), ("reqpests", "requests")]
    assert column(spark, rows, "a string, b string", names.edit_kind(F.col("a"), F.col("b"))) == ["transposition", "adjacent-key", "insertion", "omission", "substitution"]


def test_hmac(spark):
    for key in (b"k", b"x" * 80):
        payload = '{"é":1}'
        message = f"DSSEv1 {len(signing.PAYLOAD_TYPE)} {signing.PAYLOAD_TYPE} {len(payload)} {payload}"
        want = hmac.new(key, message.encode(), hashlib.sha256).hexdigest()
        assert column(spark, [(payload,)], "p string", signing.sign(key, F.lit(signing.PAYLOAD_TYPE), F.col("p"))) == [want]


#: Seeds, public keys, messages and signatures of RFC 8032, section 7.1.
VECTORS = (
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
)


@pytest.mark.parametrize(("seed", "public", "message", "sig"), VECTORS)
def test_ed25519_vectors(seed, public, message, sig):
    key, message, sig = PrivateKey(bytes.fromhex(seed)), bytes.fromhex(message), bytes.fromhex(sig)
    assert key.public().raw.hex() == public and key.sign(message) == sig
    assert key.public().verify(message, sig)
    late = sig[:32] + (int.from_bytes(sig[32:], "little") + ORDER).to_bytes(32, "little")
    for bad in (sig[:-1], b"", sig[::-1], bytes(64), late):
        assert not key.public().verify(message, bad)
    assert not key.public().verify(message + b"x", sig)
    assert not PublicKey(b"\xff" * 32).verify(message, sig) and not PublicKey(b"").verify(message, sig)


def test_ed25519_uses_tables():
    """A key in use costs no doublings; results are the same before and after it has a table."""
    key = PrivateKey(bytes(range(32)))
    public, signed = key.public(), [(b"%d" % i, key.sign(b"%d" % i)) for i in range(2 * ed25519.KEY_USES)]
    assert all(public.verify(m, s) and not public.verify(m + b"x", s) for m, s in signed)
    adds, times = [], ed25519._add
    try:
        ed25519._add = lambda a, b: adds.append(1) or times(a, b)
        assert public.verify(*signed[0]) and key.sign(signed[0][0]) == signed[0][1]
    finally:
        ed25519._add = times
    assert not adds


def test_ed25519_points_of_small_order():
    """Keys and commitments without a base point, as the equation says; other encodings of the same points are refused."""
    one, minus = (1).to_bytes(32, "little"), (ed25519.P - 1).to_bytes(32, "little")
    zero = bytes(32)
    assert PublicKey(one).verify(b"any", one + zero) and not PublicKey(one).verify(b"any", minus + zero)
    assert not PublicKey(one).verify(b"any", (ed25519.P + 1).to_bytes(32, "little") + zero)
    assert {PublicKey(minus).verify(b"%d" % i, one + zero) for i in range(16)} == {True, False}


def test_ed25519_pem():
    key = PrivateKey.generate()
    assert PrivateKey.from_pem(key.pem()) == key and PublicKey.from_pem(key.public().pem()) == key.public()
    for wrong in (b"", b"-----BEGIN PUBLIC KEY-----\nAAAA\n-----END PUBLIC KEY-----", key.pem()):
        with pytest.raises(ValueError):
            PublicKey.from_pem(wrong)


def test_python_mentions():
    text = 'import a.b as c\nfrom d import e, f\nfrom g import *\nfrom . import no\nx = ["Bcrypt", "h.i", "no way", "ab", b"xyz"]\nm.include("my-urls")\n__import__(name)\nimport_module()\n'
    names = {k: {n for kind, n in reach.mentions_of(text) if kind == k} for k in ("module", "word")}
    assert names == {"module": {"a", "a.b", "d", "d.e", "d.f", "g", "h", "h.i", "my-urls"}, "word": {"bcrypt"}}
    assert reach.mentions_of(None) == reach.mentions_of("") == reach.mentions_of("def x(") == reach.mentions_of("a\0b") == []


def test_referenced_by_word(spark):
    files = spark.createDataFrame([("a.py", 'S = "Bcrypt"'), ("b.py", None)], "path string, text string")
    names = spark.createDataFrame([("bcrypt", "bcrypt"), ("attrs", "attr"), ("g", "google.bcrypt")], "dist string, import_name string")
    assert [r.dist for r in reach.referenced(reach.mentions(files), names).collect()] == ["bcrypt"]
