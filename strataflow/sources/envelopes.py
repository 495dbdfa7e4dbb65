"""Signed envelopes: reading, verifying, writing (SRC-01, SRC-02, SIG-01 to SIG-06, SNK-01)."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.ed25519 import PrivateKey, PublicKey
from strataflow.functions.signing import PAYLOAD_TYPE, ed25519_sign, ed25519_valid, hmac_sha256, pads, pae, sign

_FIELDS = ("payload_type", "payload", "keyid", "sig")


class NoTrustRoot(Exception):
    """No trusted key is configured."""


def load_envelopes(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """env_idx, payload_type, payload, keyid, sig, parse_error of a JSON array of envelopes.

    Both layouts are read: the plain one and DSSE (base64 payload, first
    signature).  A bad entry gets a parse_error; unless ``lenient`` it fails.
    """
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    doc.createOrReplaceTempView("_strataflow_envelopes")
    rows = spark.sql("SELECT pos AS env_idx, value AS v FROM _strataflow_envelopes, LATERAL variant_explode(doc)")
    shape = F.schema_of_variant("v")
    text = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    is_text = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant")) == "STRING", F.lit(False))
    dsse = F.try_variant_get("v", "$.payloadType", "variant").isNotNull()
    decoded = F.decode(F.try_to_binary(text("payload"), F.lit("base64")), "UTF-8")
    hex_sig = F.lower(F.hex(F.try_to_binary(text("signatures[0].sig"), F.lit("base64"))))
    columns = {
        "payload_type": F.when(dsse, text("payloadType")).otherwise(text("payload_type")),
        "payload": F.when(dsse, decoded).otherwise(text("payload")),
        "keyid": F.when(dsse, text("signatures[0].keyid")).otherwise(text("keyid")),
        "sig": F.when(dsse, hex_sig).otherwise(text("sig")),
    }
    error = F.when(~shape.startswith("OBJECT"), F.concat(F.lit("expected an object, got "), shape))
    for f in _FIELDS:
        error = F.coalesce(error, F.when(~dsse & ~is_text(f), F.lit(f"{f} is not a string")))
    out = rows.withColumns(columns)
    error = F.coalesce(error, F.when(F.col("payload").isNull() | F.col("sig").isNull(), "payload or signature is not base64"), F.when((F.col("sig") != "") & ~F.col("sig").rlike("^[0-9a-f]+$"), "sig is not lowercase hex"))
    out = out.select(F.col("env_idx").cast("long"), *_FIELDS, error.alias("parse_error"))
    if not lenient:
        out = out.withColumn("parse_error", F.when(F.col("parse_error").isNotNull(), F.raise_error(F.concat(F.lit("malformed envelope: "), "parse_error"))))
    return out


def verify(envelopes: DataFrame, trusted: dict[str, bytes | PublicKey]) -> DataFrame:
    """Adds stage, run_id, payload of the event, and reject_reason (NULL if accepted).

    Bytes are HMAC keys.  Python workers run only if an Ed25519 key is trusted.  Checks go in a fixed order, and the first that fails gives the reason.
    """
    if not trusted:
        raise NoTrustRoot("no trusted key")
    spark = envelopes.sparkSession
    public = {k: bytearray(v.raw) for k, v in trusted.items() if isinstance(v, PublicKey)}
    shared = {k: tuple(map(bytearray, pads(v))) for k, v in trusted.items() if k not in public}
    keys = spark.createDataFrame([(k, *shared.get(k, (None, None)), public.get(k)) for k in trusted], "keyid string, _inner binary, _outer binary, _public binary")
    rows = envelopes.join(F.broadcast(keys), "keyid", "left")  # as many rows as there are keys in the configuration
    message = pae(F.col("payload_type"), F.col("payload"))
    differs = hmac_sha256(F.col("_inner"), F.col("_outer"), message) != F.col("sig")
    if public:
        differs = F.coalesce(~ed25519_valid("_public", message, "sig"), differs)
    shape = F.schema_of_variant(F.try_parse_json("payload"))
    e = F.from_json("payload", "stage string, run_id string, payload string")
    keys_of = F.array_sort(F.json_object_keys("payload"))
    reason = (
        F.when(F.col("parse_error").isNotNull(), F.concat(F.lit("malformed envelope: "), "parse_error"))
        .when(F.col("payload_type") != PAYLOAD_TYPE, F.concat(F.lit("unexpected payload type "), "payload_type"))
        .when(F.col("_inner").isNull() & F.col("_public").isNull(), F.concat(F.lit("untrusted keyid "), "keyid"))
        .when(F.col("sig") == "", "missing signature")
        .when(differs, "signature mismatch")
        .when(shape.isNull() | ~shape.startswith("OBJECT"), "malformed payload")
        .when(~F.coalesce(keys_of == F.array(F.lit("payload"), F.lit("run_id"), F.lit("stage")), F.lit(False)), "malformed payload: unexpected fields")
    )
    return rows.select("env_idx", e["stage"].alias("stage"), e["run_id"].alias("run_id"), e["payload"].alias("payload"), reason.alias("reject_reason"))


def canonical_event(stage: str, run_id: str, payload: dict) -> str:
    return json.dumps({"stage": stage, "run_id": run_id, "payload": payload}, sort_keys=True, separators=(",", ":"))


def signed_events(spark: SparkSession, events: list[tuple[str, str, dict]], keyid: str, key: bytes | PrivateKey) -> DataFrame:
    """Envelopes of (stage, run_id, payload) events, signed by expressions (HMAC) or in Arrow batches (Ed25519)."""
    rows = [(i, canonical_event(*e)) for i, e in enumerate(events)]
    df = spark.createDataFrame(rows, "env_idx long, payload string")
    sig = ed25519_sign if isinstance(key, PrivateKey) else sign
    return df.select("env_idx", F.lit(PAYLOAD_TYPE).alias("payload_type"), "payload", F.lit(keyid).alias("keyid"), sig(key, F.lit(PAYLOAD_TYPE), F.col("payload")).alias("sig"), F.lit(None).cast("string").alias("parse_error"))


def concat_envelopes(*frames: DataFrame) -> DataFrame:
    """All envelopes after each other, renumbered (SET-01); duplicates stay."""
    out, base = None, 0
    for f in frames:
        part = f.withColumn("env_idx", F.col("env_idx") + base)
        base += f.agg(F.coalesce(F.max("env_idx") + 1, F.lit(0))).first()[0]
        out = part if out is None else out.unionByName(part)
    return out


def to_dsse(envelopes: DataFrame) -> DataFrame:
    """One column ``value``: DSSE JSON of each envelope."""
    sig = F.struct("keyid", F.base64(F.unhex("sig")).alias("sig"))
    return envelopes.select(F.to_json(F.struct(F.base64(F.encode("payload", "UTF-8")).alias("payload"), F.col("payload_type").alias("payloadType"), F.array(sig).alias("signatures"))).alias("value"))


def intoto_statements(builds: DataFrame) -> DataFrame:
    """In-toto provenance of build events (build_id, image name and digest, commit, deps array of purl)."""
    subject = F.array(F.struct(F.col("image_name").alias("name"), F.struct(F.regexp_replace("image_digest", "^sha256:", "").alias("sha256")).alias("digest")))
    git = F.struct(F.concat(F.lit("git+commit:"), "commit").alias("uri"))
    deps = F.concat(F.array(git), F.transform("deps", lambda d: F.struct(d.alias("uri"))))
    body = F.struct(F.lit("https://in-toto.io/Statement/v1").alias("_type"), subject.alias("subject"), F.lit("https://slsa.dev/provenance/v1").alias("predicateType"), F.struct(F.struct(F.col("build_id").alias("buildId"), deps.alias("resolvedDependencies")).alias("buildDefinition")).alias("predicate"))
    return builds.select("build_id", F.to_json(body).alias("statement"))


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    """A JSON array, one envelope a line, in index order."""
    line = F.to_json(F.struct(*_FIELDS))
    rows = envelopes.select("env_idx", line.alias("j"))
    rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("env_idx", "j"))), lambda x: x["j"]), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def trust_from_environment(names: dict[str, str]) -> dict[str, bytes | PublicKey]:
    """Keys from environment variables {keyid: variable}, PEM ones as Ed25519; fails if none is set."""
    key = lambda text: PublicKey.from_pem(text) if text.startswith(b"-----BEGIN") else text
    found = {k: key(os.environ[v].encode()) for k, v in names.items() if os.environ.get(v)}
    if not found:
        raise NoTrustRoot(f"none of {', '.join(names.values())} is set")
    return found
