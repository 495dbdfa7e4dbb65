"""Pre-authentication encoding and HMAC-SHA256 from built-in functions (SIG-01, SIG-02); Ed25519 in Arrow batches (SIG-03)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from strataflow.functions.ed25519 import PrivateKey, PublicKey

PAYLOAD_TYPE = "application/vnd.strataflow.stage+json"


def pae(payload_type, payload):
    """DSSE v1 encoding with lengths in characters."""
    return F.concat(F.lit("DSSEv1 "), F.length(payload_type).cast("string"), F.lit(" "), payload_type, F.lit(" "), F.length(payload).cast("string"), F.lit(" "), payload)


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of a key."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(inner, outer, message):
    """Lower-case hex; ``inner`` and ``outer`` are binary pad columns, ``message`` a string."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def sign(key: bytes, payload_type, payload):
    inner, outer = pads(key)
    return hmac_sha256(F.lit(inner), F.lit(outer), pae(payload_type, payload))


@F.pandas_udf(BooleanType())
def ed25519_valid(key: pd.Series, message: pd.Series, sig: pd.Series) -> pd.Series:
    """Whether a hex signature is the key's; NULL without a key, False without a message or a whole signature."""
    def valid(k, m, s):
        if k is None:
            return None
        try:
            return m is not None and s is not None and PublicKey(bytes(k)).verify(m.encode(), bytes.fromhex(s))
        except ValueError:
            return False

    return pd.Series([valid(*row) for row in zip(key, message, sig)], dtype="object")


def ed25519_sign(key: PrivateKey, payload_type, payload):
    """Lower-case hex of the signature of the encoded payload; NULL of a NULL payload."""
    @F.pandas_udf("string")
    def signed(message: pd.Series) -> pd.Series:
        return message.map(lambda m: None if m is None else key.sign(m.encode()).hex())

    return signed(pae(payload_type, payload))
