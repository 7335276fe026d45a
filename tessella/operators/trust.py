"""Canonical JSON, payload hashes and signed envelopes, on columns of JSON texts."""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions import ed25519

#: Fixed values of the envelope format.
VERSION = 1
PAYLOAD_TYPES = ("portable_artifact", "render_trace", "rcg_divergence_census", "verification_trace")
HEADER = ("attestation_version", "payload_type", "payload_hash", "signed_at", "signed_by", "key_id", "public_key")


def canonical_bytes(value) -> bytes:
    """Sorted keys, no spaces, UTF-8; NaN and infinities raise."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def demo_canonical(value) -> str:
    """The browser's form: whole floats print as integers, and -0 as 0."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{demo_canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(demo_canonical, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("only finite numbers have a canonical form")
        return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical form of JSON texts; null stays null."""
    for part in texts:
        yield part.map(lambda t: None if t is None else canonical_bytes(json.loads(t)).decode())


@F.pandas_udf(StringType())
def demo_canonical_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: None if t is None else demo_canonical(json.loads(t)))


def key_id(public_key: Column) -> Column:
    """'ed25519:' and 16 hex digits of the SHA-256 of a base64 public key."""
    return F.concat(F.lit("ed25519:"), F.substring(F.sha2(F.unbase64(public_key), 256), 1, 16))


def fingerprint(raw: bytes) -> str:
    return f"ed25519:{hashlib.sha256(raw).hexdigest()[:16]}"


def sign_one(payload: dict, payload_type: str, seed: bytes, signed_at: str, signed_by: str = "") -> dict:
    """A signed envelope; the signature covers the header, which holds the payload's hash."""
    if payload_type not in PAYLOAD_TYPES:
        raise ValueError(f"payload_type has to be one of {', '.join(PAYLOAD_TYPES)}")
    if not isinstance(payload, dict):
        raise ValueError("a payload is an object")
    key = ed25519.public_key(seed)
    values = (VERSION, payload_type, f"sha256:{hashlib.sha256(canonical_bytes(payload)).hexdigest()}", signed_at, signed_by.strip() or fingerprint(key), fingerprint(key), base64.b64encode(key).decode())
    head = dict(zip(HEADER, values))
    return head | {"payload": payload, "signature": base64.b64encode(ed25519.sign(seed, canonical_bytes(head))).decode()}


def verify_one(envelope: dict) -> tuple[bool, str]:
    """(valid, reason): the first check that fails gives the reason."""
    if envelope.get("attestation_version") != VERSION:
        return False, "version"
    if {"payload", "signature", *HEADER} - set(envelope):
        return False, "missing_fields"
    if f"sha256:{hashlib.sha256(canonical_bytes(envelope['payload'])).hexdigest()}" != envelope["payload_hash"]:
        return False, "payload_hash"
    try:
        key, signature = (base64.b64decode(envelope[k], validate=True) for k in ("public_key", "signature"))
    except (ValueError, TypeError):
        return False, "encoding"
    if len(key) != 32:
        return False, "encoding"
    if fingerprint(key) != envelope["key_id"]:
        return False, "key_id"
    if not ed25519.verify(key, canonical_bytes({k: envelope[k] for k in HEADER}), signature):
        return False, "signature"
    return True, "ok"


def signed(payloads: DataFrame, payload_type: str, seed: bytes, signed_at: str, column: str = "payload") -> DataFrame:
    """Adds ``envelope``, the signed envelope of each JSON payload, as JSON."""

    @F.pandas_udf("string")
    def envelope(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: None if t is None else json.dumps(sign_one(json.loads(t), payload_type, seed, signed_at), ensure_ascii=False))

    return payloads.withColumn("envelope", envelope(column))


@F.pandas_udf(StructType([StructField("valid", BooleanType()), StructField("reason", StringType())]))
def verified(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Verdict of each envelope; a text that isn't an object fails as 'unreadable'."""

    def one(text: str | None) -> tuple[bool, str]:
        try:
            value = json.loads(text or "")
        except ValueError:
            return False, "unreadable"
        return verify_one(value) if isinstance(value, dict) else (False, "unreadable")

    for part in texts:
        yield pd.DataFrame([one(t) for t in part], columns=["valid", "reason"])


def did_document(domain: str, public_key: bytes) -> dict:
    """A did:web document with the key as a JWK."""
    did = f"did:web:{domain}"
    raw = base64.urlsafe_b64encode(public_key).rstrip(b"=").decode()
    method = {"id": f"{did}#{fingerprint(public_key).split(':')[1]}", "type": "JsonWebKey2020", "controller": did, "publicKeyJwk": {"kty": "OKP", "crv": "Ed25519", "x": raw}}
    return {"@context": ["https://www.w3.org/ns/did/v1"], "id": did, "verificationMethod": [method], "assertionMethod": [method["id"]]}


def tampered(text: Column) -> Column:
    """The text with its first digit bumped, or, without one, its first letter's case flipped, or else a full stop after it."""
    at = F.regexp_instr(text, F.lit("[0-9]"))
    digit = F.substring(text, at, F.lit(1))
    letter = F.regexp_instr(text, F.lit("[A-Za-z]"))
    one = F.substring(text, letter, F.lit(1))
    flipped = F.when(one == F.lower(one), F.upper(one)).otherwise(F.lower(one))
    bumped = ((digit.cast("int") + 1) % 10).cast("string")
    return F.when(at > 0, F.overlay(text, bumped, at, 1)).when(letter > 0, F.overlay(text, flipped, letter, 1)).otherwise(F.concat(text, F.lit(".")))


def tampered_signature(signature: Column) -> Column:
    """A hex signature whose last digit is the next one; '0' for an empty one."""
    last = F.lower(F.right(signature, F.lit(1)))
    following = F.when(last.rlike("^[0-9a-f]$"), F.lower(F.hex(F.pmod(F.conv(last, 16, 10).cast("int") + 1, F.lit(16))))).otherwise("0")
    return F.when(F.length(signature) == 0, "0").otherwise(F.concat(F.left(signature, F.length(signature) - 1), following))
