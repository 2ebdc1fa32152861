"""Signed grants: who may do what, on which file or digest, until when.

A token is base64url(payload).base64url(HMAC-SHA256); the payload is permission|file|sha256|expiry. Hosts that serve a store
can check requests in bulk with ``grant``.
"""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = {"read": 1, "write": 2}
GRANT = T.StructType([T.StructField("permission", T.StringType()), T.StructField("file", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("expiry", T.LongType())])


def sign(secret: bytes, permission: str, expiry: int, file: str = "", sha256: str = "") -> str:
    payload = f"{permission}|{file}|{sha256.lower()}|{expiry}".encode()
    return ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (payload, hmac.digest(secret, payload, hashlib.sha256)))


def validate(secret: bytes, token: str | None, now: int) -> dict | None:
    """The grant of a token; None for a forged, broken or expired one."""
    try:
        payload, mac = (base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in token.split("."))
        permission, file, sha, expiry = payload.decode().split("|")
        good = hmac.compare_digest(mac, hmac.digest(secret, payload, hashlib.sha256)) and permission in LEVELS and int(expiry) > now
    except (AttributeError, ValueError):
        return None
    return {"permission": permission, "file": file, "sha256": sha, "expiry": int(expiry)} if good else None


def grant(secret: bytes, token: Column, now: int) -> Column:
    """validate over a column."""

    @F.pandas_udf(GRANT)
    def run(tokens: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([validate(secret, t, now) or dict.fromkeys(GRANT.names) for t in tokens], columns=GRANT.names).astype({"expiry": "Int64"})

    return run(token)


def allows(g: Column, permission: Column, file: Column, sha256: Column) -> Column:
    """Whether a grant covers a request: its level, and its file or digest where it is bound to one."""
    level = lambda p: F.when(p == "write", 2).when(p == "read", 1).otherwise(0)
    free = lambda bound, asked: (bound == "") | (bound == F.lower(F.coalesce(asked, F.lit(""))))
    return F.coalesce((level(g["permission"]) >= level(permission)) & free(g["file"], file) & free(g["sha256"], sha256), F.lit(False))
