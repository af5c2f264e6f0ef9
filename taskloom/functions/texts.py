"""Fuzzy scores, stored timestamps, JSON equality and payload codecs as column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\r\f\x0b"
STAMP = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def fuzzy_score(query: str, text: Column) -> Column:
    """How well ``query`` fits ``text`` (double): equal, then contained, then as a subsequence; 0 where it doesn't fit."""
    q = query.strip().lower()
    if not q:
        return F.lit(1.0)

    def score(c: Column) -> Column:
        def step(at: Column, letter: Column) -> Column:
            found = F.position(letter, c, at["last"] + 2) - 1
            gap = found - at["last"] - 1
            before = F.substring(c, found, F.lit(1))
            gain = F.when(gap == 0, 12).otherwise(4) + F.when((found == 0) | before.isin("-", "_", "/"), 8).otherwise(0) - gap
            went = F.struct((at["score"] + gain).alias("score"), found.alias("last"), F.lit(True).alias("fits"))
            return F.when(at["fits"] & (found >= 0), went).otherwise(F.struct(F.lit(0).alias("score"), F.lit(-1).alias("last"), F.lit(False).alias("fits")))

        start = F.struct(F.lit(0).alias("score"), F.lit(-1).alias("last"), F.lit(True).alias("fits"))
        loose = F.aggregate(F.array(*map(F.lit, q)), start, step, lambda at: F.when(at["fits"], F.greatest(F.lit(1.0), at["score"].cast("double") - F.length(c) * F.lit(0.1))).otherwise(0.0))
        direct = F.position(F.lit(q), c) - 1
        return F.when(c == "", 0.0).when(c == q, 1000.0 + len(q)).when(direct >= 0, (700 + 10 * len(q) - direct).cast("double")).otherwise(loose)

    return F.transform(F.array(F.lower(F.btrim(text, F.lit(SPACE)))), score)[0]


def parse_stamp(text: Column) -> Column:
    """Epoch microseconds of a stored timestamp with an offset, by T or a space; null for any other text."""
    return F.when(text.rlike(STAMP), F.unix_micros(F.regexp_replace(text, r"(\.\d{6})\d+", "$1").try_cast("timestamp_ltz")))


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts hold the same value, whatever the order of keys; null where either is null or no JSON."""

    def same(x, y):
        try:
            return json.dumps(json.loads(x, parse_int=float), sort_keys=True) == json.dumps(json.loads(y, parse_int=float), sort_keys=True)
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("boolean")
    def equal(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([same(x, y) for x, y in zip(xs, ys)], dtype="object")

    return equal(a, b)


@dataclass(frozen=True)
class Codec:
    """Payload bytes to stored bytes and back, as column functions; ``decode`` gives null for what it can't open."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    identity: bool = False


IDENTITY = Codec(lambda c: c, lambda c: c, True)


def aes(key: Column) -> Codec:
    """AES-GCM under a key of 16, 24 or 32 bytes."""
    return Codec(lambda c: F.aes_encrypt(c, key, F.lit("GCM")), lambda c: F.try_aes_decrypt(c, key, F.lit("GCM")))


def decode_payload(codec: Codec, stored: Column) -> Column:
    """Stored bytes as text; null stays null."""
    return codec.decode(stored).cast("string")


def encode_error(codec: Codec, text: Column, tag: str = "enc:") -> Column:
    """An error text as stored: plain under the identity, else base64 behind ``tag``; empty stays empty."""
    return text if codec.identity else F.when(text == "", "").otherwise(F.concat(F.lit(tag), F.base64(codec.encode(text.cast("binary")))))


def decode_error(codec: Codec, stored: Column, tag: str = "enc:") -> Column:
    """The text of a stored error; a prefix stays, a tag before what isn't base64 is plain text, null where the codec can't open it."""
    if codec.identity:
        return stored
    at = F.position(F.lit(tag), stored)
    token = F.substring(stored, at + len(tag), F.length(stored))
    return F.when((at == 0) | ~token.rlike(BASE64), stored).otherwise(F.concat(F.substring(stored, F.lit(1), at - 1), codec.decode(F.unbase64(token)).cast("string")))
