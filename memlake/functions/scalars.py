"""Small scalar functions of the applications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default lifetimes of the memory tiers in seconds (fixed values).
TIER_TTL = {"working": 300, "session": 3600, "project": 30 * 86400, "user": 365 * 86400}


def cache_key(text: Column) -> Column:
    """The first 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def crc32(data: Column) -> Column:
    """The CRC-32 of a text's UTF-8 bytes."""
    return F.crc32(data.cast("binary"))


def fnv1a(data: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes, as a signed long (offset basis and prime are fixed values)."""
    basis, prime = 0xCBF29CE484222325 - (1 << 64), 0x100000001B3
    low = (1 << 32) - 1
    octets = F.transform(F.filter(F.split(F.regexp_replace(F.hex(data.cast("binary")), "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))

    def step(h: Column, octet: Column) -> Column:
        # the prime is 2**40 + 435: products modulo 2**64 by halves, as longs must not overflow
        x = h.bitwiseXOR(octet)
        small, large = x.bitwiseAND(F.lit(low)), F.shiftrightunsigned(x, 32)
        first = small * F.lit(prime & low)
        upper = (F.shiftrightunsigned(first, 32) + large * F.lit(prime & low) + small * F.lit(prime >> 32)).bitwiseAND(F.lit(low))
        return F.shiftleft(upper, 32).bitwiseOR(first.bitwiseAND(F.lit(low)))

    return F.aggregate(octets, F.lit(basis).cast("long"), step)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def short_id(i: Column) -> Column:
    return F.substring(i, 1, 8)


def format_ttl(seconds: Column) -> Column:
    """Whole seconds, minutes, hours or days, the largest unit that fits."""
    whole = lambda d: F.floor(seconds / d).cast("string")
    return (
        F.when(seconds < 60, F.concat(whole(1), F.lit("s")))
        .when(seconds < 3600, F.concat(whole(60), F.lit("m")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit("h")))
        .otherwise(F.concat(whole(86400), F.lit("d")))
    )


def score_bucket(score: Column, high: float = 0.7, low: float = 0.5) -> Column:
    return F.when(score >= high, "high").when(score >= low, "medium").otherwise("low")


def format_score(score: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", score)


def tier_ttl(tier: Column) -> Column:
    pairs = [x for t, s in TIER_TTL.items() for x in (F.lit(t), F.lit(s).cast("long"))]
    return F.create_map(*pairs)[tier]


def expires_at(created_at: Column, ttl: Column) -> Column:
    return created_at + ttl


def ttl_remaining(expires: Column, now: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), expires - now)


def active(expires: Column, now: Column) -> Column:
    """The engine's rule: a row is gone at its expiry."""
    return expires.isNull() | (now < expires)


def unexpired(expires: Column, now: Column) -> Column:
    """The memory application's rule: a row is gone after its expiry."""
    return expires.isNull() | ~(now > expires)
