"""Keys, values and shards of the serving tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def bucketed_key(url: Column, granularity: Column, bucket: Column) -> Column:
    """`url/granularity-bucket` as UTF-8 bytes."""
    return text_bytes(F.concat(url, F.lit("/"), granularity, F.lit("-"), bucket.cast("string")))


def url_of_key(key: Column) -> Column:
    """What stands before the last slash of a key; null without one."""
    text = F.decode(key, "UTF-8")
    return F.when(F.contains(text, F.lit("/")), F.regexp_extract(text, r"(?s)^(.*)/[^/]*$", 1))


def big_endian(value: Column) -> Column:
    """A long as 8 bytes, the highest first."""
    return F.to_binary(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit("hex"))


def big_endian_pair(one: Column, two: Column) -> Column:
    return F.concat(big_endian(one), big_endian(two))


def from_big_endian(value: Column, at: int = 0) -> Column:
    """The long at byte `at` of a value. Its top bit is its sign."""
    part = F.hex(F.substring(value, at + 1, 8))
    high, low = F.conv(F.substring(part, 1, 8), 16, 10).cast("long"), F.conv(F.substring(part, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash (factor 31) over a text's UTF-16 units, as a signed int.

    Characters beyond U+FFFF count as their two surrogates.
    """
    code = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    one = lambda h, u: (h * 31 + u).bitwiseAND(F.lit(4294967295))
    step = lambda h, c: F.when(c < 65536, one(h, c)).otherwise(one(one(h, F.lit(55296) + F.shiftright(c - 65536, 10)), F.lit(56320) + (c - 65536) % 1024))
    total = F.aggregate(code, F.lit(0).cast("long"), step)
    return F.when(total >= 2147483648, total - 4294967296).otherwise(total).cast("int")


def url_shard(key: Column, shards: int = 32) -> Column:
    """Shard of a bucketed key by its URL alone, so that all buckets of a URL lie together.

    The remainder is never negative here.
    """
    return F.pmod(string_hash(url_of_key(key)), F.lit(shards))


def key_shard(key: Column, shards: int = 32) -> Column:
    """Shard by the whole key."""
    return F.pmod(F.hash(key), F.lit(shards))
