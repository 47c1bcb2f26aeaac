"""URL filters: a cascade of Bloom filters over the corpus's hosts, in DataFrame operations only.

Level 1 holds the listed keys; level 2 the other keys of the corpus that level 1 lets pass;
level 3 the listed keys that level 2 lets pass; and so on until no key passes wrongly. As the
levels are built over every key that the corpus has, following them down gives exact
membership for all of its rows, without a join: a filter is a bitmap read by index.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rules (verdict, host, path); the fixed ones of the production query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bits of one level up to which its bitmap goes to all executors; larger lists are joined instead.
MOST_BITS = 1 << 26
#: Listed hosts of the production query: those of whose pages at least one in so many is blocked by a rule.
LISTED_SHARE = 4


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdicts(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (like `net/`) and its verdict, null where none fits.

    A rule fits its host and all subdomains, if the path starts with the rule's; rules of equal
    length go by name.
    """
    name = verdict = F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    one, two = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1)).bitwiseOR(F.lit(1))
    return [F.pmod(F.shiftright(one, 1) + F.lit(k) * F.shiftrightunsigned(two, 8), F.lit(bits)) for k in range(hashes)]


def _bitmap(keys: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
    """One row, one column: the filter's 64-bit words in order."""
    spark = keys.sparkSession
    at = F.explode(F.array(*_positions(F.col("key"), level, bits, hashes)))
    words = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("value"))
    empty = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("value"))
    full = words.union(empty).groupBy("word").agg(F.bit_or("value").alias("value"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "value"))), lambda x: x["value"]).alias("words"))


class Cascade:
    """Exact membership of the universe's keys in a list, by alternating Bloom filters."""

    def __init__(self, universe: DataFrame, listed: DataFrame, rate: float = 0.01, most_bits: int = MOST_BITS, most_levels: int = 32):
        """universe, listed: (key). Keys listed but not in the universe are put aside: no row asks for them."""
        self.levels: list[tuple[DataFrame, int, int]] = []
        known = universe.select("key").where("key is not null").distinct()
        marks = listed.select("key").distinct().withColumn("listed", F.lit(True))
        tagged = materialise(known.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
        left, right = tagged.where("listed").select("key"), tagged.where("not listed").select("key")
        self.exact = None
        while (n := left.count()) > 0:
            if len(self.levels) >= most_levels:
                raise RuntimeError("the cascade did not end")
            bits = max(64, 64 * ceil(-n * log(rate) / log(2) ** 2 / 64))
            hashes = max(1, round(bits / n * log(2))) if n * 20 > bits else max(1, ceil(-log(rate, 2)))
            if bits > most_bits:
                self.exact = tagged.where("listed").select("key")
                break
            words = materialise(_bitmap(left, len(self.levels), bits, hashes))
            self.levels.append((words, bits, hashes))
            passed = materialise(right.where(self._passes(F.col("key"), len(self.levels) - 1)))
            left, right = passed, left

    def _passes(self, key: Column, level: int) -> Column:
        words, bits, hashes = self.levels[level]
        bitmap = words.scalar()
        out = F.lit(True)
        for at in _positions(key, level, bits, hashes):
            word = F.element_at(bitmap, (F.floor(at / 64) + 1).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that it fails decides, the last stands for all after it."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, k), out).otherwise(F.lit(k % 2 == 1))
        return out

    def mark(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """rows with a boolean column name: whether key is listed. A list beyond most_bits is joined exactly."""
        if self.exact is None:
            return rows.withColumn(name, self.contains(F.col(key)))
        named = self.exact.select(F.col("key").alias("_key"), F.lit(True).alias("_in"))
        return rows.join(named, rows[key] == F.col("_key"), "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_key", "_in")


def listed_hosts(judged: DataFrame, share: int = LISTED_SHARE) -> DataFrame:
    """(key): hosts of whose pages at least one in share is blocked by a rule; judged: (host, ruled)."""
    blocked = F.sum((F.col("ruled") == "block").cast("long"))
    return judged.groupBy("host").agg((F.coalesce(blocked, F.lit(0)) * share >= F.count("*")).alias("listed")).where("listed").select(F.col("host").alias("key"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed: DataFrame | None = None, share: int = LISTED_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict per row of pages (page_id, url; others are ignored).

    Where a rule fits, the longest decides. Elsewhere the cascade does: hosts of the block list
    `listed` (key) are blocked; by default the list holds the hosts that rules block often, see
    listed_hosts(), so that what no rule names on such a host goes as well. Null urls and urls
    without :// have empty host and path and are judged like any other host. Repeated rows and
    null ids give a row each; an empty table gives none.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_verdicts(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    keys = listed if listed is not None else listed_hosts(rows.select("host", "ruled"), share)
    cascade = Cascade(rows.select(F.col("host").alias("key")), keys)
    return cascade.mark(rows, "host", "in_list").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("in_list"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
