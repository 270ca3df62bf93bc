"""URL filter: a cascade of Bloom filters gives exact membership of a url's keys in rule lists, without a join.

A rule is host + path; it fits its host and all subdomains if a url's path starts with the rule's path. A url's
candidate keys are its host's suffixes joined to its path's prefixes, in the shapes (labels, path length) that
some rule has. For each list, level 0 encodes the listed keys, level 1 those keys of the corpus that pass level 0
though unlisted, level 2 the listed ones that pass level 1, and so on until none passes: over this universe
(the corpus's keys and all rules) the answer is exact. The first level's rate is chosen so that about as many
false positives as listed keys are expected; so all levels are as large as the lists, whatever the corpus. Keys stay in
tables; of a level only its bits come to the driver, and plans hold them as one binary literal of up to LITERAL_BYTES.
Where a list's levels would be larger (above a million rules or so), the keys of the different urls are joined with the rules.

Null urls and those without `://` have empty host and path. The longest fitting rule wins, between equals the one
of the longer host; of a rule listed twice the first counts. A url that no rule fits is allowed. Every input row
gives one output row; other columns of the input never matter.
"""

from __future__ import annotations

import json
import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Bytes of one level's bits in a plan.
LITERAL_BYTES = 4 << 20
#: False positive rate of all levels but the first.
RATE = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def shapes(rules: tuple[tuple[str, str], ...]) -> list[tuple[int, int]]:
    """(labels of the host, length of the path) that some rule has."""
    found = set()
    for _, rule in rules:
        host, slash, path = rule.partition("/")
        found.add((host.count(".") + 1, len(slash + path)))
    return sorted(found)


def candidates(host: Column, path: Column, kinds: list[tuple[int, int]]) -> Column:
    """Array of a url's keys, longest first, then by longer host."""
    keys = [F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n))) for labels, n in kinds]
    known = F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull() & (k != "")))
    width = lambda k: F.length(F.substring_index(k, "/", 1))
    order = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(width(b) - width(a))
    return F.array_sort(known, order)


class TooLarge(Exception):
    """A level beyond LITERAL_BYTES."""


@dataclass
class Level:
    """One Bloom filter: its size in bits, hash functions, seed and bits."""

    n_bits: int
    n_hashes: int
    seed: int
    bits: bytes = b""

    def positions(self, key: Column) -> list[Column]:
        a, b = (F.pmod(F.xxhash64(*x), F.lit(1 << 40)) for x in ((key, F.lit(self.seed)), (F.lit(self.seed), key)))
        return [F.pmod(a + b * F.lit(i) if i else a, F.lit(self.n_bits)) for i in range(self.n_hashes)]

    def holds(self, key: Column) -> Column:
        bits, out = F.lit(self.bits), F.lit(True)
        for p in self.positions(key):
            byte = F.ascii(F.decode(F.substring(bits, F.floor(p / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
            out = out & (F.getbit(byte, F.pmod(p, F.lit(8)).cast("int")) == 1)
        return out


def level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter over the column `key` of n rows; its bits are combined by an aggregate, only they come to the driver."""
    words = max(1, math.ceil(-max(1, n) * math.log(rate) / math.log(2) ** 2 / 64))
    if 8 * words > LITERAL_BYTES:
        raise TooLarge
    out = Level(64 * words, max(1, round(-math.log2(rate))), seed)
    at = keys.select(F.explode(F.array(*out.positions(F.col("key")))).alias("p"))
    set_ = at.groupBy(F.floor(F.col("p") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("bits"))
    held = [0] * words
    for r in set_.collect():  # at most LITERAL_BYTES / 8 rows
        held[r.word] = r.bits
    out.bits = struct.pack(f"<{words}q", *held)
    return out


def _rows(spark: SparkSession, values: list, kind: str) -> DataFrame:
    """Column `x` of values of a kind, from one literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")).alias("x"))


def listed(spark: SparkSession, keys: list[str]) -> DataFrame:
    return _rows(spark, keys, "string").withColumnRenamed("x", "key")


def ruled(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    """key and list of every rule."""
    return _rows(spark, [{"key": k, "list": v} for v, own in lists.items() for k in own], "struct<key:string,list:string>").select("x.*")


def member(levels: list[Level], key: Column) -> Column:
    """Exact for keys of the universe: in the list if the first level that misses the key is an odd one."""
    out = F.lit(len(levels) % 2 == 1)
    for i, x in reversed(list(enumerate(levels))):
        out = F.when(~x.holds(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def cascades(keys: DataFrame, lists: dict[str, list[str]], n_universe: int) -> dict[str, list[Level]]:
    """A cascade for each list; `keys` has the corpus's keys in column `key`, at most n_universe different ones."""
    spark = keys.sparkSession
    tables = {v: listed(spark, own) for v, own in lists.items()}
    first = {v: level(tables[v], len(own), min(RATE, math.sqrt(RATE) * len(own) / max(1, n_universe)), 1) for v, own in lists.items()}
    universe = keys
    for t in tables.values():
        universe = universe.unionByName(t)
    passed = F.array_compact(F.array(*(F.when(x.holds(F.col("key")), F.lit(v)) for v, x in first.items())))
    false = written(universe.select("key", F.explode(passed).alias("list")).distinct().join(ruled(spark, lists), ["key", "list"], "left_anti"), "false")
    out = {}
    for v in lists:
        levels, inside, outside, done = [first[v]], tables[v], false.filter(F.col("list") == v).select("key"), []
        while n := outside.count():
            levels.append(level(outside, n, RATE, len(levels) + 1))
            done.append(written(inside.filter(levels[-1].holds(F.col("key"))), "false"))
            inside, outside = outside, done[-1]
        out[v] = levels
        removed(spark, *done)
    removed(spark, false)
    return out


def _joined(urls: DataFrame, kinds: list[tuple[int, int]], rules: DataFrame) -> DataFrame:
    """The urls with `best`, the first (key, verdict) of their keys that are in the rules."""
    keys = urls.select("host", "path").distinct()
    keys = keys.select("host", "path", F.posexplode(candidates(F.col("host"), F.col("path"), kinds)).alias("n", "key"))
    found = keys.join(rules, "key").groupBy("host", "path").agg(F.min(F.struct("n", "key", "verdict")).alias("best"))
    return urls.join(found, ["host", "path"], "left")


def filter_urls(df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (of the longest that fits, or null) and verdict of every row."""
    lists: dict[str, list[str]] = {}
    seen: set[str] = set()
    for verdict, rule in rules:
        if rule not in seen:
            seen.add(rule)
            lists.setdefault(verdict, []).append(rule)
    host, path = split_url(F.col(url_col))
    urls = df.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not lists:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    kinds = shapes(rules)
    keyed = urls.withColumn("keys", candidates(F.col("host"), F.col("path"), kinds))
    try:
        built = cascades(keyed.select(F.explode("keys").alias("key")), lists, df.count() * len(kinds) + len(seen))
    except TooLarge:
        told = _joined(urls, kinds, ruled(df.sparkSession, lists).withColumnRenamed("list", "verdict"))
    else:
        which = lambda key: F.coalesce(*(F.when(member(x, key), F.lit(v)) for v, x in built.items()), F.lit(None).cast("string"))
        fits = F.filter(F.transform("keys", lambda k: F.struct(k.alias("key"), which(k).alias("verdict"))), lambda x: x.verdict.isNotNull())
        told = keyed.withColumn("best", F.get(fits, F.lit(0)))
    return told.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def oracle(rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """The same rows by DuckDB, with a plain CASE over the rules from the longest."""
    tests = sorted(rules, key=lambda r: -len(r[1]))

    def case(value) -> str:
        parts = []
        for verdict, rule in tests:
            host, slash, rest = rule.partition("/")
            parts.append(f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{slash + rest}') then '{value(verdict, rule)}'")
        return "case " + " ".join(parts)

    return f"""
    with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from a),
    c as (select page_id, translate(raw, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b)
    select page_id, host, path, {case(lambda v, r: r)} end as rule, {case(lambda v, r: v)} else 'allow' end as verdict from c
    """
