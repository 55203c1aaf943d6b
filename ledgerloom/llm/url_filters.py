"""URL filters: exact membership in a key list through a cascade of Bloom filters.

The first filter encodes the listed keys. Keys of the corpus that it wrongly lets through are encoded
by a second one, listed keys that the second wrongly holds by a third, and so on until a level
holds no wrong key. Built over every key that occurs in the corpus, the cascade answers
exactly for each of them: the first level that does not hold a key tells by its parity.
Looking a URL up needs no join and no shuffle.

Keys are domains. A host is listed if it or one of its parent domains is, so the key universe
holds every suffix of two or more labels of every host.

How it spreads: keys fall into shards of about `keys_per_shard` listed keys. Filter words are
or-ed together by Spark; a pass takes shards whose filters stay under `pass_bytes`, which bounds
what the driver gathers and broadcasts. A longer list takes more passes over the keys, in blocks,
not larger broadcasts.

Defined cases: a NULL url, one without `://` and an empty host have no key and are not
listed; repeated rows are judged alike; an empty list lists nothing; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import base

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the production query, and its list of domains.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
LISTED_NAMES = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track")
LISTED_PARENTS = ("example.com", "example.net", "example.org")


@dataclass(frozen=True)
class Sizes:
    """Parameters of the filters."""

    bits_per_key: int = 12
    hashes: int = 8
    keys_per_shard: int = 1_000_000
    pass_bytes: int = 64 << 20


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def keys_of(host: Column) -> Column:
    """The host without user and port, and its parents of two or more labels; none for an empty host.

    A domain name has at most 127 labels; of a longer host, only parents of so many are keys."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+$", "")
    labels = F.split(bare, r"\.")
    labels = F.slice(labels, F.greatest(F.size(labels) - 126, F.lit(1)), F.lit(127))
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(parents)


def _hashed(keys: DataFrame, shards: int) -> DataFrame:
    """key, two 44-bit hashes, whose multiples stay in range, and the shard."""
    wide = F.xxhash64("key")
    return keys.select(
        "key",
        F.shiftrightunsigned(wide, 20).alias("h"),
        F.shiftrightunsigned(F.xxhash64(F.lit("step"), "key"), 20).alias("step"),
        F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(shards)).cast("int").alias("shard"),
    )


@dataclass
class Level:
    bits: int
    hashes: int
    shards: dict[int, np.ndarray]

    def holds(self, number: int, h: np.ndarray, step: np.ndarray, shard: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), dtype=bool)
        for s, words in self.shards.items():
            rows = np.flatnonzero(shard == s)
            inside = np.ones(len(rows), dtype=bool)
            for j in range(self.hashes):
                at = (h[rows] + (j + 1 + number * self.hashes) * step[rows]) % self.bits
                inside &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            found[rows] = inside
        return found


def _within(levels: list[Level], h, step, shard) -> np.ndarray:
    """Whether each key is listed, by the first level that does not hold it."""
    listed = np.zeros(len(h), dtype=bool)
    open_rows = np.arange(len(h))
    for number, level in enumerate(levels):
        held = level.holds(number, h[open_rows], step[open_rows], shard[open_rows])
        listed[open_rows[~held]] = number % 2 == 1
        open_rows = open_rows[held]
    listed[open_rows] = len(levels) % 2 == 1
    return listed


def _encoded(keys: DataFrame, number: int, count: int, shards: int, sizes: Sizes) -> Level:
    """One level over hashed keys: words of 64 bits or-ed by Spark, gathered within the pass's bound."""
    # Odd and different at each level, so that keys that fall together at one part at the next.
    bits = max(2, math.ceil(count / max(shards, 1) * sizes.bits_per_key / 64)) * 64 + 2 * number + 1
    at = F.explode(
        F.transform(
            F.sequence(F.lit(1 + number * sizes.hashes), F.lit((number + 1) * sizes.hashes)),
            lambda j: (F.col("h") + j * F.col("step")) % bits,
        )
    ).alias("at")
    words = (
        keys.select("shard", at)
        .groupBy("shard", F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("mask"))
    )
    found: dict[int, np.ndarray] = {}
    for part in words.toArrow().to_batches():
        shard, word, mask = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for s in np.unique(shard):
            own = shard == s
            found.setdefault(int(s), np.zeros(bits // 64 + 1, dtype=np.uint64))[word[own]] = mask[own].view(np.uint64)
    return Level(bits, sizes.hashes, found)


def _held(keys: DataFrame, level: Level, number: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, step, shard = (b.column(i).to_numpy() for i in (1, 2, 3))
            yield b.filter(pa.array(shared.value.holds(number, h, step, shard)))

    return keys.mapInArrow(test, keys.schema)


@dataclass
class Cascade:
    """Passes of (shards, levels); a key's shard lies in exactly one pass."""

    shards: int
    passes: list[tuple[range, list[Level]]]

    def listed_any(self, rows: DataFrame, keys: str, name: str) -> DataFrame:
        """The rows with a flag: whether any of the array column's keys is listed."""
        hashed = F.transform(
            keys,
            lambda k: F.struct(
                F.shiftrightunsigned(F.xxhash64(k), 20).alias("h"),
                F.shiftrightunsigned(F.xxhash64(F.lit("step"), k), 20).alias("step"),
                F.pmod(F.xxhash64(F.lit("shard"), k), F.lit(self.shards)).cast("int").alias("shard"),
            ),
        )
        out = rows.withColumn("_hashed", hashed).withColumn(name, F.lit(False))
        for own, levels in self.passes:
            out = self._look_up(out, own, levels, name)
        return out.drop("_hashed")

    @staticmethod
    def _look_up(rows: DataFrame, own: range, levels: list[Level], name: str) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(levels)
        first, last = own.start, own.stop

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(b.schema.get_field_index("_hashed"))
                flat = lists.flatten()
                h, step, shard = (np.asarray(flat.field(i)) for i in range(3))
                row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
                mine = (shard >= first) & (shard < last)
                hit = np.zeros(len(h), dtype=bool)
                hit[mine] = _within(shared.value, h[mine], step[mine], shard[mine])
                at = b.schema.get_field_index(name)
                flags = np.array(b.column(at).to_numpy(zero_copy_only=False), dtype=bool)
                flags[row[hit]] = True
                yield b.set_column(at, name, pa.array(flags))

        return rows.mapInArrow(test, rows.schema)


def build(universe: DataFrame, listed: DataFrame, sizes: Sizes = Sizes()) -> Cascade:
    """The cascade for a list (`key`) that answers exactly for every key of the universe (`key`)."""
    names = listed.where(F.col("key").isNotNull()).select("key").distinct()
    total = names.count()
    shards = max(1, math.ceil(total / sizes.keys_per_shard))
    inside = base.stored(_hashed(names, shards), "listed-keys")
    outside = base.stored(
        _hashed(universe.select("key").distinct().join(names, "key", "left_anti"), shards), "other-keys"
    )
    # The first level is the largest; the rest together are smaller than it.
    each = 2 * math.ceil(total / shards * sizes.bits_per_key / 8) + 64
    step = max(1, sizes.pass_bytes // each)
    passes = []
    for first in range(0, shards, step):
        own = range(first, min(first + step, shards))
        mine = (F.col("shard") >= own.start) & (F.col("shard") < own.stop)
        encode, test = inside.where(mine), outside.where(mine)
        levels: list[Level] = []
        count = encode.count()
        while count:
            number = len(levels)
            levels.append(_encoded(encode, number, count, len(own), sizes))
            wrong = base.stored(_held(test, levels[-1], number), "wrongly-held")
            encode, test, count = wrong, encode, wrong.count()
        passes.append((own, levels))
    return Cascade(shards, passes)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """A value of the longest rule that fits, NULL if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, sizes: Sizes = Sizes()) -> DataFrame:
    """page_id, host, path, the fitting rule, whether the host is listed, and the verdict."""
    url = F.col("url").cast("string")
    parsed = pages.select(
        "page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path")
    )
    universe = (
        parsed.select("host").distinct().select(F.explode(keys_of(F.col("host"))).alias("key")).distinct()
    )
    cascade = build(universe, listed, sizes)
    host, path = F.col("host"), F.col("path")
    rows = cascade.listed_any(parsed.withColumn("keys", keys_of(host)), "keys", "listed").drop("keys")
    return rows.select(
        "page_id", "host", "path",
        matched_rule(host, path, rules, lambda r: r.text).alias("rule"),
        F.coalesce(
            matched_rule(host, path, rules, lambda r: r.verdict),
            F.when(F.col("listed"), "block").otherwise("allow"),
        ).alias("verdict"),
        "listed",
    )


def production_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(f"{name}.{parent}",) for name in LISTED_NAMES for parent in LISTED_PARENTS], "key string"
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    base.small_batches(spark, 10_000)
    return judge(base.table(spark, sf_dir, "pages"), production_list(spark))


ORACLE = """
WITH parsed AS (
  SELECT page_id,
         CASE WHEN contains(url, '://')
           THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://')
           THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), marked AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/')
                THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/')
                THEN 'example.com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
         regexp_matches(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'),
           '^(.*\\.)?(spam-farm|cheap-pills|casino-win|free-bets|adult-x|ads-track)\\.example\\.(com|net|org)\\.*$') AS listed
  FROM parsed
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM marked
"""
