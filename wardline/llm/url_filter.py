"""URL filters by a Bloom filter cascade: exact membership of listed keys, without joins.

Level 1 holds the listed keys. Some keys of the corpus that are not listed pass it by chance; level 2
holds those. Some listed keys pass level 2 by chance; level 3 holds those, and so on until nobody passes
by chance. A key is listed if the first level that refuses it has an even number (or the last level that
accepts it has an odd one). This is exact for every key of the universe the cascade was built over, which
here is the complete set of keys the corpus' urls give.

Only DataFrame operations are used. A level is one row: its words of 64 bits, reached by plans as a scalar
subquery. Level 1 spends log2(universe / listed) bits more per key, all levels together about
listed * (1.44 log2(universe / listed) + 5) bits: the size follows the list, not the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.llm.common import cut_lineage, private_names, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Level 1 is at least this sparse, later levels pass half of the others.
LATER_RATE = 0.5
MAX_LEVELS = 200


@dataclass
class Level:
    """Bits of one Bloom filter: ``words`` is a one-row, one-column DataFrame (array<bigint>)."""

    words: DataFrame
    bits: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        words = self.words.scalar()
        tests = [
            F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0
            for p in places(key, self.bits, self.hashes, self.seed)
        ]
        found = tests[0]
        for t in tests[1:]:
            found = found & t
        return found


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))


def places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    """Bit numbers of a key by double hashing of one 64-bit hash."""
    h = F.xxhash64(key, F.lit(seed))
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [F.pmod(low + high * F.lit(i), F.lit(bits)) for i in range(hashes)]


def bloom(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the distinct values in column ``key`` (n of them) with about this false positive rate."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    bits = -(-bits // 64) * 64
    set_bits = keys.select(F.explode(F.array(*places(F.col("key"), bits, hashes, seed))).alias("p"))
    words = set_bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(_bit(F.col("p"))).alias("b"))
    # One row for the whole filter: a map from word number to word, laid out in order with empty words as 0.
    gathered = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
    full = gathered.select(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(bits // 64 - 1).cast("bigint")),
                    lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("bigint"))).alias("words"))
    return Level(cut_lineage(full), bits, hashes, seed)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe; false for null."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            answer = F.when(~self.levels[number - 1].passes(key), F.lit(number % 2 == 0)).otherwise(answer)
        return F.coalesce(answer & key.isNotNull(), F.lit(False))


def cascade(listed: DataFrame, universe: DataFrame, seed: int = 11) -> Cascade:
    """Build over column ``key`` of both; the universe may hold repeats and listed keys.

    The universe is scanned twice: once to estimate its size, once for the keys that pass level 1. Only
    those, about as many as are listed, are shuffled.
    """
    mine = cut_lineage(listed.select("key").filter(F.col("key").isNotNull()).distinct())
    n = mine.count()
    if n == 0:
        return Cascade()
    others = universe.select("key").filter(F.col("key").isNotNull())
    total = others.agg(F.approx_count_distinct("key", 0.02)).first()[0]
    first = bloom(mine, n, min(LATER_RATE, n * math.sqrt(LATER_RATE) / max(total, 1)), seed)
    found = Cascade([first])
    wrong = others.filter(first.passes(F.col("key"))).distinct().join(mine, "key", "left_anti")
    inside, outside = mine, cut_lineage(wrong)
    # Keys in ``outside`` pass all levels so far and belong to the other side.
    while (m := outside.count()) > 0:
        if len(found.levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end: two keys share all their hashes")
        level = bloom(outside, m, LATER_RATE, seed + len(found.levels))
        found.levels.append(level)
        inside, outside = outside, cut_lineage(inside.filter(level.passes(F.col("key"))))
    return found


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """(labels in the host, characters in the path) that rules have: a few small numbers, whatever the list's size."""
    found = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect()
    return sorted((r["labels"], r["chars"]) for r in found)


def candidate_keys(host: Column, path: Column, kinds: Sequence[tuple[int, int]]) -> list[Column]:
    """For each shape the key (ending of the host at a label, beginning of the path) a rule could have; null where the url is too short."""
    labels = F.size(F.split(host, r"\."))
    return [
        F.when((host != "") & (labels >= n) & (F.length(path) >= chars),
               F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, chars)))
        for n, chars in kinds
    ]


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of pages plus host, path, rule and verdict.

    ``rules``: (host, path, verdict), verdict being allow or block. A rule fits its host and all its
    subdomains where the url's path starts with the rule's; the longest fitting rule wins, else ``default``
    holds. A null url, or one without ``://``, has empty host and path and fits no rule. Repeated rows get
    equal answers. Columns of pages named like the four added ones are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = split_url(F.col(url))
    kinds = shapes(rules)
    parts = pages.withColumns({"host": host, "path": path})
    if not kinds:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    candidates = candidate_keys(F.col("host"), F.col("path"), kinds)
    universe = parts.select(F.explode(F.array(*candidates)).alias("key"))
    key = F.concat("host", "path").alias("key")
    sides = {side: cascade(rules.filter(F.col("verdict") == side).select(key), universe, 11 + k) for k, side in enumerate(("allow", "block"))}
    hits = []
    for k, (n, _) in zip(candidates, kinds):
        allow, block = (sides[side].contains(k) for side in ("allow", "block"))
        fit = F.struct((-F.length(k)).alias("l"), F.lit(-n).alias("n"), k.alias("rule"), F.when(block, "block").otherwise("allow").alias("verdict"))
        hits.append(F.when(allow | block, fit))
    best = F.array_min(F.array(*hits))  # the longest key; of equally long ones that with the longer host
    (name,) = private_names(parts, ["_best"])
    ruled = parts.withColumn(name, best)
    return ruled.select("*", F.col(f"{name}.rule").alias("rule"), F.coalesce(f"{name}.verdict", F.lit(default)).alias("verdict")).drop(name)


# The rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict WHERE false")
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("host", "path", "verdict"))]) for r in rules])
    return spark.range(1).select(F.inline(rows))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = f"""
WITH rules(rh, rp, rv) AS (VALUES {_VALUES}),
u AS (
  SELECT row_number() OVER () AS i, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
hits AS (
  SELECT i, rh || rp AS rule, rv,
    row_number() OVER (PARTITION BY i ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM hits WHERE k = 1) h USING (i)
"""
