"""URL filters: longest-match rules, then a Bloom filter cascade of listed hosts.

The cascade answers "is this key listed?" exactly for every key of a known universe.
Level 0 is a Bloom filter of the listed keys; level 1 encodes those keys of the
universe that level 0 takes wrongly, level 2 the listed ones that level 1 takes, and
so on until nothing is taken wrongly. A key is judged by the first level that refuses
it: refused by an even level, it is not listed; by an odd one, it is. Sizes follow
the optimum for cascades: level 0 lets about as many wrong keys through as there are
listed ones, each further level halves what is left, so the bits grow with the
listed keys and only with the logarithm of the universe. Built-in functions only; the
levels reach the scan as scalar subqueries, so the pages are neither joined nor shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import ascii_lower, checkpoint

#: Fixed values: (host, path, verdict) of the rules, and the listed hosts.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LISTED_HOSTS = (
    "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org",
    "casino-win.example.com", "casino-win.example.net", "casino-win.example.org",
    "free-bets.example.com", "free-bets.example.net", "free-bets.example.org",
    "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org",
    "ads-track.example.com", "ads-track.example.net", "ads-track.example.org",
    "adult-x.example.com", "adult-x.example.net", "adult-x.example.org",
)
#: A level has so many bits (32 MB) at most; more listed keys are dealt out to several cascades.
MAX_BITS = 1 << 28


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


class Cascade:
    """A Bloom filter cascade over keys: ``Cascade(universe, listed).has(key)``.

    Both are DataFrames of one string column. Null keys are in neither; repeated keys
    count once. Without listed keys nothing is a member. Keys outside the universe get
    an approximate answer. If level 0 would need more than ``max_bits`` bits, keys are
    dealt out by hash to as many cascades as keep each below that, each built from its
    own share of the universe and of the list; what is broadcast is then the sum of all
    levels, about 10 bits a listed key.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS, deal: bool = True):
        self.parts: list[Cascade] = []
        self.levels: list[tuple[DataFrame, int, int]] = []
        inside = checkpoint(listed.toDF("key").where("key is not null").distinct())
        universe = checkpoint(universe.toDF("key").where("key is not null").distinct())
        a, b = inside.count(), universe.count()
        if deal and self._size(a, b)[0] > max_bits:
            n = 2 * math.ceil(self._size(a, b)[0] / max_bits)
            self.parts = [Cascade(universe.where(self._part(F.col("key"), n) == i), inside.where(self._part(F.col("key"), n) == i), max_bits, False) for i in range(n)]
            return
        # level 0 encodes the list; level 1 the keys of the universe that it takes wrongly; and so on
        outside = None
        while a:
            m, k = self._size(a, b)
            self.levels.append((checkpoint(self._build(inside, m, k)), m, k))
            taken = (universe if outside is None else outside).where(self._test(F.col("key"), len(self.levels) - 1))
            # only the few keys of the universe that level 0 takes are held against the list
            wrong = checkpoint(taken.join(inside, "key", "left_anti") if outside is None else taken)
            inside, outside, a, b = wrong, inside, wrong.count(), a

    @staticmethod
    def _part(key: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(n))

    def _size(self, a: int, b: int) -> tuple[int, int]:
        """Bits and hashes of the next level, for ``a`` keys against ``b``."""
        rate = min(0.5, a / (math.sqrt(2) * b)) if not self.levels and b else 0.5
        k = max(1, round(-math.log2(rate))) if a else 1
        return max(64, 64 * math.ceil(a * k / math.log(2) / 64)), k

    def _positions(self, key: Column, level: int, m: int, k: int) -> list[Column]:
        h = F.xxhash64(F.lit(level), key)
        one, two = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
        return [(one + two * j) % m for j in range(k)]

    def _build(self, keys: DataFrame, m: int, k: int) -> DataFrame:
        """One row: the level's bits as an array of 64-bit words."""
        bits = keys.select(F.explode(F.array(*self._positions(F.col("key"), len(self.levels), m, k))).alias("p"))
        one = F.expr("shiftleft(cast(1 as bigint), cast(p % 64 as int))")
        words = bits.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(one).alias("v"))
        words = words.unionByName(keys.sparkSession.range(m // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v")))
        words = words.groupBy("w").agg(F.bit_or("v").alias("v"))
        # m / 64 rows at most, whatever the number of pages
        return words.agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("x")).select(F.transform("x", lambda x: x["v"]).alias("bits"))

    def _test(self, key: Column, level: int) -> Column:
        df, m, k = self.levels[level]
        bits = df.scalar()
        out = F.lit(True)
        for p in self._positions(key, level, m, k):
            word = F.get(bits, F.floor(p / 64).cast("int"))
            out = out & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0)
        return out

    def has(self, key: Column) -> Column:
        """True exactly for the listed keys of the universe."""
        if self.parts:
            part, out = self._part(key, len(self.parts)), F.lit(False)
            for i, c in enumerate(self.parts):
                out = F.when(part == i, c.has(key)).otherwise(out)
            return out
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._test(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def judge_urls(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    The longest rule that fits decides; without one a page is blocked if its host or a
    parent domain is listed, else allowed. A first cascade has the list against the
    universe of all hosts and parent domains of the table; it judges the distinct
    hosts, and a second one carries their verdicts to the pages, which are neither
    joined nor shuffled. Null urls and urls without ``://`` have empty host and path.
    Repeated rows and null ids stay; an empty table gives an empty result; other
    columns are not read.
    """
    spark = pages.sparkSession
    if listed is None:
        listed = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "key string")
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = checkpoint(p.select("host").distinct())
    domains = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("key"))
    by_domain = Cascade(domains.select("key"), listed)
    cascade = Cascade(hosts, domains.where(by_domain.has(F.col("key"))).select("host"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    member = cascade.has(F.col("host"))
    return p.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(member, "block").otherwise("allow")).alias("verdict"))
