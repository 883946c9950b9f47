"""URL rules by a cascade of Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, folded

#: A cascade has at most so many bits in all (1 MB); a longer list goes by an equi-join instead.
MAX_BITS = 1 << 23
MAX_LEVELS = 64
#: Verdict of an url that no rule fits.
DEFAULT = "allow"

#: verdict, host, path
RULES: list[tuple[str, str, str]] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidates(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """Every key host suffix + path prefix that a rule with a path of one of these lengths, and a host of at most so many labels,
    could have, longest first. Their number and size follow the rules, however many labels a host has."""
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in range(1, labels + 1)]))
    sizes = F.array(*[F.lit(n) for n in sorted(lengths)])
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(sizes, lambda n: n <= F.length(path)), lambda n: F.concat(s, F.substr(path, F.lit(1), n)))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(keys, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)))


def _positions(key: Column, seed: int, bits: int, k: int) -> list[Column]:
    a = F.shiftrightunsigned(F.xxhash64(F.lit(2 * seed), key), 8)
    b = F.shiftrightunsigned(F.xxhash64(F.lit(2 * seed + 1), key), 16)
    return [F.pmod(a + b * F.lit(i), F.lit(bits)) for i in range(k)]


class Level:
    """One Bloom filter: its bits as words, made by a partially aggregated bit_or."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int):
        rate = min(rate, 0.5)
        self.k = max(1, round(-math.log2(rate)))
        self.bits = 64 * max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))
        self.seed = seed
        if self.bits > MAX_BITS:
            raise OverflowError
        rows = (
            keys.select(F.explode(F.array(*_positions(F.col("key"), seed, self.bits, self.k))).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
            .collect()
        )
        words = [0] * (self.bits // 64)
        for w, b in rows:
            words[w] = b
        self.words = folded(words)

    def test(self, key: Column) -> Column:
        hit = F.lit(True)
        for p in _positions(key, self.seed, self.bits, self.k):
            hit = hit & (F.getbit(F.element_at(self.words, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return hit


class Cascade:
    """Exact membership in listed for every key of universe (each a column key, without repeats).

    Level 1 holds the listed keys of the universe; level 2 those other keys that pass level 1; level 3 the listed
    keys that pass level 2; and so on until none is left over, so no key of the universe is
    misjudged. The first level's rate follows the sizes, so later levels are as small as the list:
    the bits grow with the list and only with the logarithm of the universe.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        listed = cut(universe.join(F.broadcast(listed), "key", "left_semi"), "listed") if listed.count() <= 100_000 else cut(universe.join(listed, "key", "left_semi"), "listed")
        others = universe
        n, u = listed.count(), universe.count()
        self.levels: list[Level] = []
        mine, theirs, made = listed, others, [listed]
        first = True
        while n and len(self.levels) < MAX_LEVELS:
            level = Level(mine, n, n / (math.sqrt(2) * max(u - n, n)) if first else 0.5, len(self.levels))
            self.levels.append(level)
            if sum(x.bits for x in self.levels) > MAX_BITS:
                raise OverflowError
            passed = theirs.where(level.test(F.col("key")))
            passed = cut(passed.join(listed, "key", "left_anti") if first else passed, "passed")
            made.append(passed)
            mine, theirs, n, first = passed, mine, passed.count(), False
        else:
            if n:
                raise OverflowError
        drop(*made)

    def test(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            # a key that stops at level k isn't of the kind that it holds
            out = F.when(self.levels[k].test(key), out).otherwise(F.lit(k % 2 == 1))
        return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url).

    A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest rule
    string wins. rule is null and the verdict is default where none fits. Null urls and urls without ://
    have an empty host and path, which no rule fits. Repeated rows and null ids stay; other columns are
    ignored; an empty table gives an empty result.

    The key universe is every host suffix + path prefix in the table of the rules' path lengths and numbers of labels, made distinct
    with partial aggregation, so a host with a third of the rows costs a row a task. A suffix of more labels than any rule's host is no key. Two cascades,
    one of the keys to block and one of those to allow, then judge each page in one scan without any
    join: a key found is itself the rule. A list whose cascade would pass MAX_BITS goes by an
    equi-join with the distinct keys instead.
    """
    spark = pages.sparkSession
    lengths, labels = sorted({len(p) for _, _, p in rules}) or [1], max((h.count(".") + 1 for _, h, _ in rules), default=1)
    base = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    base = base.select("page_id", host.alias("host"), path.alias("path"))
    base = base.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    base = base.withColumn("_keys", candidates(F.col("host"), F.col("path"), lengths, labels))
    universe = cut(base.select(F.explode("_keys").alias("key")).distinct(), "universe")  # judged pages don't read it
    chosen = {}
    for v, h, p in rules:
        chosen[h + p] = v
    sides = {v: [k for k, x in chosen.items() if x == v] for v in ("block", "allow")}
    try:
        tests = {v: Cascade(_keys(spark, keys), universe) for v, keys in sides.items() if keys}
        drop(universe)
    except OverflowError:
        drop(universe)
        return _joined(base, _keys(spark, sides["block"]).withColumn("v", F.lit("block")).unionByName(_keys(spark, sides["allow"]).withColumn("v", F.lit("allow"))), default)
    none = F.lit(None).cast("string")
    first = {v: F.get(F.filter("_keys", c.test), F.lit(0)) for v, c in tests.items()}
    out = base.select("page_id", "host", "path", first.get("block", none).alias("_b"), first.get("allow", none).alias("_a"))
    rule = F.when(F.coalesce(F.length("_b"), F.lit(-1)) > F.coalesce(F.length("_a"), F.lit(-1)), F.col("_b")).otherwise(F.col("_a"))
    verdict = F.when(rule.isNull(), F.lit(default)).when(rule == F.col("_b"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _keys(spark, keys: list[str]) -> DataFrame:
    if not keys:
        return spark.range(0).select(F.lit("").alias("key"))
    return spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.to_json(F.array(*map(F.lit, keys))), "array<string>")).alias("key"))


def _joined(base: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """The same verdicts by a join of the distinct keys with a long list."""
    best = base.select("host", "path", F.explode("_keys").alias("key")).distinct().join(listed, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key"), "key", "v")).alias("m"))
    out = base.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("m.key").alias("rule"), F.coalesce("m.v", F.lit(default)).alias("verdict"))


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, pre, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, max_by(h || pre, length(h || pre)) AS rule, max_by(v, length(h || pre)) AS v
  FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT q.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict FROM q LEFT JOIN m ON q.page_id = m.page_id
"""
