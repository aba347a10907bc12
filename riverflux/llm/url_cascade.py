"""URL rules decided by a cascade of Bloom filters, without joins.

A rule is a host (which stands for all its subdomains) and a path prefix. The keys of a url are all
pairs of a suffix of its host and a prefix of its path that has the length of some rule's path. The
corpus's distinct keys are the complete universe: level 1 holds the listed keys, level 2 the
universe's keys that level 1 accepts wrongly, level 3 the listed keys that level 2 accepts, and so
on, until a level accepts nothing wrongly. A key's first refusing level then tells exactly whether
it is listed. The levels are arrays of longs that every task gets as one constant; their size
follows the number of listed keys, as the first level's rate of false positives is chosen to leave
about as many keys as are listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverflux.llm.common import ascii_lower, bit, has_bit, let, long_array, materialize

#: (host, path prefix, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
MAX_LEVELS = 40
#: Largest level in bits, and bits for each key and hash function. Where the listed keys alone need more, they are joined.
MAX_BITS = 1 << 25
BITS = 1.45


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """All possible rules host + path prefix that fit, the longest first; none without a host.

    depths: how many labels the rules' hosts have; lengths: how long the rules' paths are."""

    def of(labels: Column) -> Column:
        suffixes = F.filter(F.array(*[F.when(F.size(labels) >= n, F.concat_ws(".", F.slice(labels, -n, n))) for n in depths]), lambda h: h.isNotNull())
        prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
        return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))

    found = F.when(host == "", F.array().cast("array<string>")).otherwise(let(F.split(host, r"\."), of))
    return F.transform(
        F.array_sort(F.transform(found, lambda k: F.struct((-F.length(k)).alias("n"), (-F.locate("/", k)).alias("h"), k.alias("k")))),
        lambda s: s["k"],
    )


def bit_at(key: Column, salt: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(bits))


class Level:
    """One Bloom filter: k hash functions over an array of longs."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int):
        # a large level has fewer hash functions, which leaves more to the next one
        self.k = max(1, min(round(-math.log2(rate)), int(MAX_BITS / (BITS * max(n, 1)))))
        self.bits = 64 * max(1, math.ceil(BITS * max(n, 1) * self.k / 64))
        self.salts = [seed * 64 + i for i in range(self.k)]
        at = keys.select(F.explode(F.array(*[bit_at(F.col("key"), s, self.bits) for s in self.salts])).alias("at"))
        words = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(bit(F.col("at"))).alias("ones"))
        values = [0] * (self.bits // 64)
        for row in words.collect():  # at most bits / 64 rows, bounded by MAX_BITS
            values[row.word] = row.ones
        self.words = long_array(values)

    def accepts(self, key: Column) -> Column:
        test = F.lit(True)
        for s in self.salts:
            test = test & has_bit(self.words, bit_at(key, s, self.bits))
        return test


def listed(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that refuses it decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].accepts(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def build_cascade(universe: DataFrame, rules: DataFrame) -> list[Level]:
    """Levels that are exact for every key in universe or rules (both: column key, distinct)."""
    inside, n_in = rules, rules.count()
    outside = universe.join(rules, "key", "left_anti")
    n_out = max(1, universe.count())
    levels: list[Level] = []
    while n_in:
        rate = min(0.5, max(1e-6, n_in / n_out)) if not levels else 0.5
        levels.append(Level(inside, n_in, rate, len(levels)))
        wrong = materialize(outside.where(levels[-1].accepts(F.col("key"))))
        inside, outside, n_in = wrong, inside, wrong.count()
        if len(levels) > MAX_LEVELS:
            raise RuntimeError("the cascade does not converge: two keys agree in all hash values")
    return levels


def judge_urls(pages: DataFrame, rules=RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names are replaced).

    The longest rule that fits wins, of two equally long ones that with the longer host. Without a
    fitting rule, and so for null, empty or malformed urls, the rule is null and the verdict the
    cascade's answer "not listed": default. Repeated rows are judged alike; no rules or no pages are
    fine. Rules: a list of (host, path prefix, verdict) or a table of host, path and verdict; of several verdicts for
    one host and path block holds. Which of them block is told by a second cascade, over the listed keys. More rules than a
    level can hold (some 20 million) are joined instead.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")
    rules = materialize(rules.select("host", "path", F.concat("host", "path").alias("key"), (F.col("verdict") == "block").alias("blocks")))
    rows = materialize(rules.groupBy("key").agg(F.max("blocks").alias("blocks")))
    depths = sorted(r.n for r in rules.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect())  # a few numbers
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect())
    parts = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    if not depths:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = keys_of(F.col("host"), F.col("path"), depths, lengths)
    universe = materialize(parts.select("host", F.substring("path", 1, max(lengths)).alias("path")).distinct().select(F.explode(keys).alias("key")).distinct())
    if rows.count() * BITS > MAX_BITS:
        return by_join(parts, keys, rows, max(lengths), default)
    levels = build_cascade(universe, rows.select("key"))
    parts = parts.withColumn("rule", F.try_element_at(F.filter(keys, lambda k: listed(levels, k)), F.lit(1)))
    blocked = listed(build_cascade(rows.select("key"), rows.where("blocks").select("key")), F.col("rule"))
    return parts.withColumn("verdict", F.when(F.col("rule").isNull(), F.lit(default)).when(blocked, F.lit("block")).otherwise(F.lit("allow")))


def by_join(parts: DataFrame, keys: Column, rows: DataFrame, longest: int, default: str) -> DataFrame:
    """The same by a join of the distinct keys with the rules, and one of the pages with what is found for their place."""
    place = F.struct("host", F.substring("path", 1, longest).alias("path"))
    each = parts.select(place.alias("place"), keys.alias("keys")).distinct().select("place", F.posexplode("keys").alias("at", "key"))
    best = each.join(rows.select("key", "blocks"), "key").groupBy("place").agg(F.min(F.struct("at", "key", "blocks")).alias("best"))
    found = parts.withColumn("rule", place).join(best, F.col("rule") == F.col("place"), "left")
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.blocks"), F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumns({"rule": F.col("best.key"), "verdict": verdict}).drop("place", "best")


def op10_url_cascade(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, hit.rule AS rule, coalesce(hit.v, 'allow') AS verdict
FROM p LEFT JOIN hit ON p.page_id = hit.page_id
"""
