"""URL rules answered by a Bloom filter cascade instead of a join.

A rule is a host and a path prefix; its key is both in one string (``example.org/en/``). The keys that could match a
url are each suffix of its host that begins at a label, with each prefix of its path that is as long as some rule's
path. The corpus's key universe is all of those of all urls. Level 1 of a cascade encodes the listed keys; level 2
encodes the keys of the universe that level 1 takes for listed but aren't; level 3 the listed keys that level 2 takes
for those; and so on until nothing is taken wrongly. Over that universe membership is then exact, and it is read from a
few bit arrays inside the scan. Allowed and blocked keys have a cascade each.

A cascade has about ``1.44 * log2(universe / listed)`` bits and a few more for each listed key: its size is bounded by
the rule list, which is why it may be part of the plan. All of it is DataFrame expressions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import settled

#: The rules of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substr(_url, instr(_url, '://') + 3)"))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^(?s)([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(_url, instr(_url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^(?s)[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: Sequence[int], most_labels: int) -> Column:
    """Keys that could match, those of the longest host and then the longest path first. No rule's host has more than
    ``most_labels`` labels, so no longer suffix of a host is built."""
    last = F.substring_index(host, ".", -most_labels)
    hosts = F.array(*[F.substring_index(last, ".", -k) for k in range(most_labels, 0, -1)])
    hosts = F.array_distinct(hosts)  # a host of fewer labels comes out whole several times
    paths = F.filter(F.array(*[F.lit(n) for n in sorted(set(lengths), reverse=True)]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda n: F.concat(h, path.substr(F.lit(1), n)))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


class BloomLevel:
    """A bit array of ``bits`` bits with ``hashes`` positions a key, held as 64-bit words."""

    def __init__(self, level: int, bits: int, hashes: int, words: list[int]):
        self.level, self.bits, self.hashes, self.words = level, bits, hashes, words

    @staticmethod
    def positions(key: Column, level: int, bits: int, hashes: int) -> Column:
        return F.array(*[F.pmod(F.xxhash64(F.lit(level * 64 + i), key), F.lit(bits)) for i in range(hashes)])

    @classmethod
    def over(cls, keys: DataFrame, level: int, rate: float) -> BloomLevel:
        """A filter of the distinct ``key`` rows with about ``rate`` false positives. The job returns its words to the
        driver: ``-log2(rate) * 1.44`` bits for each key."""
        n = max(1, keys.count())
        bits = 64 * max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
        hashes = max(1, round(-math.log2(rate)))
        at = keys.select(F.explode(cls.positions(F.col("key"), level, bits, hashes)).alias("p"))
        words = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("x")).collect()
        out = [0] * (bits // 64)
        for r in words:
            out[r["w"]] = r["x"]
        return cls(level, bits, hashes, out)

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to one constant
        test = F.lit(True)
        for i in range(self.hashes):
            p = F.pmod(F.xxhash64(F.lit(self.level * 64 + i), key), F.lit(self.bits))
            bit = F.get(words, F.floor(p / 64).cast("int")).bitwiseAND(
                F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int")))
            test = test & (bit != 0)
        return test


class Cascade:
    """Exact membership in ``listed`` (distinct ``key``) for every key of ``universe``."""

    def __init__(self, listed: DataFrame, universe: DataFrame, deep_rate: float = 0.5):
        """``universe``: column ``key``, repeats allowed. Level 1 is as fine as the ratio of both sizes asks, so that
        about as many keys are taken wrongly as are listed; deeper levels halve what is left."""
        self.levels: list[BloomLevel] = []
        self.n_listed = listed.count()
        if not self.n_listed:
            return
        n = universe.agg(F.approx_count_distinct("key")).first()[0]
        rate = min(deep_rate, max(2.0 ** -30, self.n_listed / max(n, 1) / math.sqrt(2)))
        self.levels.append(BloomLevel.over(listed, 1, rate))
        inside = listed
        wrong = settled(universe.filter(self.levels[0].holds(F.col("key"))).distinct()
                        .join(listed, "key", "left_anti"))
        while not wrong.isEmpty():
            level = BloomLevel.over(wrong, len(self.levels) + 1, deep_rate)
            self.levels.append(level)
            # what this level must not hold, but does
            inside, wrong = wrong, settled(inside.filter(level.holds(F.col("key"))))

    def holds(self, key: Column) -> Column:
        """Listed if the first level that doesn't hold the key is an even one, or none and their number is odd."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.holds(key), answer).otherwise(F.lit(level.level % 2 == 0))
        return answer


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    text = json.dumps([{"host": h, "path": p, "verdict": v} for h, p, v in rules])
    rows = F.explode(F.from_json(F.lit(text), "array<struct<host:string,path:string,verdict:string>>"))
    return spark.range(1).select(rows.alias("r")).select("r.*")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule`` (the longest that fits: longest host, then longest
    path; null if none) and ``verdict``: the rule's, or ``default`` for a url whose keys no cascade holds.

    Null urls and urls without ``://`` have an empty host and path and fit no rule, as does a url with an empty host.
    A key listed with both verdicts blocks. Repeated pages are judged alike; an empty table gives no rows; other
    columns are not read. Rules need a path that begins with ``/``. Hosts may have any number of labels.
    """
    rules = settled(rules.select(F.concat("host", "path").alias("key"), F.length("path").alias("n"),
                                 F.size(F.split("host", r"\.", -1)).alias("labels"), "verdict").distinct())
    lengths = [r["n"] for r in rules.select("n").distinct().collect()]  # at most the longest rule path
    most_labels = rules.agg(F.max("labels")).first()[0] or 1
    urls = (pages.select("page_id", F.col("url").alias("_url"))
            .select("page_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path")))
    keyed = urls.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths, most_labels))
    universe = keyed.select(F.explode("_keys").alias("key"))
    blocked, allowed = (Cascade(rules.filter(F.col("verdict") == v).select("key").distinct(), universe)
                        for v in ("block", "allow"))
    hit = F.filter("_keys", lambda k: blocked.holds(k) | allowed.holds(k))
    return (keyed.select("page_id", "host", "path", F.get(hit, F.lit(0)).alias("rule"))
            .withColumn("verdict", F.when(F.col("rule").isNull(), F.lit(default))
                        .when(blocked.holds(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest
           FROM pages),
h AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
      ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT h.*, rhost || rpath AS rule, rverdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC) AS k
      FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE k = 1
"""
