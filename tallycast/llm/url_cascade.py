"""URL rules by a Bloom filter cascade: exact membership of a page's keys in the listed keys, without joins."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm.queries import query, table
from tallycast.session import materialise

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
RULE_SCHEMA = "host string, path string, verdict string"
DEFAULT = "allow"  # of an address whose keys are all proven to be unlisted
MAX_BITS = 1 << 23  # of all levels (1 MB), up to which a cascade travels in the plan; beyond it keys meet by equi-join
MAX_HASHES = 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits in 64-bit words, and how many hashes a key sets."""

    number: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def contains(self, key: Column) -> Column:
        # a constant for the optimizer, which folds it to one array before any row is read
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        found = F.lit(True)
        for at in positions(key, self.number, self.bits, self.hashes):
            word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
            found = found & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return found


def positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(number), F.lit(i)), F.lit(bits).cast("bigint")) for i in range(hashes)]


def bits_of(count: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a filter of ``count`` keys with false positives at ``rate``."""
    hashes = min(MAX_HASHES, max(1, round(math.log2(1 / rate))))
    return max(64, math.ceil(count * hashes / math.log(2) / 64) * 64), hashes


def level_of(keys: DataFrame, number: int, bits: int, hashes: int) -> Level:
    """The filter of ``keys`` (key): words are grouped ORs of bits, of which ``bits / 64`` reach the driver."""
    at = keys.select(F.explode(F.array(*positions(F.col("key"), number, bits, hashes))).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = [0] * (bits // 64)
    for word, value in at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("value")).collect():
        words[word] = value
    return Level(number, bits, hashes, tuple(words))


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int | None = None) -> list[Level] | None:
    """Levels that tell the ``listed`` keys from all others of ``universe`` (both: key), without error.

    Level 0 encodes the listed keys; each further level the keys of the other side that all levels before let through,
    until none is left: level 1 the unlisted keys of the universe that level 0 takes for listed, level 2 the listed
    keys that level 1 takes for those, and so on.  Level 0 is sized for as many false positives as balance the
    levels after it (their rate is a half).  Only keys that pass level 0 are shuffled, pre-aggregated by key.  None if
    the filters would need more than ``max_bits``.  Null keys of either side are not listed.
    """
    max_bits = MAX_BITS if max_bits is None else max_bits
    listed = materialise(listed.select("key").filter("key IS NOT NULL").distinct(), "listed")
    count = listed.count()
    if not count:
        return []
    others = universe.select(F.approx_count_distinct("key")).first()[0]
    bits, hashes = bits_of(count, min(0.5, math.sqrt(0.5) * count / max(others, 1)))
    if bits > max_bits:
        return None
    levels = [level_of(listed, 0, bits, hashes)]
    passed = universe.select("key").filter(levels[0].contains(F.col("key"))).withColumn("is_listed", F.lit(False))
    sides = passed.unionAll(listed.withColumn("is_listed", F.lit(True))).groupBy("key").agg(F.max("is_listed").alias("is_listed"))
    encoded, other = materialise(sides.filter("NOT is_listed").select("key"), "passed"), listed
    while count := encoded.count():
        bits, hashes = bits_of(count, 0.5)
        if bits + sum(level.bits for level in levels) > max_bits:
            return None
        levels.append(level_of(encoded, len(levels), bits, hashes))
        encoded, other = materialise(other.filter(levels[-1].contains(F.col("key"))), "passed"), encoded
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the first level that does not contain it decides."""
    answer = F.lit(len(levels) % 2 == 1)  # in all levels: on the side that the last one encodes
    for level in reversed(levels):
        answer = F.when(level.contains(key), answer).otherwise(F.lit(level.number % 2 == 1))
    return answer


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case) and
    ``path`` (from there up to ``?``, ``#`` or the end); both are empty without ``://`` and for a null address."""
    start = F.instr(F.col(url), "://")
    rest = F.when(start > 0, F.substring(F.col(url), start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return pages.withColumn("host", ascii_lower(host)).withColumn("path", path)


def rule_keys(rules: DataFrame) -> DataFrame:
    """``(key, labels, chars, blocks)``: one row per different host and path; blocking wins over allowing.

    A path neither empty nor starting with ``/`` and a host with ``/``, ``?`` or ``#`` fit no address and are left out.
    """
    named = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        (~F.col("verdict").eqNullSafe("allow")).alias("blocks"),
    ).filter("(path = '' OR startswith(path, '/')) AND NOT host RLIKE '[/?#]'")
    labels = (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels")
    return named.groupBy(F.concat("host", "path").alias("key"), labels, F.length("path").alias("chars")).agg(F.max("blocks").alias("blocks"))


def candidate_keys(shapes: list[tuple[int, int]]) -> Column:
    """Structs (key, labels): an address's last labels and first characters of its path, in each shape that a rule has."""
    every = F.from_json(F.lit("[" + ",".join(f'{{"labels":{a},"chars":{b}}}' for a, b in shapes) + "]"), "array<struct<labels:int,chars:int>>")
    owned = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    fitting = F.filter(every, lambda s: (s["labels"] <= owned) & (s["chars"] <= F.length("path")))

    def key(s: Column) -> Column:
        tail = F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"])
        return F.struct(F.concat(tail, F.substring(F.col("path"), F.lit(1), s["chars"])).alias("key"), s["labels"].alias("labels"))

    return F.transform(fitting, key)


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, max_bits: int | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages`` (page_id, url), under ``rules``
    (host, path, verdict): a rule fits its host and all subdomains where the address's path starts with its path.

    The listed keys are host and path of the rules; the universe is every key that an address of ``pages`` can
    offer in a shape (labels of the host, characters of the path) that some rule has.  One cascade tells which
    keys are rules, a second one which of the rules block, so pages are judged in place: two scans of the
    addresses build the filters, a third one applies them.  The longest rule wins, of equally long ones the one with
    more labels; of two verdicts for the same host and path, block.  Without a rule the keys are proven to be
    unlisted and ``rule`` is null, ``verdict`` the ``default``.  Null addresses and those without ``://`` have empty host and
    path; null ids are passed on, repeated rows stay, other columns are not read, no pages give no rows, no
    rules the default.  Shapes go through the driver: they grow with the rules' lengths, not with rules or pages.
    If the filters would exceed ``max_bits``, keys of the pages meet the rules by an equi-join instead.
    """
    addresses = with_host_and_path(pages.select("page_id", "url")).drop("url")
    keyed = materialise(rule_keys(rules), "rules")
    shapes = sorted(tuple(r) for r in keyed.select("labels", "chars").distinct().collect())
    if not shapes:
        return addresses.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    universe = addresses.select(F.explode(candidate_keys(shapes)).alias("c")).select("c.key")
    rules_cascade = build_cascade(keyed, universe, max_bits)
    blocks_cascade = build_cascade(keyed.filter("blocks"), keyed, max_bits) if rules_cascade is not None else None
    if rules_cascade is None or blocks_cascade is None:
        return _verdicts_by_join(addresses, keyed, shapes, default)
    found = F.filter(candidate_keys(shapes), lambda c: is_listed(c["key"], rules_cascade))
    longest = F.array_max(F.transform(found, lambda c: F.struct(F.length(c["key"]).alias("length"), c["labels"], c["key"])))
    verdict = F.when(F.col("rule").isNull(), default).when(is_listed(F.col("rule"), blocks_cascade), "block").otherwise("allow")
    return addresses.withColumn("rule", longest["key"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _verdicts_by_join(addresses: DataFrame, keyed: DataFrame, shapes: list[tuple[int, int]], default: str) -> DataFrame:
    """The same by equi-joins, for lists too long for the plan; each different host and path is looked up once."""
    different = addresses.select("host", "path").distinct().withColumn("c", F.explode(candidate_keys(shapes)))
    hits = different.join(keyed, different["c.key"] == keyed["key"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("length"), "labels", "key", "blocks")).alias("best"))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.blocks"), "block").otherwise("allow")
    return addresses.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


OP11_SQL = f"""
WITH parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM parts),
named AS (SELECT page_id, translate(host, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM hosts),
rules(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)})
SELECT page_id, host, path,
  (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1), '{DEFAULT}') AS verdict
FROM named
"""


@query("op11_url_cascade", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), default_rules(spark))
