"""URL filtering: host and path rules over an exact Bloom filter cascade.

The cascade follows Larisch et al. (CRLite, 2017): level 1 encodes the listed keys; level 2 the unlisted keys of the
corpus that level 1 lets through; level 3 the listed keys that level 2 lets through; and so on until no key passes
wrongly. Over the universe it was built for, the first level that rejects a key tells exactly whether it is listed,
and the test is a projection: no join, no shuffle. Everything is DataFrame functions.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and, unless the empty
key is listed, is allowed. Empty universes or lists give a cascade without levels: nothing is listed. Repeated
keys count once. Other columns of the input pass through; ``page_id`` may be null or repeated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import ascii_lower, materialise, release

#: Rules of the production query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Bits in a page of the filter: what ``bitmap_construct_agg`` gathers in one binary value.
PAGE_BITS = 32768


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later branches win: the longest goes on last
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Cascade:
    """Filter levels, first to last: bits and hash functions of each, and its bits."""

    levels: list[tuple[int, int]] = field(default_factory=list)  # (bits, hashes)
    words: list[bytes] = field(default_factory=list)

    def size_bytes(self) -> int:
        return sum(map(len, self.words))

    def listed(self, key: Column) -> Column:
        """Whether the key is listed; exact for keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            out = F.when(passes(key, depth, *self.levels[depth - 1], F.lit(self.words[depth - 1])), out).otherwise(F.lit(depth % 2 == 0))
        return out


def positions(key: Column, depth: int, bits: int, hashes: int) -> list[Column]:
    """Bit positions by double hashing, seeded by the level: what collides at one level doesn't at the next."""
    h1 = F.pmod(F.xxhash64(F.lit(depth), key), F.lit(bits))
    h2 = F.pmod(F.xxhash64(key, F.lit(-depth)), F.lit(bits - 1)) + 1
    return [F.pmod(h1 + F.lit(i) * h2, F.lit(bits)) for i in range(hashes)]


def passes(key: Column, depth: int, bits: int, hashes: int, filled: Column) -> Column:
    """Whether all of the key's bits are set in the filter, a binary with bit p in byte p div 8."""
    out = F.lit(True)
    for p in positions(key, depth, bits, hashes):
        byte = F.conv(F.hex(F.substring(filled, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.call_function("shiftright", byte, F.pmod(p, F.lit(8)).cast("int")).bitwiseAND(1) == 1)
    return out


def fill(keys: DataFrame, depth: int, bits: int, hashes: int) -> bytes:
    """The Bloom filter of ``keys.key``: bit pages are or-ed on the executors, and the pages come to the driver."""
    at = keys.select(F.explode(F.array(*positions(F.col("key"), depth, bits, hashes))).alias("p"))
    pages = at.groupBy(F.expr(f"p div {PAGE_BITS}").alias("page")).agg(F.expr(f"bitmap_construct_agg(p % {PAGE_BITS})").alias("b"))
    out = bytearray(math.ceil(bits / PAGE_BITS) * PAGE_BITS // 8)
    for r in pages.toLocalIterator():
        out[r["page"] * PAGE_BITS // 8 : (r["page"] + 1) * PAGE_BITS // 8] = r["b"]
    return bytes(out)


def build_cascade(universe: DataFrame, hashes: int = 6, most_bytes: int = 64 << 20) -> Cascade:
    """A cascade from ``universe``, rows (key string, listed boolean); a key with any listed row is listed.

    Levels get ``hashes`` hash functions and the bits that make a false positive one in 2 ** hashes (8.7 bits a key for
    six), so what is left shrinks by that factor at every second level. ``most_bytes`` bounds the filters, which the
    driver holds and sends with each task: more listed keys than fit (60 million in 64 MB) raise ValueError; split
    the keys by a hash then, one cascade each (``with_listed``).
    """
    keys = materialise(universe.groupBy("key").agg(F.max("listed").alias("listed")), "url-keys")
    cascade, depth = Cascade(), 0
    encode = keys.where("listed").select("key")
    other = keys.where("not listed").select("key")
    tables, n = [keys], encode.count()
    while n:
        depth += 1
        bits = max(64, math.ceil(n * hashes / math.log(2)))
        if cascade.size_bytes() + bits // 8 > most_bytes:
            raise ValueError(f"the cascade needs more than {most_bytes} bytes; use with_listed with more shards")
        word = fill(encode, depth, bits, hashes)
        cascade.levels.append((bits, hashes))
        cascade.words.append(word)
        wrong = materialise(other.where(passes(F.col("key"), depth, bits, hashes, F.lit(word))), f"url-level-{depth}")
        tables.append(wrong)
        encode, other, n = wrong, encode, wrong.count()
    for t in tables:
        release(t)
    return cascade


def shards_for(listed: int, hashes: int = 6, most_bytes: int = 64 << 20) -> int:
    """How many cascades so many listed keys need; a quarter more than the first level takes is left for the others."""
    return max(1, math.ceil(1.25 * listed * hashes / math.log(2) / 8 / most_bytes))


def with_listed(df: DataFrame, key: Column, universe: DataFrame, shards: int | None = None, hashes: int = 6, most_bytes: int = 64 << 20, name: str = "listed") -> DataFrame:
    """Adds whether the key is listed, by the cascade of ``universe``, rows (key, listed), which holds all keys of ``df``.

    Keys that one cascade can't hold are dealt to hash shards: a shard's cascade is built, judges its rows, which go
    to a table, and is dropped before the next one, so the driver holds one at a time.
    """
    if shards is None:
        shards = shards_for(universe.where("listed").select("key").distinct().count(), hashes, most_bytes)
    if shards == 1:
        return df.withColumn(name, build_cascade(universe, hashes, most_bytes).listed(key))
    own, out = F.pmod(F.xxhash64(key), F.lit(shards)), None
    for s in range(shards):
        cascade = build_cascade(universe.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == s), hashes, most_bytes)
        part = materialise(df.where(own == s).withColumn(name, cascade.listed(key)), "url-judged")
        out = part if out is None else out.union(part)
    return out


def judge(pages: DataFrame, listed_url: Column, rules=RULES, shards: int | None = None, hashes: int = 6) -> DataFrame:
    """Adds host, path, rule, listed and verdict to ``pages``.

    ``listed_url`` says which rows put their key (host and path) on the block list. The verdict is that of the longest
    rule that fits, else block for listed keys and allow for the rest. ``shards``: by the number of listed keys if not given.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "listed", "verdict")]
    at = pages.select(*own, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(listed_url, F.lit(False)).alias("_lists"))
    key = F.concat("host", "path")
    universe = at.select(key.alias("key"), F.col("_lists").alias("listed"))
    out = with_listed(at.drop("_lists").withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)), key, universe, shards, hashes)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(*own, "host", "path", F.col("_rule.rule").alias("rule"), "listed", verdict.alias("verdict"))


#: The production list: addresses that a campaign link (a utm_ parameter) leads to.
CAMPAIGN = r"[?&]utm_[a-z]+="


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, F.col("url").rlike(CAMPAIGN)).drop("url")


ORACLE = """
WITH p AS (
  SELECT page_id, regexp_matches(url, '[?&]utm_[a-z]+=') AS lists,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
l AS (SELECT host || path AS key, bool_or(coalesce(lists, false)) AS listed FROM p GROUP BY 1),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, s, v)),
m AS (
  SELECT p.page_id, p.host, p.path, l.listed,
    (SELECT max_by(h || s, length(h || s)) FROM r WHERE (p.host = h OR p.host LIKE '%.' || h) AND starts_with(p.path, s)) AS rule
  FROM p JOIN l ON l.key = p.host || p.path)
SELECT page_id, host, path, rule, listed,
  coalesce((SELECT v FROM r WHERE h || s = m.rule), CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""
