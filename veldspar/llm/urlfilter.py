"""URL verdicts by path rules and a Bloom filter cascade, with DataFrame functions only.

Rules fit a host and all its subdomains, and paths by prefix; the longest rule that fits decides. Other URLs are
blocked if their host is on the block list, a table of hosts. The list is held as a cascade of Bloom filters built over
every host of the corpus: level 0 encodes the listed hosts, level 1 the unlisted hosts that level 0 lets through, level
2 the listed hosts that level 1 lets through, and so on until a level lets nothing wrong through. A host's verdict is
the parity of the first level that rejects it, so membership is exact for every host of the corpus, and URLs are judged
without a join: each level is one constant of the expression.

A list whose cascade would have more than `MOST_BYTES` is cut, as all hosts are, into shards by a hash of the host. Each
shard has its own cascade, and URLs, written once by shard, are judged shard by shard; nothing larger than a shard's
cascade is held at once, and no shard is joined with anything.

Defined cases: a null URL, or one without ://, has an empty host and path, fits no rule and is allowed (the empty
host is never listed); null keys aren't listed; a URL of any length is judged whole; repeated rows have equal results; of
rules that fit with equal length, which only equal ones can, either decides; an empty table or list builds no level and
lists nothing; extra columns whose names clash with result columns are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, scratch_path, without

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labels of unwanted hosts: advertising, gambling, medicine and adult offers. A list of hosts can be derived by them.
LISTED_LABELS = ("spam-farm", "cheap-pills", "casino-win", "ads-track", "free-bets", "adult-x")
#: Bytes of a cascade, which is held as constants of the plan.
MOST_BYTES = 32 << 20
#: Filter bytes that come to the driver as one value.
_CHUNK = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


@dataclass
class Cascade:
    """Bloom filters as (bytes, bits, hashes) by level; exact for the keys it was built over."""

    levels: list[tuple[bytes, int, int]] = field(default_factory=list)

    def bytes(self) -> int:
        return sum(len(b) for b, _, _ in self.levels)

    def passes(self, key: Column, level: int) -> Column:
        """Whether all bits of the key are set; the lambda holds the level's only constant."""
        bits, m, k = self.levels[level]

        def lit_bit(position: Column) -> Column:
            byte = F.conv(F.hex(F.substr(F.lit(bits), F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
            return F.getbit(byte, F.pmod(position, F.lit(8)).cast("int")) == 1

        return F.forall(F.array(*_positions(key, level, m, k)), lit_bit)

    def contains(self, key: Column) -> Column:
        """True where the first level that rejects the key is an odd one, or none rejects it after an odd number of levels."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self.passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return F.coalesce(out, F.lit(False))


def _positions(key: Column, level: int, m: int, k: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(m)) for i in range(k)]


def _filter_bytes(keys: DataFrame, level: int, m: int, k: int) -> bytes:
    """The filter of a column of keys: set bits are united by byte, and bytes to chunks, before they come to the driver."""
    at = F.explode(F.array(*_positions(F.col("key"), level, m, k))).alias("p")
    bytes_ = keys.select(at).groupBy(F.shiftright("p", 3).alias("b")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("p", F.lit(8)).cast("int"))).alias("v"))
    chunks = bytes_.groupBy(F.floor(F.col("b") / _CHUNK).cast("long").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("b") % _CHUNK).cast("int").alias("i"), "v"))).alias("m"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(_CHUNK - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(0))), 2, "0"))
    size = -(-m // 8)
    out = bytearray(-(-size // _CHUNK) * _CHUNK)
    for c, value in chunks.select("c", F.unhex(F.array_join(digits, "")).alias("value")).toLocalIterator():
        out[c * _CHUNK : (c + 1) * _CHUNK] = value
    return bytes(out[:size])


def _first_rate(n_in: int, n_out: int) -> float:
    """The first level's rate of false positives: half of listed to unlisted times the square root of two, by the classic choice."""
    return min(0.5, (n_in / n_out) * math.sqrt(0.5)) if n_out else 0.5


def expected_bytes(n_in: int, n_out: int) -> int:
    """About the bytes of a cascade over so many listed and unlisted keys: the first level, and later ones that halve."""
    if not n_in:
        return 0
    rate = _first_rate(n_in, n_out)
    return math.ceil((n_in * max(1, round(math.log2(1 / rate))) + 2 * (n_out * rate + n_in / 2)) / math.log(2) / 8)


def _counts(keys: DataFrame) -> tuple[int, int]:
    counts = {r[0]: r[1] for r in keys.groupBy("listed").count().collect()}
    return counts.get(True, 0), counts.get(False, 0)


def universe(keys: DataFrame) -> DataFrame:
    """Distinct keys of the columns key and listed, written; a key is listed if any of its rows is."""
    return materialize(keys.filter("key is not null").groupBy("key").agg(F.max("listed").alias("listed")), "urls-keys")


def build(keys: DataFrame) -> Cascade:
    """A cascade over the distinct keys of universe(). Later levels have a rate of one half."""
    n_in, n_out = _counts(keys)
    cascade = Cascade()
    current, n, rest, rate = keys.filter("listed"), n_in, keys.filter("not listed"), _first_rate(n_in, n_out)
    while n:
        k = max(1, round(math.log2(1 / rate)))
        m = max(64, math.ceil(n * k / math.log(2)))
        level = len(cascade.levels)
        cascade.levels.append((_filter_bytes(current, level, m, k), m, k))
        through = materialize(rest.filter(cascade.passes(F.col("key"), level)), "urls-through")
        current, rest, n, rate = through, current, through.count(), 0.5
    return cascade


def listed_hosts(pages: DataFrame, url: str = "url", labels=LISTED_LABELS) -> DataFrame:
    """A block list (column host) derived from a table of URLs: its hosts of which any dot-separated label is in labels."""
    hosts = pages.select(host_of(F.col(url)).alias("host")).filter("host <> ''").distinct()
    return hosts.filter(F.arrays_overlap(F.split("host", r"\."), F.array(*[F.lit(x) for x in labels])))


def judge(pages: DataFrame, block_list: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per page: its id, host, path, rule, verdict and listed. block_list: a table with a column host."""
    u = F.col(url)
    parted = pages.select(F.col(page_id).alias("_vs_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    hosts = parted.select(F.col("host").alias("key"), F.lit(False).alias("listed")).distinct()
    on = block_list.select(F.col("host").alias("key"), F.lit(True).alias("listed"))
    keys = universe(hosts.unionByName(on).filter("key <> ''"))
    shards = max(1, -(-expected_bytes(*_counts(keys)) // most_bytes))

    def judged(rows: DataFrame, cascade: Cascade) -> DataFrame:
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        out = rows.withColumn("listed", cascade.contains(F.col("host")) & (F.col("host") != ""))
        return out.select(F.col("_vs_id").alias(page_id), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")

    if shards == 1:
        return judged(parted, build(keys))
    shard = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit("shard")), F.lit(shards)).cast("int")
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "urls-shards")
    parted.withColumn("shard", shard("host")).write.partitionBy("shard").parquet(path)
    whole = spark.read.schema(parted.withColumn("shard", F.lit(0)).schema).parquet(path)
    done = None
    for k in range(shards):
        part = materialize(judged(whole.filter(F.col("shard") == k).drop("shard"), build(keys.filter(shard("key") == k))), "urls-judged")
        done = part if done is None else done.unionByName(part)
    return done


ORACLE = """
with p as (
  select page_id, url, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages
), q as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p
), r as (
  select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule,
    len(list_intersect(string_split(host, '.'), ['spam-farm', 'cheap-pills', 'casino-win', 'ads-track', 'free-bets', 'adult-x'])) > 0 as listed
  from q
)
select page_id, host, path, rule,
  case rule when 'org/' then 'allow' when 'com/fr/' then 'allow' when 'example.org/es/' then 'block' when 'example.org/en/1' then 'block' when 'com/de/' then 'block'
  else case when listed then 'block' else 'allow' end end as verdict, listed
from r
"""
