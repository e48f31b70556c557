"""URL filters: a blocked Bloom filter before an exact hash join.

A list has rules (host, path, verdict), which fit a host with all its subdomains and every path that starts with the
rule's, and single URLs, named by their canonical form. Each list entry is one key. Eight bits of a key, one in each
word of a 512-bit block, go into the filter; a URL's own keys (its canonical form; its host's suffixes times its path's
prefixes) are tried against their blocks, and only those that may be listed are joined with the list by the key itself,
which removes the false positives. The longest rule that fits decides, else a listed URL is blocked, else allowed.

The filter is a table of at most MAX_BLOCKS rows of 64 bytes, so it may be broadcast whatever the list's size; a list
that overfills it costs more rows in the exact join, never a wrong verdict. What passes is counted by key first, only
entries that are met go on, and they meet the URLs in SALTS copies, so a rule that fits a third of all URLs isn't one
task's.

Canonical form: host in lower case without www., the scheme's own port and user names; path without the slashes at its
end; parameters in order, without those of TRACKING; no scheme, no fragment.

Defined results: a null URL or one without :// has an empty host and path, no rule, and is allowed; null ids and
repeated rows are kept, each judged by itself; an empty table gives no rows, an empty list allows all; equal rules of
different verdicts block; of rules of equal length the one with the longer host decides; URLs of any length are tried
whole, with as many host suffixes and path prefixes as the longest rule has. Columns other than page_id and url aren't
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.llm.common import stage

#: Rows of the broadcast filter at most (64 bytes of bits each), bits aimed at for an entry, copies of an entry in the exact join.
MAX_BLOCKS = 1 << 16
BITS = 16
SALTS = 16
_WORDS = 8

# Parameters that name a visit, not a page.
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid", "session", "sid")
#: Rules as host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Host names whose pages the query lists.
LISTED_NAMES = ("cheap-pills", "casino-win", "free-bets", "adult-x", "spam-farm", "ads-track")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a URL; all empty for null or where :// is missing."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*+", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1), F.regexp_extract(rest, r"^[^?#]*+\?([^#]*+)", 1)


def canonical(url: Column) -> Column:
    host, path, query = host_and_path(url)
    port = F.when(F.lower(F.substring(url, 1, 6)) == "https:", ":443$").otherwise(":80$")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*+@", ""), port, ""), r"^www\.(?=.)", "")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{'|'.join(TRACKING)})(?:=|$)"))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, F.regexp_replace(path, "/++$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """key, rule (null for single URLs), length of host and verdict of each entry, each key once."""
    bad = rules.where("path IS NULL OR host IS NULL OR host = '' OR NOT startswith(path, '/') OR NOT endswith(path, '/')").first()
    if bad:
        raise ValueError(f"a rule needs a host and a path that starts and ends with a slash: {bad}")
    rule = F.concat("host", "path")
    of_rules = rules.select(F.concat(F.lit("p"), rule).alias("key"), rule.alias("rule"), F.length("host").alias("host_length"), "verdict")
    of_urls = listed.where("url IS NOT NULL").select(F.concat(F.lit("u"), canonical(F.col("url"))).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("host_length"), F.lit("block").alias("verdict"))
    return of_rules.unionByName(of_urls).groupBy("key").agg(F.first("rule").alias("rule"), F.first("host_length").alias("host_length"), F.max("verdict").alias("verdict"))


def place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bit in each of the block's words."""
    other = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [bit(i) for i in range(_WORDS)]


def filter_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter: block and its words, for blocks that hold a key."""
    block, bits = place(F.col("key"), blocks)
    return listed.select(block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def keys_of(host: Column, path: Column, named: Column, labels: int, parts: int) -> Column:
    """All keys under which a URL may be listed: suffixes of up to `labels` names, prefixes of up to `parts` slashes."""
    names, steps = F.split(host, r"\.", -1), F.split(path, "/", -1)
    none = F.expr("cast(array() as array<int>)")
    upto = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(none)
    suffixes = F.transform(upto(F.when(host == "", 0).otherwise(F.least(F.size(names), F.lit(labels)))), lambda k: F.array_join(F.slice(names, F.size(names) - k + 1, k), "."))
    prefixes = F.transform(upto(F.least(F.size(steps) - 1, F.lit(parts))), lambda k: F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/")))
    return F.concat(F.array(F.concat(F.lit("u"), named)), F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("p"), s, p)))))


def may_be_listed(tries: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """The tries (uid, key) whose bits are all set in the filter."""
    block, bits = place(F.col("key"), blocks)
    held = F.broadcast(filter_blocks(listed, blocks))  # at most MAX_BLOCKS rows
    hit = F.col("t.block") == F.col("f.block")
    for i in range(_WORDS):
        hit = hit & (F.col(f"f.w{i}").bitwiseAND(F.col(f"t.b{i}")) != 0)
    tried = tries.select("uid", "key", block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    return tried.alias("t").join(held.alias("f"), hit).select("t.uid", "t.key")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and url_listed (whether the canonical URL is on the list) of every page."""
    known = stage(entries(rules, listed), "url-list")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rule").isNotNull(), F.size(F.split(F.regexp_extract("rule", "^[^/]*", 0), r"\.")))).alias("labels"), F.max(F.when(F.col("rule").isNotNull(), F.size(F.split("rule", "/")) - 1)).alias("parts")).first()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 64 * _WORDS < size.n * BITS:
        blocks *= 2

    host, path, _ = host_and_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), "page_id", host.alias("host"), path.alias("path"), F.coalesce(canonical(F.col("url")), F.lit("")).alias("named"))
    rows = stage(rows, "urls")  # uid must not change
    tries = rows.select("uid", F.explode(keys_of(F.col("host"), F.col("path"), F.col("named"), size.labels or 0, size.parts or 0)).alias("key"))
    passed = may_be_listed(tries, known, blocks)
    met = known.join(passed.select("key").distinct(), "key")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hits = passed.withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int")).join(met.select("*", salts), ["key", "salt"])
    by_rule = F.col("rule").isNotNull()
    best = hits.groupBy("uid").agg(F.max(F.when(by_rule, F.struct(F.length("rule").alias("length"), "host_length", "rule", "verdict"))).alias("best"), F.max(~by_rule).alias("url_listed"))
    out = rows.select("uid", "page_id", "host", "path").join(best, "uid", "left")
    found = F.coalesce("url_listed", F.lit(False))
    verdict = F.coalesce(F.col("best.verdict"), F.when(found, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), found.alias("url_listed"))


def named_hosts(pages: DataFrame, names: tuple[str, ...] = LISTED_NAMES) -> DataFrame:
    """url of the pages that have one of the names in their host: a list that grows with the pages."""
    host, _, _ = host_and_path(F.col("url"))
    return pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, names)))).select("url")


def rule_table(spark, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
