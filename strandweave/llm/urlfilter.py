"""URL filtering by rules and by a list of URLs.

The list is canonicalised and written into a blocked Bloom filter: a table of
64-bit blocks in which each URL sets ``PROBES`` bits of one block.  Pages probe
the one block their hash names.  Those that the filter rejects are done; only possible
hits go on to the exact hash join with the list, which removes the false positives.
The pages' URLs are read once for each of the two parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm._common import cut, lower_ascii

#: Bits that one URL sets in its block.
PROBES = 4
#: URLs to a block of 64 bits, about 1.5 % false positives.
PER_BLOCK = 5
#: Largest filter (in blocks of 16 bytes with their key) that is broadcast; beyond it the probe is a shuffled join.
BROADCAST_BLOCKS = 1 << 20
#: Tasks over which the pages that probe one block are dealt where that join is shuffled.
SALTS = 8
#: Query parameters that do not change what a URL names.
TRACKING = ("utm_", "ref=")
#: Rules as (host, path prefix, verdict).
DEFAULT_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Labels that name a junk category, as hosts bear them.
JUNK_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without a closing slash, then the sorted query without
    tracking parameters; scheme and fragment go.  Null without ``://``."""
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    keep = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith(TRACKING[0]) & ~p.startswith(TRACKING[1])))
    rest = F.when(F.size(keep) > 0, F.concat(F.lit("?"), F.array_join(keep, "&"))).otherwise(F.lit(""))
    return F.when(_after_scheme(url).isNotNull(), F.concat(host_of(url), path, rest))


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = DEFAULT_RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _bits(key: Column) -> Column:
    """The ``PROBES`` bits of a URL, 6 hash bits to each."""
    salt = F.xxhash64(F.lit(7), key)
    mask = F.lit(0).cast("bigint")
    for k in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(salt, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("bigint")


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter's non-empty blocks as (block, mask)."""
    return listed.groupBy(_block(F.col(key), blocks).alias("_sw_block")).agg(F.bit_or(_bits(F.col(key))).alias("_sw_mask"))


def _dealt_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join of rows whose keys may repeat without limit with a table of different keys, which is copied for each of ``SALTS`` parts of them."""
    dealt = left.withColumn("_sw_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    copied = right.withColumn("_sw_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, (dealt[left_key] == copied[right_key]) & (dealt["_sw_salt"] == copied["_sw_copy"]), "left").drop("_sw_salt", "_sw_copy")


def listed_hits(pages: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with boolean ``is_listed``: whether the canonical URL is in ``listed.url``.

    Null URLs and URLs without ``://`` are never listed, and take part in no join; the pages
    of one URL are dealt over several tasks to probe the filter.  Rows of ``listed`` may repeat.  Of clashing names, ``is_listed`` made here wins.
    """
    keys = cut(listed.select(canonical(F.col("url")).alias("_sw_listed")).where(F.col("_sw_listed").isNotNull()).distinct())
    count = keys.count()
    blocks = max(1, -(-count // PER_BLOCK))
    filt = bloom_blocks(keys, "_sw_listed", blocks)
    keyed = pages.drop("is_listed").withColumn("_sw_key", canonical(F.col(url_col)))
    names = [F.col(c) for c in pages.columns if c != "is_listed"]
    outside = keyed.where(F.col("_sw_key").isNull()).select(*names, F.lit(False).alias("is_listed"))
    probe = keyed.where(F.col("_sw_key").isNotNull()).withColumn("_sw_probe", _block(F.col("_sw_key"), blocks))
    if blocks <= BROADCAST_BLOCKS:
        probe = probe.join(F.broadcast(filt), probe["_sw_probe"] == filt["_sw_block"], "left")
    else:
        probe = _dealt_join(probe, filt, "_sw_probe", "_sw_block")
    mask = F.col("_sw_mask").bitwiseAND(_bits(F.col("_sw_key")))
    probe = probe.withColumn("_sw_maybe", F.coalesce(mask == _bits(F.col("_sw_key")), F.lit(False)))
    rejected = probe.where(~F.col("_sw_maybe")).select(*names, F.lit(False).alias("is_listed"))
    possible = probe.where("_sw_maybe")
    # A shuffled left join whose left side is skewed is split by adaptive execution.
    exact = possible.join(keys, possible["_sw_key"] == keys["_sw_listed"], "left")
    return outside.unionByName(rejected).unionByName(exact.select(*names, F.col("_sw_listed").isNotNull().alias("is_listed")))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = DEFAULT_RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``is_listed``.

    The verdict is the longest fitting rule's; without one, listed URLs are
    blocked and all others allowed (null URLs too).  Of clashing names, the
    columns made here win.
    """
    made = ("host", "path", "rule", "verdict", "is_listed")
    marked = listed_hits(pages.drop(*[c for c in made if c != url_col]), listed, url_col)
    parts = marked.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    parts = parts.withColumn("_sw_rule", match_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_sw_rule.verdict"), F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow")))
    return parts.withColumn("rule", F.col("_sw_rule.rule")).withColumn("verdict", verdict).drop("_sw_rule")


def listed_by_label(pages: DataFrame, labels: tuple[str, ...] = JUNK_LABELS, url_col: str = "url") -> DataFrame:
    """A list made from the pages themselves: URLs of hosts with one of ``labels`` among their labels."""
    labelled = F.arrays_overlap(F.split(host_of(F.col(url_col)), "[.]"), F.array(*[F.lit(x) for x in labels]))
    return pages.where(labelled).select(F.col(url_col).alias("url"))


def listed_by_digest(pages: DataFrame, digits: tuple[str, ...] = ("7",), url_col: str = "url") -> DataFrame:
    """A list that no rule on hosts implies: canonical URLs whose MD5 begins with one of ``digits``."""
    return pages.where(F.substring(F.md5(canonical(F.col(url_col)).cast("binary")), 1, 1).isin(*digits)).select(F.col(url_col).alias("url"))
