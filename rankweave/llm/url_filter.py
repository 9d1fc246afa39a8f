"""URL verdicts: host and path rules, then a list behind a blocked Bloom filter. SQL functions only."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh

#: a block is eight 64-bit words; a key sets one bit in each
WORDS = 8
BITS_PER_KEY = 16
#: filters up to this many blocks (72 bytes each, 19 MB) are broadcast, larger ones are joined
BROADCAST_BLOCKS = 1 << 18


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and for paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @staticmethod
    def parse(verdict: str, text: str) -> Rule:
        at = text.index("/")
        return Rule(verdict, text[:at], text[at:])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def canonical(url: Column) -> Column:
    """Host without `www.` and path without closing slashes, with the query but for `utm_` parts.

    Scheme and fragment go. Null where there is no host.
    """
    host, path = host_and_path(url)
    host = F.regexp_replace(host, r"^www\.", "")
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_")))
    tail = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", ""), tail))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, null if none does.

    Rules are part of the query, in order of length; equal lengths go to the longer host.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        inside = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        fits = inside & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    bit = F.shiftrightunsigned(F.xxhash64(F.lit("bits"), key), 6 * word).bitwiseAND(F.lit(63))
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter as a table, a row for each block with a key."""
    rows = keys.select(
        _block(F.col(key), blocks).alias("block"),
        *[_mask(F.col(key), i).alias(f"w{i}") for i in range(WORDS)],
    )
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(keys: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """The rows of `keys` that the filter over `listed` lets pass: all hits, few others."""
    size = listed.count()
    blocks = max(1, -(-size * BITS_PER_KEY // (64 * WORDS)))
    table = bloom_blocks(listed, listed_key, blocks)
    if blocks <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    else:
        table = cut_lineage(table)
    probe = keys.withColumn("block", _block(F.col(key), blocks)).join(table, "block")
    for i in range(WORDS):
        mask = _mask(F.col(key), i)
        probe = probe.where(F.col(f"w{i}").bitwiseAND(mask) == mask)
    return probe.select(*keys.columns)


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: list[Rule], url_col: str = "url", listed_col: str = "url"
) -> DataFrame:
    """`pages` with host, path, rule, verdict.

    The longest rule that fits decides; without one, a page whose canonical URL is that of a
    listed URL is blocked and any other allowed. Distinct canonical URLs pass the Bloom filter;
    what passes meets the list in an exact hash join, so false positives don't count. Null URLs
    and those without `://` have no host and are allowed. Repeated rows and other columns stay;
    an empty list blocks nothing. New columns follow the old, also where names repeat.
    """
    names = [fresh(pages, f"c{i}") for i in range(len(pages.columns))]
    url = names[pages.columns.index(url_col)]
    host, path = host_and_path(F.col(url))
    rows = pages.toDF(*names).select(
        *names, host.alias("host"), path.alias("path"), canonical(F.col(url)).alias("canon")
    )
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(*names, "host", "path", "canon", rule.alias("rule"), ruled.alias("ruled"))
    known = cut_lineage(
        listed.select(canonical(F.col(listed_col)).alias("canon")).where("canon IS NOT NULL").distinct()
    )
    asked = rows.where("ruled IS NULL AND canon IS NOT NULL").select("canon").distinct()
    hits = possible_hits(asked, "canon", known, "canon").join(known.hint("shuffle_hash"), "canon")
    hits = cut_lineage(hits.select("canon", F.lit(True).alias("listed")))
    judged = rows.join(hits, "canon", "left")
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(*names, "host", "path", "rule", verdict.alias("verdict")).toDF(
        *pages.columns, "host", "path", "rule", "verdict"
    )
