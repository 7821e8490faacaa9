"""Operator 6: URL filtering with a blocked Bloom filter in front of an exact join.

The canonical form of a URL is its host, A-Z lower-cased and without a leading "www.", and its path
without closing slashes. Every listed canonical URL sets one bit in each of the eight 64-bit words of one
block of the filter. A URL whose eight bits are all set is a possible hit; only those go to the join with
the list, which removes the false positives. The filter has at most `most_blocks` blocks of 64 bytes, 16 MB,
so its broadcast is bounded; it is as good as empty beyond some eight million listed URLs, when a longer
list makes more false positives, never a wrong verdict.

Rules on host and path go before the list: a rule fits its host and all subdomains, if the path starts
with the rule's; the longest wins. They are an operator's own few exceptions (MOST_RULES at most).

Rows: one per input row. Host: after the first "://" up to "/", "?", "#" or the end; path: then up to
"?", "#" or the end. Null URLs and those without "://" have an empty host and path and match neither a
rule nor the list. Columns of the input that have the name of a new column are replaced; all others stay.
Repeated rows are judged alike. An empty table gives an empty table, an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipeweave.llm.names import fresh
from pipeweave.llm.storage import Scratch

MOST_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SHAPE, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SHAPE, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Null for an empty host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit in each of eight words."""
    h = F.xxhash64(F.lit(2), key)
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(8)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """keys: key. One row per block that has a bit, with the words w0 to w7."""
    set_ = keys.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    return set_.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (action, host/path) that fits, as a struct of n, rule and action, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    known = []
    for action, rule in rules:
        at = rule.index("/")
        kept = F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        known.append(F.when(fits, kept))
    return F.array_max(F.array(*known)) if known else F.lit(None).cast("struct<n:int,rule:string,action:string>")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], scratch: Scratch, most_blocks: int = 1 << 18) -> DataFrame:
    """pages with host, path, rule and verdict (allow or block). listed: url of each URL to block."""
    keys = listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key")).where("key is not null").distinct()
    keys = scratch.keep(keys, "listed")
    n, blocks = keys.count(), 1
    while blocks < most_blocks and blocks * 32 < n:  # 16 bits a key
        blocks *= 2
    block, found, key, maybe_, listed_, *own = fresh(pages, "_block", "_rule", "_key", "_maybe", "_listed", *[f"_w{i}" for i in range(8)])
    words = F.broadcast(bloom(keys, blocks).toDF(block, *own))

    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    known = pages.select(*others, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = known.withColumn(found, rule_for(F.col("host"), F.col("path"), rules)).withColumn(key, canonical(F.col("host"), F.col("path")))
    tried = known.withColumn(block, F.when(F.col(found).isNull(), _block(F.col(key), blocks))).join(words, block, "left")
    maybe = F.lit(True)
    for w, b in zip(own, _bits(F.col(key)), strict=True):
        maybe = maybe & F.coalesce(F.col(w).bitwiseAND(b) != 0, F.lit(False))
    tried = tried.withColumn(maybe_, maybe)
    result = [*[F.col(f"`{c}`") for c in others], "host", "path", F.col(found)["rule"].alias("rule")]
    # Only possible hits go to the join, and so perhaps to a shuffle.
    clear = tried.where(~F.col(maybe_)).select(*result, F.coalesce(F.col(found)["action"], F.lit("allow")).alias("verdict"))
    hits = tried.where(F.col(maybe_)).join(keys.select(F.col("key").alias(key), F.lit(True).alias(listed_)), key, "left")
    return clear.unionByName(hits.select(*result, F.when(F.col(listed_), "block").otherwise("allow").alias("verdict")))
