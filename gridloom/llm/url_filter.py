"""URL rules behind a blocked Bloom filter (DataFrame operations only).

A rule is a host and a path prefix; it fits the host and all its subdomains wherever the URL's path starts with the
rule's path, and the longest rule that fits decides. Each URL yields its canonical candidates (every suffix of its
host at a dot, with every path prefix of a length that some rule has). A blocked Bloom filter over the rules' keys, in
which one key touches one 256-bit block only, passes possible hits; an exact hash join on the whole key removes its
false positives.

Defined cases: a null URL or one without ``://`` has empty host and path and fits no rule; repeated rows are judged
one by one; a rule with an empty host fits nothing; extra columns are ignored unless asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import checked_broadcast

LANES = 4  # 64-bit words in a block
BITS_PER_KEY = 16
PROBES = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host (A-Z) and the path of a URL as the contract of the filter cuts them."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), key), F.lit(blocks)).cast("int")


def _probes(key: Column) -> list[Column]:
    """Bit numbers inside the block, from disjoint bytes of a second hash."""
    h = F.xxhash64(F.lit(29), key)
    return [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(64 * LANES - 1)).cast("int") for i in range(PROBES)]


def lane_masks(key: Column) -> list[Column]:
    bits = _probes(key)
    out = []
    for lane in range(LANES):
        mask = F.lit(0).cast("long")
        for b in bits:
            inside = F.floor(b / 64) == lane
            mask = mask.bitwiseOR(F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)))).otherwise(F.lit(0).cast("long")))
        out.append(mask)
    return out


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """``(block, l0..l3)``: the filter, one row for each block that has a bit set; OR is merged by partial aggregation."""
    k = F.col("key")
    masks = keys.select(block_of(k, blocks).alias("block"), *[m.alias(f"l{i}") for i, m in enumerate(lane_masks(k))])
    return masks.groupBy("block").agg(*[F.bit_or(f"l{i}").alias(f"l{i}") for i in range(LANES)])


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    broadcast_limit: int = 8 << 20,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``; of equal rules the one with the smallest verdict counts. The
    filter is broadcast while its counted size is within ``broadcast_limit`` (2 bytes a rule, so some millions of
    rules), and so is the rule table; beyond it, both joins are shuffled, with the skewed keys split by Spark.
    """
    rules = (
        rules.where("host <> ''")
        .select(F.concat(F.translate("host", UPPER, LOWER), F.col("path")).alias("key"), F.length("path").alias("plen"), "verdict")
        .groupBy("key", "plen")
        .agg(F.min("verdict").alias("verdict"))
    )
    size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)), F.collect_set("plen")).first()
    n, key_bytes, lengths = size[0], size[1], sorted(size[2])
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    if not n:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # Distinct URLs only: a URL that many rows repeat is looked up once.
    urls = judged.where("host <> ''").select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    lens = F.filter(F.array(*map(F.lit, lengths)), lambda x: x <= F.length("path"))
    keys = urls.select(
        "host",
        "path",
        F.explode(F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(lens, lambda x: F.concat(s, F.substring(F.col("path"), F.lit(1), x))))))).alias("key"),
    )
    blocks = 1 << max(0, math.ceil(math.log2(max(1, n * BITS_PER_KEY / (64 * LANES)))))
    bloom = checked_broadcast(bloom_blocks(rules, blocks), blocks, 8 * LANES + 4, broadcast_limit)
    masks = lane_masks(F.col("key"))
    may = (
        keys.withColumn("block", block_of(F.col("key"), blocks))
        .join(bloom, "block")
        .where(all_set(masks))
        .select("host", "path", "key")
    )
    sure = may.join(checked_broadcast(rules, n, key_bytes // n + 32, broadcast_limit), "key")
    best = (
        sure.groupBy("host", "path")
        .agg(F.max(F.struct(F.length("key").alias("len"), (-F.col("plen")).alias("host_len"), "key", "verdict")).alias("b"))
        .select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("b.key").alias("rule"), F.col("b.verdict").alias("rule_verdict"))
    )
    return judged.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict")
    )


def all_set(masks: list[Column]) -> Column:
    ok = F.lit(True)
    for i, m in enumerate(masks):
        ok = ok & (F.col(f"l{i}").bitwiseAND(m) == m)
    return ok
