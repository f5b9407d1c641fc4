"""What several operators share: staged tables, words and connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, new_path, shared_dir, shipped, staged

__all__ = ["cut", "new_path", "shared_dir", "shipped", "staged"]

#: Characters that separate words: the space and the ASCII controls 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"
#: Runs of blanks that are not already one plain space (all that a normaliser has to touch).
UNEVEN_BLANKS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Bytes of a text that are split into words at a time, and what ends a word.
BLOCK_BYTES, BLANK = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")
#: ASCII characters that are neither letters nor digits.
ASCII_PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of ``data`` by blocks of about ``BLOCK_BYTES``; no word is cut."""
    if len(data) <= BLOCK_BYTES:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = min(at + BLOCK_BYTES, len(data))
        if end < len(data) and not data[end : end + 1].isspace():
            # the word that straddles the border belongs to this block
            rest = BLANK.search(data, end)
            end = rest.start() if rest else len(data)
        yield data[at:end].split()
        at = end


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_BLANKS, " ")


def plain_words(text: Column) -> Column:
    """Lower-case words between ASCII blanks and punctuation; other scripts' characters belong to words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), ASCII_PUNCTUATION), "")


def unused(name: str, rows: DataFrame) -> str:
    """``name``, with as many underscores as no column of ``rows`` needs."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(rows: DataFrame, key: Column, keys: DataFrame, broadcast_keys: int = 1_000_000) -> DataFrame:
    """``rows`` whose ``key`` is not among ``keys`` (one column; null is a key). The keys are staged and counted: few are
    broadcast, so that whole rows need not move; more are met by a shuffle join."""
    name = unused("_gone", rows)
    gone = staged(keys.select(F.col(f"`{keys.columns[0]}`").alias(name)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= broadcast_keys else gone
    return rows.join(gone, key.eqNullSafe(F.col(name)), "left_anti")


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``links`` as rows (node, root), root being the smallest node; nodes without a link are left out.

    Alternates large-star and small-star steps, which need O(log^2 n) rounds at worst. A node's smallest neighbour
    comes from an aggregate with map-side partials and goes back by a join that adaptive execution can split, so a
    node with very many links is no single task's work. Each round is a reliable checkpoint. Links with a null end
    are ignored; an empty table gives an empty result.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """A count and two order-free sums by which rounds are compared."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1)))).first())
