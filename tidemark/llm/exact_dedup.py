"""Exact dedup: a two-pass Bloom filter finds texts that may repeat; only those rows shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import normalised, staged

#: A group of copies is hot beyond this share of all rows and this number of rows.
HOT_SHARE, HOT_ROWS = 1e-5, 1000


def text_digest(text: Column) -> Column:
    """Hex SHA-256 of the text with each run of blanks as one space (null: the empty text)."""
    return F.sha2(normalised(text), 256)


def _word(words: int) -> Column:
    return F.pmod(F.col("h"), F.lit(words))


def _bits() -> Column:
    """The bits that a hash ``h`` sets in its word, two (by chance one), as a long."""
    one = "shiftleft(1L, cast(shiftrightunsigned(xxhash64(h, 1), {}) & 63 as int))"
    return F.expr(f"{one.format(58)} | {one.format(52)}")


def bloom_filter(hashes: DataFrame, words: int) -> DataFrame:
    """Pass one: the Bloom filter of ``hashes`` (column ``h``), as (word, twice): its 64-bit words, each with the bits that may have been
    set more than once; words without such a bit are left out.

    A hash sets two bits of one word. Tasks set their bits in words of their own, which are then merged, so a task sends each word that it
    touches once (a word, its bits, their parity and how many were set): never more than the filter has, nor than
    there are hashes, and a text that a third of the rows share is one word of each task. Parity tells bits that were set
    twice from those set once, unless some bit of the word was set three times or more: then the sum is greater than parity
    explains, and all bits of the word count as set again. So every hash that comes twice is found, and few others.
    """
    merged = hashes.groupBy(_word(words).alias("word")).agg(F.bit_or(_bits()).alias("any"), F.bit_xor(_bits()).alias("odd"), F.sum(F.bit_count(_bits())).alias("n"))
    even = F.col("any").bitwiseXOR(F.col("odd"))
    explained = F.col("n") == F.bit_count("odd") + 2 * F.bit_count(even)
    twice = F.when(explained, even).otherwise(F.col("any"))
    return staged(merged.select("word", twice.alias("twice")).where("twice <> 0"), "exact-filter")


def may_repeat(rows: DataFrame, hashes: DataFrame, n_rows: int, *, bits_per_row: int, broadcast_words: int) -> DataFrame:
    """Pass two: ``rows`` with a hash ``h`` get ``repeats``, true for all whose hash comes twice in ``hashes`` and, by chance, for few others
    (at 64 bits a row for some 0.3 % of those that come once; with fewer bits for more, and the result stays the same).

    The filter has ``bits_per_row`` bits for each of ``n_rows`` rows. Words with bits that were set again are broadcast, so
    ``rows`` need not move; beyond ``broadcast_words`` of them rows are joined to their word by a shuffle instead.
    """
    words = max(1, n_rows * bits_per_row // 64)
    found = bloom_filter(hashes, words)
    found = F.broadcast(found) if found.count() <= broadcast_words else found
    joined = rows.withColumn("word", _word(words)).join(found, "word", "left")
    repeats = F.coalesce(F.col("twice").bitwiseAND(_bits()) == _bits(), F.lit(False))
    return joined.withColumn("repeats", repeats).drop("word", "twice", "h")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits_per_row: int = 64, broadcast_words: int = 1 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are read and digested once; both passes run over the staged (id, digest) table. Rows that the filter clears are
    answered in place. The rest are counted by (digest, id), with map-side partials. Facts of hot groups, those of over
    ``HOT_SHARE`` of all rows (and ``HOT_ROWS``), go to their rows by broadcast, of others by a shuffle join; so no
    task gets a hot group's rows.

    Null texts count as empty. A null id is larger than every other: it is kept only where its whole group has null
    ids. Of rows with one id and one text, the first stays and the others are dropped rows of their own. An empty
    table gives an empty result. Very long texts are digested whole, where they are read; only their digests go on. Extra
    columns are ignored, whatever their names.
    """
    keys = staged(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "exact-keys")
    rows = keys.count()
    hashed = F.xxhash64("digest").alias("h")
    flagged = may_repeat(keys.select("*", hashed), keys.select(hashed), rows, bits_per_row=bits_per_row, broadcast_words=broadcast_words)
    alone = flagged.where("not repeats").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256")
    )
    counted = flagged.where("repeats").groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    groups = counted.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    hot = F.col("group_size") > max(HOT_ROWS, int(rows * HOT_SHARE))
    # at most 1 / HOT_SHARE groups can be hot
    marked = counted.join(F.broadcast(groups.where(hot)), "digest", "left")
    answered = marked.where("group_size is not null")
    others = marked.where("group_size is null").select("digest", "doc_id", "n").join(groups.where(~hot), "digest")
    both = answered.unionByName(others, allowMissingColumns=False)
    copies = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    shared = copies.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("digest").alias("text_sha256")
    )
    return alone.unionByName(shared)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits_per_row: int = 64, broadcast_words: int = 1 << 20) -> DataFrame:
    """``docs`` with one row for each text, that of the smallest id, all columns as they were (of any type).

    Rows that the filter clears pass straight through; the rest meet in one min_by aggregate with map-side partials.
    Nulls, ties and empty tables as in ``decide``; very long texts are hashed whole in both passes; of rows with one id and text, that with the smallest hash of its JSON
    form stays.
    """
    text = F.col(f"`{text_col}`")
    hashed = F.xxhash64(normalised(text)).alias("h")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{id_col}`").alias("id"), text.alias("text"), hashed)
    flagged = may_repeat(rows, docs.select(hashed), docs.count(), bits_per_row=bits_per_row, broadcast_words=broadcast_words)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.xxhash64(F.to_json("whole")))
    first = flagged.where("repeats").groupBy(text_digest(F.col("text")).alias("digest")).agg(F.min_by("whole", order).alias("whole"))
    return flagged.where("not repeats").select("whole.*").unionByName(first.select("whole.*"))
