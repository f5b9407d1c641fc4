"""Benchmark decontamination: spaced-seed hashes retrieve, substitution-tolerant overlaps verify."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_words, staged, without

#: Token offsets that each spaced seed compares; the others are ignored. In every stretch of 15 aligned words with
#: three substitutions or fewer, some seed lies on equal words only (tests/llm tries all 455 patterns).
SEEDS = ((0, 1, 4, 7, 9, 10), (0, 1, 8, 9, 10, 11), (0, 1, 2, 4, 5, 6))
#: The stretch of words that is compared, and the share of it that must be equal.
WINDOW, SIMILARITY = 15, 0.8
#: Items of fewer words need all their words equal.
WHOLE_BELOW = 7


def _seeds(window: int, similarity: float) -> tuple[tuple[int, ...], ...]:
    """Seeds of which one lies on equal words only in every stretch that is similar enough: SEEDS where they are known to do,
    else the run that as many substitutions cannot all break (the equal words fall into one run more than there are substitutions)."""
    if window < 1 or not 0 < similarity <= 1:
        raise ValueError("window is one word at least, similarity above 0 and at most 1")
    apart = window - math.ceil(window * similarity)
    if window >= WINDOW and apart <= 3:
        return SEEDS
    return (tuple(range(-(-(window - apart) // (apart + 1)))),)


def _least(size: Column, window: int, similarity: float) -> Column:
    """How many words of a stretch of an item of ``size`` words must be equal."""
    return F.when(size < WHOLE_BELOW, size).otherwise(F.ceil(F.least(F.lit(window), size) * F.lit(similarity)).cast("int"))


def _blocks(items: DataFrame, least: Column) -> DataFrame:
    """Items cut into disjoint blocks (item_at, width), one more than the words that may differ: one block at least is equal."""
    size, count = F.size("item_words"), F.size("item_words") - least + 1
    cut = items.withColumn("block", F.explode(F.sequence(F.lit(0), count - 1)))
    begin, end = [F.floor((F.col("block") + i) * size / count).cast("int") for i in (0, 1)]
    return cut.select("item_key", "item_words", begin.alias("item_at"), (end - begin).alias("width"))


def _seed_hash(words: Column, at: Column, seed: tuple[int, ...], number: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in seed], F.lit(number))


def _hashes(words: Column, at: Column, seeds) -> list[Column]:
    """The hash of each seed at position ``at``; null where a seed does not fit."""
    return [F.when((at >= 0) & (at + seed[-1] < F.size(words)), _seed_hash(words, at, seed, n)) for n, seed in enumerate(seeds)]


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Items with at least one word, each with a key of its own; equal word sequences of one id count once."""
    items = benchmark.select(F.col(item_col).alias("item_id"), plain_words(F.col(text_col)).alias("item_words"))
    return items.where(F.size("item_words") > 0).distinct().withColumn("item_key", F.xxhash64("item_id", "item_words"))


def _keys(items: DataFrame, spaced, widths: list[int], whole: int, least: Column) -> DataFrame:
    """What hashes meet: (seed, number of the seed, hash of the place before, item_key, ats). Places of an item that share a
    hash and the hash before are one row, so a run of one word repeated is two."""
    own_size, item_at, words = F.size("item_words"), F.col("item_at"), F.col("item_words")
    long = items.where(own_size >= whole).withColumn("item_at", F.explode(F.sequence(F.lit(0), own_size - 1)))
    pairs = zip(_hashes(words, item_at, spaced), _hashes(words, item_at - 1, spaced), strict=True)
    found = F.inline(F.array(*[F.struct(here.alias("seed"), F.lit(n).alias("number"), before.alias("before")) for n, (here, before) in enumerate(pairs)]))
    keys = long.select("item_key", "item_at", found)
    if widths:
        of_width = [(F.col("width") == w, _seed_hash(words, item_at, range(w), len(spaced) + k), len(spaced) + k) for k, w in enumerate(widths)]
        keys = keys.unionByName(_blocks(items.where(own_size < whole), least).select(
            "item_key", "item_at", F.coalesce(*[F.when(fits, h) for fits, h, _ in of_width]).alias("seed"),
            F.coalesce(*[F.when(fits, n) for fits, _, n in of_width]).alias("number"), F.lit(None).cast("long").alias("before"),
        ))
    return keys.where("seed is not null").groupBy("seed", "number", "before", "item_key").agg(F.collect_set("item_at").alias("ats"))


def _alignments(texts: DataFrame, benchmark: DataFrame, *, item_col: str, item_text_col: str, window: int, similarity: float, broadcast_hashes: int) -> tuple[DataFrame, Column]:
    """Alignments of ``texts`` (any columns and ``words``) with items that are close enough, with item_id, item_key, item_words,
    start, and the number of the item's words. One alignment may come several times."""
    items = _items(benchmark, item_col, item_text_col)
    size = F.size("item_words")
    least = _least(size, window, similarity)
    whole = max(window, WHOLE_BELOW)  # shorter items are one stretch
    spaced = _seeds(window, similarity)
    widths = sorted(r[0] for r in _blocks(items.where(size < whole), least).select("width").distinct().collect())  # fewer than ``whole``
    seeds = (*spaced, *[tuple(range(n)) for n in widths])
    keys = _keys(items, spaced, widths, whole, least)
    few = (keys.agg(F.sum(F.size("ats"))).first()[0] or 0) <= broadcast_hashes

    words, at, item_at, start = F.col("words"), F.col("at"), F.col("item_at"), F.col("at") - F.col("item_at")
    # no filter on the number of words: it would split every text once more
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))
    placed = texts.select("*", F.explode(places).alias("at"))
    # the hit before, on the same alignment, stands for this one as well
    goes_on = lambda prior: F.coalesce(F.col("before") == prior, F.lit(False))
    if few:
        probes = placed.select("*", F.explode(F.array(*_hashes(words, at, seeds))).alias("seed")).where("seed is not null")
        prior = F.coalesce(*[F.when(F.col("number") == n, h) for n, h in enumerate(_hashes(words, at - 1, spaced))])
        hits = probes.join(F.broadcast(keys), "seed").where(~goes_on(prior)).drop("seed", "before")
        met = hits.select("*", F.explode("ats").alias("item_at")).join(F.broadcast(items), "item_key").where(~_sooner(spaced)).drop("number")
    else:
        befores = [*_hashes(words, at - 1, spaced), *[F.lit(None).cast("long")] * len(widths)]
        pairs = F.inline(F.array(*[F.struct(h.alias("seed"), b.alias("prior")) for h, b in zip(_hashes(words, at, seeds), befores, strict=True)]))
        hits = placed.select(F.col("text_key").alias("of_text"), "at", pairs).where("seed is not null").join(keys, "seed").where(~goes_on(F.col("prior")))
        hits = hits.select("of_text", "item_key", "at", F.explode("ats").alias("item_at")).distinct().join(items, "item_key")
        met = texts.join(hits, F.col("text_key") == F.col("of_text")).drop("of_text")
    whole_equal = sum((F.when(size > i, _same(start + i, F.lit(i))).otherwise(F.lit(0)) for i in range(whole - 1)), F.lit(0))
    around = [_same(at + j, item_at + j) for j in range(1 - window, window)]
    if window <= 32:  # one bit for each word around the hit
        beside = sum((F.shiftleft(e.cast("long"), j) for j, e in enumerate(around)), F.lit(0).cast("long"))
        counts = [F.bit_count(F.shiftright("beside", k).bitwiseAND(F.lit((1 << window) - 1))) for k in range(window)]
    else:
        beside = F.array(*around)
        counts = [F.aggregate(F.slice("beside", k + 1, window), F.lit(0), lambda a, b: a + b) for k in range(window)]
    # an array of one element, taken apart: so the words are compared once, whatever refers to the outcome
    judged = met.select("*", F.explode(F.array(F.when(size >= whole, beside))).alias("beside"))
    inside = [(item_at + 1 - window + k >= 0) & (item_at + 1 + k <= size) for k in range(window)]
    some = F.lit(False)
    for count, fits in zip(counts, inside, strict=True):
        some = some | (fits & (count >= least))
    close = judged.where(F.when(size < whole, whole_equal >= least).otherwise(some))
    return close.withColumn("start", start).drop("at", "item_at", "ats", "beside"), size


def _sooner(spaced) -> Column:
    """True where a seed of a lower number hits in the same place."""
    hit = F.lit(False)
    for n, seed in enumerate(spaced[:-1]):
        equal = F.col("number").between(n + 1, len(spaced) - 1)
        for i in seed:
            equal = equal & (_same(F.col("at") + i, F.col("item_at") + i) == 1)
        hit = hit | equal
    return hit


def _same(at: Column, item_at: Column) -> Column:
    """1 where the text has the item's word, else 0; places outside of either are unlike."""
    return F.coalesce((F.get("words", at) == F.get("item_words", item_at)).cast("int"), F.lit(0))


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, similarity: float = SIMILARITY, broadcast_hashes: int = 2_000_000, broadcast_texts: int = 1_000_000) -> DataFrame:
    """One row per (doc_id, item_id) that overlap: doc_id, item_id, equal_words, item_words.

    Words are lower-cased and stand between ASCII blanks and punctuation. Some stretch of ``window`` words of the item
    (the whole item if it is shorter) must lie in the document with at least ``similarity`` of its words equal in place;
    ``equal_words`` is the largest count of equal words along one alignment. Items of fewer than seven words need all
    their words equal. Every such stretch is found for certain, whatever words of it differ.

    Each position of a document and of an item gives one hash per spaced seed; equal hashes are a hit, and a hit fixes
    an alignment (document position minus item position). A hit whose neighbour before is a hit of the same seed and
    alignment is left to that one, so texts of repeated words give no more hits than alignments. Items shorter than
    ``window`` give one hash per block instead: they are cut into disjoint blocks, one more than the words that may
    differ, so one block is equal; a document's positions give one hash more for each width of block that the benchmark
    has (3, 4 and 5 words for items of 7 to 14). For another ``window`` or ``similarity`` than the seeds are proved for,
    an unbroken run that must be equal takes their place. The words around a hit are compared at once, beside the hit
    and before anything is shuffled; what leaves that loop is the numbers of the alignments that are close enough, each
    of which then has all its words counted once, beside its text's words. All steps are built-in expressions over whole texts,
    so a very long text, or one of few different words, costs what its alignments have words.

    The item hashes are broadcast where they number ``broadcast_hashes`` at most; a larger benchmark is met by a shuffle
    join of (text, position, hash) rows, whose hits are joined to the texts.

    Null or empty texts and items overlap nothing. Rows with null ids are reported with null; repeated rows give one
    result row, and of rows that share an id each is compared by its own text. Empty tables give an empty result.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), plain_words(F.col(text_col)).alias("words"))
    close, size = _alignments(texts, benchmark, item_col=item_col, item_text_col=item_text_col, window=window, similarity=similarity, broadcast_hashes=broadcast_hashes)
    # an alignment comes once for each of its hits; only its numbers move, and its words are counted once
    found = staged(close.select("doc_id", "text_key", "item_id", "item_key", "start").distinct(), "alignments")
    matched = found.select("text_key").distinct()
    few = matched.count() <= broadcast_texts
    held = texts.select("text_key", "words").join(F.broadcast(matched) if few else matched, "text_key", "left_semi").dropDuplicates(["text_key"])
    once = found.select("text_key", "item_key", "start").distinct().join(held, "text_key")
    laid = once.join(_items(benchmark, item_col, item_text_col).select("item_key", "item_words"), "item_key").select(
        "text_key", "item_key", "start", "words", "item_words", size.alias("item_size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("place")
    )
    equal = _same(F.col("start") + F.col("place"), F.col("place"))
    summed = laid.groupBy("text_key", "item_key", "start").agg(F.sum(equal).cast("int").alias("equal"), F.max("item_size").alias("item_size"))
    most = summed.groupBy("text_key", "item_key").agg(F.max("equal").alias("equal"), F.max("item_size").alias("item_size"))
    pairs = found.select("doc_id", "text_key", "item_id", "item_key").distinct().join(most, ["text_key", "item_key"])
    return pairs.groupBy("doc_id", "item_id").agg(F.max("equal").alias("equal_words"), F.max("item_size").alias("item_words"))


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, similarity: float = SIMILARITY, broadcast_hashes: int = 2_000_000) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item, all columns as they were. Rows go by their text's
    SHA-256, never by id, so a clean row that shares its id (or has none) stays."""
    digest = F.sha2(F.col(f"`{text_col}`"), 256)
    texts = docs.select(digest.alias("text_key"), plain_words(F.col(f"`{text_col}`")).alias("words"))
    close, _ = _alignments(texts, benchmark, item_col=item_col, item_text_col=item_text_col, window=window, similarity=similarity, broadcast_hashes=broadcast_hashes)
    return without(docs, digest, close.select("text_key"))
