"""Importance resampling towards a target: bucket-partitioned inverted postings give each hashed feature's gain and each document's weight."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shipped, staged, word_blocks

#: Buckets that features are hashed to, and longest runs of words that are features.
BUCKETS, RUN = 10_000, 2
#: Postings of so many documents are inverted together, and cut into so many ranges of buckets.
BATCH_DOCS, SLOTS = 4096, 32
#: Batches whose postings of one range a task may share out.
BATCHES_A_KEY = 16
#: So many rows of postings, of one batch and one range each, are a task's share at the mean.
ROWS_A_TASK = 64
#: Batches whose documents, and shares of their sums, are a task's at the mean.
BATCHES_A_TASK = 16
#: Postings are stored in row groups of about so many bytes: readers decode a few thousand rows, or a whole group, at a time.
GROUP_BYTES = 8 << 20
#: What belongs to words: ASCII letters (lower-cased) and digits, and all bytes of other characters.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
POSTINGS = "batch long, slot int, doc_ids array<long>, n_features array<long>, n_words array<long>, buckets array<int>, totals array<long>, ends array<int>, docs binary, counts binary"
SHARES = "batch long, kind int, sums array<long>"
SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def features(text: str, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The buckets of all features of a text, repeats included, and the number of its words. A run's crc32 goes on from that of the
    run without its last word."""
    words = [w for block in word_blocks(text.encode("utf-8", "surrogatepass").translate(WORD_BYTES)) for w in block]
    crc = zlib.crc32
    own = [crc(w) for w in words]
    every = [np.array(own, np.int64)]
    for n in range(1, min(run, len(words))):
        own = [crc(w, crc(b" ", c)) for c, w in zip(own, words[n:], strict=False)]
        every.append(np.array(own, np.int64))
    return np.concatenate(every) % buckets, len(words)


def _batch(columns: list, kinds: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in kinds.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k.split()[1]]) for c, k in zip(columns, kinds.split(", "), strict=True)], names=names)


def _inverted(pairs: np.ndarray, buckets: int, slots: int, batch_docs: int) -> Iterator[tuple]:
    """(slot, buckets, totals, ends, docs, counts) of (bucket, document) pairs, which are sorted in place: ``ends`` is where each bucket's
    postings end. Counts have the smallest type that holds them."""
    if not len(pairs):
        return
    pairs.sort()
    starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    keys, counts = pairs[starts], np.diff(starts, append=len(pairs)).astype(np.int32)
    del starts
    bucket, doc = keys // batch_docs, keys % batch_docs
    own, first = np.unique(bucket, return_index=True)
    last = np.r_[first[1:], len(keys)]
    slot = own * slots // buckets
    for s in np.unique(slot):
        a, b = np.searchsorted(slot, [s, s + 1])
        low, high = first[a], last[b - 1]
        totals = np.add.reduceat(counts[low:high], first[a:b] - low, dtype=np.int64)
        yield int(s), own[a:b], totals, last[a:b] - low, doc[low:high], counts[low:high].astype(np.min_scalar_type(counts[low:high].max()))


def _numbers(docs: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a row of postings, 16 bits each, and their counts: as many numbers, so their size tells their type."""
    held = np.frombuffer(docs.as_buffer(), "<i2")
    return held, np.frombuffer(counts.as_buffer(), f"<u{counts.as_buffer().size // len(held)}")


def postings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, buckets: int = BUCKETS, slots: int = SLOTS, batch_docs: int = BATCH_DOCS, batch_features: int = 1 << 20) -> DataFrame:
    """Inverted postings, by batches of documents: for each range of buckets (``slot``) a row with its buckets, how often the batch has
    each, and (document of the batch, count) of each, as the bytes of numpy's numbers (see ``_numbers``); and a row of slot -1 with the facts
    of the batch's documents. Extra columns are ignored; a batch ends with the document that fills it, so a very long text is one of its own.
    """
    if not 1 <= batch_docs <= 1 << 15:
        raise ValueError("a batch has 1 to 32,768 documents")
    pair = np.int32 if buckets * batch_docs < 1 << 31 else np.int64
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def made(batch: int, ids: list, sizes: list, words: list, found: list) -> pa.RecordBatch:
        rows = [(batch, -1, ids, sizes, words, None, None, None, None, None)]
        pairs = np.concatenate(found)
        found.clear()
        for s, own, totals, ends, docs, counts in _inverted(pairs, buckets, slots, batch_docs):
            rows.append((batch, s, None, None, None, own, totals, ends, docs.astype("<i2").tobytes(), counts.tobytes()))
        del pairs
        return _batch(list(zip(*rows, strict=True)), POSTINGS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, sizes, words, found, held = [], [], [], [], 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                bucket, count = features(text.as_py(), run, buckets)
                found.append((bucket * batch_docs + len(ids)).astype(pair))
                ids.append(name)
                sizes.append(len(bucket))
                words.append(count)
                held += len(bucket)
                if len(ids) == batch_docs or held >= batch_features:
                    yield made(number, ids, sizes, words, found)
                    number += 1
                    ids, sizes, words, found, held = [], [], [], [], 0
        if ids:
            yield made(number, ids, sizes, words, found)

    shipped(docs.sparkSession)
    return own.mapInArrow(work, POSTINGS)


def bucket_totals(inverted: DataFrame, name: str) -> DataFrame:
    """How often a corpus has each bucket: a row for each of them at most."""
    counted = inverted.where("slot >= 0").select(F.inline(F.arrays_zip("buckets", "totals")))
    return counted.groupBy("buckets").agg(F.sum("totals").alias(name)).withColumnRenamed("buckets", "bucket")


def gain(s: int, t: int, source: int, target: int, buckets: int = BUCKETS) -> int:
    """By how much a feature of the bucket is likelier in the target, smoothed by one for each bucket: thousandths of a nat, rounded down."""
    return math.floor(1000 * math.log((t + 1) * float(source + buckets) / ((s + 1) * float(target + buckets))))


def gumbel(doc_id: int | None, seed: int) -> int:
    """The document's own draw, in thousandths, from the first 32 bits of a digest (a null id is the empty text)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", run: int = RUN, buckets: int = BUCKETS, slots: int = SLOTS, batch_docs: int = BATCH_DOCS, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of each row of ``docs``.

    Postings are inverted in batches of documents and written once. They are shuffled by ranges of buckets, in salted parts,
    as a range holds postings of all documents. With each part come both corpora's totals of its buckets (counted with
    map-side partials, a row for each bucket); its task makes the gains from them and emits, for each batch, the sums of gains
    over its documents. Those shares meet once more by batch. What moves is the postings and ``slots`` numbers for
    each document; a task sorts some ROWS_A_TASK rows of postings, however many there are, and shares out one at a time, and
    sums up some BATCHES_A_TASK batches.
    """
    inverted = staged(postings(docs, id_col=id_col, text_col=text_col, run=run, buckets=buckets, slots=slots, batch_docs=batch_docs), "postings", {"parquet.block.size": GROUP_BYTES})
    aimed = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{target_text_col}`").alias("text"))
    s = bucket_totals(inverted, "s").withColumn("t", F.lit(0).cast("long"))
    t = bucket_totals(postings(aimed, run=run, buckets=buckets, slots=slots), "t").withColumn("s", F.lit(0).cast("long"))
    counted = staged(s.unionByName(t).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-totals")
    source, aim = counted.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    made = max(1, inverted.where("slot = -1").count())
    salts, tasks = -(-made // BATCHES_A_KEY), -(-made * slots // ROWS_A_TASK)
    slot = F.floor(F.col("bucket") * slots / F.lit(buckets)).cast("int").alias("slot")
    both = counted.groupBy(slot).agg(F.collect_list(F.struct("bucket", "s", "t")).alias("corpora"))  # a slot's share of the buckets
    both = both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lists = inverted.where("slot >= 0").withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int")).select("slot", "salt", "batch", "buckets", "ends", "docs", "counts")
    dealt = lists.unionByName(both, allowMissingColumns=True).repartition(tasks, "slot", "salt").sortWithinPartitions("slot", "salt", F.col("corpora").isNull())

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = np.zeros(buckets)
        for batch in batches:
            out = []
            for k, own in enumerate(batch.column("corpora").to_pylist()):
                if own is not None:
                    for x in own:
                        gains[x["bucket"]] = gain(x["s"], x["t"], source, aim, buckets)
                    continue
                found, ends = (batch.column(c)[k].values.to_numpy() for c in ("buckets", "ends"))
                held, counts = _numbers(batch.column("docs")[k], batch.column("counts")[k])
                each = np.repeat(gains[found], np.diff(ends, prepend=0))
                # whole numbers below 2^53: their sums are exact
                out.append((batch.column("batch")[k].as_py(), 1, np.bincount(held, each * counts).astype(np.int64)))
            if out:
                yield _batch(list(zip(*out, strict=True)), SHARES)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sums = None
        for batch in batches:
            for k, kind in enumerate(batch.column("kind").to_pylist()):
                if kind == 0:  # a batch begins with its documents
                    if now is not None:
                        yield _scored(now, sums, seed)
                    now = [batch.column(c)[k].as_py() for c in ("doc_ids", "n_features", "n_words")]
                    sums = np.zeros(len(now[0]), np.int64)
                else:
                    part = batch.column("sums")[k].values.to_numpy()
                    sums[: len(part)] += part
        if now is not None:
            yield _scored(now, sums, seed)

    facts = inverted.where("slot = -1").select("batch", F.lit(0).alias("kind"), "doc_ids", "n_features", "n_words")
    shares = dealt.mapInArrow(share, SHARES)
    met = facts.unionByName(shares, allowMissingColumns=True).repartition(-(-made // BATCHES_A_TASK), "batch").sortWithinPartitions("batch", "kind")
    return met.mapInArrow(reduced, SCORED)


def _scored(facts: list, sums: np.ndarray, seed: int) -> pa.RecordBatch:
    ids, sizes, words = facts
    weights = [int(total) // n if n else 0 for total, n in zip(sums.tolist(), sizes, strict=True)]
    return _batch([ids, sizes, words, weights, [w + gumbel(i, seed) for i, w in zip(ids, weights, strict=True)]], SCORED)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank.

    Features are runs of one and two words, hashed to buckets. ``weight`` is the rounded-down mean gain of a document's
    features, ``score`` adds a draw of the Gumbel distribution that depends on the id alone: so the highest scores are a sample
    without replacement in proportion to exp(weight). Of the documents with ``least_words`` words, ``percent`` in a hundred
    (rounded down) get their rank; of others it is null. See ``weighted`` for how and its options.

    Ranks need no global sort: scores are whole numbers from a bounded range, so rows are counted by score, the counts run
    along the scores (some ten thousand rows, whatever the input), and rows are numbered within their score, by id (null
    last), then by their other columns. Null texts count as empty; a document without features weighs 0. Repeated rows count each.
    An empty target smooths to equal counts; an empty table gives an empty result. A very long text is one batch of postings.
    """
    scored = staged(weighted(docs, target, **options), "resampled")
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    counts = scored.where(enough).groupBy("score").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    high = counts.withColumn("above", above).where(F.col("above") < drawn).select("score", "above")
    marked = scored.join(high.withColumn("_chosen", F.lit(True)), "score", "left").withColumn("_chosen", enough & F.col("_chosen").isNotNull())
    within = F.row_number().over(W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "n_words"))
    ranked = marked.where("_chosen").withColumn("rank", (F.col("above") + within).cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = marked.where("not _chosen").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")
