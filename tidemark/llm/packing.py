"""Best-fit packing under conflicts: bins ordered by residual space carry bitmaps of their sources and duplicate clusters."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import normalised, shipped, staged

#: Equal rows that are dealt together.
COPIES = 64
#: Tokens are bytes: the vocabulary of a byte-level model.
CAPACITY = 16384


def byte_tokens(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def copy_cluster(text: Column) -> Column:
    """Texts equal up to runs of blanks share a cluster."""
    return F.xxhash64(normalised(text))


class Bins:
    """Open bins in order of (residual space, number), in blocks of at most ``most``. A block keeps the sources and the
    clusters that all its bins hold: an item of one of them passes over the whole block."""

    def __init__(self, most: int = 128):
        self.most = most
        self.blocks: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []  # the last bin of each block
        self.common: list[tuple[int, int]] = []
        self.held: list[tuple[int, int]] = []  # the sources and clusters of each bin, open or full

    def take(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """Takes out the tightest bin that has room for ``size`` and neither of the two bits."""
        first = bisect_left(self.tops, (size, -1))
        for k in range(first, len(self.blocks)):
            sources, clusters = self.common[k]
            if sources & source or clusters & cluster:
                continue
            block = self.blocks[k]
            for at in range(bisect_left(block, (size, -1)) if k == first else 0, len(block)):
                sources, clusters = self.held[block[at][1]]
                if not (sources & source or clusters & cluster):
                    found = block.pop(at)
                    self._settle(k)
                    return found
        return None

    def put(self, residual: int, number: int) -> None:
        k = min(bisect_left(self.tops, (residual, number)), len(self.blocks) - 1)
        if k < 0:
            self.blocks, self.tops, self.common, k = [[]], [(0, 0)], [(0, 0)], 0
        insort(self.blocks[k], (residual, number))
        self._settle(k)

    def _settle(self, k: int) -> None:
        block = self.blocks[k]
        halves = [block] if 0 < len(block) <= self.most else [block[: len(block) // 2], block[len(block) // 2 :]] if block else []
        self.blocks[k : k + 1] = halves
        self.tops[k : k + 1] = [x[-1] for x in halves]
        self.common[k : k + 1] = [(reduce(and_, (self.held[n][0] for _, n in x)), reduce(and_, (self.held[n][1] for _, n in x))) for x in halves]


def pack_shard(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """Places items (size, source, cluster), the largest first; gives (bin, offset) of each.

    Bins lie ordered by residual space. An item looks up the smallest residual that holds it and goes on to the successors
    until a bin has neither its source nor its cluster in its bitmaps: the tightest compatible bin. Where there is none,
    it opens a bin.
    """
    bins = Bins()
    source_bit: dict[int, int] = {}
    cluster_bit: dict[int, int] = {}
    out = []
    for size, source, cluster in items:
        s = source_bit.setdefault(source, 1 << len(source_bit))
        c = cluster_bit.setdefault(cluster, 1 << len(cluster_bit))
        found = bins.take(size, s, c)
        if found is None:
            found = capacity, len(bins.held)
            bins.held.append((0, 0))
        residual, number = found
        sources, clusters = bins.held[number]
        bins.held[number] = sources | s, clusters | c
        out.append((number, capacity - residual))
        if residual > size:
            bins.put(residual - size, number)
    return out


def pieces(docs: DataFrame, id_col: str, source_col: str, size: Column, cluster: Column, capacity: int) -> DataFrame:
    """Spans of at most ``capacity`` tokens: a longer document gives full pieces and a rest; an empty one an empty piece."""
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), cluster.alias("cluster"), size.alias("total"))
    count = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / capacity).cast("long"))
    cut = measured.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return cut.select(
        "doc_id", "piece", F.coalesce(F.xxhash64("source"), F.lit(0)).alias("source"), "cluster", (F.col("piece") * capacity).alias("span_start"),
        F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * capacity).alias("tokens"),
    )


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, shard_rows: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, span_start, tokens, bin_id, bin_offset.

    No bin holds more than ``capacity`` tokens, two pieces of one source, or two of one duplicate cluster. Pieces are
    dealt into shards of about ``shard_rows`` by a hash of all that tells them apart, so that a source or cluster with a
    third of all rows is spread over all shards; rows that nothing tells apart are counted first and dealt ``COPIES`` at
    a time. Each shard is packed by best fit, the largest pieces first (ties by id, piece, source and cluster). A shard is
    the most that a task holds: shards are numbered by the pieces there are, so they differ by chance alone. ``bin_id`` is
    the shard's number times 2^32 plus the bin's.

    ``size`` gives a document's tokens (default: UTF-8 bytes) and ``cluster`` its duplicate cluster (default: equal
    texts). Full pieces of long documents take a bin each, as no space is left. Null and empty texts are pieces of no
    tokens; a null source is a source; a null size counts as zero. Repeated rows are pieces of one source, so they
    never meet. An empty table gives an empty result; extra columns are ignored.
    """
    size = F.coalesce((byte_tokens(F.col(text_col)) if size is None else size).cast("long"), F.lit(0).cast("long"))
    cluster = copy_cluster(F.col(text_col)) if cluster is None else cluster
    cut = pieces(docs, id_col, source_col, size, F.coalesce(F.xxhash64(cluster), F.lit(0)), capacity)
    told = ["doc_id", "piece", "source", "cluster", "span_start", "tokens"]
    counted = staged(cut.groupBy(*told).agg(F.count("*").alias("copies")), "pieces")
    shards = max(1, -(-(counted.agg(F.sum("copies")).first()[0] or 0) // shard_rows))
    lots = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).alias("lot")
    dealt = counted.select(*told, lots, "copies").withColumn("copies", F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("lot") * COPIES).cast("int"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(*told, "lot"), F.lit(shards)).cast("long"))
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("tokens"), "doc_id", "piece", "source", "cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column("shard").to_pylist()
            at = 0
            while at < len(shard):
                end = at + 1
                while end < len(shard) and shard[end] == shard[at]:
                    end += 1
                if held and held[0].column("shard")[0].as_py() != shard[at]:
                    yield packed(held, capacity)
                    held = []
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield packed(held, capacity)

    shipped(docs.sparkSession)
    return ordered.mapInArrow(run, "doc_id long, piece long, span_start long, tokens long, bin_id long, bin_offset long")


def pack_apart(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bits: int = simhash.MAX_BITS, capacity: int = CAPACITY, shard_rows: int = 4096) -> DataFrame:
    """``pack`` with SimHash components of ``bits`` as duplicate clusters: no bin holds near copies, from whatever sources.

    Texts equal up to blanks and the case of A-Z have one fingerprint, so they are of one cluster too, and so are all texts
    without a word. Texts are read once, for fingerprints and sizes; what moves after that are ids, sources and numbers.
    Nulls, empty and long texts, repeated rows and empty tables are as in ``pack``.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), byte_tokens(F.col(text_col)).alias("size"))
    prints = staged(simhash.with_fingerprint(own, "text", "fp").drop("text"), "prints")
    return pack(simhash.clustered(prints, bits), size=F.col("size"), cluster=F.col("cluster"), capacity=capacity, shard_rows=shard_rows)


def packed(parts: list[pa.RecordBatch], capacity: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts)
    table = table.take(np.repeat(np.arange(table.num_rows), table.column("copies").to_numpy())).combine_chunks()
    items = list(zip(*(table.column(c).to_pylist() for c in ("tokens", "source", "cluster")), strict=True))
    placed = pack_shard(items, capacity)
    base = table.column("shard")[0].as_py() << 32
    columns = [table.column(c).combine_chunks() for c in ("doc_id", "piece", "span_start", "tokens")]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    columns += [pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "span_start", "tokens", "bin_id", "bin_offset"])
