"""Structured Streaming: continuous merging, live queries and framed batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import hlc as clocks
from ..operators import merge, spaces
from ..sources.log import SCHEMA
from ..sources.shared import paths_like, remove, shipped, staged


PARTS = ("rows", "fields", "generations")
_VIOLATIONS = f"{', '.join(f'{c} string' for c in (*merge.ROW, 'column', 'node', 'kind'))}, unit string, first_seen long, last_seen long, hlc {clocks.TYPE}, occurrences long"


class MergeSink:
    """foreachBatch target: merges micro-batches into stored state (M15), all of a unit or nothing of it.

    State lies in ``buckets`` by a hash of the row key. A batch reads and rewrites the buckets it touches alone, into a
    folder of its version, and then writes a manifest that names for every bucket the version that holds it; the
    manifest's success file makes the version the newest in one step. So a batch that breaks off leaves no trace, one that is
    tried again rewrites its own, and a sink that starts anew finds the newest version in the folder. Versions that none of
    the last ``kept`` manifests names are removed. Late changes need no watermark, as clocks and not arrival decide (T19).

    ``unit`` names the column whose values are the batches of a micro-batch that stand or fall together (None: it is one).
    Before anything is written, stamps too far in the future are refused and units with a violation (see
    ``merge.violations_of``; ``granted`` and ``reserved`` as there, ``granted`` may be a function that gives a micro-batch's
    grants by its number) are left out whole. Their violations are kept, rolled up by
    kind, row and column (A9), as part of the version.
    """

    def __init__(self, folder: str, columns: dict[str, list[str]], now_ms: int | None = None, on_merge: Callable[[int, DataFrame], None] | None = None, kept: int = 3, *, buckets: int = 16,
                 unit: str | None = None, granted: DataFrame | Callable[[int], DataFrame] | None = None, reserved: dict[str, str] | None = None, validate: bool = False, with_later_inserts: bool = False):
        if kept < 2:
            raise ValueError("a batch needs the version before its own")
        self.folder, self.columns, self.now_ms, self.on_merge, self.kept, self.buckets = folder, columns, now_ms, on_merge, kept, buckets
        self.unit, self.granted, self.reserved, self.with_later_inserts = unit, granted, reserved, with_later_inserts
        self.validate = validate or bool(granted is not None or reserved)

    def versions(self, spark: SparkSession) -> list[int]:
        """The versions that are there to be read, in order."""
        return sorted(int(p.split("/")[-2][1:]) for p in paths_like(spark, f"{self.folder}/manifest/v*/_SUCCESS"))

    def newest(self, spark: SparkSession) -> int:
        """The newest version, -1 before the first."""
        return max(self.versions(spark), default=-1)

    def manifest(self, spark: SparkSession, version: int) -> dict[int, int]:
        """The version that holds each bucket (one row for each of them)."""
        return {r.bucket: r.version for r in spark.read.schema("bucket int, version int").parquet(f"{self.folder}/manifest/v{version}").collect()}

    def _read(self, spark: SparkSession, part: str, held: dict[int, int]) -> DataFrame:
        schema = {"rows": f"{', '.join(f'{c} string' for c in merge.ROW)}, hlc {clocks.TYPE}", "fields": f"{', '.join(f'{c} string' for c in merge.FIELD)}, value string, hlc {clocks.TYPE}",
                  "generations": f"{', '.join(f'{c} string' for c in merge.ROW)}, cl_flag int, hlc {clocks.TYPE}, reason string"}[part]
        by_version: dict[int, list[int]] = {}
        for bucket, version in held.items():
            by_version.setdefault(version, []).append(bucket)
        # one folder for each version that holds a bucket; the scan prunes the others
        found = [spark.read.schema(f"{schema}, bucket int").parquet(f"{self.folder}/data/v{v}/{part}").where(F.col("bucket").isin(*of)).drop("bucket") for v, of in sorted(by_version.items())]
        return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)

    def state(self, spark: SparkSession, version: int) -> merge.State | None:
        """The state after micro-batch ``version``, one of the last ``kept``; None before the first."""
        if version < 0:
            return None
        if version not in self.versions(spark):
            raise LookupError(f"version {version} is not there, the newest is {self.newest(spark)}")
        held = self.manifest(spark, version)
        return merge.State(*(self._read(spark, p, held) for p in PARTS))

    def violations(self, spark: SparkSession, version: int) -> DataFrame:
        """The violations up to a version."""
        there = version >= 0 and paths_like(spark, f"{self.folder}/violations/v{version}/_SUCCESS")
        return spark.read.schema(_VIOLATIONS).parquet(f"{self.folder}/violations/v{version}") if there else spark.createDataFrame([], _VIOLATIONS)

    def _facts(self, changes: DataFrame, old: merge.State, last: int, batch_id: int) -> DataFrame:
        """The changes of units without a violation; the others' violations are written."""
        unit = F.col(self.unit).cast("string") if self.unit else F.lit("batch")
        changes = changes.withColumn("unit", F.coalesce(unit, F.lit("")))
        owners = old.rows.select("tbl", "row_id", F.col("space").alias("owner_space"))
        granted = self.granted(batch_id) if callable(self.granted) else self.granted
        found = staged(merge.violations_of(changes, owners=owners, granted=granted, reserved=self.reserved, by=["unit"]), "violations")
        key = [*merge.ROW, "column", "node", "kind", "unit"]
        rolled = spaces.violations(found.withColumn("seen_at", F.lit(batch_id).cast("long")), key)
        before = self.violations(changes.sparkSession, last).select(rolled.columns)
        spaces.merged_violations(before, rolled, key).write.mode("overwrite").parquet(f"{self.folder}/violations/v{batch_id}")
        return changes.join(found.select("unit").distinct(), "unit", "left_anti").drop("unit")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changes = batch if self.now_ms is None else batch.where(~clocks.too_far_ahead(F.col("hlc"), F.lit(self.now_ms)))
        last = max((v for v in self.versions(spark) if v < batch_id), default=-1)
        held = self.manifest(spark, last) if last >= 0 else {}
        bucket = F.pmod(F.xxhash64("tbl", "row_id"), F.lit(self.buckets)).cast("int")
        of = [r[0] for r in changes.select(bucket.alias("bucket")).distinct().collect()]  # as many as there are buckets
        old = merge.State(*(self._read(spark, p, {b: held[b] for b in of if b in held}) for p in PARTS))
        facts = self._facts(changes, old, last, batch_id) if self.validate else changes
        new = merge.merged(old, facts, self.columns, with_later_inserts=self.with_later_inserts)
        for part in PARTS:
            rows = getattr(new, part).withColumn("bucket", bucket)
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/v{batch_id}/{part}")
        named = {**held, **dict.fromkeys(of, batch_id)}
        spark.createDataFrame(sorted(named.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v{batch_id}")
        self._forget(spark, batch_id)
        if self.on_merge:
            self.on_merge(batch_id, facts)

    def _forget(self, spark: SparkSession, newest: int) -> None:
        """Removes manifests that are older than the last ``kept``, and data that none of those names."""
        every = [v for v in self.versions(spark) if v <= newest]
        stay = every[-self.kept :]
        for version in every[: -self.kept]:
            for what in ("manifest", "violations"):
                remove(spark, f"{self.folder}/{what}/v{version}")
        needed = {v for m in stay for v in self.manifest(spark, m).values()}
        for path in paths_like(spark, f"{self.folder}/data/v*"):
            version = int(path.rsplit("/v", 1)[1])
            if version <= newest and version not in needed:
                remove(spark, path)


def merging(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts continuous merging of a streaming change log; ``trigger`` as in ``DataStreamWriter.trigger``."""
    return changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def change_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = 1) -> DataFrame:
    """A change log as a stream of its Parquet files, so many a micro-batch (None: all that have arrived)."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(folder)


def fingerprint(result: DataFrame) -> tuple:
    """An order-free digest of a result, computed where the rows are: (rows, sum, sum)."""
    h = F.xxhash64(F.to_json(F.struct(*result.columns), {"ignoreNullFields": "false"}))
    return tuple(result.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1)))).first())


class Watch:
    """foreachBatch target of a live query (T15, T16): after a change of a trigger table the query runs again, and is emitted only if
    its result differs from the last one."""

    def __init__(self, query: Callable[[SparkSession], DataFrame], emit: Callable[[int, DataFrame], None], tables: set[str] | None = None):
        self.query, self.emit, self.tables, self.last = query, emit, tables, None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        touched = batch if self.tables is None else batch.where(F.col("tbl").isin(*self.tables))
        if self.last is not None and touched.isEmpty():
            return
        result = self.query(batch.sparkSession)
        mark = fingerprint(result)
        if mark != self.last:
            self.last = mark
            self.emit(batch_id, result)


FRAMES_OUT = "session string, batch long, chunks long, changes long, status string"
_STATE = "batch long, chunks long, changes long"
_FRAMES = {"chunk": 0, "endOfBatch": 1, "close": 2}


def framed(frames: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Batches of a session's frames (session, seq, type, changes) as a stateful operator.

    chunk frames add up until endOfBatch, which gives a complete batch. close ends the session: with nothing collected it
    is ``closed``, in the middle of a batch ``premature``. Silence (``idle_ms`` of processing time) ends an empty
    batch as ``idle``; a begun one waits on. State is three numbers per session. Frames of one session that arrive in
    one micro-batch are taken in order of ``seq``.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, chunks, changes = state.get if state.exists else (0, 0, 0)
        if state.hasTimedOut:
            if not chunks:
                yield pd.DataFrame([(key[0], batch, 0, 0, "idle")], columns=[c.split()[0] for c in FRAMES_OUT.split(", ")])
        else:
            out = []
            # three numbers of each frame are held, not the frames
            kept = [(p["seq"].to_numpy("int64"), p["type"].map(_FRAMES).fillna(len(_FRAMES)).to_numpy("int8"), p["changes"].fillna(0).to_numpy("int64")) for p in parts]
            seq, kinds, sizes = (np.concatenate(c) for c in zip(*kept, strict=True))
            for at in np.argsort(seq, kind="stable"):
                kind = kinds[at]
                if kind == _FRAMES["chunk"]:
                    chunks, changes = chunks + 1, changes + int(sizes[at])
                elif kind == _FRAMES["endOfBatch"]:
                    out.append((key[0], batch, chunks, changes, "complete"))
                    batch, chunks, changes = batch + 1, 0, 0
                elif kind == _FRAMES["close"]:
                    out.append((key[0], batch, chunks, changes, "premature" if chunks else "closed"))
                    batch, chunks, changes = batch + 1, 0, 0
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in FRAMES_OUT.split(", ")])
        state.update((batch, chunks, changes))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    shipped(frames.sparkSession)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return frames.groupBy("session").applyInPandasWithState(run, FRAMES_OUT, _STATE, "append", timeout)


def framed_batches(frames: DataFrame) -> DataFrame:
    """The same over a table of frames, as gaps and islands: batches are numbered by the ends before them."""
    ends = F.col("type").isin("endOfBatch", "close")
    before = W.partitionBy("session").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = frames.withColumn("batch", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(before), F.lit(0)))
    chunk = F.col("type") == "chunk"
    out = rows.groupBy("session", "batch").agg(
        F.sum(F.when(chunk, 1).otherwise(0)).alias("chunks"), F.coalesce(F.sum(F.when(chunk, F.col("changes"))), F.lit(0)).alias("changes"),
        F.max(F.when(ends, F.col("type"))).alias("_end"),
    )
    status = F.when(F.col("_end") == "endOfBatch", "complete").when(F.col("_end") == "close", F.when(F.col("chunks") > 0, "premature").otherwise("closed")).otherwise("open")
    return out.select("session", "batch", "chunks", "changes", status.alias("status"))
