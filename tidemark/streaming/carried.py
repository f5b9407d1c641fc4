"""Tables that a stream carries from batch to batch: clocks of nodes, announced grants, what sessions have sent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hlc as clocks
from ..operators import replicate, spaces
from ..sources.shared import paths_like, remove

Step = Callable[[DataFrame, DataFrame], DataFrame]


class Carrying:
    """foreachBatch target that carries a table from batch to batch.

    ``step(carried, batch)`` gives what goes out of a micro-batch, which is written; ``after(carried, out)`` gives the table to
    carry on from what was written, so a batch is read once. The carried table's success file makes a version the newest
    in one step: a batch that breaks off leaves nothing that is read, one that is tried again rewrites its own version from the
    one before, and a sink that starts anew goes on from the newest version in the folder. The last ``kept`` carried tables stay.
    A version is the whole carried table (one row per node, grant or sent change of an open session), not the stream's past.
    """

    def __init__(self, folder: str, carried: str, out: str, step: Step, after: Step, kept: int = 3):
        if kept < 2:
            raise ValueError("a batch needs the version before its own")
        self.folder, self.schema, self.out_schema, self.step, self.after, self.kept = folder, carried, out, step, after, kept

    def versions(self, spark: SparkSession) -> list[int]:
        return sorted(int(p.split("/")[-2][1:]) for p in paths_like(spark, f"{self.folder}/carried/v*/_SUCCESS"))

    def carried(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The table after a version (None: the newest), empty before the first."""
        there = [v for v in self.versions(spark) if version is None or v <= version]
        return spark.read.schema(self.schema).parquet(f"{self.folder}/carried/v{there[-1]}") if there else spark.createDataFrame([], self.schema)

    def out(self, spark: SparkSession) -> DataFrame:
        """What has gone out up to the newest version."""
        newest = max(self.versions(spark), default=-1)
        paths = [p for p in paths_like(spark, f"{self.folder}/out/v*") if int(p.rsplit("/v", 1)[1]) <= newest]
        return spark.read.schema(self.out_schema).parquet(*paths) if paths else spark.createDataFrame([], self.out_schema)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, names = self.carried(spark, batch_id - 1), spark.createDataFrame([], self.out_schema).columns
        path = f"{self.folder}/out/v{batch_id}"
        self.step(before, batch).select(*names).write.mode("overwrite").parquet(path)
        self.after(before, spark.read.schema(self.out_schema).parquet(path)).write.mode("overwrite").parquet(f"{self.folder}/carried/v{batch_id}")
        for version in self.versions(spark)[: -self.kept]:
            remove(spark, f"{self.folder}/carried/v{version}")


def stamping(folder: str, *, seq: str = "seq", bucket: int | None = 1024, max_drift_ms: int | None = clocks.MAX_DRIFT_MS) -> Carrying:
    """Stamps the writes of a stream (node, ``seq``, wall_ms) as their nodes' clocks would, one after another (W1, X6): adds ``hlc`` and
    ``error``. Each node's last clock is carried. Within a batch ``seq`` orders a node's writes, in two levels of ``bucket`` numbers,
    so a node with very many is many tasks' work; a write of a later batch comes later, whatever its number."""

    def step(last: DataFrame, batch: DataFrame) -> DataFrame:
        writes = batch.select("node", F.col(seq).cast("long").alias("seq"), "wall_ms").join(last, "node", "left")
        return clocks.stamped(writes, node="node", wall_ms="wall_ms", order="seq", last="last", bucket=bucket, max_drift_ms=max_drift_ms)

    def after(last: DataFrame, out: DataFrame) -> DataFrame:
        given = out.where("hlc is not null").select("node", F.col("hlc").alias("last"))
        return last.unionByName(given).groupBy("node").agg(F.max("last").alias("last"))

    out = f"node string, seq long, wall_ms long, hlc {clocks.TYPE}" + ("" if max_drift_ms is None else ", error string")
    return Carrying(folder, f"node string, last {clocks.TYPE}", out, step, after)


def announcing(folder: str) -> Carrying:
    """What a peer tells its followers of a stream of grants (user, space, role, at; null role: revoked): changes alone (T10). The grants
    last announced are carried, which are the follower's spaces too; a revoked one is removed."""

    def after(last: DataFrame, out: DataFrame) -> DataFrame:
        newest = last.unionByName(out.select("user", "space", "role", "at")).groupBy("user", "space").agg(F.max(F.struct("at", "role")).alias("_last"))
        return newest.select("user", "space", "_last.role", "_last.at").where("role is not null")

    grants = "user string, space string, role string, at long"
    return Carrying(folder, grants, f"{grants}, action string", spaces.announced, after)


def sending_once(folder: str) -> Carrying:
    """What sessions send of a stream of changes (session, space, tbl, row_id, kind, column, hlc): each once a session, again if it was
    written again (D17, T3). The clocks sent are carried until a change of kind ``end`` closes its session, after all others of its batch."""
    schema = f"session string, space string, tbl string, row_id string, kind string, column string, hlc {clocks.TYPE}"
    return Carrying(folder, schema, schema, replicate.sent_once, replicate.sent_after)
