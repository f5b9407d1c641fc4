"""Queries on tables that a stream carries from batch to batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hlc as clocks
from ..sources.shared import new_path
from ..streaming import carried, live
from .logs import EV, event_log
from .outbound import _arrivals
from .registry import query, table

HOUR = 3_600_000


def _ran(spark, sink: carried.Carrying, rows: DataFrame, order: str) -> carried.Carrying:
    """The sink after three arrivals of ``rows``, each of which takes up where the last one ended."""
    checkpoint = new_path(spark, "carried-checkpoint")
    for folder in _arrivals(spark, rows, order, 3):
        live.merging(spark.readStream.schema(rows.schema).parquet(folder), sink, checkpoint).awaitTermination()
    return sink


@query(f"""WITH d AS (SELECT event_id, 'n' || (event_id % 3) AS node, epoch_us(date_trunc('hour', ts)) // 1000 - CASE WHEN event_id % 11 = 0 THEN {2 * HOUR} ELSE 0 END AS wall FROM events),
  t AS (SELECT *, max(wall) OVER (PARTITION BY node ORDER BY event_id) AS ms FROM d),
  k AS (SELECT *, ms - wall <= {HOUR} AS ok, sum(CASE WHEN ms - wall <= {HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY node, ms ORDER BY event_id) - 1 AS place FROM t)
  SELECT event_id, node, CASE WHEN ok THEN ms END AS hlc_ms, CASE WHEN ok THEN CAST(place AS INTEGER) END AS hlc_counter, CASE WHEN NOT ok THEN 'localAhead' END AS error FROM k""")
def stream_stamps(spark, sf_dir):
    """Stamps of a stream of writes: each node's clock is carried, writes of a wall clock that lags are refused."""
    e = table(spark, sf_dir, "events")
    hour = clocks.truncated_ms(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"))
    wall = hour - F.when(F.col("event_id") % 11 == 0, 2 * HOUR).otherwise(0)
    writes = e.select(F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")).alias("node"), F.col("event_id").alias("seq"), wall.alias("wall_ms"))
    out = _ran(spark, carried.stamping(new_path(spark, "stamps"), max_drift_ms=HOUR), writes, "seq").out(spark)
    return out.select(F.col("seq").alias("event_id"), "node", F.col("hlc.ms").alias("hlc_ms"), F.col("hlc.counter").alias("hlc_counter"), "error")


GRANTED = """gr AS (SELECT event_id AS seen, 'u' || user_id AS u, 's' || (event_id // 2 % 5) AS space, CASE event_type WHEN 'signup' THEN 'readWrite' WHEN 'purchase' THEN 'readWrite' WHEN 'error' THEN NULL ELSE 'readOnly' END AS role FROM events),
  ch AS (SELECT *, lag(role) OVER (PARTITION BY u, space ORDER BY seen) AS was FROM gr)"""


def _grants(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    role: Column = F.when(kind.isin("signup", "purchase"), "readWrite").when(kind != "error", "readOnly")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), F.concat(F.lit("s"), (F.floor(F.col("event_id") / 2) % 5).cast("string")).alias("space"), role.alias("role"), F.col("event_id").alias("at")
    )


@query(f"""WITH {GRANTED} SELECT u AS "user", space, role, seen AS "at", CASE WHEN role IS NULL THEN 'delete' WHEN was IS NULL THEN 'insert' ELSE 'update' END AS action FROM ch WHERE role IS DISTINCT FROM was""")
def stream_announcements(spark, sf_dir):
    """What followers are told of a stream of grants: changes alone, revoked ones as deletes."""
    return _ran(spark, carried.announcing(new_path(spark, "announced")), _grants(spark, sf_dir), "at").out(spark)


@query(f"""WITH {GRANTED}, mx AS (SELECT u, space, arg_max({{'r': role}}, seen).r AS role FROM gr GROUP BY u, space) SELECT u AS "user", space, role FROM mx WHERE role IS NOT NULL""")
def stream_follower_spaces(spark, sf_dir):
    """The spaces of a follower after a stream of grants: what was announced last, without what was revoked."""
    return _ran(spark, carried.announcing(new_path(spark, "announced")), _grants(spark, sf_dir), "at").carried(spark).select("user", "space", "role")


@query(f"""WITH {EV}, tm AS (SELECT max(event_id) AS top FROM events), x AS (SELECT n, row_id, event_type AS col, ms * 65536 + c AS k, event_id, event_id * 3 // (top + 1) AS a FROM ev, tm),
  cand AS (SELECT n, row_id, col, k, a FROM x UNION ALL SELECT n, row_id, col, k, a + s FROM x, (VALUES (1), (2)) AS later(s) WHERE event_id % 7 < 3 AND a + s <= 2),
  g AS (SELECT n, row_id, col, a, CASE WHEN n = 'n1' AND a = 2 THEN 1 ELSE 0 END AS life, max(k) AS k FROM cand GROUP BY ALL),
  p AS (SELECT *, max(k) OVER (PARTITION BY n, row_id, col, life ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
  SELECT n AS session, row_id, col AS "column", k // 65536 AS hlc_ms, CAST(k % 65536 AS INTEGER) AS hlc_counter FROM p WHERE before IS NULL OR k > before""")
def stream_released_once(spark, sf_dir):
    """Changes that are released again in later rounds go once a session, and again in the session after it."""
    e = event_log(spark, sf_dir)
    top = e.agg(F.max("event_id")).first()[0] or 0
    rows = e.select(
        F.col("hlc.node").alias("session"), "space", "tbl", "row_id", F.lit("update").alias("kind"), F.col("event_type").alias("column"), "hlc",
        F.explode(F.when(F.col("event_id") % 7 < 3, F.array(*[F.lit(k) for k in range(3)])).otherwise(F.array(F.lit(0)))).alias("_later"), F.floor(F.col("event_id") * 3 / (top + 1)).alias("_first"),
    )
    again = rows.withColumn("round", F.col("_first") + F.col("_later")).where("round <= 2").drop("_later", "_first")
    end = again.select("session", "round").distinct().where("session = 'n1' and round = 1")
    every = again.unionByName(end.withColumn("kind", F.lit("end")), allowMissingColumns=True)
    return (
        _ran(spark, carried.sending_once(new_path(spark, "sent")), every, "round").out(spark).where("kind <> 'end'")
        .select("session", "row_id", "column", F.col("hlc.ms").alias("hlc_ms"), F.col("hlc.counter").alias("hlc_counter"))
    )
