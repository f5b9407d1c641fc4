"""Queries on the remaining operators of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hlc as clocks
from ..operators import merge, projection, record, replicate
from ..sources import log as logs_io
from .constraints import ARRIVED, PARTS, WORLD, parts, world
from .logs import EV, LOG, PROFILE, STATE_SQL, event_log, profile_log
from .outbound import WR, writes
from .registry import query, table
from .schema import UniqueIndex


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority")
def raw_sql(spark, sf_dir):
    """A raw query with named parameters."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("raw_orders")
    return logs_io.raw(spark, "SELECT o_orderpriority, count(*) AS n FROM raw_orders WHERE o_totalprice > :least GROUP BY o_orderpriority", least=100000)


@query("SELECT s_suppkey, s_name FROM supplier")
def untracked_table(spark, sf_dir):
    """A table that does not replicate is read as it is."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'fine' END AS class, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code FROM customer")
def case_expression(spark, sf_dir):
    """Searched and simple CASE."""
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(balance < 0, "debt").when(balance < 1000, "low").otherwise("fine").alias("class"),
        F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(0).alias("code"),
    )


@query(f"""WITH {WR} SELECT row_id, CASE WHEN seq % 5 = 0 THEN NULL ELSE CAST(o_custkey + 1 AS VARCHAR) END AS value, max(wall) OVER (PARTITION BY node ORDER BY seq) AS hlc_ms FROM w""")
def attach_relation(spark, sf_dir):
    """Attaching and detaching a relation is an update of its column."""
    rows = writes(spark, sf_dir).withColumn("o_custkey", F.when(F.col("seq") % 5 != 0, F.col("o_custkey") + 1))
    return record.updates(rows, ["o_custkey"]).select("row_id", "value", F.col("hlc.ms").alias("hlc_ms"))


@query("WITH c AS (SELECT p_brand, p_type FROM part WHERE p_size = 7) SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM c WHERE c.p_brand = p.p_brand AND c.p_type = p.p_type)")
def any_of_claims(spark, sf_dir):
    """Rows that hold any of several claimed tuples."""
    p = table(spark, sf_dir, "part")
    return projection.claimants(p, p.where("p_size = 7"), ["p_brand", "p_type"]).select("p_partkey")


@query(f"""WITH {LOG}, {STATE_SQL} SELECT f.row_id, f.col AS "column", s.ms AS field_ms, k0.ms AS row_ms, 'wish-' || f.row_id AS value FROM f JOIN b USING (space, row_id) WHERE CAST(f.row_id AS BIGINT) % 3 = 0 AND f.col = 'name'""")
def attempted_metadata(spark, sf_dir):
    """Attempted values with their field's and row's clocks."""
    log = profile_log(spark, sf_dir)
    state = merge.state_of(log, PROFILE)
    wish = log.where(F.col("row_id").cast("bigint") % 3 == 0).select("space", "tbl", "row_id", F.lit("name").alias("column"), F.concat(F.lit("wish-"), F.col("row_id")).alias("value")).distinct()
    out = projection.attempted_fields(wish, state.fields, state.rows)
    return out.select("row_id", "column", F.col("field_hlc.ms").alias("field_ms"), F.col("row_hlc.ms").alias("row_ms"), "value")


@query(f"WITH {EV} SELECT space, max(ms) AS hlc_ms, count(*) AS inserts FROM ev WHERE event_type = 'signup' GROUP BY space")
def last_insert_per_table(spark, sf_dir):
    """The newest insert of each space's table (A10)."""
    log = event_log(spark, sf_dir).where("event_type = 'signup'")
    return log.groupBy("space", "tbl").agg(F.max("hlc").alias("hlc"), F.count("*").alias("inserts")).select("space", F.col("hlc.ms").alias("hlc_ms"), "inserts")


@query("SELECT bool_and(o_custkey > 0) AND bool_and(o_totalprice IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS stable FROM orders")
def projection_stable(spark, sf_dir):
    """Whether a write's references all hold, in one row."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    orders = table(spark, sf_dir, "orders").join(known, "o_custkey", "left")
    return projection.is_stable(orders, F.col("o_custkey") > 0, F.col("o_totalprice").isNotNull(), F.col("known").isNotNull())


@query(f"""WITH {WORLD} SELECT line_id AS row_id, 'l_partkey' AS col, CASE WHEN p_size <= 45 THEN CAST(l_partkey AS VARCHAR) END AS safe, CASE WHEN p_size > 45 THEN 'setNull' ELSE 'write' END AS verdict FROM ln JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT line_id, 'l_orderkey', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey IS NULL THEN 'wait' ELSE 'write' END FROM ln LEFT JOIN od ON o_orderkey = l_orderkey""")
def insert_safety(spark, sf_dir):
    """What arriving lines may reference (P9): deletions as their users made them."""
    nodes, refs = world(spark, sf_dir)
    own = refs.where("col in ('l_partkey', 'l_orderkey')")
    return projection.insert_safety(own, nodes.withColumn("hidden", F.col("deleted"))).select("row_id", "col", "safe", "verdict")


@query(f"""WITH {PARTS}, r AS (SELECT *, sum(CASE WHEN hidden THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand, p_type) AS k FROM p)
  SELECT row_id, CASE WHEN hidden THEN 'released' WHEN k > 1 AND NOT p_size % 5 = 0 THEN 'refused' ELSE 'kept' END AS outcome FROM r""")
def unique_local_mode(spark, sf_dir):
    """Local writes with visible conflicts are refused, not arbitrated."""
    rows = parts(spark, sf_dir).withColumn("restoring", F.col("p_size") % 5 == 0)
    return projection.local_unique(rows, UniqueIndex(("p_brand", "p_type"), "p_type")).select("row_id", "outcome")


@query(f"WITH {WORLD} SELECT count(*) > 0 AS found FROM ln WHERE l_orderkey NOT IN (SELECT o_orderkey FROM od)")
def any_invalid_reference(spark, sf_dir):
    """Whether any reference is broken: union all over edges, and the first hit is enough."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").where(ARRIVED).select(F.col("o_orderkey").alias("k"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    lost = line.select(F.col("l_orderkey").alias("k")).join(orders, "k", "left_anti").unionByName(line.select(F.col("l_partkey").alias("k")).join(part, "k", "left_anti"))
    return lost.limit(1).agg((F.count("*") > 0).alias("found"))


@query(f"""WITH {EV}, r AS (SELECT n AS replica, ms AS t, event_type AS phase, event_type <> 'error' AS ok, event_id % 100 AS unsent, event_id FROM ev)
  SELECT replica, arg_max(phase, {{'a': t, 'p': phase, 'u': unsent}}) AS phase, arg_max(unsent, {{'a': t, 'p': phase, 'u': unsent}}) AS unsent, max(CASE WHEN ok THEN t END) AS last_success, max(CASE WHEN NOT ok THEN t END) AS last_failure, count(*) AS rounds FROM r GROUP BY replica""")
def status_tracker(spark, sf_dir):
    """Phase, backlog and last outcomes of each replica."""
    rounds = event_log(spark, sf_dir).select(F.col("hlc.node").alias("replica"), F.col("hlc.ms").alias("at"), F.col("event_type").alias("phase"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 100).alias("unsent"))
    return replicate.status(rounds)


@query("SELECT user_id, count(*) > 0 AS has_account, min(event_id) AS account FROM events WHERE event_type = 'signup' GROUP BY user_id")
def account_lookup(spark, sf_dir):
    """Whether users have an account, and which (V5)."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.groupBy("user_id").agg((F.count("*") > 0).alias("has_account"), F.min("event_id").alias("account"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 800000000000 ELSE 0 END AS ms, greatest(CASE o_orderkey % 3 WHEN 0 THEN 800000000000 ELSE 0 END, epoch_us(o_orderdate) // 1000) AS latest FROM orders""")
def clock_constructors(spark, sf_dir):
    """The beginning of time, and the later of two clocks."""
    o = table(spark, sf_dir, "orders")
    a = F.when(F.col("o_orderkey") % 3 == 0, clocks.hlc(F.lit(800_000_000_000), F.lit(0), F.lit("n"))).otherwise(clocks.zero(F.lit("n")))
    b = clocks.hlc(clocks.truncated_ms(F.col("o_orderdate")), F.lit(0), F.lit("n"))
    return o.select("o_orderkey", a["ms"].alias("ms"), clocks.latest(a, b)["ms"].alias("latest"))
