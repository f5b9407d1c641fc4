"""Queries on scoped reads, spaces and violations (S, F1-F9, J1-J5, O, U, A1, A9, T10, T11, T21-T23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, spaces, visibility
from .logs import EV, STAMP, event_log
from .registry import query, table

CUST = """cust AS (SELECT c_custkey, c_name, c_acctbal, c_nationkey, c_mktsegment, 'r' || n_regionkey AS space, CAST(c_custkey AS VARCHAR) AS id, c_acctbal < 0 AS hid
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
MEMBERS = """usr AS (SELECT 'u' || n_nationkey AS u, n_nationkey AS k FROM nation),
  mem AS (SELECT u, 'r' || r_regionkey AS space, CASE WHEN k * r_regionkey % 2 = 0 THEN 'readOnly' ELSE 'readWrite' END AS role FROM usr, region WHERE (k + r_regionkey) % 3 = 0)"""


def customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as a domain table whose spaces are regions, and its hidden rows: those with debts."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("space"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey").withColumn("id", F.col("c_custkey").cast("string"))
    crdt = rows.select("space", F.lit("customer").alias("tbl"), F.col("id").alias("row_id"), F.when(F.col("c_acctbal") < 0, 3).otherwise(0).alias("visibility"))
    return rows, visibility.hidden_rows(crdt)


def members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    users = table(spark, sf_dir, "nation").select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("user"), F.col("n_nationkey").alias("k"))
    regions = table(spark, sf_dir, "region").select("r_regionkey")
    # each user meets the regions of one residue: an equi join
    keyed = regions.withColumn("m", (3 - F.col("r_regionkey") % 3) % 3)
    rows = users.withColumn("m", F.col("k") % 3).join(keyed, "m")
    role = F.when(F.col("k") * F.col("r_regionkey") % 2 == 0, "readOnly").otherwise("readWrite")
    return users.select("user"), rows.select("user", F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("space"), role.alias("role"))


@query(f"WITH {CUST} SELECT c_custkey, c_name FROM cust WHERE NOT hid")
def visible_rows(spark, sf_dir):
    """All visible rows, as an administrator reads them."""
    rows, hidden = customers(spark, sf_dir)
    return visibility.find(visibility.visible(rows, hidden)).select("c_custkey", "c_name")


@query(f"WITH {CUST} SELECT count(*) AS n FROM cust WHERE NOT hid AND c_mktsegment = 'BUILDING'")
def visible_count(spark, sf_dir):
    """The count of visible rows under a condition."""
    rows, hidden = customers(spark, sf_dir)
    return visibility.count(visibility.visible(rows, hidden), F.col("c_mktsegment") == "BUILDING")


@query(f"WITH {CUST} SELECT c_custkey, c_acctbal FROM cust WHERE NOT hid ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def paged_find(spark, sf_dir):
    """A page, taken after visibility (O1, O2)."""
    rows, hidden = customers(spark, sf_dir)
    return visibility.find(visibility.visible(rows, hidden), order_by=[F.desc("c_acctbal"), F.col("c_custkey")], limit=20, offset=10).select("c_custkey", "c_acctbal")


@query(f"WITH {CUST} SELECT c_custkey FROM cust WHERE NOT hid ORDER BY c_acctbal, c_custkey LIMIT 1 OFFSET 2")
def find_first_row(spark, sf_dir):
    """The third row of an order."""
    rows, hidden = customers(spark, sf_dir)
    return visibility.find(visibility.visible(rows, hidden), order_by=[F.col("c_acctbal"), F.col("c_custkey")], limit=1, offset=2).select("c_custkey")


@query(f"WITH {CUST} SELECT c_custkey, c_name FROM cust WHERE NOT hid AND id = '42'")
def find_by_id(spark, sf_dir):
    """A point lookup through visibility (S3)."""
    rows, hidden = customers(spark, sf_dir)
    return visibility.find(visibility.visible(rows, hidden), where=F.col("id") == "42", limit=1).select("c_custkey", "c_name")


@query(f"WITH {CUST} SELECT c_custkey FROM cust JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 3 = 0")
def find_by_ids(spark, sf_dir):
    """Rows of a set of ids, hidden ones too, by a semi join."""
    rows, _ = customers(spark, sf_dir)
    wanted = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return visibility.by_ids(rows, wanted, "c_nationkey").select("c_custkey")


@query(f"WITH {CUST}, {MEMBERS}, mine AS (SELECT space FROM mem WHERE u = 'u1') SELECT c_custkey, hid AS hidden FROM cust WHERE space IN (SELECT space FROM mine)")
def include_hidden_rows(spark, sf_dir):
    """A member's rows with the hidden ones: tenancy still holds."""
    rows, hidden = customers(spark, sf_dir)
    own = members(spark, sf_dir)[1].where("user = 'u1'").select("space")
    seen = visibility.visible(rows, hidden, spaces=own, include_hidden=True)
    return seen.select("c_custkey", (F.col("c_acctbal") < 0).alias("hidden"))


@query(f"WITH {CUST}, {MEMBERS}, mine AS (SELECT space FROM mem WHERE u = 'u2' UNION SELECT 'u2') SELECT c_custkey FROM cust WHERE NOT hid AND space IN (SELECT space FROM mine)")
def space_isolation(spark, sf_dir):
    """Rows of all spaces a user belongs to."""
    rows, hidden = customers(spark, sf_dir)
    users, joined = members(spark, sf_dir)
    own = spaces.member_spaces(users, joined).where("user = 'u2'").select("space")
    return visibility.visible(rows, hidden, spaces=own).select("c_custkey")


@query(f"WITH {CUST} SELECT c_custkey FROM cust WHERE NOT hid AND space IN ('r1', 'r3')")
def space_filter(spark, sf_dir):
    """Rows of named spaces."""
    rows, hidden = customers(spark, sf_dir)
    return visibility.visible(rows, hidden, spaces=["r1", "r3"]).select("c_custkey")


@query(f"WITH {CUST} SELECT c_custkey FROM cust WHERE false")
def no_space_fails_closed(spark, sf_dir):
    """Without any space nothing is seen (F2)."""
    rows, hidden = customers(spark, sf_dir)
    return visibility.visible(rows, hidden, spaces=[]).select("c_custkey")


@query(f"WITH {CUST} SELECT o_orderkey, c_name FROM orders LEFT JOIN cust ON CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END = c_custkey WHERE c_custkey IS NULL OR NOT hid")
def include_object(spark, sf_dir):
    """Orders with their customer: a hidden customer hides the order, a missing one does not."""
    rows, hidden = customers(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).cast("string").alias("fk"))
    target = rows.select("space", "id", "c_name")
    return visibility.include_object(orders, target, hidden, fk="fk", target_id="id").select("o_orderkey", "c_name")


@query(f"""WITH {CUST}, k AS (SELECT c_nationkey, string_agg(id, ',' ORDER BY c_custkey) AS ids, count(*) AS n FROM cust WHERE NOT hid GROUP BY c_nationkey)
  SELECT n_nationkey, coalesce(ids, '') AS ids, CAST(coalesce(n, 0) AS INTEGER) AS n FROM nation LEFT JOIN k ON n_nationkey = c_nationkey""")
def include_list(spark, sf_dir):
    """Nations with all their visible customers in order."""
    rows, hidden = customers(spark, sf_dir)
    seen = visibility.visible(rows, hidden).select("c_nationkey", "c_custkey", "id")
    out = visibility.include_list(table(spark, sf_dir, "nation"), seen, root_id="n_nationkey", fk="c_nationkey", columns=["id"], order_by=["c_custkey"])
    return out.select("n_nationkey", F.array_join(F.transform("children", lambda c: c["id"]), ",").alias("ids"), F.size("children").alias("n"))


@query(f"""WITH {CUST}, k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS k FROM cust WHERE NOT hid),
  l AS (SELECT c_nationkey, string_agg(id, ',' ORDER BY k) AS ids FROM k WHERE k BETWEEN 2 AND 4 GROUP BY c_nationkey)
  SELECT n_nationkey, coalesce(ids, '') AS ids FROM nation LEFT JOIN l ON n_nationkey = c_nationkey""")
def include_list_paged(spark, sf_dir):
    """Three customers of each nation, after the first."""
    rows, hidden = customers(spark, sf_dir)
    seen = visibility.visible(rows, hidden).select("c_nationkey", "c_acctbal", "c_custkey", "id")
    out = visibility.include_list(table(spark, sf_dir, "nation"), seen, root_id="n_nationkey", fk="c_nationkey", columns=["id"], order_by=["c_acctbal", "c_custkey"], limit=3, offset=1)
    return out.select("n_nationkey", F.array_join(F.transform("children", lambda c: c["id"]), ",").alias("ids"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)")
def rows_without_metadata(spark, sf_dir):
    """Ids that have no metadata row."""
    known = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return visibility.required(table(spark, sf_dir, "orders").select("o_custkey").distinct(), known, ["o_custkey"])


@query(f"WITH {CUST} SELECT id FROM cust WHERE hid UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'")
def hidden_or_override(spark, sf_dir):
    """Union of two id sets, without duplicates."""
    _, hidden = customers(spark, sf_dir)
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("id"))
    return hidden.select(F.col("row_id").alias("id")).union(urgent).distinct()


@query(f"WITH {CUST} SELECT id, hid AS hide FROM cust WHERE hid <> (c_custkey % 4 = 0)")
def hidden_diff(spark, sf_dir):
    """Rows to hide and to show after the hidden set changed: differences both ways."""
    rows, hidden = customers(spark, sf_dir)
    new, old = hidden.select(F.col("row_id").alias("id")), rows.where("c_custkey % 4 = 0").select("id")
    hide = new.join(old, "id", "left_anti").withColumn("hide", F.lit(True))
    return hide.unionByName(old.join(new, "id", "left_anti").withColumn("hide", F.lit(False)))


@query(f"WITH {MEMBERS} SELECT u AS \"user\", u AS space FROM usr UNION SELECT u, space FROM mem")
def member_spaces(spark, sf_dir):
    """Personal and shared spaces of all users."""
    return spaces.member_spaces(*members(spark, sf_dir))


@query(f"WITH {MEMBERS} SELECT u AS \"user\", u AS space, 'readWrite' AS role FROM usr UNION ALL SELECT u, space, role FROM mem")
def member_grants(spark, sf_dir):
    """Roles of all users; one's own space is always writable."""
    users, rows = members(spark, sf_dir)
    personal = users.select("user", F.col("user").alias("space"), F.lit("readOnly").alias("role"))
    return spaces.grants(users, rows.unionByName(personal))


@query(f"""WITH {MEMBERS}, loc AS (SELECT u, CASE WHEN k % 4 = 0 THEN 'r9' ELSE space END AS space, 'readOnly' AS role FROM mem JOIN usr USING (u)),
  l AS (SELECT DISTINCT * FROM loc)
  SELECT coalesce(l.u, m.u) AS "user", coalesce(l.space, m.space) AS space, coalesce(m.role, l.role) AS role,
    CASE WHEN m.u IS NULL THEN 'delete' WHEN l.u IS NULL THEN 'insert' WHEN l.role <> m.role THEN 'update' ELSE 'keep' END AS action
  FROM l FULL JOIN mem m ON l.u = m.u AND l.space = m.space""")
def membership_prune(spark, sf_dir):
    """What a follower's membership table needs."""
    users, rows = members(spark, sf_dir)
    n = F.substring("user", 2, 9).cast("int")
    local = rows.select("user", F.when(n % 4 == 0, "r9").otherwise(F.col("space")).alias("space"), F.lit("readOnly").alias("role")).distinct()
    return spaces.pruned(local, rows)


@query(f"WITH {MEMBERS} SELECT u AS \"user\", space, role FROM mem WHERE NOT (space = 'r2' AND u IN (SELECT u FROM usr WHERE k < 10)) UNION ALL SELECT u, 'r2', 'readWrite' FROM usr WHERE k < 10")
def grant_all(spark, sf_dir):
    """Granting a role in a space to many users."""
    users, rows = members(spark, sf_dir)
    some = users.where(F.substring("user", 2, 9).cast("int") < 10)
    return spaces.granted_all(rows, some, rows.select("space").distinct(), "r2", "readWrite")


@query(f"""WITH {EV}, {MEMBERS}, ch AS (SELECT event_id, 'u' || (user_id % 25) AS u, 'r' || (event_id % 5) AS space FROM ev)
  SELECT event_id FROM ch WHERE NOT EXISTS (SELECT 1 FROM mem WHERE mem.u = ch.u AND mem.space = ch.space AND role = 'readWrite')""")
def unauthorized_write(spark, sf_dir):
    """Changes by users who may not write their space."""
    log = event_log(spark, sf_dir)
    changes = log.select("event_id", F.concat(F.lit("u"), (F.col("user_id") % 25).cast("string")).alias("user"), F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("space"))
    return spaces.unauthorized(changes, spaces.grants(*members(spark, sf_dir))).select("event_id")


@query(f"WITH {EV} SELECT event_id, 's' || (user_id % 3) AS owner_space FROM ev WHERE space <> 's' || (user_id % 3)")
def ownership_collision(spark, sf_dir):
    """Changes of rows that another space owns."""
    log = event_log(spark, sf_dir)
    owners = log.select("tbl", "row_id", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("owner_space")).distinct()
    return merge.ownership_collisions(log, owners).select("event_id", "owner_space")


V = "v AS (SELECT event_type AS type, row_id, CASE WHEN user_id % 2 = 0 THEN space END AS owner, ms, c, n, event_id FROM ev)"


@query(f"WITH {EV}, {V} SELECT type, row_id, owner, min(ms) AS first_seen, max(ms) AS last_seen, max({STAMP}).ms AS hlc_ms, count(*) AS occurrences FROM v GROUP BY type, row_id, owner")
def violations_rollup(spark, sf_dir):
    """Violations counted by a key that may hold nulls."""
    out = spaces.violations(_violations(spark, sf_dir), ["type", "row_id", "owner"])
    return out.select("type", "row_id", "owner", "first_seen", "last_seen", F.col("hlc.ms").alias("hlc_ms"), "occurrences")


@query(f"WITH {EV}, {V} SELECT type, row_id, owner, min(ms) AS first_seen, max(ms) AS last_seen, count(*) AS occurrences FROM v GROUP BY type, row_id, owner")
def violations_merge(spark, sf_dir):
    """Two stored roll-ups merged."""
    rows, key = _violations(spark, sf_dir), ["type", "row_id", "owner"]
    parts = [spaces.violations(rows.where(F.col("event_id") % 2 == k), key) for k in (0, 1)]
    return spaces.merged_violations(*parts, key).drop("hlc")


def _violations(spark, sf_dir) -> DataFrame:
    log = event_log(spark, sf_dir)
    return log.select("event_id", F.col("event_type").alias("type"), "row_id", F.when(F.col("user_id") % 2 == 0, F.col("space")).alias("owner"), F.col("hlc.ms").alias("seen_at"), "hlc")


@query(f"""WITH {EV}, m AS (SELECT space, max({STAMP}) AS k FROM ev WHERE space <> 's3' GROUP BY space), s AS (SELECT DISTINCT space FROM ev)
  SELECT s.space, 'node-' || s.space AS node, coalesce(k.ms, 0) AS hlc_ms, coalesce(k.c, 0) AS hlc_counter FROM s LEFT JOIN m USING (space)""")
def node_per_space(spark, sf_dir):
    """A server's nodes and where their clocks start."""
    log = event_log(spark, sf_dir)
    out = spaces.assigned_nodes(log.select("space").distinct(), log.where("space <> 's3'"))
    return out.select("space", "node", F.col("last.ms").alias("hlc_ms"), F.col("last.counter").alias("hlc_counter"))


@query(f"WITH {EV} SELECT DISTINCT space, 'device' AS node, (SELECT max(ms) FROM ev) AS hlc_ms FROM ev")
def shared_node(spark, sf_dir):
    """A device's one node for all its spaces."""
    log = event_log(spark, sf_dir)
    out = spaces.assigned_nodes(log.select("space").distinct(), log, shared_node="device")
    return out.select("space", "node", F.col("last.ms").alias("hlc_ms"))
