"""Queries on gates, local plans and projections of some rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hlc as clocks
from ..functions import values
from ..operators import merge, projection, record, spaces
from . import schema
from .constraints import EDGES, PARTS, SUPPLIER_HIDDEN, WORLD, parts, world
from .logs import LOG, PROFILE, profile_log
from .outbound import WR, writes
from .registry import query, table
from .schema import UniqueIndex


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'unknown' WHEN c_custkey % 4 = 2 OR c_mktsegment = 'BUILDING' THEN 'compatible' ELSE 'mismatch' END AS verdict FROM customer")
def schema_gate(spark, sf_dir):
    """Whether a peer's tables are the same, by their hash."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    peer = F.when(k == 1, "").when(k == 2, F.md5("c_mktsegment")).when(k == 3, F.md5(F.lit("BUILDING")))
    return c.select("c_custkey", schema.compatibility(F.md5("c_mktsegment"), peer).alias("verdict"))


@query("""WITH q AS (SELECT event_id, user_id % 40 AS u, event_id % 30 AS s FROM events), m AS (SELECT DISTINCT user_id % 40 AS u, value < 50 AS w, CAST(event_id // 7 % 30 AS BIGINT) AS s FROM events WHERE event_type = 'signup'), r AS (SELECT u, s, bool_or(w) AS w FROM m GROUP BY u, s)
  SELECT event_id, CASE WHEN q.u = q.s OR w THEN 'allowed' WHEN w IS NULL THEN 'notMember' ELSE 'readOnly' END AS outcome FROM q LEFT JOIN r ON q.u = r.u AND q.s = r.s""")
def acting_space(spark, sf_dir):
    """Who may act in a space: members with a writing role, in two refusals."""
    e = table(spark, sf_dir, "events")
    user = (F.col("user_id") % 40).cast("string").alias("user")
    requests = e.select("event_id", user, (F.col("event_id") % 30).cast("string").alias("space"))
    role = F.when(F.col("value") < 50, "readWrite").otherwise("readOnly")
    members = e.where("event_type = 'signup'").select(user, (F.floor(F.col("event_id") / 7) % 30).cast("string").alias("space"), role.alias("role")).distinct()
    return spaces.acting(requests, members).select("event_id", "outcome")


@query("SELECT n_name AS name, n_nationkey % 2 = 0 AS found FROM nation UNION ALL SELECT DISTINCT 'X' || CAST(c_nationkey AS VARCHAR), false FROM customer")
def node_registration(spark, sf_dir):
    """Nodes known so far, and each new one once."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("known"))
    named = F.concat(F.lit("X"), F.col("c_nationkey").cast("string")).alias("name")
    seen = table(spark, sf_dir, "customer").select(named).unionByName(n.select("name"))
    return spaces.registered(n.where("known"), seen, ["name"])


@query(f"""WITH {LOG}, b AS (SELECT space, row_id, min({{'ms': ms, 'c': c, 'n': n}}) AS k0 FROM log WHERE event_type = 'signup' GROUP BY space, row_id),
  g AS (SELECT space, row_id, cl, ms, c, n, reason FROM log WHERE cl IS NOT NULL UNION ALL
    SELECT space, row_id, 1, ms, c, n, 'userInsert' FROM log JOIN b USING (space, row_id) WHERE event_type = 'signup' AND {{'ms': ms, 'c': c, 'n': n}} > k0),
  m AS (SELECT space, row_id, max({{'cl': cl, 'ms': ms, 'c': c, 'n': n, 'r': reason}}) AS k FROM g SEMI JOIN b USING (space, row_id) GROUP BY space, row_id)
  SELECT row_id, k.cl AS cl_flag, k.ms AS hlc_ms, k.r AS reason FROM m""")
def known_insert_generation(spark, sf_dir):
    """Inserts of rows that are known make a generation of their own (M5)."""
    state = merge.state_of(profile_log(spark, sf_dir), PROFILE, with_later_inserts=True)
    return state.generations.select("row_id", "cl_flag", F.col("hlc.ms").alias("hlc_ms"), "reason")


@query("""WITH i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS k, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 25 END AS nation FROM orders),
  f AS (SELECT k, min(o_orderkey) AS o FROM i WHERE k IS NOT NULL GROUP BY k)
  SELECT c_custkey AS row_id, c_custkey AS k, o_orderstatus, coalesce(nation, 7) AS nation, o_orderkey FROM customer JOIN f ON f.k = c_custkey JOIN i ON i.o_orderkey = f.o WHERE c_custkey % 2 = 0""")
def upsert_inputs(spark, sf_dir):
    """The input that each row of an upsert answers to: the first of a conflict key, references with their defaults."""
    n = F.col("o_orderkey")
    incoming = table(spark, sf_dir, "orders").select("o_orderkey", F.when(n % 11 != 0, F.col("o_custkey")).alias("k"), "o_orderstatus", F.when(n % 3 != 0, n % 25).alias("nation"))
    stored = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("row_id"), F.col("c_custkey").alias("k"))
    return record.upsert_inputs(stored, incoming, ["k"], order="o_orderkey", defaults={"nation": F.lit(7).cast("long")})


@query("""SELECT c_custkey AS row_id, 'c_name' AS "column", c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END FROM customer WHERE c_custkey % 4 < 2""")
def upsert_overlays(spark, sf_dir):
    """Authored values of an upsert: what was given, nulls too."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("row_id"), "c_name", F.when(k % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return record.authored_overlays(rows, {"c_name": F.lit(True), "c_mktsegment": F.col("row_id") % 4 < 2})


@query("""WITH s AS (SELECT o_custkey, o_orderkey, (o_orderkey // 3) % 4 AS x FROM orders), g AS (SELECT *, CASE WHEN x = lag(x) OVER w THEN 0 ELSE 1 END AS st FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
  SELECT o_custkey, o_orderkey, CAST(sum(st) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS grp FROM g""")
def explicit_null_groups(spark, sf_dir):
    """Consecutive rows with the same explicit nulls are one group."""
    x = F.floor(F.col("o_orderkey") / 3) % 4
    nulls = F.when(x == 0, F.array().cast("array<string>")).when(x == 1, F.array(F.lit("a"))).when(x == 2, F.array(F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", nulls.alias("nulls"))
    return record.null_groups(rows, F.col("nulls"), order="o_orderkey", by="o_custkey").select("o_custkey", "o_orderkey", "grp")


@query("""SELECT o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority, count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1, 2""")
def grouped_updates(spark, sf_dir):
    """Rows that get the same values are one statement."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return record.grouped_updates(rows, ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'w' || c_custkey END ELSE c_name END AS c_name, c_acctbal FROM customer")
def bulk_update(spark, sf_dir):
    """Different values for many rows in one join."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    k = F.col("c_custkey")
    return record.applied(c, c.where(k % 3 == 0).select("c_custkey", F.when(k % 2 == 0, F.concat(F.lit("w"), k.cast("string"))).alias("c_name")), ["c_name"], "c_custkey")


UID = "'0000000' || (c_custkey % 10) || '-ABCD-4000-8000-00000000000' || (c_custkey % 7)"


@query(f"SELECT c_name, CASE WHEN c_custkey % 5 <> 0 THEN lower({UID}) END AS ref FROM customer")
def sanitised_columns(spark, sf_dir):
    """Arriving rows with known columns only, ids in canonical form."""
    k = F.col("c_custkey")
    ref = F.concat(F.lit("0000000"), (k % 10).cast("string"), F.lit("-ABCD-4000-8000-00000000000"), (k % 7).cast("string"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.lit(1).alias("space_id"), "c_name", F.when(k % 5 == 0, "none").otherwise(ref).alias("ref"), F.lit(0).alias("unknown"))
    return record.sanitised(rows, ["id", "space_id", "c_name", "ref"], ["ref"])


@query(f"WITH {WR} SELECT row_id FROM w WHERE seq % 6 = 0")
def foreign_space_writes(spark, sf_dir):
    """Writes of another space than the acting one."""
    rows = writes(spark, sf_dir).withColumn("space", F.when(F.col("seq") % 6 == 0, "t").otherwise("s"))
    return record.foreign_writes(rows, "s").select("row_id")


@query("""SELECT event_id, CASE WHEN d % 1000 = 0 THEN (d // 1000) || 'ms' ELSE printf('%.3fms', d / 1000.0) END AS drift FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id * 1000 ELSE event_id * 37 END AS d FROM events)""")
def drift_text(spark, sf_dir):
    """Clock drift as text (X11)."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", clocks.drift_text(F.when(n % 3 == 0, n * 1000).otherwise(n * 37)).alias("drift"))


@query("""SELECT o_orderkey, CASE WHEN kind = 'json' THEN NULL WHEN nullable THEN 'null' WHEN kind = 'string' THEN 'text' WHEN kind = 'uuid' AND NOT fk THEN 'uuid' END AS release
  FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'uuid' WHEN 2 THEN 'json' ELSE 'bigint' END AS kind, o_custkey % 2 = 0 AS nullable, o_orderstatus = 'F' AS fk FROM orders)""")
def release_kinds(spark, sf_dir):
    """How the columns of a registry can give up a unique claim."""
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "string").when(k == 1, "uuid").when(k == 2, "json").otherwise("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", values.release(F.col("o_custkey") % 2 == 0, kind, F.col("o_orderstatus") == "F").alias("release"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 OR p_partkey % 5 = 0 THEN NULL ELSE p_brand || chr(31) || CAST(p_size AS VARCHAR) END AS claim, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN lower(p_brand) END, '') AS text FROM part""")
def canonical_claims(spark, sf_dir):
    """Tuples and values as projection compares them."""
    brand = F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", values.claim_key(brand, F.when(F.col("p_size") % 4 != 0, F.col("p_size"))).alias("claim"), values.canonical(brand, "uuid").alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN false ELSE o_orderkey % 3 <> 0 OR o_orderstatus = 'F' END AS same, CASE WHEN o_orderkey % 2 = 0 THEN false ELSE true END AS plain FROM orders")
def deep_equality(spark, sf_dir):
    """Maps are equal whatever their order; null equals null only."""
    n = F.col("o_orderkey")
    a = F.create_map(F.lit("x"), F.col("o_orderstatus"), F.lit("y"), F.col("o_orderpriority"))
    b = F.create_map(F.lit("y"), F.col("o_orderpriority"), F.lit("x"), F.when(n % 3 == 0, "F").otherwise(F.col("o_orderstatus")))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", values.same_map(a, F.when(n % 7 != 0, b)).alias("same"), values.same_value(none, F.when(n % 2 == 0, F.col("o_orderstatus"))).alias("plain"),
    )


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower({UID}) END AS of_text, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS of_bytes FROM (SELECT *, md5(c_name) AS h FROM customer)""")
def uuid_values(spark, sf_dir):
    """UUIDs from text or sixteen bytes."""
    k = F.col("c_custkey")
    text = F.concat(F.when(k % 3 == 0, "x").otherwise(" "), F.lit("0000000"), (k % 10).cast("string"), F.lit("-ABCD-4000-8000-00000000000"), (k % 7).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", values.try_uuid(text).alias("of_text"), values.uuid_of_bytes(F.unhex(F.md5("c_name"))).alias("of_bytes"))


@query("""SELECT c_custkey, c_mktsegment AS of_text, CASE c_custkey % 3 WHEN 0 THEN '00000000-0000-4000-8000-000000000001' END AS of_uuid FROM customer""")
def column_defaults(spark, sf_dir):
    """Declared defaults: quotes go, generated and broken ids are none."""
    k = F.col("c_custkey") % 3
    uid = F.when(k == 0, "'00000000-0000-4000-8000-000000000001'").when(k == 1, "random_v7").otherwise("'broken'")
    quoted = F.concat(F.lit("'"), F.col("c_mktsegment"), F.lit("'"))
    return table(spark, sf_dir, "customer").select("c_custkey", values.default_value(quoted, "string").alias("of_text"), values.default_value(uid, "uuid").alias("of_uuid"))


@query("""WITH w AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'line' WHEN 1 THEN 'line' WHEN 2 THEN 'part' WHEN 3 THEN 'part' ELSE 'orders' END AS tbl, CASE event_id % 5 WHEN 0 THEN 'l_suppkey' WHEN 1 THEN 'l_comment' WHEN 2 THEN 'id' WHEN 3 THEN 'p_name' ELSE 'o_custkey' END AS col FROM events)
  SELECT event_id, col IN ('l_suppkey', 'id', 'o_custkey') AS affects, tbl = 'line' AS by_default FROM w""")
def reference_helpers(spark, sf_dir):
    """Writes that may change references, and those of tables that fall back on defaults."""
    k = F.col("event_id") % 5
    tbl = F.when(k < 2, "line").when(k < 4, "part").otherwise("orders")
    column = F.when(k == 0, "l_suppkey").when(k == 1, "l_comment").when(k == 2, "id").when(k == 3, "p_name").otherwise("o_custkey")
    return table(spark, sf_dir, "events").select("event_id", schema.affects_references(EDGES, tbl, column).alias("affects"), tbl.isin(*schema.default_consumers(EDGES)).alias("by_default"))


#: A table of which two columns are not direct.
NOTE = [schema.Table("note", tuple(schema.Column(c) for c in ("name", "score", "folder", "code")), (schema.ForeignKey("note", "folder", "folder"),), (UniqueIndex(("code",), "code"),))]


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'name' ELSE 'score' END AS \"column\" FROM events WHERE event_id % 4 < 2")
def direct_writes(spark, sf_dir):
    """Authored values of columns that no constraint names need no projection."""
    k = F.col("event_id") % 4
    column = F.when(k == 0, "name").when(k == 1, "score").when(k == 2, "folder").otherwise("code")
    return table(spark, sf_dir, "events").select("event_id", column.alias("column")).where(F.col("column").isin(*schema.direct_columns(NOTE, "note")))


@query(f"""WITH {WORLD} SELECT 'orders' AS tbl, CAST(o_orderkey AS VARCHAR) AS row_id, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM oh) THEN 5 ELSE 0 END AS visibility FROM od WHERE o_orderkey % 40 = 0
  UNION ALL SELECT 'line', line_id, CASE WHEN hidden THEN 5 ELSE 0 END FROM lh JOIN ln USING (line_id) JOIN od ON o_orderkey = l_orderkey WHERE l_orderkey % 40 = 0""")
def project_seeds(spark, sf_dir):
    """Some orders projected anew, from what they hang together with alone."""
    nodes, refs = world(spark, sf_dir)
    seeds = nodes.where("tbl = 'orders' and cast(row_id as bigint) % 40 = 0").select("tbl", "row_id")
    found = projection.project(nodes, refs, seeds)
    own = seeds.unionByName(refs.where("col = 'l_orderkey'").join(seeds.select(F.col("row_id").alias("value")), "value", "left_semi").select("tbl", "row_id"))
    return found.join(own, ["tbl", "row_id"], "left_semi").select("tbl", "row_id", "visibility")


@query(f"""WITH {WORLD}, {SUPPLIER_HIDDEN}, one AS (SELECT NOT hidden AS live FROM sh WHERE s_suppkey = 1), l AS (SELECT ln.*, (SELECT live FROM one) AS live FROM ln WHERE l_orderkey % 40 = 0)
  SELECT line_id AS row_id, 'l_partkey' AS col, CASE WHEN p_size > 45 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS shown, CASE WHEN p_size > 45 THEN 'foreignKeySetNull' END AS reason FROM l JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM od)
  UNION ALL SELECT line_id, 'l_suppkey', CASE WHEN hidden AND live THEN '1' ELSE CAST(l_suppkey AS VARCHAR) END, CASE WHEN hidden AND live THEN 'foreignKeySetDefault' END FROM l JOIN sh ON s_suppkey = l_suppkey WHERE l_orderkey IN (SELECT o_orderkey FROM od)
  UNION ALL SELECT line_id, 'l_orderkey', CAST(l_orderkey AS VARCHAR), NULL FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM od)""")
def project_values(spark, sf_dir):
    """What the references of some orders' lines show, projected anew from their scope."""
    nodes, refs = world(spark, sf_dir)
    seeds = nodes.where("tbl = 'orders' and cast(row_id as bigint) % 40 = 0").select("tbl", "row_id")
    values_shown = projection.project_values(nodes, refs, seeds)[1]
    return values_shown.where("tbl = 'line'").select("row_id", "col", "shown", "reason")


@query(f"""WITH {PARTS}, s AS (SELECT p_brand, p_size, p_type FROM p WHERE CAST(row_id AS BIGINT) % 100 = 0 UNION SELECT p_brand, p_size % 7, p_type FROM p WHERE CAST(row_id AS BIGINT) % 100 = 0),
  f AS (SELECT row_id, p_brand, p_size, p_type FROM p WHERE (p_brand, p_size) IN (SELECT p_brand, p_size FROM s) OR CAST(row_id AS BIGINT) % 100 = 0),
  aff AS (SELECT row_id FROM f UNION SELECT row_id FROM p WHERE (p_type, p_size) IN (SELECT p_type, p_size FROM f UNION SELECT p_type, p_size FROM s)),
  a AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size, hidden ORDER BY ms, row_id) AS k FROM p),
  b AS (SELECT row_id, p_brand, p_type, hidden, ms, CASE WHEN hidden OR k > 1 THEN NULL ELSE p_size END AS p_size, hidden OR k > 1 AS free FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_size, hidden ORDER BY ms, row_id) AS k2 FROM b)
  SELECT row_id, CAST(CASE WHEN p_size IS NOT NULL AND k2 > 1 THEN NULL ELSE p_size END AS INTEGER) AS p_size,
    CASE WHEN free THEN CASE WHEN hidden THEN 'hiddenUniqueRelease' ELSE 'uniqueConflict' END WHEN p_size IS NOT NULL AND k2 > 1 THEN 'uniqueConflict' END AS unique_reason FROM c SEMI JOIN aff USING (row_id)""")
def project_claims(spark, sf_dir):
    """Unique claims that some parts' new sizes may change, projected anew from the parts they contest tuples with."""
    rows = parts(spark, sf_dir)
    indexes = [UniqueIndex(("p_brand", "p_size"), "p_size"), UniqueIndex(("p_type", "p_size"), "p_size")]
    seeds = rows.where(F.col("row_id").cast("bigint") % 100 == 0)
    found = projection.project_unique(rows, indexes, {"p_size": "null"}, seeds.select("space", "row_id"), seeds.withColumn("p_size", (F.col("p_size") % 7).cast("int")))
    return found.select("row_id", "p_size", "unique_reason")


@query(f"""WITH {WORLD}, x AS (SELECT line_id, l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey END ELSE l_partkey END AS v FROM ln)
  SELECT line_id AS row_id, CAST(v AS VARCHAR) AS value FROM x WHERE v IS NOT NULL""")
def planned_references(spark, sf_dir):
    """References as planned writes would leave them; a null takes one away."""
    refs = world(spark, sf_dir)[1]
    own = refs.where("col = 'l_partkey'")
    order = F.split_part("row_id", F.lit("-"), F.lit(1)).cast("bigint")
    suppliers = refs.where("col = 'l_suppkey'").where(order % 3 == 0).select("tbl", "row_id", F.lit("l_partkey").alias("col"), F.when(order % 2 == 0, F.col("value")).alias("value"))
    return projection.overlaid(own, suppliers).select("row_id", "value")


@query(f"""WITH {WORLD} SELECT line_id AS row_id, CASE WHEN l_partkey % 10 = 0 AND l_orderkey % 50 <> 0 THEN 'stored-' || line_id ELSE CAST(l_partkey AS VARCHAR) END AS shown FROM ln""")
def restored_references(spark, sf_dir):
    """References to rows that are still to be inserted keep their stored value."""
    shown = world(spark, sf_dir)[1].where("col = 'l_partkey'").select("tbl", "row_id", "col", "target_tbl", F.col("value").alias("shown"))
    stored = shown.select("tbl", "row_id", "col", F.concat(F.lit("stored-"), F.col("row_id")).alias("value"))
    parts_to_come = table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.lit("part").alias("tbl"), F.col("p_partkey").cast("string").alias("row_id"))
    lines_to_come = shown.where(F.split_part("row_id", F.lit("-"), F.lit(1)).cast("bigint") % 50 == 0).select("tbl", "row_id")
    return projection.restored_references(shown, stored, parts_to_come.unionByName(lines_to_come)).select("row_id", "shown")


@query(f"""WITH {PARTS}, r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, hidden ORDER BY ms, row_id) AS k FROM p), n AS (SELECT row_id, p_type AS a FROM r WHERE hidden OR k > 1),
  s AS (SELECT row_id, CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'old' END AS v FROM p WHERE p_size % 2 = 0)
  SELECT coalesce(n.row_id, s.row_id) AS row_id, a AS value, CASE WHEN s.row_id IS NULL THEN 'insert' WHEN n.row_id IS NULL THEN 'delete' ELSE 'update' END AS action
  FROM n FULL JOIN s ON n.row_id = s.row_id WHERE s.row_id IS NULL OR n.row_id IS NULL OR a IS DISTINCT FROM v""")
def insert_attempts(spark, sf_dir):
    """What the store of attempted values needs after a projection."""
    rows = parts(spark, sf_dir)
    shown = projection.unique(rows, [UniqueIndex(("p_brand", "p_type"), "p_type")], {"p_type": "text"})
    wanted = rows.select("row_id", F.col("p_type").alias("authored")).join(shown.select("row_id", F.col("p_type").alias("shown")), "row_id")
    stored = rows.where("p_size % 2 = 0").select("row_id", F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("old").alias("value"))
    return projection.attempts(wanted, stored, ["row_id"])


@query(f"""WITH {WORLD}, {SUPPLIER_HIDDEN}, v AS (SELECT CAST(s_suppkey AS VARCHAR) AS row_id, CASE WHEN s_acctbal < 0 THEN CASE WHEN hidden THEN 3 ELSE 2 END ELSE 0 END AS visibility FROM supplier JOIN sh USING (s_suppkey))
  SELECT row_id, visibility, CASE WHEN CAST(row_id AS BIGINT) % 4 > 0 THEN CAST(CAST(row_id AS BIGINT) % 4 AS INTEGER) END AS before FROM v WHERE visibility IS DISTINCT FROM CASE WHEN CAST(row_id AS BIGINT) % 4 > 0 THEN CAST(row_id AS BIGINT) % 4 END""")
def visibility_writer(spark, sf_dir):
    """Rows whose stored visibility has to be written."""
    nodes, refs = world(spark, sf_dir)
    shown = projection.visibility(nodes, refs).where("tbl = 'supplier'")
    key = F.col("row_id").cast("bigint")
    stored = nodes.where("tbl = 'supplier'").where(key % 4 > 0).select("tbl", "row_id", (key % 4).cast("int").alias("visibility"))
    return projection.visibility_writes(stored, shown, ["tbl", "row_id"]).select("row_id", "visibility", "before")
