"""Queries on constraint projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hlc as clocks
from ..operators import projection
from ..sources.shared import staged
from .registry import query, table
from .schema import ForeignKey, UniqueIndex

EDGES = [
    ForeignKey("nation", "n_regionkey", "region", "noAction", nullable=False),
    ForeignKey("customer", "c_nationkey", "nation", "noAction", nullable=False),
    ForeignKey("orders", "o_custkey", "customer", "cascade", nullable=False),
    ForeignKey("line", "l_orderkey", "orders", "cascade", nullable=False),
    ForeignKey("line", "l_partkey", "part", "setNull"),
    ForeignKey("line", "l_suppkey", "supplier", "setDefault", default="1"),
]
IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "line": "line_id"}
#: Deleted by their users; orders of low priority have not arrived.
ARRIVED = "o_orderpriority <> '5-LOW'"
DELETED = {"region": "r_regionkey = 4", "nation": "n_nationkey % 5 = 0", "customer": "c_acctbal < 0", "part": "p_size > 45", "supplier": "s_acctbal < 0"}

WORLD = f"""ln AS (SELECT l_orderkey || '-' || l_linenumber AS line_id, min(l_orderkey) AS l_orderkey, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1),
  od AS (SELECT * FROM orders WHERE {ARRIVED}),
  oh AS (SELECT o_orderkey FROM od JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0),
  lh AS (SELECT line_id, l_orderkey IN (SELECT o_orderkey FROM oh) OR l_orderkey NOT IN (SELECT o_orderkey FROM od) AS hidden FROM ln)"""
SUPPLIER_HIDDEN = """sh AS (SELECT s_suppkey, s_acctbal < 0 AND NOT (EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = 1 AND s_acctbal < 0)
    AND s_suppkey IN (SELECT l_suppkey FROM ln JOIN lh USING (line_id) WHERE NOT hidden)) AS hidden FROM supplier)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with an id of its own; of rows that share order and number the smallest values count."""
    line = table(spark, sf_dir, "lineitem").withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return line.groupBy("line_id").agg(*[F.min(c).alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey")])


def world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes and refs of the star schema as replicated tables; the lines, which both read, are grouped once."""
    names = ("region", "nation", "customer", "part", "supplier")
    tables = {n: table(spark, sf_dir, n) for n in names} | {"orders": table(spark, sf_dir, "orders").where(ARRIVED), "line": staged(lines(spark, sf_dir), "lines")}
    parts = [
        t.select(F.lit(n).alias("tbl"), F.col(IDS[n]).cast("string").alias("row_id"), F.coalesce(F.expr(DELETED.get(n, "false")), F.lit(False)).alias("deleted"), F.lit("userDelete").alias("reason"))
        for n, t in tables.items()
    ]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    return nodes, projection.references(tables, EDGES, IDS)


@query(f"""WITH {WORLD}, {SUPPLIER_HIDDEN}
  SELECT 'region' AS tbl, CAST(r_regionkey AS VARCHAR) AS row_id, CASE WHEN r_regionkey = 4 THEN 2 ELSE 0 END AS visibility FROM region
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 5 = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal >= 0) THEN 2 ELSE 3 END ELSE 0 END FROM nation
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), CASE WHEN c_acctbal < 0 THEN 3 ELSE 0 END FROM customer
  UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), CASE WHEN p_size > 45 THEN 3 ELSE 0 END FROM part
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), CASE WHEN s_acctbal < 0 THEN CASE WHEN hidden THEN 3 ELSE 2 END ELSE 0 END FROM supplier JOIN sh USING (s_suppkey)
  UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey IN (SELECT o_orderkey FROM oh) THEN 5 ELSE 0 END FROM od
  UNION ALL SELECT 'line', line_id, CASE WHEN hidden THEN 5 ELSE 0 END FROM lh""")
def fk_visibility(spark, sf_dir):
    """What deletions, cascades, missing parents and restricting references leave visible."""
    return projection.visibility(*world(spark, sf_dir)).select("tbl", "row_id", "visibility")


@query(f"""WITH {WORLD}, {SUPPLIER_HIDDEN}, one AS (SELECT NOT hidden AS live FROM sh WHERE s_suppkey = 1), l AS (SELECT ln.*, (SELECT live FROM one) AS live FROM ln)
  SELECT line_id AS row_id, 'l_partkey' AS col, CASE WHEN p_size > 45 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS shown, CASE WHEN p_size > 45 THEN 'foreignKeySetNull' END AS reason FROM l JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT line_id, 'l_suppkey', CASE WHEN hidden AND live THEN '1' ELSE CAST(l_suppkey AS VARCHAR) END, CASE WHEN hidden AND live THEN 'foreignKeySetDefault' END FROM l JOIN sh ON s_suppkey = l_suppkey
  UNION ALL SELECT line_id, 'l_orderkey', CAST(l_orderkey AS VARCHAR), CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM od) THEN 'foreignKeyMissingParent' END FROM l""")
def fk_repaired_values(spark, sf_dir):
    """What references show when their targets are hidden or missing."""
    nodes, refs = world(spark, sf_dir)
    own = refs.where("tbl = 'line'")
    return projection.repaired(own, projection.visibility(nodes, refs)).select("row_id", "col", "shown", "reason")


@query(f"""WITH {WORLD} SELECT 'orders' AS tbl, CAST(o_orderkey AS VARCHAR) AS row_id, 'customer' AS lead_tbl FROM oh
  UNION ALL SELECT 'line', line_id, 'customer' FROM ln WHERE l_orderkey IN (SELECT o_orderkey FROM oh)
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'customer' FROM customer WHERE c_acctbal < 0""")
def fk_cascade_closure(spark, sf_dir):
    """Rows that deleted customers take along."""
    nodes, refs = world(spark, sf_dir)
    roots = nodes.where("deleted and tbl = 'customer'")
    return projection.closure(roots, refs.where("action = 'cascade'")).select("tbl", "row_id", F.col("lead.tbl").alias("lead_tbl"))


PRESENT = """SELECT line_id AS row_id, 'l_orderkey' AS col, CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM od) THEN 'absent' WHEN o_orderstatus = 'P' THEN 'hidden' ELSE 'visible' END AS presence FROM ln JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT line_id, 'l_partkey', CASE WHEN p_size > 45 THEN 'hidden' ELSE 'visible' END FROM ln JOIN part ON p_partkey = l_partkey"""


def _crdt(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(ARRIVED)
    part = table(spark, sf_dir, "part")
    rows = orders.select(F.lit("orders").alias("tbl"), F.col("o_orderkey").cast("string").alias("row_id"), F.concat(F.lit("s"), (F.col("o_orderkey") % 2).cast("string")).alias("space"), F.when(F.col("o_orderstatus") == "P", 3).otherwise(0).alias("visibility"))
    return rows.unionByName(part.select(F.lit("part").alias("tbl"), F.col("p_partkey").cast("string").alias("row_id"), F.lit("s0").alias("space"), F.when(F.col("p_size") > 45, 5).otherwise(1).alias("visibility")))


@query(f"WITH {WORLD} {PRESENT}")
def fk_target_presence(spark, sf_dir):
    """Whether referenced rows are absent, hidden or visible."""
    edges = [e for e in EDGES if e.column in ("l_orderkey", "l_partkey")]
    refs = projection.references({"line": lines(spark, sf_dir)}, edges, IDS)
    return projection.target_presence(refs, _crdt(spark, sf_dir)).select("row_id", "col", "presence")


@query(f"""WITH {WORLD}, r AS (SELECT line_id, CAST(l_orderkey AS VARCHAR) AS v, 's' || (l_partkey % 2) AS space, l_orderkey FROM ln)
  SELECT line_id AS row_id, CASE WHEN o_orderkey IS NULL THEN 'missing' WHEN 's' || (o_orderkey % 2) <> space THEN 'otherSpace' ELSE 'hidden' END AS problem
  FROM r LEFT JOIN od ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR 's' || (o_orderkey % 2) <> space OR o_orderstatus = 'P'""")
def fk_invalid_reference(spark, sf_dir):
    """References to missing, hidden or foreign rows."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id")).agg(F.min("l_orderkey").alias("o"), F.min("l_partkey").alias("p"))
    refs = line.select(F.lit("line").alias("tbl"), "row_id", F.lit("orders").alias("target_tbl"), F.col("o").cast("string").alias("value"), F.concat(F.lit("s"), (F.col("p") % 2).cast("string")).alias("space"))
    return projection.invalid_references(refs, _crdt(spark, sf_dir)).select("row_id", "problem")


@query(f"""WITH {WORLD} SELECT 'customer' AS tbl, CAST(c_custkey AS VARCHAR) AS row_id, 'c_nationkey' AS col, 'refused' AS action FROM customer WHERE c_nationkey = 3
  UNION ALL SELECT 'line', line_id, 'l_partkey', 'setNull' FROM ln WHERE l_partkey % 50 = 0
  UNION ALL SELECT 'line', line_id, 'l_suppkey', 'setDefault' FROM ln WHERE l_suppkey = 2
  UNION ALL SELECT 'line', line_id, 'l_orderkey', 'cascade' FROM ln JOIN od ON o_orderkey = l_orderkey WHERE o_orderkey % 40 = 0""")
def fk_local_delete(spark, sf_dir):
    """What deleting rows does to the rows that name them."""
    nodes, refs = world(spark, sf_dir)
    n = F.col("row_id").cast("bigint")
    which = ((F.col("tbl") == "nation") & (n == 3)) | ((F.col("tbl") == "part") & (n % 50 == 0)) | ((F.col("tbl") == "supplier") & (n == 2)) | ((F.col("tbl") == "orders") & (n % 40 == 0))
    deleted = nodes.where("tbl in ('nation', 'part', 'supplier', 'orders')").where(which)
    return projection.local_delete_actions(refs, deleted).select("tbl", "row_id", "col", "action")


PARTS = """p AS (SELECT CAST(p_partkey AS VARCHAR) AS row_id, p_brand, p_type, p_size, p_size > 45 AS hidden, (p_partkey * 7919) % 1000 AS ms FROM part)"""


def parts(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    clock = clocks.hlc((F.col("p_partkey") * 7919) % 1000, F.lit(0), F.lit("n"))
    return p.select(F.col("p_partkey").cast("string").alias("row_id"), F.lit("s").alias("space"), "p_brand", "p_type", "p_size", (F.col("p_size") > 45).alias("hidden"), clock.alias("claim_hlc"))


@query(f"""WITH {PARTS}, r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, hidden ORDER BY ms, row_id) AS k FROM p)
  SELECT row_id, CASE WHEN hidden THEN p_type || '__hidden__' || row_id WHEN k > 1 THEN p_type || '__conflict__' || row_id ELSE p_type END AS p_type,
    CASE WHEN hidden THEN 'hiddenUniqueRelease' WHEN k > 1 THEN 'uniqueConflict' END AS unique_reason FROM r""")
def unique_conflict_text(spark, sf_dir):
    """The earliest claim keeps a tuple, others and hidden rows are marked."""
    out = projection.unique(parts(spark, sf_dir), [UniqueIndex(("p_brand", "p_type"), "p_type")], {"p_type": "text"})
    return out.select("row_id", "p_type", "unique_reason")


@query(f"""WITH {PARTS}, a AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size, hidden ORDER BY ms, row_id) AS k FROM p),
  b AS (SELECT row_id, p_brand, p_type, hidden, ms, CASE WHEN hidden OR k > 1 THEN NULL ELSE p_size END AS p_size, hidden OR k > 1 AS free FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_size, hidden ORDER BY ms, row_id) AS k2 FROM b)
  SELECT row_id, CAST(CASE WHEN p_size IS NOT NULL AND k2 > 1 THEN NULL ELSE p_size END AS INTEGER) AS p_size,
    CASE WHEN free THEN CASE WHEN hidden THEN 'hiddenUniqueRelease' ELSE 'uniqueConflict' END WHEN p_size IS NOT NULL AND k2 > 1 THEN 'uniqueConflict' END AS unique_reason FROM c""")
def unique_conflict_null(spark, sf_dir):
    """Two indexes that share a nullable column, in their order."""
    indexes = [UniqueIndex(("p_brand", "p_size"), "p_size"), UniqueIndex(("p_type", "p_size"), "p_size")]
    return projection.unique(parts(spark, sf_dir), indexes, {"p_size": "null"}).select("row_id", "p_size", "unique_reason")


@query(f"""WITH {PARTS}, u AS (SELECT *, md5(p_brand || p_type) AS h FROM p), v AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS code FROM u),
  r AS (SELECT *, row_number() OVER (PARTITION BY code, hidden ORDER BY ms, row_id) AS k FROM v),
  t AS (SELECT *, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('code:' || code || '__conflict__' || row_id)) AS d FROM r)
  SELECT row_id, CASE WHEN hidden OR k > 1 THEN substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-8' || substr(d, 14, 3) || '-' || CASE substr(d, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8'
      WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substr(d, 18, 3) || '-' || substr(d, 21, 12) ELSE code END AS code FROM t""")
def unique_conflict_uuid(spark, sf_dir):
    """Synthetic ids that release a claim on a UUID column."""
    h = F.md5(F.concat("p_brand", "p_type"))
    code = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    rows = parts(spark, sf_dir).withColumn("code", code)
    return projection.unique(rows, [UniqueIndex(("code",), "code")], {"code": "uuid"}).select("row_id", "code")


@query(f"""WITH {PARTS}, r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, hidden ORDER BY ms, row_id) AS k FROM p)
  SELECT row_id, p_type AS authored, p_type || CASE WHEN hidden THEN '__hidden__' ELSE '__conflict__' END || row_id AS shown FROM r WHERE hidden OR k > 1""")
def attempted_diff(spark, sf_dir):
    """Authored values that projection does not show, which are to be kept."""
    rows = parts(spark, sf_dir)
    shown = projection.unique(rows, [UniqueIndex(("p_brand", "p_type"), "p_type")], {"p_type": "text"})
    return projection.attempted_diff(rows.select("row_id", F.col("p_type").alias("value")), shown.select("row_id", F.col("p_type").alias("value")), ["row_id"])


@query("""SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS born, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN greatest(o_custkey, o_orderkey) ELSE o_custkey END
    WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE epoch_us(o_orderdate) // 1000 END AS claim_ms FROM orders""")
def claim_clocks(spark, sf_dir):
    """A claim is as old as its newest indexed field, or its row."""
    o = table(spark, sf_dir, "orders")
    born = clocks.hlc(clocks.truncated_ms(F.col("o_orderdate")), F.lit(0), F.lit("n"))
    a = F.when(F.col("o_orderkey") % 3 == 0, clocks.hlc(F.col("o_custkey"), F.lit(0), F.lit("n")))
    b = F.when(F.col("o_orderkey") % 2 == 0, clocks.hlc(F.col("o_orderkey"), F.lit(0), F.lit("n")))
    return o.select("o_orderkey", born["ms"].alias("born"), projection.claim_clock(born, a, b)["ms"].alias("claim_ms"))
