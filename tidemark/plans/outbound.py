"""Queries on outbound batches, local writes, values, accounts and registries (W5-W11, T3-T7, R, S13-S18, X12-X28, V, Z9)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hlc as clocks
from ..functions import values
from ..operators import accounts, merge, record, replicate
from ..sources import log as logs_io
from ..sources.shared import new_path, staged
from ..streaming import live
from . import schema
from .logs import EV, LOG, PROFILE, event_log, flat, profile_log
from .registry import query, table

OUT = """x AS (SELECT event_id, (event_id // 1000) % 10 AS s, 'profile' AS tbl, CAST((event_id // 3) % 700 AS VARCHAR) AS row_id, event_id // 20 AS hr, 'n' || ((event_id // 5) % 3) AS n,
    CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'insert' WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS kind,
    CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 0 WHEN event_type = 'error' THEN 2 ELSE 1 END AS kn,
    CASE WHEN NOT (event_type = 'error' OR event_type = 'signup' AND event_id % 4 = 0) THEN event_type END AS col,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'userCascadeDelete' ELSE 'userDelete' END END AS reason FROM ev),
  y AS (SELECT *, CAST(row_number() OVER (PARTITION BY s, n, hr ORDER BY event_id) // 2 AS INTEGER) AS c FROM x),
  o AS (SELECT *, CAST(row_number() OVER (PARTITION BY s ORDER BY hr, c, n, kn, tbl, row_id, coalesce(col, ''), event_id) AS INTEGER) AS pos FROM y)"""


def outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as changes of ten sessions whose clocks repeat and follow each other, as writes in one millisecond do."""
    e = event_log(spark, sf_dir)
    n = F.col("event_id")
    born = (F.col("event_type") == "signup") & (n % 4 == 0)
    kind = F.when(born, "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    rows = e.select(
        "event_id", (F.floor(n / 1000) % 10).alias("session"), "tbl", (F.floor(n / 3) % 700).cast("string").alias("row_id"), F.floor(n / 20).alias("ms"),
        F.concat(F.lit("n"), (F.floor(n / 5) % 3).cast("string")).alias("node"), kind.alias("kind"), F.when(kind == "update", F.col("event_type")).alias("column"),
        F.when(kind == "delete", F.when(n % 3 == 0, "userCascadeDelete").otherwise("userDelete")).alias("reason"),
    )
    place = F.row_number().over(W.partitionBy("session", "node", "ms").orderBy("event_id"))
    return rows.withColumn("hlc", clocks.hlc(F.col("ms"), F.floor(place / 2), F.col("node"))).drop("ms", "node")


def in_order(spark, sf_dir) -> DataFrame:
    """Positions as the library gives them; the event's id settles what is equal in all keys."""
    return replicate.ordered(outbound(spark, sf_dir), tie=["event_id"], bucket_ms=256).withColumn("pos", F.col("pos").cast("int"))


@query(f"WITH {EV}, {OUT} SELECT s AS session, pos, kind, row_id, col AS \"column\", hr AS hlc_ms, c AS hlc_counter FROM o")
def outbound_order(spark, sf_dir):
    """The order in which changes are sent."""
    return in_order(spark, sf_dir).select("session", "pos", "kind", "row_id", "column", F.col("hlc.ms").alias("hlc_ms"), F.col("hlc.counter").alias("hlc_counter"))


CUTS = """z AS (SELECT *, lead(hr) OVER w AS nhr, lead(c) OVER w AS nc, lead(n) OVER w AS nn, max(CASE kind WHEN 'insert' THEN pos END) OVER (PARTITION BY s, row_id) AS ins, min(pos) OVER (PARTITION BY s, row_id) AS fst,
    lag(pos) OVER v AS pp, lag(row_id) OVER v AS prow, lag(hr) OVER v AS phr, lag(c) OVER v AS pc, coalesce(kind = 'delete', false) AS tomb, coalesce(reason = 'userCascadeDelete', false) AS casc
    FROM o WINDOW w AS (PARTITION BY s ORDER BY pos), v AS (PARTITION BY s, n ORDER BY pos)),
  zz AS (SELECT *, coalesce(phr = hr AND c = pc + 1, false) AS chain, sum(CASE WHEN tomb THEN 0 ELSE 1 END) OVER (PARTITION BY s, n ORDER BY pos) AS run FROM z),
  d AS (SELECT *, min(pos) OVER q AS st, max(CASE WHEN casc THEN pos END) OVER q AS lc, min(CASE WHEN casc THEN pos END) OVER q AS fc FROM zz WHERE tomb WINDOW q AS (PARTITION BY s, n, run)),
  e AS (SELECT *, sum(CASE WHEN chain AND pos > st THEN 0 ELSE 1 END) OVER (PARTITION BY s, n, run ORDER BY pos) AS lk FROM d),
  h AS (SELECT s, n, run, lk, min(pos) AS hd FROM e GROUP BY s, n, run, lk),
  t AS (SELECT e.s, hd, st, lc FROM e JOIN h ON e.s = h.s AND e.n = h.n AND e.run = h.run AND e.lk = h.lk WHERE pos = fc),
  r AS (SELECT s, pos AS lo, pos + 1 AS hi, 0 AS lv FROM z WHERE nhr = hr AND nc = c AND nn = n UNION ALL SELECT s, fst, pos, 0 FROM z WHERE pos = ins AND fst < pos
    UNION ALL SELECT s, pp, pos, 1 FROM zz WHERE chain AND prow = row_id UNION ALL SELECT s, hd, lc, 1 FROM t UNION ALL SELECT s, st, lc, 2 FROM t),
  b AS (SELECT s, lo AS pos, lv, 1 AS d FROM r WHERE hi > lo UNION ALL SELECT s, hi, lv, -1 FROM r WHERE hi > lo),
  k AS (SELECT s, pos, sum(CASE lv WHEN 0 THEN d ELSE 0 END) AS d0, sum(CASE WHEN lv <= 1 THEN d ELSE 0 END) AS d1, sum(d) AS d2 FROM b GROUP BY s, pos),
  f AS (SELECT o.s, o.pos, event_id, sum(coalesce(d0, 0)) OVER u AS p0, sum(coalesce(d1, 0)) OVER u AS p1, sum(coalesce(d2, 0)) OVER u AS p2 FROM o LEFT JOIN k ON k.s = o.s AND k.pos = o.pos WINDOW u AS (PARTITION BY o.s ORDER BY o.pos)),
  un AS (SELECT s, pos, event_id, CAST(coalesce(sum(CASE p0 WHEN 0 THEN 1 ELSE 0 END) OVER m, 0) AS BIGINT) AS part, CAST(coalesce(sum(CASE p1 WHEN 0 THEN 1 ELSE 0 END) OVER m, 0) AS BIGINT) AS grp,
    CAST(coalesce(sum(CASE p2 WHEN 0 THEN 1 ELSE 0 END) OVER m, 0) AS BIGINT) AS unit FROM f WINDOW m AS (PARTITION BY s ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {EV}, {OUT}, {CUTS} SELECT s AS session, pos, part, grp, unit FROM un")
def outbound_units(spark, sf_dir):
    """Where a batch may end: parts within groups within units."""
    return replicate.units(in_order(spark, sf_dir)).select("session", "pos", "part", "grp", "unit")


@query(f"""WITH {EV}, {OUT}, {CUTS}, sz AS (SELECT s, unit, count(*) AS n FROM un GROUP BY s, unit), tk AS (SELECT *, sum(n) OVER w AS t, row_number() OVER w AS k FROM sz WINDOW w AS (PARTITION BY s ORDER BY unit))
  SELECT un.s AS session, pos FROM un JOIN tk ON tk.s = un.s AND tk.unit = un.unit WHERE k = 1 OR t <= 300""")
def outbound_prefix(spark, sf_dir):
    """What an empty batch takes under a change limit."""
    return replicate.prefix(replicate.units(in_order(spark, sf_dir)), 300).select("session", "pos")


@query(f"""WITH {EV}, {OUT}, rf AS (SELECT s, pos AS dep, CAST((event_id * 7) % 700 AS VARCHAR) AS tid FROM o WHERE kind <> 'delete')
  SELECT DISTINCT rf.s AS session, dep AS dependent, o.pos AS prerequisite FROM rf JOIN o ON o.s = rf.s AND o.row_id = tid AND o.kind = 'insert' WHERE o.pos > dep""")
def outbound_dependencies(spark, sf_dir):
    """Changes that name rows inserted after them."""
    rows = in_order(spark, sf_dir)
    refs = rows.where("kind <> 'delete'").select("session", "pos", F.col("tbl").alias("target_tbl"), ((F.col("event_id") * 7) % 700).cast("string").alias("target_id"))
    return replicate.dependencies(rows, refs)


@query()
def outbound_batches(spark, sf_dir):
    """All rounds of each session cut at once under two bounds."""
    rows = replicate.units(in_order(spark, sf_dir))
    parts = rows.groupBy("session", "unit", "grp", "part").agg(F.count("*").alias("changes"), F.sum(10 + F.col("event_id") % 7).alias("payload"))
    return replicate.batches(parts, replicate.Budget(max_changes=200, max_payload=2000))


@query(f"WITH {EV}, {OUT} SELECT s AS session, CAST((pos - 1) // 100 AS BIGINT) AS chunk, count(*) AS changes FROM o GROUP BY ALL")
def chunking(spark, sf_dir):
    """Frames of at most 100 changes."""
    return replicate.chunks(in_order(spark, sf_dir)).groupBy("session", "chunk").agg(F.count("*").alias("changes"))


@query("SELECT event_id FROM events WHERE user_id % 5 <> 0 UNION SELECT event_id FROM events WHERE user_id % 15 = 0")
def row_isolation(spark, sf_dir):
    """Withheld rows wait, released rows go out again."""
    e = event_log(spark, sf_dir).withColumns({"kind": F.lit("update"), "column": F.col("event_id").cast("string")})
    held = e.where("user_id % 5 = 0").select("space", "tbl", "row_id").distinct()
    return replicate.isolated(e, held, e.where("user_id % 15 = 0")).select("event_id")


@query("""SELECT doc_id, CAST((octet_length(encode(text))) AS BIGINT) AS bytes, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS chars FROM documents""")
def payload_measure(spark, sf_dir):
    """A payload's UTF-16 units, as budgets count them, and its bytes."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), values.utf16_length(F.col("text")).alias("chars"))


@query(f"""WITH {LOG} SELECT space, row_id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'click' THEN 'update' WHEN 'view' THEN 'update' ELSE 'delete' END AS kind,
  CASE event_type WHEN 'click' THEN 'score' WHEN 'view' THEN 'name' END AS "column", CASE event_type WHEN 'click' THEN cents WHEN 'view' THEN nm END AS value,
  cl AS cl_flag, reason, ms AS hlc_ms, c AS hlc_counter, n AS hlc_node FROM log""")
def wire_round_trip(spark, sf_dir):
    """Changes as JSON frames and back."""
    changes = logs_io.aligned(profile_log(spark, sf_dir))
    back = logs_io.decoded(logs_io.encoded(changes))
    return flat(back.select("space", "row_id", "kind", "column", "value", "cl_flag", "reason", "hlc"))


SUFFIX = "CASE doc_id % 4 WHEN 0 THEN '__conflict__' WHEN 1 THEN '__hidden__' WHEN 2 THEN '__park_' ELSE '' END || '00000000-0000-4000-8000-' || lpad(CAST(doc_id AS VARCHAR), 12, '0')"


@query(f"SELECT doc_id, regexp_matches(source || {SUFFIX}, '__(conflict|hidden|park)__[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') AS reserved FROM documents")
def reserved_values(spark, sf_dir):
    """Authored texts that only projection may write."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    mark = F.when(k == 0, "__conflict__").when(k == 1, "__hidden__").when(k == 2, "__park_").otherwise("")
    text = F.concat("source", mark, F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return d.select("doc_id", values.is_reserved(text).alias("reserved"))


@query("""SELECT p_partkey, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr(d, 17, 1))::INTEGER % 4, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS uuid
  FROM (SELECT p_partkey, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(p_name)) AS d FROM part)""")
def uuid_v5(spark, sf_dir):
    """Name-based UUIDs by built-in SHA-1."""
    return table(spark, sf_dir, "part").select("p_partkey", values.uuid5(F.col("p_name")).alias("uuid"))


@query("""WITH r(reason) AS (VALUES ('userInsert'), ('userReinsert'), ('userDelete'), ('userCascadeDelete'), ('uniqueLoser')), g(flag) AS (SELECT CAST(range AS INTEGER) FROM range(1, 7))
  SELECT reason, flag, flag % 2 = 0 AS deleted, CASE WHEN flag % 2 = 0 THEN CASE reason WHEN 'userCascadeDelete' THEN 4 ELSE 3 END ELSE CASE reason WHEN 'userReinsert' THEN 1 ELSE 0 END END AS visibility,
    CASE WHEN flag % 2 = 0 THEN flag + 2 ELSE flag + 1 END AS next_deleted, CASE WHEN flag % 2 = 0 THEN flag + 1 ELSE flag + 2 END AS next_visible, starts_with(reason, 'user') AS synced FROM r, g""")
def visibility_table(spark, sf_dir):
    """Stored visibilities, next generations and what replicates, for every reason."""
    reasons = spark.createDataFrame([(r, list(range(1, 7))) for r in ("userInsert", "userReinsert", "userDelete", "userCascadeDelete", "uniqueLoser")], "reason string, flags array<int>")
    rows = reasons.select("reason", F.explode("flags").alias("flag"))
    deleted = values.is_deleted(F.col("flag"))
    return rows.select("reason", "flag", deleted.alias("deleted"), values.visibility(F.col("reason"), deleted).alias("visibility"), values.next_flag(F.col("flag"), F.lit(False)).alias("next_deleted"),
                       values.next_flag(F.col("flag"), F.lit(True)).alias("next_visible"), values.is_synced(F.col("reason")).alias("synced"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'clockDrift' WHEN 1 THEN 'serverClockDrift' WHEN 2 THEN 'duplicateNode' WHEN 3 THEN 'integrityViolation' ELSE 'unknown' END AS code, event_id % 5 IN (2, 3) AS permanent,
  CAST(least(greatest(greatest(CASE WHEN event_id % 3 = 0 THEN 200 ELSE user_id * 100 END, CASE WHEN event_id % 4 = 0 THEN 200 ELSE event_id END), 200), 5000) AS BIGINT) AS interval_ms FROM events""")
def failure_codes(spark, sf_dir):
    """How errors are reported, and the interval two sides agree on."""
    e = table(spark, sf_dir, "events")
    error = F.element_at(F.array(*[F.lit(x) for x in ("remoteAhead", "localAhead", "duplicateNode", "unauthorizedWrite", "somethingElse")]), (F.col("event_id") % 5 + 1).cast("int"))
    code = values.failure_code(error)
    wait = values.clamped(F.when(F.col("event_id") % 3 != 0, F.col("user_id") * 100), F.when(F.col("event_id") % 4 != 0, F.col("event_id")), 200, 5000)
    return e.select("event_id", code.alias("code"), values.is_permanent(code).alias("permanent"), wait.cast("long").alias("interval_ms"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || user_id || ' ' WHEN 1 THEN 'x' || user_id WHEN 2 THEN '-' || user_id ELSE CAST(user_id AS VARCHAR) END AS s FROM events)
  SELECT event_id, CASE WHEN TRY_CAST(trim(s) AS BIGINT) > 0 THEN TRY_CAST(trim(s) AS BIGINT) END AS app_id FROM t""")
def app_ids(spark, sf_dir):
    """Application ids as numbers or numeric text."""
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit(" "), u, F.lit(" "))).when(k == 1, F.concat(F.lit("x"), u)).when(k == 2, F.concat(F.lit("-"), u)).otherwise(u)
    return table(spark, sf_dir, "events").select("event_id", values.app_id(text).alias("app_id"))


@query("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_identifier, CASE WHEN event_id % 9 = 0 THEN 'missingId' END AS error, 'user' || user_id || '@mail.test' AS email, props AS name FROM events""")
def kakao_profile(spark, sf_dir):
    """Profiles from nested JSON answers."""
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(
        F.when(F.col("event_id") % 9 != 0, F.col("user_id")).alias("id"),
        F.struct(F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@Mail.TEST")).alias("email"), F.struct(F.col("props").alias("nickname")).alias("profile")).alias("kakao_account"),
    ))
    p = e.select("event_id", accounts.profile(body, "kakao").alias("p"))
    return p.select("event_id", F.col("p.user_identifier").alias("user_identifier"), F.col("p.error").alias("error"), F.col("p.email").alias("email"), F.col("p.name").alias("name"))


@query("""SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'badResult' WHEN event_id % 9 = 0 THEN 'missingId' END AS error, CASE WHEN event_id % 8 <> 0 AND event_id % 9 <> 0 THEN 'x' || user_id END AS user_identifier,
  CASE WHEN event_id % 7 = 0 THEN 'denied' WHEN event_id % 5 = 0 THEN 'missingToken' END AS token_error, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN 't' || event_id END AS access_token FROM events""")
def naver_profile(spark, sf_dir):
    """Answers with a result code, and token answers."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    ident = F.when(n % 9 == 0, "").otherwise(F.concat(F.lit("x"), F.col("user_id").cast("string")))
    body = F.to_json(F.struct(F.when(n % 8 == 0, "24").otherwise("00").alias("resultcode"), F.struct(ident.alias("id")).alias("response")))
    answer = F.to_json(F.struct(F.when(n % 7 == 0, "denied").alias("error"), F.when(n % 5 != 0, F.concat(F.lit("t"), n.cast("string"))).alias("access_token")))
    p = e.select("event_id", accounts.profile(body, "naver").alias("p"), accounts.token(answer).alias("t"))
    return p.select("event_id", F.col("p.error").alias("error"), F.col("p.user_identifier").alias("user_identifier"), F.col("t.error").alias("token_error"), F.col("t.access_token").alias("access_token"))


@query("""SELECT CAST(user_id AS VARCHAR) AS user_identifier, lower(arg_min('U' || event_id || '@X.test', event_id)) AS email, min(event_id) AS auth_user FROM events WHERE user_id % 3 <> 0 GROUP BY user_id""")
def account_find_or_create(spark, sf_dir):
    """New accounts: the first profile of each unknown identifier (V3, V5)."""
    e = table(spark, sf_dir, "events")
    profiles = e.select(F.col("user_id").cast("string").alias("user_identifier"), F.concat(F.lit("U"), F.col("event_id").cast("string"), F.lit("@X.test")).alias("email"), F.col("event_id").alias("auth_user"), F.col("event_id").alias("created"))
    known = e.where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("user_identifier")).distinct()
    return accounts.new_accounts(profiles, known)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders")
def account_repoint(spark, sf_dir):
    """References after users were merged (V4)."""
    pairs = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("remove"), (F.col("c_custkey") + 1).alias("keep"))
    return accounts.repointed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), pairs, "o_custkey")


@query("""SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING max(ts) < (SELECT max(ts) - INTERVAL 1 DAY FROM events) AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 20 = 0)""")
def stale_accounts(spark, sf_dir):
    """Accounts to refresh, without those that the provider reported as gone (V6, V7)."""
    e = table(spark, sf_dir, "events")
    last = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("last_refreshed_at")).withColumn("user_identifier", F.col("user_id"))
    gone = e.where("event_type = 'error' and event_id % 20 = 0").select(F.col("user_id").alias("user_identifier"), F.lit("consent-revoked").alias("type"))
    now = e.agg(F.max("ts").alias("now"))
    old = accounts.stale(accounts.after_notifications(last, gone).join(F.broadcast(now)), F.col("now"))
    return old.select("user_id", F.col("last_refreshed_at").alias("last"))


def writes(spark, sf_dir) -> DataFrame:
    """orders as local writes of three nodes, in key order, at the start of their day."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.lit("s").alias("space"), F.lit("orders").alias("tbl"), F.col("o_orderkey").cast("string").alias("row_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("n"), (F.col("o_orderkey") % 3).cast("string")).alias("node"),
        clocks.truncated_ms(F.col("o_orderdate")).alias("wall_ms"), "o_orderstatus", "o_orderpriority", "o_custkey",
    )


WR = "w AS (SELECT CAST(o_orderkey AS VARCHAR) AS row_id, o_orderkey AS seq, 'n' || (o_orderkey % 3) AS node, epoch_us(o_orderdate) // 1000 AS wall, o_orderstatus, o_orderpriority, o_custkey FROM orders)"


@query(f"""WITH {WR}, t AS (SELECT *, max(wall) OVER (PARTITION BY node ORDER BY seq) AS ms FROM w)
  SELECT row_id, o_orderstatus AS status, ms AS hlc_ms, CAST(row_number() OVER (PARTITION BY node, ms ORDER BY seq) - 1 AS INTEGER) AS hlc_counter FROM t""")
def record_inserts(spark, sf_dir):
    """Inserted rows as stamped changes."""
    out = record.inserts(writes(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])
    return out.select("row_id", F.col("payload")["o_orderstatus"].alias("status"), F.col("hlc.ms").alias("hlc_ms"), F.col("hlc.counter").alias("hlc_counter"))


@query(f"""WITH {WR}, f AS (SELECT row_id, seq, node, wall, 0 AS k, 'o_orderstatus' AS col, o_orderstatus AS v FROM w UNION ALL SELECT row_id, seq, node, wall, 1, 'o_orderpriority', o_orderpriority FROM w),
  t AS (SELECT *, greatest(800000000000, max(wall) OVER (PARTITION BY node ORDER BY seq, k)) AS ms FROM f)
  SELECT row_id, col AS "column", v AS value, ms AS hlc_ms, CAST(row_number() OVER (PARTITION BY node, ms ORDER BY seq, k) - 1 + CASE WHEN ms = 800000000000 THEN 8 ELSE 0 END AS INTEGER) AS hlc_counter FROM t""")
def record_updates(spark, sf_dir):
    """Full-row updates stamp every column, after the node's last clock."""
    rows = writes(spark, sf_dir).withColumn("last", clocks.hlc(F.lit(800_000_000_000), F.lit(7), F.col("node")))
    out = record.updates(rows, ["o_orderstatus", "o_orderpriority"], last="last")
    return out.select("row_id", "column", "value", F.col("hlc.ms").alias("hlc_ms"), F.col("hlc.counter").alias("hlc_counter"))


@query("""WITH r AS (SELECT 'customer' AS tbl, CAST(c_custkey AS VARCHAR) AS row_id, 0 AS st FROM customer WHERE c_acctbal < 0),
  k AS (SELECT 'orders' AS tbl, CAST(o_orderkey AS VARCHAR) AS row_id, 1 AS st FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)), b AS (SELECT * FROM r UNION ALL SELECT * FROM k),
  g AS (SELECT *, CASE WHEN CAST(row_id AS BIGINT) % 5 = 0 AND tbl = 'orders' THEN 1 + CAST(row_id AS BIGINT) % 2 ELSE NULL END AS fl FROM b)
  SELECT tbl, row_id, CAST(CASE WHEN fl IS NULL THEN 2 ELSE fl + 1 END AS INTEGER) AS cl_flag, CASE st WHEN 0 THEN 'userDelete' ELSE 'userCascadeDelete' END AS reason, CAST(1 AS BIGINT) AS hlc_ms,
    CAST(row_number() OVER (ORDER BY st, CAST(row_id AS BIGINT)) - 1 AS INTEGER) AS hlc_counter FROM g WHERE fl IS NULL OR fl % 2 = 1""")
def record_deletes(spark, sf_dir):
    """Soft deletes with their cascade and next generations; rows already deleted are left."""
    at = {"space": F.lit("s"), "node": F.lit("n"), "wall_ms": F.lit(1)}
    roots = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit("customer").alias("tbl"), F.col("c_custkey").cast("string").alias("row_id"), F.col("c_custkey").alias("seq")).withColumns(at)
    orders = table(spark, sf_dir, "orders")
    taken = orders.join(roots.select(F.col("seq").alias("o_custkey")), "o_custkey", "left_semi").select(F.lit("orders").alias("tbl"), F.col("o_orderkey").cast("string").alias("row_id"), F.col("o_orderkey").alias("seq")).withColumns(at)
    flags = orders.where("o_orderkey % 5 = 0").select(F.lit("s").alias("space"), F.lit("orders").alias("tbl"), F.col("o_orderkey").cast("string").alias("row_id"), (1 + F.col("o_orderkey") % 2).cast("int").alias("cl_flag"))
    return record.deletes(roots, taken, flags).select("tbl", "row_id", "cl_flag", "reason", F.col("hlc.ms").alias("hlc_ms"), F.col("hlc.counter").alias("hlc_counter"))


@query(f"WITH {WR} SELECT row_id, CAST(seq % 4 + 1 AS INTEGER) AS cl_flag, 'userReinsert' AS reason FROM w WHERE seq % 4 > 0 AND seq % 2 = 0")
def reinsert(spark, sf_dir):
    """Inserts of deleted ids bring the row back with an odd generation."""
    rows = writes(spark, sf_dir)
    generations = rows.where("seq % 4 > 0").select("space", "tbl", "row_id", (F.col("seq") % 4).cast("int").alias("cl_flag"))
    return record.reinserts(rows.select("space", "tbl", "row_id"), generations).select("row_id", "cl_flag", "reason")


@query("""WITH s AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT c_custkey, 'new' || c_custkey AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
  SELECT coalesce(s.c_custkey, i.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NULL OR (i.c_custkey IS NOT NULL AND s.c_acctbal > 0) THEN i.c_name ELSE s.c_name END AS c_name, coalesce(s.c_acctbal, i.c_acctbal) AS c_acctbal,
    CASE WHEN s.c_custkey IS NULL THEN 'insert' WHEN i.c_custkey IS NOT NULL AND s.c_acctbal > 0 THEN 'update' ELSE 'keep' END AS op FROM s FULL JOIN i ON s.c_custkey = i.c_custkey""")
def upsert(spark, sf_dir):
    """An upsert with chosen update columns and a condition."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return record.upserted(c.where("c_custkey % 3 <> 0"), new, keys=["c_custkey"], update=["c_name"], where=F.col("c_acctbal") > 0)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 5")
def topk_update(spark, sf_dir):
    """The rows of an ordered, limited update."""
    return record.first_by(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 15, 5)


@query("SELECT l_orderkey || '-' || l_linenumber AS row_id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    """Ids given twice in one call."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit("s").alias("space"), F.lit("line").alias("tbl"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"))
    return record.duplicate_ids(rows).select("row_id", "n")


@query("""WITH o AS (SELECT DISTINCT p_brand AS tbl, p_type AS col, CASE WHEN length(p_type) % 3 = 0 THEN 'text' ELSE 'int' END AS ty FROM part WHERE p_size % 5 <> 0), n AS (SELECT DISTINCT p_brand AS tbl, p_type AS col, CASE WHEN length(p_type) % 2 = 0 THEN 'text' ELSE 'int' END AS ty FROM part WHERE p_size % 7 <> 0)
  SELECT coalesce(o.tbl, n.tbl) AS tbl, coalesce(o.col, n.col) AS "column", o.ty AS old_type, n.ty AS new_type, CASE WHEN o.ty IS NULL THEN 'insert' WHEN n.ty IS NULL THEN 'delete' ELSE 'update' END AS change
  FROM o FULL JOIN n ON o.tbl = n.tbl AND o.col = n.col WHERE o.ty IS DISTINCT FROM n.ty""")
def registry_reconcile(spark, sf_dir):
    """What a stored schema registry needs."""
    p = table(spark, sf_dir, "part")
    kind = lambda m: F.when(F.length("p_type") % m == 0, "text").otherwise("int").alias("type")
    old = p.where("p_size % 5 <> 0").select(F.col("p_brand").alias("tbl"), F.col("p_type").alias("column"), kind(3)).distinct()
    return schema.reconcile(old, p.where("p_size % 7 <> 0").select(F.col("p_brand").alias("tbl"), F.col("p_type").alias("column"), kind(2)).distinct())


FR = """fr AS (SELECT CAST(user_id AS VARCHAR) AS s, event_id AS q, CASE event_type WHEN 'error' THEN 'close' WHEN 'signup' THEN 'endOfBatch' ELSE 'chunk' END AS ty, 1 + event_id % 5 AS ch FROM events),
  nb AS (SELECT *, CAST(coalesce(sum(CASE WHEN ty <> 'chunk' THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM fr),
  ab AS (SELECT s, b, CAST(sum(CASE ty WHEN 'chunk' THEN 1 ELSE 0 END) AS BIGINT) AS chunks, CAST(coalesce(sum(CASE ty WHEN 'chunk' THEN ch END), 0) AS BIGINT) AS changes, max(CASE WHEN ty <> 'chunk' THEN ty END) AS e FROM nb GROUP BY s, b),
  fb AS (SELECT s AS session, b AS batch, chunks, changes, CASE WHEN e = 'endOfBatch' THEN 'complete' WHEN e = 'close' THEN CASE WHEN chunks > 0 THEN 'premature' ELSE 'closed' END ELSE 'open' END AS status FROM ab)"""


def frames(spark, sf_dir) -> DataFrame:
    """events as protocol frames of one session per user."""
    kind = F.when(F.col("event_type") == "error", "close").when(F.col("event_type") == "signup", "endOfBatch").otherwise("chunk")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), kind.alias("type"), (1 + F.col("event_id") % 5).alias("changes"))


@query(f"WITH {FR} SELECT * FROM fb")
def framed_batches(spark, sf_dir):
    """Batches from frames, over a table."""
    return live.framed_batches(frames(spark, sf_dir))


def _arrivals(spark: SparkSession, rows: DataFrame, order: str, slices: int, bounds: tuple | None = None) -> Iterator[str]:
    """``rows`` as files that arrive in even stretches of ``order`` (between ``bounds``, where rows of the log are left out), each written
    by as many tasks as read it; gives the folder after each arrival."""
    folder = new_path(spark, "stream-input")
    low, high = bounds or rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        rows.limit(0).write.parquet(folder)
        yield folder
        return
    place = F.floor((F.col(order) - F.lit(low)) * slices / F.lit(high - low + 1))
    for k in range(slices):
        rows.where(place == k).write.mode("append").parquet(folder)
        yield folder


@query(f"WITH {FR} SELECT * FROM fb WHERE status <> 'open'")
def stream_frames(spark, sf_dir):
    """Batches from a stream of frames, by a stateful operator."""
    rows = frames(spark, sf_dir)
    out, checkpoint = new_path(spark, "stream-frames"), new_path(spark, "stream-checkpoint")
    for folder in _arrivals(spark, rows, "seq", 3):  # each run takes up where the last one ended
        source = spark.readStream.schema(rows.schema).parquet(folder)
        live.framed(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(live.FRAMES_OUT).parquet(out)


def _merged_stream(spark, sf_dir, rows: DataFrame | None = None, bounds: tuple | None = None, **options) -> live.MergeSink:
    rows = logs_io.aligned(profile_log(spark, sf_dir)) if rows is None else rows
    sink, checkpoint = live.MergeSink(new_path(spark, "stream-state"), PROFILE, **options), new_path(spark, "stream-checkpoint")
    for folder in _arrivals(spark, rows.withColumn("at", F.col("hlc.ms")), "at", 3, bounds):
        live.merging(live.change_stream(spark, folder, None), sink, checkpoint).awaitTermination()
    return sink


def _shown(spark, sf_dir, sink: live.MergeSink) -> DataFrame:
    state = sink.state(spark, sink.newest(spark)) or merge.state_of(logs_io.aligned(profile_log(spark, sf_dir)).limit(0), PROFILE)
    fields = merge.wide(state.fields, PROFILE["profile"])
    return merge.row_visibility(state).join(fields, merge.ROW).select("row_id", "name", "score", F.col("hlc.ms").alias("birth_ms"), "cl_flag", "visibility")


#: The state after three arrivals, even stretches of the clock: a row is known from the arrival of its first insert on.
ARRIVED = """tm AS (SELECT min(ms) AS low, max(ms) AS high FROM log), arr AS (SELECT log.*, (ms - low) * 3 // (high - low + 1) AS a FROM log, tm)"""
STREAMED = """b AS (SELECT row_id, a0, min({'ms': ms, 'c': c, 'n': n}).ms AS birth_ms FROM (SELECT *, min(a) OVER (PARTITION BY row_id) AS a0 FROM fct WHERE event_type = 'signup') WHERE a = a0 GROUP BY row_id, a0),
  w AS (SELECT row_id, a, 'name' AS col, nm AS v, ms, c, n FROM fct WHERE event_type IN ('signup', 'view') UNION ALL SELECT row_id, a, 'score', CASE event_type WHEN 'click' THEN cents END, ms, c, n FROM fct WHERE event_type IN ('signup', 'click')),
  f AS (SELECT row_id, max(CASE col WHEN 'name' THEN v END) AS name, max(CASE col WHEN 'score' THEN v END) AS score FROM
    (SELECT row_id, col, last(v ORDER BY ms, c, n) AS v FROM w JOIN b USING (row_id) WHERE a >= a0 GROUP BY row_id, col) GROUP BY row_id),
  g AS (SELECT row_id, max(cl) AS cl, arg_max(reason, {'cl': cl, 'ms': ms, 'c': c, 'n': n}) AS reason FROM fct JOIN b USING (row_id) WHERE cl IS NOT NULL AND a >= a0 GROUP BY row_id)
  SELECT b.row_id, name, score, birth_ms, coalesce(cl, 1) AS cl_flag, CASE WHEN coalesce(cl, 1) % 2 = 0 THEN 3 ELSE CASE reason WHEN 'userReinsert' THEN 1 ELSE 0 END END AS visibility
  FROM b JOIN f USING (row_id) LEFT JOIN g USING (row_id)"""


@query(f"WITH {LOG}, {ARRIVED}, fct AS (SELECT * FROM arr), {STREAMED}")
def stream_merge(spark, sf_dir):
    """A log merged batch by batch from a stream."""
    return _shown(spark, sf_dir, _merged_stream(spark, sf_dir))


SUFFIX_ID = "'__hidden__00000000-0000-4000-8000-000000000001'"
#: Units are (arrival, node): one with a reserved name, a row of another space or a space its node may only read falls whole.
REFUSED = f"""prm AS (SELECT * REPLACE (CASE WHEN event_type = 'view' AND event_id % 991 = 7 THEN nm || {SUFFIX_ID} ELSE nm END AS nm) FROM arr),
  vio AS (SELECT a, n, row_id, ms, CASE WHEN event_type = 'view' AND event_id % 991 = 7 THEN 'reservedValue' END AS kind, 'name' AS col FROM prm WHERE event_type = 'view' AND event_id % 991 = 7
    UNION ALL SELECT a, n, row_id, ms, 'unauthorizedWrite', NULL FROM prm WHERE n = 'n1' AND space = 's3' AND a = 1 AND event_id % 3 = 1)"""


@query(f"WITH {LOG}, {ARRIVED}, {REFUSED}, fct AS (SELECT * FROM prm WHERE NOT EXISTS (SELECT 1 FROM vio WHERE vio.a = prm.a AND vio.n = prm.n) AND NOT (n = 'n1' AND space = 's3')), {STREAMED}")
def stream_validated_merge(spark, sf_dir):
    """A stream of which some nodes' batches are refused whole, for a reserved value or a space their node may only read."""
    return _shown(spark, sf_dir, _validated(spark, sf_dir))


@query(f"WITH {LOG}, {ARRIVED}, {REFUSED} SELECT row_id, kind, n AS node, count(*) AS occurrences, max(ms) AS hlc_ms FROM vio GROUP BY ALL")
def stream_violations(spark, sf_dir):
    """What was refused, rolled up over the batches of a stream."""
    sink = _validated(spark, sf_dir)
    found = sink.violations(spark, sink.newest(spark)).groupBy("row_id", "kind", "node").agg(F.sum("occurrences").alias("occurrences"), F.max("hlc").alias("hlc"))
    return found.select("row_id", "kind", "node", "occurrences", F.col("hlc.ms").alias("hlc_ms"))


def _validated(spark, sf_dir) -> live.MergeSink:
    log = profile_log(spark, sf_dir)
    low, high = log.agg(F.min("hlc.ms"), F.max("hlc.ms")).first()
    reserved = F.coalesce((F.col("column") == "name") & (F.col("event_id") % 991 == 7), F.lit(False))
    marked = F.when(reserved, F.concat("value", F.lit("__hidden__00000000-0000-4000-8000-000000000001"))).otherwise(F.col("value"))
    # n1 leaves s3 alone but in the second arrival, when it may only read it, and with reserved names, with which its batch falls
    second = F.floor((F.col("hlc.ms") - (low or 0)) * 3 / F.lit((high or 0) - (low or 0) + 1)) == 1
    rows = log.withColumn("value", marked).where(~((F.col("hlc.node") == "n1") & (F.col("space") == "s3")) | second | reserved)
    pairs = staged(rows.select("space", F.col("hlc.node").alias("node")).distinct(), "granted")
    only_read = (F.col("node") == "n1") & (F.col("space") == "s3")

    def granted(arrival: int) -> DataFrame:
        return pairs.withColumn("role", F.when(only_read & F.lit(arrival == 1), "readOnly").otherwise("readWrite"))

    return _merged_stream(spark, sf_dir, logs_io.aligned(rows), (low, high), unit="hlc.node", granted=granted, reserved={"name": "text"})


@query()
def stream_watch(spark, sf_dir):
    """A live query: results that changed after a batch, as (batch, rows)."""
    seen: list[tuple[int, int]] = []
    rows = logs_io.aligned(profile_log(spark, sf_dir)).withColumn("at", F.col("hlc.ms"))
    sink, checkpoint = live.MergeSink(new_path(spark, "watch-state"), PROFILE), new_path(spark, "watch-checkpoint")
    now = {"batch": 0}
    watch = live.Watch(lambda s: sink.state(s, now["batch"]).rows, lambda k, r: seen.append((k, r.count())))

    def both(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        now["batch"] = batch_id
        watch(batch, batch_id)

    for folder in _arrivals(spark, rows, "at", 3):
        live.merging(live.change_stream(spark, folder, None), both, checkpoint).awaitTermination()
    return spark.createDataFrame(seen, "batch long, rows long")
