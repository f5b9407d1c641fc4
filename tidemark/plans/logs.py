"""Queries on change logs: registers, generations, state, clocks and checkpoints (M, A, F11, T, W1, X1-X11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hlc as clocks
from ..functions import values
from ..operators import merge, replicate, session
from ..sources.shared import staged
from .registry import query, table

#: The columns of the replicated profile table.
PROFILE = {"profile": ["name", "score"]}
#: The same log in SQL.
EV = """ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000 AS ms, CAST(event_id & 65535 AS INTEGER) AS c,
  'n' || (event_id % 3) AS n, 's' || (user_id % 4) AS space, CAST(user_id AS VARCHAR) AS row_id FROM events)"""
STAMP = "{'ms': ms, 'c': c, 'n': n}"


def clock(event_id: Column, ts: Column) -> Column:
    return clocks.hlc(clocks.truncated_ms(ts), event_id.bitwiseAND(F.lit(65535)), F.concat(F.lit("n"), (event_id % 3).cast("string")))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as stamped facts of user profiles: one space per four users, three nodes."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value", "props", F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("space"), F.lit("profile").alias("tbl"),
        F.col("user_id").cast("string").alias("row_id"), clock(F.col("event_id"), F.col("ts")).alias("hlc"),
    )


def _cents(c: Column) -> Column:
    return F.floor(c * 100).cast("bigint").cast("string")


def profile_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup inserts a profile, click and view update it, error deletes and purchase restores it."""
    e = event_log(spark, sf_dir)
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type").isin("click", "view"), "update").otherwise("delete")
    flag = F.when(F.col("event_type") == "error", 2 * (F.col("event_id") % 3) + 2).when(F.col("event_type") == "purchase", 2 * (F.col("event_id") % 3) + 1)
    name = F.concat(F.lit("u"), F.col("row_id"), F.lit("-"), F.col("event_id").cast("string"))
    return e.select(
        "event_id", "space", "tbl", "row_id", kind.alias("kind"), F.when(F.col("event_type") == "click", "score").when(F.col("event_type") == "view", "name").alias("column"),
        F.when(F.col("event_type") == "click", _cents(F.col("value"))).when(F.col("event_type") == "view", name).alias("value"),
        F.when(kind == "insert", F.create_map(F.lit("name"), name)).alias("payload"), flag.cast("int").alias("cl_flag"),
        F.when(F.col("event_type") == "error", "userDelete").when(F.col("event_type") == "purchase", "userReinsert").alias("reason"), "hlc",
    )


LOG = EV + """, log AS (SELECT *, CAST(CASE event_type WHEN 'error' THEN 2 * (event_id % 3) + 2 WHEN 'purchase' THEN 2 * (event_id % 3) + 1 END AS INTEGER) AS cl,
  CASE event_type WHEN 'error' THEN 'userDelete' WHEN 'purchase' THEN 'userReinsert' END AS reason,
  'u' || row_id || '-' || event_id AS nm, CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS cents FROM ev)"""


def flat(df: DataFrame, clock_col: str = "hlc", prefix: str = "hlc") -> DataFrame:
    """A clock as three columns."""
    return df.withColumns({f"{prefix}_ms": F.col(f"{clock_col}.ms"), f"{prefix}_counter": F.col(f"{clock_col}.counter"), f"{prefix}_node": F.col(f"{clock_col}.node")}).drop(clock_col)


@query(f"""WITH {EV} SELECT row_id, event_type AS "column", arg_max(value, {STAMP}) AS value, max(ms) AS hlc_ms,
  arg_max(c, {STAMP}) AS hlc_counter, arg_max(n, {STAMP}) AS hlc_node FROM ev GROUP BY row_id, event_type""")
def lww_register(spark, sf_dir):
    """Last-writer-wins per (row, column)."""
    writes = event_log(spark, sf_dir).select("row_id", F.col("event_type").alias("column"), "value", "hlc")
    return flat(merge.registers(writes, ["row_id", "column"]))


@query(f"""WITH {EV}, g AS (SELECT *, CAST(2 * (event_id % 5) + CASE event_type WHEN 'error' THEN 2 ELSE 1 END AS INTEGER) AS cl,
    CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'userDelete' ELSE 'userCascadeDelete' END WHEN 'signup' THEN 'userReinsert' ELSE 'uniqueLoser' END AS reason FROM ev),
  m AS (SELECT row_id, arg_max(cl, {{'cl': cl, 'ms': ms, 'c': c, 'n': n}}) AS cl_flag, arg_max(reason, {{'cl': cl, 'ms': ms, 'c': c, 'n': n}}) AS reason,
    arg_max(ms, {{'cl': cl, 'ms': ms, 'c': c, 'n': n}}) AS hlc_ms FROM g WHERE event_type IN ('error', 'signup', 'view') AND starts_with(reason, 'user') GROUP BY row_id)
  SELECT row_id, cl_flag, reason, hlc_ms, CASE WHEN cl_flag % 2 = 0 THEN CASE reason WHEN 'userCascadeDelete' THEN 4 ELSE 3 END ELSE CASE reason WHEN 'userReinsert' THEN 1 ELSE 0 END END AS visibility FROM m""")
def causal_length_visibility(spark, sf_dir):
    """The largest replicated generation of a row decides what it shows."""
    e = event_log(spark, sf_dir).where("event_type in ('error', 'signup', 'view')")
    flag = 2 * (F.col("event_id") % 5) + F.when(F.col("event_type") == "error", 2).otherwise(1)
    deleted = F.when(F.col("event_id") % 2 == 0, "userDelete").otherwise("userCascadeDelete")
    reason = F.when(F.col("event_type") == "error", deleted).when(F.col("event_type") == "signup", "userReinsert").otherwise("uniqueLoser")
    log = e.select("space", "tbl", "row_id", F.lit("delete").alias("kind"), flag.cast("int").alias("cl_flag"), reason.alias("reason"), "hlc")
    out = merge.generations(log)
    return out.select("row_id", "cl_flag", "reason", F.col("hlc.ms").alias("hlc_ms"), values.visibility(F.col("reason"), values.is_deleted(F.col("cl_flag"))).alias("visibility"))


@query(f"""WITH {LOG}, b AS (SELECT row_id, min(ms) AS birth_ms FROM log WHERE event_type = 'signup' GROUP BY row_id),
  w AS (SELECT row_id, 'name' AS col, nm AS v, ms, c, n FROM log WHERE event_type IN ('signup', 'view')
    UNION ALL SELECT row_id, 'score', CASE event_type WHEN 'click' THEN cents END, ms, c, n FROM log WHERE event_type IN ('signup', 'click')),
  f AS (SELECT row_id, max(CASE col WHEN 'name' THEN v END) AS name, max(CASE col WHEN 'score' THEN v END) AS score FROM
    (SELECT row_id, col, last(v ORDER BY ms, c, n) AS v FROM w GROUP BY row_id, col) GROUP BY row_id),
  g AS (SELECT row_id, max(cl) AS cl, arg_max(reason, {{'cl': cl, 'ms': ms, 'c': c, 'n': n}}) AS reason FROM log WHERE cl IS NOT NULL GROUP BY row_id)
  SELECT b.row_id, name, score, birth_ms, coalesce(cl, 1) AS cl_flag,
    CASE WHEN coalesce(cl, 1) % 2 = 0 THEN 3 ELSE CASE reason WHEN 'userReinsert' THEN 1 ELSE 0 END END AS visibility
  FROM b JOIN f USING (row_id) LEFT JOIN g USING (row_id)""")
def replica_state(spark, sf_dir):
    """The whole merge of a log: births, registers, generations."""
    state = merge.state_of(profile_log(spark, sf_dir), PROFILE)
    fields = merge.wide(state.fields, PROFILE["profile"])
    rows = merge.row_visibility(state).join(fields, merge.ROW)
    return rows.select("row_id", "name", "score", F.col("hlc.ms").alias("birth_ms"), "cl_flag", "visibility")


@query(f"""WITH {LOG}, b AS (SELECT row_id, min(CASE WHEN event_id % 2 = 0 THEN ms END) AS b1, min(CASE WHEN event_id % 2 = 1 THEN ms END) AS b2 FROM log WHERE event_type = 'signup' GROUP BY row_id),
  w AS (SELECT event_id, row_id, 'name' AS col, nm AS v, ms, c, n FROM log WHERE event_type IN ('signup', 'view')
    UNION ALL SELECT event_id, row_id, 'score', CASE event_type WHEN 'click' THEN cents END, ms, c, n FROM log WHERE event_type IN ('signup', 'click')),
  f AS (SELECT row_id, col, last(v ORDER BY ms, c, n) AS v FROM w JOIN b USING (row_id) WHERE event_id % 2 = 1 OR b1 IS NOT NULL GROUP BY row_id, col),
  x AS (SELECT row_id, max(CASE col WHEN 'name' THEN v END) AS name, max(CASE col WHEN 'score' THEN v END) AS score FROM f GROUP BY row_id)
  SELECT row_id, coalesce(b1, b2) AS birth_ms, name, score FROM b JOIN x USING (row_id)""")
def incremental_merge(spark, sf_dir):
    """State after two batches: stored row clocks stay, early updates of unknown rows are gone."""
    log = profile_log(spark, sf_dir)
    first = merge.state_of(log.where("event_id % 2 = 0"), PROFILE)
    state = merge.merged(first, log.where("event_id % 2 = 1"), PROFILE)
    return state.rows.join(merge.wide(state.fields, PROFILE["profile"]), merge.ROW).select("row_id", F.col("hlc.ms").alias("birth_ms"), "name", "score")


@query(f"""WITH {LOG}, i AS (SELECT space, row_id, event_id, {{'ms': ms, 'c': c, 'n': n}} AS k FROM log WHERE event_type = 'signup'), b AS (SELECT space, row_id, min(k) AS k0, bool_or(event_id % 2 = 0) AS early FROM i GROUP BY space, row_id),
  g AS (SELECT space, row_id, cl, {{'ms': ms, 'c': c, 'n': n}} AS k, reason FROM log JOIN b USING (space, row_id) WHERE cl IS NOT NULL AND (event_id % 2 = 1 OR early)
    UNION ALL SELECT space, row_id, 1, k, 'userInsert' FROM i JOIN b USING (space, row_id) WHERE k > k0),
  m AS (SELECT space, row_id, max({{'cl': cl, 'k': k, 'r': reason}}) AS m FROM g GROUP BY space, row_id)
  SELECT row_id, k0.ms AS birth_ms, m.cl AS cl_flag, m.k.ms AS hlc_ms, m.r AS reason FROM b LEFT JOIN m USING (space, row_id)""")
def incremental_known_insert(spark, sf_dir):
    """Births and generations after two batches where births are registers too: what a rebuild gives."""
    log = profile_log(spark, sf_dir)
    first = merge.state_of(log.where("event_id % 2 = 0"), PROFILE, with_later_inserts=True)
    state = merge.merged(first, log.where("event_id % 2 = 1"), PROFILE, with_later_inserts=True)
    kept = state.generations.withColumnRenamed("hlc", "generation")
    return state.rows.join(kept, merge.ROW, "left").select("row_id", F.col("hlc.ms").alias("birth_ms"), "cl_flag", F.col("generation.ms").alias("hlc_ms"), "reason")


@query(f"""WITH {LOG}, k AS (SELECT CAST((min(ms) + max(ms)) // 2 AS BIGINT) AS cut FROM log), own AS (SELECT * FROM log WHERE row_id IN (SELECT row_id FROM log, k WHERE event_type = 'signup' AND ms <= cut)),
  b AS (SELECT row_id, min({STAMP}).ms AS birth_ms FROM own WHERE event_type = 'signup' GROUP BY row_id),
  w AS (SELECT row_id, 'name' AS col, nm AS v, {STAMP} AS s FROM own WHERE event_type IN ('signup', 'view') UNION ALL SELECT row_id, 'score', CASE event_type WHEN 'click' THEN cents END, {STAMP} FROM own WHERE event_type IN ('signup', 'click')),
  f AS (SELECT row_id, max(CASE col WHEN 'name' THEN v END) AS name, max(CASE col WHEN 'score' THEN v END) AS score FROM (SELECT row_id, col, last(v ORDER BY s) AS v FROM w GROUP BY row_id, col) GROUP BY row_id)
  SELECT side, row_id, birth_ms, name, score FROM b JOIN f USING (row_id), (VALUES ('a'), ('b')) t(side)""")
def session_convergence(spark, sf_dir):
    """Two replicas that were alike at the middle of the log's time and then saw other nodes' changes: after one round both have all."""
    log = profile_log(spark, sf_dir)
    middle = staged(log.agg(F.floor((F.min("hlc.ms") + F.max("hlc.ms")) / 2).alias("cut")), "session-middle")
    timed = log.join(F.broadcast(middle)).withColumn("early", F.coalesce(F.col("hlc.ms") <= F.col("cut"), F.lit(False)))
    alike = merge.state_of(timed.where("early"), PROFILE, with_later_inserts=True, keep=session.stored)
    late = staged(timed.where("not early").drop("event_id", "cut", "early").join(alike.rows.select("row_id"), "row_id", "left_semi"), "session-log")
    spaces, none = staged(log.select("space").distinct(), "session-spaces"), staged(replicate.checkpoints_of(log.limit(0)), "session-checkpoints")
    mine = {"a": late.where("hlc.node = 'n0'"), "b": late.where("hlc.node <> 'n0'")}
    sides = [session.Replica("h", spaces, merge.merged(alike, rows, PROFILE, with_later_inserts=True, keep=session.stored), none) for rows in mine.values()]
    after = session.session_round(*sides, PROFILE)
    out = [r.state.rows.join(merge.wide(r.state.fields, PROFILE["profile"]), merge.ROW).select(F.lit(n).alias("side"), "row_id", F.col("hlc.ms").alias("birth_ms"), "name", "score") for n, r in zip(mine, after, strict=True)]
    return out[0].unionByName(out[1])


CUT_MS = "(SELECT CAST((min(ms) + max(ms)) // 2 AS BIGINT) FROM ev)"
CP = f"cp AS (SELECT space, n, max({STAMP}) AS k FROM ev WHERE ms <= {CUT_MS} AND n <> 'n2' GROUP BY space, n)"
NEWER = "(k IS NULL OR ms > k.ms OR (ms = k.ms AND c > k.c))"


def half_checkpoints(log: DataFrame) -> DataFrame:
    """Checkpoints at the middle of the log's time; one node is not known yet."""
    middle = log.agg(F.floor((F.min("hlc.ms") + F.max("hlc.ms")) / 2).alias("cut"))
    return replicate.checkpoints_of(log.join(F.broadcast(middle)).where("hlc.ms <= cut and hlc.node <> 'n2'"))


@query(f"WITH {EV}, {CP} SELECT event_id FROM ev LEFT JOIN cp USING (space, n) WHERE {NEWER}")
def checkpoint_filter(spark, sf_dir):
    """Changes after a peer's checkpoints; all of an unknown node."""
    log = event_log(spark, sf_dir)
    return replicate.after_checkpoints(log, half_checkpoints(log)).select("event_id")


@query(f"""WITH {EV}, {CP}, r AS (SELECT space, n, max({STAMP}) AS k2 FROM ev WHERE event_type = 'click' GROUP BY space, n),
  j AS (SELECT coalesce(cp.space, r.space) AS space, coalesce(cp.n, r.n) AS node, CASE WHEN k IS NULL OR k2 > k THEN coalesce(k2, k) ELSE k END AS h FROM cp FULL JOIN r ON cp.space = r.space AND cp.n = r.n)
  SELECT space, node, h.ms AS hlc_ms, h.c AS hlc_counter, h.n AS hlc_node FROM j""")
def checkpoint_advance(spark, sf_dir):
    """Checkpoints after a batch never go back."""
    log = event_log(spark, sf_dir)
    return flat(replicate.advanced(half_checkpoints(log), replicate.checkpoints_of(log.where("event_type = 'click'"))))


@query(f"""WITH {EV}, {CP}, r AS (SELECT space, n, max({STAMP}) AS k2 FROM ev WHERE event_type = 'signup' AND event_id % 7 = 0 GROUP BY space, n)
  SELECT coalesce(cp.space, r.space) AS space, coalesce(cp.n, r.n) AS node, coalesce(k2, k).ms AS hlc_ms FROM cp FULL JOIN r ON cp.space = r.space AND cp.n = r.n""")
def checkpoint_replace(spark, sf_dir):
    """A forced checkpoint simply replaces the stored one."""
    log = event_log(spark, sf_dir)
    fresh = replicate.checkpoints_of(log.where("event_type = 'signup' and event_id % 7 = 0"))
    return replicate.advanced(half_checkpoints(log), fresh, force=True).select("space", "node", F.col("hlc.ms").alias("hlc_ms"))


@query(f"""WITH {EV}, {CP}, k AS (SELECT space, n, max({STAMP}) AS own FROM ev GROUP BY space, n)
  SELECT k.space, k.n AS node, CASE WHEN k.n = 'n0' THEN greatest(own.ms, 1700000000000) ELSE coalesce(cp.k.ms, 0) END AS hlc_ms,
    CAST(CASE WHEN k.n = 'n0' THEN CASE WHEN own.ms >= 1700000000000 THEN own.c ELSE 0 END ELSE coalesce(cp.k.c, 0) END AS INTEGER) AS hlc_counter
  FROM k LEFT JOIN cp ON k.space = cp.space AND k.n = cp.n""")
def resume_vector(spark, sf_dir):
    """What to resume from: own clock or now, received clocks, or the beginning."""
    log = event_log(spark, sf_dir)
    nodes = replicate.checkpoints_of(log).withColumnRenamed("hlc", "last")
    out = replicate.resume_vector(nodes, half_checkpoints(log), "n0", F.lit(1_700_000_000_000))
    return out.select("space", "node", F.col("hlc.ms").alias("hlc_ms"), F.col("hlc.counter").alias("hlc_counter"))


@query(f"""WITH {LOG}, {CP}, own AS (SELECT space, row_id FROM log LEFT JOIN cp USING (space, n) WHERE n = 'n1' AND {NEWER} AND event_type <> 'purchase'),
  held AS (SELECT space, row_id FROM log WHERE user_id % 10 = 0) SELECT count(*) AS unsent FROM (SELECT * FROM own UNION SELECT * FROM held)""")
def unsent_row_count(spark, sf_dir):
    """Own rows that still wait, over births, fields and deletions, and rows held back."""
    log = profile_log(spark, sf_dir)
    parts = [log.where(F.col("kind") == k) for k in ("insert", "update")] + [log.where("kind = 'delete' and reason = 'userDelete'")]
    held = log.where("cast(row_id as bigint) % 10 = 0")
    return replicate.unsent_rows(parts, half_checkpoints(event_log(spark, sf_dir)), "n1", held)


@query(f"""WITH {LOG}, {CP}, b AS (SELECT space, row_id, min({STAMP}) AS s FROM log WHERE event_type = 'signup' GROUP BY space, row_id),
  w AS (SELECT space, row_id, 'name' AS col, {STAMP} AS s FROM log WHERE event_type IN ('signup', 'view') UNION ALL SELECT space, row_id, 'score', {STAMP} FROM log WHERE event_type IN ('signup', 'click')),
  f AS (SELECT space, row_id, col, max(s) AS s FROM w SEMI JOIN b USING (space, row_id) GROUP BY space, row_id, col),
  g AS (SELECT space, row_id, max({{'cl': cl, 's': {STAMP}}}).s AS s FROM log SEMI JOIN b USING (space, row_id) WHERE cl IS NOT NULL GROUP BY space, row_id),
  every AS (SELECT space, row_id, s.n AS n, s.ms AS ms, s.c AS c FROM b UNION ALL SELECT space, row_id, s.n, s.ms, s.c FROM f UNION ALL SELECT space, row_id, s.n, s.ms, s.c FROM g)
  SELECT count(*) AS unsent FROM (SELECT DISTINCT space, row_id FROM every LEFT JOIN cp USING (space, n) WHERE n = 'n1' AND {NEWER})""")
def unsent_stored_rows(spark, sf_dir):
    """Own rows of a stored state that still wait, counted while checkpoints may be replaced."""
    state = merge.state_of(profile_log(spark, sf_dir), PROFILE)
    stored = [staged(t.select("space", "tbl", "row_id", "hlc"), "stored") for t in (state.rows, state.fields, state.generations)]
    confirmed = half_checkpoints(event_log(spark, sf_dir))
    return spark.createDataFrame([(replicate.unsent_count(lambda: stored, lambda: confirmed, "n1"),)], "unsent long")


STATE_SQL = f"""b AS (SELECT space, row_id, min({STAMP}) AS k0 FROM log WHERE event_type = 'signup' GROUP BY space, row_id),
  w AS (SELECT space, row_id, 'name' AS col, nm AS v, {STAMP} AS s FROM log WHERE event_type IN ('signup', 'view')
    UNION ALL SELECT space, row_id, 'score', CASE event_type WHEN 'click' THEN cents END, {STAMP} FROM log WHERE event_type IN ('signup', 'click')),
  f AS (SELECT space, row_id, col, max(s) AS s, last(v ORDER BY s) AS v FROM w SEMI JOIN b USING (space, row_id) GROUP BY space, row_id, col),
  g AS (SELECT space, row_id, max(cl) AS cl, max({{'cl': cl, 'ms': ms, 'c': c, 'n': n}}) AS s FROM log SEMI JOIN b USING (space, row_id) WHERE cl IS NOT NULL GROUP BY space, row_id)"""


@query(f"WITH {LOG}, {STATE_SQL} SELECT row_id, col AS \"column\", s.ms AS hlc_ms FROM f JOIN b USING (space, row_id) WHERE s <> k0")
def sparse_field_clocks(spark, sf_dir):
    """Field clocks that differ from their row's; the others are redundant."""
    return merge.sparse_clocks(merge.state_of(profile_log(spark, sf_dir), PROFILE)).select("row_id", "column", F.col("hlc.ms").alias("hlc_ms"))


@query(f"""WITH {LOG}, {CP}, {STATE_SQL}, p AS (SELECT space, row_id, 'insert' AS kind, NULL AS col, k0.ms AS ms, k0.c AS c, k0.n AS n FROM b
    UNION ALL SELECT space, row_id, 'update', col, s.ms, s.c, s.n FROM f JOIN b USING (space, row_id) WHERE s <> k0
    UNION ALL SELECT space, row_id, 'delete', NULL, s.ms, s.c, s.n FROM g)
  SELECT space, row_id, kind, col AS "column", ms AS hlc_ms FROM p LEFT JOIN cp USING (space, n) WHERE {NEWER}""")
def pending_changes(spark, sf_dir):
    """Changes to send from state: births, sparse updates, replicated generations."""
    state = merge.state_of(profile_log(spark, sf_dir), PROFILE)
    out = replicate.pending(state, half_checkpoints(event_log(spark, sf_dir)))
    return out.select("space", "row_id", "kind", "column", F.col("hlc.ms").alias("hlc_ms"))


@query(f"""WITH {LOG}, {STATE_SQL}, u AS (SELECT space, row_id, col, s FROM f JOIN b USING (space, row_id) WHERE s <> k0),
  a AS (SELECT DISTINCT space, row_id, 'name' AS col, CASE WHEN user_id % 6 = 0 THEN NULL ELSE 'wish-' || row_id END AS wish FROM log WHERE user_id % 3 = 0)
  SELECT u.row_id, u.col AS "column", CASE WHEN a.row_id IS NOT NULL THEN wish ELSE v END AS value, false AS missing
  FROM u JOIN f USING (space, row_id, col) LEFT JOIN a ON a.space = u.space AND a.row_id = u.row_id AND a.col = u.col""")
def payload_resolution(spark, sf_dir):
    """Late values of pending updates; an authored null counts."""
    log = profile_log(spark, sf_dir)
    state = merge.state_of(log, PROFILE)
    updates = replicate.pending(state, replicate.checkpoints_of(log).limit(0)).where("kind = 'update'")
    user = F.col("row_id").cast("bigint")
    wish = F.when(user % 6 == 0, F.lit(None)).otherwise(F.concat(F.lit("wish-"), F.col("row_id")))
    attempted = log.where(user % 3 == 0).select("space", "tbl", "row_id", F.lit("name").alias("column"), wish.alias("value")).distinct()
    return replicate.resolved(updates, state.fields, attempted).select("row_id", "column", "value", "missing")


@query(f"WITH {LOG}, {STATE_SQL} SELECT space, max(ms) AS hlc_ms FROM (SELECT space, k0.ms AS ms FROM b UNION ALL SELECT space, s.ms FROM f UNION ALL SELECT space, s.ms FROM g) GROUP BY space")
def latest_stamp(spark, sf_dir):
    """The newest stored clock of each space."""
    return merge.latest_stamp(merge.state_of(profile_log(spark, sf_dir), PROFILE)).select("space", F.col("hlc.ms").alias("hlc_ms"))


@query(f"""WITH {EV} SELECT max(CASE WHEN n = 'n1' THEN {STAMP} END).ms AS own_ms, max(CASE WHEN n = 'n1' THEN {STAMP} END).c AS own_counter,
  max(CASE WHEN n <> 'n1' THEN {STAMP} END).ms AS others_ms, max(CASE WHEN n <> 'n1' THEN {STAMP} END).n AS others_node FROM ev""")
def own_and_others_clock(spark, sf_dir):
    """A batch's newest own and foreign clocks."""
    out = merge.own_and_others(event_log(spark, sf_dir), F.lit("n1"))
    return out.select(F.col("own.ms").alias("own_ms"), F.col("own.counter").alias("own_counter"), F.col("others.ms").alias("others_ms"), F.col("others.node").alias("others_node"))


@query(f"WITH {EV} SELECT space, n AS node, count(*) AS changes, max(ms) AS hlc_ms FROM ev GROUP BY space, n")
def max_clock_per_node(spark, sf_dir):
    """Newest clock and size per space and node."""
    log = event_log(spark, sf_dir)
    return log.groupBy("space", F.col("hlc.node").alias("node")).agg(F.count("*").alias("changes"), F.max("hlc").alias("hlc")).select("space", "node", "changes", F.col("hlc.ms").alias("hlc_ms"))


@query(f"""WITH {LOG} SELECT space, row_id, string_agg(DISTINCT CASE event_type WHEN 'click' THEN 'score' WHEN 'view' THEN 'name' END, ',' ORDER BY CASE event_type WHEN 'click' THEN 'score' WHEN 'view' THEN 'name' END) AS columns,
  count(*) AS changes FROM log GROUP BY space, row_id""")
def changes_by_row(spark, sf_dir):
    """Rows that a batch touches and the columns it writes."""
    out = merge.by_row(profile_log(spark, sf_dir))
    return out.select("space", "row_id", F.when(F.size("columns") > 0, F.array_join("columns", ",")).alias("columns"), "changes")


@query("""WITH d AS (SELECT event_id, 'n' || (event_id % 3) AS node, epoch_us(date_trunc('day', ts)) // 1000 AS wall FROM events),
  t AS (SELECT event_id, node, max(wall) OVER (PARTITION BY node ORDER BY event_id) AS ms FROM d)
  SELECT event_id, node, ms AS hlc_ms, CAST(row_number() OVER (PARTITION BY node, ms ORDER BY event_id) - 1 AS INTEGER) AS hlc_counter FROM t""")
def hlc_stamp(spark, sf_dir):
    """Stamps of each node's writes in sequence."""
    e = table(spark, sf_dir, "events")
    day = F.date_trunc("day", F.col("ts"))
    writes = e.select("event_id", F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")).alias("node"), clocks.truncated_ms(day.cast("timestamp_ntz")).alias("wall_ms"))
    out = clocks.stamped(writes, node="node", wall_ms="wall_ms", order="event_id", bucket=1024)
    return out.select("event_id", "node", F.col("hlc.ms").alias("hlc_ms"), F.col("hlc.counter").alias("hlc_counter"))


NODE = "'0000000' || (event_id % 3) || '-0000-4000-8000-000000000000'"


@query(f"""WITH {EV}, t AS (SELECT event_id, ms, c, {NODE} AS node, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM ev)
  SELECT event_id, ms AS hlc_ms, c AS hlc_counter, node AS hlc_node, iso || '-' || upper(lpad(hex(c), 4, '0')) || '-' || node AS text,
    event_id % 7 = 0 AS malformed, ms AS unix_ms FROM t""")
def hlc_parse_format(spark, sf_dir):
    """Clock texts: written, read back from ISO and from unix ms with a worker number; malformed ones give null."""
    e = event_log(spark, sf_dir)
    node = F.concat(F.lit("0000000"), (F.col("event_id") % 3).cast("string"), F.lit("-0000-4000-8000-000000000000"))
    own = e.select("event_id", clocks.hlc(F.col("hlc.ms"), F.col("hlc.counter"), node).alias("own")).withColumn("text", clocks.to_text(F.col("own")))
    unix = clocks.parse(F.concat(F.col("own.ms").cast("string"), F.lit("-"), F.lower(F.hex(F.col("own.counter").cast("bigint"))), F.lit("-"), node, F.lit(":7")))
    bad = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), F.col("text"))).otherwise(F.col("text"))
    back = own.withColumns({"hlc": clocks.parse(F.col("text")), "unix_ms": unix["ms"], "malformed": clocks.parse(bad).isNull()})
    return flat(back.select("event_id", "hlc", "text", "malformed", "unix_ms"))



def neighbours(spark, sf_dir, shift: int = 1) -> DataFrame:
    """Each event's clock beside the next event's, by a self join on the id."""
    e = event_log(spark, sf_dir).select("event_id", "hlc")
    return e.join(e.select((F.col("event_id") - shift).alias("event_id"), F.col("hlc").alias("remote")), "event_id")


PAIRS = f"WITH {EV}, p AS (SELECT a.event_id, a.ms, a.c, a.n, b.ms AS rms, b.c AS rc, b.n AS rn FROM ev a JOIN ev b ON b.event_id = a.event_id + {{k}})"


@query(PAIRS.replace("{k}", "3") + """, r AS (SELECT *, rms > ms OR (rms = ms AND rc > c) AS newer FROM p),
  x AS (SELECT *, CASE WHEN newer AND n = rn THEN 'duplicateNode' WHEN newer AND rms - (ms - 1000) > 3600000 THEN 'remoteAhead' END AS error FROM r)
  SELECT event_id, error, CASE WHEN error IS NULL THEN CASE WHEN newer THEN rms ELSE ms END END AS hlc_ms FROM x""")
def hlc_duplicate_node(spark, sf_dir):
    """Merging newer clocks of one's own node is an error."""
    out = neighbours(spark, sf_dir, 3).withColumn("m", clocks.merge(F.col("hlc"), F.col("remote"), F.col("hlc.ms") - 1000))
    return out.select("event_id", F.col("m.error").alias("error"), F.col("m.hlc.ms").alias("hlc_ms"))


@query(PAIRS.replace("{k}", "1") + """, r AS (SELECT *, rms > ms OR (rms = ms AND rc > c) AS newer FROM p),
  x AS (SELECT *, CASE WHEN newer AND n = rn THEN 'duplicateNode' WHEN newer AND rms - (ms + 60000) > 3600000 THEN 'remoteAhead' END AS error FROM r)
  SELECT event_id, error, CASE WHEN error IS NULL THEN CASE WHEN newer THEN rms ELSE ms END END AS hlc_ms,
    CAST(CASE WHEN error IS NULL THEN CASE WHEN newer THEN rc ELSE c END END AS INTEGER) AS hlc_counter, CASE WHEN error IS NULL THEN n END AS hlc_node FROM x""")
def hlc_merge(spark, sf_dir):
    """A clock after seeing another node's, with its errors."""
    out = neighbours(spark, sf_dir).withColumn("m", clocks.merge(F.col("hlc"), F.col("remote"), F.col("hlc.ms") + 60000))
    return flat(out.select("event_id", F.col("m.error").alias("error"), F.col("m.hlc").alias("hlc")))


@query(PAIRS.replace("{k}", "3") + """, x AS (SELECT *, CASE WHEN (rms > ms OR (rms = ms AND rc > c)) AND rms - ms > 3600000 THEN 'remoteAhead' END AS error FROM p)
  SELECT event_id, error, CASE WHEN error IS NULL THEN greatest(ms, rms) END AS hlc_ms FROM x""")
def hlc_adopt_own(spark, sf_dir):
    """A clock after its own stamp came back, bounded by drift."""
    out = neighbours(spark, sf_dir, 3).withColumn("m", clocks.adopt_own(F.col("hlc"), F.col("remote"), F.col("hlc.ms")))
    return out.select("event_id", F.col("m.error").alias("error"), F.col("m.hlc.ms").alias("hlc_ms"))


@query(f"""WITH {EV}, x AS (SELECT event_id, ms, c, n, ms - (event_id % 5) * 1000000 + 1000000 AS wall FROM ev), y AS (SELECT *, greatest(ms, wall) AS nms FROM x),
  z AS (SELECT *, CASE WHEN nms = ms THEN c + 1 ELSE 0 END AS nc, CASE WHEN nms - wall > 2500000 THEN 'localAhead' WHEN nms = ms AND c + 1 > 65535 THEN 'overflow' END AS error FROM y)
  SELECT event_id, error, CASE WHEN error IS NULL THEN nms END AS hlc_ms, CAST(CASE WHEN error IS NULL THEN nc END AS INTEGER) AS hlc_counter FROM z""")
def hlc_increment(spark, sf_dir):
    """The next stamp of a clock, with drift and overflow errors."""
    wall = F.col("hlc.ms") - (F.col("event_id") % 5) * 1_000_000 + 1_000_000
    out = event_log(spark, sf_dir).withColumn("m", clocks.increment(F.col("hlc"), wall, 2_500_000))
    return out.select("event_id", F.col("m.error").alias("error"), F.col("m.hlc.ms").alias("hlc_ms"), F.col("m.hlc.counter").alias("hlc_counter"))


@query("""WITH m AS (SELECT event_id, epoch_us(ts) AS us FROM events), k AS (SELECT CAST((min(us) + max(us)) // 2 AS BIGINT) AS now FROM m)
  SELECT event_id, us // 1000 - now // 1000 > 3600000 AS refused, CAST(ceil(abs(us - now) / 1000.0) AS BIGINT) AS drift_ms FROM m, k""")
def drift_reject(spark, sf_dir):
    """Late changes are taken, stamps too far in the future refused; drift rounds up."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", clocks.micros(F.col("ts")).alias("us"))
    now = e.agg(F.floor((F.min("us") + F.max("us")) / 2).cast("bigint").alias("now"))
    stamp = clocks.hlc(clocks.truncated_ms(F.col("ts")), F.lit(0), F.lit("n"))
    out = e.join(F.broadcast(now)).withColumn("refused", clocks.too_far_ahead(stamp, F.floor(F.col("now") / 1000)))
    return out.select("event_id", "refused", clocks.drift_ms(F.abs(F.col("us") - F.col("now"))).alias("drift_ms"))
