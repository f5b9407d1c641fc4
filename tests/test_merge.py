"""Merging: any order and any cut of a log leads to one state."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merge, spaces
from tidemark.sources import log as logs

COLUMNS = {"note": ["title", "folder"]}


def make_log(spark, seed, n=120, rows=12):
    rng = random.Random(seed)
    out = [("s", "note", f"r{r}", "insert", None, None, {"title": f"t{r}"}, None, None, (1, r, "a")) for r in range(rows)]
    for i in range(n):
        clock = (rng.randrange(2, 30), i, rng.choice("abc"))
        row = f"r{rng.randrange(rows)}"
        kind = rng.choice(["insert", "update", "update", "delete"])
        if kind == "insert":
            out.append(("s", "note", row, kind, None, None, {"folder": f"f{i}"}, None, None, clock))
        elif kind == "update":
            out.append(("s", "note", row, kind, rng.choice(COLUMNS["note"]), rng.choice([None, f"v{i}"]), None, None, None, clock))
        else:
            out.append(("s", "note", row, kind, None, None, None, rng.randrange(1, 6), rng.choice(["userDelete", "userReinsert", "uniqueLoser"]), clock))
    return spark.createDataFrame(out, logs.SCHEMA), out


def model(log):
    born, fields, flags = {}, {}, {}
    for _, _, row, kind, column, value, payload, flag, reason, clock in sorted(log, key=lambda r: (r[3] != "insert", r[9])):
        if kind == "insert":
            born[row] = min(clock, born.get(row, clock))
        writes = [(c, payload.get(c)) for c in COLUMNS["note"]] if kind == "insert" else [(column, value)] if kind == "update" else []
        for c, v in writes:
            if (row, c) not in fields or clock > fields[row, c][0]:
                fields[row, c] = (clock, v)
        if kind == "delete" and reason.startswith("user"):
            flags[row] = max(flags.get(row, (0,)), (flag, clock, reason))
    return born, {k: v for k, v in fields.items() if k[0] in born}, {k: v for k, v in flags.items() if k in born}


def collected(state):
    return (
        {r.row_id: tuple(r.hlc) for r in state.rows.collect()}, {(r.row_id, r.column): (tuple(r.hlc), r.value) for r in state.fields.collect()},
        {r.row_id: (r.cl_flag, tuple(r.hlc), r.reason) for r in state.generations.collect()},
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_state_of_a_log(spark, seed):
    frame, log = make_log(spark, seed)
    assert collected(merge.state_of(frame, COLUMNS)) == model(log)


@pytest.mark.parametrize("seed", [3, 4])
def test_batches_in_any_order_converge(spark, seed):
    frame, log = make_log(spark, seed)
    rng = random.Random(seed)
    inserts = spark.createDataFrame(log[:12], logs.SCHEMA)
    rest = log[12:]
    rng.shuffle(rest)
    state = merge.state_of(inserts, COLUMNS)
    for part in (rest[:50], rest[40:90], rest[80:], rest[:20]):  # overlaps: merging twice changes nothing
        state = merge.merged(state, spark.createDataFrame(part, logs.SCHEMA), COLUMNS)
        state = merge.State(*(t.cache() for t in (state.rows, state.fields, state.generations)))
    assert collected(state) == model(log)


def test_unknown_rows_are_dropped_and_nulls_win(spark):
    log = [("s", "note", "x", "update", "title", "v", None, None, None, (1, 0, "a")), ("s", "note", "y", "insert", None, None, {"title": "t"}, None, None, (1, 0, "a")), ("s", "note", "y", "update", "title", None, None, None, None, (2, 0, "a"))]
    state = merge.state_of(spark.createDataFrame(log, logs.SCHEMA), COLUMNS)
    assert collected(state)[1] == {("y", "title"): ((2, 0, "a"), None), ("y", "folder"): ((1, 0, "a"), None)}
    assert [(r.row_id, r.column) for r in merge.sparse_clocks(state).collect()] == [("y", "title")]


def test_a_log_written_twice_is_read_once(spark, tmp_path):
    frame, log = make_log(spark, 5)
    for _ in range(2):
        logs.append(frame, str(tmp_path / "log"), 1)
    logs.append(frame.limit(3), str(tmp_path / "log"), 2)
    assert logs.load(spark, str(tmp_path / "log")).count() == len(log) + 3
    back = logs.decoded(logs.encoded(frame))
    assert collected(merge.state_of(back, COLUMNS)) == model(log)


def test_grants_and_violations(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user string")
    members = spark.createDataFrame([("a", "s", "readOnly"), ("b", "s", "readWrite"), ("a", "a", "readOnly")], "user string, space string, role string")
    assert {(r.user, r.space): r.role for r in spaces.grants(users, members).collect()} == {("a", "a"): "readWrite", ("b", "b"): "readWrite", ("a", "s"): "readOnly", ("b", "s"): "readWrite"}
    with pytest.raises(LookupError):
        spaces.granted_all(members, users, members.select("space").distinct(), "nowhere", "readOnly")
    with pytest.raises(ValueError):
        spaces.granted_all(members, users, members.select("space").distinct(), "s", "owner")
    rows = spark.createDataFrame([("t", None, 5), ("t", None, 3), ("t", "o", 4)], "type string, owner string, seen_at long").withColumn("hlc", F.col("seen_at"))
    assert {(r.owner, r.first_seen, r.last_seen, r.occurrences) for r in spaces.violations(rows, ["type", "owner"]).collect()} == {(None, 3, 5, 2), ("o", 4, 4, 1)}


@pytest.mark.parametrize("seed", [3, 4])
def test_inserts_in_any_order_of_batches_give_the_rebuild(spark, seed):
    frame, log = make_log(spark, seed)
    log = [r for r in log if r[3] == "insert"]
    rng = random.Random(seed)
    rng.shuffle(log)
    plain = lambda state: ({(r.row_id, r.hlc) for r in state.rows.collect()}, {(r.row_id, r.cl_flag, r.hlc, r.reason) for r in state.generations.collect()}, {(r.row_id, r.column, r.value, r.hlc) for r in state.fields.collect()})
    want = plain(merge.state_of(spark.createDataFrame(log, logs.SCHEMA), COLUMNS, with_later_inserts=True))
    cuts = sorted(rng.sample(range(1, len(log)), 2))
    state = merge.state_of(spark.createDataFrame([], logs.SCHEMA), COLUMNS)
    for a, b in zip([0, *cuts], [*cuts, len(log)]):
        state = merge.merged(state, spark.createDataFrame(log[a:b], logs.SCHEMA), COLUMNS, with_later_inserts=True)
    again = merge.merged(state, spark.createDataFrame(log[:4], logs.SCHEMA), COLUMNS, with_later_inserts=True)
    assert plain(state) == want == plain(again)
