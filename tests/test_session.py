"""Session rounds: replicas that write apart end in one state, whatever the order of rounds."""

import random

import pytest

from tidemark.errors import SchemaMismatch
from tidemark.operators import merge, session
from tidemark.plans import logs as log_queries
from tidemark.sources import log as logs
from tidemark.streaming.live import fingerprint

COLUMNS = {"note": ["title", "folder"]}


def replica(spark, log, spaces=("s", "t"), tables="h"):
    frame = spark.createDataFrame(log, logs.SCHEMA)
    return session.Replica(tables, spark.createDataFrame([(s,) for s in spaces], "space string"), merge.state_of(frame, COLUMNS, with_later_inserts=True), spark.createDataFrame([], "space string, node string, hlc struct<ms:bigint,counter:int,node:string>"))


def digests(side):
    columns = {"rows": [*merge.ROW, "hlc"], "fields": [*merge.FIELD, "value", "hlc"], "generations": [*merge.ROW, "cl_flag", "hlc", "reason"]}
    return {name: fingerprint(getattr(side.state, name).select(*cols)) for name, cols in columns.items()}


def writes(rng, node, at, rows):
    out = []
    for i in range(12):
        space, row = rng.choice(rows)
        clock, kind = (at + i, 0, node), rng.choice(["insert", "update", "update", "delete"])
        out.append((space, "note", row, kind, rng.choice(COLUMNS["note"]) if kind == "update" else None, f"{node}{i}" if kind == "update" else None, {"title": f"{node}{i}"} if kind == "insert" else None,
                    rng.randrange(1, 5) if kind == "delete" else None, rng.choice(["userDelete", "userReinsert", "uniqueLoser"]) if kind == "delete" else None, clock))
    return out


@pytest.mark.parametrize("seed", [1])
def test_three_replicas_converge(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("st"), f"r{i}") for i in range(6)]
    born = [(s, "note", r, "insert", None, None, {"title": r}, None, None, (1, i, "a")) for i, (s, r) in enumerate(rows)]
    logs_of = [born + writes(rng, node, 10, rows) for node in "abc"]
    sides = [replica(spark, log) for log in logs_of]
    for x, y in ((0, 1), (1, 2), (2, 0), (0, 1)):
        sides[x], sides[y] = session.session_round(sides[x], sides[y], COLUMNS)
    whole = replica(spark, [change for log in logs_of for change in log])
    assert digests(sides[0]) == digests(sides[1]) == digests(sides[2]) == digests(whole)
    again = session.outgoing(sides[0].state, session.known(sides[1]), sides[0].spaces)
    assert again.isEmpty()


def test_only_shared_spaces_of_equal_tables_are_exchanged(spark):
    make = lambda node, space: [(space, "note", f"{node}1", "insert", None, None, {"title": node}, None, None, (1, 0, node))]
    a, b = replica(spark, make("a", "s") + make("x", "t"), ["s", "t"]), replica(spark, make("b", "s"), ["s"])
    a, b = session.session_round(a, b, COLUMNS)
    assert {r.row_id for r in b.state.rows.collect()} == {"a1", "b1"} and {r.row_id for r in a.state.rows.collect()} == {"a1", "b1", "x1"}
    assert {(r.space, r.node, r.hlc.ms) for r in b.received.collect()} == {("s", "a", 1)}
    with pytest.raises(SchemaMismatch):
        session.session_round(a, replica(spark, [], tables="other"), COLUMNS)


def test_a_round_works_states_out_once(spark, monkeypatch):
    reads = []

    def counting(df):
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        reads.extend(text for i in range(leaves.size()) if "event_type#" in (text := leaves.apply(i).toString()) or "payload#" in text)
        return df

    for module in (session, log_queries):
        monkeypatch.setattr(module, "staged", lambda df, name, write=module.staged: write(counting(df), name))
    counting(log_queries.session_convergence(spark, "/root/testdata/sf0.001"))
    assert len(reads) <= 30  # reads of the log or a part of it


def test_kept_states_equal_those_worked_out_at_each_use(spark):
    rng = random.Random(5)
    rows = [(rng.choice("st"), f"r{i}") for i in range(6)]
    first, second = (spark.createDataFrame([c for n in "ab" for c in writes(rng, n, at, rows)], logs.SCHEMA) for at in (1, 30))
    for again in (False, True):
        kept = merge.merged(merge.state_of(first, COLUMNS, with_later_inserts=again, keep=session.stored), second, COLUMNS, with_later_inserts=again, keep=session.stored)
        plain = merge.merged(merge.state_of(first, COLUMNS, with_later_inserts=again), second, COLUMNS, with_later_inserts=again)
        assert digests(session.Replica("h", None, kept, None)) == digests(session.Replica("h", None, plain, None))
