"""Tables that a stream carries from batch to batch, and sessions that fall silent."""

import random
import time

import pandas as pd
import pytest

from tidemark.functions import hlc as clocks
from tidemark.streaming import carried, live

WRITES = "node string, seq long, wall_ms long"


def sequential(writes, drift, last):
    """Each node's clock, one write after another."""
    out = {}
    for node, seq, wall in writes:
        ms, counter = last.get(node, (-1, 0))
        now = (wall, 0) if wall > ms else (ms, counter + 1)
        error = "localAhead" if now[0] - wall > drift else "overflow" if now[1] > clocks.MAX_COUNTER else None
        if error is None:
            last[node] = now
        out[node, seq] = (*(now if error is None else (None, None)), error)
    return out


@pytest.mark.parametrize("bucket", [None, 4])
def test_stamps_go_on_over_batches(spark, tmp_path, bucket):
    rng, last, want = random.Random(7), {}, {}
    for k in range(3):
        sink = carried.stamping(str(tmp_path / "s"), bucket=bucket, max_drift_ms=5)  # a new one each time
        writes = [(rng.choice("ab"), 100 * k + i, 20 * k + rng.choice([0, 0, 3, 9])) for i in range(40)]
        frame = spark.createDataFrame(writes, WRITES)
        sink(frame, k)
        sink(frame, k)  # tried again
        want |= sequential(writes, 5, last)
    got = {(r.node, r.seq): (*((r.hlc.ms, r.hlc.counter) if r.hlc else (None, None)), r.error) for r in sink.out(spark).collect()}
    assert got == want and {e for *_, e in want.values()} == {None, "localAhead"}
    assert {r.node: (r.last.ms, r.last.counter) for r in sink.carried(spark).collect()} == last
    assert sink.versions(spark) == [0, 1, 2]


def test_the_last_counter_is_not_passed(spark):
    writes = spark.createDataFrame([("a", i, 1, (1, clocks.MAX_COUNTER - 2, "a")) for i in range(4)] + [("a", 4, 2, (1, clocks.MAX_COUNTER - 2, "a"))], f"{WRITES}, last {clocks.TYPE}")
    for bucket in (None, 2):
        out = clocks.stamped(writes, node="node", wall_ms="wall_ms", order="seq", last="last", bucket=bucket, max_drift_ms=10)
        assert [(r.hlc.counter if r.hlc else None, r.error) for r in out.orderBy("seq").collect()] == [(65534, None), (65535, None), (None, "overflow"), (None, "overflow"), (0, None)]


def test_only_changed_grants_are_announced(spark, tmp_path):
    sink = carried.announcing(str(tmp_path / "g"))
    batches = [
        [("u", "s", "readOnly", 1), ("u", "s", "readOnly", 2), ("u", "t", None, 3), ("v", "s", "readWrite", 4)],
        [],
        [("u", "s", "readOnly", 5), ("u", "s", "readWrite", 6), ("v", "s", None, 7), ("v", "s", None, 8)],
        [("v", "s", "readOnly", 9), ("u", "s", None, 10), ("u", "s", "readWrite", 11)],
    ]
    for k, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, "user string, space string, role string, at long"), k)
    assert sorted((r["at"], r.user, r.space, r.role, r.action) for r in sink.out(spark).collect()) == [
        (1, "u", "s", "readOnly", "insert"), (4, "v", "s", "readWrite", "insert"), (6, "u", "s", "readWrite", "update"), (7, "v", "s", None, "delete"),
        (9, "v", "s", "readOnly", "insert"), (10, "u", "s", None, "delete"), (11, "u", "s", "readWrite", "insert"),
    ]
    assert sorted((r.user, r.space, r.role) for r in sink.carried(spark).collect()) == [("u", "s", "readWrite"), ("v", "s", "readOnly")]
    assert sink.versions(spark) == [1, 2, 3] and sink.carried(spark, 1).count() == 2


def test_a_session_sends_a_change_once(spark, tmp_path):
    schema = f"session string, space string, tbl string, row_id string, kind string, column string, hlc {clocks.TYPE}"
    change = lambda session, ms, column="c", kind="update": (session, "s", "t", "1", kind, column, (ms, 0, "n"))
    sink = carried.sending_once(str(tmp_path / "m"))
    batches = [
        [change("a", 1), change("a", 1), change("b", 1), change("a", 1, None, "insert")],
        [change("a", 1), change("a", 2), change("b", 1), change("a", 1, None, "insert"), ("a", None, None, None, "end", None, None)],
        [change("a", 2), change("b", 1), change("b", 3)],
    ]
    got = []
    for k, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), k)
        now = sorted((r.session, r.column, r.hlc.ms) for r in sink.out(spark).where("kind = 'update'").collect())
        got.append(now)
    first, second = [("a", "c", 1), ("b", "c", 1)], [("a", "c", 2)]
    assert got == [first, sorted(first + second), sorted(first + 2 * second + [("b", "c", 3)])]
    assert sink.out(spark).where("kind = 'insert'").count() == 1
    assert sorted((r.session, r.hlc.ms) for r in sink.carried(spark).collect()) == [("a", 2), ("b", 3)]


def test_a_table_before_its_first_batch_is_empty(spark, tmp_path):
    for make in (carried.stamping, carried.announcing, carried.sending_once):
        sink = make(str(tmp_path / make.__name__))
        assert sink.out(spark).count() == sink.carried(spark).count() == 0 and sink.versions(spark) == []
        sink(spark.createDataFrame([], WRITES if make is carried.stamping else sink.schema), 0)
        assert sink.out(spark).count() == sink.carried(spark).count() == 0 and sink.versions(spark) == [0]
    with pytest.raises(ValueError):
        carried.Carrying("f", "a int", "a int", None, None, kept=1)


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path):
    sink = carried.stamping(str(tmp_path / "s"))
    sink(spark.createDataFrame([("a", 1, 5)], WRITES), 0)
    sink.out(spark).write.parquet(str(tmp_path / "s" / "out" / "v1"))  # its carried table was not written
    assert sink.out(spark).count() == 1
    sink(spark.createDataFrame([("a", 2, 5)], WRITES), 1)
    assert sorted((r.seq, r.hlc.counter) for r in sink.out(spark).collect()) == [(1, 0), (2, 1)]


def test_a_silent_session_is_idle_and_a_begun_batch_waits(spark, tmp_path):
    schema, source = "session string, seq int, type string, changes int", tmp_path / "frames"
    source.mkdir()

    def arrives(name, rows):
        frame = pd.DataFrame(rows, columns=["session", "seq", "type", "changes"]).astype({"seq": "int32", "changes": "Int32"})
        frame.to_parquet(tmp_path / f"{name}.parquet")
        (tmp_path / f"{name}.parquet").rename(source / f"{name}.parquet")

    seen = lambda: {tuple(r) for r in spark.table("idle_frames").collect()}

    def waited(for_row):
        until = time.time() + 60
        while for_row not in seen() and time.time() < until:
            time.sleep(0.2)
        return for_row in seen()

    arrives("0", [("done", 1, "chunk", 3), ("done", 2, "endOfBatch", None), ("begun", 1, "chunk", 2), ("begun", 2, "ping", None)])
    stream = spark.readStream.schema(schema).parquet(str(source))
    run = live.framed(stream, idle_ms=1000).writeStream.format("memory").queryName("idle_frames").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        assert waited(("done", 1, 0, 0, "idle"))
        assert ("done", 0, 1, 3, "complete") in seen() and not [r for r in seen() if r[0] == "begun"]
        arrives("1", [("begun", 3, "chunk", 5), ("begun", 4, "endOfBatch", None)])
        assert waited(("begun", 0, 2, 7, "complete")) and waited(("begun", 1, 0, 0, "idle"))
    finally:
        run.stop()
