"""Scoped reads, local writes and streaming on micro-tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.operators import accounts, merge, record, spaces, visibility
from tidemark.plans import catalogue, schema
from tidemark.sources import log as logs
from tidemark.sources.log import SCHEMA
from tidemark.streaming import live


def test_reads_fail_closed_and_keep_null_ids(spark):
    rows = spark.createDataFrame([("1", "s", 1), ("2", "s", 2), ("3", "t", 3), (None, "t", 4)], "id string, space string, v int")
    hidden = spark.createDataFrame([("s", "2"), ("t", "1")], "space string, row_id string")
    ids = lambda d: sorted((r.id for r in d.collect()), key=str)
    assert ids(visibility.visible(rows, hidden)) == ["1", "3", None]
    assert ids(visibility.visible(rows, hidden, spaces=["s"])) == ["1", None]
    assert ids(visibility.visible(rows, hidden, spaces=[])) == [None]
    own = spark.createDataFrame([("s",), ("s",)], "space string")
    assert ids(visibility.visible(rows, hidden, spaces=own)) == ["1", None]
    assert ids(visibility.visible(rows, hidden, spaces=own, include_hidden=True)) == ["1", "2", None]
    assert visibility.find(rows, order_by=[F.desc("v")], limit=2, offset=1).columns == ["id", "v"]


def test_includes(spark):
    root = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "9")], "rid string, fk string")
    target = spark.createDataFrame([("1", "s", "x"), ("2", "s", "y")], "id string, space string, name string")
    hidden = spark.createDataFrame([("s", "2")], "space string, row_id string")
    got = {r.rid: r.name for r in visibility.include_object(root, target, hidden, fk="fk", target_id="id").collect()}
    assert got == {"a": "x", "c": None, "d": None}
    children = spark.createDataFrame([("1", "k", 3), ("1", "l", 1), ("1", "m", 2), (None, "n", 1)], "fk string, name string, o int")
    paged = visibility.include_list(target, children, root_id="id", fk="fk", columns=["name"], order_by=["o"], limit=1, offset=1)
    assert {r.id: [c.name for c in r.children] for r in paged.collect()} == {"1": ["m"], "2": []}
    every = visibility.include_list(target, children, root_id="id", fk="fk", columns=["name"], order_by=["o"])
    assert {r.id: [c.name for c in r.children] for r in every.collect()} == {"1": ["l", "m", "k"], "2": []}


def test_local_writes(spark):
    rows = spark.createDataFrame([("s", "note", "1", "n", 5, 0, "a", None), ("s", "note", "2", "n", 5, 1, "b", "c")], "space string, tbl string, row_id string, node string, wall_ms long, seq int, title string, folder string")
    made = sorted(((r.row_id, r.column, r.hlc.counter) for r in record.updates(rows, ["title", "folder"]).collect()), key=lambda r: r[2])
    assert made == [("1", "title", 0), ("1", "folder", 1), ("2", "title", 2), ("2", "folder", 3)]
    assert {r.row_id: r.payload["folder"] for r in record.inserts(rows, ["title", "folder"]).collect()} == {"1": None, "2": "c"}
    flags = spark.createDataFrame([("s", "note", "2", 2)], "space string, tbl string, row_id string, cl_flag int")
    assert [(r.row_id, r.cl_flag) for r in record.deletes(rows, rows.limit(0), flags).collect()] == [("1", 2)]
    assert [(r.row_id, r.cl_flag, r.reason) for r in record.reinserts(rows.select(*record.KEY), flags).collect()] == [("2", 3, "userReinsert")]
    assert record.foreign_writes(rows, "t").count() == 2
    assert record.sanitised(rows, ["title", "id"]).columns == ["title"]


def test_profiles(spark):
    bodies = spark.createDataFrame([('{"id": 7, "kakao_account": {"email": "A@B.C", "profile": {"nickname": "n"}}}',), ("{}",), ("not json",), (None,)], "body string")
    got = [r.p.asDict() for r in bodies.select(accounts.profile(F.col("body"), "kakao").alias("p")).collect()]
    assert got[0] == {"user_identifier": "7", "email": "a@b.c", "name": "n", "image": None, "error": None}
    assert [g["error"] for g in got[1:]] == ["missingId"] * 3


LOG = [("s", "note", "1", "insert", None, None, {"title": "a"}, None, None, (1, 0, "a")), ("s", "note", "1", "update", "title", "b", None, None, None, (2, 0, "a")), ("s", "note", "1", "delete", None, None, None, 2, "userDelete", (9_000_000_000_000, 0, "a"))]


def test_stream_merge_is_idempotent_and_refuses_the_future(spark, tmp_path):
    sink = live.MergeSink(str(tmp_path / "state"), {"note": ["title"]}, now_ms=10)
    first = spark.createDataFrame(LOG[:1], logs.SCHEMA)
    sink(first, 0)
    rest = spark.createDataFrame(LOG[1:], logs.SCHEMA)
    for _ in range(2):  # a batch that is tried again
        sink(rest, 1)
    state = sink.state(spark, 1)
    assert [r.value for r in state.fields.collect()] == ["b"] and state.generations.count() == 0
    assert merge.row_visibility(state).first().visibility == 0 and sink.state(spark, -1) is None


def test_versions_take_turns(spark, tmp_path):
    sink = live.MergeSink(str(tmp_path / "state"), {"note": ["title"]}, kept=2)
    for k in range(4):
        sink(spark.createDataFrame([("s", "note", str(k), "insert", None, None, {"title": "a"}, None, None, (k, 0, "a"))], logs.SCHEMA), k)
    assert sink.newest(spark) == 3 and sink.state(spark, 3).rows.count() == 4 and sink.state(spark, 2).rows.count() == 3
    assert len(list((tmp_path / "state").iterdir())) == 2
    with pytest.raises(LookupError):
        sink.state(spark, 1)


def test_a_local_store_by_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    rows = spark.range(1000).selectExpr("id as k", "concat('n', id) as name")
    logs.save_table(rows, url, "note", driver="org.apache.derby.jdbc.EmbeddedDriver")
    logs.save_table(rows.selectExpr("k + 1000 as k", "name"), url, "note", driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = logs.table(spark, url, "note", key="k", low=0, high=2000, partitions=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert back.rdd.getNumPartitions() == 4 and back.count() == 2000 and back.selectExpr("sum(k)").first()[0] == 1999 * 1000


def test_refusals(spark):
    members = spark.createDataFrame([("u", "s", "readOnly"), ("u", "t", "readWrite")], "user string, space string, role string")
    spaces.require_acting(members, "u", "t")
    spaces.require_acting(members, "u", "u")
    with pytest.raises(errors.ReadOnlyMember):
        spaces.require_acting(members, "u", "s")
    with pytest.raises(errors.NotAMember):
        spaces.require_acting(members, "v", "s")
    with pytest.raises(errors.ForeignSpace):
        record.require_own_space(members, "s")
    schema.require_peer("h", "h")
    for peer in ("", None, "g"):
        with pytest.raises(errors.SchemaMismatch):
            schema.require_peer("h", peer)


def test_merging_in_another_order(spark):
    early, late = ("s", "n", "1", "insert", None, None, {"t": "a"}, None, None, (1, 0, "a")), ("s", "n", "1", "insert", None, None, {"t": "b"}, None, None, (5, 0, "b"))
    frames = [spark.createDataFrame([x], logs.SCHEMA) for x in (early, late)]
    columns = {"n": ["t"]}
    states = [merge.merged(merge.state_of(a, columns), b, columns) for a, b in (frames, frames[::-1])]
    # registers agree, births are those that came first
    assert [[r.value for r in s.fields.collect()] for s in states] == [["b"], ["b"]] and [s.rows.first().hlc.ms for s in states] == [1, 5]
    whole = merge.state_of(frames[0].unionByName(frames[1]), columns, with_later_inserts=True)
    assert whole.rows.first().hlc.ms == 1 and [(r.cl_flag, r.hlc.ms, r.reason) for r in whole.generations.collect()] == [(1, 5, "userInsert")]


def test_payloads_are_measured_as_told(spark):
    changes = spark.createDataFrame(LOG[:1], logs.SCHEMA)
    assert logs.encoded(changes, F.octet_length).first().frame_chars == len(logs.encoded(changes).first().frame.encode())


def test_watch_emits_changes_only(spark):
    emitted, result = [], {"rows": [(1,)]}
    watch = live.Watch(lambda s: s.createDataFrame(result["rows"], "v int"), lambda k, r: emitted.append(k), {"note"})
    touched, other = spark.createDataFrame([("note",)], "tbl string"), spark.createDataFrame([("x",)], "tbl string")
    watch(other, 0)
    watch(touched, 1)
    result["rows"] = [(2,)]
    watch(other, 2)
    watch(touched, 3)
    assert emitted == [0, 3]


FRAMES = [("a", 1, "chunk", 3), ("a", 2, "chunk", 4), ("a", 3, "endOfBatch", 0), ("a", 4, "endOfBatch", 0), ("a", 5, "chunk", 1), ("a", 6, "close", 0), ("b", 1, "close", 0), ("c", 1, "chunk", 2)]
WANT = {("a", 0, 2, 7, "complete"), ("a", 1, 0, 0, "complete"), ("a", 2, 1, 1, "premature"), ("b", 0, 0, 0, "closed")}


def test_frames_over_a_table_and_a_stream(spark, tmp_path):
    schema = "session string, seq int, type string, changes int"
    table = spark.createDataFrame(FRAMES, schema)
    assert {tuple(r) for r in live.framed_batches(table).collect()} == WANT | {("c", 0, 1, 2, "open")}
    source = tmp_path / "frames"
    for k, part in enumerate((FRAMES[:2], FRAMES[2:5], FRAMES[5:])):
        source.mkdir(exist_ok=True)
        pd.DataFrame(part, columns=["session", "seq", "type", "changes"]).astype({"seq": "int32", "changes": "int32"}).to_parquet(source / f"{k}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    live.framed(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == WANT


def change(row, kind, ms, *, space="s", node="n", column=None, value=None, payload=None, cl=None, reason=None):
    return (space, "note", row, kind, column, value, payload, cl, reason, (ms, 0, node))


def test_a_batch_rewrites_the_buckets_it_touches_and_a_new_sink_finds_them(spark, tmp_path):
    folder = str(tmp_path / "state")
    sink = live.MergeSink(folder, {"note": ["title"]}, buckets=32)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    sink(frame([change(str(i), "insert", 1, payload={"title": f"t{i}"}) for i in range(400)]), 0)
    before = sink.manifest(spark, 0)
    sink(frame([change("7", "update", 5, column="title", value="new")]), 1)
    after = sink.manifest(spark, 1)
    assert len(before) == 32 and [b for b in before if after[b] != 0] == [b for b in after if after[b] == 1] and sum(v == 1 for v in after.values()) == 1
    again = live.MergeSink(folder, {"note": ["title"]}, buckets=32)
    assert again.newest(spark) == 1 and again.state(spark, 1).rows.count() == 400
    assert {r.value for r in again.state(spark, 1).fields.where("row_id = '7'").collect()} == {"new"}
    assert {r.value for r in again.state(spark, 0).fields.where("row_id = '7'").collect()} == {"t7"}
    # a batch that broke off before its manifest leaves the version before it as the newest, and is tried again
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{folder}/data/v2/rows/bucket=0")
    assert again.newest(spark) == 1
    again(frame([change("8", "update", 6, column="title", value="newer")]), 2)
    for k in range(3, 7):
        again(frame([change("8", "update", 6 + k, column="title", value=f"x{k}")]), k)
    assert again.versions(spark) == [4, 5, 6] and again.state(spark, 6).rows.count() == 400
    with pytest.raises(LookupError):
        again.state(spark, 1)
    assert not (tmp_path / "state" / "data" / "v2").exists()


def test_a_unit_with_a_violation_falls_whole(spark, tmp_path):
    granted = spark.createDataFrame([("s", "n", "readWrite"), ("t", "n", "readWrite"), ("s", "m", "readOnly"), ("t", "m", "readWrite")], "space string, node string, role string")
    sink = live.MergeSink(str(tmp_path / "state"), {"note": ["title"]}, unit="hlc.node", granted=granted, reserved={"title": "text"})
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    mark = "x__hidden__00000000-0000-4000-8000-000000000001"
    sink(frame([change("1", "insert", 1, payload={"title": "a"}), change("2", "insert", 1, node="m", space="t", payload={"title": "b"}), change("3", "insert", 2, node="m", payload={"title": "c"})]), 0)
    assert {r.row_id for r in sink.state(spark, 0).rows.collect()} == {"1"}
    sink(frame([change("2", "insert", 4, node="m", space="t", payload={"title": "b"}), change("4", "insert", 4, payload={"title": "d"}), change("1", "update", 5, column="title", value=mark)]), 1)
    state = sink.state(spark, 1)
    assert {r.row_id for r in state.rows.collect()} == {"1", "2"} and {r.value for r in state.fields.where("row_id = '1'").collect()} == {"a"}
    sink(frame([change("1", "update", 6, node="m", space="t", column="title", value="mine"), change("5", "insert", 6, payload={"title": mark})]), 2)
    sink(frame([change("1", "update", 9, node="m", space="t", column="title", value="mine")]), 3)
    found = {(r.kind, r.row_id, r.node): (r.first_seen, r.last_seen, r.occurrences) for r in sink.violations(spark, 3).collect()}
    assert found == {("unauthorizedWrite", "3", "m"): (0, 0, 1), ("reservedValue", "1", "n"): (1, 1, 1), ("ownershipCollision", "1", "m"): (2, 3, 2), ("reservedValue", "5", "n"): (2, 2, 1)}
    assert {r.row_id for r in sink.state(spark, 3).rows.collect()} == {"1", "2"}


def test_reserved_names_count_in_every_arrival(spark, tmp_path):
    """n1 writes a reserved name in s3 in the first arrival, when it may: its batch falls, and the name is a violation."""
    rows = [(7, 3, "view", 5), (10, 2, "view", 9), (1, 3, "signup", 1), (2, 3, "signup", 40), (4, 3, "click", 50), (11, 3, "view", 99), (998 * 991 + 7, 7, "view", 95)]
    events = pd.DataFrame([(i, u, kind, 1.5, "{}", pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=at)) for i, u, kind, at in rows], columns=["event_id", "user_id", "event_type", "value", "props", "ts"])
    events.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("stream_violations", "stream_validated_merge"):
        got = catalogue.queries()[name](spark, str(tmp_path))
        want = con.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(map(tuple, got.select(*[f"`{n}`" for n in names]).collect())) == sorted(want.fetchall())
