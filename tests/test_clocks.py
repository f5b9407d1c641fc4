"""Clock columns against a plain model of a hybrid logical clock."""

import random

from pyspark.sql import functions as F

from tidemark.functions import hlc, values

NODES = ["11111111-1111-4111-8111-111111111111", "22222222-2222-4222-8222-222222222222"]
T0 = 1_000_000_000_000


def test_order_is_time_counter_node(spark):
    rng = random.Random(1)
    rows = [(T0 + rng.randrange(3), rng.randrange(3), rng.choice(NODES)) for _ in range(60)]
    frame = spark.createDataFrame(rows, "ms long, counter int, node string").select(hlc.hlc(F.col("ms"), F.col("counter"), F.col("node")).alias("h"))
    assert [tuple(r.h) for r in frame.orderBy("h").collect()] == sorted(rows)
    assert tuple(frame.agg(F.max("h").alias("h")).first().h) == max(rows)


def test_texts(spark):
    texts = [
        ("2001-09-09T01:46:40.000Z-0017-" + NODES[0], (T0, 0x17, NODES[0])), (f"{T0}-0017-{NODES[0]}", (T0, 23, NODES[0])), (f"2001-09-09T01:46:40.000Z-0017-{NODES[0]}:7", (T0, 23, NODES[0])),
        (f"{T0}-ffff-{NODES[1].upper()}", (T0, 0xFFFF, NODES[1])), (f"{T0}-10000-{NODES[0]}", None), ("noon-0017-" + NODES[0], None), ("", None), (None, None), (f"{T0}-0017-nobody", None),
    ]
    got = spark.createDataFrame(texts, "text string, want struct<ms:long,counter:int,node:string>").withColumn("h", hlc.parse(F.col("text"))).collect()
    for r in got:
        assert r.h == r.want, r.text
    one = spark.range(1).select(hlc.hlc(F.lit(T0), F.lit(23), F.lit(NODES[0])).alias("h"))
    r = one.select(hlc.to_text(F.col("h")).alias("t"), hlc.from_json(hlc.to_json(F.col("h"))).alias("back"), F.col("h")).first()
    assert r.t == texts[0][0] and r.back == r.h


def model_stamps(writes, last):
    out = []
    for wall in writes:
        ms = max(wall, last[0]) if last else wall
        last = (ms, last[1] + 1 if last and ms == last[0] else 0)
        out.append(last)
    return out


def test_stamps_equal_a_sequence(spark):
    rng = random.Random(2)
    for last in (None, (T0 + 3, 9)):
        walls = {n: [T0 + rng.randrange(8) for _ in range(40)] for n in NODES}
        rows = [(n, i, w) for n in NODES for i, w in enumerate(walls[n])]
        frame = spark.createDataFrame(rows, "node string, seq int, wall long")
        if last:
            frame = frame.withColumn("last", hlc.hlc(F.lit(last[0]), F.lit(last[1]), F.col("node")))
        for bucket in (None, 7):
            made = hlc.stamped(frame, node="node", wall_ms="wall", order="seq", last="last" if last else None, bucket=bucket)
            got = {(r.node, r.seq): (r.hlc.ms, r.hlc.counter) for r in made.collect()}
            for n in NODES:
                assert [got[n, i] for i in range(40)] == model_stamps(walls[n], last)


def test_merge_and_errors(spark):
    cases = [  # clock, remote, wall, result or error
        ((5, 1, "a"), (5, 1, "b"), 5, (5, 1, "a")), ((5, 1, "a"), (5, 2, "b"), 5, (5, 2, "a")), ((5, 1, "a"), (4, 9, "a"), 5, (5, 1, "a")), ((5, 1, "a"), (6, 0, "a"), 5, "duplicateNode"),
        ((5, 1, "a"), (105, 0, "b"), 5, (105, 0, "a")), ((5, 1, "a"), (106, 0, "b"), 5, "remoteAhead"),
    ]
    t = hlc.TYPE
    frame = spark.createDataFrame([(i, a, b, w) for i, (a, b, w, _) in enumerate(cases)], f"i int, a {t}, b {t}, w long")
    for r in frame.withColumn("m", hlc.merge(F.col("a"), F.col("b"), F.col("w"), 100)).collect():
        want = cases[r.i][3]
        assert (r.m.error or tuple(r.m.hlc)) == want
    inc = frame.withColumn("m", hlc.increment(F.col("a"), F.col("w") - 101, 100)).first()
    assert inc.m.error == "localAhead" and inc.m.hlc is None
    assert frame.select(hlc.increment(hlc.hlc(F.lit(5), F.lit(0xFFFF), F.lit("a")), F.lit(5)).alias("m")).first().m.error == "overflow"


def test_values(spark):
    import uuid

    frame = spark.createDataFrame([("a😀b", "x"), (None, None), ("", "É")], "t string, u string")
    got = frame.select(values.utf16_length(F.col("t")).alias("n"), values.uuid5(F.col("u")).alias("v"), values.claim_key(F.col("t"), F.col("u")).alias("k"), values.try_uuid(F.lit(" " + NODES[0].upper())).alias("c")).collect()
    assert [r.n for r in got] == [4, None, 0]
    assert [r.v for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_OID, "x")), None, str(uuid.uuid5(uuid.NAMESPACE_OID, "É"))]
    assert [r.k for r in got] == ["a😀b\x1fx", None, "\x1fÉ"] and got[0].c == NODES[0]
    made = frame.limit(1).select(values.conflict_free("uuid", F.lit(NODES[0]), F.lit("r"), "c").alias("v"), hlc.drift_text(F.lit(1500)).alias("d")).first()
    assert made.v[14] == "8" and made.d == "1.500ms"
    assert spark.range(1).select(hlc.drift_text(F.lit(2000)).alias("d")).first().d == "2ms"
    assert (values.release_kind(True, "string", False), values.release_kind(False, "string", False), values.release_kind(False, "uuid", True), values.release_kind(True, "json", False)) == ("null", "text", None, None)
