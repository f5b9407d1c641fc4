"""Outbound planning against a plain model of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import replicate
from tidemark.operators.replicate import Budget

CHANGES = "session string, kind string, tbl string, row_id string, column string, reason string, hlc struct<ms:long,counter:int,node:string>"


def make(seed, n=60):
    rng = random.Random(seed)
    out, clock = [], {"a": (0, 0), "b": (0, 0)}
    for _ in range(n):
        node = rng.choice("ab")
        ms, counter = clock[node]
        step = rng.random()
        clock[node] = (ms, counter + 1) if step < 0.6 else (ms + 1, 0) if step < 0.9 else (ms, counter)
        kind = rng.choice(["insert", "update", "delete", "delete"])
        reason = rng.choice(["userDelete", "userCascadeDelete", "userReinsert"]) if kind == "delete" else None
        out.append(("s", kind, rng.choice("xy"), f"r{rng.randrange(6)}", rng.choice("pq") if kind == "update" else None, reason, (*clock[node], node)))
    return list(dict.fromkeys(out))


def model(changes, dependencies=()):
    kinds = ["insert", "update", "delete"]
    order = sorted(changes, key=lambda c: (c[6], kinds.index(c[1]), c[2], c[3], c[4] or ""))
    n = len(order)
    bars = {"part": [], "grp": [], "unit": []}
    for i in range(n - 1):
        if order[i][6] == order[i + 1][6]:
            bars["part"].append((i, i + 1))
    for row in {c[2:4] for c in order}:
        places = [i for i, c in enumerate(order) if c[2:4] == row]
        inserts = [i for i in places if order[i][1] == "insert"]
        if inserts:
            bars["part"].append((places[0], inserts[-1]))
    bars["part"] += [(d - 1, p - 1) for d, p in dependencies]
    follows = lambda i, j: order[j][6][0] == order[i][6][0] and order[j][6][1] == order[i][6][1] + 1
    for node in "ab":
        own = [i for i, c in enumerate(order) if c[6][2] == node]
        for i, j in zip(own, own[1:], strict=False):
            if order[i][2:4] == order[j][2:4] and follows(i, j):
                bars["grp"].append((i, j))
        runs, run = [], []
        for i in own:
            if order[i][5] in ("userDelete", "userCascadeDelete"):
                run.append(i)
            else:
                runs.append(run)
                run = []
        for run in [*runs, run]:
            cascades = [k for k, i in enumerate(run) if order[i][5] == "userCascadeDelete"]
            if cascades:
                k = cascades[0]
                while k > 0 and follows(run[k - 1], run[k]):
                    k -= 1
                bars["grp"].append((run[k], run[cascades[-1]]))
                bars["unit"].append((run[0], run[cascades[-1]]))
    numbers = {}
    for level, wanted in (("part", ["part"]), ("grp", ["part", "grp"]), ("unit", ["part", "grp", "unit"])):
        every = [b for w in wanted for b in bars[w]]
        number, numbers[level] = 0, []
        for i in range(n):
            numbers[level].append(number)
            number += not any(a <= i < b for a, b in every)
    return order, numbers


@pytest.mark.parametrize("seed", range(4))
def test_units_equal_the_model(spark, seed):
    changes = make(seed)
    depends = [(3, 9), (8, 14)] if seed % 2 else []
    order, want = model(changes, depends)
    rows = replicate.ordered(spark.createDataFrame(changes, CHANGES), bucket_ms=3)
    frame = spark.createDataFrame([("s", a, b) for a, b in depends], "session string, dependent int, prerequisite int")
    got = replicate.units(rows, frame, stretch=7).orderBy("pos").collect()
    assert got == replicate.units(replicate.ordered(spark.createDataFrame(changes, CHANGES)), frame).orderBy("pos").collect()
    assert [(r.kind, r.tbl, r.row_id, r.column) for r in got] == [c[1:5] for c in order]
    for level in ("part", "grp", "unit"):
        assert [r[level] for r in got] == want[level]


def test_prefix_and_batches(spark):
    parts = [("s", u, g, p, c, c * 10) for p, (u, g, c) in enumerate([(0, 0, 7), (1, 1, 2), (2, 2, 2), (3, 3, 3), (3, 3, 1), (3, 4, 4), (4, 5, 9), (5, 6, 1)])]
    frame = spark.createDataFrame(parts, "session string, unit int, grp int, part int, changes int, payload int")
    cut = {r.part: r.batch for r in replicate.batches(frame, Budget(max_changes=5)).collect()}
    # the first exceeds a batch alone; the unit of eight goes by its groups
    assert [cut[k] for k in range(8)] == [0, 1, 1, 2, 2, 3, 4, 5]
    assert {r.batch for r in replicate.batches(frame, Budget()).collect()} == {0}
    assert {r.part: r.batch for r in replicate.batches(frame, Budget(max_payload=90)).collect()} == dict(enumerate([0, 0, 1, 2, 2, 2, 3, 4]))
    rows = spark.createDataFrame([("s", u) for u, n in enumerate([4, 2, 3, 1]) for _ in range(n)], "session string, unit int")
    assert replicate.prefix(rows, 6).count() == 6 and replicate.prefix(rows, 1).count() == 4
    with pytest.raises(ValueError):
        Budget(max_changes=0)


def test_checkpoints(spark):
    t = "struct<ms:long,counter:int,node:string>"
    changes = spark.createDataFrame([("s", (5, 1, "a")), ("s", (5, 2, "a")), ("s", (4, 0, "a")), ("s", (1, 0, "b")), ("t", (1, 0, "a"))], f"space string, hlc {t}")
    known = spark.createDataFrame([("s", "a", (5, 1, "a"))], f"space string, node string, hlc {t}")
    assert sorted(tuple(r.hlc) for r in replicate.after_checkpoints(changes, known).collect()) == [(1, 0, "a"), (1, 0, "b"), (5, 2, "a")]
    older = spark.createDataFrame([("s", "a", (3, 0, "a")), ("s", "c", (1, 0, "c"))], known.schema)
    assert {r.node: r.hlc.ms for r in replicate.advanced(known, older).collect()} == {"a": 5, "c": 1}
    assert {r.node: r.hlc.ms for r in replicate.advanced(known, older, force=True).collect()} == {"a": 3, "c": 1}
    assert replicate.after_checkpoints(changes.limit(0), known).count() == 0
    assert replicate.resume_vector(known.withColumnRenamed("hlc", "last"), older.limit(0), "z", F.lit(9)).first().hlc.ms == 0


def test_a_count_starts_anew_when_a_checkpoint_goes_back(spark):
    clock = "struct<ms:bigint,counter:int,node:string>"
    rows = spark.createDataFrame([("s", "t", str(i), (i, 0, "n")) for i in range(10)], f"space string, tbl string, row_id string, hlc {clock}")
    at = lambda ms: spark.createDataFrame([("s", "n", (ms, 0, "n"))] if ms is not None else [], f"space string, node string, hlc {clock}")
    count = lambda *seen: replicate.unsent_count(lambda: [rows], iter([at(m) for m in seen]).__next__, "n")
    assert count(6, 6) == 3 and count(6, 8) == 3  # forwards is fine
    assert count(6, 2, 2) == 7 and count(6, None, None) == 10  # replaced by an older one, or gone
    assert count(8, 7, 6, 5) == 10  # after three attempts all count


def test_dependencies_are_pairs_once_and_not_shuffled(spark):
    changes = spark.createDataFrame([("s", 1, "update", "x", "r1"), ("s", 2, "insert", "x", "r2"), ("s", 3, "insert", "x", "r1"), ("s", 4, "update", "x", "r1"), ("s", 5, "insert", "x", "r2"), ("t", 6, "insert", "x", "r2")], "session string, pos int, kind string, tbl string, row_id string")
    references = spark.createDataFrame([("s", 1, "x", "r2"), ("s", 1, "x", "r2"), ("s", 1, "x", "r1"), ("s", 2, "x", "r2"), ("s", 3, "y", "r2"), ("s", 5, "x", "r1"), ("s", 4, "x", None)], "session string, pos int, target_tbl string, target_id string")
    found = replicate.dependencies(changes, references)
    assert sorted(map(tuple, found.collect())) == [("s", 1, 2), ("s", 1, 3), ("s", 1, 5), ("s", 2, 5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]  # pairs grow with the square of a row's references
