"""Constraint projection against a plain model, on random schemas with every action, self references and cycles."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import projection
from tidemark.plans.schema import Column, ForeignKey, SchemaError, Table, UniqueIndex, component, needs_projection, schema_hash, topological, validate


def world(seed, cyclic):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d"]
    edges = []
    for k, child in enumerate(names):
        for parent in rng.sample(names[: k + 1] if not cyclic else names, min(2, len(names[: k + 1] if not cyclic else names))):
            action = rng.choice(["cascade", "cascade", "noAction", "setNull", "setDefault"])
            edges.append(ForeignKey(child, f"{parent}_id", parent, action, nullable=rng.random() < 0.5, default=rng.choice([None, "0", "1"]) if action == "setDefault" else None))
    rows = {(t, str(i)): rng.random() < 0.25 for t in names for i in range(7)}
    refs = []
    for t, i in rows:
        for e in edges:
            if e.table == t and rng.random() < 0.5:
                refs.append((t, i, e.column, str(rng.randrange(9)), e.parent, e.on_delete, e.nullable, e.default))
    return edges, rows, refs


def model(rows, refs):
    accepted = {r for r, deleted in rows.items() if deleted}
    children = {}
    for ref in refs:
        children.setdefault((ref[4], ref[3]), []).append(ref)

    def closure(root):
        seen, todo = set(), [root]
        while todo:
            r = todo.pop()
            if r in seen:
                continue
            seen.add(r)
            todo += [c[:2] for c in children.get(r, []) if c[5] == "cascade"]
        return seen

    def default_holds(ref, hidden):
        return ref[6] if ref[7] is None else (ref[4], ref[7]) in rows and (ref[4], ref[7]) not in hidden

    while True:
        covered, closures = set(), {}
        for root in sorted(accepted):
            if root not in covered:
                closures[root] = closure(root)
                covered |= closures[root]
        missing, changed = set(), True
        while changed:
            changed = False
            for ref in refs:
                row, target = ref[:2], (ref[4], ref[3])
                if row in covered or row in missing or (target in rows and target not in missing):
                    continue
                if ref[5] == "setNull" or (ref[5] == "setDefault" and default_holds(ref, covered | missing)):
                    continue
                missing.add(row)
                changed = True
        hidden = covered | missing
        bad = set()
        for root, members in closures.items():
            for m in members:
                for ref in children.get(m, []):
                    if ref[:2] not in hidden and (ref[5] in ("cascade", "noAction") or (ref[5] == "setDefault" and not default_holds(ref, hidden))):
                        bad.add(root)
        if not bad:
            break
        accepted -= bad
    seen = {r: (3 if rows[r] else 5) if r in hidden else (2 if rows[r] else 0) for r in rows}
    values = {}
    for ref in refs:
        target = (ref[4], ref[3])
        shown, reason = ref[3], None
        if target not in rows or target in hidden:
            if ref[5] == "setNull":
                shown, reason = None, "foreignKeySetNull"
            elif ref[5] == "setDefault" and default_holds(ref, hidden):
                shown, reason = ref[7], "foreignKeySetDefault"
        if shown is not None and (ref[4], shown) not in rows:
            shown, reason = (None if ref[6] else ref[3]), "foreignKeyMissingParent"
        values[ref[:3]] = (shown, reason)
    return seen, values


@pytest.mark.parametrize(("seed", "cyclic"), [(1, False), (2, False), (3, True), (4, True)])
def test_projection_equals_the_model(spark, seed, cyclic):
    _, rows, refs = world(seed, cyclic)
    nodes = spark.createDataFrame([(*r, d, "userDelete") for r, d in rows.items()], "tbl string, row_id string, deleted boolean, reason string")
    frame = spark.createDataFrame(refs, "tbl string, row_id string, col string, value string, target_tbl string, action string, nullable boolean, default_id string")
    shown = projection._kept(projection.visibility(nodes, frame))
    seen, values = model(rows, refs)
    assert {(r.tbl, r.row_id): r.visibility for r in shown.collect()} == seen
    assert {(r.tbl, r.row_id, r.col): (r.shown, r.reason) for r in projection.repaired(frame, shown).collect()} == values


@pytest.mark.parametrize(("seed", "cyclic"), [(1, False), (5, True)])
def test_projecting_some_rows_equals_the_whole(spark, seed, cyclic):
    _, rows, refs = world(seed, cyclic)
    refs = [r for k, r in enumerate(refs) if k % 3]  # not all hang together
    nodes = spark.createDataFrame([(*r, d, "userDelete") for r, d in rows.items()], "tbl string, row_id string, deleted boolean, reason string")
    frame = spark.createDataFrame(refs, "tbl string, row_id string, col string, value string, target_tbl string, action string, nullable boolean, default_id string")
    seen, _ = model(rows, refs)
    for seeds in ([("d", "1")], [("a", "0"), ("b", "3")]):
        got = {(r.tbl, r.row_id): r.visibility for r in projection.project(nodes, frame, spark.createDataFrame(seeds, "tbl string, row_id string")).collect()}
        assert set(seeds) <= set(got) and got == {k: seen[k] for k in got}
        # what the seeds can change is within: their deletion leaves all other rows as they were
        other, _ = model({k: (not d if k in seeds else d) for k, d in rows.items()}, refs)
        assert {k for k in seen if other[k] != seen[k]} <= set(got)


def test_long_chains_settle(spark):
    n = 1000
    nodes = spark.range(n).selectExpr("'t' as tbl", "cast(id as string) as row_id", "id = 0 as deleted", "'userDelete' as reason")
    refs = spark.range(1, n).selectExpr("'t' as tbl", "cast(id as string) as row_id", "'up' as col", "cast(id - 1 as string) as value", "'t' as target_tbl", "'cascade' as action", "true as nullable", "cast(null as string) as default_id")
    assert {r[0]: r[1] for r in projection.visibility(nodes, refs).groupBy("visibility").count().collect()} == {3: 1, 5: n - 1}
    # a row below needs the chain: the deletion is rejected
    user = spark.createDataFrame([("u", "0", "down", str(n - 1), "t", "noAction", True, None)], refs.schema)
    more = nodes.unionByName(spark.createDataFrame([("u", "0", False, "userDelete")], nodes.schema))
    assert {r[0]: r[1] for r in projection.visibility(more, refs.unionByName(user)).groupBy("visibility").count().collect()} == {2: 1, 0: n}
    # the first row is missing: all hang on it
    gone = nodes.where("row_id <> '0'")
    assert {r[0]: r[1] for r in projection.visibility(gone, refs).groupBy("visibility").count().collect()} == {5: n - 1}


def test_unique_release_kinds(spark):
    rows = spark.createDataFrame(
        [("s", "1", "x", "p", False, 5), ("s", "2", "x", "p", False, 3), ("s", "3", "x", "p", True, 1), ("s", "4", "x", None, False, 1), ("t", "5", "x", "p", False, 9), ("s", "6", "x", "p", False, 3)],
        "space string, row_id string, name string, other string, hidden boolean, claim_hlc int",
    )
    got = {r.row_id: (r.name, r.unique_reason) for r in projection.unique(rows, [UniqueIndex(("name", "other"), "name")], {"name": "text"}).collect()}
    assert got == {"1": ("x__conflict__1", "uniqueConflict"), "2": ("x", None), "3": ("x__hidden__3", "hiddenUniqueRelease"), "4": ("x", None), "5": ("x", None), "6": ("x__conflict__6", "uniqueConflict")}


def test_an_authored_null_counts(spark):
    rows = spark.createDataFrame([(None, True, "a", "d"), (None, False, "a", "d"), (None, False, None, "d"), ("o", True, "a", "d")], "o string, has boolean, att string, dom string")
    assert [r[0] for r in rows.select(projection.authored(F.col("o"), F.col("has"), F.col("att"), F.col("dom"))).collect()] == [None, "a", "d", "o"]


def good(**changes):
    parts = {"name": "note", "columns": (Column("id", "uuid", False), Column("space_id", "bigint"), Column("title", "string", False), Column("folder_id", "uuid")), "foreign_keys": (ForeignKey("note", "folder_id", "folder", "setNull"),), "indexes": (UniqueIndex(("title",), "title"),)}
    return [Table("folder", (Column("id", "uuid", False), Column("space_id", "bigint"))), Table(**(parts | changes))]


@pytest.mark.parametrize("broken", [
    {"columns": (Column("space_id", "bigint"),)}, {"columns": (Column("id", "uuid"), Column("space_id", "string"))}, {"foreign_keys": (ForeignKey("note", "folder_id", "nothing"),)},
    {"foreign_keys": (ForeignKey("note", "folder_id", "folder", "restrict"),)}, {"foreign_keys": (ForeignKey("note", "folder_id", "folder", nullable=False, deferred=False),)},
    {"indexes": (UniqueIndex(("folder_id",), "title"),)}, {"indexes": (UniqueIndex(("title",), "title", per_space=False),)}, {"indexes": (UniqueIndex(("missing",), "missing"),)},
])
def test_broken_schemas_are_refused(broken):
    validate(good())
    with pytest.raises(SchemaError):
        validate(good(**broken))


def test_schema_plans():
    edges = [ForeignKey("c", "b_id", "b"), ForeignKey("b", "a_id", "a"), ForeignKey("x", "y_id", "y")]
    order = topological(edges)
    assert order.index("a") < order.index("b") < order.index("c") and component(edges, {"c"}) == {"a", "b", "c"}
    assert needs_projection(good(), {"note": {"title"}}) and not needs_projection(good(), {"note": {"body"}})
    assert schema_hash(good()) == schema_hash(good()[::-1]) != schema_hash(good(indexes=()))


def test_a_hub_is_judged_without_its_children(spark):
    """A deleted supplier with 5,000 lines that fall back on a default, and a deleted nation with firm customers, stay out of the inner rows."""
    node, ref = "tbl string, row_id string, deleted boolean, reason string", "tbl string, row_id string, col string, value string, target_tbl string, action string, nullable boolean, default_id string"
    lines = spark.range(5000).selectExpr("'line' as tbl", "cast(id as string) as row_id", "false as deleted", "'userDelete' as reason")
    others = spark.createDataFrame([("supplier", "9", True, "userDelete"), ("supplier", "1", False, "userDelete"), ("nation", "0", True, "userDelete"), *[("customer", str(i), False, "userDelete") for i in range(50)]], node)
    refs = spark.range(5000).selectExpr("'line' as tbl", "cast(id as string) as row_id", "'s' as col", "'9' as value", "'supplier' as target_tbl", "'setDefault' as action", "true as nullable", "'1' as default_id")
    refs = refs.unionByName(spark.createDataFrame([("customer", str(i), "n", "0", "nation", "noAction", False, None) for i in range(50)] + [("line", "7", "c", "7", "customer", "cascade", True, None)], ref))
    nodes = lines.unionByName(others)
    seeds = spark.createDataFrame([("line", "7"), ("customer", "7")], "tbl string, row_id string")
    part = projection.scope(nodes, refs, seeds)
    assert {tuple(r) for r in part.inner.collect()} == {("line", "7"), ("customer", "7")}
    assert {tuple(r) for r in part.rejected.collect()} == {("nation", "0")}
    whole = {(r.tbl, r.row_id): r.visibility for r in projection.visibility(nodes, refs).collect()}
    assert {(r.tbl, r.row_id): r.visibility for r in projection.project(nodes, refs, seeds).collect()} == {k: whole[k] for k in (("line", "7"), ("customer", "7"))}
    # the default itself among the seeds: then all lines may change
    every = projection.scope(nodes, refs, spark.createDataFrame([("supplier", "1")], seeds.schema))
    assert every.inner.count() > 5000


def test_claims_with_a_null_stay_out_of_windows(spark):
    rows = spark.range(2000).selectExpr("'s' as space", "cast(id as string) as row_id", "case when id % 100 = 0 then 'x' end as name", "id % 200 = 0 as hidden", "id as claim_hlc", "false as restoring")
    got = {r.row_id: (r.name, r.unique_reason) for r in projection.unique(rows, [UniqueIndex(("name",), "name")], {"name": "text"}).collect()}
    assert len(got) == 2000 and got["1"] == (None, None) and got["0"] == ("x__hidden__0", "hiddenUniqueRelease") and got["100"] == ("x", None) and got["300"] == ("x__conflict__300", "uniqueConflict")
    local = {r.row_id: r.outcome for r in projection.local_unique(rows, UniqueIndex(("name",), "name")).collect()}
    assert local["1"] == "kept" and local["0"] == "released" and local["100"] == "refused"
    plan = projection.unique(rows, [UniqueIndex(("name",), "name")], {"name": "text"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan.partition("Window")[2].partition("Union")[0]


@pytest.mark.parametrize(("seed", "cyclic"), [(11, False), (12, True), (13, True)])
def test_projecting_seeds_of_more_worlds(spark, seed, cyclic):
    _, rows, refs = world(seed, cyclic)
    refs = [r for k, r in enumerate(refs) if k % 2]
    nodes = spark.createDataFrame([(*r, d, "userDelete") for r, d in rows.items()], "tbl string, row_id string, deleted boolean, reason string")
    frame = spark.createDataFrame(refs, "tbl string, row_id string, col string, value string, target_tbl string, action string, nullable boolean, default_id string")
    seen, _ = model(rows, refs)
    seeds = [("b", "2"), ("d", "4")]
    got = {(r.tbl, r.row_id): r.visibility for r in projection.project(nodes, frame, spark.createDataFrame(seeds, "tbl string, row_id string")).collect()}
    assert got == {k: seen[k] for k in got}
    other, _ = model({k: (not d if k in seeds else d) for k, d in rows.items()}, refs)
    assert {k for k in seen if other[k] != seen[k]} <= set(got)


@pytest.mark.parametrize("seed", range(6))
def test_claims_of_some_rows_equal_the_whole(spark, seed):
    """Seeds change their columns and visibility; what they may change is found, and gets what all rows together would get."""
    rng = random.Random(seed)
    indexes = [UniqueIndex(("a", "b"), "b"), UniqueIndex(("b", "c"), "c"), UniqueIndex(("a", "c"), "a")]
    kinds = {"a": "null", "b": "text", "c": "null"}
    value = lambda k: rng.choice([None, *"xyzw"[:k]])
    schema = "space string, row_id string, a string, b string, c string, hidden boolean, claim_hlc int"
    old = [(rng.choice("st"), str(i), value(4), value(3), value(4), rng.random() < 0.3, rng.randrange(9)) for i in range(40)]
    seeds = [str(i) for i in rng.sample(range(40), 2)]
    new = [(r[0], r[1], value(4), value(3), value(4), not r[5], r[6]) if r[1] in seeds else r for r in old]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    result = lambda rows: {r.row_id: tuple(r) for r in projection.unique(frame(rows), indexes, kinds).collect()}
    before, after = result(old), result(new)
    got = {r.row_id: tuple(r) for r in projection.project_unique(frame(new), indexes, kinds, frame(new).where(F.col("row_id").isin(seeds)).select("space", "row_id"), frame([r for r in old if r[1] in seeds])).collect()}
    assert got == {k: after[k] for k in got}
    assert set(seeds) | {k for k in after if after[k] != before[k]} <= set(got)


@pytest.mark.parametrize(("seed", "cyclic"), [(1, False), (12, True)])
def test_values_of_some_rows_equal_the_whole(spark, seed, cyclic):
    _, rows, refs = world(seed, cyclic)
    refs = [r for k, r in enumerate(refs) if k % 3]
    nodes = spark.createDataFrame([(*r, d, "userDelete") for r, d in rows.items()], "tbl string, row_id string, deleted boolean, reason string")
    frame = spark.createDataFrame(refs, "tbl string, row_id string, col string, value string, target_tbl string, action string, nullable boolean, default_id string")
    seen, values = model(rows, refs)
    seeds = spark.createDataFrame([("a", "0"), ("d", "3")], "tbl string, row_id string")
    shown, repaired = projection.project_values(nodes, frame, seeds)
    got = {(r.tbl, r.row_id): r.visibility for r in shown.collect()}
    assert got == {k: seen[k] for k in got}
    assert {(r.tbl, r.row_id, r.col): (r.shown, r.reason) for r in repaired.collect()} == {k: v for k, v in values.items() if k[:2] in got}


def test_only_the_tables_asked_for_are_read(spark, tmp_path):
    """Steps of a projection name tables: then branches of other edges are left out of the plan."""
    spark.createDataFrame([(1, 2, 3)], "id int, up int, side int").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(1, 2)], "id int, up int").write.parquet(str(tmp_path / "b"))
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in "ab"}
    edges = [ForeignKey("a", "up", "p", "cascade"), ForeignKey("a", "side", "q", "setNull"), ForeignKey("b", "up", "q", "setNull")]
    refs = projection.references(tables, edges, {"a": "id", "b": "id"})
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.tbl, r.col, r.value) for r in refs.collect()) == [("a", "side", "3"), ("a", "up", "2"), ("b", "up", "2")]
    one = plan(refs.where("target_tbl = 'p'"))
    assert one.count("Relation [") == 1 and "Generate" not in one and "Union" not in one


def test_no_step_writes_all_references(spark, monkeypatch):
    """A thousand lines, one with a deleted order: what is written grows with what hangs on it, not with the lines."""
    nodes = spark.range(1000).selectExpr("'line' as tbl", "cast(id as string) as row_id", "false as deleted", "'userDelete' as reason")
    nodes = nodes.unionByName(spark.range(1000).selectExpr("'orders' as tbl", "cast(id as string) as row_id", "id = 7 as deleted", "'userDelete' as reason"))
    refs = spark.range(1000).selectExpr("'line' as tbl", "cast(id as string) as row_id", "'o' as col", "cast(id as string) as value", "'orders' as target_tbl", "'cascade' as action", "false as nullable", "cast(null as string) as default_id")
    written = []
    keep = projection.staged
    monkeypatch.setattr(projection, "staged", lambda rows, name: written.append(keep(rows, name)) or written[-1])
    got = {(r.tbl, r.row_id): r.visibility for r in projection.visibility(nodes, refs).where("visibility > 0").collect()}
    assert got == {("orders", "7"): 3, ("line", "7"): 5}
    assert sum(w.count() for w in written) < 10
