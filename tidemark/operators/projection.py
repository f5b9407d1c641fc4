"""Constraint projection: which rows a replica shows, and with which values.

Rows of all tables are one long table ``nodes`` (tbl, row_id, deleted, reason), and their authored references another,
``refs`` (tbl, row_id, col, value, target_tbl, action, nullable, default_id); so each step is a few equi joins on
(table, id), whatever the schema. Fixpoints run as driver loops over distributed tables; each round is a written table,
whose size the planner knows, and follows only what the last round found. Where tables refer to each other in circles,
links are first doubled again and again, so that a chain takes as many rounds as its length has binary digits. No loop
has a bound: each ends when nothing changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values
from ..plans.schema import ForeignKey, UniqueIndex
from ..sources.shared import staged

KEY = ["tbl", "row_id"]


#: Rows that a round may hand to the next by the driver; more are written.
SMALL = 20_000


def _kept(rows: DataFrame) -> DataFrame:
    return staged(rows, "projection")


@dataclass(frozen=True)
class Found:
    """What a round found, and how many rows: few (SMALL) are rows of the plan itself, which joins broadcast, others a written table."""

    rows: DataFrame
    count: int

    def __bool__(self) -> bool:
        return self.count > 0

    @property
    def few(self) -> bool:
        return self.count <= SMALL


def _local(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame(rows.toArrow(), schema=rows.schema)


def _found(rows: DataFrame, few: bool = False) -> Found:
    """``few``: whether to expect few rows, as after a round that found few. One round that was wrong costs its work once more."""
    if few:
        table = rows.limit(SMALL + 1).toArrow()
        if table.num_rows <= SMALL:
            return Found(rows.sparkSession.createDataFrame(table, schema=rows.schema), table.num_rows)
    kept = _kept(rows)
    count = kept.count()
    return Found(_local(kept) if count <= SMALL else kept, count)


def references(tables: dict[str, DataFrame], edges: list[ForeignKey], ids: dict[str, str]) -> DataFrame:
    """The authored references of all tables; null values are none. Each edge is a branch of its own, so that filters on tables and
    columns leave whole branches out."""
    parts = [
        tables[e.table].select(
            F.lit(e.table).alias("tbl"), F.col(ids[e.table]).cast("string").alias("row_id"), F.lit(e.column).alias("col"), F.col(e.column).cast("string").alias("value"),
            F.lit(e.parent).alias("target_tbl"), F.lit(e.on_delete).alias("action"), F.lit(e.nullable).alias("nullable"), F.lit(e.default).cast("string").alias("default_id"),
        ).where("value is not null")
        for e in edges
    ]
    return reduce(DataFrame.unionByName, parts)


#: What the references of one column have in common.
KIND = ["tbl", "target_tbl", "action", "default_id", "nullable"]


def _kinds(refs: DataFrame) -> set[tuple]:
    return {tuple(r) for r in refs.select(*KIND).distinct().collect()}  # as many as the schema has


def _tables(rows: DataFrame) -> set[str]:
    return {r[0] for r in rows.select("tbl").distinct().collect()}  # as many as the schema has


def _in(rows: DataFrame, tables: set[str], column: str = "tbl") -> DataFrame:
    """The rows of some tables: what is not asked for is neither read nor shuffled, where each table is a branch of a union."""
    return rows.where(F.col(column).isin(*sorted(tables)))


def _below(tables: set[str], pairs: set[tuple[str, str]]) -> set[str]:
    return {t for t, p in pairs if p in tables}


def authored(overlay: Column, has_overlay: Column, attempted: Column, domain: Column) -> Column:
    """The user's value of a field (P2): a pending write (null counts) before an attempted value before the domain's."""
    return F.when(has_overlay, overlay).otherwise(F.coalesce(attempted, domain))


def _keys(rows: DataFrame, tbl: str, row_id: str) -> DataFrame:
    return rows.select(F.col("tbl").alias(tbl), F.col("row_id").alias(row_id))


def _circles(pairs: set[tuple[str, str]]) -> list[tuple[str, str]]:
    """Those (table, parent) pairs that lie on a circle of references."""
    reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    while True:
        more = {a: found | {c for b in found for c in reach.get(b, ())} for a, found in reach.items()}
        if more == reach:
            return sorted((a, b) for a, b in pairs if b == a or a in reach.get(b, ()))
        reach = more


def shortcuts(links: DataFrame, pairs: set[tuple[str, str]] | None = None) -> DataFrame | None:
    """Links (tbl, row_id, target_tbl, value) to the rows 2, 4, 8, ... steps up, for rows with one parent within a circle of tables (there
    alone can chains be longer than the schema); None where tables form no circle. They lead nowhere that links do not.
    ``pairs`` are (table, parent) of all links, and maybe of more, where the caller knows them."""
    if pairs is None:
        pairs = {tuple(r) for r in links.select("tbl", "target_tbl").distinct().collect()}  # as many as the schema has
    circle = _circles(pairs)
    if not circle:
        return None
    inside = reduce(lambda x, y: x | y, [(F.col("tbl") == a) & (F.col("target_tbl") == b) for a, b in circle])
    up = F.struct("target_tbl", "value")
    single = links.where(inside).groupBy(*KEY).agg(F.min(up).alias("up"), F.max(up).alias("other")).where("up = other")
    hop = _kept(single.select(*KEY, "up.*"))
    rows, step, found = hop.count(), 1, [hop.limit(0)]
    while step < rows:
        above = hop.select(F.col("tbl").alias("target_tbl"), F.col("row_id").alias("value"), F.col("target_tbl").alias("_tbl"), F.col("value").alias("_id"))
        hop = _kept(hop.join(above, ["target_tbl", "value"]).select(*KEY, F.col("_tbl").alias("target_tbl"), F.col("_id").alias("value")))
        if hop.isEmpty():
            break
        found.append(hop)
        step *= 2
    return reduce(DataFrame.unionByName, found)


def with_shortcuts(links: DataFrame, pairs: set[tuple[str, str]] | None = None) -> DataFrame:
    plain = links.select(*KEY, "target_tbl", "value")
    more = shortcuts(plain, pairs)
    return plain if more is None else _kept(plain.unionByName(more))


def closure(roots: DataFrame, links: DataFrame, settled: DataFrame | None = None, few: bool = False, pairs: set[tuple[str, str]] | None = None, lost: Found | None = None) -> DataFrame:
    """Rows (tbl, row_id) reachable from ``roots`` along cascading references (P4, J14), each with ``lead``, the smallest root
    that reaches it. ``links`` has (target_tbl, value) as parent and (tbl, row_id) as child. A round follows only rows whose
    lead has just become smaller, through the links of their tables alone, and looks up only rows that it may have reached before.
    ``pairs`` as in ``shortcuts``. ``settled`` are rows whose lead is known already, from a run with more roots, and ``lost``
    the other rows of that run: only these can get a new lead."""
    if pairs is None:
        pairs = {tuple(r) for r in links.select("tbl", "target_tbl").distinct().collect()}  # as many as the schema has
    own = roots.select(*KEY, F.struct("tbl", "row_id").alias("lead")).distinct()
    if settled is None:
        front = _found(own, few)
        labels = front.rows
        at = _tables(labels)
        seen = set(at)
    else:
        if not lost:
            return settled
        seen = _tables(lost.rows)
        fresh = _found(own.join(lost.rows.select(*KEY), KEY, "left_semi"), lost.few).rows
        labels = settled.unionByName(fresh)
        if not {t for t, _ in pairs} & seen:
            return labels
        links = _found(_in(links, seen).select(*KEY, "target_tbl", "value").join(lost.rows.select(*KEY), KEY, "left_semi"), lost.few).rows
        border = settled.join(_keys(links.select(F.col("target_tbl").alias("tbl"), F.col("value").alias("row_id")), "tbl", "row_id"), KEY, "left_semi")
        front = _found(border.unionByName(fresh), lost.few)
        pairs = {(t, p) for t, p in pairs if t in seen}
        at = {p for _, p in pairs}
    rounds, once = 0, settled is None
    while front:
        below = _below(at, pairs)
        if not below:
            break
        parents = _in(front.rows, {p for _, p in pairs}).select(F.col("tbl").alias("target_tbl"), F.col("row_id").alias("value"), "lead")
        down = parents.join(_in(links, at, "target_tbl"), ["target_tbl", "value"]).select(*KEY, "lead").groupBy(*KEY).agg(F.min("lead").alias("new"))
        if below & seen:
            once = False
            reached = _found(down, front.few)
            if not reached:
                break
            known = _in(labels, below).join(reached.rows.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min("lead").alias("old"))
            front = _found(reached.rows.join(known, KEY, "left").where("old is null or new < old").select(*KEY, F.col("new").alias("lead")), reached.few)
        else:  # no row of these tables has a lead
            front = _found(down.withColumnRenamed("new", "lead"), front.few)
        labels = labels.unionByName(front.rows)
        at, seen = below, seen | below
        rounds += 1
        if rounds % 8 == 0:  # plans stay short
            labels = _kept(labels.groupBy(*KEY).agg(F.min("lead").alias("lead")))
    return labels if once else _found(labels.groupBy(*KEY).agg(F.min("lead").alias("lead")), few).rows


def _defaults(kinds: set[tuple], nodes: DataFrame) -> DataFrame:
    """The defaults that references may fall back on (as many as the schema has) and whether their rows exist."""
    named = sorted({(p, d) for _, p, a, d, _ in kinds if a == "setDefault" and d is not None})
    keys = ["target_tbl", "default_id"]
    found = nodes.sparkSession.createDataFrame(named, "target_tbl string, default_id string")
    if not named:
        return found
    there = _keys(_in(nodes, {p for p, _ in named}), *keys).join(F.broadcast(found), keys, "left_semi").distinct()
    return _found(there, True).rows


def _default_holds(rows: DataFrame, defaults: DataFrame, hidden: DataFrame, kinds: set[tuple]) -> DataFrame:
    """Adds ``_default``: whether the default of a reference may be shown (a null default: whether the column takes null)."""
    named = {p for _, p, a, d, _ in kinds if a == "setDefault" and d is not None}
    if not named:
        return rows.withColumn("_default", F.when(F.col("default_id").isNull(), F.col("nullable")).otherwise(F.lit(False)))
    keys = ["target_tbl", "default_id"]
    gone = _keys(_in(hidden, named), *keys).join(F.broadcast(defaults), keys, "left_semi").distinct()
    live = _found(defaults.join(_found(gone, True).rows, keys, "left_anti"), True).rows.withColumn("_live", F.lit(True))  # as many as the schema has
    joined = rows.join(F.broadcast(live), keys, "left")
    return joined.withColumn("_default", F.when(F.col("default_id").isNull(), F.col("nullable")).otherwise(F.coalesce("_live", F.lit(False)))).drop("_live")


def _absent(refs: DataFrame, nodes: DataFrame, kinds: set[tuple]) -> DataFrame:
    """References to rows that do not exist, but for those that show null then; by target table, so that small ones are broadcast."""
    own = refs.select(*KEY, "value", "target_tbl", "action", "nullable", "default_id").where("action <> 'setNull'")
    parts = [
        _in(own, {t}, "target_tbl").join(_in(nodes, {t}).select(F.col("row_id").alias("value")), "value", "left_anti").select(own.columns)
        for t in sorted({p for _, p, a, *_ in kinds if a != "setNull"})
    ]
    return reduce(DataFrame.unionByName, parts, own.limit(0))


def missing_hidden(refs: DataFrame, absent: Found, defaults: DataFrame, root_hidden: DataFrame, kinds: set[tuple], few: bool = False) -> DataFrame:
    """Rows hidden because a row they reference is missing, or hidden for that reason, and cannot be repaired (P5).

    ``absent`` are the references whose target does not exist. Only references to rows just hidden are followed, and only those
    of tables that refer to theirs; those that fall back on a default are judged again each round, as the default may have gone.
    """
    free = root_hidden.select(*KEY)
    if not absent:
        return free.limit(0)
    begun = {tuple(r) for r in absent.rows.select("tbl", "action").distinct().collect()}  # as many as the schema has
    at, waits = {t for t, _ in begun}, {t for t, a in begun if a == "setDefault"}
    lost = absent.rows.join(_in(free, at), KEY, "left_anti")
    front = _found(_default_holds(lost, defaults, free, kinds).where("action <> 'setDefault' or not _default").select(*KEY).distinct(), few)
    hidden = front.rows
    if not front and not waits:
        return hidden
    binding = {(t, p) for t, p, a, *_ in kinds if a not in ("setNull", "setDefault")}
    pairs = {(t, p) for t, p, a, *_ in kinds if a != "setNull"}
    follow = refs.where("action <> 'setNull'").select(absent.rows.columns)
    # a row in between must not be one that its own root hides
    if _circles(binding):
        sure = follow.where("action <> 'setDefault'").join(free, KEY, "left_anti")
        more = shortcuts(sure.join(_keys(free, "target_tbl", "value"), ["target_tbl", "value"], "left_anti").select(*KEY, "target_tbl", "value"), binding)
        nothing = [F.lit(None).cast(follow.schema[c].dataType).alias(c) for c in follow.columns if c not in (*KEY, "target_tbl", "value", "action")]
        follow = follow.unionByName(more.select(*KEY, "target_tbl", "value", F.lit("noAction").alias("action"), *nothing))
    rounds = 0
    while front:
        below = _below(at, pairs)
        if not below and not waits:
            return hidden
        reached = _in(follow, at, "target_tbl").join(_keys(front.rows, "target_tbl", "value"), ["target_tbl", "value"], "left_semi")
        waits |= {t for t, p, a, *_ in kinds if a == "setDefault" and p in at}
        at = below | waits
        lost = lost.where("action = 'setDefault'").unionByName(reached.select(lost.columns)).join(_in(hidden.unionByName(free), at), KEY, "left_anti")
        again = _found(lost, front.few)
        if not again:
            return hidden
        lost = again.rows
        judged = _default_holds(lost, defaults, free.unionByName(hidden), kinds).where("action <> 'setDefault' or not _default")
        front = _found(judged.select(*KEY).distinct(), again.few)
        hidden = hidden.unionByName(front.rows)
        rounds += 1
        if rounds % 8 == 0:
            hidden = _kept(hidden)
    return hidden


def visibility(nodes: DataFrame, refs: DataFrame, few: bool = False) -> DataFrame:
    """nodes with ``hidden`` and the materialised ``visibility`` (P3-P7). ``few`` tells that there are few nodes and references.

    Deletions are accepted with their cascade closures unless a row outside still needs one of the closure's rows: by a
    restricting reference, or by a default that cannot be shown. All such roots are rejected together, and the rest is
    tried again; rows that a root which stays leads keep their lead. A root whose closure is covered by a smaller root is
    not tested in that round. Being blocked climbs the cascade from the needed row to its roots, so no table of (root,
    row) pairs is ever built. ``nodes`` and ``refs``, whose rows are among the nodes, are read several times, table by table.
    """
    kinds = _kinds(refs)
    cascades = {(t, p) for t, p, a, *_ in kinds if a == "cascade"}
    links = with_shortcuts(refs.where("action = 'cascade'"), cascades)
    absent = _found(_absent(refs, nodes, kinds), few)
    defaults = _defaults(kinds, nodes)
    # what a cascade leads to is hidden with it, so only other references may need a row of a closure
    claims = refs.where("action not in ('setNull', 'cascade')")
    claimed = {p for _, p, a, *_ in kinds if a not in ("setNull", "cascade")}
    claiming = {t for t, _, a, *_ in kinds if a not in ("setNull", "cascade")}
    roots = _found(nodes.where("deleted").select(*KEY), few).rows
    labels = closure(roots, links, few=few, pairs=cascades)
    while True:
        hidden = labels.select(*KEY).unionByName(missing_hidden(refs, absent, defaults, labels, kinds, few))
        asked = _found(_in(labels, claimed).select(*KEY), few)
        needing = claims.join(_keys(asked.rows, "target_tbl", "value"), ["target_tbl", "value"], "left_semi")
        needing = _default_holds(needing, defaults, hidden, kinds).where("action <> 'setDefault' or not _default")
        blocked = needing.join(_in(hidden, claiming), KEY, "left_anti")
        blocked = _found(blocked.select(F.col("target_tbl").alias("tbl"), F.col("value").alias("row_id")).distinct(), few or asked.few)
        if not blocked:
            break
        climbed = _climbed(blocked, links, labels, claimed, cascades)
        leading = labels.where("lead.tbl = tbl and lead.row_id = row_id")
        invalid = _found(leading.select(*KEY).join(climbed, KEY, "left_semi"), blocked.few)
        if not invalid:
            break
        roots = _found(roots.join(invalid.rows, KEY, "left_anti"), few).rows
        of_invalid = invalid.rows.select(F.struct("tbl", "row_id").alias("lead"))
        lost = _found(labels.join(of_invalid, "lead", "left_semi").select(*KEY), few)
        labels = closure(roots, links, _found(labels.join(of_invalid, "lead", "left_anti").select(*KEY, "lead"), few).rows, few, cascades, lost)
    shown = nodes.join(hidden.withColumn("hidden", F.lit(True)), KEY, "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))
    own = values.visibility(F.col("reason"), F.lit(True))
    live = F.when(F.col("deleted"), 2).otherwise(0)
    return shown.withColumn("visibility", F.when(F.col("hidden"), F.when(F.col("deleted"), own).otherwise(5)).otherwise(live).cast("int"))


def _climbed(blocked: Found, links: DataFrame, labels: DataFrame, at: set[str], pairs: set[tuple[str, str]]) -> DataFrame:
    """Blocked rows (of the tables ``at``) and those whose closure holds one."""
    front, every, rounds = blocked, blocked.rows, 0
    while above := {p for t, p in pairs if t in at}:
        within = _in(links, at).join(_keys(_in(labels, above), "target_tbl", "value"), ["target_tbl", "value"], "left_semi")
        up = within.join(front.rows, KEY, "left_semi").select(F.col("target_tbl").alias("tbl"), F.col("value").alias("row_id")).distinct()
        front = _found(up.join(every, KEY, "left_anti"), front.few)
        if not front:
            break
        every, rounds, at = every.unionByName(front.rows), rounds + 1, above
        if rounds % 8 == 0:
            every = _kept(every)
    return every


@dataclass(frozen=True)
class Scope:
    """What a projection of some rows has to read (P1, P17): inner rows, whose state may change with the seeds; outer ones, which inner rows
    refer to, and so on upwards; of these the deleted rows that are known to stay visible, whatever the seeds do; the references of all; and how
    many rows there are."""

    inner: DataFrame
    outer: DataFrame
    rejected: DataFrame
    links: DataFrame
    count: int


def scope(nodes: DataFrame, refs: DataFrame, seeds: DataFrame) -> Scope:
    """Inner rows are the seeds, what refers to an inner row, also by a default, and the deleted rows above one whose verdict may turn with
    it. A deleted row reached from below is judged without its children where that is certain (see ``_judged``): only where
    it is not do its children enter. So a row that many refer to costs a count of them, not their closure."""
    kinds = _kinds(refs)
    pairs = {k[:2] for k in kinds}
    by_default = refs.where("action = 'setDefault' and default_id is not null").select(*KEY, "target_tbl", F.col("default_id").alias("value"))
    quick = with_shortcuts(refs.select(*KEY, "target_tbl", "value").unionByName(by_default), pairs)
    deleted = nodes.where("deleted").select(*KEY)
    spark = nodes.sparkSession
    none = spark.createDataFrame([], nodes.select(*KEY).schema)
    inner = outer = rejected = looked = none
    links, inside, outside, count = refs.limit(0), set(), set(), 0
    front = _found(seeds.select(*KEY).distinct(), True)
    at = _tables(front.rows)
    while front:
        few = front.few
        while front:  # down
            inner, inside = inner.unionByName(front.rows), inside | at
            below = _below(at, pairs)
            if not below:
                break
            down = _in(quick, at, "target_tbl").join(_keys(front.rows, "target_tbl", "value"), ["target_tbl", "value"], "left_semi").select(*KEY).distinct()
            front = _found(down.join(_in(inner, below), KEY, "left_anti") if below & inside else down, front.few)
            few, at = few and front.few, below
        counted = _found(inner, few)
        inner, count = counted.rows, counted.count
        up, at = _found(inner.join(looked, KEY, "left_anti"), few), inside
        while up:
            # each row's references are looked up once; its defaults are the same for all of its kind
            looked = looked.unionByName(up.rows)
            own = _found(_in(refs, at).join(up.rows, KEY, "left_semi"), up.few).rows
            links = links.unionByName(own)
            named = spark.createDataFrame(sorted({(p, d) for t, p, a, d, _ in kinds if t in at and a == "setDefault" and d is not None}), none.schema)
            above = own.select(F.col("target_tbl").alias("tbl"), F.col("value").alias("row_id")).unionByName(named).distinct()
            up = _found(above.join(inner.unionByName(outer), KEY, "left_anti"), up.few)
            at = {p for t, p in pairs if t in at}
            outer, outside = outer.unionByName(up.rows), outside | at
        counted = _found(outer.join(inner, KEY, "left_anti"), few)
        outer, count = counted.rows, count + counted.count
        rejected, front = _judged(_found(outer.join(_in(deleted, outside), KEY, "left_semi"), few), nodes, refs, kinds, inner)
        at = outside
    return Scope(inner, outer, rejected, links, count)


def _judged(candidates: Found, nodes: DataFrame, refs: DataFrame, kinds: set[tuple], inner: DataFrame) -> tuple[DataFrame, Found]:
    """Of deleted rows reached from below: those that stay visible for certain, and those that may turn with the inner rows.

    A row is hidden for certain if no table that its deletion cascades to is ever needed: none is named by a restricting
    reference, or by a default's that may fail. It stays visible for certain if it has a firm child: one outside of the inner
    rows, not deleted, that restricts it and has no other reference that could hide it.
    """
    if not candidates:
        return candidates.rows, candidates
    fallible = [k for k in kinds if k[2] == "setDefault" and (k[3] is not None or not k[4])]
    needed = {k[1] for k in kinds if k[2] in ("noAction", "restrict")} | {k[1] for k in fallible if k[3] is None}
    asked = {(k[1], k[3]) for k in fallible if k[3] is not None}
    binding = {k[0] for k in kinds if k[2] != "setNull"}
    if asked:
        named = nodes.where(reduce(lambda a, b: a | b, [(F.col("tbl") == t) & (F.col("row_id") == i) for t, i in asked]))
        sure = {tuple(r) for r in named.where("not deleted").join(inner, KEY, "left_anti").select(*KEY).collect()}  # as many as the schema has
        needed |= {t for t, i in asked if (t, i) not in sure or t in binding}
    falls = {(k[1], k[0]) for k in kinds if k[2] == "cascade"}  # deletions go from parent to child
    settled = {t for t in {x for k in kinds for x in k[:2]} if not _reached(t, falls) & needed}
    open_rows = candidates.rows.where(~F.col("tbl").isin(*settled)) if settled else candidates.rows
    hides = refs.where("action <> 'setNull'")
    firmly = {(k[0], k[1]) for k in kinds if k[2] in ("noAction", "restrict")}
    hides = _in(hides, {t for t, _ in firmly})
    children = hides.where("action in ('noAction', 'restrict')").join(_keys(open_rows, "target_tbl", "value"), ["target_tbl", "value"], "left_semi").select(*KEY, "target_tbl", "value")
    children = children.join(inner, KEY, "left_anti").join(_in(nodes, {t for t, _ in firmly}).where("not deleted").select(*KEY), KEY, "left_semi")
    others = hides.join(children.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.count_distinct("target_tbl", "value").alias("n")).where("n = 1")
    firm = children.join(others.select(*KEY), KEY, "left_semi").select(F.col("target_tbl").alias("tbl"), F.col("value").alias("row_id")).distinct()
    rejected = _found(firm, candidates.few).rows
    return rejected, _found(open_rows.join(rejected, KEY, "left_anti"), candidates.few)


def _reached(start: str, pairs: set[tuple[str, str]]) -> set[str]:
    found = {start}
    while more := {b for a, b in pairs if a in found} - found:
        found |= more
    return found


def _of_scope(nodes: DataFrame, part: Scope) -> tuple[DataFrame, DataFrame]:
    """The visibility of all rows of a scope, and their references."""
    every = part.inner.unionByName(part.outer)
    kept = part.rejected.withColumn("_stays", F.lit(True))
    own = nodes.join(every, KEY, "left_semi").join(kept, KEY, "left").withColumn("deleted", F.col("deleted") & F.col("_stays").isNull()).drop("_stays")
    few = part.count <= SMALL
    links = _found(part.links, few).rows
    return visibility(_found(own, few).rows, links, few=few), links


def project(nodes: DataFrame, refs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``visibility`` of the rows that may change with ``seeds`` (Z10), from their scope alone; the same as the whole projection gives them."""
    part = scope(nodes, refs, seeds)
    return _of_scope(nodes, part)[0].join(part.inner, KEY, "left_semi")


def project_values(nodes: DataFrame, refs: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``visibility`` and the ``repaired`` references of the rows that may change with ``seeds`` (Z10, P8), from their scope alone. All rows
    that refer to one that may change are among them, and what they refer to, defaults too, is in the scope."""
    part = scope(nodes, refs, seeds)
    shown, links = _of_scope(nodes, part)
    shown = _found(shown, part.count <= SMALL).rows
    return shown.join(part.inner, KEY, "left_semi"), repaired(links.join(part.inner, KEY, "left_semi"), shown)


def project_unique(rows: DataFrame, indexes: list[UniqueIndex], kinds: dict[str, str], seeds: DataFrame, before: DataFrame | None = None, *, hidden: str = "hidden", clock: str = "claim_hlc", row_id: str = "row_id", space: str = "space") -> DataFrame:
    """``unique`` of the rows that may change with ``seeds`` (space, row_id), from the rows they contest tuples with alone.

    ``rows`` are as they are now; ``before`` are the seeds as they were, whose claims are free now. Forwards along the indexes, rows
    that claim a tuple of rows found so far may change, as those may release or restore it. Backwards, what a row shows
    depends on those that claim its tuples. A released column claims nothing, or a text that is its row's own, so authored tuples
    tell all. A step is a semi join on the exact tuple; rows with a null in it share none.
    """
    key = [space, row_id]
    own = rows.select(*key, *dict.fromkeys(c for i in indexes for c in i.columns))
    found = own.join(seeds.select(*key), key, "left_semi")
    if before is not None:
        found = found.unionByName(before.select(own.columns))
    found = _found(found, True)
    for index in indexes:
        found = _found(found.rows.unionByName(_sharing(own, found.rows, index, space)).distinct(), found.few)
    affected = found.rows.select(*key)
    for index in reversed(indexes):
        found = _found(found.rows.unionByName(_sharing(own, found.rows, index, space)).distinct(), found.few)
    return unique(rows.join(found.rows.select(*key), key, "left_semi"), indexes, kinds, hidden=hidden, clock=clock, row_id=row_id, space=space).join(affected, key, "left_semi")


def _sharing(rows: DataFrame, found: DataFrame, index: UniqueIndex, space: str) -> DataFrame:
    """Rows that claim a tuple of an index which a row in ``found`` claims."""
    return claimants(rows, found, [space, *index.columns])


def overlaid(refs: DataFrame, overlays: DataFrame) -> DataFrame:
    """References as planned writes would leave them (R10, P2): ``overlays`` has (tbl, row_id, col, value); a null takes the
    reference away. Projecting these tells what a local write would show."""
    key = [*KEY, "col"]
    new = overlays.select(*key, F.struct("value").alias("_new"))
    joined = refs.join(new, key, "left")
    value = F.when(F.col("_new").isNotNull(), F.col("_new.value")).otherwise(F.col("value"))
    return joined.withColumn("value", value).where("value is not null").select(refs.columns)


def restored_references(shown: DataFrame, stored: DataFrame, pending: DataFrame) -> DataFrame:
    """What may be written before a batch's inserts (P15): a reference (``shown``) of a row that is there to one that is still to be
    inserted keeps its stored value. ``pending`` has (tbl, row_id); rows that are themselves pending carry theirs along."""
    waits = _keys(pending, "target_tbl", "shown").withColumn("_waits", F.lit(True))
    own = pending.select(*KEY).withColumn("_own", F.lit(True))
    joined = shown.join(waits, ["target_tbl", "shown"], "left").join(own, KEY, "left").join(stored.select(*KEY, "col", F.col("value").alias("_stored")), [*KEY, "col"], "left")
    return joined.withColumn("shown", F.when(F.col("_waits") & F.col("_own").isNull(), F.col("_stored")).otherwise(F.col("shown"))).select(shown.columns)


def attempts(wanted: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """What the store of attempted values needs (Z12): ``insert`` or ``update`` of fields whose shown value is not the authored one,
    ``delete`` of those kept so far without need; equal ones are left out. ``wanted`` has ``authored`` and ``shown``."""
    need = wanted.where(~F.col("authored").eqNullSafe(F.col("shown"))).select(*key, F.struct("authored").alias("_new"))
    joined = need.join(stored.select(*key, F.struct("value").alias("_old")), key, "full")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_new.authored").eqNullSafe(F.col("_old.value")), "update")
    return joined.select(*key, F.col("_new.authored").alias("value"), action.alias("action")).where("action is not null")


def visibility_writes(stored: DataFrame, projected: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose stored visibility is not the projected one, with both (Z14): all that has to be written."""
    old = stored.select(*key, F.col("visibility").alias("before"))
    return projected.select(*key, "visibility").join(old, key, "left").where(~F.col("visibility").eqNullSafe(F.col("before")))


def _with_targets(refs: DataFrame, nodes: DataFrame, kinds: set[tuple]) -> DataFrame:
    """References with ``_hidden`` of their target (null: there is none). Each kind is joined with the rows of its target table alone, which
    are broadcast where they are small, and what a kind's references have in common is not shuffled."""
    state = {t: _kept(_in(nodes, {t}).select(F.col("row_id").alias("value"), F.col("hidden").alias("_hidden"))) for t in sorted({k[1] for k in kinds})}
    parts = []
    for kind in sorted(kinds, key=str):
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(KIND, kind, strict=True)])
        joined = refs.where(same).drop(*KIND).join(state[kind[1]], "value", "left")
        parts.append(joined.withColumns({c: F.lit(v).cast(refs.schema[c].dataType) for c, v in zip(KIND, kind, strict=True)}).select(*refs.columns, "_hidden"))
    return reduce(DataFrame.unionByName, parts) if parts else refs.withColumn("_hidden", F.lit(None).cast("boolean"))


def repaired(refs: DataFrame, nodes: DataFrame, current: Column | None = None) -> DataFrame:
    """The value each reference shows, and why it differs (P8): nodes come from ``visibility``.

    A hidden or missing target gives null or the default where the action says so; a value without a row at all becomes
    null where the column takes it, and stays as stored (``current``, default the authored value) elsewhere.
    """
    kinds = _kinds(refs)
    judged = _default_holds(_with_targets(refs, nodes, kinds), _defaults(kinds, nodes), nodes.where("hidden"), kinds)
    lost = F.coalesce(F.col("_hidden"), F.lit(True))
    by_default = lost & (F.col("action") == "setDefault") & F.col("_default")
    shown = F.when(lost & (F.col("action") == "setNull"), F.lit(None)).when(by_default, F.col("default_id")).otherwise(F.col("value"))
    reason = F.when(lost & (F.col("action") == "setNull"), "foreignKeySetNull").when(by_default, "foreignKeySetDefault")
    # a default that may be shown exists, so only the authored value can lack a row
    absent = F.col("_hidden").isNull() & reason.isNull()
    stored = F.when(F.col("nullable"), F.lit(None).cast("string")).otherwise(F.col("value") if current is None else current)
    return judged.select(
        *KEY, "col", "value", F.when(absent, stored).otherwise(shown).alias("shown"), F.when(absent, "foreignKeyMissingParent").otherwise(reason).alias("reason")
    )


def target_presence(refs: DataFrame, crdt_rows: DataFrame) -> DataFrame:
    """Whether each reference's target is absent, visible or hidden (J7); crdt_rows has (tbl, row_id, visibility)."""
    state = crdt_rows.select(F.col("tbl").alias("target_tbl"), F.col("row_id").alias("value"), F.col("visibility").alias("_v"))
    presence = F.when(F.col("_v").isNull(), "absent").when(values.is_hidden(F.col("_v")), "hidden").otherwise("visible")
    return refs.join(state, ["target_tbl", "value"], "left").withColumn("presence", presence).drop("_v")


def invalid_references(refs: DataFrame, crdt_rows: DataFrame) -> DataFrame:
    """References whose target is missing, hidden or of another space (J6, R7); callers take one to report. Both have ``space``."""
    state = crdt_rows.select(F.col("tbl").alias("target_tbl"), F.col("row_id").alias("value"), F.col("space").alias("_space"), F.col("visibility").alias("_v"))
    joined = refs.join(state, ["target_tbl", "value"], "left")
    problem = F.when(F.col("_v").isNull(), "missing").when(F.col("_space") != F.col("space"), "otherSpace").when(values.is_hidden(F.col("_v")), "hidden")
    return joined.withColumn("problem", problem).where("problem is not null").drop("_space", "_v")


def local_delete_actions(refs: DataFrame, deleted: DataFrame) -> DataFrame:
    """What deleting rows does to the visible rows that name them (R3, R4): ``action`` is cascade, setNull, setDefault, or refused
    for restricting references."""
    tables = _tables(deleted)
    hits = [_in(refs, {t}, "target_tbl").join(_in(deleted, {t}).select(F.col("row_id").alias("value")), "value", "left_semi") for t in sorted(tables)]
    hit = reduce(DataFrame.unionByName, hits, refs.limit(0))
    both = tables & _tables(refs)
    if both:
        hit = hit.join(_in(deleted, both).select(*KEY), KEY, "left_anti")
    return hit.withColumn("action", F.when(F.col("action").isin("noAction", "restrict"), "refused").otherwise(F.col("action")))


def claim_clock(row_clock: Column, *field_clocks: Column) -> Column:
    """When a row claimed its tuple (W4): its newest indexed field, or its birth."""
    newest = F.greatest(*field_clocks) if len(field_clocks) > 1 else field_clocks[0]
    return F.coalesce(newest, row_clock)


def unique(rows: DataFrame, indexes: list[UniqueIndex], kinds: dict[str, str], *, hidden: str = "hidden", clock: str = "claim_hlc", row_id: str = "row_id", space: str = "space") -> DataFrame:
    """Releases unique claims (P10, W3): per index in order, hidden rows always release theirs, and of visible rows with one tuple
    the earliest claim (ties: the smaller id) keeps it. A tuple with a null claims nothing. The released column shows
    null, a marked text or a synthetic id by its kind in ``kinds``; ``unique_reason`` tells why.

    One window per index, by claim tuple; rows without a whole tuple, which may be most, do not enter it. A tuple that very many
    rows claim is still one sort: hence only keys and clocks enter it when the caller selects them so.
    """
    out = rows.withColumn("unique_reason", F.lit(None).cast("string"))
    for index in indexes:
        claims = [F.col(c) for c in index.columns]
        whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in claims])
        place = F.row_number().over(W.partitionBy(space, *index.columns, F.col(hidden)).orderBy(clock, row_id))
        why = F.when(F.col(hidden), "hiddenUniqueRelease").when(~F.col(hidden) & (place > 1), "uniqueConflict")
        released = index.release
        suffix = F.when(F.col("_why") == "hiddenUniqueRelease", "hidden").otherwise("conflict")
        free = values.conflict_free(kinds[released], F.col(released).cast("string"), F.col(row_id), released)
        if kinds[released] == "text":
            free = F.concat(F.col(released), F.lit("__"), suffix, F.lit("__"), F.col(row_id))
        claiming = out.where(whole).withColumn("_why", why)
        claiming = claiming.withColumn(released, F.when(F.col("_why").isNotNull(), free.cast(rows.schema[released].dataType)).otherwise(F.col(released)))
        claiming = claiming.withColumn("unique_reason", F.coalesce("_why", "unique_reason")).drop("_why")
        out = claiming.unionByName(out.where(~whole))
    return out


def attempted_diff(wanted: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """Fields whose shown value is not the authored one (P13): what has to be kept as attempted. Both have ``value``."""
    joined = wanted.withColumnRenamed("value", "authored").join(shown.withColumnRenamed("value", "shown"), keys)
    return joined.where(~F.col("authored").eqNullSafe(F.col("shown")))


def insert_safety(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """What an arriving row may write into each reference (P9): nodes has ``hidden``. A visible target is fine, and so is a hidden one
    whose deletion would take the row along; else the action decides, and what cannot be repaired waits as attempted."""
    kinds = _kinds(refs)
    judged = _default_holds(_with_targets(refs, nodes, kinds), _defaults(kinds, nodes), nodes.where("hidden"), kinds)
    fine = F.coalesce(~F.col("_hidden"), F.lit(False)) | (F.coalesce(F.col("_hidden"), F.lit(False)) & (F.col("action") == "cascade"))
    safe = F.when(fine, F.col("value")).when((F.col("action") == "setDefault") & F.col("_default"), F.col("default_id"))
    verdict = F.when(fine, "write").when(F.col("action") == "setNull", "setNull").when((F.col("action") == "setDefault") & F.col("_default"), "setDefault").otherwise("wait")
    return judged.select(*KEY, "col", "value", safe.alias("safe"), verdict.alias("verdict"))


def local_unique(rows: DataFrame, index: UniqueIndex, *, hidden: str = "hidden", restoring: str = "restoring", space: str = "space") -> DataFrame:
    """Local writes do not arbitrate (P12): adds ``outcome``, ``refused`` for a visible row whose tuple another visible row has (rows
    being restored are exempt), ``released`` for hidden claims, else ``kept``."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in index.columns])
    others = F.sum(F.when(~F.col(hidden), 1).otherwise(0)).over(W.partitionBy(space, *index.columns))
    outcome = F.when(F.col(hidden), "released").when(~F.col(hidden) & (others > 1) & ~F.col(restoring), "refused").otherwise("kept")
    # rows without a whole tuple claim nothing and stay out of the window
    return rows.where(whole).withColumn("outcome", outcome).unionByName(rows.where(~whole).withColumn("outcome", F.lit("kept")))


def claimants(rows: DataFrame, claims: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that hold any of the claimed tuples (F12): a semi join on the exact tuple."""
    return rows.join(claims.select(*columns).distinct(), columns, "left_semi")


def attempted_fields(attempted: DataFrame, fields: DataFrame, rows: DataFrame) -> DataFrame:
    """Attempted values with the clocks of their field and row."""
    key = ["space", "tbl", "row_id"]
    clocks = fields.select(*key, "column", F.col("hlc").alias("field_hlc"))
    return attempted.join(clocks, [*key, "column"]).join(rows.select(*key, F.col("hlc").alias("row_hlc")), key)


def is_stable(rows: DataFrame, *conditions: Column) -> DataFrame:
    """One row telling whether every condition holds for all rows (A14, R8): then a write needs no projection."""
    return rows.agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(f"c{i}") for i, c in enumerate(conditions)]).select(
        reduce(lambda a, b: a & b, [F.col(f"c{i}") for i in range(len(conditions))]).alias("stable")
    )
