"""Outbound replication: checkpoints, pending changes, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hlc as clocks
from ..functions import values
from ..sources.shared import shipped, staged
from .merge import State, sparse_clocks

KINDS = ("insert", "update", "delete")


@dataclass(frozen=True)
class Budget:
    """Bounds of a batch, both inclusive (T5)."""

    max_changes: int | None = None
    max_payload: int | None = None

    def __post_init__(self) -> None:
        for bound in (self.max_changes, self.max_payload):
            if bound is not None and bound < 1:
                raise ValueError("bounds of a batch are positive")


def after_checkpoints(changes: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Changes that a peer has not confirmed (F11): newer than the checkpoint (time and counter) of their space and node, and
    all of nodes it does not know. One left join; the checkpoints (a row per space and node) broadcast where they are small."""
    known = checkpoints.select(F.col("space").alias("_s"), F.col("node").alias("_n"), F.col("hlc").alias("_c"))
    joined = changes.join(known, (F.col("space") == F.col("_s")) & (F.col("hlc.node") == F.col("_n")), "left")
    newer = (F.col("hlc.ms") > F.col("_c.ms")) | ((F.col("hlc.ms") == F.col("_c.ms")) & (F.col("hlc.counter") > F.col("_c.counter")))
    return joined.where(F.col("_c").isNull() | newer).drop("_s", "_n", "_c")


def checkpoints_of(changes: DataFrame) -> DataFrame:
    """The newest clock per space and node (A3)."""
    return changes.groupBy("space", F.col("hlc.node").alias("node")).agg(F.max("hlc").alias("hlc"))


def advanced(stored: DataFrame, received: DataFrame, *, force: bool = False) -> DataFrame:
    """Checkpoints after a batch: never backwards (M11, T13), or simply replaced where ``force`` says so."""
    old = stored.select("space", "node", F.col("hlc").alias("_old"))
    new = received.select("space", "node", F.col("hlc").alias("_new"))
    value = F.coalesce("_new", "_old") if force else F.greatest("_old", "_new")
    return old.join(new, ["space", "node"], "full").select("space", "node", value.alias("hlc"))


def resume_vector(nodes: DataFrame, received: DataFrame, own_node: str, now_ms: Column) -> DataFrame:
    """What a replica asks a peer to resume from (T12): for its own node the later of its last stamp and now, for others the
    last clock received of them, else the beginning of time. ``nodes`` has (space, node, last)."""
    seen = received.select("space", "node", F.col("hlc").alias("_seen"))
    own = F.greatest(clocks.hlc(now_ms, F.lit(0), F.col("node")), F.col("last"))
    clock = F.when(F.col("node") == own_node, own).otherwise(F.coalesce("_seen", clocks.zero(F.col("node"))))
    return nodes.join(seen, ["space", "node"], "left").select("space", "node", clock.alias("hlc"))


def unsent_rows(parts: list[DataFrame], checkpoints: DataFrame, own_node: str, held: DataFrame | None = None) -> DataFrame:
    """The number of own rows that wait to be sent (A8, T14): distinct rows over births, fields and replicated generations after the
    confirmed checkpoints, and rows held back."""
    keys = [after_checkpoints(p.where(F.col("hlc.node") == own_node), checkpoints).select("space", "tbl", "row_id") for p in parts]
    if held is not None:
        keys.append(held.select("space", "tbl", "row_id"))
    return reduce(DataFrame.unionByName, keys).distinct().agg(F.count("*").alias("unsent"))


def went_back(before: DataFrame, after: DataFrame) -> DataFrame:
    """(space, node) whose checkpoint is gone or older than it was."""
    now = after.select("space", "node", F.col("hlc").alias("_now"))
    return before.join(now, ["space", "node"], "left").where("_now is null or _now < hlc").select("space", "node")


def unsent_count(parts: Callable[[], list[DataFrame]], checkpoints: Callable[[], DataFrame], own_node: str, held: Callable[[], DataFrame] | None = None, *, attempts: int = 3) -> int:
    """``unsent_rows`` while others write (T14): the functions read what is stored at that time. Checkpoints that are read before a count
    and again after it must not have gone back in between, as replaced ones do: else rows they cleared were not counted. After
    ``attempts`` such counts all own rows count, which is never too few."""
    counted = lambda confirmed: unsent_rows(parts(), confirmed, own_node, held() if held else None).first()["unsent"]
    before = staged(checkpoints().select("space", "node", "hlc"), "checkpoints")
    for _ in range(attempts):
        found = counted(before)
        after = staged(checkpoints().select("space", "node", "hlc"), "checkpoints")
        if went_back(before, after).isEmpty():
            return found
        before = after
    return counted(before.limit(0))


def pending(state: State, checkpoints: DataFrame) -> DataFrame:
    """Changes to send, without payload (T1, U4): births, then sparse field clocks, then replicated generations after the checkpoints.
    Checkpoints filter each table before anything is joined."""
    none = {"column": F.lit(None).cast("string"), "cl_flag": F.lit(None).cast("int"), "reason": F.lit(None).cast("string")}
    columns = ["space", "tbl", "row_id", "kind", "column", "cl_flag", "reason", "hlc"]
    births = state.rows.withColumns({"kind": F.lit("insert"), **none})
    updates = sparse_clocks(state).withColumns({"kind": F.lit("update"), "cl_flag": none["cl_flag"], "reason": none["reason"]})
    synced = state.generations.where(values.is_synced(F.col("reason"))).withColumns({"kind": F.lit("delete"), "column": none["column"]})
    return reduce(DataFrame.unionByName, [after_checkpoints(t, checkpoints).select(columns) for t in (births, updates, synced)])


def resolved(changes: DataFrame, fields: DataFrame, attempted: DataFrame) -> DataFrame:
    """Late payloads (J13, T2): the value of each update, the authored one where projection shows another. ``present`` tells an
    authored null from none; ``missing`` marks updates whose row has no such field."""
    key = ["space", "tbl", "row_id", "column"]
    shown = fields.select(*key, F.col("value").alias("_shown"), F.lit(True).alias("_has"))
    wish = attempted.select(*key, F.col("value").alias("_wish"), F.lit(True).alias("_authored"))
    joined = changes.join(shown, key, "left").join(wish, key, "left")
    value = F.when(F.col("_authored"), F.col("_wish")).otherwise(F.col("_shown"))
    lost = (F.col("kind") == "update") & F.col("_has").isNull() & F.col("_authored").isNull()
    return joined.select(*changes.columns, value.alias("value"), lost.alias("missing"))


def ordered(changes: DataFrame, by: str = "session", *, tie: list[str] = (), bucket_ms: int = 60_000) -> DataFrame:
    """Adds ``pos``: clock, then insert before update before delete, then table, row and column, then ``tie`` (W5), within each session.

    In two levels: rows are numbered within stretches of ``bucket_ms`` of the clock, and the stretches' counts run along the
    session; so a session with very many changes is many tasks' work.
    """
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    rows = changes.withColumn("_bucket", F.floor(F.col("hlc.ms") / bucket_ms))
    earlier = W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    passed = rows.groupBy(by, "_bucket").agg(F.count("*").alias("_n")).select(by, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_passed"))
    within = F.row_number().over(W.partitionBy(by, "_bucket").orderBy("hlc", kind, "tbl", "row_id", F.coalesce("column", F.lit("")), *tie))
    return rows.withColumn("_within", within).join(passed, [by, "_bucket"]).select(*changes.columns, (F.col("_passed") + F.col("_within")).alias("pos"))


def _stretched(rows: DataFrame, stretch: int) -> DataFrame:
    return rows.withColumn("_stretch", F.floor((F.col("pos") - 1) / stretch))


def _running(rows: DataFrame, keys: list[str], sums: dict[str, Column], *, to_current: bool) -> DataFrame:
    """Adds running sums along the positions of each key, in two levels: within stretches, and over the stretches' totals."""
    inside = W.partitionBy(*keys, "_stretch").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow if to_current else -1)
    earlier = W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_stretch").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    bases = totals.select(*keys, "_stretch", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums])
    own = rows.withColumns({f"_own_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    joined = own.join(bases, [*keys, "_stretch"])
    return joined.withColumns({n: F.col(f"_base_{n}") + F.col(f"_own_{n}") for n in sums}).drop(*[f"_{k}_{n}" for k in ("base", "own") for n in sums])


def _before(rows: DataFrame, keys: list[str], what: list[str]) -> DataFrame:
    """Adds ``_prior``, a struct of the columns ``what`` of the row before along the positions of each key (null at the first)."""
    row = F.struct(*what)
    inside = F.lag(row).over(W.partitionBy(*keys, "_stretch").orderBy("pos"))
    along = W.partitionBy(*keys).orderBy("_stretch")
    last = rows.groupBy(*keys, "_stretch").agg(F.max_by(row, "pos").alias("_last")).select(*keys, "_stretch", F.lag("_last").over(along).alias("_carried"))
    return rows.withColumn("_inside", inside).join(last, [*keys, "_stretch"]).withColumn("_prior", F.coalesce("_inside", "_carried")).drop("_inside", "_carried")


def dependencies(changes: DataFrame, references: DataFrame, by: str = "session") -> DataFrame:
    """(session, dependent, prerequisite) positions (J15): a change that names a row whose insert is sent after it. An equi join on
    the referenced row with the order as residual. ``references`` has (session, pos, target_tbl, target_id).

    The pairs are as many as the answer, so nothing is done to them after the join: references named twice are dropped before it,
    and a position is one change, so no pair comes twice."""
    parents = changes.where("kind = 'insert'").select(F.col(by), F.col("tbl").alias("target_tbl"), F.col("row_id").alias("target_id"), F.col("pos").alias("prerequisite"))
    named = references.select(F.col(by), F.col("pos").alias("dependent"), "target_tbl", "target_id").distinct()
    return named.join(parents, [by, "target_tbl", "target_id"]).where("prerequisite > dependent").select(by, "dependent", "prerequisite")


def units(changes: DataFrame, depends: DataFrame | None = None, by: str = "session", *, stretch: int = 65536) -> DataFrame:
    """Adds part, grp and unit numbers to ordered changes (W7, W8): a batch ends between parts, should between groups, better between units.

    What belongs together is a range of positions, and a cut is allowed where no range is open: ranges become +1 and -1
    at their ends, a running sum counts open ones, and a second running sum counts cuts. Running sums and looks at the
    change before go by stretches of positions, whose totals are carried on; only an unbroken run of one node's deletes
    is one window.
    """
    changes = staged(changes, "ordered")  # each of the ranges reads them
    rows = _stretched(changes, stretch).withColumn("_node", F.col("hlc.node"))
    rows = _before(rows, [by], ["hlc"]).withColumn("_same_clock", F.coalesce(F.col("_prior.hlc") == F.col("hlc"), F.lit(False))).drop("_prior")
    row = W.partitionBy(by, "tbl", "row_id")
    insert = F.max(F.when(F.col("kind") == "insert", F.col("pos"))).over(row)
    prior = lambda c: F.col(f"_prior.{c}")
    rows = _before(rows, [by, "_node"], ["pos", "hlc", "tbl", "row_id"]).withColumns({
        "_insert": insert, "_first": F.min("pos").over(row), "_chain": F.coalesce(clocks.follows(F.col("hlc"), prior("hlc")), F.lit(False)),
        "_prev": prior("pos"), "_same_row": (prior("tbl") == F.col("tbl")) & (prior("row_id") == F.col("row_id")),
        "_cascade": F.coalesce((F.col("kind") == "delete") & (F.col("reason") == "userCascadeDelete"), F.lit(False)),
        "_tomb": F.coalesce((F.col("kind") == "delete") & F.col("reason").isin("userDelete", "userCascadeDelete"), F.lit(False)),
    }).drop("_prior", "cl_flag", "column", "kind", "reason", "hlc")
    rows = staged(rows, "ordered-marks")
    same_clock = rows.where("_same_clock").select(by, (F.col("pos") - 1).alias("lo"), F.col("pos").alias("hi"), F.lit("part").alias("level"))
    with_insert = rows.where("pos = _insert and _first < pos").select(by, F.col("_first").alias("lo"), F.col("pos").alias("hi"), F.lit("part").alias("level"))
    one_write = rows.where("_chain and _same_row").select(by, F.col("_prev").alias("lo"), F.col("pos").alias("hi"), F.lit("grp").alias("level"))
    # islands of deletes of a node, then of unbroken stamps within them
    tombs = _running(rows, [by, "_node"], {"_run": F.when(~F.col("_tomb"), 1).otherwise(0)}, to_current=True).where("_tomb")
    island = W.partitionBy(by, "_node", "_run")
    in_run = island.orderBy("pos")
    tombs = tombs.withColumns({"_start": F.min("pos").over(island), "_last": F.max(F.when(F.col("_cascade"), F.col("pos"))).over(island), "_first_cascade": F.min(F.when(F.col("_cascade"), F.col("pos"))).over(island)})
    linked = F.col("_chain") & (F.col("pos") > F.col("_start"))
    tombs = tombs.withColumn("_link", F.sum(F.when(linked, 0).otherwise(1)).over(in_run))
    tail = tombs.withColumn("_head", F.min("pos").over(W.partitionBy(by, "_node", "_run", "_link"))).where("pos = _first_cascade")
    tails = tail.select(by, F.col("_head").alias("lo"), F.col("_last").alias("hi"), F.lit("grp").alias("level"))
    runs = tail.select(by, F.col("_start").alias("lo"), F.col("_last").alias("hi"), F.lit("unit").alias("level"))
    ranges = [same_clock, with_insert, one_write, tails, runs]
    if depends is not None:
        ranges.append(depends.select(by, F.col("dependent").alias("lo"), F.col("prerequisite").alias("hi"), F.lit("part").alias("level")))
    every = reduce(DataFrame.unionByName, ranges).where("hi > lo")
    ends = every.select(by, "level", F.inline(F.array(F.struct(F.col("lo").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("pos"), F.lit(-1).alias("d")))))
    names = ("part", "grp", "unit")
    steps = ends.groupBy(by, "pos").agg(*[F.sum(F.when(F.col("level") == n, F.col("d")).otherwise(0)).alias(f"_{n}") for n in names])
    places = _stretched(changes.select(by, "pos"), stretch).join(steps, [by, "pos"], "left").na.fill(0, [f"_{n}" for n in names])
    covers = {"part": F.col("_part"), "grp": F.col("_part") + F.col("_grp"), "unit": F.col("_part") + F.col("_grp") + F.col("_unit")}
    depth = _running(places, [by], {f"_open_{n}": c for n, c in covers.items()}, to_current=True)
    cuts = {n: F.when(F.col(f"_open_{n}") == 0, 1).otherwise(0) for n in names}
    numbered = _running(depth, [by], cuts, to_current=False).select(by, "pos", *names)
    return changes.join(numbered, [by, "pos"]).select(*changes.columns, *names)


def prefix(units_of: DataFrame, max_changes: int, by: str = "session") -> DataFrame:
    """The units an empty batch takes under a change limit (W10): the first whatever its size, then those whose running total fits.
    A unit has a change at least, so no more than the limit's number of units are looked at."""
    sizes = units_of.where(F.col("unit") <= max_changes).groupBy(by, "unit").agg(F.count("*").alias("n"))
    line = W.partitionBy(by).orderBy("unit")
    taken = sizes.withColumn("_sum", F.sum("n").over(line)).withColumn("_k", F.row_number().over(line)).where((F.col("_k") == 1) | (F.col("_sum") <= max_changes))
    return units_of.join(taken.select(by, "unit"), [by, "unit"], "left_semi")


class Cutter:
    """Cuts one session's units, in order, into batches under a budget."""

    def __init__(self, budget: Budget):
        self.budget, self.number, self.changes, self.payload = budget, 0, 0, 0

    def fits(self, changes: int, payload: int) -> bool:
        most, load = self.budget.max_changes, self.budget.max_payload
        return (most is None or changes <= most) and (load is None or payload <= load)

    def place(self, parts: list[tuple], level: int = 0) -> list[int]:
        """The batch of each part (unit, grp, part, changes, payload) of one block."""
        changes, payload = sum(p[3] for p in parts), sum(p[4] for p in parts)
        if not self.fits(self.changes + changes, self.payload + payload):
            if self.changes:
                self.number, self.changes, self.payload = self.number + 1, 0, 0
            if level < 2 and not self.fits(changes, payload):
                return [n for _, inner in groupby(parts, key=lambda p: p[level + 1]) for n in self.place(list(inner), level + 1)]
        self.changes, self.payload = self.changes + changes, self.payload + payload
        return [self.number] * len(parts)


CUT = "session string, unit long, grp long, part long, changes long, payload long, batch long"


def batches(parts: DataFrame, budget: Budget, by: str = "session") -> DataFrame:
    """Cuts all rounds of a session at once (W11): adds ``batch`` to one row per part (session, unit, grp, part, changes, payload).

    A batch takes whole units while they fit; a unit that exceeds an empty batch goes by groups, such a group by parts,
    and a part that alone exceeds the budget is a batch. The cut depends on all before it, so a session's parts (not
    its changes) stream through one task in order, which holds the open unit; sessions are independent.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, session, unit = Cutter(budget), None, []
        for batch in found:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("session", "unit", "grp", "part", "changes", "payload")), strict=True):
                if unit and (row[0], row[1]) != (session, unit[0][0]):
                    out += [(session, *p, n) for p, n in zip(unit, cutter.place(unit), strict=True)]
                    unit = []
                if row[0] != session:
                    cutter, session = Cutter(budget), row[0]
                unit.append(row[1:])
            if out:
                yield _cut_rows(out)
        if unit:
            yield _cut_rows([(session, *p, n) for p, n in zip(unit, cutter.place(unit), strict=True)])

    shipped(parts.sparkSession)
    own = parts.selectExpr(f"cast({by} as string) as session", *[f"cast({c} as long) as {c}" for c in ("unit", "grp", "part", "changes", "payload")])
    return own.repartition("session").sortWithinPartitions("session", "part").mapInArrow(run, CUT)


def _cut_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in CUT.split(", ")]
    types = [pa.string(), *[pa.int64()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def chunks(changes: DataFrame, size: int = 100, by: str = "session") -> DataFrame:
    """Adds the number of the frame that carries each ordered change."""
    return changes.withColumn("chunk", F.floor((F.col("pos") - 1) / size))


def isolated(changes: DataFrame, withheld: DataFrame, released: DataFrame) -> DataFrame:
    """Row isolation (D17): changes of withheld rows wait; rows released since go out again whole. Both have (space, tbl, row_id)."""
    key = ["space", "tbl", "row_id"]
    return changes.join(withheld, key, "left_anti").unionByName(released).dropDuplicates([*key, "kind", "column"])


SENT = ["session", "space", "tbl", "row_id", "kind", "column"]


def sent_once(sent: DataFrame, changes: DataFrame) -> DataFrame:
    """Of ``changes`` (session, row, kind, column, hlc) those that their session has not ``sent`` yet, or in an older writing (D17, T3): the
    newest of each. Marks of kind ``end`` pass. Both tables meet in one aggregate with map-side partials, where nulls are
    equal, so a row that is released again and again is one row of each task."""
    both = sent.select(*SENT, F.col("hlc").alias("_old"), F.lit(None).cast(clocks.TYPE).alias("_new")).unionByName(
        changes.where("kind <> 'end'").select(*SENT, F.lit(None).cast(clocks.TYPE).alias("_old"), F.col("hlc").alias("_new"))
    )
    newest = both.groupBy(*SENT).agg(F.max("_old").alias("_old"), F.max("_new").alias("hlc"))
    going = newest.where(F.col("hlc").isNotNull() & (F.col("_old").isNull() | (F.col("hlc") > F.col("_old")))).drop("_old")
    return going.unionByName(changes.where("kind = 'end'").select(*SENT, "hlc"))


def sent_after(sent: DataFrame, out: DataFrame) -> DataFrame:
    """What sessions remember after ``out`` has gone: the newest clock of each change; nothing of sessions that have ended."""
    newest = sent.unionByName(out.where("kind <> 'end'")).groupBy(*SENT).agg(F.max("hlc").alias("hlc"))
    return newest.join(out.where("kind = 'end'").select("session").distinct(), "session", "left_anti")


def status(rounds: DataFrame) -> DataFrame:
    """The state of each replica from its rounds (T17): rounds has (replica, at, phase, ok, unsent). The newest phase and count,
    and the newest success and failure."""
    last = F.max(F.struct("at", "phase", "unsent"))
    return rounds.groupBy("replica").agg(
        last.alias("_last"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"), F.max(F.when(~F.col("ok"), F.col("at"))).alias("last_failure"), F.count("*").alias("rounds")
    ).select("replica", F.col("_last.phase").alias("phase"), F.col("_last.unsent").alias("unsent"), "last_success", "last_failure", "rounds")
