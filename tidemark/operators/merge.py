"""Merging a change log into replica state.

A change log has the columns space, tbl, row_id, kind (insert, update, delete), column, value, payload
(map<string,string> of an insert), cl_flag, reason, hlc. State is three tables: rows (birth clock), fields (value and
clock per column) and generations (visibility). Registers and generations are maxima over clocks, so merging them is commutative,
associative and idempotent, and one shuffle by row key with map-side partials is all it takes. Births are not: a row that
is stored keeps its clock, so batches that bring the inserts of one row in another order give it another birth (a
rebuild takes the smallest, and so does ``merged`` where it is asked to), and updates that come before any insert of their
row are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values

ROW = ["space", "tbl", "row_id"]
FIELD = [*ROW, "column"]


@dataclass(frozen=True)
class State:
    rows: DataFrame
    fields: DataFrame
    generations: DataFrame


#: What becomes of a table of a new state, by its name, before the next one is made from it: nothing, or it is stored.
Keep = Callable[[DataFrame, str], DataFrame]


def _as_it_is(table: DataFrame, name: str) -> DataFrame:
    return table


def field_writes(changes: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Every authored value with its clock: updates, and inserts over all columns of their table's schema (absent ones as null)."""
    inserts = changes.where("kind = 'insert'")
    per_table = F.lit(None).cast("array<string>")
    for table, names in columns.items():
        per_table = F.when(F.col("tbl") == table, F.array(*[F.lit(n) for n in names])).otherwise(per_table)
    spread = inserts.select(*ROW, "hlc", "payload", F.explode(per_table).alias("column"))
    born = spread.select(*FIELD, F.try_element_at("payload", F.col("column")).alias("value"), "hlc")
    return born.unionByName(changes.where("kind = 'update'").select(*FIELD, "value", "hlc"))


def registers(writes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The last-writer-wins register per key (A6): the value of the largest clock; equal clocks fall back to the value itself."""
    keys = keys or FIELD
    last = writes.groupBy(*keys).agg(F.max(F.struct("hlc", "value")).alias("last"))
    return last.select(*keys, F.col("last.value").alias("value"), F.col("last.hlc").alias("hlc"))


def births(changes: DataFrame) -> DataFrame:
    """A row's clock is its first insert's (M4); later inserts only write columns (M5)."""
    return changes.where("kind = 'insert'").groupBy(*ROW).agg(F.min("hlc").alias("hlc"))


def generations(changes: DataFrame) -> DataFrame:
    """The largest (causal length, clock) of each row's replicated visibility changes."""
    return _largest(changes.where("kind = 'delete'").where(values.is_synced(F.col("reason"))))


def later_inserts(changes: DataFrame, rows: DataFrame) -> DataFrame:
    """Generations of inserts that name a known row (M5): causal length one, ``userInsert``, where the insert is newer than the row's
    birth. They count as long as nothing has deleted the row."""
    born = rows.select(*ROW, F.col("hlc").alias("_born"))
    again = changes.where("kind = 'insert'").join(born, ROW).where("hlc > _born")
    return _largest(again.select(*ROW, F.lit(1).alias("cl_flag"), "hlc", F.lit("userInsert").alias("reason")))


def _largest(synced: DataFrame) -> DataFrame:
    last = synced.groupBy(*ROW).agg(F.max(F.struct("cl_flag", "hlc", "reason")).alias("last"))
    return last.select(*ROW, F.col("last.cl_flag").alias("cl_flag"), F.col("last.hlc").alias("hlc"), F.col("last.reason").alias("reason"))


def state_of(changes: DataFrame, columns: dict[str, list[str]], *, with_later_inserts: bool = False, keep: Keep = _as_it_is) -> State:
    """State of a whole log. Updates and visibility changes of rows without an insert are dropped (M6, M7). ``with_later_inserts``
    also stores the generations that inserts of known rows make (M5). A ``keep`` that stores tables saves working out births for
    each of the others, and the state for each use."""
    rows = keep(births(changes), "rows")
    keys = rows.select(*ROW)
    fields = registers(field_writes(changes, columns)).join(keys, ROW, "left_semi")
    stored = generations(changes).join(keys, ROW, "left_semi")
    if with_later_inserts:
        stored = _largest(stored.unionByName(later_inserts(changes, rows)))
    return State(rows, keep(fields, "fields"), keep(stored, "generations"))


def merged(state: State, changes: DataFrame, columns: dict[str, list[str]], *, with_later_inserts: bool = False, keep: Keep = _as_it_is) -> State:
    """State after one more batch. Stored row clocks stay; registers take the larger clock of both sides. ``keep`` as in ``state_of``.

    ``with_later_inserts`` (M5) makes births a register as well: a row's clock is the smallest of its inserts, whichever batch
    brings it, and every other insert's, a stored birth's too, a generation. So batches of inserts in any order give what a
    rebuild gives.
    """
    if with_later_inserts:
        inserts = changes.where("kind = 'insert'").select(*ROW, "hlc").unionByName(state.rows.select(*ROW, "hlc"))
        rows = keep(inserts.groupBy(*ROW).agg(F.min("hlc").alias("hlc")), "rows")
        again = inserts.join(rows.withColumnRenamed("hlc", "_born"), ROW).where("hlc > _born")
        more = again.select(*ROW, F.lit(1).alias("cl_flag"), "hlc", F.lit("userInsert").alias("reason"))
    else:
        rows = keep(state.rows.unionByName(births(changes).join(state.rows.select(*ROW), ROW, "left_anti")), "rows")
        more = None
    keys = rows.select(*ROW)
    fields = registers(state.fields.unionByName(field_writes(changes, columns))).join(keys, ROW, "left_semi")
    new = generations(changes).join(keys, ROW, "left_semi")
    both = state.generations.unionByName(new)
    return State(rows, keep(fields, "fields"), keep(_largest(both if more is None else both.unionByName(more)), "generations"))


VIOLATION = [*ROW, "column", "node", "hlc", "kind"]


def violations_of(changes: DataFrame, *, owners: DataFrame, granted: DataFrame | None = None, reserved: dict[str, str] | None = None, by: list[str] = ()) -> DataFrame:
    """What a batch may not do, found before anything of it is merged (M2, M9, T11, M15): ``VIOLATION`` and the columns ``by``.

    ``reservedValue``: a text that only projection writes, in a column of ``reserved`` (column to text or uuid).
    ``ownershipCollision``: a row that another space owns, by ``owners`` (tbl, row_id, owner_space) or by the first insert of it here.
    ``unauthorizedWrite``: a space in which the author's node (``granted``: space, node, role) may not write.
    """
    kept = lambda rows, column, kind: rows.select(*by, *ROW, column.alias("column"), F.col("hlc.node").alias("node"), "hlc", F.lit(kind).alias("kind"))
    none = F.lit(None).cast("string")
    found = []
    if reserved:
        text = lambda c: F.when(F.col("kind") == "insert", F.try_element_at("payload", F.lit(c))).when((F.col("kind") == "update") & (F.col("column") == c), F.col("value"))
        bad = F.array(*[F.when(values.is_reserved(text(c), kind), c) for c, kind in reserved.items()])
        spread = changes.withColumn("column", F.explode(bad)).where("column is not null")
        found.append(kept(spread, F.col("column"), "reservedValue"))
    first = changes.where("kind = 'insert'").groupBy("tbl", "row_id").agg(F.min_by("space", "hlc").alias("owner_space"))
    every = owners.select("tbl", "row_id", "owner_space").unionByName(first.join(owners.select("tbl", "row_id"), ["tbl", "row_id"], "left_anti"))
    found.append(kept(ownership_collisions(changes, every), none, "ownershipCollision"))
    if granted is not None:
        may = granted.where("role = 'readWrite'").select(F.col("space").alias("_space"), F.col("node").alias("_node"))
        others = changes.join(may, (F.col("space") == F.col("_space")) & (F.col("hlc.node") == F.col("_node")), "left_anti")
        found.append(kept(others, none, "unauthorizedWrite"))
    return reduce(DataFrame.unionByName, found)


def row_visibility(state: State) -> DataFrame:
    """rows with cl_flag (1 without any generation) and the stored visibility (M8)."""
    joined = state.rows.join(state.generations.withColumnRenamed("hlc", "generation_hlc"), ROW, "left")
    flag = F.coalesce("cl_flag", F.lit(1))
    return joined.withColumn("cl_flag", flag).withColumn("visibility", values.visibility(F.col("reason"), values.is_deleted(flag)))


def wide(fields: DataFrame, columns: list[str]) -> DataFrame:
    """One row per domain row, a column per field."""
    return fields.groupBy(*ROW).agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])


def sparse_clocks(state: State) -> DataFrame:
    """Field clocks that differ from their row's: the only ones that need storing or sending."""
    rows = state.rows.withColumnRenamed("hlc", "row_hlc")
    return state.fields.join(rows, ROW).where("hlc <> row_hlc").drop("row_hlc")


def latest_stamp(state: State) -> DataFrame:
    """The newest clock of each space over all three tables (A5)."""
    every = [t.select("space", "hlc") for t in (state.rows, state.fields, state.generations)]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("space").agg(F.max("hlc").alias("hlc"))


def own_and_others(changes: DataFrame, own_node: Column) -> DataFrame:
    """The newest own and foreign clock of a batch, by which the node's clock moves on."""
    own = F.col("hlc.node") == own_node
    return changes.agg(F.max(F.when(own, F.col("hlc"))).alias("own"), F.max(F.when(~own, F.col("hlc"))).alias("others"))


def ownership_collisions(changes: DataFrame, owners: DataFrame) -> DataFrame:
    """Changes of rows that another space owns (M9, J10): owners has (tbl, row_id, owner_space)."""
    return changes.join(owners, ["tbl", "row_id"]).where("owner_space <> space")


def by_row(changes: DataFrame) -> DataFrame:
    """Rows that a batch touches, with the columns written."""
    return changes.groupBy(*ROW).agg(F.sort_array(F.collect_set("column")).alias("columns"), F.max("hlc").alias("last"), F.count("*").alias("changes"))
