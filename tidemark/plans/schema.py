"""Table descriptions that plans are built from, their rules, and their fingerprint (D12, D15, D16, T9, Z9, section 1.3)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column as SqlColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaMismatch

ACTIONS = ("cascade", "restrict", "noAction", "setNull", "setDefault")


class SchemaError(ValueError):
    """A table description that replication cannot keep consistent."""


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "string"
    nullable: bool = True


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    on_delete: str = "noAction"
    nullable: bool = True
    default: str | None = None
    deferred: bool = True


@dataclass(frozen=True)
class UniqueIndex:
    columns: tuple[str, ...]
    release: str
    per_space: bool = True


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    indexes: tuple[UniqueIndex, ...] = field(default=())

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


def validate(tables: list[Table]) -> None:
    """Raises SchemaError at the first broken rule."""
    names = {t.name for t in tables}
    for t in tables:
        own = {c.name: c for c in t.columns}
        if own.get("id", Column("")).type != "uuid":
            raise SchemaError(f"{t.name}: the key must be a UUID named id")
        if own.get("space_id", Column("")).type != "bigint":
            raise SchemaError(f"{t.name}: an integer space_id is needed")
        for k in t.foreign_keys:
            if k.parent not in names or k.column not in own:
                raise SchemaError(f"{t.name}.{k.column}: unknown table or column")
            if k.on_delete not in ACTIONS or k.on_delete == "restrict":
                raise SchemaError(f"{t.name}.{k.column}: use noAction instead of {k.on_delete}")
            if not k.nullable and not k.deferred:
                raise SchemaError(f"{t.name}.{k.column}: a required reference must be deferred")
        keys = {k.column: k for k in t.foreign_keys}
        for i in t.indexes:
            if not set(i.columns) <= set(own):
                raise SchemaError(f"{t.name}: an index names an unknown column")
            if any(own[c].type == "json" for c in i.columns):
                raise SchemaError(f"{t.name}: JSON cannot be unique")
            if not i.per_space and not all(c in keys for c in i.columns):
                raise SchemaError(f"{t.name}: unique indexes are per space, unless on references only")
            if len(i.columns) == 1 and i.columns[0] in keys and not keys[i.columns[0]].nullable:
                raise SchemaError(f"{t.name}: a one-to-one reference must be nullable")
            free = [c for c in i.columns if own[c].nullable or own[c].type == "string" or (own[c].type == "uuid" and c not in keys)]
            if i.release not in free:
                raise SchemaError(f"{t.name}: an index needs a column that can give up its claim")


def topological(edges: list[ForeignKey]) -> list[str]:
    """Parents before children; tables of a cycle come last, by name."""
    waiting = {t: {e.parent for e in edges if e.table == t and e.parent != t} for e in edges for t in (e.table, e.parent)}
    out: list[str] = []
    while waiting:
        free = sorted(t for t, parents in waiting.items() if parents <= set(out)) or sorted(waiting)
        out += free
        waiting = {t: p for t, p in waiting.items() if t not in free}
    return out


def component(edges: list[ForeignKey], seeds: set[str]) -> set[str]:
    """Tables that references connect with the seeds: projection of the others cannot change (Q5)."""
    found = set(seeds)
    while more := {t for e in edges for t in (e.table, e.parent) if {e.table, e.parent} & found} - found:
        found |= more
    return found


def needs_projection(tables: list[Table], touched: dict[str, set[str]]) -> bool:
    """Whether any touched column is a reference or in a unique index (M3)."""
    for t in tables:
        keys = {k.column for k in t.foreign_keys} | {c for i in t.indexes for c in i.columns}
        if keys & touched.get(t.name, set()):
            return True
    return False


def signature(tables: list[Table]) -> str:
    lines = []
    for t in sorted(tables, key=lambda t: t.name):
        lines.append(f"table {t.name}")
        lines += [f"  {c.name}:{c.type}:{'null' if c.nullable else 'set'}" for c in sorted(t.columns, key=lambda c: c.name)]
        lines += [f"  {k.column}->{k.parent}:{k.on_delete}" for k in sorted(t.foreign_keys, key=lambda k: k.column)]
        lines += [f"  unique {','.join(i.columns)}" for i in sorted(t.indexes, key=lambda i: i.columns)]
    return "\n".join(lines)


def schema_hash(tables: list[Table]) -> str:
    """Two name-based UUIDs of the signature; equal on both sides or replication is refused."""
    text = signature(tables)
    return f"{uuid.uuid5(uuid.NAMESPACE_URL, text)}:{uuid.uuid5(uuid.NAMESPACE_OID, text)}"


def compatibility(own: SqlColumn | str, peer: SqlColumn) -> SqlColumn:
    """What a peer's hash says before a session (T9): ``unknown`` without one, else ``compatible`` or ``mismatch``."""
    mine = F.lit(own) if isinstance(own, str) else own
    return F.when(peer.isNull() | (peer == ""), "unknown").when(peer == mine, "compatible").otherwise("mismatch")


def require_peer(own: str, peer: str | None) -> None:
    """Raises SchemaMismatch unless a session's peer has the same hash; none at all is not accepted."""
    if peer != own:
        raise SchemaMismatch(f"received {peer!r}, expected {own!r}")


def reference_columns(edges: list[ForeignKey], table: str) -> set[str]:
    """Columns of a table that are references."""
    return {e.column for e in edges if e.table == table}


def may_affect_references(edges: list[ForeignKey], table: str, touched: set[str]) -> bool:
    """Whether a write may change what references show: it touches one, or the id that others name."""
    return bool(touched & reference_columns(edges, table)) or ("id" in touched and any(e.parent == table for e in edges))


def affects_references(edges: list[ForeignKey], table: SqlColumn, column: SqlColumn) -> SqlColumn:
    """``may_affect_references`` of each write of a log."""
    own = {(e.table, e.column) for e in edges} | {(e.parent, "id") for e in edges}
    return F.struct(table.alias("t"), column.alias("c")).isin(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c in sorted(own)])


def default_consumers(edges: list[ForeignKey]) -> set[str]:
    """Tables whose references may fall back on a default row."""
    return {e.table for e in edges if e.on_delete == "setDefault" and e.default is not None}


def direct_columns(tables: list[Table], name: str) -> set[str]:
    """Columns that no reference or unique index names: authored values go straight to them, without projection."""
    t = next(t for t in tables if t.name == name)
    return {c.name for c in t.columns} - {k.column for k in t.foreign_keys} - {c for i in t.indexes for c in i.columns}


def reconcile(registered: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a stored registry of (tbl, column, type) needs (Z9): insert, update or delete per column; equal ones are left out."""
    old, new = registered.withColumnRenamed("type", "_old"), wanted.withColumnRenamed("type", "_new")
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old") != F.col("_new"), "update")
    return old.join(new, ["tbl", "column"], "full").withColumn("change", change).where("change is not null").select(
        "tbl", "column", F.col("_old").alias("old_type"), F.col("_new").alias("new_type"), "change"
    )


def ambiguous(changes: DataFrame, live: DataFrame) -> DataFrame:
    """Tables where a column with live metadata goes or changes its type: refused, as nobody can tell a rename from a drop."""
    risky = changes.where("change in ('delete', 'update')").select("tbl", "column", "change")
    return risky.join(live.select("tbl", "column").distinct(), ["tbl", "column"], "left_semi")
