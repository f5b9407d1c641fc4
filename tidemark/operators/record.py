"""Local writes as stamped changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ForeignSpace
from ..functions import hlc as clocks
from ..functions import values

KEY = ["space", "tbl", "row_id"]


#: Writes are numbered in stretches of so many, by their first order column, where they are stamped.
BUCKET = 4096


def inserts(rows: DataFrame, columns: list[str], *, node: str = "node", wall_ms: str = "wall_ms", order: str = "seq", last: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """One insert change per row, one stamp each (R1, S13). ``order`` is a whole number; a node with very many writes is many tasks' work."""
    payload = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))
    made = clocks.stamped(rows, node=node, wall_ms=wall_ms, order=order, last=last, bucket=bucket)
    return made.select(*KEY, F.lit("insert").alias("kind"), payload.alias("payload"), "hlc")


def updates(rows: DataFrame, columns: list[str], *, node: str = "node", wall_ms: str = "wall_ms", order: str = "seq", last: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """One update change per row and column, stamped row by row in column order (R2). A full-row update names all columns and stamps
    each, changed or not."""
    fields = F.array(*[F.struct(F.lit(i).alias("_at"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    spread = rows.select(*KEY, node, wall_ms, order, *([last] if last else []), F.inline(fields))
    made = clocks.stamped(spread, node=node, wall_ms=wall_ms, order=[order, "_at"], last=last, bucket=bucket)
    return made.select(*KEY, F.lit("update").alias("kind"), "column", "value", "hlc")


def deletes(roots: DataFrame, cascade: DataFrame, generations: DataFrame, *, node: str = "node", wall_ms: str = "wall_ms", last: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """Soft deletes (R3, R5, S16): the rows themselves first, then the rows that cascading references take along; each gets its
    next even generation. ``roots`` and ``cascade`` have the row key, node, wall_ms and seq."""
    first = roots.withColumns({"_step": F.lit(0), "reason": F.lit("userDelete")})
    then = cascade.join(roots.select(*KEY), KEY, "left_anti").withColumns({"_step": F.lit(1), "reason": F.lit("userCascadeDelete")})
    both = first.unionByName(then).join(generations.select(*KEY, "cl_flag"), KEY, "left")
    live = both.where(F.col("cl_flag").isNull() | ~values.is_deleted(F.col("cl_flag")))
    # the cascade's numbers lie behind those of the rows themselves
    beyond = roots.agg((F.max("seq") + 1).alias("_beyond"))
    least = cascade.agg(F.min("seq").alias("_least"))
    numbered = live.join(F.broadcast(beyond.join(F.broadcast(least)))).withColumn("_seq", F.when(F.col("_step") == 0, F.col("seq")).otherwise(F.col("_beyond") + F.col("seq") - F.col("_least")))
    made = clocks.stamped(numbered, node=node, wall_ms=wall_ms, order=["_seq", *KEY], last=last, bucket=bucket)
    return made.select(*KEY, F.lit("delete").alias("kind"), values.next_flag(F.col("cl_flag"), F.lit(False)).cast("int").alias("cl_flag"), "reason", "hlc")


def reinserts(rows: DataFrame, generations: DataFrame) -> DataFrame:
    """Inserts of ids that are deleted (S17, R6): the row is written anew and gets the next odd generation, ``userReinsert``."""
    gone = generations.where(values.is_deleted(F.col("cl_flag"))).select(*KEY, "cl_flag")
    return rows.join(gone, KEY).withColumns({"cl_flag": values.next_flag(F.col("cl_flag"), F.lit(True)).cast("int"), "reason": F.lit("userReinsert")})


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """Ids given twice in one call, which callers refuse."""
    return rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def upserted(stored: DataFrame, incoming: DataFrame, *, keys: list[str], update: list[str], where: Column | None = None) -> DataFrame:
    """Rows after an upsert (S14, R9): stored rows with a match on ``keys`` take the ``update`` columns (where the condition on
    ``stored`` and ``new_`` columns holds), incoming rows without one are inserted. ``op`` tells which."""
    new = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in incoming.columns if c not in keys], F.lit(True).alias("_new"))
    old = stored.withColumn("_old", F.lit(True))
    joined = old.join(new, keys, "full")
    matched = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    write = matched if where is None else matched & F.coalesce(where, F.lit(False))
    out = []
    for c in stored.columns:
        if c in keys:
            out.append(F.col(c))
        else:
            taken = F.col(f"new_{c}") if c in incoming.columns else F.lit(None)
            value = F.when(F.col("_old").isNull(), taken)
            out.append((value.when(write, taken) if c in update else value).otherwise(F.col(c)).alias(c))
    op = F.when(F.col("_old").isNull(), "insert").when(write, "update").otherwise("keep")
    return joined.select(*out, op.alias("op"))


def upsert_inputs(stored: DataFrame, incoming: DataFrame, conflict: list[str], *, order: str, row_id: str = "row_id", defaults: dict[str, Column] | None = None) -> DataFrame:
    """The inputs that an upsert's stored rows answer to (R9, R11), with the stored row's id: of inputs with one conflict key the
    first by ``order``. References left null take their default first; a key with a null claims nothing and matches none."""
    filled = incoming.withColumns({c: F.coalesce(F.col(c), d) for c, d in (defaults or {}).items()})
    whole = filled.where(" and ".join(f"`{c}` is not null" for c in conflict))
    others = [c for c in filled.columns if c not in (*conflict, order, row_id)]
    first = whole.groupBy(*conflict).agg(F.min_by(F.struct(*others, order), order).alias("_input"))
    return stored.select(row_id, *conflict).join(first, conflict).select(row_id, *conflict, "_input.*")


def authored_overlays(inputs: DataFrame, given: dict[str, Column], row_id: str = "row_id") -> DataFrame:
    """(row_id, column, value) of the fields that an upsert's caller gave (R9, R10): a null counts where it was given (``given`` tells of
    each column whether it was)."""
    fields = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.coalesce(g, F.lit(False)).alias("_given")) for c, g in given.items()])
    return inputs.select(row_id, F.inline(fields)).where("_given").drop("_given")


def null_groups(rows: DataFrame, nulls: Column, *, order: str, by: str) -> DataFrame:
    """Adds ``grp`` (S19): consecutive rows of a call whose sets of explicit nulls are equal are written as one group."""
    line = W.partitionBy(by).orderBy(order)
    marked = rows.withColumn("_nulls", F.array_sort(nulls))
    starts = F.when(F.col("_nulls").eqNullSafe(F.lag("_nulls").over(line)), 0).otherwise(1)
    return marked.withColumn("_starts", starts).withColumn("grp", F.sum("_starts").over(line)).drop("_nulls", "_starts")


def grouped_updates(writes: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """Rows that are to get the same values, as one statement each (S18): the values, how many rows, and the first and last id."""
    return writes.groupBy(*columns).agg(F.count("*").alias("rows"), F.min(row_id).alias("first"), F.max(row_id).alias("last"))


def applied(stored: DataFrame, writes: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """``stored`` after a bulk update (S18): one join, whatever values the rows get; a null is written like any other value."""
    new = writes.select(row_id, F.struct(*columns).alias("_new"))
    taken = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns]
    return stored.join(new, row_id, "left").select(*taken)


def first_by(rows: DataFrame, order_by: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows that an ordered, limited update writes (O7): a top-k plan, no global sort of what is not taken."""
    return rows.orderBy(*order_by).limit(limit + offset).withColumn("_n", F.row_number().over(W.orderBy(*order_by))).where(F.col("_n") > offset).drop("_n")


def sanitised(rows: DataFrame, known: list[str], uuids: list[str] = ()) -> DataFrame:
    """Known columns only, without id and tenancy; UUID columns in canonical form."""
    kept = [c for c in rows.columns if c in known and c not in ("id", "space_id")]
    return rows.select(*[values.try_uuid(F.col(c)).alias(c) if c in uuids else F.col(c) for c in kept])


def foreign_writes(rows: DataFrame, acting_space: str, space: str = "space") -> DataFrame:
    """Writes that name another space than the acting one (F18), which callers refuse."""
    return rows.where(F.col(space) != acting_space)


def require_own_space(rows: DataFrame, acting_space: str, space: str = "space") -> None:
    """Raises ForeignSpace where ``foreign_writes`` finds one."""
    if not foreign_writes(rows, acting_space, space).isEmpty():
        raise ForeignSpace(f"a write names another space than {acting_space}")


def with_default(fk: Column, default: Column, given: Column) -> Column:
    """A reference left out of an insert takes its default; an explicit null stays."""
    return F.when(given, fk).otherwise(F.coalesce(fk, default))
