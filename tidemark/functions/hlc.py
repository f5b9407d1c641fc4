"""Hybrid logical clocks as ``struct<ms bigint, counter int, node string>``.

Spark compares structs field by field, so ``max``, ``max_by``, ``greatest``, ``<`` and ``orderBy`` on the struct are the
clock's total order: time, then counter, then node text. All functions take and give Columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The largest counter and the default bound of clock drift in ms.
MAX_COUNTER, MAX_DRIFT_MS = 0xFFFF, 3_600_000
TYPE = "struct<ms:bigint,counter:int,node:string>"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
#: Date or unix ms, counter in hex, node with an optional worker number (which is dropped).
_TEXT = rf"^(.+)-([0-9a-fA-F]{{1,8}})-({UUID})(?::\d+)?$"


def hlc(ms: Column, counter: Column, node: Column) -> Column:
    return F.struct(ms.cast("bigint").alias("ms"), counter.cast("int").alias("counter"), node.cast("string").alias("node"))


def zero(node: Column) -> Column:
    """The beginning of time."""
    return hlc(F.lit(0), F.lit(0), node)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def truncated_ms(ts: Column) -> Column:
    """Whole milliseconds, rounded down."""
    return F.floor(micros(ts) / 1000).cast("bigint")


def drift_ms(us: Column) -> Column:
    """A drift in microseconds as milliseconds, rounded up."""
    return F.ceil(us / 1000).cast("bigint")


def drift_text(us: Column) -> Column:
    """Milliseconds, with three decimals only where they are needed (X11)."""
    return F.when(us % 1000 == 0, F.concat((us / 1000).cast("bigint").cast("string"), F.lit("ms"))).otherwise(F.format_string("%.3fms", us / F.lit(1000.0)))


def parse(text: Column) -> Column:
    """``<ISO date or unix ms>-<hex counter>-<uuid[:worker]>``; null where the text is malformed."""
    when, counter, node = (F.regexp_extract(text, _TEXT, k) for k in (1, 2, 3))
    iso = F.try_to_timestamp(F.regexp_replace(when, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX]"))
    ms = F.when(when.rlike(r"^-?\d+$"), when.try_cast("bigint")).otherwise(F.unix_millis(iso))
    count = F.conv(F.when(counter != "", counter), 16, 10).cast("bigint")
    return F.when(text.rlike(_TEXT) & ms.isNotNull() & (count <= MAX_COUNTER), hlc(ms, count, F.lower(node)))


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def counter_text(counter: Column) -> Column:
    return F.lpad(F.hex(counter.cast("bigint")), 4, "0")


def to_text(clock: Column) -> Column:
    """ISO date, four upper-case hex digits, node."""
    return F.concat_ws("-", iso(clock["ms"]), counter_text(clock["counter"]), clock["node"])


def to_json(clock: Column) -> Column:
    """A JSON object of datetime, counter and node."""
    return F.to_json(F.struct(iso(clock["ms"]).alias("datetime"), counter_text(clock["counter"]).alias("counter"), clock["node"].alias("node")))


def from_json(text: Column) -> Column:
    read = F.from_json(text, "datetime string, counter string, node string")
    return parse(F.concat_ws("-", read["datetime"], read["counter"], read["node"]))


def latest(a: Column, b: Column) -> Column:
    """The later of two clocks; null loses."""
    return F.greatest(a, b)


def increment(clock: Column, wall_ms: Column, max_drift_ms: int = MAX_DRIFT_MS) -> Column:
    """``struct<hlc, error>`` of the next stamp (X6): ``localAhead`` where it is too far before the wall clock, ``overflow`` past the last counter."""
    ms = F.greatest(clock["ms"], wall_ms)
    counter = F.when(ms == clock["ms"], clock["counter"] + 1).otherwise(0)
    error = F.when(ms - wall_ms > max_drift_ms, "localAhead").when(counter > MAX_COUNTER, "overflow")
    return F.struct(F.when(error.isNull(), hlc(ms, counter, clock["node"])).alias("hlc"), error.alias("error"))


def _newer(clock: Column, remote: Column) -> Column:
    return (remote["ms"] > clock["ms"]) | ((remote["ms"] == clock["ms"]) & (remote["counter"] > clock["counter"]))


def merge(clock: Column, remote: Column, wall_ms: Column, max_drift_ms: int = MAX_DRIFT_MS) -> Column:
    """``struct<hlc, error>`` after seeing another node's clock (X7): an older one changes nothing; a newer one of one's own
    node is ``duplicateNode``, one too far ahead ``remoteAhead``; else its time and counter are taken over."""
    newer = _newer(clock, remote)
    error = F.when(newer & (clock["node"] == remote["node"]), "duplicateNode").when(newer & (remote["ms"] - wall_ms > max_drift_ms), "remoteAhead")
    taken = F.when(newer, hlc(remote["ms"], remote["counter"], clock["node"])).otherwise(clock)
    return F.struct(F.when(error.isNull(), taken).alias("hlc"), error.alias("error"))


def adopt_own(clock: Column, own: Column, wall_ms: Column, max_drift_ms: int = MAX_DRIFT_MS) -> Column:
    """``struct<hlc, error>`` after one's own stamp came back."""
    error = F.when(own["node"] != clock["node"], "foreignNode").when((own > clock) & (own["ms"] - wall_ms > max_drift_ms), "remoteAhead")
    return F.struct(F.when(error.isNull(), F.greatest(clock, own)).alias("hlc"), error.alias("error"))


def too_far_ahead(clock: Column, now_ms: Column, max_drift_ms: int = MAX_DRIFT_MS) -> Column:
    """Late data are never dropped, but stamps from the future are refused."""
    return clock["ms"] - now_ms > max_drift_ms


def stamped(writes: DataFrame, *, node: str, wall_ms: str, order: str | list[str], last: str | None = None, out: str = "hlc", bucket: int | None = None, max_drift_ms: int | None = None) -> DataFrame:
    """Stamps each node's writes in ``order`` as its clock would, one after another.

    The sequential rule (time never goes back; the counter goes up while the time stands still) in closed form: the
    time is the running maximum of the wall clock and the last stamp, the counter the position within its time. ``last``
    names a column with the node's last clock (null: none).

    Without ``bucket`` a node's writes are one window. With it (for one whole-number ``order`` column) they are windows of
    that many numbers each: maxima and counts of whole buckets run along the node first, so that a node with very many
    writes is many tasks' work.

    With ``max_drift_ms`` writes whose time would be further before their wall clock are refused, as are those past the last
    counter (X6): they have no stamp, are not counted, and a column ``error`` says why.
    """
    by = [order] if isinstance(order, str) else order
    start = F.col(f"{last}.ms") if last else F.lit(None).cast("bigint")
    after = F.when(F.col("_ms") == F.col(f"{last}.ms"), F.col(f"{last}.counter") + 1).otherwise(0) if last else F.lit(0)
    counted = F.lit(1) if max_drift_ms is None else F.when(F.col("_ms") - F.col(wall_ms) <= max_drift_ms, 1).otherwise(0)

    def with_stamp(rows: DataFrame, counter: Column) -> DataFrame:
        stamp = hlc(F.col("_ms"), counter, F.col(node))
        if max_drift_ms is None:
            return rows.withColumn(out, stamp).select(*writes.columns, out)
        error = F.when(F.col("_ms") - F.col(wall_ms) > max_drift_ms, "localAhead").when(F.col("_counter") > MAX_COUNTER, "overflow")
        rows = rows.withColumn("_counter", counter).withColumn("error", error).withColumn(out, F.when(F.col("error").isNull(), stamp))
        return rows.select(*writes.columns, out, "error")

    if bucket is None:
        so_far = F.max(wall_ms).over(W.partitionBy(node).orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow))
        timed = writes.withColumn("_ms", F.greatest(start, so_far))
        place = F.sum(counted).over(W.partitionBy(node, "_ms").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
        return with_stamp(timed, place + after)
    rows = writes.withColumn("_bucket", F.floor(F.col(by[0]) / bucket))
    earlier = W.partitionBy(node).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    tops = rows.groupBy(node, "_bucket").agg(F.max(wall_ms).alias("_top")).select(node, "_bucket", F.max("_top").over(earlier).alias("_before"))
    inside = F.max(wall_ms).over(W.partitionBy(node, "_bucket").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow))
    timed = rows.join(tops, [node, "_bucket"]).withColumn("_ms", F.greatest(start, F.col("_before"), inside))
    along = W.partitionBy(node, "_ms").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = timed.groupBy(node, "_ms", "_bucket").agg(F.sum(counted).alias("_n")).select(node, "_ms", "_bucket", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_passed"))
    place = F.sum(counted).over(W.partitionBy(node, "_ms", "_bucket").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    return with_stamp(timed.join(counts, [node, "_ms", "_bucket"]), F.col("_passed") + place + after)


def follows(clock: Column, before: Column) -> Column:
    """Whether a stamp was given right after another by the same node."""
    return (clock["node"] == before["node"]) & (clock["ms"] == before["ms"]) & (clock["counter"] == before["counter"] + 1)
