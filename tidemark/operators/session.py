"""A session round between two stored states (T8): what each side lacks goes over, checkpoints advance. The transport is the caller's."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import require_peer
from ..sources.log import aligned
from ..sources.shared import staged
from . import merge, replicate
from .merge import ROW, State


@dataclass(frozen=True)
class Replica:
    """One side: the hash of its tables, its spaces (space), its state, and the newest clock received per space and node. A round reads
    the state several times, so it should be stored (``stored`` as what ``merge`` keeps)."""

    schema_hash: str
    spaces: DataFrame
    state: State
    received: DataFrame


def stored(table: DataFrame, name: str) -> DataFrame:
    """A table of a state, written to the shared folder."""
    return staged(table, f"session-{name}")


def known(side: Replica) -> DataFrame:
    """What a side has, as checkpoints (F11): the newest clock received or stored, per space and node."""
    rows, fields, generations = (t.select("space", "hlc") for t in (side.state.rows, side.state.fields, side.state.generations))
    return replicate.advanced(side.received, replicate.checkpoints_of(rows.unionByName(fields).unionByName(generations)))


def outgoing(state: State, confirmed: DataFrame, spaces: DataFrame) -> DataFrame:
    """The changes of a state that checkpoints do not cover, in the given spaces, as a log (T1, T2): births with the fields that still
    have their clock, other fields as updates, replicated generations. Checkpoints filter before anything is joined."""
    own = lambda rows: replicate.after_checkpoints(rows.join(spaces, "space", "left_semi"), confirmed)
    births = own(state.rows)
    clocks = state.rows.withColumnRenamed("hlc", "_born")
    at_birth = state.fields.join(births.withColumnRenamed("hlc", "_born"), ROW).where("hlc = _born")
    payload = at_birth.groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("payload"))  # as many as the table has columns
    inserts = births.join(payload, ROW, "left").withColumn("kind", F.lit("insert"))
    updates = own(state.fields).join(clocks, ROW).where("hlc <> _born").withColumn("kind", F.lit("update"))
    sent = replicate.pending(State(state.rows.limit(0), state.fields.limit(0), state.generations.join(spaces, "space", "left_semi")), confirmed)
    return aligned(inserts).unionByName(aligned(updates)).unionByName(aligned(sent))


def session_round(a: Replica, b: Replica, columns: dict[str, list[str]]) -> tuple[Replica, Replica]:
    """Both sides after one round: the hashes must be equal (T9), the spaces that both have are exchanged in both directions, and each
    side's checkpoints advance by what came (T13). A round that is broken off or repeated changes nothing else: merging is a
    maximum. Births are registers here, so the order of rounds does not matter."""
    require_peer(a.schema_hash, b.schema_hash)
    shared = a.spaces.select("space").join(b.spaces.select("space"), "space", "left_semi").distinct()
    shared = staged(shared, "session-spaces")
    to_b, to_a = (staged(outgoing(x.state, staged(known(y), "session-known"), shared), "session") for x, y in ((a, b), (b, a)))
    return _after(a, to_a, columns), _after(b, to_b, columns)


def _after(side: Replica, came: DataFrame, columns: dict[str, list[str]]) -> Replica:
    state = merge.merged(side.state, came, columns, with_later_inserts=True, keep=stored)
    return replace(side, state=state, received=staged(replicate.advanced(side.received, replicate.checkpoints_of(came)), "session-checkpoints"))
