"""Spaces, members, grants and violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NotAMember, ReadOnlyMember
from ..functions import hlc as clocks

ROLES = ("readOnly", "readWrite")


def member_spaces(users: DataFrame, members: DataFrame) -> DataFrame:
    """(user, space): everyone's personal space, which is named like the user, and those they belong to."""
    return users.select("user", F.col("user").alias("space")).union(members.select("user", "space")).distinct()


def grants(users: DataFrame, members: DataFrame) -> DataFrame:
    """(user, space, role): one role per space; the personal space is always readWrite, whatever a membership row says."""
    personal = users.select("user", F.col("user").alias("space"), F.lit("readWrite").alias("role"), F.lit(0).alias("_rank"))
    shared = members.select("user", "space", "role", F.when(F.col("role") == "readWrite", 1).otherwise(2).alias("_rank"))
    first = personal.unionByName(shared).groupBy("user", "space").agg(F.min(F.struct("_rank", "role")).alias("best"))
    return first.select("user", "space", F.col("best.role").alias("role"))


def unauthorized(changes: DataFrame, granted: DataFrame) -> DataFrame:
    """Changes whose author may not write their space (T11): no role, or readOnly. ``changes`` has user and space."""
    return changes.join(granted.where("role = 'readWrite'").select("user", "space"), ["user", "space"], "left_anti")


def acting(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``outcome`` to requests (user, space) to act in a space (Z2): ``allowed`` in one's own and where the role is readWrite,
    ``notMember`` without a role, ``readOnly`` with another one. A user has one role per space, the best of what is stored."""
    role = members.groupBy("user", "space").agg(F.max(F.col("role") == "readWrite").alias("_writes"))
    joined = requests.join(role, ["user", "space"], "left")
    outcome = F.when((F.col("user") == F.col("space")) | F.col("_writes"), "allowed").when(F.col("_writes").isNull(), "notMember").otherwise("readOnly")
    return joined.withColumn("outcome", outcome).drop("_writes")


def require_acting(members: DataFrame, user: str, space: str) -> None:
    """Raises NotAMember or ReadOnlyMember where ``acting`` does not allow it."""
    request = members.sparkSession.createDataFrame([(user, space)], "user string, space string")
    outcome = acting(request, members).first()["outcome"]
    if outcome != "allowed":
        raise (NotAMember if outcome == "notMember" else ReadOnlyMember)(f"{user} in {space}")


def registered(stored: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """The registry of nodes after a batch (M12): what is stored, and each newly seen key once (``found`` tells which was known)."""
    fresh = seen.select(*key).distinct().join(stored.select(*key), key, "left_anti")
    return stored.select(*key, F.lit(True).alias("found")).unionByName(fresh.withColumn("found", F.lit(False)))


def pruned(local: DataFrame, granted: DataFrame) -> DataFrame:
    """What a follower's membership table needs (T10, T22): upsert granted, delete what is no longer granted, keep the rest."""
    old, new = local.withColumnRenamed("role", "_old"), granted.withColumnRenamed("role", "_new")
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull(), "insert").when(F.col("_old") != F.col("_new"), "update").otherwise("keep")
    return old.join(new, ["user", "space"], "full").select("user", "space", action.alias("action"), F.coalesce("_new", "_old").alias("role"))


def announced(last: DataFrame, events: DataFrame) -> DataFrame:
    """Grants (user, space, role, at; null role: revoked) that change what was ``last`` announced of their user and space, in order of
    ``at``, with the ``action`` that a follower takes: insert, update or delete (T10). What a stored grant repeats, or revokes
    where nothing is granted, is not announced."""
    line = W.partitionBy("user", "space").orderBy("at", "role")
    joined = events.join(last.select("user", "space", F.col("role").alias("_last")), ["user", "space"], "left")
    was = F.when(F.row_number().over(line) == 1, F.col("_last")).otherwise(F.lag("role").over(line))
    action = F.when(F.col("role").isNull(), "delete").when(F.col("_was").isNull(), "insert").otherwise("update")
    return joined.withColumn("_was", was).where(~F.col("role").eqNullSafe(F.col("_was"))).select("user", "space", "role", "at", action.alias("action"))


def granted_all(members: DataFrame, users: DataFrame, spaces: DataFrame, space: str, role: str) -> DataFrame:
    """Membership after granting a role to all users in a space (T23); an unknown space is an error."""
    if role not in ROLES:
        raise ValueError(f"unknown role {role}")
    if spaces.where(F.col("space") == space).isEmpty():
        raise LookupError(f"no space {space}")
    fresh = users.select("user", F.lit(space).alias("space"), F.lit(role).alias("role"))
    return members.join(fresh.select("user", "space"), ["user", "space"], "left_anti").select("user", "space", "role").unionByName(fresh)


def violations(events: DataFrame, key: list[str]) -> DataFrame:
    """Violations rolled up by key, whose parts may be null (A9): first and last time, newest clock, count."""
    return events.groupBy(*key).agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.max("hlc").alias("hlc"), F.count("*").alias("occurrences"))


def merged_violations(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Two roll-ups of the same key as one."""
    return stored.unionByName(fresh).groupBy(*key).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("hlc").alias("hlc"), F.sum("occurrences").alias("occurrences")
    )


def assigned_nodes(spaces: DataFrame, stored: DataFrame, *, shared_node: str | None = None) -> DataFrame:
    """(space, node, last): one node for all spaces of a device, or one per space (T21). A space starts at the newest stamp it has stored."""
    node = F.lit(shared_node) if shared_node else F.concat(F.lit("node-"), F.col("space"))
    named = spaces.select("space", node.alias("node"))
    last = stored.groupBy("space").agg(F.max("hlc").alias("last"))
    joined = named.join(last, "space", "left")
    own = F.struct(F.col("last.ms").alias("ms"), F.col("last.counter").alias("counter"), F.col("node").alias("node"))
    start = F.when(F.col("last").isNull(), clocks.zero(F.col("node"))).otherwise(own)
    if shared_node:  # a shared clock is as new as the newest of its spaces
        start = F.max(start).over(W.partitionBy("node"))
    return joined.select("space", "node", start.alias("last"))
