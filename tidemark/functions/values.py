"""Scalar helpers of merging and projection."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Visibilities in storage order (rows are hidden after the third), suffixes that only projection may
#: write, and the name space of synthetic ids.
VISIBILITY = ("userInsert", "userReinsert", "foreignKeyRestrictRestore", "userDelete", "userCascadeDelete", "foreignKeyCascade")
LAST_VISIBLE = 2
OID = uuid.NAMESPACE_OID
RESERVED_SUFFIX = r"__(conflict|hidden|park)__[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: How errors are reported to the other side; those of clock drift may pass with time.
FAILURES = {
    "remoteAhead": "clockDrift", "localAhead": "serverClockDrift", "overflow": "hlcOverflow", "duplicateNode": "duplicateNode",
    "ownershipCollision": "integrityViolation", "unauthorizedWrite": "integrityViolation", "missingDomainRow": "integrityViolation",
}
PERMANENT = ("duplicateNode", "integrityViolation")


def is_deleted(flag: Column) -> Column:
    """Even generations are deleted, odd ones visible."""
    return F.pmod(flag, F.lit(2)) == 0


def is_synced(reason: Column) -> Column:
    """Only what a user did replicates; what projection did is derived anew (F16)."""
    return F.coalesce(reason.startswith("user"), F.lit(False))


def is_hidden(visibility: Column) -> Column:
    return visibility > LAST_VISIBLE


def next_flag(flag: Column, visible: Column) -> Column:
    """The next generation with the wanted parity."""
    one = F.coalesce(flag, F.lit(1)) + 1
    return one + F.when(is_deleted(one) == visible, 1).otherwise(0)


def visibility(reason: Column, deleted: Column) -> Column:
    """The stored visibility of a user's generation."""
    hidden = F.when(reason == "userCascadeDelete", 4).otherwise(3)
    shown = F.when(reason == "userReinsert", 1).otherwise(0)
    return F.when(deleted, hidden).otherwise(shown).cast("int")


def uuid5(name: Column, namespace: uuid.UUID = OID) -> Column:
    """A version 5 UUID of UTF-8 text, by built-in SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def conflict_free(kind: str, value: Column, row_id: Column, column: str, suffix: str = "conflict") -> Column:
    """The value that releases a unique claim (X14): null, a marked text, or a synthetic id of version 8."""
    if kind == "text":
        return F.concat(value, F.lit(f"__{suffix}__"), row_id)
    if kind == "uuid":
        made = uuid5(F.concat(F.lit(f"{column}:"), value, F.lit(f"__{suffix}__"), row_id))
        return F.concat(F.substring(made, 1, 14), F.lit("8"), F.substring(made, 16, 21))
    return F.lit(None).cast("string")


def release_kind(nullable: bool, data_type: str, foreign_key: bool) -> str | None:
    """How a column can give up a claim: nullable ones by null, text by a suffix, free UUIDs by a synthetic id."""
    if data_type == "json":
        return None
    return "null" if nullable else "text" if data_type == "string" else "uuid" if data_type == "uuid" and not foreign_key else None


def release(nullable: Column, data_type: Column, foreign_key: Column) -> Column:
    """``release_kind`` of described columns."""
    free = F.when(nullable, "null").when(data_type == "string", "text").when((data_type == "uuid") & ~foreign_key, "uuid")
    return F.when(data_type != "json", free)


def is_reserved(value: Column, kind: str = "text") -> Column:
    """Authored values that only projection may write."""
    found = value.rlike(RESERVED_SUFFIX) if kind == "text" else F.substring(value, 15, 1) == "8"
    return F.coalesce(found, F.lit(False))


def same_value(a: Column, b: Column) -> Column:
    """Null equals null only."""
    return a.eqNullSafe(b)


def try_uuid(text: Column) -> Column:
    """Canonical lower-case UUID, or null."""
    plain = F.lower(F.trim(text))
    return F.when(plain.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), plain)


def uuid_of_bytes(data: Column) -> Column:
    """The UUID of 16 bytes, or null."""
    h = F.lower(F.hex(data))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.octet_length(data) == 16, F.concat_ws("-", *parts))


def default_value(text: Column, data_type: str) -> Column:
    """The value of a declared column default (X21): without its quotes; a UUID that is made anew each time is none, and so is a broken one."""
    plain = F.replace(text, F.lit("'"), F.lit(""))
    return plain if data_type != "uuid" else F.when(~plain.isin("random", "random_v7"), try_uuid(plain))


def same_map(a: Column, b: Column) -> Column:
    """Whether two maps hold the same entries, in whatever order (X17); null equals null only."""
    entries = lambda m: F.array_sort(F.map_entries(m))
    return entries(a).eqNullSafe(entries(b))


def canonical(value: Column, data_type: str = "string") -> Column:
    """The text by which projection compares a value (X16): null is empty, a UUID lower-case."""
    text = value.cast("string")
    return F.coalesce(F.lower(text) if data_type == "uuid" else text, F.lit(""))


def utf16_length(text: Column) -> Column:
    """UTF-16 code units, the measure of payloads."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("bigint")


def claim_key(*columns: Column) -> Column:
    """A tuple of dynamic values as one text; null where any is null, as that claims nothing."""
    every = columns[0].isNotNull()
    for c in columns[1:]:
        every = every & c.isNotNull()
    return F.when(every, F.concat_ws("\x1f", *[c.cast("string") for c in columns]))


def clamped(local: Column, peer: Column, floor: int, most: int) -> Column:
    """The slower of two wished intervals, within bounds."""
    wish = F.greatest(F.coalesce(local, F.lit(floor)), F.coalesce(peer, F.lit(floor)))
    return F.least(F.greatest(wish, F.lit(floor)), F.lit(most))


def failure_code(error: Column) -> Column:
    """What the other side is told."""
    out = F.lit("unknown")
    for kind, code in FAILURES.items():
        out = F.when(error == kind, code).otherwise(out)
    return out


def is_permanent(code: Column) -> Column:
    return code.isin(*PERMANENT)


def app_id(text: Column) -> Column:
    """A positive number, given as such or as text."""
    number = F.trim(text.cast("string")).try_cast("bigint")
    return F.when(number > 0, number)
