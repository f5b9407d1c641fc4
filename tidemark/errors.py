"""What callers of the library may catch."""

from __future__ import annotations


class ReplicationError(Exception):
    """Any refusal of this library."""


class SchemaMismatch(ReplicationError):
    """The two sides replicate different tables."""


class NotAMember(ReplicationError):
    """A user acts in a space they do not belong to."""


class ReadOnlyMember(ReplicationError):
    """A member writes a space in which they may only read."""


class ForeignSpace(ReplicationError):
    """A write names another space than the acting one."""
