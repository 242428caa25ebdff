"""All registered queries of the protobuf engine."""

from . import edits, json_forms, relational  # noqa: F401  each module adds its own
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
