"""Filters as Column expressions: validity in time, namespaces, metadata, text ids."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = ("tenant_id", "user_id", "session_id", "agent_id")


def valid_now(valid_to: Column) -> Column:
    """Open validity; looks at the end only."""
    return valid_to.isNull()


def valid_at(valid_from: Column, valid_to: Column, at: Column) -> Column:
    """``at`` within the half-open ``[valid_from, valid_to)``; a null end is open."""
    return (valid_from <= at) & (valid_to.isNull() | (at < valid_to))


def invalid(status: Column, valid_to: Column) -> Column:
    """Is a row closed, or invalid by its own status?"""
    return valid_to.isNotNull() | F.coalesce(status == "invalid", F.lit(False))


def namespace_filter(namespace: dict[str, str | None], prefix: str = "") -> Column:
    """Equality on the keys that are set; without any, everything passes."""
    cond = F.lit(True)
    for key in NAMESPACE:
        if namespace.get(key) is not None:
            cond = cond & (F.col(prefix + key) == namespace[key])
    return cond


def within_namespace(query: dict[str, Column], row: dict[str, Column]) -> Column:
    """Does the row lie in the namespace of the query? Keys null on the query's side match anything."""
    cond = F.lit(True)
    for key, q in query.items():
        cond = cond & (q.isNull() | (row[key] == q))
    return F.coalesce(cond, F.lit(False))


def metadata_filter(wanted: dict[str, Any]) -> Column:
    """Conjunction over columns: scalars by equality, a list holds where the array column has all of it, None is skipped."""
    cond = F.lit(True)
    for name, value in wanted.items():
        if value is None:
            continue
        if isinstance(value, (list, tuple)):
            cond = cond & (F.size(F.array_except(F.array(*map(F.lit, value)), F.col(name))) == 0)
        else:
            cond = cond & (F.col(name) == value)
    return F.coalesce(cond, F.lit(False))


def atom_filter(phase=None, type=None, status=None, vault_id=None, tag=None) -> Column:  # noqa: A002
    """Conjunction of the attributes that are given; ``tag`` must be among the tags."""
    cond = metadata_filter({"phase": phase, "type": type, "status": status, "vault_id": vault_id})
    return cond if tag is None else cond & F.coalesce(F.array_contains("tags", tag), F.lit(False))
