"""Dimension names: ensemble, time, functional group, cohort, depth, latitude, longitude."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from .errors import TransposeError

CANONICAL = ("E", "T", "F", "C", "Z", "Y", "X")
VALUE = "value"


def canonical_order(dims: Iterable[str]) -> tuple[str, ...]:
    """Canonical dimensions in canonical order, then the others as they come."""
    dims = tuple(dict.fromkeys(dims))
    return tuple(d for d in CANONICAL if d in dims) + tuple(d for d in dims if d not in CANONICAL)


def broadcast_dims(inputs: Iterable[Iterable[str]], core: Iterable[str]) -> tuple[str, ...]:
    """The key columns of a projection: all inputs' canonical dimensions but core ones."""
    core = set(core)
    return canonical_order(d for dims in inputs for d in dims if d in CANONICAL and d not in core)


def rename_dims(df: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    """Apply a dimension mapping to the key columns that are there."""
    return df.withColumnsRenamed({a: b for a, b in (mapping or {}).items() if a in df.columns})


def transpose(df: DataFrame, order: Iterable[str] | None = None) -> DataFrame:
    """Key columns in canonical order (or the one given), other columns after them. Only the column order changes."""
    keys = [c for c in df.columns if c != VALUE]
    want = list(order) if order is not None else list(canonical_order(keys))
    if missing := [d for d in want if d not in keys]:
        raise TransposeError(f"no dimension {', '.join(missing)} among {', '.join(keys)}")
    rest = [c for c in df.columns if c not in want]
    return df.select(*want, *rest)
