"""Names for columns that a plan adds for itself."""

from __future__ import annotations

from collections.abc import Iterable


def own_names(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to clash with none of the columns, case ignored."""
    taken = [c.lower() for c in columns]
    mark = "_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + n for n in names]
