"""Names of columns beside those that a table has."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], n: int) -> list[str]:
    """n names that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    names = (f"inner_{i}" for i in range(n + len(taken)))
    return [name for name in names if name not in taken][:n]
