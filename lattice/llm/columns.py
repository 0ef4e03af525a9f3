"""Helper columns beside a user's own ones."""

from __future__ import annotations

from collections.abc import Iterable


def spare(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until no column has it; Spark ignores case, so this does too."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
