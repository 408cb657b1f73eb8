"""Column names that don't clash."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *wanted: str) -> dict[str, str]:
    """For each wanted name itself, or with underscores appended while a column (in any case) has it."""
    used, out = {c.lower() for c in taken}, {}
    for name in wanted:
        own = name
        while own.lower() in used:
            own += "_"
        used.add(own.lower())
        out[name] = own
    return out
