"""Names of helper columns that no input column has."""

from __future__ import annotations


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until no column has it; Spark
    does not tell upper from lower case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
