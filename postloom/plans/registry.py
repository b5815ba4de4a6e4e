"""All registered queries: name → (build(tables), oracle SQL or None)."""

from __future__ import annotations

from postloom.plans import delivery, ingest, learning, streams, text

MODULES = [ingest, text, delivery, learning, streams]


def registered() -> dict:
    merged: dict = {}
    for module in MODULES:
        repeated = merged.keys() & module.QUERIES.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        merged.update(module.QUERIES)
    return merged
