"""Named queries over the test tables, each with the SQL that must give the same rows."""

from importlib import import_module

from placeloom.plans.registry import ORACLES, QUERIES

FAMILIES = ["spatial", "cleaning", "articles", "sources", "evaluation"]


def load():
    """All queries and their SQL."""
    for family in FAMILIES:
        import_module(f"placeloom.plans.{family}")
    return QUERIES, ORACLES
