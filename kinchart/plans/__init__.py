"""Named query plans."""

from importlib import import_module

MODULES = ("record_queries", "family_queries", "insight_queries", "risk_queries", "text_queries", "maintain_queries")


def load():
    """All registered queries by name."""
    for module in MODULES:
        import_module(f"kinchart.plans.{module}")
    from kinchart.plans.registry import QUERIES

    return QUERIES
