"""Registered queries, each beside the SQL that checks it."""

from importlib import import_module

from confab.plans import registry

MODULES = ("text", "privacy", "search", "temporal", "insights", "sequence", "catalog", "voice", "grounding", "export", "streams")


def load():
    """Import every plan module and return (queries, check SQL)."""
    for name in MODULES:
        import_module(f"confab.plans.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
