"""Registered queries and the physical-plan helpers they share."""

from importlib import import_module

MODULES = ("apps", "decision", "lineage", "codependence", "perturbation", "comparison", "generation", "tracked", "scalar_queries")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"whence.plans.{name}")
