"""Composed jobs and the catalog of named queries."""

import importlib

_CATALOG = (
    "catalog_cleanse catalog_joins catalog_windows catalog_metrics catalog_features "
    "catalog_blend catalog_actions catalog_models catalog_sources catalog_streams"
).split()


def load_catalog() -> None:
    for name in _CATALOG:
        importlib.import_module(f"assaylake.plans.{name}")
