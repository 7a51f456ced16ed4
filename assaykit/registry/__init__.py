"""All registered queries; importing a module of this package registers its queries."""

import importlib

MODULES = ("tables", "distance", "linear", "trees", "patterns", "runs")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"assaykit.registry.{name}")
