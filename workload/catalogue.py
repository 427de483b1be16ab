"""Loads every module that registers queries."""

from importlib import import_module

MODULES = ["folding", "scalars", "configuration", "mirroring", "checking", "payloads", "judging", "registered", "streams", "lookups"]


def load() -> None:
    for name in MODULES:
        import_module(f"workload.{name}")


load()
