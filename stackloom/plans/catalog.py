"""Every query of the profile library by name, with its SQL twin where it has one."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers ``f(spark, sf_dir)`` under ``name``."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    from stackloom.plans import address, aggregate, decode, history, stores, stream, timeline  # noqa: F401


load()
