"""What the modules of registered queries share: the registry and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from seismark.plans.context import Context

#: The small shift keeps halves from rounding one way here and the other there.
R = "round({} + 3e-10, 6) + 0e0 AS {}"
OHLC = ("open", "high", "low", "close")
K = "symbol, dt"
#: Query and SQL, if any, by name.
REGISTRY: dict[str, tuple[Callable[[Context], DataFrame], str | None]] = {}


def _r(*names: str, **named: str) -> str:
    return ", ".join([R.format(n, n) for n in names] + [R.format(v, k) for k, v in named.items()])


def _b(*names: str, **named: str) -> str:
    return ", ".join([f"{n}::BIGINT AS {n}" for n in names] + [f"({v})::BIGINT AS {k}" for k, v in named.items()])


def _add(name: str, make: Callable[[Context], DataFrame], sql: str | None = None) -> None:
    REGISTRY[name] = (make, sql)
