"""The list of runnable queries: name -> (function, what it covers, cross-check SQL)."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    run: Callable
    covers: tuple
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None):
    """Register a function under its own name; ``covers`` lists inventory rows."""

    def add(fn):
        if fn.__name__ in ENTRIES:
            raise ValueError(f"query {fn.__name__} defined twice")
        ENTRIES[fn.__name__] = Entry(fn, tuple(covers.split()), sql)
        return fn

    return add


def r(c, digits: int = 6) -> Column:
    """Round for comparison across engines; -0.0 becomes 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def r_signed(c: Column, digits: int = 6) -> Column:
    """Round as SQL's plain round() of a double does: the product with 10^digits is rounded, and a
    negative value that becomes zero is -0.0."""
    rounded = F.round(c * F.lit(10.0**digits), 0) / F.lit(10.0**digits)
    return F.when(rounded == 0, c * F.lit(0.0)).otherwise(rounded)


def load_all() -> dict[str, Entry]:
    from foretally.plans.queries import (contract_checks, feature_steps, forecasting, lookups, registry_audit,  # noqa: F401
                                         scans, scores, tests_of_skill)
    return ENTRIES
