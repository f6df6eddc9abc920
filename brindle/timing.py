"""Seconds of a query, split into loading (views, analysis), planning and execution."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

PHASES = ("load", "plan", "execute")


def once(query: Callable[[], DataFrame]) -> dict[str, float]:
    began = time.perf_counter()
    df = query()
    loaded = time.perf_counter()
    df._jdf.queryExecution().executedPlan()
    planned = time.perf_counter()
    # the plan that is at hand is run, to its end, without its rows leaving the executors
    df._jdf.queryExecution().toRdd().count()
    ended = time.perf_counter()
    return {"load": loaded - began, "plan": planned - loaded, "execute": ended - planned, "total": ended - began}


def measure(query: Callable[[], DataFrame], warmup: int = 1, repeat: int = 5) -> list[dict[str, float]]:
    """`repeat` measured runs after `warmup` others."""
    for _ in range(warmup):
        once(query)
    return [once(query) for _ in range(repeat)]
