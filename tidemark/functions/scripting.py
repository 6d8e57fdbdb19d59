"""User functions: computed columns, row filters and file names, given as SQL or as Python callables.

A function is text: a generator (`make://identifier`, `make://timestamp`), `python:module:name`, or a SQL
expression over the columns. A Python callable takes a pandas DataFrame of the rows and returns a Series, batch by batch.
SQL stays inside the JVM and is what to use where it suffices.
"""

from __future__ import annotations

import importlib
import logging
import os
import signal
import socket
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.types import MARK, Kind
from tidemark.functions.values import GENERATORS, parse_text

PYTHON = "python:"
#: Seconds that a Python function may take for a batch of rows.
TIME_LIMIT = 60.0


def load(name: str) -> Callable[[pd.DataFrame], pd.Series]:
    """The function; its module is loaded anew when its file has changed, as a worker lives on from task to task."""
    module, _, function = name.removeprefix(PYTHON).partition(":")
    found = importlib.import_module(module)
    path = getattr(found, "__file__", None)
    changed = os.stat(path).st_mtime_ns if path and os.path.exists(path) else None
    if _LOADED.setdefault(module, changed) != changed:
        found, _LOADED[module] = importlib.reload(found), changed
    return getattr(found, function)


_LOADED: dict[str, int | None] = {}


def limited(call: Callable[[], Any], seconds: float) -> Any:
    """The call's result, or TimeoutError if it takes longer. In a worker's main thread; elsewhere there is no limit."""
    if threading.current_thread() is not threading.main_thread():
        return call()

    def stop(*_: Any) -> None:
        raise TimeoutError(f"a function took more than {seconds} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return call()
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def expression(df: DataFrame, code: str, kind: Kind) -> Column:
    """The function's value for each row of df, as a column of the declared type; null where it can't be one."""
    if code in GENERATORS:
        return GENERATORS[code][0]().cast(kind.spark)
    if code.startswith(PYTHON):
        names = df.columns

        @F.pandas_udf(kind.spark)
        def call(rows: pd.DataFrame) -> pd.Series:
            return limited(lambda: load(code)(rows.set_axis(names, axis=1)), TIME_LIMIT)

        return call(F.struct(*(F.col(f"`{c}`") for c in names)))
    value = F.expr(code)
    found = df.select(value.alias("v")).schema["v"].dataType
    if found == kind.spark:
        return value
    return parse_text(value, kind) if found.typeName() == "string" else value.try_cast(kind.spark)


@dataclass(frozen=True)
class Computed:
    """A computed column: its name, its type and the function."""

    name: str
    kind: Kind
    code: str

    def column(self, df: DataFrame) -> Column:
        metadata = {MARK: Kind.JSON.name} if self.kind is Kind.JSON else {}
        return expression(df, self.code, self.kind).alias(self.name, metadata=metadata)


def keep(df: DataFrame, code: str | None) -> DataFrame:
    """Rows for which the filter is true; false, null and failures to be a truth value drop the row."""
    return df.where(expression(df, code, Kind.BOOL)) if code else df


class Stats:
    """Counts and values observed while a frame is written, without another pass."""

    def __init__(self, name: str):
        self.observation = Observation(name)

    def watch(self, df: DataFrame, **metrics: Column) -> DataFrame:
        return df.observe(self.observation, *(m.alias(n) for n, m in metrics.items()))

    def get(self) -> dict:
        return self.observation.get


def log(level: str, message: str) -> None:
    logging.getLogger("tidemark").log(logging.getLevelName(level.upper()), message)


def hardware_address() -> str:
    node = f"{uuid.getnode():012x}"
    return ":".join(node[i : i + 2] for i in range(0, 12, 2))


def address_of(host: str) -> str:
    return socket.gethostbyname(host.partition(":")[0])
