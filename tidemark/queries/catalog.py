"""The list that queries are entered in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Runner
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def enter(run: Runner) -> Runner:
        if name in ENTRIES:
            raise ValueError(f"query '{name}' entered twice")

        def configured(spark: SparkSession, folder: str) -> DataFrame:
            return run(configure(spark), folder)

        ENTRIES[name] = Entry(configured, sql)
        return run

    return enter
