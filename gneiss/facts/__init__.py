"""Facts: flat tables of what source files contain, so that rules are predicates that Catalyst can push and prune.

LANGUAGES says how the files of a language become facts; a plugin adds a language by an entry of its own and rules registered for
its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

LANGUAGES: dict[str, Callable] = {}


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of which each is a file to parse, dealt by keys over all cores: short rows are few splits, or one, but much work.  The number of
    tasks grows with that of the rows."""
    return rows.repartition(max(4 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() // 5000), *keys)


def language(name: str):
    """Registers facts(files(path, text)) -> rows of facts.python.SCHEMA for a language."""

    def add(f):
        LANGUAGES[name] = f
        return f

    return add
