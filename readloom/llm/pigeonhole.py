"""Blocking by pigeonholes whose groups stay small, however many rows agree in a block."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Into how many parts the rows of a large group are dealt when it is marked.
SALT = 64


def refine(rows: DataFrame, key: list[str], item: str, split: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """The rows, those of groups (by ``key``) of more than ``limit`` replaced by ``split`` of them until no group is
    larger. ``split`` returns rows of the same columns under longer keys, so that whatever is close in a group is
    still together in one of the smaller ones; it has to leave groups of ``limit`` at most when keys can't grow.

    Groups are counted with partial sums, and each large key is there SALT times when its rows (told apart by ``item``) are
    marked, so no task meets a whole group. Large keys are at most a ``limit``-th of the rows. Keys must not be null.
    """
    columns, done = rows.columns, []
    while True:
        large = common.materialize(rows.groupBy(*key).count().where(F.col("count") > limit).select(*key), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        spread = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumn("_large", F.lit(True))
        marked = rows.withColumn("_salt", F.pmod(F.xxhash64(item, F.lit("salt")), F.lit(SALT)).cast("int")).join(spread, [*key, "_salt"], "left")
        done.append(marked.where("_large is null").select(*columns))
        rows = split(common.materialize(marked.where("_large").select(*columns), "split"))
