"""Joins of rows with facts of their keys, of which some may belong to a great share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one HOT-th of all rows is hot: there are fewer than HOT of them, whatever the data.
HOT = 10_000


def with_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The rows whose key has facts, with the other columns of facts; null keys are equal.

    facts holds one row a key, with the number of its rows in the column ``count``; total is the number of all rows.
    Facts of hot keys, fewer than HOT, are broadcast to the rows where they lie; the others are joined by a shuffle in
    which no key holds more than one HOT-th of the rows.
    """
    facts = facts.withColumnRenamed(key, "__key")
    same = rows[key].eqNullSafe(F.col("__key"))
    hot, cold = facts.where(F.col(count) * HOT > total), facts.where(F.col(count) * HOT <= total)
    near = rows.join(F.broadcast(hot), same).drop("__key")
    far = rows.join(F.broadcast(hot.select("__key")), same, "left_anti").join(cold, same).drop("__key")
    return near.unionByName(far)
