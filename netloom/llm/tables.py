"""Helpers over DataFrames, shared by the operators: free column names, and joins in which hot keys are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.plans.durable import durable

#: A key with more than this share of all rows is hot; there are at most 1 / HOT_SHARE of them, so they may be broadcast.
HOT_SHARE = 0.001


def col(name: str) -> Column:
    """The top-level column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: list[str]) -> list[Column]:
    return [col(n) for n in names]


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def joined_by(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``keyed`` by their non-null column ``key``, which is unique in ``keyed``.

    ``keyed[count]`` says how many of the rows have the key. Rows of hot keys meet them in a broadcast, so that none of
    them is shuffled; only the others are joined by a shuffle.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = durable(keyed.where(F.col(count) > HOT_SHARE * total))
    if not hot.limit(1).count():
        return rows.join(keyed.drop(count), key)
    few = F.broadcast(hot.drop(count))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col(count) <= HOT_SHARE * total).drop(count), key)
    return rows.join(few, key).unionByName(cold)
