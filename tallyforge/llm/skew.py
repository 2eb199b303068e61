"""Joining rows to one row of their group when a group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when its group holds more than one part in so many of all rows, so there are fewer hot keys than this.
HOT_SHARE = 1000
#: Rows that any group may bring to one task.
HOT_LEAST = 1000


def hot_keys(groups: DataFrame, key: str, size: str) -> dict[int, int]:
    """By hot key: the pieces that its rows are dealt to. Fewer than ``HOT_SHARE`` keys, whatever the input's size.

    ``key`` is a bigint of ``groups``, which has one row a group and the number of its rows in ``size``.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(total // HOT_SHARE, HOT_LEAST)
    found = groups.where(F.col(size) > least).groupBy(key).agg(F.sum(size).alias("n")).collect()
    return {r[0]: -(-r["n"] // least) for r in found}


def _pieces(key: str, hot: dict[int, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in hot.items() for x in kv]), F.col(key)), F.lit(1).cast("bigint"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, on: list[str], size: str, spread: Column, how: str = "left") -> DataFrame:
    """rows joined to groups on ``key`` (a bigint in both) and the columns ``on``; rows of hot keys are dealt by ``spread``.

    The few rows of hot groups are repeated for each piece, so no task gets more than a small share of one group.
    """
    hot = hot_keys(groups, key, size)
    if not hot:
        return rows.join(groups, [key, *on], how)
    dealt = rows.withColumn("_piece", F.pmod(F.xxhash64(spread), _pieces(key, hot)))
    copies = groups.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), _pieces(key, hot) - 1)))
    return dealt.join(copies, [key, "_piece", *on], how).drop("_piece")
