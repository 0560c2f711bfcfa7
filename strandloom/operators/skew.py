"""Joins that stay balanced when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys: a proven broadcast bound.
HOT_SHARE = 1000


def join_to_unique(rows: DataFrame, unique: DataFrame, key: str, count_col: str, total_rows: int) -> DataFrame:
    """Inner join of ``rows`` with ``unique`` (one row per key; ``count_col`` is how many of ``rows`` it has).

    Hot keys, of which there are fewer than HOT_SHARE, are broadcast, so their rows are never shuffled to one task; the
    rest goes through an ordinary join. ``count_col`` is dropped.
    """
    limit = max(1, total_rows // HOT_SHARE)
    hot = unique.where(F.col(count_col) > limit).drop(count_col)
    rest = unique.where(F.col(count_col) <= limit).drop(count_col)
    hot_keys = [r[0] for r in hot.select(key).limit(HOT_SHARE + 1).collect()]
    if not hot_keys:
        return rows.join(rest, key)
    is_hot = F.col(key).isin(hot_keys)
    return rows.where(is_hot).join(F.broadcast(hot), key).unionByName(rows.where(~is_hot).join(rest, key))
