"""Joins with keys that a large share of all rows have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_store import staged

MOST_KEYS = 200_000  # sent at most; a key takes the place of thousands of rows


MOST_BYTES = 64 << 20  # of a column of theirs that has no bound of its own


def crowded(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The keys that more than `limit` rows have."""
    return staged(rows.groupBy(*keys).count().where(F.col("count") > limit).select(*keys))


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], hot: DataFrame, wide: str | None = None) -> DataFrame:
    """Inner join of rows with facts (a row a key), where the facts of the hot keys are sent to the rows and all others meet theirs in a shuffle.

    hot: the keys that many rows have. There are no more of them than rows divided by that many; beyond MOST_KEYS,
    or MOST_BYTES of the column `wide`, all keys are shuffled, which the engine may split.
    """
    count = hot.count()
    if not 0 < count <= MOST_KEYS:
        return rows.join(facts, keys)
    sent = F.broadcast(hot)
    few = facts.join(sent, keys, "left_semi")
    if wide is not None and (few.agg(F.sum(F.octet_length(wide))).first()[0] or 0) > MOST_BYTES:
        return rows.join(facts, keys)
    here = rows.join(F.broadcast(few), keys)
    return here.unionByName(rows.join(sent, keys, "left_anti").join(facts, keys).select(here.columns))
