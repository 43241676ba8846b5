"""As-of joins: for each row of one table, the row of the other that is nearest in time.

Both tables are put one above the other; a window over time carries the last (or next) row of the
right one to those of the left one. Windows end at the borders of time buckets, and what a
bucket passes on to later ones is a row for each key and bucket, so a key with most of the
rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROWS = 100_000  # of a bucket, on average


def bucket_width(left: DataFrame, right: DataFrame, on: str, rows: int = _ROWS) -> float:
    """The width of time buckets that have `rows` rows each on average."""
    t = left.select(F.col(on).cast("double").alias("t")).unionByName(right.select(F.col(on).cast("double").alias("t")))
    r = t.agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count("t").alias("n")).first()
    return max((r.z - r.a) / max(r.n / rows, 1), 1e-9) * 1.000001 if r.n else 1.0


def _one_way(left: DataFrame, right: DataFrame, by: list[str], on: str, width: float, later: bool) -> DataFrame:
    """left with a column `hit`: the last row of right at or before it, or the first at or after it."""
    names = [c for c in right.columns if c not in by]
    sign = -1 if later else 1
    side = lambda df, mine, hit: df.select(*by, F.col(on).alias("t"), (F.col(on).cast("double") * sign).alias("order"), F.lit(mine).alias("mine"), hit.alias("hit"), (F.struct(*[F.col(c) for c in df.columns]) if mine else F.lit(None)).alias("row"))
    theirs = side(right, False, F.struct(*[F.col(c) for c in names]))
    ours = side(left, True, F.lit(None))
    row_type = ours.schema["row"].dataType
    both = ours.withColumn("hit", F.lit(None).cast(theirs.schema["hit"].dataType)).unionByName(theirs.withColumn("row", F.lit(None).cast(row_type)))
    both = both.withColumn("bucket", F.floor(F.col("order") / width))
    # rows of the right table come first, so that equal times meet
    inside = Window.partitionBy(*by, "bucket").orderBy("order", F.col("mine"), "hit").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("hit", F.last("hit", ignorenulls=True).over(inside)).where("mine")
    ends = both.where("not mine").groupBy(*by, "bucket").agg(F.max_by("hit", F.struct("order", "hit")).alias("end"))
    buckets = both.select(*by, "bucket").distinct().join(ends, [*by, "bucket"], "left")
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("carry", F.last("end", ignorenulls=True).over(before)).drop("end")
    return here.join(carried, [*by, "bucket"], "left").select("row.*", F.coalesce("hit", "carry").alias("hit"))


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, direction: str = "backward", tolerance: float | None = None, width: float | None = None, suffix: str = "_right") -> DataFrame:
    """All rows of left with the columns of the right row of the same keys that is last at or before it (backward), first at or after it (forward), or nearest.

    `on` is a number in both tables. Without such a row, or beyond `tolerance`, the right columns are null. Of rows of equal time the largest counts (backward) or
    the largest (forward) by the remaining columns; nearest prefers the earlier. Left rows with a null key or time have no match.
    Right columns are named with the suffix; their keys are left out.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"no such direction: {direction}")
    names = [c for c in right.columns if c not in by]
    usable = right.where(" and ".join(f"`{c}` is not null" for c in [*by, on]))
    width = width or bucket_width(left, usable, on)
    back = lambda df: _one_way(df, usable, by, on, width, False)
    ahead = lambda df: _one_way(df, usable, by, on, width, True)
    own = [F.col(c) for c in left.columns]
    if direction == "nearest":
        first = back(left).select(*own, F.col("hit").alias("hit_before"))
        both = ahead(first).withColumnRenamed("hit", "hit_after")
        gap = lambda c: F.abs(F.col(f"{c}.{on}").cast("double") - F.col(on).cast("double"))
        take_after = F.coalesce(gap("hit_after") < gap("hit_before"), F.col("hit_before").isNull())
        found = both.select(*own, F.when(take_after, F.col("hit_after")).otherwise(F.col("hit_before")).alias("hit"))
    else:
        found = (ahead if direction == "forward" else back)(left)
    reach: Column = F.abs(F.col(f"hit.{on}").cast("double") - F.col(on).cast("double")) <= tolerance if tolerance is not None else F.lit(True)
    return found.select(*own, *[F.when(reach, F.col(f"hit.{c}")).alias(c + suffix) for c in names])
