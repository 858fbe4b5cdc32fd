"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

DEAL = 1 << 20


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], rows: str, per_task: int = 200_000) -> DataFrame:
    """Left join with a table of one row per key, whose column ``rows`` tells about how many rows of ``left`` a key has.

    Keys of more than ``per_task`` rows are few (all rows over ``per_task``) and go to all tasks; the rows that have one
    are dealt out by their content in the second join, where they look for nothing. All other keys meet by a shuffle in
    which none fills a task. Columns of ``right`` are added; a null key finds nothing.
    """
    values = [c for c in right.columns if c not in keys]
    # The stored 0 stays a join key; a literal would be folded out of the shuffle.
    table = materialise(right.withColumn("_deal", F.lit(0)), "by-key")
    hot = table.filter(F.col(rows) > per_task).select(*keys, *(F.col(c).alias(f"_hot_{c}") for c in values), F.lit(True).alias("_hot"))
    cold = table.filter(F.col(rows) <= per_task)
    spread = F.when(F.col("_hot") | F.col(keys[0]).isNull(), F.pmod(F.xxhash64(*left.columns), F.lit(DEAL)).cast("int") + 1).otherwise(0)
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_deal", F.coalesce(spread, F.lit(0)))
    met = dealt.join(cold, [*keys, "_deal"], "left")
    return met.select(*left.columns, *(F.coalesce(f"_hot_{c}", c).alias(c) for c in values))
