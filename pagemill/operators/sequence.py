"""Operators over rows that have an order within a document or another key.

Every window is partitioned by ``keys``, so a plan that uses several of these on one key has one exchange for all of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _window(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys).orderBy(*order)


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """For each ``new: old``, the last non-null value of ``old`` so far."""
    so_far = _window(keys, order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({new: F.last(old, ignorenulls=True).over(so_far) for new, old in columns.items()})


def state_context(df: DataFrame, keys: Sequence[str], order: Sequence[str], setter: Column, transition: Column, moved: str, initial: str) -> DataFrame:
    """The state that each row finds: ``setter`` values set it for later rows and begin a segment; inside a segment the first row
    with ``transition`` moves the state to ``moved`` for later rows. A setter's own row finds the state it sets."""
    w = _window(keys, order)
    df = df.withColumn("_set", setter)
    df = df.withColumn("segment", F.sum(F.col("_set").isNotNull().cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    base = F.coalesce(F.last("_set", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(initial))
    before = _window([*keys, "segment"], order).rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.max((transition & F.col("_set").isNull()).cast("int")).over(before), F.lit(0)) == 1
    return df.withColumn("state", F.when(seen, F.lit(moved)).otherwise(base)).drop("_set")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, least: int = 2) -> DataFrame:
    """Runs of ``least`` or more consecutive rows with ``flag``: keys, first and last of ``order[0]``, n."""
    w = _window(keys, order)
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("_island", F.sum((~F.col("_flag")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.filter("_flag").groupBy(*keys, "_island")
    return runs.agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("_island")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """``df`` with ``before`` and ``after``, the values of ``column`` in the neighbouring rows."""
    w = _window(keys, order)
    return df.withColumns({"before": F.lag(column).over(w), "after": F.lead(column).over(w)})


def level_jumps(df: DataFrame, keys: Sequence[str], order: Sequence[str], level: str) -> DataFrame:
    """Rows whose level is more than one deeper than the row before."""
    return df.withColumn("previous", F.lag(level).over(_window(keys, order))).filter(F.col(level) > F.col("previous") + 1)


def continuity(df: DataFrame, keys: Sequence[str], order: Sequence[str], level: str, number: str, levels: int = 9) -> DataFrame:
    """``df`` with ``expected`` (the last part of the number) and ``continuous``, for numbers like [2, 1, 3] at level 3.

    The row before at the same level counts unless a shallower one came since. With the same parent the next number is one more;
    with another parent or none before, it is one. Rows without a number of the right depth are neither checked nor remembered."""
    w = _window(keys, order).rowsBetween(W.unboundedPreceding, -1)
    valid = F.col(number).isNotNull() & (F.size(number) == F.col(level))
    here = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    made = {}
    for n in range(1, levels + 1):
        at = valid & (F.col(level) == n)
        made[f"_n{n}"] = F.last(F.when(at, F.col(number)), ignorenulls=True).over(w)
        made[f"_at{n}"] = F.last(F.when(at, here), ignorenulls=True).over(w)
    df = df.withColumns(made)
    previous = F.lit(None)
    for n in range(levels, 0, -1):
        shallower = [F.col(f"_at{k}") for k in range(1, n)]
        fresh = F.lit(True)
        for s in shallower:
            fresh = fresh & (s.isNull() | (s < F.col(f"_at{n}")))
        previous = F.when(F.col(level) == n, F.when(fresh, F.col(f"_n{n}"))).otherwise(previous)
    df = df.withColumn("_previous", previous)
    head = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    same = F.col("_previous").isNotNull() & (head(F.col("_previous")) == head(F.col(number)))
    expected = F.when(same, F.element_at("_previous", -1) + 1).otherwise(1)
    last = F.element_at(F.col(number), -1)
    return df.withColumns({"expected": F.when(valid, expected), "continuous": F.when(valid, last == expected)}).drop(*made, "_previous")


def first_match(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """The first row of each key that meets ``condition``."""
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.filter(condition).groupBy(*keys).agg(row.alias("_row")).select("_row.*")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str], tokens: Column, most: int | None = None) -> DataFrame:
    """Distinct ``tokens`` (an array column) of each key by first appearance: keys, token, order, rank; the first ``most``."""
    exploded = df.select(*keys, *order, F.posexplode(tokens).alias("position", "token"))
    firsts = exploded.groupBy(*keys, "token").agg(F.min(F.struct(*order, "position")).alias("_at"))
    ranked = firsts.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("_at")))
    ranked = ranked if most is None else ranked.filter(F.col("rank") <= most)
    return ranked.select(*keys, "token", *[F.col(f"_at.{o}").alias(o) for o in order], F.col("rank").cast("long").alias("rank"))


def region(df: DataFrame, keys: Sequence[str], order: str, start: Column, stop: Column) -> DataFrame:
    """Rows after the first ``start`` row and before the first ``stop`` row that follows it."""
    whole = W.partitionBy(*keys)
    df = df.withColumn("_from", F.min(F.when(start, F.col(order))).over(whole))
    df = df.withColumn("_to", F.min(F.when(stop & (F.col(order) > F.col("_from")), F.col(order))).over(whole))
    return df.filter((F.col(order) > F.col("_from")) & (F.col("_to").isNull() | (F.col(order) < F.col("_to")))).drop("_from", "_to")


def consecutive(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Per key: n numbers in order of appearance kept as a sorted list, and whether they are 1 .. n."""
    listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(number)).alias("numbers"))
    n = F.size("numbers")
    wanted = F.when(n > 0, F.sequence(F.lit(1), n).cast("array<bigint>")).otherwise(F.array().cast("array<bigint>"))
    return listed.withColumn("consecutive", F.col("numbers").cast("array<bigint>") == wanted)


def mixed_modes(df: DataFrame, keys: Sequence[str], order: Sequence[str], mode: str) -> DataFrame:
    """The first row of each key whose rows have more than one mode."""
    firsts = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"), F.count_distinct(mode).alias("modes"))
    return firsts.filter("modes > 1").select("_row.*", "modes")
