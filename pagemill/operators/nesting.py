"""Brackets in sequences: what begins and ends, how deep it nests, and what lies inside, with windows only.

Rows of one key form a sequence. A row may open a level or close one; a closing row with nothing open closes nothing, and what is never
closed has no end. Depths are running sums, held at zero from below. Of one level, opening and closing rows alternate, so a row's
partner is its neighbour among the rows of that level. All windows of a call share one exchange by the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_levels(rows: DataFrame, keys: Sequence[str], order: str, begin: Column, end: Column, name: str = "level") -> DataFrame:
    """``rows`` with ``name``: the level that a row opens or closes, and of other rows the depth they lie at (0: in nothing).

    A closing row that closes nothing has null."""
    so_far = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    begin, end = F.coalesce(begin, F.lit(False)), F.coalesce(end, F.lit(False))
    out = rows.withColumn("_step", F.when(begin, 1).when(end, -1).otherwise(0)).withColumn("_sum", F.sum("_step").over(so_far))
    out = out.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(so_far)))
    before = F.lag("_depth", 1, 0).over(W.partitionBy(*keys).orderBy(order))
    level = F.when(F.col("_step") == 1, F.col("_depth")).when(F.col("_step") == 0, F.col("_depth")).when(before > 0, before)
    return out.withColumn(name, level.cast("int")).drop("_sum", "_depth", "_step")


def spans(rows: DataFrame, keys: Sequence[str], order: str, begin: Column, end: Column) -> DataFrame:
    """(keys, begin, end, level) of everything that opens: the places of both rows; ``end`` is null where nothing closes it."""
    marked = with_levels(rows.select(*keys, F.col(order).alias("_at"), begin.alias("_b"), end.alias("_e")), keys, "_at", F.col("_b"), F.col("_e"))
    partner = F.lead("_at").over(W.partitionBy(*keys, "level").orderBy("_at"))
    return marked.filter("(_b or _e) and level is not null").withColumn("_end", partner).filter("_b").select(*keys, F.col("_at").alias("begin"), F.col("_end").alias("end"), "level")


def contents(rows: DataFrame, keys: Sequence[str], order: str, begin: Column, end: Column, every_level: bool = False) -> DataFrame:
    """The rows that neither open nor close, with ``begin`` (where the innermost thing around them opens) and ``level``; rows that lie in
    nothing are left out. With ``every_level`` a row comes once for each thing around it."""
    marked = with_levels(rows.withColumns({"_b": F.coalesce(begin, F.lit(False)), "_e": F.coalesce(end, F.lit(False))}), keys, order, F.col("_b"), F.col("_e"), "_level")
    around = F.when(~F.col("_b") & (F.col("_level") > 0), F.sequence(F.lit(1), F.col("_level"))) if every_level else F.array("_level")
    own = marked.filter("_level > 0 and not _e").withColumn("level", F.explode(F.when(F.col("_b"), F.array("_level")).otherwise(around)))
    last = F.last(F.when(F.col("_b"), F.col(order)), ignorenulls=True).over(W.partitionBy(*keys, "level").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return own.withColumn("begin", last).filter("not _b").drop("_b", "_e", "_level")


def pieces_joined(rows: DataFrame, keys: Sequence[str], order: str, begin: Column, end: Column, text: str) -> DataFrame:
    """(keys, begin, end, level, joined) of everything that opens and closes: ``text`` of the rows right inside, in order, as one string."""
    whole = spans(rows, keys, order, begin, end).filter("end is not null")
    inside = contents(rows, keys, order, begin, end).groupBy(*keys, "begin").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("p"))
    joined = whole.join(inside, [*keys, "begin"], "left")
    return joined.select(*keys, "begin", "end", "level", F.coalesce(F.array_join(F.transform("p", lambda x: x["t"]), ""), F.lit("")).alias("joined"))
