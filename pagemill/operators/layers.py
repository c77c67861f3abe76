"""Inheritance chains and layered merges, for style hierarchies and anything shaped like them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import scratch, staged


def chains(edges: DataFrame, keys: Sequence[str], node: str, parent: str, folder: str | None = None) -> DataFrame:
    """(keys, root, node, depth) for every node and each of its ancestors, itself at depth 0.

    A parent that isn't a node ends the chain, and so does one that the chain has had. Rows without a node are no nodes; of several
    parents of one node the greatest counts; repeated rows count once; keys may be null.

    By pointer doubling: every node carries the path to an ancestor and a pointer to what follows, and a round puts that ancestor's own
    path behind it. So a chain of n links takes log2(n) rounds, each one equi-join of the nodes whose path is still open. A round's
    paths are written to ``folder`` (one of ``storage.scratch``, made if not given) and the result reads them there: plans stay short
    and a lost executor costs a round."""
    spark = edges.sparkSession
    folder = folder or scratch(spark, "chains")
    own = edges.select(*keys, F.col(node).alias("root"), F.col(parent).alias("next")).filter("root is not null").groupBy(*keys, "root").agg(F.max("next").alias("next"))
    columns = [*keys, "root", "path", "next"]
    known = staged(own.withColumn("path", F.array("root")).select(*columns), folder, "paths-0")
    done, number = known.filter("next is null"), 0
    still = known.filter("next is not null")
    while still.limit(1).collect():
        number += 1
        other = known.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("root").alias("_at"), F.col("path").alias("_more"), F.col("next").alias("_next"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("next") == F.col("_at"))
        joined = still.join(other, same, "left").withColumn("_whole", F.when(F.col("_at").isNull(), F.col("path")).otherwise(F.concat("path", "_more")))
        # A node has one parent, so behind the first that comes again all come again.
        cut = joined.withColumn("_path", F.array_distinct("_whole"))
        following = F.when(F.size("_path") == F.size("_whole"), F.col("_next"))
        moved = staged(cut.select(*keys, "root", F.col("_path").alias("path"), following.alias("next")), folder, f"paths-{number}")
        done, still = done.unionByName(moved.filter("next is null")), moved.filter("next is not null")
        known = done.unionByName(still)
    return done.select(*keys, "root", F.posexplode("path").alias("depth", "node")).select(*keys, "root", "node", "depth")


def layer_merge(layers: DataFrame, keys: Sequence[str], order: str, name: str, value: str, source: str) -> DataFrame:
    """The value of the last layer that sets a property, and that layer: keys, name, value, source."""
    last = F.max_by(F.struct(value, source), F.col(order))
    return layers.filter(F.col(value).isNotNull()).groupBy(*keys, name).agg(last.alias("_v")).select(*keys, name, f"_v.{value}", f"_v.{source}")


def toggle_fold(layers: DataFrame, keys: Sequence[str], order: str, value: str, toggles: str) -> DataFrame:
    """A boolean through ordered layers: in a toggling layer true inverts what is set, anything else replaces it."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(toggles).alias("t"), F.col(value).alias("v"))))
    folded = F.aggregate(
        F.filter("_l", lambda x: x["v"].isNotNull()),
        F.lit(None).cast("boolean"),
        lambda acc, x: F.when(x["t"] & x["v"] & acc.isNotNull(), ~acc).otherwise(x["v"]),
    )
    return layers.groupBy(*keys).agg(listed.alias("_l")).select(*keys, folded.alias(value))


def tinted(colour: Column, tint: Column, shade: Column) -> Column:
    """A hex colour darkened by the hex byte ``shade`` and then lightened by ``tint``, rounded to whole channels; null bytes do nothing."""
    byte = lambda c: F.conv(c, 16, 10).cast("int")
    scaled = lambda c, by: F.floor((c * by + 127) / 255).cast("int")

    def channel(i: int) -> Column:
        c = byte(F.substring(colour, 1 + 2 * i, 2))
        dark = F.when(shade.isNotNull(), scaled(c, byte(shade))).otherwise(c)
        light = F.when(tint.isNotNull(), dark + scaled(255 - dark, byte(tint))).otherwise(dark)
        return F.lpad(F.hex(light), 2, "0")

    return F.concat(*[channel(i) for i in range(3)])
