"""Connected components as joins over contracted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dealt, each_part, join_back, part_of, parts_met, stage


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, component: for each node of an edge the smallest node it reaches.

    Each round points every node at its neighbour of least hash (or itself), follows the pointers
    once more, and replaces the edges by those between the nodes pointed at. Hash order keeps the
    pointer chains short, so the rounds grow as the logarithm of a path's length. A node of any
    degree is a row per task in the aggregation, which tells the parts of its edges too, and the edges of a node, or the nodes that
    point at one, meet its pointer in parts. Nothing but an edge count reaches the driver.
    """

    def ranked(c: str):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))

    live = stage(edges.select("a", "b").where("a <> b").distinct().withColumn("part", part_of("a", "b")), "edges", narrow=True)
    none, roots = F.lit(None).cast("tinyint"), None
    while live.limit(1).count():
        both = live.select("a", "b", F.col("part").alias("left"), none.alias("right")).union(live.select("b", "a", none, "part"))
        to = stage(
            both.groupBy("a").agg(F.min(ranked("b")).alias("m"), parts_met("left").alias("left"), parts_met("right").alias("right"))
            .select("a", F.least(F.col("m"), ranked("a"))["v"].alias("p"), "left", "right", part_of("a").alias("part")),
            "pointers", narrow=True,
        )
        far = dealt(to.select(F.col("a").alias("p"), F.col("p").alias("pp")), to, "p")
        to = stage(to.join(far, ["p", "part"]).select("a", F.col("pp").alias("p"), "left", "right", "part"), "pointers", narrow=True)
        if roots is None:
            roots = to.select(F.col("a").alias("node"), F.col("p").alias("root"), "part")
        else:
            moved = dealt(to.select(F.col("a").alias("root"), "p"), roots, "root")
            moved = roots.join(moved, ["root", "part"], "left").select("node", F.coalesce("p", "root").alias("root"), "part")
            roots = stage(moved, "roots", narrow=True)
        left = each_part(to.select("a", F.col("p").alias("x"), "left"), "left", "part")
        right = each_part(to.select(F.col("a").alias("b"), F.col("p").alias("y"), "right"), "right", "part")
        live = stage(
            live.join(left, ["a", "part"]).join(right, ["b", "part"]).where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            .withColumn("part", part_of("a", "b")),
            "edges", narrow=True,
        )
    if roots is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return join_back(roots, ["root"], F.col("part"), F.min("node").alias("component")).select("node", "component")
