"""Lineage over edge tables: build, classify, follow, check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import snake_id
from sievework.operators.reach import cyclic_edges  # noqa: F401
from sievework.session import cut, parts

LAYERS = ["source", "bronze", "silver", "gold", "serving"]
#: Tasks that the ends of one node are told apart in.
SHARES = 8


def edges(mappings: DataFrame) -> DataFrame:
    """Distinct directed edges from mapping rows (source, target, rule).

    Ids follow from the labels, so rows are told apart by source, target and rule alone and ids are made
    afterwards. The partitions follow the number of rows: what one task holds does not grow with the table.
    """
    rule = F.coalesce(F.nullif(F.trim("rule"), F.lit("")), F.lit("passthrough"))
    rows = mappings.select("source", "target", F.when(F.lower(rule) == "unknown", "passthrough").otherwise(rule).alias("transformation"))
    return rows.repartition(parts(mappings.count()), "source", "target", "transformation").distinct().select(
        snake_id(F.col("source")).alias("from_id"),
        snake_id(F.col("target")).alias("to_id"),
        "transformation",
        F.col("source").alias("from_label"),
        F.col("target").alias("to_label"),
    )


def nodes(edge_rows: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct ends of the edges, with their layer. most: how many edges there are at most, counted if not given.

    Ends are told apart first, a node of many edges in several tasks: an extreme of texts is found by sorting,
    and that is left with few rows. As for edges, the partitions follow the number of rows.
    """
    n = parts(2 * (edge_rows.count() if most is None else most))

    def end(this: str, other: str) -> Column:
        share = F.pmod(F.xxhash64(f"{other}_label"), F.lit(SHARES))
        return F.struct(F.col(f"{this}_id").alias("id"), F.col(f"{this}_label").alias("label"), share.alias("share"))

    ends = edge_rows.select(F.explode(F.array(end("from", "to"), end("to", "from"))).alias("n")).select("n.*")
    told = ends.repartition(n, "id", "share").distinct().select("id", "label")
    # Without a shuffle between them the optimizer would leave the distinct out and sort all ends.
    found = told.repartition(n, "id").groupBy("id").agg(F.min("label").alias("label"))
    return found.withColumn("layer", layer(F.col("id")))


def layer(node: Column) -> Column:
    """Layer by name: raw tables bronze, vault silver, dimensional gold, reports serving."""
    return (
        F.when(node.rlike("^(hub|lnk|sat)_"), "silver")
        .when(node.rlike("^(dim|fact|agg)_"), "gold")
        .when(node.rlike("(report|dashboard|feature)"), "serving")
        .when(node.rlike("^src_"), "source")
        .otherwise("bronze")
    )


def layer_jumps(edge_rows: DataFrame) -> DataFrame:
    """Edges that skip a layer or run backwards."""
    rank = F.create_map(*[F.lit(x) for i, name in enumerate(LAYERS) for x in (name, i)])
    step = F.element_at(rank, layer(F.col("to_id"))) - F.element_at(rank, layer(F.col("from_id")))
    return edge_rows.withColumn("step", step).filter((F.col("step") > 1) | (F.col("step") < 0))


def closure(edge_rows: DataFrame, roots: DataFrame, downstream: bool = True, max_depth: int | None = None) -> DataFrame:
    """Nodes each root reaches, with the shortest depth (root, node, depth).

    Breadth-first: a round joins only the newest pairs with the edges and keeps the pairs not seen
    before, so it ends on cycles too. Each round is cut to the checkpoint folder.
    """
    here, there = ("from_id", "to_id") if downstream else ("to_id", "from_id")
    steps = cut(edge_rows.select(F.col(here).alias("node"), F.col(there).alias("next")).distinct())
    frontier = cut(
        roots.select(F.col("id").alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    )
    seen = frontier
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = (
            frontier.join(steps, "node")
            .select("root", F.col("next").alias("node"))
            .distinct()
            .join(seen.select("root", "node"), ["root", "node"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = cut(found)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")
