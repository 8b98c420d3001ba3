"""Reachability in edge tables: cycles in few rounds, and a label index for asked pairs.

Nodes are ids of any type; edges are (from_id, to_id). Each round works on the edges or labels that are
left and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import parts, written


def cut(df: DataFrame) -> DataFrame:
    return written(df, "reach")


#: Rounds of plain peeling between two compressions.
PEEL = 3
#: Hubs of the first batch of labels, and by how much a batch is larger than the one before.
FIRST, GROWTH = 16, 8

def _peeled(left: DataFrame, size: int) -> tuple[DataFrame, int, bool]:
    """Some rounds of leaving out edges that start where nothing enters or end where nothing leaves; their number
    then, and whether none is left to leave out."""
    for _ in range(PEEL):
        # Each end is held once, in partitions that follow the number of edges; the edges pass by and are not sorted.
        n = parts(size)
        sources = left.select(F.col("from_id").alias("to_id")).distinct().repartition(n, "to_id").hint("shuffle_hash")
        targets = left.select(F.col("to_id").alias("from_id")).distinct().repartition(n, "from_id").hint("shuffle_hash")
        left = cut(left.repartition(n, "to_id").join(sources, "to_id", "left_semi").repartition(n, "from_id").join(targets, "from_id", "left_semi"))
        rest = left.count()
        if rest == size:
            return left, size, True
        size = rest
    return left, size, not size


def _chains(left: DataFrame) -> DataFrame | None:
    """(id, last, closed): each node with one edge in and one out, and the last such node on the way on from it.

    Pointers double their reach each round, so a way of n nodes takes log2(n) rounds. Where the way never
    ends (closed), it is a cycle of such nodes alone. None if no two of them follow each other.
    """
    one = F.lit(1).alias("n")
    ends = left.select(F.col("from_id").alias("id"), one, F.lit(0).alias("m"), F.col("to_id").alias("next")).unionByName(
        left.select(F.col("to_id").alias("id"), F.lit(0).alias("n"), F.lit(1).alias("m"), F.lit(None).cast(left.schema["to_id"].dataType).alias("next"))
    )
    inner = cut(ends.groupBy("id").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("next").alias("next")).where("n = 1 and m = 1").select("id", "next"))
    on = inner.select(F.col("id").alias("next"), F.lit(False).alias("more"))
    now = cut(inner.join(on, "next", "left").select("id", F.when(F.col("more").isNotNull(), F.col("next")).otherwise(F.col("id")).alias("last"), F.col("more").isNull().alias("done")))
    going = now.where("not done").count()
    if not going:
        return None
    reach, total = 1, now.count()
    while going and reach <= total:
        step = now.select(F.col("id").alias("last"), F.col("last").alias("further"), F.col("done").alias("ends"))
        moved = now.where("not done").drop("done").join(step, "last").select("id", F.col("further").alias("last"), F.col("ends").alias("done"))
        now = cut(now.where("done").unionByName(moved))
        going, reach = now.where("not done").count(), 2 * reach
    return now.select("id", "last", (~F.col("done")).alias("closed"))


def _compressed(left: DataFrame, chains: DataFrame) -> DataFrame:
    """(from_id, to_id, from_new, to_new): each chain as one edge; a closed one as loops of its nodes."""
    a, b = chains.toDF("from_id", "_last_from", "_closed_from"), chains.toDF("to_id", "_last_to", "_closed_to")
    edges = cut(
        left.join(a, "from_id", "left").join(b, "to_id", "left").select(
            "from_id", "to_id", F.coalesce("_last_from", "_last_to").alias("chain"), F.coalesce("_closed_from", "_closed_to", F.lit(False)).alias("closed"),
            F.col("_last_from").isNull().alias("enters"),
        )
    )
    whole = edges.where("chain IS NOT NULL AND NOT closed").groupBy("chain").agg(
        F.max(F.when(F.col("enters"), F.col("from_id"))).alias("_begin"), F.max(F.when(F.col("from_id") == F.col("chain"), F.col("to_id"))).alias("_end")
    )
    return edges.join(whole, "chain", "left").select(
        "from_id", "to_id", F.when(F.col("closed"), F.col("from_id")).otherwise(F.coalesce("_begin", "from_id")).alias("from_new"),
        F.when(F.col("closed"), F.col("from_id")).otherwise(F.coalesce("_end", "to_id")).alias("to_new"),
    )


def _marked(left: DataFrame) -> DataFrame:
    """(way, id, least): the smallest node that each node is reached from (way 'out') and that it reaches ('in'), itself included."""
    steps = cut(
        left.select(F.lit("out").alias("way"), F.col("from_id").alias("id"), F.col("to_id").alias("next"))
        .unionByName(left.select(F.lit("in").alias("way"), F.col("to_id").alias("id"), F.col("from_id").alias("next")))
    )
    now = steps.select("way", "id").union(steps.select("way", "next")).distinct().select("way", "id", F.col("id").alias("least"))
    while True:
        sent = steps.join(now, ["way", "id"]).select("way", F.col("next").alias("id"), "least", F.lit(None).cast(now.schema["least"].dataType).alias("own"))
        both = now.withColumn("own", F.col("least")).unionByName(sent)
        then = cut(both.groupBy("way", "id").agg(F.min("least").alias("least"), F.min("own").alias("own")))
        if then.where("least <> own").isEmpty():
            return now
        now = then.drop("own")


def cyclic_edges(edge_rows: DataFrame) -> DataFrame:
    """(from_id, to_id): the edges that lie on a cycle; empty if there is none.

    Peeling (edges that nothing enters or leaves go) and compressing (a chain of nodes with one edge in and
    one out becomes one edge, by pointer doubling) alternate until neither changes anything, so long ways
    and trees cost rounds by their logarithm. A chain lies on a cycle as a whole or not at all; a compressed
    edge from a node to itself is a cycle. What is left branches everywhere. There, nodes on a cycle are
    reached by the same nodes and reach the same nodes: edges whose ends differ in the smallest node that
    reaches them, or that they reach, go, until none does; then every part that hangs together holds its own
    smallest node, which reaches all of it and is reached by all of it. No node pairs are built.
    """
    left = cut(edge_rows.select("from_id", "to_id"))
    left, size, whole = _peeled(left, left.count())
    left = cut(left.distinct()) if size else left
    size = left.count() if size else 0
    # Where each edge that was not peeled at once has got to, and the ones among those that are known to lie on a cycle.
    origin, found = left.select("from_id", "to_id", F.col("from_id").alias("a"), F.col("to_id").alias("b")), []
    while size:
        if not whole:
            left, size, whole = _peeled(left, size)
        before = size
        chains = _chains(left) if size else None
        if chains is not None:
            made = cut(_compressed(left, chains))
            # Edges that are out, or loops already, stay where they are.
            moved = origin.join(made.toDF("a", "b", "_a", "_b"), ["a", "b"], "left")
            origin = cut(moved.select("from_id", "to_id", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
            left = cut(made.select(F.col("from_new").alias("from_id"), F.col("to_new").alias("to_id")).distinct())
        size, loops = left.agg(F.count_if(F.col("from_id") != F.col("to_id")), F.count_if(F.col("from_id") == F.col("to_id"))).first()
        if loops:
            found.append(left.where("from_id = to_id"))
            left = cut(left.where("from_id <> to_id"))
        if whole and size == before and not loops:
            break
        whole = whole and size == before and not loops
    while size:
        marks = _marked(left)
        end = lambda way, n: marks.where(F.col("way") == way).select(F.col("id").alias(f"{n}_id"), F.col("least").alias(f"{way}_{n}"))
        joined = left.join(end("out", "from"), "from_id").join(end("in", "from"), "from_id").join(end("out", "to"), "to_id").join(end("in", "to"), "to_id")
        left = cut(joined.filter("out_from = out_to AND in_from = in_to").select("from_id", "to_id"))
        before, size = size, left.count()
        if size == before:
            break
        whole = False
        while not whole:
            left, size, whole = _peeled(left, size)
    if size:
        found.append(left)
    if not found:
        return left.select("from_id", "to_id")
    on_cycle = found[0]
    for more in found[1:]:
        on_cycle = on_cycle.unionByName(more)
    return origin.join(on_cycle.toDF("a", "b"), ["a", "b"], "left_semi").select("from_id", "to_id")


def _batches(steps: DataFrame) -> DataFrame:
    """(id, batch): all nodes, those on many ways first."""
    counts = steps.groupBy(F.col("node").alias("id")).agg(F.count_if(F.col("way") == "out").alias("outs"), F.count_if(F.col("way") == "in").alias("ins"))
    # Ties are told apart by a hash, so that a batch is about as large as it should be.
    score = (F.col("outs") + 1) * (F.col("ins") + 1) + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    scored = cut(counts.select("id", score.alias("score")))
    n, share, size, done = scored.count(), [], FIRST, 0
    while done + size < n:
        done, size = done + size, size * GROWTH
        share.append(1 - done / n)
    bounds = scored.agg(F.percentile_approx("score", share, 100_000)).first()[0] if share else []
    return scored.select("id", sum((F.when(F.col("score") <= b, 1).otherwise(0) for b in bounds), F.lit(0)).alias("batch"))


def label_index(edge_rows: DataFrame) -> DataFrame:
    """(way, node, hub, distance): for each node, hubs it reaches (way 'in': node to hub) and hubs that reach it ('out': hub to node).

    Pruned landmark labels: hubs are taken batch by batch, the nodes on most ways first, and searched from
    breadth-first both ways at once; a node that earlier hubs already connect with the hub as shortly is
    neither labelled nor passed. Whatever way is shortest between two nodes, its first-taken node is in the
    labels of both ends. The number of batches is the logarithm of the number of nodes.

    An earlier hub is connected with every node by the labels there are, so a search never passes one: each
    edge is left out once the first of its ends had its batch, and no labels are compared for it. Only for
    nodes that are no hubs yet the labels of the batch's own hubs are held against theirs.
    """
    rows = cut(edge_rows.select("from_id", "to_id"))
    n = parts(rows.count())
    pairs = cut(rows.where("from_id <> to_id").repartition(n, "from_id", "to_id").distinct())
    ways = pairs.select(F.lit("out").alias("way"), F.col("from_id").alias("node"), F.col("to_id").alias("next")).unionByName(
        pairs.select(F.lit("in").alias("way"), F.col("to_id").alias("node"), F.col("from_id").alias("next"))
    )
    alone = rows.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    hubs = cut(alone.join(_batches(ways), "id", "left").select("id", F.coalesce("batch", F.lit(0)).alias("batch")))
    turn = lambda end: hubs.select(F.col("id").alias(end), F.col("batch").alias(f"{end}_batch"))
    until = cut(pairs.join(turn("from_id"), "from_id").join(turn("to_id"), "to_id").select("from_id", "to_id", F.least("from_id_batch", "to_id_batch").alias("batch")))
    steps = until.select(F.lit("out").alias("way"), F.col("from_id").alias("node"), F.col("to_id").alias("next"), "batch").unionByName(
        until.select(F.lit("in").alias("way"), F.col("to_id").alias("node"), F.col("from_id").alias("next"), "batch")
    )
    # Until which batch a node has steps: a search goes on from those only that have some left.
    going = cut(steps.groupBy("way", "node").agg(F.max("batch").alias("batch")))
    last, labels = until.agg(F.max("batch")).first()[0], None
    for batch in range((hubs.agg(F.max("batch")).first()[0] or 0) + 1):
        start = hubs.where(F.col("batch") == batch)
        frontier = cut(start.select(F.explode(F.array(F.lit("out"), F.lit("in"))).alias("way"), F.col("id").alias("hub"), F.col("id").alias("node")))
        seen, distance, back = frontier.withColumn("distance", F.lit(0)), 0, None
        left = steps.where(F.col("batch") >= batch).drop("batch")
        more = going.where(F.col("batch") >= batch).select("way", "node").hint("shuffle_hash")
        if labels is not None and batch <= last:
            back = cut(
                labels.join(start.select(F.col("id").alias("node")), "node", "left_semi").select(
                    F.when(F.col("way") == "in", "out").otherwise("in").alias("way"), F.col("node").alias("hub"), F.col("hub").alias("over"), F.col("distance").alias("d1")
                )
            )
        while last is not None and batch <= last:
            distance += 1
            met = frontier.join(left, ["way", "node"]).select("way", "hub", F.col("next").alias("node")).distinct()
            met = met.join(seen.select("way", "hub", "node"), ["way", "hub", "node"], "left_anti")
            if back is not None:
                met = cut(met)
                on = labels.select("way", "node", F.col("hub").alias("over"), F.col("distance").alias("d2"))
                known = met.join(back, ["way", "hub"]).join(on, ["way", "node", "over"]).where(F.col("d1") + F.col("d2") <= distance).select("way", "hub", "node")
                met = met.join(known, ["way", "hub", "node"], "left_anti")
            met = cut(met)
            if met.isEmpty():
                break
            seen = seen.unionByName(met.withColumn("distance", F.lit(distance)))
            frontier = cut(met.join(more, ["way", "node"], "left_semi"))
            if frontier.isEmpty():
                break
        fresh = cut(seen.select("way", "node", "hub", "distance"))
        labels = fresh if labels is None else labels.unionByName(fresh)
    return labels


def distances(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (from_id, to_id, any other columns) with distance: the fewest edges on a way, NULL if there is none.

    A join of two label sets on the pair and their hub; no closure is built, and a hub that many nodes
    share splits over the pairs.
    """
    asked = pairs.select("from_id", "to_id").distinct()
    up = labels.where("way = 'in'").select(F.col("node").alias("from_id"), "hub", F.col("distance").alias("d1"))
    down = labels.where("way = 'out'").select(F.col("node").alias("to_id"), "hub", F.col("distance").alias("d2"))
    down = down.join(asked.select("to_id").distinct(), "to_id", "left_semi")  # what no pair asks for is not sent around
    found = asked.join(up, "from_id").join(down, ["to_id", "hub"]).groupBy("from_id", "to_id").agg(F.min(F.col("d1") + F.col("d2")).alias("distance"))
    return pairs.join(found, ["from_id", "to_id"], "left")


def label_sizes(labels: DataFrame) -> DataFrame:
    """One row: nodes, labels, mean and greatest number of labels of a node (both ways)."""
    each = labels.groupBy("node").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("nodes"), F.sum("n").alias("labels"), F.avg("n").alias("mean"), F.max("n").alias("most"))
