"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by the order of its `near` nearest reference points (pivots). Vectors that point
the same way order the pivots alike, so a pair is retrieved if their first `near` pivots have at least
`shared` in common, and then verified by its cosine in double precision.

Retrieval goes through the inverted lists of the pivots. Two lists of `near` pivots with `shared` in common
also meet within the `near - shared + 1` pivots of each that are rarest over all rows, so a vector is
entered under those only. A list is worked off in blocks of `block` rows: each pair of blocks is a group of
its own, so a hot list is many groups of bounded size and no group is the size of its list. Inside a group
the shared-pivot counts of all pairs are one product of 0/1 matrices and the cosines another. A pair that
meets in several lists counts in the first of them only. A group returns for each vector the number of its
links, and the links of a spanning forest; pairs are never emitted.

Equal vectors are one class, taken once with its size, before anything is compared. NULL or zero vectors
and those with NULL or non-finite components link with nothing. Vectors of different lengths are indexed
apart and never linked. NULL vec_ids are rows of their own with links, and no one's component_id.

Pivots are drawn evenly by hash from the classes, one per `per_pivot` of them between `least` and `most`
(a documented bound; they are the only sample, and every row is indexed). More pivots make the orders of a
pair differ more, so NEAR is taken for MOST_PIVOTS: of random pairs of 64 dimensions at cosine 0.9, 0.999 or
more are retrieved at any number of pivots up to it (8 pivots: 0.80 at 4,096).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Batches, components, rows_of
from sievework.session import cut

NEAR, SHARED = 16, 3
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 64, 64, 4096
BLOCK = 512
UNIT = "vec_id long, class binary, dim int, unit binary"


def units(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, class (a digest of the direction's exact components; NULL: links with nothing), dim, unit."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys, dims, out = [], [], []
            for vector in batch.column("vector"):
                values = vector.values
                key = unit = dim = None
                if values is not None and len(values) and not values.null_count:
                    raw = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    # By the largest component first, so squares neither overflow nor vanish.
                    scale = np.abs(raw).max()
                    if np.isfinite(scale) and scale > 0:
                        raw_unit = raw / scale
                        unit = (raw_unit / np.sqrt(raw_unit @ raw_unit)).tobytes()
                        key, dim = hashlib.blake2b(raw.tobytes(), digest_size=16).digest(), len(raw)
                keys.append(key)
                dims.append(dim)
                out.append(unit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
                ["vec_id", "class", "dim", "unit"],
            )

    slim = rows_of(df, vec_id=df[id_col].cast("long"), vector=df[vector_col].cast("array<double>"))
    return slim.mapInArrow(run, UNIT)


def matrix(column: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def draw_pivots(classes: DataFrame, dim: int, per_pivot: int, least: int, most: int) -> np.ndarray:
    """Reference points: the classes with the least hashes, at most `most` of them."""
    n = min(max(-(-classes.count() // per_pivot), least), most)
    drawn = classes.select("unit", F.xxhash64("class").alias("h")).orderBy("h").limit(n).collect()
    return matrix([bytes(r["unit"]) for r in drawn], dim)


def described(classes: DataFrame, pivots: np.ndarray, near: int) -> DataFrame:
    """node, unit, size, order: the nearest pivots, nearest first, of every class."""
    shared, dim = classes.sparkSession.sparkContext.broadcast(pivots.astype(np.float32)), pivots.shape[1]
    near = min(near, len(pivots))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                close = matrix(part.column("unit").to_pylist(), dim).astype(np.float32) @ shared.value.T
                top = np.argpartition(-close, near - 1, axis=1)[:, :near]
                order = np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable"), 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("node", "size", "unit")] + [pa.array(order.tolist(), pa.list_(pa.int32()))],
                    ["node", "size", "unit", "pivots"],
                )

    return classes.select("node", "size", "unit").mapInArrow(run, "node long, size long, unit binary, pivots array<int>")


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Those of the links among 0..n-1 that join parts not joined yet."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def _block(frame: pd.DataFrame, dim: int, shared: int, least_cosine: float, ranks: np.ndarray) -> Iterator[pd.DataFrame]:
    """Links between the two blocks of a group (or inside its one block)."""
    pivot, left, right = frame["pivot"].iloc[0], frame["left"].iloc[0], frame["right"].iloc[0]
    frame = frame.sort_values("node", ignore_index=True)
    vectors = matrix(list(frame["unit"]), dim)
    order = np.array(frame["pivots"].tolist(), np.int64)
    mine = frame["own"].to_numpy()
    used = np.unique(order)
    held = np.zeros((len(frame), len(used)), np.float32)
    np.put_along_axis(held, np.searchsorted(used, order), 1, 1)
    # Lists this pair may have met in before: pivots that come earlier in the one order all rows share.
    before = held * (ranks[used] < ranks[pivot])
    nodes, size = frame["node"].to_numpy(), frame["size"].to_numpy()
    links, edges = np.zeros(len(frame), np.int64), []
    a, b = np.flatnonzero(mine == left), np.flatnonzero(mine == right)
    cosine = vectors[a] @ vectors[b].T
    ok = (cosine >= least_cosine) & (held[a] @ held[b].T >= shared) & (before[a] @ before[b].T == 0)
    if left == right:
        ok = np.triu(ok, 1)
    x, y = np.nonzero(ok)
    np.add.at(links, a[x], size[b[y]])
    np.add.at(links, b[y], size[a[x]])
    edges = forest(np.stack([a[x], b[y]], 1), len(frame))
    some = np.flatnonzero(links)
    yield pd.DataFrame({"a": nodes[some], "b": nodes[some], "n": links[some]})
    if edges:
        e = np.array(edges)
        yield pd.DataFrame({"a": nodes[e[:, 0]], "b": nodes[e[:, 1]], "n": np.zeros(len(e), np.int64)})


def _linked(classes: DataFrame, dim: int, least_cosine: float, near: int, shared: int, per_pivot: int, least: int, most: int, block: int) -> DataFrame:
    """(a, b, n): where a = b, n links of class a found in a group; else a link of a spanning forest."""
    pivots = draw_pivots(classes, dim, per_pivot, least, most)
    near = min(near, len(pivots))
    shared = min(shared, near)
    rows = cut(described(classes, pivots, near))
    # One order of the pivots for all rows: rarest first. A number per pivot.
    counts = {r["pivot"]: r["n"] for r in rows.select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = np.zeros(len(pivots), np.int64)
    rank[sorted(range(len(pivots)), key=lambda p: (counts.get(p, 0), p))] = np.arange(len(pivots))
    rank_of = F.array(*[F.lit(int(r)) for r in rank])
    by_rank = F.array_sort(F.transform("pivots", lambda p: F.struct(F.get(rank_of, p).alias("rank"), p.alias("pivot"))))
    entered = rows.withColumn("entry", F.explode(F.slice(by_rank, 1, near - shared + 1))).withColumn("pivot", F.col("entry.pivot"))
    sizes = entered.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()
    blocks = {r["pivot"]: -(-r["n"] // block) for r in sizes}
    n_blocks = F.get(F.array(*[F.lit(blocks.get(p, 1)) for p in range(len(pivots))]), F.col("pivot"))
    placed = entered.withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = placed.withColumn("other", others).select(
        "node", "size", "unit", "pivots", "pivot", "own",
        F.least("own", F.col("other").cast("int")).alias("left"), F.greatest("own", F.col("other").cast("int")).alias("right"),
    )

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _block(pd.concat(list(frames), ignore_index=True), dim, shared, least_cosine, rank)

    return spread.groupBy("pivot", "left", "right").applyInPandas(work, "a long, b long, n long")


def near_duplicates(df: DataFrame, least_cosine: float = 0.9, near: int = NEAR, shared: int = SHARED,
                    per_pivot: int = PER_PIVOT, least: int = LEAST_PIVOTS, most: int = MOST_PIVOTS, block: int = BLOCK,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of df."""
    rows = cut(units(df, id_col, vector_col))
    classes = cut(
        rows.where(F.col("class").isNotNull()).groupBy("class", "dim")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("unit").alias("unit"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    found = None
    for r in classes.select("dim").distinct().orderBy("dim").collect():
        own = _linked(classes.where(F.col("dim") == r["dim"]), r["dim"], least_cosine, near, shared, per_pivot, least, most, block)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = df.sparkSession.createDataFrame([], "a long, b long, n long")
    found = cut(found)
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "_node")
    slim = classes.select("class", "node", "least", "size")
    placed = cut(
        slim.join(links, "node", "left").join(parts, F.col("node") == F.col("_node"), "left")
        .select("class", "least", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    smallest = cut(placed.groupBy("component").agg(F.min("least").alias("component_id")))
    of_class = cut(placed.join(smallest, "component").select("class", "n_links", "component_id"))
    return rows.select("vec_id", "class").join(of_class, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
