"""How far the sources of a language differ in their words: a K2-tree over the matrix of groups and terms.

A group is a (lang, source) that occurs; NULL text, lang and source are ''. Terms are runs of characters
other than 0x00-0x40, 0x5B-0x60 and 0x7B-0x7F, only A-Z lower-cased; a language keeps the V terms found in
at least `least_docs` of its documents. In a group with N occurrences of kept terms, a term that occurs
count times has the smoothed share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two shares differ by
f = floor((p - q)^2 / (p + q)).

Most of a group's row of the matrix is zero, and there p is the group's own constant, so a block of the
matrix in which two groups have nothing adds its width times one value of f. The matrix of a language
(terms by falling count, groups by name) is cut into squares of SIDE groups by SIDE terms. Blocks in which
no group has anything are never built and are priced at the end. In the others, the cells of a square are
a K2-tree: their Z-order codes, sorted, hold every level as the distinct prefixes. Each pair of block rows
is walked jointly from the roots down: a pair of children that are both empty is priced by its width, any
other goes on, and at the leaves shares meet shares, or the constant of a group that has nothing there.

Counts are combined per task before the only shuffle of words, so a source, term or language with any part
of the rows costs no task more than its distinct words. p and the sums are whole numbers: decimals in Spark
where count could pass 64 bits, and 64-bit in the tree, as (p - q)^2 <= 10^18. All pairs of sources of a
language are the result asked for, G (G - 1) rows for G sources; no other pairs are made. Rows that repeat
count each time, with or without a doc_id. Without documents there is no row; without kept terms all values
are 0 and no term is listed.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm.common import Batches, slices, stored, with_prefix_sums

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Groups and terms on a side of a square, a power of 2; squares side by side in one unit of work.
SIDE, SQUARES = 64, 8
#: (group, term) that a task holds before it passes their counts on; rows of a batch; bytes of a text looked at at once.
HELD, ROWS, PIECE = 500_000, 1 << 16, 1 << 20

_PLAIN = bytes(
    c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def _words(text: bytes):
    """The words of a text, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            piece = text[at:end].translate(_PLAIN)
            cut = piece.rfind(b" ") + 1
            while not cut and end < len(text):
                end += PIECE
                piece = text[at:end].translate(_PLAIN)
                cut = piece.rfind(b" ") + 1
            if cut and end < len(text):
                piece, end = piece[:cut], at + cut
        else:
            piece = text[at:].translate(_PLAIN)
        yield piece.split()
        at = end


class _Counts:
    """Sums over documents by (group, word): words and groups as numbers, sums as sorted arrays."""

    def __init__(self):
        self.words: dict[bytes, int] = defaultdict(count().__next__)
        self.groups: dict[tuple[str, str], int] = defaultdict(count().__next__)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.keys, self.n, self.docs = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        group = self.groups[lang, source]
        codes = [np.fromiter(map(self.words.__getitem__, words), np.int64) for words in _words(text)]
        if codes:
            own, times = np.unique(np.concatenate(codes), return_counts=True)
            self.new.append((own + (group << 32), times, np.ones(len(own), np.int64)))
            self.waiting += len(own)

    def combine(self) -> None:
        keys, n, docs = (np.concatenate(x) for x in zip((self.keys, self.n, self.docs), *self.new))
        self.new, self.waiting = [], 0
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            self.keys, self.n, self.docs = keys[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)

    def rows(self) -> Batches:
        self.combine()
        names = ["lang", "source", "term", "n", "docs"]
        lang, source = (pa.array(x, pa.string()) for x in zip(*self.groups))
        zero = pa.array([0] * len(lang), pa.int64())
        yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(lang), pa.string()), zero, zero], names)
        terms = pa.array(list(self.words), pa.binary()).cast(pa.string())
        self.words.clear()
        for at in range(0, len(self.keys), ROWS):
            keys, n, docs = (x[at : at + ROWS] for x in (self.keys, self.n, self.docs))
            group, word = pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), terms.take(word), pa.array(n), pa.array(docs)], names)


def _count(batches: Batches) -> Batches:
    """lang, source, term, n, docs: sums over this task's documents, passed on when many are held.

    Each group comes with a row without a term, so that it is known without terms, too.
    """
    held = _Counts()
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text").cast(pa.large_binary())):
                held.add(lang, source, text.as_py())
                if held.waiting > HELD:
                    held.combine()
            if len(held.keys) > HELD or len(held.words) > HELD:
                yield from held.rows()
                held = _Counts()
    if held.groups:
        yield from held.rows()


@dataclass
class Matrix:
    """cells: lang, row, source, term, col, n, p. kept: lang, term, col, p (of the language).
    groups: lang, source, row, p0 (share of a term the group lacks; NULL without kept terms), v."""

    cells: DataFrame
    kept: DataFrame
    groups: DataFrame


def _share(n: Column, total: Column, v: Column) -> Column:
    whole = lambda c: c.cast("decimal(20,0)")
    over = F.lit(SCALE).cast("decimal(10,0)") * (whole(n) + 2)
    return F.when(v > 0, F.call_function("div", over.cast("decimal(38,0)"), (whole(total) + 2 * whole(v)).cast("decimal(38,0)")) + 1)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def matrix(docs: DataFrame, least_docs: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> Matrix:
    known = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(known(text_col).alias("text"), known(lang_col).alias("lang"), known(source_col).alias("source"))
    counted = stored(
        rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "terms",
    )
    met = counted.where(F.col("term").isNotNull())
    kept = met.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    # Places among all kept terms, then inside the language: no language is numbered in one task.
    placed = stored(
        with_prefix_sums(kept.select("lang", "term", "n", (-F.col("n")).alias("rare"), F.lit(1).cast("long").alias("one")), ["lang", "rare", "term"], {"place": "one"}),
        "kept-terms",
    )
    langs = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("all"), F.min("place").alias("base"))
    kept = placed.join(langs, "lang").select(
        "lang", "term", (F.col("place") - F.col("base")).alias("col"), _share(F.col("n"), F.col("all"), F.col("v")).alias("p")
    )
    cells = met.join(kept.select("lang", "term", "col"), ["lang", "term"]).select("lang", "source", "term", "col", "n")
    cells = stored(cells, "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = (
        counted.where(F.col("term").isNull()).select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
        .join(langs.select("lang", "v"), "lang", "left")
        .select(
            "lang", "source", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("row"),
            F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"),
        )
        .withColumn("p0", _share(zero, F.col("total"), F.col("v")))
    )
    groups = stored(groups, "groups")
    shared = cells.join(groups, ["lang", "source"]).select("lang", "row", "source", "term", "col", "n", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    return Matrix(shared, kept, groups.select("lang", "source", "row", "p0", "v"))


def z_order(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The Z-order code of each cell of a square: the bits of row and column, in turn."""
    code = np.zeros(len(row), np.int64)
    for bit in range(SIDE.bit_length() - 1):
        code |= (row >> bit & 1) << 2 * bit + 1 | (col >> bit & 1) << 2 * bit
    return code


class Tree:
    """A K2-tree (K = 2) of a square: for each level the sorted codes of its quadrants that are not empty."""

    def __init__(self, row: np.ndarray, col: np.ndarray, p: np.ndarray):
        code = z_order(row, col)
        order = np.argsort(code)
        self.p = p[order]
        levels = [code[order]]
        while len(levels) < SIDE.bit_length():
            levels.append(np.unique(levels[-1] >> 2))
        self.levels = levels[::-1]

    def find(self, level: int, code: np.ndarray) -> np.ndarray:
        """The place of each quadrant in its level, -1 for an empty one."""
        own = self.levels[level]
        if not len(own):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(own, code), len(own) - 1)
        return np.where(own[at] == code, at, -1)


def walk(a: Tree, b: Tree, p0a: np.ndarray, p0b: np.ndarray, width: int, same: bool) -> np.ndarray:
    """The sums of f over the first `width` columns, for each row of a against each row of b.

    The frontier holds pairs of quadrants of one size over the same columns: a block of rows of a, one of b,
    a block of columns. same: a and b are one square, so only pairs with the first row before the second count.
    """
    na, nb = len(p0a), len(p0b)
    empty = np.zeros((SIDE, SIDE), np.int64)  # columns in which neither row has anything
    ra = rb = c = np.zeros(1, np.int64)
    for level, size in enumerate(SIDE >> k for k in range(SIDE.bit_length())):
        if level:
            ra, rb, c = (np.repeat(x << 1, 8) for x in (ra, rb, c))
            turn = np.arange(len(c)) & 7
            ra, rb, c = ra + (turn >> 2), rb + (turn >> 1 & 1), c + (turn & 1)
            inside = (ra * size < na) & (rb * size < nb) & (c * size < width)
            if same:
                inside &= ra <= rb
            ra, rb, c = ra[inside], rb[inside], c[inside]
        ia, ib = a.find(level, z_order(ra, c)), b.find(level, z_order(rb, c))
        void = (ia < 0) & (ib < 0)
        if void.any():
            side = SIDE // size
            wide = np.minimum(size, width - c[void] * size)
            found = np.bincount(ra[void] * side + rb[void], weights=wide, minlength=side * side).astype(np.int64).reshape(side, side)
            empty += found.repeat(size, 0).repeat(size, 1)
            ra, rb, c, ia, ib = (x[~void] for x in (ra, rb, c, ia, ib))
    p, q = p0a[:, None], p0b[None, :]
    sums = empty[:na, :nb] * ((p - q) ** 2 // (p + q))
    if len(c):
        p, q = p0a[ra], p0b[rb]
        p[ia >= 0], q[ib >= 0] = a.p[ia[ia >= 0]], b.p[ib[ib >= 0]]
        # Sums of whole numbers under 2^53 are exact in doubles: at most SIDE terms of 2 * 10^9 each.
        met = np.bincount(ra * nb + rb, weights=(p - q) ** 2 // (p + q), minlength=na * nb)
        sums += met.astype(np.int64).reshape(na, nb)
    return sums


def _unit(table: pa.Table) -> pa.Table:
    """One strip of terms and two block rows of groups: lang, a, b, value, cols of each pair of groups, a before b.

    Rows with col -1 give p0 of a group; v is the number of kept terms.
    """
    lang, strip, low, high = (table.column(c)[0].as_py() for c in ("lang", "strip", "low", "high"))
    row, col, p = (table.column(c).to_numpy() for c in ("row", "col", "p"))
    wide = SIDE * SQUARES
    width = min(wide, table.column("v")[0].as_py() - strip * wide)
    constants, sides = [], []
    for block in (low, high):
        own = row // SIDE == block
        frame = own & (col < 0)
        order = np.argsort(row[frame])
        constants.append(p[frame][order])
        sides.append(own & (col >= 0))
    sums = np.zeros((len(constants[0]), len(constants[1])), np.int64)
    for square in range(-(-width // SIDE)):
        trees = []
        for side in sides if low < high else sides[:1]:
            here = side & (col // SIDE == strip * SQUARES + square)
            trees.append(Tree(row[here] % SIDE, col[here] % SIDE, p[here]))
        sums += walk(trees[0], trees[-1], *constants, min(SIDE, width - square * SIDE), low == high)
    a, b = np.indices(sums.shape)
    a, b = a.ravel() + low * SIDE, b.ravel() + high * SIDE
    once = a < b
    n = int(once.sum())
    return pa.table({
        "lang": pa.array([lang] * n, pa.string()), "a": a[once], "b": b[once], "value": sums.ravel()[once],
        "cols": pa.array([width] * n, pa.int64()),
    })


def pairs(m: Matrix) -> DataFrame:
    """lang, source, item, value: each source of a language with each other one, both ways."""
    wide = SIDE * SQUARES
    groups = m.groups.withColumn("block", F.floor(F.col("row") / SIDE))
    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"), F.first("v").alias("v"))
    cells = (
        m.cells.select("lang", F.floor(F.col("col") / wide).alias("strip"), F.floor(F.col("row") / SIDE).alias("block"), "row", "col", "p")
        .join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("lang", "strip", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "row", "col", "p", "v")
    )
    units = cells.select("lang", "strip", "low", "high", "v").distinct()
    frames = units.join(groups.select("lang", "block", "row", "p0"), "lang").where("block = low or block = high").select(
        "lang", "strip", "low", "high", "row", F.lit(-1).cast("long").alias("col"), F.col("p0").alias("p"), "v"
    )
    walked = (
        cells.unionByName(frames).groupBy("lang", "strip", "low", "high")
        .applyInArrow(_unit, "lang string, a long, b long, value long, cols long")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("cols").alias("cols"))
    )
    side = lambda n: m.groups.select("lang", F.col("row").alias(n), F.col("source").alias(f"source_{n}"), F.col("p0").alias(f"p0_{n}"), "v")
    both = side("a").join(side("b").drop("v"), "lang").where("a < b").join(walked, ["lang", "a", "b"], "left")
    zero = F.lit(0).cast("long")
    # Where neither block row has anything, every column is priced here.
    rest = (F.col("v") - F.coalesce("cols", zero)) * _apart(F.col("p0_a"), F.col("p0_b"))
    valued = both.select("lang", "source_a", "source_b", F.when(F.col("v") > 0, F.coalesce("value", zero) + rest).otherwise(zero).alias("value"))
    ways = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    return valued.select("lang", "value", F.inline(ways)).select("lang", "source", "item", "value")


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def terms(m: Matrix, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the terms a group has above its language's share, the `top` first."""
    above = m.cells.join(m.kept.select("lang", "term", F.col("p").alias("q")), ["lang", "term"]).where("p > q")
    return _ranked(above.select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= top)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    m = matrix(docs, least_docs, text_col, lang_col, source_col)
    parts = _ranked(pairs(m)).withColumn("part", F.lit("pair")).unionByName(terms(m, top).withColumn("part", F.lit("term")))
    return parts.select("lang", "source", "part", "item", "value", "rank")
