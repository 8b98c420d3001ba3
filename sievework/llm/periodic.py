"""Periodic stretches of words: maximal runs, found in tiles of each period octave and stitched.

A text's words are runs of characters other than ASCII white space, numbered from 0. A run of period q is a
stretch whose words q apart are identical, q its smallest period, at least max(SHORTEST, TIMES * q) words
long, that no neighbouring word extends.

Octave k holds the periods from 2^k up to 2^(k+1). Its tiles are S = 2^(k+1) words apart and reach S words
to the left of their boundary and 2 S to the right. For each period q of the octave a tile says how far to
both sides of its boundary words q apart agree: the right end comes from the Z-function of the words after
the boundary, the left end from the Z-function of the reversed words before it, put before the reversed
words of the tile. Tiles in which too little agrees at the boundary for any period are passed over by
comparing whole arrays first. A stretch with a shorter period d that divides q is left to d's octave, as both
Z-functions tell. What is left are fragments (period, first, past the last place i that agrees with i + q):
whole ones that are long enough, and those that touch the tile's reach. They are shuffled by document and
period; overlapping ones are stitched together, and what is long enough then is a run. A run agrees over 3 q
> S places, so it holds a boundary, and neighbouring tiles overlap, so stitching loses nothing.

All octaves of a text up to `long_bytes` fit one tile row, which its own task solves; texts are laid side by
side there, with marks between them that equal nothing. Longer texts are exploded: the octaves with small S
share tile rows of TILE words, each further octave has its own rows of 4 S words, and the rows are dealt to
all tasks. Words go as numbers, four bytes each. Time is n log n in the words of a text, whatever it repeats.

Rows with the same doc_id are told apart by a fingerprint of their text; NULL texts have no words, NULL ids
are ids like others. Rows that repeat each get their result. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm.common import Batches, slices

SHORTEST, TIMES = 6, 4
#: Texts of more bytes are exploded into tile rows; words that a row of the small octaves owns.
LONG_BYTES, TILE = 1 << 16, 1 << 13
#: Words compared as whole arrays before a tile's Z-functions are computed; bytes of texts laid side by side.
GLANCE, TOGETHER, PIECE = 8, 4 << 20, 1 << 20

FRAGMENT = "doc_id long, mark long, period long, low long, high long"
TILES = "doc_id long, mark long, least int, most int, first long, last long, begin long, words binary"
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"


def needed(period: int) -> int:
    """Places that must agree with the place a period later."""
    return max(SHORTEST - period, (TIMES - 1) * period)


@lru_cache(100_000)
def _parts(q: int) -> tuple[int, ...]:
    """q over each of its prime factors."""
    out, rest, d = [], q, 2
    while d * d <= rest:
        if rest % d == 0:
            out.append(q // d)
            while rest % d == 0:
                rest //= d
        d += 1
    if rest > 1:
        out.append(q // rest)
    return tuple(out)


def z_function(s: list[int], upto: int) -> list[int]:
    """For each place before `upto`, how many items from there agree with the items from the beginning."""
    n = len(s)
    z = [0] * upto
    left = right = 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve(words: np.ndarray, least: int, most: int, first: int = 0, last: int | None = None, ends: dict[int, int] | None = None) -> list[tuple[int, int, int]]:
    """(period, low, high) of the fragments of the octaves least..most around the boundaries in [first, last).

    words: numbers of words, negative marks equal to nothing. first is a multiple of the largest S. ends: an
    octave -> the words it concerns, from the left.
    """
    out = []
    for k in range(least, most + 1):
        half, step = 1 << k, 2 << k
        stop = len(words) if ends is None else ends[k]
        until = min(stop, len(words) if last is None else last)
        if stop <= half:
            continue
        # The words in rows of one step, with a row of marks before and two after, so that boundaries are row beginnings.
        rows = -(-stop // step) + 3
        flat = np.empty(rows * step, np.int64)
        flat[:step] = -np.arange(1, step + 1) - (1 << 40)
        flat[step : step + stop] = words[:stop]
        flat[step + stop :] = -np.arange(1, len(flat) - step - stop + 1) - (1 << 41)
        grid = flat.reshape(rows, step)
        begin, end = first // step + 1, -(-until // step) + 1
        if begin >= end:
            continue
        found: set[tuple[int, int]] = set()
        for columns, edge, way in ((slice(half, step), grid[begin:end, 0], 1), (slice(half - 1, step - 1), grid[begin - 1 : end - 1, step - 1], -1)):
            row, q = np.nonzero(grid[begin:end, columns] == edge[:, None])
            at = (row + begin) * step - (way < 0)
            q = q + half
            for far in range(1, min(half, GLANCE)):
                same = flat[at + way * far] == flat[at + way * far + q]
                row, at, q = row[same], at[same], q[same]
            found.update(zip((row + begin).tolist(), q.tolist()))
        by_row = defaultdict(list)
        for row, q in found:
            by_row[row].append(q)
        for row, periods in by_row.items():
            c = row * step
            right = z_function(flat[c : c + 2 * step].tolist(), step)
            back = flat[c - step : c + step][::-1].tolist()
            left = z_function([*back[step:], None, *back], 2 * step + 1)
            for q in periods:
                r, l = min(right[q], step), left[2 * step + 1 - q]
                if r < half and l < half:
                    continue
                if l < step and r < step and l + r < needed(q):
                    continue
                if any(left[2 * step + 1 - d] >= l and right[d] >= r + q - d for d in _parts(q)):
                    continue
                out.append((q, c - step - l, c - step + r))
    return out


class Numbers:
    """Words of texts as numbers; the same word has the same number until forgotten."""

    def __init__(self):
        self.table: dict[bytes, int] = defaultdict(count().__next__)

    def of(self, text: bytes) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and not text[end : end + 1].isspace():
                end += 1
            parts.append(np.fromiter(map(self.table.__getitem__, text[at:end].split()), np.int32))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _octaves(n: int) -> int:
    """Octaves that a text of n words can hold runs of."""
    return max(n // TIMES, 1 if n >= SHORTEST else 0).bit_length()


def _rows(part: pa.RecordBatch) -> Iterator[tuple[int | None, int, bytes]]:
    texts = part.column("text").cast(pa.large_binary())
    for doc, mark, text in zip(part.column("doc_id").to_pylist(), part.column("mark").to_pylist(), texts):
        yield doc, mark, text.as_py() or b""


def _solve_short(batches: Batches) -> Batches:
    """Fragments of whole texts, many texts at a time."""
    for batch in batches:
        for part in slices(batch, "text", TOGETHER):
            numbers = Numbers()
            held = [(doc, mark, w) for doc, mark, text in _rows(part) if len(w := numbers.of(text)) >= SHORTEST]
            if not held:
                continue
            held.sort(key=lambda x: -len(x[2]))
            pieces: list[np.ndarray] = []
            ends: dict[int, int] = {}
            begins, at = [], 0
            for i, (_, _, w) in enumerate(held):
                begins.append(at)
                pieces += [w, np.array([-1 - i], np.int32)]
                at += len(w) + 1
                for k in range(_octaves(len(w))):
                    ends[k] = at
            fragments = solve(np.concatenate(pieces), 0, max(ends), ends=ends)
            yield _fragments(fragments, held, begins)


def _fragments(fragments: list, held: list, begins: list[int]) -> pa.RecordBatch:
    q, low, high = (np.array(x, np.int64) for x in zip(*fragments)) if fragments else (np.zeros(0, np.int64),) * 3
    which = np.searchsorted(begins, low, "right") - 1
    base = np.array(begins, np.int64)[which]
    return pa.RecordBatch.from_arrays(
        [pa.array([held[i][0] for i in which], pa.int64()), pa.array([held[i][1] for i in which], pa.int64()), pa.array(q), pa.array(low - base), pa.array(high - base)],
        ["doc_id", "mark", "period", "low", "high"],
    )


def _explode(tile: int):
    """Tile rows of long texts: one set for the octaves whose S is at most a quarter of `tile`, one for each further octave."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                for doc, mark, text in _rows(part):
                    words = Numbers().of(text).astype("<i4")
                    n, octaves = len(words), _octaves(len(words))
                    if not octaves:
                        continue
                    shared = min(octaves, max(1, tile.bit_length() - 3))
                    for least, most in [(0, shared - 1), *((k, k) for k in range(shared, octaves))]:
                        step = 2 << most
                        own = max(tile if least == 0 else 0, 4 * step)
                        for first in range(0, n, own):
                            begin, end = max(0, first - step), min(n, first + own + 2 * step)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([doc], pa.int64()), pa.array([mark], pa.int64()), pa.array([least], pa.int32()), pa.array([most], pa.int32()),
                                 pa.array([first], pa.int64()), pa.array([min(n, first + own)], pa.int64()), pa.array([begin], pa.int64()),
                                 pa.array([words[begin:end].tobytes()], pa.binary())],
                                ["doc_id", "mark", "least", "most", "first", "last", "begin", "words"],
                            )

    return run


def _solve_tiles(batches: Batches) -> Batches:
    for batch in batches:
        for doc, mark, least, most, first, last, begin, words in zip(*(batch.column(i) for i in range(8))):
            base = begin.as_py()
            fragments = solve(np.frombuffer(words.as_py(), "<i4"), least.as_py(), most.as_py(), first.as_py() - base, last.as_py() - base)
            q, low, high = zip(*fragments) if fragments else ((), (), ())
            n = len(q)
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc.as_py()] * n, pa.int64()), pa.array([mark.as_py()] * n, pa.int64()), pa.array(q, pa.int64()),
                 pa.array([x + base for x in low], pa.int64()), pa.array([x + base for x in high], pa.int64())],
                ["doc_id", "mark", "period", "low", "high"],
            )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def fragments(docs: DataFrame, long_bytes: int = LONG_BYTES, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark, period, low, high: what the tiles say."""
    rows = _keyed(docs, id_col, text_col)
    size = F.octet_length("text")
    short = rows.where(size <= long_bytes).mapInArrow(_solve_short, FRAGMENT)
    tiles = rows.where(size > long_bytes).mapInArrow(_explode(tile), TILES)
    return short.unionByName(tiles.repartition("doc_id", "mark", "least", "first").mapInArrow(_solve_tiles, FRAGMENT))


def stitched(found: DataFrame) -> DataFrame:
    """doc_id, mark, start, length, period of the runs: fragments that overlap or touch are one."""
    by_low = W.partitionBy("doc_id", "mark", "period").orderBy("low", "high")
    reach = F.max("high").over(by_low.rowsBetween(W.unboundedPreceding, -1))
    parts = found.withColumn("begins", F.when(reach >= F.col("low"), 0).otherwise(1)).withColumn("part", F.sum("begins").over(by_low.rowsBetween(W.unboundedPreceding, 0)))
    whole = parts.groupBy("doc_id", "mark", "period", "part").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    length = F.col("high") - F.col("start") + F.col("period")
    return whole.withColumn("length", length).where(F.col("length") >= F.greatest(F.lit(SHORTEST), TIMES * F.col("period"))).select("doc_id", "mark", "start", "length", "period")


def runs(docs: DataFrame, long_bytes: int = LONG_BYTES, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark, start, length, period: all runs; mark is the fingerprint of the text."""
    return stitched(fragments(docs, long_bytes, tile, id_col, text_col))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Of (start, length, period), the one with the greatest length / period, then smallest start, then period."""
    best = None
    for run in sorted(found, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words outside of runs and the first period of each run, joined by a space."""
    if not found:
        return b" ".join(words)
    turn = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        turn[start + period] += 1
        turn[start + length] -= 1
    gone = np.cumsum(turn)[:-1] > 0
    return b" ".join([w for w, out in zip(words, gone.tolist()) if not out])


def _assemble(batches: Batches) -> Batches:
    schema = _arrow_result()
    for batch in batches:
        for part in slices(batch, "text", TOGETHER):
            out: list[dict] = []
            for doc, text, found in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.large_binary()), part.column("runs").to_pylist()):
                words = text.as_py().split()
                found = sorted((r["start"], r["length"], r["period"]) for r in found or [])
                found.sort(key=lambda r: (r[0], r[2]))
                as_row = lambda r: r and dict(zip(("start", "length", "period"), r))
                out.append({
                    "doc_id": doc, "n_words": len(words), "runs": [as_row(r) for r in found], "strongest": as_row(strongest(found)),
                    "collapsed": collapsed(words, found).decode(),
                })
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _arrow_result() -> pa.Schema:
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("strongest", run), ("collapsed", pa.string())])


def with_runs(docs: DataFrame, long_bytes: int = LONG_BYTES, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), strongest, collapsed (the text without repetitions): a row per row."""
    found = runs(docs, long_bytes, tile, id_col, text_col).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "length", "period")).alias("runs"))
    found = found.withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"})
    rows = _keyed(docs, id_col, text_col)
    same = rows["doc_id"].eqNullSafe(found["_doc"]) & (rows["mark"] == found["_mark"])
    return rows.join(found, same, "left").select("doc_id", "text", "runs").mapInArrow(_assemble, RESULT)


def listed(runs: Column) -> Column:
    """'start,length,period' and a line feed, for each run."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return F.concat(F.array_join(F.transform(runs, line), "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
