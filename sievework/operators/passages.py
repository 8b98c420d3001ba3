"""Keyword search over stored passages by trigram postings: only passages that can hold a keyword are scored.

`build` writes the passages with a number each and, for every three characters in a row of a lower-cased
passage (and the shorter ends), the numbers of the passages that hold them. Lists are cut into blocks of
passage numbers, so a frequent trigram is many short rows, hold the steps from number to number, mostly a
byte each, and lie sorted by trigram, so a search reads the row groups of its trigrams only. A passage that
holds a keyword holds all of its trigrams, or, for a shorter keyword, one that begins with it. Candidates are
read and scored as `corpus.top_k` scores all passages, and the outcome is the same: where fewer than k
passages score, the first of the others in document order follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.operators.corpus import score
from sievework.session import written

GRAM = 3
#: Bits of a passage's place in its block; a step within a block takes two bytes of 7 bits at most.
BLOCK_BITS = 14
#: Characters whose trigrams a task sorts at a time.
PIECE = 1 << 21
#: Stands after the end of a passage.
END = "\0"
#: Candidates that are broadcast at a time, to the passages in their range of numbers.
BROADCAST_ROWS = 250_000


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, block, passages) of (passage, text) rows, text being UTF-8: the lists of some passages at a time."""
    for batch in batches:
        rows = sorted((i, t.decode("utf-8", "replace")) for i, t in zip(batch["passage"].to_pylist(), batch["text"].to_pylist()) if t)
        some, size = [], 0
        for n, row in enumerate(rows, 1):
            some.append(row)
            size += len(row[1])
            if size >= PIECE or n == len(rows):
                yield _lists_of(some)
                some, size = [], 0


def _lists_of(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    """The lists of passages that ascend by number; none is empty."""
    points = np.frombuffer("".join(t + END * (GRAM - 1) for _, t in rows).encode("utf-32-le"), "<u4")
    letters = np.flatnonzero(np.bincount(points))
    bits, row_bits = (len(letters) - 1).bit_length(), (len(rows) - 1).bit_length()
    if GRAM * bits + row_bits > 63:
        return pa.concat_batches([_lists_of(rows[: len(rows) // 2]), _lists_of(rows[len(rows) // 2 :])])
    # The letters of a piece are numbered in order, so a gram and the row that holds it are one number to sort.
    numbered = np.zeros(letters[-1] + 1, np.int64)
    numbered[letters] = np.arange(len(letters))
    points = numbered[points]
    sizes = np.array([len(t) for _, t in rows])
    # A gram begins at every character of a passage, none at the ends that were put on.
    owner = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(len(owner)) + owner * (GRAM - 1)
    held = points[at]
    for _ in range(1, GRAM):
        at += 1
        held <<= bits
        held |= points[at]
    held <<= row_bits
    held |= owner
    held.sort()
    held = held[np.r_[True, held[1:] != held[:-1]]]  # by gram, then passage
    gram, passage = held >> row_bits, np.array([i for i, _ in rows], np.int64)[held & (1 << row_bits) - 1]
    block = passage >> BLOCK_BITS
    first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])])
    grams, mask = gram[first], (1 << bits) - 1
    points = np.stack([letters[grams >> 2 * bits], letters[grams >> bits & mask], letters[grams & mask]], 1).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    names = pa.array([text[i : i + GRAM] for i in range(0, len(text), GRAM)])
    lists = pa.ListArray.from_arrays(np.r_[first, len(held)].astype(np.int32), passage)
    return pa.RecordBatch.from_arrays([names, pa.array(block[first]), lists], ["gram", "block", "passages"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, block, steps) of (passage, text) rows: the same lists, each a first place in its block and the steps from there."""
    for batch in _lists(batches):
        lists = batch["passages"]
        first, place = lists.offsets.to_numpy(), lists.values.to_numpy() & (1 << BLOCK_BITS) - 1
        step = np.diff(place, prepend=0)
        step[first[:-1]] = place[first[:-1]]
        # 7 bits a byte, the low ones first; all but a number's last byte have the high bit set.
        long = step > 127
        last = np.cumsum(1 + long) - 1
        held = np.zeros(last[-1] + 1, np.uint8)
        held[last] = np.where(long, step >> 7, step)
        held[last[long] - 1] = step[long] & 127 | 128
        begins = np.r_[last - long, len(held)][first].astype(np.int32)
        steps = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(begins), pa.py_buffer(held)])
        yield pa.RecordBatch.from_arrays([batch["gram"], batch["block"], steps], ["gram", "block", "steps"])


def _places(lists: list[bytes]) -> np.ndarray:
    """The places in their block that lists of steps hold, list after list."""
    held = np.frombuffer(b"".join(lists), np.uint8).astype(np.int64)
    last = np.flatnonzero(held < 128)
    step = held[last]
    long = np.flatnonzero(np.diff(last, prepend=-1) > 1)
    step[long] = step[long] << 7 | held[last[long] - 1] & 127
    of = np.searchsorted(np.cumsum([len(x) for x in lists]), last, side="right")
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    total = np.cumsum(step)
    return total - (total - step)[first][of]


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, passage) of (word, block, need, steps) rows: the passages that at least `need` of a row's lists hold."""
    for batch in batches:
        for word, block, need, steps in zip(*(batch[c].to_pylist() for c in ("word", "block", "need", "steps"))):
            passage = np.flatnonzero(np.bincount(_places(steps)) >= need) + (block << BLOCK_BITS)
            yield pa.RecordBatch.from_arrays([pa.array([word] * len(passage), pa.string()), pa.array(passage)], ["word", "passage"])


def build(chunk_rows: DataFrame, path: str) -> None:
    """chunk_rows: doc_id, chunk_no, chunk.

    Each task makes the lists of its own passages, so what is shuffled is lists, one row a trigram and block
    or a few, and not a row for each trigram of each passage. Lists are shuffled and stored as bytes of steps,
    those of one task apart from the next one's.
    """
    spark = chunk_rows.sparkSession
    numbered = chunk_rows.select("doc_id", "chunk_no", "chunk").withColumn("passage", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(f"{path}/passages")
    stored = spark.read.parquet(f"{path}/passages")
    some = stored.select("passage", F.lower("chunk").cast("binary").alias("text")).mapInArrow(_steps, "gram string, block bigint, steps binary")
    lists = some.groupBy("gram", "block").agg(F.sort_array(F.collect_list("steps")).alias("steps"))
    lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.option("compression", "zstd").parquet(f"{path}/postings")


def _words(queries: dict[str, list[str]]) -> list[str]:
    return sorted({k.lower() for words in queries.values() for k in words if k})


def candidates(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """(word, passage): passages that hold all trigrams of a word, or one that begins with a shorter word.

    The lists of a word and a block meet in one row, so what is shuffled is lists, not passages.
    """
    grams = {w: sorted({w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}) for w in words}
    exact = sorted({g for found in grams.values() for g in found})
    wanted = [(w, g, len(found)) for w, found in grams.items() for g in found]
    postings = spark.read.parquet(f"{path}/postings")
    asked = spark.createDataFrame(wanted, "word string, gram string, need int")  # the keywords of a few questions
    hits = postings.where(F.col("gram").isin(exact)).join(F.broadcast(asked), "gram").select("word", "block", "need", "steps")
    for w in words:
        if len(w) < GRAM:
            hits = hits.unionByName(postings.where(F.col("gram").startswith(w)).select(F.lit(w).alias("word"), "block", F.lit(1).alias("need"), "steps"))
    met = hits.groupBy("word", "block").agg(F.max("need").alias("need"), F.flatten(F.collect_list("steps")).alias("steps"))
    return met.mapInArrow(_holders, "word string, passage bigint")


def _ranges(found: DataFrame) -> list[Column]:
    """Conditions that part all passages by number, each with about BROADCAST_ROWS of the found ones at most."""
    n = math.ceil(found.count() / BROADCAST_ROWS)
    if n < 2:
        return [F.lit(True)]
    passage = F.col("passage")
    ends = sorted(set(found.agg(F.percentile_approx("passage", [i / n for i in range(1, n)])).first()[0]))
    return [passage < ends[0], *((passage >= a) & (passage < b) for a, b in zip(ends, ends[1:])), passage >= ends[-1]]


def search(spark: SparkSession, path: str, queries: dict[str, list[str]], k: int) -> DataFrame:
    """query, score, doc_id, chunk_no, chunk, place: as `corpus.top_k` over all passages.

    Candidates go to the passages, some at a time, so no passage is shuffled but the best of each task.
    """
    asked = spark.createDataFrame([(q, w.lower()) for q, words in queries.items() for w in dict.fromkeys(words) if w], "query string, word string")
    found = written(candidates(spark, path, _words(queries)).join(F.broadcast(asked), "word").select("query", "passage").distinct(), "passages-asked")
    passages = spark.read.parquet(f"{path}/passages")
    value = F.lit(0).cast("bigint")
    for q, words in queries.items():
        value = F.when(F.col("query") == q, score(F.lower("chunk"), words)).otherwise(value)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id", "chunk_no"))
    best = None
    for some in _ranges(found):
        rows = passages.where(some).join(F.broadcast(found.where(some)), "passage")  # about BROADCAST_ROWS at most
        rows = rows.select("query", value.alias("score"), "doc_id", "chunk_no", "chunk").where("score > 0")
        rows = rows if best is None else rows.unionByName(best.drop("place"))
        best = written(rows.withColumn("place", place).where(F.col("place") <= k), "passages-found")
    # Passages without a match follow in document order; at most k of the first 2 k - 1 are among the best.
    first = passages.orderBy("doc_id", "chunk_no").limit(2 * k).select("doc_id", "chunk_no", "chunk")
    every = first.withColumn("query", F.explode(F.array(*[F.lit(q) for q in queries])))
    rest = every.join(best.select("query", "doc_id", "chunk_no"), ["query", "doc_id", "chunk_no"], "left_anti").withColumn("score", F.lit(0).cast("bigint"))
    both = best.drop("place").unionByName(rest.select("query", "score", "doc_id", "chunk_no", "chunk"))
    return both.withColumn("place", place).where(F.col("place") <= k)


def effort(spark: SparkSession, path: str, queries: dict[str, list[str]]) -> DataFrame:
    """One row: passages stored, passages scored, posting rows stored, posting rows of the asked trigrams."""
    postings, words = spark.read.parquet(f"{path}/postings"), _words(queries)
    grams = sorted({w[i : i + GRAM] for w in words for i in range(len(w) - GRAM + 1)})
    return spark.read.parquet(f"{path}/passages").agg(F.count("*").alias("passages")).select(
        "passages", candidates(spark, path, words).agg(F.count_distinct("passage")).scalar().alias("scored"),
        postings.agg(F.count("*")).scalar().alias("posting_rows"), postings.where(F.col("gram").isin(grams)).agg(F.count("*")).scalar().alias("read_rows"),
    )
