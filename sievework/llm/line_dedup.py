"""Repeated lines across documents, as compressed keep bitmaps instead of new texts.

A text is cut at line feeds (NULL and empty texts are one empty line). A line's key is the line without
the white space of ASCII at both ends, A-Z lower-cased. Of a key that several documents hold, the lines of
the smallest doc_id stay and all others go; keys under `least_chars` code points always stay.

Each line becomes a row of its key's 128-bit hash, its document and its place. The rows are partitioned by
ranges of (hash, document, place), so a key with a third of all rows is spread over many tasks, and sorted
inside each. One pass streams them: the first row of a hash names the document that keeps it. A task cannot
know this for the hash it begins with, so it leaves those rows open and reports the first document of the
hash it begins with and of the one it ends with; these few rows, two for a task at most, settle the open
ones. Only dropped places go on, to one bitmap for each document.

Rows with the same doc_id count as one document (their texts are told apart by fingerprint); a NULL doc_id
counts as the largest one, 2^63 - 1. Lines repeated inside a document stay, as do all lines of an empty
table's none. No text is a special case for its length; the longest list in a task is a document's lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import Batches, range_tasks
from sievework.session import cut

LEAST_CHARS = 10
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LARGEST = (1 << 63) - 1
#: What a row of the pass says: a dropped line, a line that waits for its hash's first document, such a document.
DROPPED, OPEN, EDGE = 0, 1, 2
PASS = "kind tinyint, high long, low long, doc long, mark long, pos int"
#: How a bitmap is written.
RUNS, BITS = b"\x00", b"\x01"


def _known(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _doc(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LARGEST))


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """high, low, doc, mark, pos: a row per line whose key has `least_chars` code points or more."""
    text = _known(docs[text_col])
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    # The fingerprint is taken before the lines come apart, else it would be taken of the whole text for each of them.
    marked = docs.select(_doc(docs[id_col]).alias("doc"), F.xxhash64(text).alias("mark"), F.split(lowered, "\n").alias("lines"))
    lines = marked.select("doc", "mark", F.posexplode("lines").alias("pos", "line"))
    keys = lines.select("doc", "mark", "pos", F.btrim(F.col("line"), F.lit(BLANKS)).alias("key")).where(F.char_length("key") >= least_chars)
    return keys.select(F.xxhash64("key").alias("high"), F.xxhash64(F.lit(1), "key").alias("low"), "doc", "mark", "pos")


def _stream(batches: Batches) -> Batches:
    """One sorted range of line hashes: what it drops, what it leaves open, and its two edges."""
    last: tuple[int, int, int] | None = None  # high, low and first document of the hash the last batch ended with
    runs = 0  # hashes begun so far
    for batch in batches:
        if not len(batch):
            continue
        high, low, doc, mark, pos = (batch.column(i).to_numpy() for i in range(5))
        begins = np.empty(len(batch), bool)
        begins[0] = last is None or (last[0], last[1]) != (int(high[0]), int(low[0]))
        begins[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        run = np.cumsum(begins)
        firsts = np.concatenate([np.array([last[2] if last else 0], np.int64), doc[begins]])
        first, number = firsts[run], run + runs
        kind = np.where(number == 1, OPEN, np.where(doc != first, DROPPED, -1))
        out = [kind, high, low, doc, mark, pos]
        keep = kind >= 0
        if runs == 0:
            yield _rows([EDGE], high[:1], low[:1], doc[:1], [0], [0])
        if keep.any():
            yield _rows(*[x[keep] for x in out])
        last, runs = (int(high[-1]), int(low[-1]), int(first[-1])), int(number[-1])
    if last is not None and runs > 1:
        yield _rows([EDGE], *[[x] for x in last], [0], [0])


def _rows(kind, high, low, doc, mark, pos) -> pa.RecordBatch:
    kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip((np.asarray(kind, np.int8), high, low, doc, mark, pos), kinds)], ["kind", "high", "low", "doc", "mark", "pos"]
    )


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, mark, pos: the lines that go (a row that repeats with its id and text gives its lines twice)."""
    lines = line_hashes(docs, least_chars, id_col, text_col)
    order = ["high", "low", "doc", "pos"]
    n = range_tasks(docs, docs[text_col])
    passed = cut(lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_stream, PASS))
    # Two rows a task at most, so their number is that of the ranges.
    edges = passed.where(F.col("kind") == EDGE).groupBy("high", "low").agg(F.min("doc").alias("first"))
    settled = passed.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["high", "low"]).where("doc <> first")
    return passed.where(F.col("kind") == DROPPED).select("doc", "mark", "pos").unionByName(settled.select("doc", "mark", "pos"))


def encode(places: Sequence[int]) -> bytes:
    """The bitmap of the lines that stay, given the places of those that go.

    Lengths of alternating runs, the first of lines that stay, seven bits to a byte; or plain bits, one for
    a line that goes, where these are shorter. Lines after the last one that goes are not written.
    """
    gone = np.unique(np.asarray(places, np.int64))
    if not len(gone):
        return RUNS
    breaks = np.flatnonzero(np.diff(gone) > 1) + 1
    begins, ends = gone[np.r_[0, breaks]], gone[np.r_[breaks - 1, len(gone) - 1]] + 1
    out = bytearray(RUNS)
    for length in np.diff(np.r_[0, np.column_stack([begins, ends]).ravel()]).tolist():
        while length > 127:
            out.append(length & 127 | 128)
            length >>= 7
        out.append(length)
    if len(out) <= gone[-1] // 8 + 2:
        return bytes(out)
    bits = np.zeros(int(gone[-1]) + 1, np.uint8)
    bits[gone] = 1
    return BITS + np.packbits(bits).tobytes()


def decode(keep: bytes, lines: int) -> np.ndarray:
    """Whether each of so many lines stays."""
    stays = np.ones(lines, bool)
    if keep[:1] == BITS:
        gone = np.unpackbits(np.frombuffer(keep, np.uint8, offset=1))[:lines]
        stays[: len(gone)] = gone == 0
        return stays
    at = shift = length = 0
    kept = True
    for byte in keep[1:]:
        length |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            if not kept:
                stays[at : at + length] = False
            at, kept, length, shift = at + length, not kept, 0, 0
    return stays


@F.pandas_udf(T.BinaryType())
def _encoded(places: pd.Series) -> pd.Series:
    return places.map(encode)


def _judged(docs: DataFrame, least_chars: int, id_col: str, text_col: str) -> DataFrame:
    """row (a row of docs as a struct, so that its columns cannot clash), n_lines, n_dropped, keep."""
    gone = (
        dropped_lines(docs, least_chars, id_col, text_col).groupBy("doc", "mark").agg(F.collect_set("pos").alias("places"))
        .select("doc", "mark", F.size("places").cast("long").alias("n_dropped"), _encoded("places").alias("keep"))
    )
    text = _known(docs[text_col])
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), n_lines.cast("long").alias("n_lines"),
        _doc(docs[id_col]).alias("doc"), F.xxhash64(text).alias("mark"),
    )
    n_dropped = F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped")
    return rows.join(gone, ["doc", "mark"], "left").select("row", "n_lines", n_dropped, "keep")


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, keep: a row per row of docs. keep is NULL where all lines stay."""
    return _judged(docs, least_chars, id_col, text_col).select(F.col("row")[id_col].alias("doc_id"), "n_lines", "n_dropped", "keep")


def with_keep(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As keep_bitmaps, with the text beside the bitmap, for those who apply it."""
    row = F.col("row")
    return _judged(docs.select(id_col, text_col), least_chars, id_col, text_col).select(
        row[id_col].alias("doc_id"), "n_lines", "n_dropped", "keep", row[text_col].alias("text")
    )


@F.pandas_udf(T.StringType())
def _without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, keeps in parts:
        out = []
        for text, keep in zip(texts, keeps):
            if keep is None:
                out.append(None)
                continue
            lines = text.split("\n")
            out.append("\n".join([line for line, stays in zip(lines, decode(keep, len(lines)).tolist()) if stays]))
        yield pd.Series(out, dtype=object)


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that stay, joined by line feeds; a NULL text is empty. Only texts that lose lines reach Python."""
    return F.coalesce(_without(F.when(keep.isNotNull(), _known(text)), keep), _known(text))


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that go taken out of its texts; texts that lose nothing are as they were."""
    row, keep = F.col("row"), F.col("keep")
    new = F.when(keep.isNull(), row[text_col]).otherwise(kept_text(row[text_col], keep))
    return _judged(docs, least_chars, id_col, text_col).select(*[(new if c == text_col else row[c]).alias(c) for c in docs.columns])
