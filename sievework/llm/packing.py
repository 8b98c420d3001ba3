"""Sum-of-squares packing of token runs into windows of a fixed length.

Each document is cut into whole windows and a rest. Rests are placed online: N[h] counts the open windows
filled to level h, and a rest of s ids goes to the level h (0: a new window) for which the sum over h of
N[h]^2 is least afterwards. Moving one window from h to h+s changes that sum by 2(N[h+s] - N[h]) + 2, or by
2 N[s] + 1 for a new window, and a window that becomes full leaves the array, so one look over the level
array decides. Ties take the fullest level. This keeps many levels lightly used, so a fitting gap is
nearly always there.

At the end of a partition, and whenever MAX_OPEN windows are open, the open windows are closed: the pieces
of the emptiest are poured, cut where needed, into the fullest. A last, partly filled window is laid out
as windows whose lengths are powers of two, which need no padding.

Every partition of the scan packs its own rows: nothing is shuffled, and the memory in use is that of the
open windows. A NULL or empty text is its end id alone. Repeated ids and NULL ids are packed as they come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import Batches, documents_of, frugal, slices
from sievework.llm.encoding import byte_level

WINDOW = 1024
MAX_OPEN = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece:
    """ids[0:] of one document, from its id number `start` on."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total


class SumOfSquares:
    """The level array and its open windows. add() yields closed windows, lists of pieces."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.open = window, max_open, 0
        self.counts = np.zeros(window + 1, np.int64)
        self.at: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level whose window a run of `size` ids should go to; 0 is a new one."""
        counts, top = self.counts, self.window - size
        after = counts[size : self.window + 1].copy()  # N[h+s] for h = 0..top
        change = 2 * (after - counts[: top + 1]) + 2
        change[top] = 1 - 2 * counts[top]  # it becomes full and leaves the array
        change[1:][counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * counts[size] + 1 if size < self.window else 0
        return top - int(np.argmin(change[::-1]))

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        size = len(piece.ids)
        if size == self.window:
            yield [piece]
            return
        level = self.level_for(size)
        if level:
            held = self.at[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            yield held
            return
        self.at[level + size].append(held)
        self.counts[level + size] += 1
        self.open += 1
        if self.open >= self.max_open:
            yield from self.close(final=False)

    def close(self, final: bool = True) -> Iterator[list[Piece]]:
        """Pour the emptiest open windows into the fullest; `final` also ends the one that is left."""
        windows = [w for level in reversed(self.at) for w in level]
        self.at = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        self.open = 0
        i, j = 0, len(windows) - 1
        while i < j:
            room = self.window - sum(len(p.ids) for p in windows[i])
            while room and i < j:
                piece = windows[j].pop()
                if len(piece.ids) > room:
                    k = len(piece.ids) - room
                    windows[j].append(Piece(piece.doc, piece.start, piece.ids[:k], piece.total))
                    piece = Piece(piece.doc, piece.start + k, piece.ids[k:], piece.total)
                windows[i].append(piece)
                room -= len(piece.ids)
                if not windows[j]:
                    j -= 1
            if not room:
                yield windows[i]
                i += 1
        for left in windows[i : j + 1]:
            fill = sum(len(p.ids) for p in left)
            if fill == self.window:
                yield left
            elif final:
                yield from powers_of_two(left, fill)
            else:
                self.at[fill].append(left)
                self.counts[fill] += 1
                self.open += 1


def powers_of_two(pieces: list[Piece], fill: int) -> Iterator[list[Piece]]:
    """The run of pieces as windows whose lengths are the binary digits of its fill, largest first."""
    rest = list(reversed(pieces))
    for bit in range(fill.bit_length() - 1, -1, -1):
        room, out = fill & (1 << bit), []
        while room:
            p = rest.pop()
            if len(p.ids) > room:
                rest.append(Piece(p.doc, p.start + room, p.ids[room:], p.total))
                p = Piece(p.doc, p.start, p.ids[:room], p.total)
            out.append(p)
            room -= len(p.ids)
        if out:
            yield out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: which ids of which document lie where in which window. with_ids adds the ids."""
    schema = T.StructType.fromDDL(SCHEMA + (", ids array<int>" if with_ids else ""))
    source = documents_of(docs, id_col, text_col).withColumn("part", F.spark_partition_id())

    def run(batches: Batches) -> Batches:
        encoder = byte_level(tokenizer_path)
        end = np.array([end_id], encoder.dtype).tobytes()
        packer, sequence = SumOfSquares(window), -1

        def rows(windows: Iterator[list[Piece]]) -> Iterator[tuple]:
            nonlocal sequence
            for pieces in windows:
                sequence += 1
                offset = 0
                for p in pieces:
                    row = (p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4")), p.total, sequence, offset)
                    yield (*row, p.ids.tolist()) if with_ids else row
                    offset += len(p.ids)

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found))
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

        for batch in batches:
            if sequence < 0 and len(batch):
                sequence = (batch.column("part")[0].as_py() << 40) - 1
            for piece in slices(batch, "text"):
                found: list[tuple] = []
                for doc, raw in zip(piece.column("doc_id").to_pylist(), encoder.encode(piece.column("text").fill_null("").to_pylist())):
                    ids = np.frombuffer(raw + end, encoder.dtype)
                    for start in range(0, len(ids), window):
                        found += rows(packer.add(Piece(doc, start, ids[start : start + window], len(ids))))
                if found:
                    yield batch_of(found)
        if found := list(rows(packer.close())):
            yield batch_of(found)

    return source.mapInArrow(frugal(run), schema)
