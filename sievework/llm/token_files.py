"""Token ids as flat files with 64-bit document offsets, written and read by memory map.

A store is a folder. Each part holds a range of ascending doc_id in three files, all little-endian:
`part-N.ids`, unsigned ids of 2 or 4 bytes, documents end to end; `part-N.off`, n+1 signed 64-bit offsets
counted over all documents of all parts; `part-N.doc`, n signed 64-bit doc_ids and then n bytes, 1 where
the doc_id is NULL. The ids of a part are written while its documents are encoded, each to a name of the
attempt, renamed when whole, so a lost or repeated task leaves one good file. The offsets need the number of ids in earlier parts:
the prefix sums of the parts' totals, one number per part, which a second pass adds to each part's lengths.

A NULL text counts as empty; every document, also an empty one, ends with the end id. NULL doc_ids come
first; rows that share a doc_id stand side by side, ordered by their text. An empty table gives a store
without parts.
"""

from __future__ import annotations

import os
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import Batches, documents_of, frugal, slices, tasks
from sievework.llm.encoding import byte_level

READ_DOCS = 20_000


def _commit(path: str, write) -> None:
    attempt = f"{path}.{uuid.uuid4().hex}"
    with open(attempt, "wb") as f:
        write(f)
    os.replace(attempt, path)


def _names(folder: str, part: int) -> list[str]:
    return [f"{folder}/part-{part:06d}.{kind}" for kind in ("ids", "off", "doc")]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, partitions: int | None = None,
          id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int]]:
    """Writes the store to a mounted shared folder. Returns (part, documents, ids) of each part."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    os.makedirs(folder, exist_ok=True)

    def encode(batches: Batches) -> Batches:
        encoder = byte_level(tokenizer_path)
        end = np.array([end_id], encoder.dtype).tobytes()
        part, names, lengths, ids, nulls = -1, [], [], [], []
        attempt, out = "", None
        try:
            for batch in batches:
                for piece in slices(batch, "text"):
                    if out is None:
                        part = piece.column("part")[0].as_py()
                        names = _names(folder, part)
                        attempt = f"{names[0]}.{uuid.uuid4().hex}"
                        out = open(attempt, "wb")  # noqa: SIM115
                    for encoded in encoder.encode(piece.column("text").to_pylist()):
                        out.write(encoded)
                        out.write(end)
                        lengths.append(len(encoded) // encoder.dtype.itemsize + 1)
                    key = piece.column("doc_id")
                    nulls.append(key.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
                    ids.append(key.fill_null(0).to_numpy().astype("<i8"))
        finally:
            if out is not None:
                out.close()
        if part < 0:
            return
        os.replace(attempt, names[0])
        _commit(names[1], lambda f: np.cumsum([0, *lengths], dtype="<i8").tofile(f))
        _commit(names[2], lambda f: (np.concatenate(ids).tofile(f), np.concatenate(nulls).tofile(f)))
        yield pa.RecordBatch.from_pydict({"part": [part], "documents": [len(lengths)], "tokens": [int(sum(lengths))]})

    ranged = (
        documents_of(docs, id_col, text_col)
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .withColumn("part", F.spark_partition_id())
    )
    written = sorted(tuple(r) for r in ranged.mapInArrow(frugal(encode), "part long, documents long, tokens long").collect())
    starts = accumulate((t for _, _, t in written), initial=0)

    def rebase(batches: Batches) -> Batches:
        for batch in batches:
            for part, base, total in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "tokens"))):
                path = _names(folder, part)[1]
                local = np.fromfile(path, "<i8")
                if local[-1] - local[0] != total:
                    raise ValueError(f"{path}: {local[-1] - local[0]} ids, {total} were written")
                _commit(path, lambda f, x=local - local[0] + base: x.tofile(f))
            yield pa.RecordBatch.from_pydict({"part": batch.column("part")})

    work = [(p, base, total) for (p, _, total), base in zip(written, starts)]
    tasks(spark, work, "part long, base long, tokens long").mapInArrow(rebase, "part long").collect()
    return written


def read(spark: SparkSession, folder: str, parts: list[int], tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files through memory maps."""
    width = byte_level(tokenizer_path).dtype

    def scan(batches: Batches) -> Batches:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                ids_path, off_path, doc_path = _names(folder, part)
                offsets = np.memmap(off_path, "<i8", "r")
                n = len(offsets) - 1
                ids = np.memmap(ids_path, width, "r")
                keys = np.memmap(doc_path, "<i8", "r", shape=(n,))
                nulls = np.memmap(doc_path, np.uint8, "r", offset=8 * n, shape=(n,))
                if len(ids) != offsets[-1] - offsets[0]:
                    raise ValueError(f"{ids_path}: its offsets are of {offsets[-1] - offsets[0]} ids, it holds {len(ids)}")
                for i in range(0, n, READ_DOCS):
                    at = np.array(offsets[i : i + READ_DOCS + 1])
                    local = (at - offsets[0]).tolist()
                    crc = [zlib.crc32(ids[b:e].astype("<u4")) for b, e in zip(local, local[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(keys[i : i + READ_DOCS]), pa.int64(), mask=np.array(nulls[i : i + READ_DOCS], bool)),
                            pa.array(at[:-1], pa.int64()),
                            pa.array(np.diff(at), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return tasks(spark, [(p,) for p in parts], "part long").mapInArrow(
        scan, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
