"""SimHash fingerprints, linked within a bit distance by pigeonring filtering.

Fingerprint: ASCII capitals are lower-cased, words are runs of characters other than space and 0x09-0x0D,
shingles are `words` consecutive words joined by a space (a text with fewer words is one shingle), each
hashed by XXH64 of its UTF-8 bytes. A bit is set if it is set in more than half of the hashes, repeats
included. No words, or a NULL text: fingerprint 0, linked like any other.

Pigeonring (Qin and Xiao 2018): the 64 bits are a ring of k+1 segments. If two fingerprints differ in at
most k bits, some segment starts a chain of which every prefix of l segments differs in at most
l*k/(k+1) bits: the first segment is equal, the first two differ in one bit at most, and so on. So a
fingerprint is stored under (its segment i, the one after it) for each i, and looked up under those keys
and under each key with one set bit of the second segment cleared: of two keys a bit apart, one is the
other with a bit cleared. That is about 36 look-ups of 16 bytes for k = 3, however many documents there are. The longer
prefixes are checked on what is found, the full distance last.

Equal fingerprints form a class first; links are sought between classes only, so copies are never paired.
NULL doc_ids belong to their class and are no one's component_id unless all of a component are NULL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Batches, components, documents_of, frugal, slices
from sievework.session import cut

BITS = 64
RUN = 100_000


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    digest, layout = xxhash.xxh64_intdigest, b" ".join([b"%b"] * words)
    total, n = np.zeros(BITS, np.int64), len(parts) - words + 1
    for i in range(0, n, RUN):
        run = parts[i : i + RUN + words - 1]
        hashes = np.array([digest(layout % s, seed) for s in zip(*(run[k:] for k in range(words)))], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); a row per document."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [fingerprint(t, words, seed) for t in part.column("text").fill_null("").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"]
                )

    return documents_of(docs, id_col, text_col).mapInArrow(frugal(run), "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


class Ring:
    """The 64 bits as k+1 segments, and the masks of the chains of segments that start at each."""

    def __init__(self, max_bits: int):
        n = max_bits + 1
        edges = [BITS * i // n for i in range(n + 1)]
        self.k, self.n = max_bits, n
        self.offsets, self.widths = edges[:-1], [b - a for a, b in zip(edges, edges[1:])]

    def segment(self, fp: Column, i: int) -> Column:
        i %= self.n
        return F.shiftrightunsigned(fp, self.offsets[i]).bitwiseAND(F.lit((1 << self.widths[i]) - 1).cast("long"))

    def chain_mask(self, i: int, length: int) -> int:
        return sum(((1 << self.widths[j % self.n]) - 1) << self.offsets[j % self.n] for j in range(i, i + length))

    def key(self, i: int, first: Column, second: Column) -> Column:
        """The start in the top bits, a hash of both segments below; a clash is found out by the checks."""
        low = F.xxhash64(first, second).bitwiseAND(F.lit((1 << 58) - 1))
        return low.bitwiseOR(F.lit(_signed(i << 58)))

    def cleared_keys(self, i: int, first: Column, second: Column, width: int) -> Column:
        """The keys with one set bit of the second segment cleared."""
        bits = F.array(*[F.lit(1 << b).cast("long") for b in range(width)])
        return F.transform(F.filter(bits, lambda bit: second.bitwiseAND(bit) != 0), lambda bit: self.key(i, first, second - bit))

    def viable(self, key: Column, a: Column, b: Column) -> Column:
        """Every prefix of the chain that starts where the key says is within its share of k."""
        start, diff = F.shiftrightunsigned(key, 58), a.bitwiseXOR(b)
        chains = F.lit(False)
        for i in range(self.n):
            ok = start == i
            for length in range(1, self.n + 1):
                ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(_signed(self.chain_mask(i, length))))) <= length * self.k // self.n)
            chains = chains | ok
        return chains


def links(classes: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b), a < b: pairs of different fingerprints `fp` within max_bits, each once."""
    if not 0 <= max_bits < 32:
        raise ValueError("max_bits is from 0 to 31")
    if max_bits == 0:
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    ring, fp = Ring(max_bits), F.col("fp")
    stored, asked = [], []
    for i in range(ring.n):
        first, second, width = ring.segment(fp, i), ring.segment(fp, i + 1), ring.widths[(i + 1) % ring.n]
        stored.append(ring.key(i, first, second))
        asked.append(F.concat(F.array(ring.key(i, first, second)), ring.cleared_keys(i, first, second, width)))
    by_key = classes.select(F.col("fp").alias("a"), F.explode(F.array(*stored)).alias("key"))
    lookups = classes.select(F.col("fp").alias("b"), F.explode(F.concat(*asked)).alias("key"))
    found = by_key.join(lookups, "key").where(F.col("a") != F.col("b")).where(ring.viable(F.col("key"), F.col("a"), F.col("b")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(docs: DataFrame, max_bits: int = 3, words: int = 3, seed: int = 42,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id, group (the smallest fp of the component): a row per document."""
    rows = cut(fingerprints(docs, words, seed, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(classes.select("fp"), max_bits))
    placed = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    placed = cut(placed)
    smallest = cut(placed.groupBy("group").agg(F.min("least").alias("component_id")))
    by_fp = cut(placed.join(smallest, "group").select("fp", "component_id", "group"))
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id", "group")


def one_of_each(docs: DataFrame, max_bits: int = 3, words: int = 3, seed: int = 42,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group the row with the smallest doc_id (NULL last).

    A row is known by its doc_id. Where ids repeat or are NULL, by its fingerprint as well, and of rows that
    agree in both the least one stays; only those rows are fingerprinted again and grouped with their texts.
    """
    groups = cut(grouped(docs, max_bits, words, seed, id_col, text_col))
    least = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k"))
    chosen = cut(least.select(F.col("k.doc_id").alias("_id"), F.col("k.fp").alias("_fp")))
    unclear = cut(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id")))
    own = docs[id_col].cast("long")
    if unclear.isEmpty():
        return docs.join(chosen, own == F.col("_id"), "left_semi")
    clear = docs.join(unclear, own.eqNullSafe(F.col("_id")), "left_anti").join(chosen, own == F.col("_id"), "left_semi")

    @F.pandas_udf("long")
    def again(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts.fillna("")], np.uint64).view(np.int64))

    several = docs.join(unclear, own.eqNullSafe(F.col("_id")), "left_semi").select(
        F.struct(*docs.columns).alias("_row"), docs[id_col].cast("long").alias("_own"), again(docs[text_col].cast("string")).alias("_print")
    )
    held = several.join(chosen, several["_own"].eqNullSafe(chosen["_id"]) & (several["_print"] == chosen["_fp"]), "left_semi")
    return clear.unionByName(held.groupBy("_own", "_print").agg(F.min("_row").alias("_row")).select("_row.*"))


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
