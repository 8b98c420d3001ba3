"""Token counts at every prefix of a text, for a SentencePiece BPE model, stored once.

Pieces of such a model hold the space mark only at their start and no line feed, so the tokens of a text
are those of its parts: a run of spaces with the word after it, or a line feed with the word after it.
Inside a part the counts come from a recurrence over its prefixes: the last token of a prefix is the one
piece that the merges leave standing beside the last token of the prefix before it, and adds 1 to its count.
Whether two neighbouring pieces are left standing the library says once for each pair; nothing else is
encoded, whatever its length. A distinct part is worked out once and kept for two fillings of a bounded table.

What is stored is `steps`, a signed byte per character: what the character adds to the count of the prefix
before it (a longer prefix may have fewer tokens). The count of any prefix, the count of the text, and the
longest prefix within a budget are sums over it: they follow from the table, without the text.

A NULL text counts as empty, an empty text has no parts and 0 tokens. Rows are kept as they come: repeated
ids and NULL ids give a row each. Whole texts are read, however long.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Batches, documents_of, frugal, slices
from sievework.llm.encoding import Pieces

MARK = "▁"
#: Pairs of pieces a generation may hold; bytes of text worked on at once.
CACHE_PAIRS = 150_000
SLICE = 4 << 20
SCHEMA = "doc_id long, n_bytes long, n_tokens long, steps binary"
_PARTS = re.compile(r"\n[^ \n]*|[ ]*[^ \n]+|[ ]+")


class PieceCounter:
    """Tokens of the prefixes of parts. A part at the start of a text has the model's own leading space."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        probe = " ﬁ Ａ  x\n ́ "
        self.by_part = (
            self.model.normalize(probe) == MARK + probe.replace(" ", MARK)
            and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
            and not any(self.model.is_unused(i) for i in range(len(pieces)))
        )
        special = [f(i) for f in (self.model.is_control, self.model.is_unknown, self.model.is_byte) for i in range(len(pieces))]
        self.pieces = {p for i, p in enumerate(pieces) if not any(special[i :: len(pieces)])}
        self.longest = max(map(len, self.pieces), default=0)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.older: dict[tuple[str, str], bool] = {}
        self.known = Pieces()

    def stand(self, pair: tuple[str, str]) -> bool:
        """Whether the merges leave two neighbouring pieces as they are."""
        found = self.older.get(pair)
        if found is None:
            # A line feed before them keeps the model's own space away.
            out = self.model.encode("\n" + (pair[0] + pair[1]).replace(MARK, " "), out_type=str)
            found = out[-2:] == [pair[0], pair[1]]
        if len(self.pairs) > CACHE_PAIRS:
            self.older, self.pairs = self.pairs, {}
        self.pairs[pair] = found
        return found

    def along(self, parts: list[str]) -> list[bytes]:
        """What each character of a part adds to the tokens of the part's prefix before it, in time linear in its length.

        Parts are taken in order, so a part goes on from the prefix it shares with the one before it.
        """
        pieces, pairs, longest = self.pieces, self.pairs, self.longest
        last: list[str | None] = [None]  # the last token of each prefix; None: nothing, or bytes of an unknown character
        counts, done, before = [0], {}, ""
        for part in sorted(parts):
            marked = part.replace(" ", MARK)
            shared = 0
            for x, y in zip(before, marked):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], counts[shared + 1 :]
            before = marked
            for i in range(shared + 1, len(marked) + 1):
                for j in range(i - longest if i > longest else 0, i):
                    piece = marked[j:i]
                    if piece in pieces:
                        beside = last[j]
                        if beside is not None:
                            stands = pairs.get((beside, piece))
                            if stands is None:
                                stands = self.stand((beside, piece))
                                pairs = self.pairs
                            if not stands:
                                continue
                        last.append(piece)
                        counts.append(counts[j] + 1)
                        break
                else:
                    last.append(None)
                    counts.append(counts[i - 1] + len(marked[i - 1].encode()))
            try:
                done[part] = array("b", map(sub, counts[1:], counts)).tobytes()
            except OverflowError as e:
                raise ValueError("a character of this model changes the count by more than a byte holds") from e
        return [done[p] for p in parts]

    def steps(self, parts: list[str]) -> list[bytes]:
        """As `along`, for parts that all differ; those met before are not worked out again."""
        return self.known.get(parts, self.along)

    def cut(self, text: str) -> list[str]:
        """The parts of a text with the model's leading space put before it."""
        return _PARTS.findall(" " + text.replace(MARK, " ")) if text else []

    def count(self, parts: list[str]) -> list[int]:
        """Tokens of each part."""
        distinct = list(dict.fromkeys(parts))
        known = {p: sum(array("b", s)) for p, s in zip(distinct, self.steps(distinct))}
        return [known[p] for p in parts]


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    counter = PieceCounter(path)
    if not counter.by_part:
        raise ValueError("this model's pieces cross spaces or line feeds, so counts of parts do not add up")
    return counter


def prefix_arrays(counter: PieceCounter, texts: list[str]) -> list[tuple[list[int], list[int]]]:
    """(where parts end in characters, tokens up to there) of each text."""
    out = []
    for text in texts:
        parts = counter.cut(text)
        ends = (np.cumsum([len(p) for p in parts], dtype=np.int64) - 1).tolist()  # the leading space is not of the text
        out.append((ends, np.cumsum(counter.count(parts), dtype=np.int64).tolist()))
    return out


def prefix_steps(counter: PieceCounter, texts: list[str]) -> list[bytes]:
    """What each character of a text adds to the tokens of the prefix before it, a signed byte each."""
    # With single spaces only, and none beside a line feed or at an end, parts are what lies between spaces.
    spaced = [" " + t.replace(MARK, " ") if t else "" for t in texts]
    odd = {i: _PARTS.findall(t) for i, t in enumerate(spaced) if "  " in t or " \n" in t or t[-1:] == " "}
    split = pc.split_pattern(pa.array(["" if i in odd else t.replace("\n", " \n")[1:] for i, t in enumerate(spaced)], pa.large_string()), " ")
    coded = split.values.dictionary_encode()
    parts = [u if u[:1] == "\n" or not u else " " + u for u in coded.dictionary.to_pylist()]
    others = list({p for found in odd.values() for p in found}.difference(parts))
    known = dict(zip(filled := [p for p in parts if p] + others, counter.steps(filled)))
    table = [known.get(p, b"") for p in parts]
    sizes = np.fromiter(map(len, table), np.int64, len(table))
    codes = coded.indices.to_numpy()
    bounds = np.concatenate([[0], np.cumsum(sizes[codes])])[split.offsets.to_numpy()].tolist()
    whole = b"".join([table[c] for c in codes.tolist()])
    return [
        _without_lead(b"".join([known[p] for p in odd[i]]) if i in odd else whole[b:e]) for i, (b, e) in enumerate(zip(bounds, bounds[1:]))
    ]


def _without_lead(steps: bytes) -> bytes:
    """The leading space is not of the text: what it adds, the first character does."""
    return ((steps[0] + steps[1]) & 255).to_bytes() + steps[2:] if steps else b""


def prefix_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, steps: to be stored, a row per document, without a shuffle."""

    def run(batches: Batches) -> Batches:
        counter = piece_counter(model_path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                text = part.column("text").fill_null("")
                steps = pa.array(prefix_steps(counter, text.to_pylist()), pa.binary())
                tokens = [int(np.frombuffer(s.as_buffer(), np.int8).sum(dtype=np.int64)) if s.as_buffer() else 0 for s in steps]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(tokens, pa.int64()), steps],
                    ["doc_id", "n_bytes", "n_tokens", "steps"],
                )

    return documents_of(docs, id_col, text_col).mapInArrow(frugal(run), SCHEMA)


def totals(table: DataFrame, limit: int) -> DataFrame:
    """Tokens of the whole text, and whether they are more than limit."""
    n = F.col("n_tokens")
    return table.select("doc_id", "n_bytes", "n_tokens", (n > limit).alias("over_limit"))


def within_budget(table: DataFrame, budget: int, keep: list[str] | None = None) -> DataFrame:
    """doc_id, kept_chars, kept_tokens (and columns to keep): the longest prefix, in characters, of at most budget tokens."""
    keep = keep or []
    fields = [table.schema[c] for c in ("doc_id", *keep)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", kept_chars long, kept_tokens long"

    def run(batches: Batches) -> Batches:
        for batch in batches:
            chars, tokens = [], []
            for steps in batch.column("steps"):
                counts = np.cumsum(np.frombuffer(steps.as_buffer(), np.int8), dtype=np.int64) if steps.as_buffer() else np.zeros(0, np.int64)
                fits = np.flatnonzero(counts <= budget)
                chars.append(int(fits[-1]) + 1 if len(fits) else 0)
                tokens.append(int(counts[fits[-1]]) if len(fits) else 0)
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], [f.name for f in fields] + ["kept_chars", "kept_tokens"])

    return table.select("doc_id", *keep, "steps").mapInArrow(run, schema)


def tokens_of_prefix(counter: PieceCounter, text: str, ends: list[int], counts: list[int], chars: int) -> int:
    """Tokens of text[:chars] by the arrays of `prefix_arrays`; only the part that chars falls into is looked at."""
    if chars <= 0:
        return 0
    k = bisect_right(ends, chars)
    done, at = (counts[k - 1], ends[k - 1]) if k else (0, 0)
    if k == len(ends) or at == chars:
        return done
    rest = (" " if at == 0 else "") + text[at:chars].replace(MARK, " ")
    return done + sum(counter.count(_PARTS.findall(rest)))
