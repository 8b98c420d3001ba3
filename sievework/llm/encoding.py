"""Byte-level BPE over many texts: encode each distinct word once, then join the stored ids.

A byte-level vocabulary splits text before it merges, and no merge crosses such a split. A single space
or line feed between two characters that are not white space is always one, so the text can be cut there
and the ids of the parts laid side by side. Words repeat, so most parts are found in a table. Texts with
other white space, and vocabularies of another kind, take the slower ways below; the ids are the
library's own in every case. Memory is that of a batch of texts and of two generations of known words.
"""

from __future__ import annotations

import gc
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

BLANKS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
IRREGULAR = (*BLANKS, "  ", " \n", "\n ", "\n\n")
_CUT = re.compile(rf"(?<=[^\s{BLANKS}]) (?=[^\s{BLANKS}])")
#: ASCII marks. An apostrophe is cut off with letters after it, and a run of marks at a part's end has none.
MARKS = r"[!-/:-@\[-`{-~]"
#: A part that is a run of letters, with the space before it or not, and a run of marks: one run each to the merges.
_RUNS = rf"^(?P<word> ?\pL+)(?P<marks>{MARKS}*)$"

LONG_PIECE = 64
#: Bytes a generation of known pieces may take, and what an entry takes beside its piece and its ids.
CACHE_BYTES, ENTRY_BYTES = 40 << 20, 220
BATCH_CHARS = 4_000_000


class Pieces:
    """piece -> ids, in two generations: what the last two fillings have met is known, the rest is forgotten."""

    def __init__(self):
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def get(self, pieces: list[str], learn) -> list[bytes]:
        """The ids of each piece (all different); learn gives those of the unknown ones."""
        found = list(map(self.young.get, pieces))
        missing = [p for p, ids in zip(pieces, found) if ids is None]
        if missing:
            again = list(map(self.old.get, missing))
            new = [p for p, ids in zip(missing, again) if ids is None]
            fresh = iter(learn(new))
            late = [next(fresh) if ids is None else ids for ids in again]
            rest = iter(late)
            found = [next(rest) if ids is None else ids for ids in found]
            if self.size > CACHE_BYTES:
                self.old, self.young, self.size = self.young, {"": b""}, 0
            self.young.update((p, ids) for p, ids in zip(missing, late) if len(p) <= LONG_PIECE)
            self.size += sum(map(len, missing)) + sum(map(len, late)) + ENTRY_BYTES * len(missing)
        return found


class ByteLevelEncoder:
    """ids of whole texts as little-endian bytes, 2 or 4 to an id, without added special tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            self.by_word = _splits_at_spaces(json.load(f))
        self.feed = self.ids(["\n"])[0]
        self.pieces = Pieces()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text (an empty text has none)."""
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word or len(self.feed) != self.dtype.itemsize:
            return self.ids(texts)
        out: list[bytes] = []
        begin = size = 0
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the lists are long
        try:
            for end, text in enumerate(texts, 1):
                size += len(text)
                if size >= BATCH_CHARS or end == len(texts):
                    out += self._encode(texts[begin:end])
                    begin, size = end, 0
        finally:
            if collects:
                gc.enable()
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        # A text with irregular white space keeps its line feeds inside its parts.
        odd = {i: parts for i, t in enumerate(texts) if (parts := _irregular_units(t))}
        # A part that begins with a line feed stands at the start of a line; any other follows a space, which is encoded with it.
        plain = pa.array(["" if i in odd else ("\n" + t).replace("\n", " \n")[1:] for i, t in enumerate(texts)], pa.large_string())
        cut = pc.split_pattern(plain, " ")
        coded = cut.values.dictionary_encode()
        codes = coded.indices.to_numpy()
        flat, begins, sizes = self._parts(coded.dictionary)
        lengths = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        width = self.dtype.itemsize
        whole = _gathered(flat, begins[codes], lengths, ends).tobytes()
        bounds = (ends[cut.offsets.to_numpy()] * width).tolist()
        lead = len(self.feed)  # the line feed put before the text
        found = iter(self._others([u for parts in odd.values() for u in parts]))
        return [b"".join([next(found) for _ in odd[i]])[lead:] if i in odd else whole[b + lead : e] for i, (b, e) in enumerate(zip(bounds, bounds[1:]))]

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all distinct parts in a row, where each part's begin, and how many it has."""
        at_line = pc.starts_with(parts, "\n")
        spaced = pc.if_else(at_line, pc.utf8_slice_codeunits(parts, 1), pc.binary_join_element_wise(pa.scalar("", parts.type), parts, pa.scalar(" ", parts.type)))
        runs = pc.extract_regex(spaced, _RUNS)
        regular = runs.is_valid().to_numpy(zero_copy_only=False)
        word, marks = (runs.field(i).filter(pa.array(regular)).dictionary_encode() for i in (0, 1))
        # By way of NumPy: to_pylist makes a scalar of each.
        words, ends = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (word, marks))
        empty = np.flatnonzero(~regular).tolist()
        others = [parts[i].as_py() for i in empty]
        # Every run of ids a part is made of: none, a line feed, the words, the marks, the other parts.
        pool = [b"", self.feed, *self.pieces.get(words, self._learn), *self.pieces.get(ends, self._learn), *self._others(others)]
        sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // self.dtype.itemsize
        begins = np.cumsum(sizes) - sizes
        made = np.zeros((len(parts), 3), np.int64)
        made[regular, 0] = at_line.to_numpy(zero_copy_only=False)[regular]
        made[regular, 1] = word.indices.to_numpy().astype(np.int64) + 2
        made[regular, 2] = marks.indices.to_numpy().astype(np.int64) + 2 + len(words)
        made[~regular, 1] = np.arange(len(others)) + 2 + len(words) + len(ends)
        runs_of = made.ravel()
        lengths = sizes[runs_of]
        stops = np.concatenate([[0], np.cumsum(lengths)])
        flat = _gathered(np.frombuffer(b"".join(pool), self.dtype), begins[runs_of], lengths, stops)
        return flat, stops[:-1:3], lengths.reshape(-1, 3).sum(1)

    def _others(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that are not words and marks, by the library's own cutting; an empty part has none."""
        distinct = list(dict.fromkeys(parts))
        ids = self.ids([u[1:] if u[:1] == "\n" else " " + u for u in distinct])
        known = {u: (self.feed + x if u[:1] == "\n" else x if u else b"") for u, x in zip(distinct, ids)}
        return [known[u] for u in parts]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of runs that the merges work on whole."""
        if not pieces:
            return []
        tokenize, flat, ends = self.tokenizer.model.tokenize, [], []
        for letters in "\n".join(pieces).encode().decode("latin-1").translate(_BYTE_LETTERS).split("\n"):
            flat += [t.id for t in tokenize(letters)]
            ends.append(len(flat))
        raw, width = np.array(flat, self.dtype).tobytes(), self.dtype.itemsize
        return [raw[i * width : j * width] for i, j in zip([0, *ends], ends)]


def _gathered(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The runs of flat that begin and are as long as said, side by side; ends: 0 and where each run ends there."""
    return flat[np.arange(ends[-1]) + np.repeat(begins - ends[:-1], lengths)]


def _irregular_units(text: str) -> list[str] | None:
    """The parts of a text with white space other than single spaces and line feeds, a line feed put before
    it; None if the text has none such."""
    if text and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in IRREGULAR):
        return None
    parts = _CUT.split(text)
    return ["\n" + parts[0], *parts[1:]]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else
    the next one from 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: A line feed stands between pieces and stays what it is.
_BYTE_LETTERS = {b: c for b, c in _byte_letters().items() if b != 10}


def _splits_at_spaces(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", False)
        and not pre.get("add_prefix_space", True)
        and not spec["model"].get("dropout")
        and not any(re.search(rf"\s|^[^\W\d_]*{MARKS}*$", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
    )


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevelEncoder:
    """One encoder for each Python worker, so its word table serves many tasks."""
    return ByteLevelEncoder(path)
