"""Shards, token files, packing and prefix counts against brute force and by exact round trips."""

import string
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import hilbert, packing, prefix_counts, token_files
from sievework.llm.common import components, shared_folder, with_prefix_sums
from sievework.llm.encoding import ByteLevelEncoder, byte_level

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", "a b", "a  b", " lead", "trail ", "it's, we're fine", "x <|endoftext|> y", "a\n b", "tab\there ", "\n", "\n\n", "a\nb.\n\nc",
    "é b c", "don't!! 's", "日本 語。", "a\r\nb", "▁a ▁b▁", "foo |bar| baz", "x" * 5000, "one two three " * 3000, "<s> x</s>", "a　b\x00c", " \n x",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, shard string"


def table(spark, texts=TEXTS):
    """Repeated and NULL ids, and columns that clash with the operators' own names."""
    rows = [(None if i == 3 else i // 2 * 2, t, ["en", None, "de"][i % 3], f"src{i % 4}", len(t or ""), i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def ids_of(text):
    return np.array(Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def crc(text):
    return zlib.crc32(ids_of(text).tobytes())


def test_encoder_equals_the_library():
    whole = Tokenizer.from_file(BPE)
    texts = [t or "" for t in TEXTS] * 2
    encoder = byte_level(BPE)
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_with_any_marks_are_encoded_once(monkeypatch):
    whole, encoder = Tokenizer.from_file(BPE), ByteLevelEncoder(BPE)
    texts = [f"word{a}{b} Été{b}\nsay{a}s's {a}s dogs'{a} {b}\n{b} it{b}ll" for a in string.punctuation for b in string.punctuation]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    # Runs of letters and then of marks are not left to the library's own cutting.
    asked, ids = [], encoder.ids
    monkeypatch.setattr(encoder, "ids", lambda texts: asked.extend(texts) or ids(texts))
    encoder.encode([f"word{a}{b} Été{b}\nsay{a}\nman{b}'" for a in string.punctuation for b in string.punctuation])
    assert not asked


@pytest.mark.parametrize("token", ["***", "ab.", "a"])
def test_added_tokens_that_look_like_words_or_marks(tmp_path, token):
    whole = Tokenizer.from_file(BPE)
    whole.add_tokens([token])
    whole.save(path := str(tmp_path / "more.json"))
    encoder, texts = ByteLevelEncoder(path), ["x*** ab. xab.* a\na**** ***", "xab."]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, law):
    docs = table(spark, [t for t in TEXTS if t is None or len(t) < 100] * 9)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    got = hilbert.shard(docs, ["lang", "source", "n_chars", "doc_id"], 4, law, size=size).collect()
    assert len(got) == docs.count()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert all(slots == list(range(len(slots))) for slots in by.values())
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        sums = [sum(r.size for r in got if r.shard == s) for s in range(4)]
        assert max(abs(s - sum(sums) / 4) for s in sums) <= max(r.size for r in got)
    order = sorted((r.shard, r.slot, r.cell) for r in got)
    assert [c for *_, c in order] == sorted(c for *_, c in order)


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.indices([1 << bits] * dims).reshape(dims, -1)
        order = np.argsort(hilbert.hilbert_index(list(grid), bits))
        assert (np.abs(np.diff(grid[:, order], axis=1)).sum(0) == 1).all()


def test_shards_of_an_empty_table(spark):
    assert hilbert.shard(table(spark).limit(0), ["lang", "n_chars"], 4).count() == 0


def test_prefix_sums_with_ties(spark):
    df = spark.createDataFrame([(i % 2, 3) for i in range(50)] + [(None, None)], "k long, w long")
    got = sorted(with_prefix_sums(df, ["k"], {"before": "w"}).collect(), key=lambda r: (r.k is not None, r.k, r.before))
    assert got[0].before == 0 and [r.before for r in got[1:]] == [3 * i for i in range(50)]


def test_token_files_round_trip(spark):
    docs, folder = table(spark), shared_folder(spark, "test-tokens")
    parts = token_files.write(docs, folder, BPE)
    got = sorted(token_files.read(spark, folder, [p for p, _, _ in parts], BPE).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(ids_of(r.text)), crc(r.text)) for r in docs.collect())
    assert sorted((k, r.n_tokens, r.ids_crc32) for k, r in zip(keys, got)) == want


def test_token_files_of_an_empty_table(spark):
    folder = shared_folder(spark, "test-tokens")
    assert token_files.write(table(spark).limit(0), folder, BPE) == []
    assert token_files.read(spark, folder, [], BPE).count() == 0


def test_packing_keeps_every_id_once(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 100] * 30 + TEXTS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.pack(docs, BPE, window=64, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, text in enumerate(texts):
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert sum([p.ids for p in own], []) == ids_of(text).tolist()
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert all(p.doc_tokens == len(ids_of(text)) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in own)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        fill = sum(p.length for p in own)
        assert fill == 64 or fill < 64 and fill & (fill - 1) == 0


def test_packing_takes_the_level_of_least_squares():
    rng = np.random.default_rng(5)
    packer = packing.SumOfSquares(32, max_open=10_000)
    for i in range(400):
        size = int(rng.integers(1, 32))
        def after(level):
            counts = packer.counts.copy()
            if level:
                counts[level] -= 1
            if level + size < 32:
                counts[level + size] += 1
            return int((counts.astype(int) ** 2).sum())
        level = packer.level_for(size)
        allowed = [h for h in range(33 - size) if h == 0 or packer.counts[h]]
        assert level in allowed and after(level) == min(map(after, allowed))
        list(packer.add(packing.Piece(i, 0, np.zeros(size, "<u2"), size)))
    assert packer.open == packer.counts.sum()


def test_prefix_counts_at_every_prefix():
    counter = prefix_counts.piece_counter(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in TEXTS if t is not None and len(t) < 100]
    for text, (ends, counts) in zip(texts, prefix_counts.prefix_arrays(counter, texts)):
        for chars in range(len(text) + 1):
            assert prefix_counts.tokens_of_prefix(counter, text, ends, counts, chars) == len(model.encode(text[:chars])), (text, chars)


def test_prefix_table(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = table(spark)
    stored = prefix_counts.prefix_table(docs, PIECES)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in prefix_counts.totals(stored, 100).collect())
    sizes = [(r.doc_id or -1, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect()]
    assert got == sorted((*s, s[2] > 100) for s in sizes)
    assert all(r.kept_tokens <= 10 for r in prefix_counts.within_budget(stored, 10).collect())
    assert prefix_counts.prefix_table(docs.limit(0), PIECES).count() == 0


SPACELESS = [
    "天地玄黄宇宙洪荒" * 20, "これは空白のない長い文章です。" * 9, "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0NTY3ODkwYWJjZGVm" * 4, "aaaa" * 50, "ab" * 99 + "é𝄞x" * 9,
    " " * 150 + "x", "\n" + "y" * 120 + "\n\nz", "=" * 90 + "internationalization" * 5, "a lead " + "unbelievablelonghouse" * 6 + " and more\nwords",
]


def test_steps_at_every_prefix():
    counter = prefix_counts.piece_counter(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in TEXTS if t is not None and len(t) < 100] + SPACELESS
    for text, steps in zip(texts, prefix_counts.prefix_steps(counter, texts)):
        want = [len(model.encode(text[: i + 1])) for i in range(len(text))]
        assert np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64).tolist() == want, text


@pytest.mark.parametrize("budget", [0, 1, 7, 40])
def test_the_longest_prefix_within_a_budget(spark, budget):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in TEXTS if t is None or len(t) < 100] + SPACELESS
    stored = prefix_counts.prefix_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES)
    for r in prefix_counts.within_budget(stored, budget).collect():
        text = texts[r.doc_id] or ""
        counts = [len(model.encode(text[:i])) for i in range(len(text) + 1)]
        kept = max(i for i, n in enumerate(counts) if n <= budget)
        assert (r.kept_chars, r.kept_tokens) == (kept, counts[kept]), text


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (5, 5)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 201 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(31)} | {200 + i: 200 for i in range(41)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_counts_of_the_query(spark, sf_dir):
    """Every row of op10, and what its budget keeps, against the library on whole texts and prefixes."""
    from sievework.llm.queries import QUERIES, TOKEN_LIMIT

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    cut = 0
    for r in QUERIES["op10_prefix_counts"](spark, sf_dir).collect():
        text = texts.pop(r.doc_id)
        n = len(model.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > TOKEN_LIMIT)
        assert r.kept_tokens == len(model.encode(text[: r.kept_chars])) <= TOKEN_LIMIT
        if r.over_limit:
            cut += 1
            assert all(len(model.encode(text[: r.kept_chars + i])) > TOKEN_LIMIT for i in range(1, 4))
        else:
            assert r.kept_chars == len(text)
    assert not texts


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_written_shards_prune_on_each_dimension(spark, tmp_path, law):
    """A box on two dimensions meets few of the shards by their min/max, and few of the files by their footers."""
    rng = np.random.default_rng(5)
    rows = [(i, int(x), float(y), "s", 1) for i, (x, y) in enumerate(rng.integers(0, 10_000, (6_000, 2)))]
    docs = spark.createDataFrame(rows, "doc_id long, x long, y double, shard string, slot int").repartition(5)
    folder = str(tmp_path / law)
    hilbert.write(docs, ["x", "y"], 32, folder, law)
    stored = spark.read.parquet(folder)
    assert sorted(map(tuple, stored.select(*docs.columns).collect())) == rows
    ends = hilbert.extents(spark, folder, ["x", "y"]).collect()
    assert sum(e.rows for e in ends) == 6_000 and len(ends) == 32
    slots = sorted((r["_shard"], r["_slot"]) for r in stored.select("_shard", "_slot").collect())
    assert [s for k in range(32) for s in [x for shard, x in slots if shard == k]] == [s for e in sorted(ends, key=lambda e: e["_shard"]) for s in range(e.rows)]
    for a, b in ((1_000, 6_000), (8_500, 200), (4_900, 4_900)):
        met = [e for e in ends if e.x_max >= a and e.x_min <= a + 800 and e.y_max >= b and e.y_min <= b + 800]
        assert 1 <= len(met) <= 10
        files = skipped = 0
        for f in (tmp_path / law).glob("*/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            x, y = (meta.row_group(0).column(at[c]).statistics for c in "xy")
            files += 1
            skipped += x.max < a or x.min > a + 800 or y.max < b or y.min > b + 800
        assert skipped >= files / 2
        box = stored.where(f"x between {a} and {a + 800} and y between {b} and {b + 800}")
        assert box.count() == sum(a <= r[1] <= a + 800 and b <= r[2] <= b + 800 for r in rows)


def test_written_shards_of_an_empty_table(spark, tmp_path):
    hilbert.write(table(spark).limit(0), ["lang", "n_chars"], 4, str(tmp_path / "none"))
    assert spark.read.schema("doc_id long").parquet(str(tmp_path / "none")).count() == 0
