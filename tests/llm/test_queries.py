"""The registered queries, and the pipeline against its stages one by one."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from sievework.llm import decontam, secret_forest, simhash, toxicity
from sievework.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_against_sql(key, spark, sf_dir):
    assert compare(QUERIES[key](spark, sf_dir), connect(sf_dir), ORACLES[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_row_counts(key, spark, sf_dir):
    table = "embeddings" if key.startswith("op6") else "documents"
    rows = QUERIES[key](spark, sf_dir)
    if key.startswith("op9"):
        texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
        want = [(r.doc_id, s, e - s, kind) for r in texts for kind, s, e in secret_forest.candidates(r.text or "")]
        assert sorted((r.doc_id, r.start, r.length, r.kind) for r in rows.collect()) == sorted(want)
    elif key.startswith("op4"):
        assert rows.count() > 0
    else:
        assert rows.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert len(QUERIES) == 13 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "packing"]


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, held = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held.append(corpus_pipeline.stored(stage(spark, held[-1], sf_dir), "test-stage"))
        assert held[-1].columns == names
    kept = [{r.doc_id: r.text for r in d.collect()} for d in held]
    scorer = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = dict(zip(kept[0], scorer.scores(list(kept[0].values()))))
    assert set(kept[1]) == {i for i, p in scores.items() if p < toxicity.THRESHOLD}
    prints = {i: simhash.fingerprint(t) for i, t in kept[1].items()}
    parent = dict(zip(prints, prints))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i in prints:
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    smallest = {}
    for i in sorted(prints):
        smallest.setdefault(root(i), i)
    assert set(kept[2]) == set(smallest.values())
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    dirty = {r.doc_id for r in decontam.contamination(held[2], items).where("contaminated").collect()}
    assert set(kept[3]) == set(kept[2]) - dirty and dirty
    assert set(kept[4]) == set(kept[3])
    changed = [i for i in kept[4] if kept[4][i] != kept[3][i]]
    assert all("[REDACTED]" in kept[4][i] for i in changed)
    pieces = corpus_pipeline.STAGES[-1][1](spark, held[-1], sf_dir).collect()
    sizes = {}
    for p in pieces:
        sizes[p.doc_id] = sizes.get(p.doc_id, 0) + p.length
    assert set(sizes) == set(kept[4]) and all(sizes[p.doc_id] == p.doc_tokens for p in pieces)
    assert public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    """Ids of each whole text by the library, the end id after them."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def test_shards(spark, sf_dir, texts):
    rows = QUERIES["op1_hilbert_shards"](spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None) for i, t in texts.items()}
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    assert len(rows) == len(texts) and set(shards) <= set(range(16))
    whole, largest = sum(r.size for r in rows), max(r.size for r in rows)
    last = -1
    for k in sorted(shards):
        own = sorted(shards[k], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - whole / 16) <= largest
        cells = [r.cell for r in own]
        assert cells == sorted(cells) and cells[0] >= last
        last = cells[-1]


def test_token_files(spark, sf_dir, ids):
    start, want = 0, {}
    for i in sorted(ids):
        want[i] = (start, len(ids[i]), crc(ids[i]))
        start += len(ids[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_token_files"](spark, sf_dir).collect()} == want


def test_packing(spark, sf_dir, ids):
    rows = QUERIES["op4_packing"](spark, sf_dir).collect()
    pieces, windows = {}, {}
    for r in rows:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for runs, whole in [(pieces[i], len(ids[i])) for i in ids] + [(w, None) for w in windows.values()]:
        at = 0
        for begin, length in sorted(runs):
            assert begin == at
            at += length
        assert at == whole if whole is not None else at <= 1024 and (at == 1024 or at & at - 1 == 0)
    assert 1 - sum(map(len, ids.values())) / sum(max(o + n for o, n in w) for w in windows.values()) < 0.01


def least_of_groups(keys, linked):
    """key -> the smallest key that links reach, by all pairs."""
    least = {k: k for k in keys}
    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                x, y = sorted((least[a], least[b]))
                least = {k: x if v == y else v for k, v in least.items()}
    return least


def test_near_vectors(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    unit = {}
    for r in found:
        v = np.array(r.embedding if r.embedding is not None else [], np.float64)
        norm = np.linalg.norm(v)
        unit[r.vec_id] = v / norm if len(v) and np.isfinite(v).all() and norm else None
    near = lambda a, b: unit[a] is not None and unit[b] is not None and unit[a] @ unit[b] >= 0.9
    least = least_of_groups(list(unit), near)
    links = {a: sum(near(a, b) for b in unit if b != a) for a in unit}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op6_pivot_index"](spark, sf_dir).collect()}
    assert got == {i: (links[i], least[i], least[i] == i) for i in unit}


def test_groups_of_prints(spark, sf_dir, texts):
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    least = least_of_groups(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_groups"](spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", least[i]) for i in prints}


def staged(spark, docs, folder):
    """The rows after each stage; each is written and read again."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), f"edge-{name}")
        out.append(docs)
    return out


def test_pipeline_edges(spark, sf_dir):
    """NULL and empty texts, NULL and repeated ids, a very long text, and columns named as the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, term string, _row int, mark string"
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, "one text of its own here"), (1, "another text that is not the first"), (1, "one text of its own here"), (2, None), (3, ""), (None, "without an id at all, this text"),
            (4, long), (5, "password = hunter2secret99XYZ8812 in a line"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or ""), 0.5, 7, "t", 1, "m") for i, t in rows], schema)
    *kept, pieces = staged(spark, docs, sf_dir)
    for d in kept:
        assert d.columns == docs.columns
    assert {r.doc_id for r in kept[0].collect()} == {1, 2, 3, 4, 5, None}
    after = kept[1].collect()
    # the two equal rows are one, and so are the texts without a word
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in after) == sorted([(1, len(rows[0][1])), (1, len(rows[1][1])), (2, 0), (0, len(rows[5][1])), (4, len(long)), (5, len(rows[7][1]))])
    assert all((r.score, r.fp, r.term, r._row, r.mark) == (0.5, 7, "t", 1, "m") for r in kept[-1].collect())
    packed = {}
    for r in pieces.collect():
        packed.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
    assert len(packed) == len(after) and all(sum(n) == total for (_, total), n in packed.items())


def test_pipeline_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    *kept, pieces = staged(spark, docs, sf_dir)
    assert all(d.columns == docs.columns and d.collect() == [] for d in kept) and pieces.collect() == []
