"""Search by trigram postings against scoring every passage."""

import random

import pytest

from sievework.operators import corpus, passages
from tests.conftest import rows

QUERIES = {"long": ["abca", "CAB", "dd"], "short": ["a", "é", ""], "none": [], "absent": ["zzzz", "xq"], "odd": ["éa b", "[source: 3", "日本語"]}


@pytest.mark.parametrize("k", [1, 4, 30])
def test_as_scoring_all(spark, tmp_path, k):
    rng = random.Random(k)
    data = [(d, c, f"[Source: {d}]\n" + "".join(rng.choices("abcdé \n", k=rng.randint(0, 40))).upper()) for d in range(40) for c in range(rng.randint(0, 3))]
    data += [(99, 0, "日本語"), (99, 1, "a"), (99, 2, ""), (98, 0, "zz " * 30_000)]
    df = spark.createDataFrame(data, "doc_id long, chunk_no int, chunk string").repartition(5)
    passages.build(df, str(tmp_path / "index"))
    want = corpus.top_k(df, QUERIES, k)
    got = passages.search(spark, str(tmp_path / "index"), QUERIES, k)
    assert rows(got.select(*want.columns)) == rows(want)


def test_few_are_scored(spark, tmp_path):
    df = spark.range(3_000).selectExpr("id AS doc_id", "0 AS chunk_no", "concat('passage number ', id, if(id % 500 = 0, ' needle', ' straw')) AS chunk")
    passages.build(df, str(tmp_path / "index"))
    found = passages.effort(spark, str(tmp_path / "index"), {"q": ["needle"]}).first()
    assert (found.passages, found.scored) == (3_000, 6) and found.read_rows < found.posting_rows / 20


def test_no_passages(spark, tmp_path):
    passages.build(spark.createDataFrame([], "doc_id long, chunk_no int, chunk string"), str(tmp_path / "index"))
    assert passages.search(spark, str(tmp_path / "index"), QUERIES, 3).collect() == []
