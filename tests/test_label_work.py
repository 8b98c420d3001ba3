"""The label index does not meet earlier hubs again."""

from sievework.operators import reach


def test_edges_of_earlier_hubs_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(reach, "FIRST", 20)
    met, cut = [], reach.cut

    def counted(df):
        out = cut(df)
        if out.columns == ["way", "hub", "node"]:
            met.append(out.count())
        return out

    monkeypatch.setattr(reach, "cut", counted)
    edges = [(f"part{p}", f"supplier{s}") for p in range(40) for s in range(20)]
    labels = reach.label_index(spark.createDataFrame(edges, "from_id string, to_id string"))
    # a label for each edge and two of each node's own; one supplier shares its batch with the parts, both label each other
    assert 800 + 2 * 60 <= labels.count() <= 800 + 2 * 60 + 40
    # each edge is met from its supplier, and not again from its part
    assert sum(met) < 1_300
