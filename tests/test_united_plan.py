"""The exact side of profile_united counts each column by itself."""

from sievework.registered import profiling


def test_no_row_is_taken_once_a_column(spark, sf_dir, capsys):
    found = profiling.profile_united(spark, sf_dir)
    found.explain()
    assert "Expand" not in capsys.readouterr().out
    assert all((r.distinct_off, r.quantiles_off) == (0, 0) for r in found.collect())
