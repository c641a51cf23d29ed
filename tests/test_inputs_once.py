"""What is derived from the tables is derived once, not for each rule or pass that reads it."""

import pytest

import __spark_entry__ as entry
from barloom.operators import models as ml, search
from barloom.plans import data
from barloom.sources import fixtures as fx


def test_search_derives_its_columns_once(spark, sf):
    made = search.prepare(fx.listing(spark, sf))
    n = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    for text in ("smal gizmos", "almond", "P1"):
        assert 0 < n(search.search(made, text)) <= n(made)
    assert n(data.fuzzy_search(spark, sf)) <= n(made)


def test_search_has_hits_alone(spark):
    rows = [("A1.NS", "Smalt Gizmo", "x"), ("A2.NS", "Smalt Gizmo", "x"), ("A3.BO", "Nothing alike", "x"), ("A4.NS", None, "x"), ("A5.NS", "", "x"), ("A6.NS", "Smal Gizmos Works", "x")]
    made = search.prepare(spark.createDataFrame(rows, "symbol string, name string, series string"))
    got = [(r.symbol, r.tier) for r in search.search(made, "smal gizmos").collect()]
    assert got == [("A6.NS", 3), ("A1.NS", 8), ("A2.NS", 8)]
    assert search.search(made, " ").collect() == [] and search.search(made, "qqqqqqqqq").collect() == []
    assert [r.symbol for r in search.search(made, "smal gizmos", limit=2).collect()] == ["A6.NS", "A1.NS"]


@pytest.mark.parametrize("query, step", [("label_candidates", "compare_labels"), ("model_calibration", "calibrate")])
def test_fits_read_what_is_written_down(spark, sf, monkeypatch, query, step):
    read = []

    class Seen(Exception):
        pass

    def stop(first, *rest):
        for df in first.values() if isinstance(first, dict) else [first, *rest]:
            read.extend(df.inputFiles())
        raise Seen

    monkeypatch.setattr(ml, step, stop)
    with pytest.raises(Seen):
        entry.queries()[query](spark, sf)
    assert read and not [f for f in read if "/root/testdata" in f]
