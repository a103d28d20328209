"""Traces that a task walks against those that go by joins."""

import random

import pytest

from lumenlake.operators import traces, trees
from lumenlake.schema import NANOS, SPANS_DDL


def span(trace, name, parent, at, status):
    start = 1_791_378_000 * NANOS + at * NANOS
    return (trace, name, parent, f"n{name}", "Server", start, start + NANOS, NANOS, status, "", "s", "", {}, {}, [])


def forest(dice):
    """Chains, wide trees, missing parents, cycles and errors anywhere; ids recur in other traces."""
    rows = []
    for t in range(30):
        n = dice.choice([1, 2, 5, 30, 120])
        for k in range(n):
            parent = dice.choice(["", str(k - 1), str(k - 1), str(dice.randrange(n)), "missing"]) if k else ""
            rows.append(span(f"t{t}", str(k), parent, dice.randrange(9), dice.choice(["Error", "Unset", "Unset", "Ok"])))
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("large", [20, 10_000])
def test_small_and_large_traces_alike(spark, monkeypatch, large):
    """The same whatever goes by joins; batches of a few rows cut traces anywhere."""
    rows = spark.createDataFrame(forest(random.Random(3)), SPANS_DDL).repartition(3)
    shown = lambda df: sorted(map(tuple, df.collect()), key=repr)
    monkeypatch.setattr(trees, "LARGE", 0)
    wanted = shown(traces.waterfall(rows)), shown(traces.error_ancestors(rows)), shown(traces.error_origins(rows).select("trace_id", "span_id"))
    monkeypatch.setattr(trees, "LARGE", large)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert (shown(traces.waterfall(rows)), shown(traces.error_ancestors(rows)), shown(traces.error_origins(rows).select("trace_id", "span_id"))) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_small_traces_take_no_rounds(spark, monkeypatch):
    """Walks by joins, whose rounds write all steps again and again, are for large traces alone."""
    rounds = []
    monkeypatch.setattr(traces, "_tour", lambda spans: rounds.append("tour"))
    monkeypatch.setattr(traces, "cut", lambda df: rounds.append("cut"))
    rows = spark.createDataFrame(forest(random.Random(4)), SPANS_DDL)
    assert traces.waterfall(rows).count() > 0 and traces.error_ancestors(rows).count() > 0 and not rounds
