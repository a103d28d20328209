"""Searches over signed files open fewer of them and find the same rows."""

import pytest
from pyspark.sql import functions as F

from lumenlake.functions.predicates import log_filter, span_filter
from lumenlake.schema import HOUR, LOGS_DDL, NANOS, SPANS_DDL
from lumenlake.sources import scan, storage, text_index

T0 = 1_791_378_000 * NANOS
WORDS = ["Connection refused by peer", "payment accepted", "Größe ÜBERSCHRITTEN 😀😀😀 ja", "", None, "ab", "retry after timeout"]


def logs(spark, low, high):
    """A log an hour for each of the words, and attribute values of their own."""
    rows = [(T0 + n * HOUR, None, "s", 9, "INFO", WORDS[n % len(WORDS)], "", str(n), "", {"order": f"Order-{n:04d}x", "none": None} if n % 2 else None, {}) for n in range(low, high)]
    return spark.createDataFrame(rows, LOGS_DDL)


def found(spark, root, terms, from_ns=None, to_ns=None, signed=True):
    """Span ids of what is found, and how many files were opened."""
    rows = text_index.scan_text(spark, root, "logs", terms, from_ns, to_ns) if signed else scan.scan(spark, root, "logs", from_ns, to_ns)
    rows = rows.filter(log_filter(terms)).select("span_id")
    ids = sorted(int(r[0]) for r in rows.collect())
    leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = [leaves.apply(n).metrics().get("numFiles") for n in range(leaves.size())]
    return ids, sum(m.get().value() for m in metrics if m.isDefined())


SEARCHES = [
    [("", "REFUSED by", False)],
    [("", "order-0005X", False)],
    [("", "größe überschritten 😀", False)],
    [("", "😀😀😀", False)],
    [("", "ab", False)],
    [("", "", False)],
    [("", "payment", True)],
    [("", "payment", False), ("", "Order-0001", False)],
    [("", "payment", False), ("level", "info", False)],
    [("", "never seen", False)],
    [("level", "info", False)],
]


@pytest.mark.parametrize("terms", SEARCHES)
def test_same_rows(signed, spark, terms):
    assert found(spark, signed, terms)[0] == found(spark, signed, terms, signed=False)[0]
    assert found(spark, signed, terms, T0 + HOUR, T0 + 9 * HOUR)[0] == found(spark, signed, terms, T0 + HOUR, T0 + 9 * HOUR, signed=False)[0]


@pytest.fixture(scope="module")
def signed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("signed"))
    storage.write_signal(logs(spark, 0, 21), "logs", root, signed=True)
    return root


def test_fewer_files_are_opened(signed, spark):
    assert found(spark, signed, [("", "order-0005X", False)]) == ([5], 1)
    assert found(spark, signed, [("", "refused", False)]) == ([0, 7, 14], 3)
    assert found(spark, signed, [("", "refused", False)], T0 + HOUR, T0 + 9 * HOUR) == ([7], 1)
    assert found(spark, signed, [("", "never seen", False)]) == ([], 0)
    assert found(spark, signed, [("", "ab", False)])[1] == 21


def test_changes_of_files(spark, tmp_path):
    root, terms = str(tmp_path), [("", "refused", False)]
    assert found(spark, root, terms) == ([], 0)  # nothing is stored
    storage.write_signal(logs(spark, 0, 8), "logs", root)
    assert found(spark, root, terms) == ([0, 7], 8)  # nothing is signed
    assert text_index.refresh(spark, root, "logs") == 8 and text_index.refresh(spark, root, "logs") == 0
    assert found(spark, root, terms) == ([0, 7], 2)
    storage.write_signal(logs(spark, 6, 15), "logs", root)  # nine files without a signature
    assert found(spark, root, terms) == ([0, 7, 7, 14], 11)
    storage.compact_hours(spark, root, "logs", T0 + 100 * HOUR)  # signs what it has written and all else that is new
    assert found(spark, root, terms) == ([0, 7, 7, 14], 3)
    storage.expire(spark, root, "logs", T0 + 14 * HOUR, 6 * HOUR)
    assert found(spark, root, terms) == found(spark, root, terms, signed=False)[:1] + (1,)
    assert text_index.signatures(spark, root, "logs").filter(F.col("hour").isNull()).isEmpty()


def test_many_names_open_all(signed, spark, monkeypatch):
    monkeypatch.setattr(text_index, "NAMES", 2)
    assert found(spark, signed, [("", "refused", False)]) == ([0, 7, 14], 21)


def test_spans(spark, tmp_path):
    row = lambda n, name: (str(n), "0", "", name, "Server", T0 + n * HOUR, T0 + n * HOUR + 1, 1, "Ok", "", "s", "", {"url": f"/cart/{n}"}, {}, [])
    storage.write_signal(spark.createDataFrame([row(0, "GET cart"), row(1, "POST order"), row(2, None)], SPANS_DDL), "spans", str(tmp_path), signed=True)
    for text, ids in (("post", ["1"]), ("/CART/2", ["2"]), ("cart", ["0", "1", "2"])):
        terms = [("", text, False)]
        assert sorted(r[0] for r in text_index.scan_text(spark, str(tmp_path), "spans", terms).filter(span_filter(terms)).select("trace_id").collect()) == ids
