"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lumenlake.plans.queries import ORACLES, QUERIES

#: Queries that write hundreds of files each; a few of them stand for all here.
SLOW = {"compacted", "retention_by_signal", "retention_expired", "write_partitioned", "scan_with_landing", "scan_logs", "search_logs_signed", "metric_filtered_by_series", "metric_rate_by_series"}


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(df):
    df = df[sorted(df.columns)]
    shown = {c: df[c].map(lambda x: "null" if pd.isna(x) else repr(float(x)) if isinstance(x, float) else str(x)) for c in df.columns}
    return pd.DataFrame(shown).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    got, wanted = _plain(QUERIES[name](spark, sf_dir).toPandas()), _plain(oracle.sql(ORACLES[name]).df())
    assert list(got.columns) == list(wanted.columns)
    pd.testing.assert_frame_equal(got, wanted)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
