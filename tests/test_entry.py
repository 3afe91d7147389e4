import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["daily_agg_model", "label_closure_days", "exact_percentile", "run_lengths_chunked", "rule_cv",
          "aep_fleet", "yearly_observed_loss", "event_overlap_join", "vote_features", "totals_row"]


def test_entry_has_rows_and_columns(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["run", "sim", "loss", "rank", "probability"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    res = con.execute(entry_points.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    df = entry_points.queries()[name](spark, FOLDER)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())
