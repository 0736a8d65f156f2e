"""The registered queries of the engine itself against their SQL."""

import duckdb
import pytest

from keelson.plans import catalog

SF = "/root/testdata/sf0.001"
#: One of each kind; all of them are compared at a larger size outside the tests.
NAMES = ["history_findings", "scan_glob_filter", "present_keywords", "detector_theta_join", "detect_aws_access_key_id", "detect_generic_api_key", "detect_custom_token", "findings_all", "baseline_filter", "placeholder_filter", "entropy", "reachable", "diff_added_lines", "history_dedup_earliest", "watch_debounce_sessions"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "nation", "region", "events", "documents", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    show = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert show(got.select(columns).collect()) == show(want)


def test_all_queries_have_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) and len(catalog.queries()) > 55
