"""The diff relation covers all of lineitem, whatever the order keys."""

from hashlib import md5

from keelson.operators.diff import added_lines
from keelson.plans import catalog
from keelson.plans.derived import view

PARTS = [(k, 100 + k % 97, k % 13, n) for k in (1, 1499, 1500, 15_000, 6_000_000_001) for n in (1, 3, 6)]


def test_added_lines_of_late_orders(spark, tmp_path):
    spark.createDataFrame(PARTS, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    hashed = lambda x: md5(str(x).encode()).hexdigest()
    want = []
    for k, part, supplier, n in PARTS:
        at = (hashed(k), f"src/f{n}.env")
        want += [(*at, n + 1, f"Password={hashed(part)}"), (*at, n + 2, "plain"), (*at, 20, "AKIA" + hashed(supplier)[:16].upper())]
    got = catalog.queries()["diff_added_lines"](spark, str(tmp_path)).select("sha", "path", "line", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_all_rows_have_a_diff(spark):
    sf = "/root/testdata/sf0.01"
    assert view(spark, sf, "v_diffs").count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_added_lines_without_inner_functions(spark):
    """Functions of elements are interpreted, one call an element; lines are rows, in generated code."""
    patch = "--- a\n+++ b\n@@ -1 +3 @@ +9\r\n+a\r\n-b\r\n+++c\r k\n+\n@@ -9 +2147483647 @@\n+last"
    rows = added_lines(spark.createDataFrame([("s", "p", patch), ("t", "p", None)], "sha string, path string, patch string"))
    assert sorted(map(tuple, rows.collect())) == [("s", "p", 3, "a"), ("s", "p", 5, ""), ("s", "p", 2147483647, "last")]
    assert "lambda" not in rows._jdf.queryExecution().toString()
