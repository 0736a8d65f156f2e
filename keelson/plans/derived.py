"""Test relations, derived from the driver's tables by SQL that Spark and DuckDB both run.

None of those tables holds files or commits, so they are made here: one text for both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "v_files": """
SELECT concat(CASE WHEN c_custkey % 11 = 0 THEN 'bin/' WHEN c_custkey % 13 = 0 THEN 'src/Migrations/' ELSE 'src/' END, 'c', cast(c_custkey AS string),
  CASE c_custkey % 8 WHEN 0 THEN '.json' WHEN 1 THEN '.cs' WHEN 2 THEN '.env' WHEN 3 THEN '.txt' WHEN 4 THEN '.yaml' WHEN 5 THEN '.dll' WHEN 6 THEN '.config' ELSE '.ini' END) AS path,
 concat('# ', c_name, chr(10),
  'Server=db;Password=', CASE WHEN c_custkey % 5 = 0 THEN 'changeme' ELSE md5(cast(c_custkey AS string)) END, ';', chr(10),
  'key ', CASE c_custkey % 3 WHEN 0 THEN 'AKIA' WHEN 1 THEN 'ASIA' ELSE 'AROA' END, upper(substring(md5(cast(c_custkey % 40 AS string)), 1, 16)), chr(10),
  CASE c_custkey % 17
   WHEN 0 THEN concat('  "ApiKey": "', md5(c_name), '"')
   WHEN 1 THEN concat('aws_secret_access_key = "', md5(c_name), upper(substring(md5(c_name), 1, 8)), '"')
   WHEN 2 THEN concat('t=ghp_', md5(c_name), 'abcd;')
   WHEN 3 THEN concat('t=github_pat_', md5(c_name), '_', md5(c_name), upper(substring(md5(c_name), 1, 17)), ';')
   WHEN 4 THEN concat('t=ghs_', md5(c_name), 'abcd;')
   WHEN 5 THEN concat('sk_', 'live_', md5(c_name))
   WHEN 6 THEN concat('rk_', 'live_', md5(c_name))
   WHEN 7 THEN concat('glpat-', substring(md5(c_name), 1, 24))
   WHEN 8 THEN concat('h("Bearer ', md5(c_name), '.', md5(c_name), '")')
   WHEN 9 THEN concat('xoxb-', md5(c_name))
   WHEN 10 THEN concat('"JwtSigningKey" : "', md5(c_name), '"')
   WHEN 11 THEN concat('AccountKey=', md5(c_name), md5(c_name), substring(md5(c_name), 1, 22), '==;')
   WHEN 12 THEN concat('-----BEGIN RSA ', 'PRIVATE KEY-----')
   WHEN 13 THEN concat('"DbPasswd": "', CASE WHEN c_custkey % 3 = 0 THEN 'placeholder' ELSE substring(md5(c_name), 1, 12) END, '"')
   WHEN 14 THEN concat('"MainConnection": "Host=x;Pwd=', substring(md5(c_name), 1, 10), ';"')
   WHEN 15 THEN concat('x = "', md5(c_name), upper(md5(cast(c_custkey + 7 AS string))), 'ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ"')
   ELSE 'nothing here' END, chr(10)) AS content,
 cast(200 + c_custkey * 1000 AS bigint) AS size
FROM customer""",
    "v_commits": """SELECT md5(cast(o_orderkey AS string)) AS sha, o_orderdate AS author_when, concat('Author ', cast(o_custkey % 50 AS string)) AS author_name, CASE o_orderkey % 350 WHEN 0 THEN concat('fix AKIA', upper(substring(md5(cast(o_orderkey % 700 AS string)), 1, 16))) WHEN 50 THEN concat('undo ghp_', md5(cast(o_orderkey % 700 AS string)), 'abcd') WHEN 100 THEN concat('rotate sk_', 'live_', md5(cast(o_orderkey % 700 AS string))) WHEN 150 THEN concat('bot xoxb-', md5(cast(o_orderkey % 700 AS string))) WHEN 200 THEN concat('set "ApiKey": "', md5(cast(o_orderkey % 700 AS string)), '"') WHEN 250 THEN concat('use Password=', md5(cast(o_orderkey % 700 AS string)), '; and AROA', upper(substring(md5(cast(o_orderkey % 700 AS string)), 1, 16))) WHEN 300 THEN concat('drop glpat-', substring(md5(cast(o_orderkey % 700 AS string)), 1, 24)) ELSE 'work' END AS message, cast(o_orderkey AS bigint) AS k FROM orders""",
    "v_edges": "SELECT md5(cast(o_orderkey AS string)) AS sha, md5(cast(cast(floor((o_orderkey - 1) / 2) AS bigint) AS string)) AS parent, 0 AS parent_idx FROM orders WHERE o_orderkey > 1 UNION ALL SELECT md5(cast(o_orderkey AS string)), md5(cast(cast(floor((o_orderkey - 1) / 3) AS bigint) AS string)), 1 FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey > 3",
    "v_refs": "SELECT concat('b', cast(n_nationkey AS string)) AS name, 'branch' AS kind, md5(cast(n_nationkey * 37 + 100 AS string)) AS sha FROM nation UNION ALL SELECT concat('t', cast(r_regionkey AS string)), 'tag', md5(cast(r_regionkey * 91 + 1000 AS string)) FROM region",
    # Files 2, 4, 5 and 7 of a commit hold the other kinds of secret on the line after the first; the extension is what their detectors ask for
    "v_diffs": """
SELECT sha, path, status,
 concat('diff --git a b', chr(10), '@@ -1,2 +', cast(n AS string), ',4 @@', chr(10), ' keep', chr(10), '+', a, chr(10), '-old', chr(10), '+', b, chr(10), '@@ -9 +20 @@', chr(10), '+', c, chr(10)) AS patch,
 concat(repeat(chr(10), n), a, chr(10), b, repeat(chr(10), 18 - n), c, chr(10)) AS content
FROM (SELECT md5(cast(l_orderkey AS string)) AS sha, l_linenumber AS n,
  concat('src/f', cast(l_linenumber AS string), CASE l_linenumber WHEN 2 THEN '.json' WHEN 5 THEN '.config' WHEN 7 THEN '.cs' ELSE '.env' END) AS path,
  CASE WHEN l_linenumber = 6 THEN 'deleted' ELSE 'modified' END AS status,
  concat('Password=', md5(cast(l_partkey AS string))) AS a,
  CASE l_linenumber
   WHEN 2 THEN CASE l_partkey % 4
    WHEN 0 THEN concat('"ApiKey": "', md5(cast(l_suppkey AS string)), '"')
    WHEN 1 THEN concat('"JwtSigningKey" : "', md5(cast(l_suppkey AS string)), '"')
    WHEN 2 THEN concat('"DbPasswd": "', substring(md5(cast(l_suppkey AS string)), 1, 12), '"')
    ELSE concat('"MainConnection": "Host=x;Pwd=', substring(md5(cast(l_suppkey AS string)), 1, 10), ';"') END
   WHEN 4 THEN CASE l_partkey % 6
    WHEN 0 THEN concat('t=ghp_', md5(cast(l_suppkey AS string)), 'abcd;')
    WHEN 1 THEN concat('t=github_pat_', md5(cast(l_suppkey AS string)), '_', md5(cast(l_suppkey AS string)), upper(substring(md5(cast(l_suppkey AS string)), 1, 17)), ';')
    WHEN 2 THEN concat('t=ghs_', md5(cast(l_suppkey AS string)), 'abcd;')
    WHEN 3 THEN concat('sk_', 'live_', md5(cast(l_suppkey AS string)))
    WHEN 4 THEN concat('rk_', 'live_', md5(cast(l_suppkey AS string)))
    ELSE concat('glpat-', substring(md5(cast(l_suppkey AS string)), 1, 24)) END
   WHEN 5 THEN CASE l_partkey % 5
    WHEN 0 THEN concat('xoxb-', md5(cast(l_suppkey AS string)))
    WHEN 1 THEN concat('AccountKey=', md5(cast(l_suppkey AS string)), md5(cast(l_suppkey AS string)), substring(md5(cast(l_suppkey AS string)), 1, 22), '==;')
    WHEN 2 THEN concat('-----BEGIN RSA ', 'PRIVATE KEY-----')
    WHEN 3 THEN concat('aws_secret_access_key = "', md5(cast(l_suppkey AS string)), upper(substring(md5(cast(l_suppkey AS string)), 1, 8)), '"')
    ELSE concat('key ASIA', upper(substring(md5(cast(l_suppkey AS string)), 1, 16))) END
   WHEN 7 THEN CASE WHEN l_partkey % 2 = 0 THEN concat('h("Bearer ', md5(cast(l_suppkey AS string)), '.', md5(cast(l_suppkey AS string)), '")') ELSE concat('key AROA', upper(substring(md5(cast(l_suppkey AS string)), 1, 16))) END
   ELSE 'plain' END AS b,
  concat('AKIA', upper(substring(md5(cast(l_suppkey AS string)), 1, 16))) AS c
 FROM lineitem) AS added""",
    "v_changes": "SELECT concat('src/u', cast(user_id AS string), '.cs') AS path, ts FROM events",
}
#: Tables that the relations are made from.
TABLES = ("customer", "orders", "lineitem", "nation", "region", "events", "documents")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a DataFrame. The source tables become temporary views of their own names."""
    for table in TABLES:
        if f"FROM {table}" in VIEWS[name]:
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            # A small table of which each row becomes a text: dealt over all cores before that. A large one is read by as many tasks
            cores = spark.sparkContext.defaultParallelism
            if name in ("v_files", "v_diffs") and rows.rdd.getNumPartitions() < cores:
                rows = rows.repartition(cores)
            rows.createOrReplaceTempView(table)
    return spark.sql(VIEWS[name])


def with_views(sql: str) -> str:
    """For DuckDB: the same relations as common table expressions, before a query that starts with its own or with SELECT."""
    used = [n for n in VIEWS if n in sql]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    if not head:
        return sql
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {sql[14:]}"
    if sql.upper().startswith("WITH"):
        return f"WITH {head}, {sql[4:]}"
    return f"WITH {head} {sql}"
