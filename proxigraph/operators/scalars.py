"""Scalar functions of the engine as columns, each on a table that shows it."""

from __future__ import annotations

from pyspark.sql import functions as F

from proxigraph.functions.columns import csv_field, half_up, histogram_map, softmax
from proxigraph.plans.session import table


QUERIES = {
    "string_lower": lambda s, d: table(s, d, "part").filter(F.contains(F.lower("p_type"), F.lit("m"))).select("p_partkey", F.lower("p_type").alias("kind"), F.trim("p_name").alias("name")),
    "csv_escape": lambda s, d: table(s, d, "events").select("event_id", F.concat_ws(",", csv_field(F.col("event_type")), csv_field(F.col("props"))).alias("line")),
    "ceil_and_half_up": lambda s, d: table(s, d, "customer").select("c_custkey", F.ceil(F.col("c_custkey") * 0.3).alias("sampled"), half_up(F.col("c_acctbal") / 3, 1).alias("tenths")),
    "softmax_balances": lambda s, d: softmax(table(s, d, "customer").groupBy("c_mktsegment").agg((F.avg("c_acctbal") / 1000).alias("x")), "x", "c_mktsegment"),
    "histogram_map": lambda s, d: histogram_map(table(s, d, "customer"), "c_mktsegment", "c_nationkey"),
}
SQL = {
    "string_lower": "SELECT p_partkey, lower(p_type) AS kind, trim(p_name) AS name FROM part WHERE contains(lower(p_type), 'm')",
    "csv_escape": """SELECT event_id, concat_ws(',', CASE WHEN regexp_matches(event_type, '[",\\r\\n]') THEN '"' || replace(event_type, '"', '""') || '"' ELSE coalesce(event_type, '') END, CASE WHEN regexp_matches(props, '[",\\r\\n]') THEN '"' || replace(props, '"', '""') || '"' ELSE coalesce(props, '') END) AS line FROM events""",
    "ceil_and_half_up": "SELECT c_custkey, ceil(c_custkey * 0.3::DOUBLE)::BIGINT AS sampled, floor(c_acctbal / 3 * 10 + 0.5) / 10 AS tenths FROM customer",
    "softmax_balances": "SELECT c_mktsegment, round(exp(x - t) / sum(exp(x - t)) OVER (), 9) AS share FROM (SELECT c_mktsegment, x, max(x) OVER () AS t FROM (SELECT c_mktsegment, avg(c_acctbal) / 1000 AS x FROM customer GROUP BY 1))",
    "histogram_map": "SELECT c_mktsegment, string_agg(c_nationkey || '=' || n, ',' ORDER BY c_nationkey) AS counts FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1",
}
