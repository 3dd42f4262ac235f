"""Tables over time: the flagship query."""

from __future__ import annotations

from tarnlake.registry import sql_query

#: Orders stand for models, their parts for the tables that a model links.
FIRST_SEEN = """
WITH links AS (SELECT CAST(o_orderdate AS DATE) AS created_date, l_partkey AS table_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
firsts AS (SELECT table_id, min(created_date) AS created_date FROM links GROUP BY table_id),
daily AS (SELECT created_date, count(*) AS n_new FROM firsts GROUP BY created_date)
SELECT created_date, n_new, CAST(sum(n_new) OVER (ORDER BY created_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_total FROM daily"""

sql_query("first_seen_over_time", FIRST_SEEN, tables=("orders", "lineitem"))
