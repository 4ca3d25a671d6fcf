"""The registry of queries, and the common tables of their DuckDB SQL."""

from __future__ import annotations

L = """L AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS txn_id, o_custkey AS src, l_partkey % (SELECT count(*) FROM customer) AS dst,
         l_extendedprice AS amount, l_shipdate AS ts, o_orderpriority AS channel, c_nationkey AS from_bank, l_suppkey % 25 AS to_bank,
         CAST(l_returnflag = 'R' AS INT) AS is_laundering
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
E = """E AS (
  SELECT event_id AS txn_id, user_id AS src, (user_id * 7 + event_id) % (SELECT count(DISTINCT user_id) FROM events) AS dst, value AS amount, ts, event_type AS channel
  FROM events)"""
B = "B AS (SELECT src AS account, dst AS other, 'out' AS direction, * FROM {0} UNION ALL SELECT dst, src, 'in', * FROM {0})"
A = "A AS (SELECT c_custkey AS account, c_acctbal AS declared_income, CASE WHEN c_acctbal > 6000 THEN 'high' WHEN c_acctbal > 2000 THEN 'middle' WHEN c_acctbal > 0 THEN 'low' ELSE 'none' END AS income_bracket, c_mktsegment AS occupation, n_name AS city FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str, *ctes: str):
    def add(f):
        QUERIES[name] = f
        ORACLE[name] = ("WITH " + ", ".join(ctes) + "\n" if ctes else "") + sql.strip()
        return f

    return add


BL, BE = B.format("L"), B.format("E")
