"""The registered queries: SQL over fixtures that are derived from the test tables, and the same SQL for DuckDB.

Texts are written so that both dialects read them; where they can't, DUCK has DuckDB's text. Sums of doubles are taken as
decimals, whose order of addition doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",)}
#: Rows of the keyed tables and lineitem, relative to each other; lineitem has no key, as (l_orderkey, l_linenumber) repeats.
CARDINALITIES = {"region": 5, "nation": 25, "supplier": 1_000, "customer": 15_000, "part": 20_000, "orders": 150_000, "lineitem": 600_000}

FIXTURES = {
    "Graph": "SELECT DISTINCT CAST(o_custkey AS INT) AS src, CAST(o_custkey - o_custkey % 30 + o_orderkey % 30 AS INT) AS dst FROM orders WHERE o_orderstatus = 'F'",
    "GraphRated": "SELECT CAST(o_custkey AS INT) AS src, CAST(o_custkey - o_custkey % 30 + o_orderkey % 30 AS INT) AS dst, MAX(o_totalprice) AS rating FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2",
    "Trade": "SELECT event_id AS T_ID, ts AS T_DTS, event_type AS T_TT_ID, CONCAT('S', CAST(event_id % 10 AS VARCHAR(20))) AS T_S_SYMB, user_id AS T_CA_ID, value AS T_TRADE_PRICE FROM events",
    "R": "SELECT DISTINCT CAST(o_orderkey AS INT) AS a, CAST(o_custkey AS INT) AS b FROM orders WHERE o_orderstatus = 'F'",
    "S": "SELECT DISTINCT CAST(c_custkey AS INT) AS b, c_nationkey AS c FROM customer",
    "T": "SELECT s_nationkey AS c, CAST(s_suppkey AS INT) AS d, CAST(FLOOR(s_acctbal) AS INT) AS e, CAST(s_suppkey AS INT) + 1 AS f FROM supplier",
}


def total(value: str) -> str:
    return f"CAST(SUM(CAST({value} AS DECIMAL(18, 4))) AS DOUBLE)"


REVENUE = total("l_extendedprice * (1 - l_discount)")
# fragments of the path queries: three hops, and the number of edges out of and into a vertex
_LINE = "Graph AS hop1, Graph AS hop2, Graph AS hop3"
_OUT = "(SELECT src, COUNT(*) AS n FROM Graph GROUP BY src)"
_IN = "(SELECT dst, COUNT(*) AS n FROM Graph GROUP BY dst)"
_CHAIN = "tail.src = hop1.src AND hop1.dst = hop2.src AND hop2.dst = hop3.src AND hop3.dst = head.src"
_HOPS = "hop1.src AS p0, hop1.dst AS p1, hop3.src AS p2, hop3.dst AS p3, tail.n AS tail_out, head.n AS head_out"
_BELLS = """Graph AS l1, Graph AS l2, Graph AS l3, Graph AS r1, Graph AS r2, Graph AS r3, Graph AS bar
    WHERE l1.dst = l2.src AND l2.dst = l3.src AND l3.dst = l1.src AND r1.dst = r2.src AND r2.dst = r3.src AND r3.dst = r1.src
    AND l1.dst = bar.src AND bar.dst = r1.src AND l1.src + l2.src + l3.src < r1.src + r2.src + r3.src"""


@dataclass(frozen=True)
class Query:
    sql: str
    duck: str | None = None
    strategy: str = "auto"
    semantics: str = "sql"


QUERIES: dict[str, Query] = {}


def _add(name: str, sql: str, duck: str | None = None, **options) -> None:
    QUERIES[name] = Query(sql, duck, **options)


# paths, counts and dumbbells on a graph
_add("graph_q1", f"SELECT {_HOPS} FROM {_LINE}, {_OUT} AS tail, {_OUT} AS head WHERE {_CHAIN} AND tail.n < head.n")
_add("graph_q2", "SELECT " + ", ".join(f"{e}.src AS {e}_from, {e}.dst AS {e}_to" for e in ("l1", "l2", "l3", "r1", "r2", "r3", "bar")) + f" FROM {_BELLS}")
_add(
    "graph_q3",
    f"""SELECT {_HOPS}, mid.n AS mid_out, sink.n AS head_in FROM {_LINE}, {_OUT} AS tail, {_OUT} AS head, {_OUT} AS mid, {_IN} AS sink
    WHERE {_CHAIN} AND mid.src = hop2.src AND sink.dst = hop3.dst AND tail.n < head.n AND mid.n < sink.n""",
)
_add("graph_q4", f"SELECT DISTINCT hop3.src AS p2, hop3.dst AS p3 FROM {_LINE}, {_OUT} AS tail, {_OUT} AS head WHERE {_CHAIN} AND tail.n < head.n")
_add(
    "graph_q5",
    f"""SELECT DISTINCT hop2.src AS p1, hop2.dst AS p2 FROM {_LINE}, Graph AS side1, Graph AS side3, {_OUT} AS tail, {_OUT} AS head, {_IN} AS side_tail, {_IN} AS side_head
    WHERE {_CHAIN} AND tail.n < head.n AND side1.dst = hop2.src AND side3.src = hop2.dst AND side_tail.dst = side1.src AND side_head.dst = side3.dst AND side_tail.n < side_head.n""",
)
_add("graph_q6", f"SELECT {_HOPS} FROM {_LINE}, {_OUT} AS tail, {_OUT} AS head WHERE {_CHAIN} AND tail.n < hop3.dst")
_add("graph_q7", f"SELECT {_HOPS} FROM {_LINE}, {_OUT} AS tail, {_OUT} AS head WHERE {_CHAIN} AND tail.n < hop1.dst AND head.n < hop3.src")
_add(
    "graph_q8",
    f"SELECT hop1.src AS p0, hop1.dst AS p1, hop2.dst AS p2, hop3.dst AS p3, hop4.dst AS p4 FROM {_LINE}, Graph AS hop4 WHERE hop1.dst = hop2.src AND hop2.dst = hop3.src AND hop3.dst = hop4.src AND hop2.src < hop2.dst AND hop3.src < hop3.dst",
)
_add("graph_q10", f"SELECT DISTINCT bar.src AS bar_from, bar.dst AS bar_to FROM {_BELLS}")
_add(
    "trade_q9",
    """SELECT buy.T_ID AS buy_id, buy.T_DTS AS buy_at, buy.T_TT_ID AS buy_type, buy.T_TRADE_PRICE AS buy_price, sell.T_ID AS sell_id, sell.T_DTS AS sell_at, sell.T_TT_ID AS sell_type,
    sell.T_TRADE_PRICE AS sell_price, buy.T_S_SYMB AS symbol, buy.T_CA_ID AS account FROM Trade buy, Trade sell
    WHERE buy.T_TT_ID LIKE '%i%' AND sell.T_TT_ID LIKE '%r%' AND buy.T_CA_ID = sell.T_CA_ID AND buy.T_S_SYMB = sell.T_S_SYMB
    AND buy.T_DTS <= sell.T_DTS AND buy.T_DTS + INTERVAL '90' DAY >= sell.T_DTS AND buy.T_TRADE_PRICE * 1.2 < sell.T_TRADE_PRICE""",
)
_add("rst_q11", "SELECT r.a AS a, s.b AS b, t.c AS c, t.f AS f FROM R AS r, S AS s, T AS t WHERE r.b = s.b AND s.c = t.c AND r.a < t.e")
_add("j_triangle", "SELECT x.src AS a, y.src AS b, z.src AS c FROM Graph x, Graph y, Graph z WHERE x.dst = y.src AND y.dst = z.src AND z.dst = x.src")

# ordered limits
_add("topk_line2", "SELECT R.src AS a, S.src AS b, S.dst AS c, R.rating + S.rating AS t FROM GraphRated R, GraphRated S WHERE R.dst = S.src ORDER BY t DESC, a, b, c LIMIT 5")
_add("topk_line3", "SELECT R.src AS a, S.src AS b, T.src AS c, T.dst AS d, R.rating + S.rating + T.rating AS t FROM GraphRated R, GraphRated S, GraphRated T WHERE R.dst = S.src AND S.dst = T.src ORDER BY t DESC, a, b, c, d LIMIT 10")
_add(
    "topk_line4",
    "SELECT R.src AS a, S.src AS b, T.src AS c, U.src AS d, U.dst AS e, R.rating + S.rating + T.rating + U.rating AS t FROM GraphRated R, GraphRated S, GraphRated T, GraphRated U WHERE R.dst = S.src AND S.dst = T.src AND T.dst = U.src ORDER BY t DESC, a, b, c, d, e LIMIT 7",
)
_add("topk_star", "SELECT R.src AS a, R.dst AS b, S.dst AS c, T.dst AS d, R.rating + S.rating + T.rating AS t FROM GraphRated R, GraphRated S, GraphRated T WHERE R.src = S.src AND R.src = T.src ORDER BY t DESC, a, b, c, d LIMIT 5")
_add(
    "topk_tree",
    "SELECT S.dst AS a, S.src AS b, R.src AS c, T.dst AS d, U.dst AS e, R.rating + S.rating + T.rating + U.rating AS t FROM GraphRated R, GraphRated S, GraphRated T, GraphRated U WHERE R.dst = S.src AND R.src = T.src AND R.src = U.src ORDER BY t DESC, a, b, c, d, e LIMIT 5",
)

# decision support
_add("tpch_q1", f"SELECT l_returnflag, l_linestatus, {total('l_quantity')} AS sum_qty, {total('l_extendedprice')} AS sum_price, ROUND({total('l_discount')} / COUNT(l_discount), 6) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-12-01 00:00:00' - INTERVAL '90' DAY GROUP BY 1, 2")
_add("tpch_q3", f"SELECT l_orderkey, {REVENUE} AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1997-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1997-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate")
_add("tpch_q4", "SELECT o_orderpriority, COUNT(*) AS n FROM orders, (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') v WHERE o_orderdate >= TIMESTAMP '1996-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-10-01 00:00:00' AND v.l_orderkey = o_orderkey GROUP BY 1")
_add(
    "tpch_q5",
    f"""SELECT n_name, {REVENUE} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
    AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY 1""",
)
_add("tpch_q6", f"SELECT {total('l_extendedprice * l_discount')} AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
_add(
    "tpch_q7",
    f"""SELECT n1.n_name AS supp, n2.n_name AS cust, CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) AS y, {REVENUE} AS revenue FROM supplier, lineitem, orders, customer, nation n1, nation n2
    WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) GROUP BY 1, 2, 3""",
)
_add(
    "tpch_q8",
    f"""SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, ROUND({total("CASE WHEN n2.n_name = 'NATION_2' THEN l_extendedprice * (1 - l_discount) ELSE 0 END")} / {REVENUE}, 8) AS share
    FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey
    AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY' GROUP BY 1""",
)
_add(
    "tpch_q9_nops",
    f"""SELECT n_name, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, {REVENUE} AS profit FROM part, supplier, lineitem, orders, nation
    WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_brand LIKE '%1%' GROUP BY 1, 2""",
)
_add(
    "tpch_q10",
    f"""SELECT c_custkey, c_name, {REVENUE} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey
    AND o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY 1, 2, 4, 5""",
)
_add(
    "tpch_q12",
    """SELECT l_returnflag, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low
    FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate GROUP BY 1""",
)
_add("tpch_q14", f"SELECT ROUND(100.0 * {total("CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END")} / {REVENUE}, 6) AS promo FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1996-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-10-01 00:00:00'")
_add(
    "tpch_q15",
    f"""SELECT s_suppkey, s_name, v.revenue AS revenue FROM supplier, (SELECT l_suppkey AS k, {REVENUE} AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY 1) v,
    (SELECT MAX(r) AS best FROM (SELECT l_suppkey, {REVENUE} AS r FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY 1) w) m
    WHERE s_suppkey = v.k AND v.revenue = m.best""",
)
_add("tpch_q17", f"SELECT {total('l_extendedprice')} / 7.0 AS avg_yearly, COUNT(*) AS n FROM lineitem, part, (SELECT l_partkey AS k, 0.2 * {total('l_quantity')} / COUNT(*) AS q FROM lineitem GROUP BY 1) v WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_partkey = k AND l_quantity > q")
_add("tpch_q18", f"SELECT c_name, o_orderkey, {total('l_quantity')} AS qty FROM customer, orders, lineitem, (SELECT l_orderkey AS k FROM lineitem GROUP BY 1 HAVING SUM(l_quantity) > 200) v WHERE o_orderkey = k AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY 1, 2")
_add("tpch_q19", f"SELECT {REVENUE} AS revenue, COUNT(*) AS n FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#12' AND p_type IN ('SMALL', 'MEDIUM') AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 15")

# one probe for each operator
_OL = "FROM orders, lineitem WHERE o_orderkey = l_orderkey"
_CN = "FROM customer, nation WHERE c_nationkey = n_nationkey"
_add("s_scan", "SELECT * FROM nation")
_add("f_project", "SELECT n_name, n_regionkey, n_nationkey * 2 + 1 AS twice, 'x' AS fixed FROM nation")
_add("f_like", f"SELECT c_custkey, n_name {_CN} AND n_name LIKE 'NATION_1%'")
_add("f_not_like", f"SELECT c_custkey, n_name {_CN} AND n_name NOT LIKE 'NATION_1%'")
_add("f_in", f"SELECT c_custkey, c_mktsegment, n_name {_CN} AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
_add("f_not_in", f"SELECT c_custkey, c_mktsegment, n_name {_CN} AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_add("f_between", f"SELECT o_orderkey, l_linenumber, l_quantity {_OL} AND l_quantity BETWEEN 10 AND 12")
_add("f_or_local", f"SELECT c_custkey, c_mktsegment, n_name {_CN} AND (c_mktsegment = 'BUILDING' OR c_acctbal < 0)")
_add("f_or_residual", f"SELECT c_custkey, c_mktsegment, n_name {_CN} AND (c_mktsegment = 'BUILDING' OR n_name = 'NATION_3')")
_add("f_null", "SELECT s_suppkey FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 5000 WHERE c_custkey IS NULL")
_add("f_not_null", f"SELECT c_custkey, n_name {_CN} AND c_mktsegment IS NOT NULL")
_add("f_string_cmp", f"SELECT c_custkey, c_name, n_name {_CN} AND c_mktsegment < n_name")
_add("f_star", "SELECT * FROM nation, region WHERE n_regionkey = r_regionkey")
_add("f_neq", f"SELECT c_custkey, n_name {_CN} AND n_name <> 'NATION_1'")
_add("f_not", f"SELECT c_custkey, n_name {_CN} AND NOT (c_acctbal > 0 AND n_name = 'NATION_1')")
_add("f_self", "SELECT src, dst FROM Graph WHERE src < dst")
_add("f_timestamp", f"SELECT o_orderkey, l_linenumber {_OL} AND l_shipdate < o_orderdate")
_add("j_semi_distinct", "SELECT DISTINCT o_orderkey, o_custkey FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_quantity > 45")
_add("j_two_comparisons", "SELECT DISTINCT g1.src AS src, g1.dst AS dst FROM Graph AS g1, GraphRated AS g2, Graph AS g3 WHERE g1.dst = g2.src AND g2.dst = g3.src AND g1.src < g2.dst AND g1.src + 3 > g2.rating / 40000 AND g3.dst > 2")
_add("j_three_comparisons", "SELECT DISTINCT g1.src AS src, g3.dst AS dst FROM Graph AS g1, Graph AS g2, Graph AS g3 WHERE g1.dst = g2.src AND g2.dst = g3.src AND g1.src < g3.dst AND g1.dst < g3.dst + 5 AND g1.src + g1.dst > g3.src")
_add("j_band", "SELECT e1.event_id AS id1, e2.event_id AS id2 FROM events e1, events e2 WHERE e1.user_id = e2.user_id AND e1.ts <= e2.ts AND e1.ts + INTERVAL '1' DAY >= e2.ts AND e1.event_id <> e2.event_id")
_add("j_composite", "SELECT g1.src AS src, g1.dst AS dst, g2.rating AS rating FROM Graph g1, GraphRated g2 WHERE g1.src = g2.src AND g1.dst = g2.dst")
_add("j_explicit_on", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
_add("j_left_outer", "SELECT s_suppkey, c_custkey FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 5000")
_add("j_exists", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
_add("j_cross", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey < 2 AND n_nationkey < 3")
_add("a_distinct", "SELECT DISTINCT c_mktsegment, n_regionkey FROM customer, nation WHERE c_nationkey = n_nationkey")
_add("a_global", f"SELECT COUNT(*) AS n, COUNT(l_shipdate) AS m {_OL}")
_add("a_min_max", "SELECT l_returnflag, MIN(o_orderdate) AS first_day, MAX(l_extendedprice) AS most FROM orders, lineitem WHERE o_orderkey = l_orderkey GROUP BY 1")
_add("a_avg", f"SELECT o_orderpriority, ROUND({total('l_quantity')} / COUNT(l_quantity), 6) AS avg_qty {_OL} GROUP BY 1")
_add("a_avg_native", f"SELECT o_orderpriority, ROUND(AVG(l_quantity), 4) AS avg_qty {_OL} GROUP BY 1")
_add("a_count_distinct", f"SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n {_OL} GROUP BY 1")
_add("a_having", f"SELECT o_custkey, COUNT(*) AS n {_OL} GROUP BY 1 HAVING COUNT(*) > 40")
_add("a_rollup", "SELECT r_name, n_name, COUNT(*) AS n FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
_add("a_set_mode", "SELECT DISTINCT o_custkey FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_quantity > 49")
_add("k_order_limit", f"SELECT c_name, {REVENUE} AS revenue FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY 1 ORDER BY revenue DESC, c_name LIMIT 10")
_add("k_offset", "SELECT n_name FROM nation ORDER BY n_name LIMIT 5 OFFSET 3")
_add("w_rank", "SELECT c_custkey, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer")
_add("u_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_add("u_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_add("u_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
_add("x_case", f"SELECT l_returnflag, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 WHEN o_orderpriority LIKE '3%' THEN 2 ELSE 0 END) AS BIGINT) AS points {_OL} GROUP BY 1")
_add("x_year", f"SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, COUNT(*) AS n {_OL} GROUP BY 1")
_add("x_interval", f"SELECT o_orderkey, l_linenumber {_OL} AND o_orderdate + INTERVAL '30' DAY < l_shipdate")
_add("x_date", f"SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d {_OL} AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND l_quantity > 48")
_add("x_date_interval", f"SELECT o_orderkey, l_linenumber, CAST(CAST(o_orderdate AS DATE) + INTERVAL '30' DAY AS DATE) AS due {_OL} AND CAST(o_orderdate AS DATE) + INTERVAL '30' DAY < CAST(l_shipdate AS DATE) AND CAST(l_shipdate AS DATE) - INTERVAL '90' DAY < CAST(o_orderdate AS DATE)")
_add("x_intdiv", "SELECT src, dst, (src + dst) DIV 2 AS half FROM Graph", "SELECT src, dst, CAST((src + dst) // 2 AS BIGINT) AS half FROM Graph")
_add("x_arith", f"SELECT o_orderkey, l_linenumber, l_quantity * 2 + o_orderkey - 1 AS v, l_extendedprice / l_quantity AS unit {_OL} AND l_quantity * 2 > o_totalprice / 10000")
_add("x_cast", "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS d, CAST(n_nationkey AS BIGINT) AS b FROM nation")

#: The same queries by the join-tree plan, whatever `auto` would do.
for _name in (
    "graph_q1", "graph_q2", "graph_q3", "graph_q4", "graph_q5", "graph_q6", "graph_q7", "graph_q8", "graph_q10", "trade_q9", "rst_q11", "topk_line2", "topk_line3", "topk_line4", "topk_star", "topk_tree", "j_triangle",
    "tpch_q3", "tpch_q4", "tpch_q5", "tpch_q7", "tpch_q8", "tpch_q10", "tpch_q12", "tpch_q18", "f_or_residual", "f_string_cmp", "j_band", "j_composite", "j_explicit_on", "a_count_distinct",
    "j_semi_distinct", "j_two_comparisons", "j_three_comparisons", "a_distinct", "a_set_mode", "tpch_q9_nops", "tpch_q14", "tpch_q15", "tpch_q17", "tpch_q19",
    "f_star", "f_like", "f_not_like", "f_in", "f_not_in", "f_between", "f_or_local", "f_not_null", "f_neq", "f_not", "f_timestamp", "a_global", "a_min_max", "a_avg", "a_avg_native", "a_having", "k_order_limit",
    "x_case", "x_year", "x_interval", "x_date", "x_date_interval", "x_arith",
):
    QUERIES[f"reduce_{_name}"] = Query(QUERIES[_name].sql, QUERIES[_name].duck, "reduce")
for _name, _sql in (("set_graph_q4", "graph_q4"), ("set_graph_q5", "graph_q5"), ("set_a_mode", "a_set_mode")):
    QUERIES[_name] = Query(QUERIES[_sql].sql.replace("SELECT DISTINCT", "SELECT", 1), QUERIES[_sql].sql, "reduce", "set")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the tables of a folder and the fixtures."""
    out = Engine(spark)
    for t in TABLES:
        out.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"), KEYS.get(t, ()), CARDINALITIES.get(t, 0))
    for name, sql in FIXTURES.items():
        out.register(name, spark.sql(sql))
    return out


def _run(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(q.sql, strategy=q.strategy, semantics=q.semantics)


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.joins import triangles as find

    engine(spark, sf_dir)
    return find(spark.table("Graph")).toDF("a", "b", "c")


def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.joins import band as join

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    return join(events, events, ["user_id"], "ts", "ts", 1).where("event_id <> r_event_id").selectExpr("event_id id1", "r_event_id id2")


def staircase(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.joins import semi_two

    engine(spark, sf_dir)
    most = (F.col("src").cast("long") + 5) * 10000  # beyond 32 bits from src 214,744 on
    a = spark.table("Graph").select("src", "dst", most.cast("double").alias("most"))
    b = spark.sql("SELECT src, dst AS low, rating FROM GraphRated")
    return semi_two(a, b, [(a["src"], b["src"])], (b["low"], "<", a["dst"]), (b["rating"], "<", a["most"]))


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared table, read from the folder instead of where its declaration says."""
    e = Engine(spark)
    e.declare("CREATE TABLE DeclaredNation (n_nationkey INT, n_name VARCHAR, n_regionkey INT, PRIMARY KEY (n_nationkey)) WITH ('path' = 'elsewhere/nation.parquet', 'cardinality' = '25')", folder=sf_dir)
    e.declare("CREATE TABLE DeclaredRegion (r_regionkey INT, r_name VARCHAR, PRIMARY KEY (r_regionkey)) WITH ('path' = 'elsewhere/region.parquet', 'cardinality' = '5')", folder=sf_dir)
    return e.sql("SELECT n_nationkey, n_name, r_name FROM DeclaredNation, DeclaredRegion WHERE n_regionkey = r_regionkey", strategy="reduce")


def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as the printed output has them."""
    from .sources import files

    return files.formatted(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts"))


OPERATORS = {"op_triangles": triangles, "op_band_join": band, "op_staircase_semi": staircase, "s_declared": declared, "s_formatted": formatted}
OPERATOR_SQL = {
    "s_declared": "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "s_formatted": "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts FROM events",
    "op_triangles": QUERIES["j_triangle"].sql,
    "op_band_join": QUERIES["j_band"].sql,
    "op_staircase_semi": "SELECT src, dst, CAST((src + 5) * 10000 AS DOUBLE) AS most FROM Graph g WHERE EXISTS (SELECT 1 FROM GraphRated r WHERE r.src = g.src AND r.dst < g.dst AND r.rating < (g.src + 5) * 10000)",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(q) for name, q in QUERIES.items()} | OPERATORS


def oracle_sql() -> dict[str, str]:
    prefix = "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in FIXTURES.items())
    texts = {name: q.duck or q.sql for name, q in QUERIES.items()} | OPERATOR_SQL
    # subqueries keep ORDER BY and LIMIT apart from the WITH
    return {name: f"{prefix} SELECT * FROM ({sql})" for name, sql in texts.items()}
