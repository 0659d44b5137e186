"""Question shapes of the golden corpus, and wrong answers to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from evalspark.catalog import query
from evalspark.functions.encode import encode_rows
from evalspark.operators import diff
from evalspark.plans import golden_queries as G
from evalspark.session import durable


@query("q_total_count", "SELECT count(*) AS total_members FROM customer")
def q_total_count(t):
    return G.total_count(t.customer)


@query("q_avg_year", "SELECT round(avg(o_totalprice), 6) AS avg_price FROM orders WHERE extract(year FROM o_orderdate) = 2000")
def q_avg_year(t):
    return G.average_in_year(t.orders)


@query("q_last_quarter", """
SELECT o_orderpriority, count(*) AS n_orders FROM orders
WHERE o_orderdate >= date_trunc('quarter', DATE '2001-07-15' - INTERVAL 3 MONTH)
  AND o_orderdate < date_trunc('quarter', DATE '2001-07-15') GROUP BY o_orderpriority""")
def q_last_quarter(t):
    return G.last_quarter_by_key(t.orders)


@query("q_filtered_count", "SELECT count(*) AS active_members FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_filtered_count(t):
    return G.filtered_count(t.customer)


@query("q_cond_ratio", """
SELECT round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 9) AS finished_rate FROM orders
WHERE date_trunc('quarter', o_orderdate) = DATE '2000-01-01'""")
def q_cond_ratio(t):
    return G.conditional_ratio(t.orders)


@query("q_net_revenue", """
SELECT round(sum(l_extendedprice) - sum(l_extendedprice * l_discount) - sum(l_extendedprice * l_tax), 2) AS net_revenue
FROM lineitem WHERE extract(year FROM l_shipdate) = 2000""")
def q_net_revenue(t):
    return G.net_revenue(t.lineitem)


@query("q_two_months", """
SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n_orders FROM orders
WHERE o_orderdate >= TIMESTAMP '2001-05-01' AND o_orderdate < TIMESTAMP '2001-07-01' GROUP BY 1 ORDER BY 1""")
def q_two_months(t):
    return G.last_two_months(t.orders)


@query("q_top100", """
WITH per_customer AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total_price FROM orders GROUP BY o_custkey)
SELECT * FROM per_customer ORDER BY total_price DESC, o_custkey LIMIT 100""")
def q_top100(t):
    return G.top_totals(t.orders)


@query("q_never_ordered", """
SELECT count(*) AS never_ordered FROM customer c
LEFT JOIN (SELECT * FROM orders WHERE o_orderdate >= DATE '2001-07-01') o ON c.c_custkey = o.o_custkey
WHERE o.o_custkey IS NULL""")
def q_never_ordered(t):
    return G.never_ordered(t.customer, t.orders)


@query("q_top10_trailing", """
SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_orderdate >= DATE '2001-07-15' - INTERVAL 12 MONTH
GROUP BY o_custkey ORDER BY n_orders DESC, o_custkey LIMIT 10""")
def q_top10_trailing(t):
    return G.top_trailing_year(t.orders)


@query("q_empty_point", "SELECT * FROM orders WHERE o_custkey = 999999999 ORDER BY o_orderkey LIMIT 100")
def q_empty_point(t):
    return G.point_lookup(t.orders)


@query("q_between_avg", """
SELECT round(avg(o_totalprice), 6) AS avg_price FROM orders
WHERE o_orderdate BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""")
def q_between_avg(t):
    return G.between_average(t.orders)


@query("q_daily", """
SELECT CAST(o_orderdate AS DATE) AS order_day, count(*) AS n_orders FROM orders
WHERE o_orderdate >= DATE '2001-06-01' GROUP BY 1""")
def q_daily(t):
    return G.daily_counts(t.orders)


@query("q_monthly", """
SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n_orders FROM orders
WHERE o_orderdate >= DATE '2001-01-01' GROUP BY 1""")
def q_monthly(t):
    return G.monthly_counts(t.orders)


@query("q_project", "SELECT p_brand, p_type, p_retailprice FROM part")
def q_project(t):
    return G.projection(t.part)


@query("q_month_string", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 6) AS avg_price FROM orders
WHERE strftime(o_orderdate, '%Y-%m') >= '2001-01' GROUP BY 1""")
def q_month_string(t):
    return G.month_as_text(t.orders)


@query("q_filter_clause", """
SELECT round(count(*) FILTER (WHERE o_orderstatus = 'F') * 1.0::DOUBLE / count(*), 9) AS finished_rate FROM orders""")
def q_filter_clause(t):
    return G.rate_by_filter(t.orders)


@query("q_sum_case", """
SELECT round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 1.0::DOUBLE / count(*), 9) AS finished_rate FROM orders""")
def q_sum_case(t):
    return G.rate_by_case(t.orders)


@query("q_avg_segment", "SELECT round(avg(c_acctbal), 6) AS avg_balance FROM customer WHERE c_mktsegment = 'MACHINERY'")
def q_avg_segment(t):
    return G.average_of_segment(t.customer)


@query("q_column_ratio", """
SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit_price FROM lineitem""")
def q_column_ratio(t):
    return G.column_ratio(t.lineitem)


@query("q_sum_if", """
SELECT date_trunc('month', l_shipdate) AS month,
  sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS finished_quantity, sum(l_quantity) AS all_quantity
FROM lineitem GROUP BY 1""")
def q_sum_if(t):
    return G.sum_if_by_month(t.lineitem)


@query("q_safe_ratio", """
SELECT date_trunc('month', o_orderdate) AS month, round(
  count(DISTINCT CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN o_custkey END) * 1.0::DOUBLE
  / nullif(count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END), 0), 9) AS urgent_rate
FROM orders GROUP BY 1""")
def q_safe_ratio(t):
    return G.safe_distinct_ratio(t.orders)


@query("q_wrong_agg_pair", """
SELECT o_orderstatus, count(*)::DOUBLE AS golden_total, round(sum(o_totalprice), 2) AS agent_total,
  abs(count(*) - round(sum(o_totalprice), 2)) <= 1e-5 * greatest(count(*), round(sum(o_totalprice), 2)) AS matched
FROM orders GROUP BY o_orderstatus""")
def q_wrong_agg_pair(t):
    key = ["o_orderstatus"]
    golden, agent = G.counted_orders(t.orders), G.summed_orders(t.orders)
    verdicts = diff.diff_batch(diff.both_sides(golden, agent), key).select(*key, "matched")
    named = golden.withColumnRenamed("total_orders", "golden_total").join(
        agent.withColumnRenamed("total_orders", "agent_total"), key
    )
    return named.join(verdicts, key)


def answer_pairs(t) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Question -> (golden answer, agent answer): right, wrong and merely different SQL."""
    orders, customer, part = t.orders, t.customer, t.part
    return {
        "clean": (G.filtered_count(customer), G.filtered_count(customer)),
        "missing_filter": (
            G.filtered_count(customer), G.total_count(customer).withColumnRenamed("total_members", "active_members")
        ),
        "wrong_grouping": (
            G.daily_counts(orders),
            G.monthly_counts(orders, G.dt.date(2001, 6, 1)).select(F.to_date("month").alias("order_day"), "n_orders"),
        ),
        "missing_column": (G.price_by(part, "p_brand", "p_type"), G.price_by(part, "p_brand")),
        "equal_rewrite": (G.rate_by_filter(orders), G.rate_by_case(orders)),
        "count_for_rate": (G.rate_by_filter(orders), G.count_as_rate(orders)),
        "dropped_condition": (
            G.sum_if_by_month(t.lineitem).select("month", F.col("finished_quantity").alias("quantity")),
            G.sum_if_by_month(t.lineitem).select("month", F.col("all_quantity").alias("quantity")),
        ),
        "between_for_year": (G.average_in_year(orders), G.between_average(orders)),
        "empty": (G.point_lookup(orders), G.point_lookup(orders)),
    }


def encoded_answers(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """All answers in one long table of encoded rows, and their column lists."""
    rows, layouts = [], []
    for case_id, sides in pairs.items():
        for side, frame in zip((diff.GOLDEN, diff.AGENT), sides):
            tags = {"case_id": F.lit(case_id), "side": F.lit(side)}
            rows.append(encode_rows(frame.withColumns(tags), ["case_id", "side"]))
            layouts.append((case_id, side, frame.columns))
    layout = frame.sparkSession.createDataFrame(layouts, "case_id string, side string, cols array<string>")
    return reduce(DataFrame.unionByName, rows), layout


def _count_pair(case_id: str, golden: str, agent: str, outcome: str) -> str:
    return f"""SELECT '{case_id}' AS case_id, '{outcome}' AS outcome,
  (SELECT count(*) FROM ({golden})) AS n_golden, (SELECT count(*) FROM ({agent})) AS n_agent"""


ONE = "SELECT 1"
DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderdate >= DATE '2001-06-01'"
MONTHS = "SELECT DISTINCT date_trunc('month', o_orderdate) FROM orders WHERE o_orderdate >= DATE '2001-06-01'"
SHIP_MONTHS = "SELECT DISTINCT date_trunc('month', l_shipdate) FROM lineitem"
BRAND_TYPES = "SELECT DISTINCT p_brand, p_type FROM part"
BRANDS = "SELECT DISTINCT p_brand FROM part"
EMPTY = "SELECT 1 FROM orders WHERE o_custkey = 999999999"


@query("golden_pairs", " UNION ALL ".join([
    _count_pair("clean", ONE, ONE, "match"),
    _count_pair("missing_filter", ONE, ONE, "values"),
    _count_pair("wrong_grouping", DAYS, MONTHS, "row_count"),
    _count_pair("missing_column", BRAND_TYPES, BRANDS, "columns"),
    _count_pair("equal_rewrite", ONE, ONE, "match"),
    _count_pair("count_for_rate", ONE, ONE, "values"),
    _count_pair("dropped_condition", SHIP_MONTHS, SHIP_MONTHS, "values"),
    _count_pair("between_for_year", ONE, ONE, "match"),
    _count_pair("empty", EMPTY, EMPTY, "match"),
]))
def golden_pairs(t):
    """Answers of different schemas, stored in one results table and compared in one plan."""
    rows, layouts = encoded_answers(answer_pairs(t))
    return diff.diff_batch(durable(rows), ["case_id"], [diff.CELLS], layouts).select(
        "case_id", "outcome", "n_golden", "n_agent"
    )
