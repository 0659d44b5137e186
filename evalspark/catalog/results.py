"""Comparison of golden and agent results."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog import query
from evalspark.functions.encode import encode_rows
from evalspark.operators import diff
from evalspark.operators.multiset import multiset_match

KEYS = ["case_id"]
VALUES = ["l_returnflag", "l_linestatus", "n", "sum_qty"]

# shared pieces of the checks
TOLERANT = ("abs(g_{c} - a_{c}) <= greatest(1e-5 * greatest(abs(g_{c}), abs(a_{c})), 1e-8)")
COUNTS = """SELECT coalesce(g.case_id, a.case_id) AS case_id, coalesce(n_golden, 0) AS n_golden,
    coalesce(n_agent, 0) AS n_agent
  FROM (SELECT case_id, count(*) AS n_golden FROM {golden_results} GROUP BY case_id) g
  FULL JOIN (SELECT case_id, count(*) AS n_agent FROM {agent_results} GROUP BY case_id) a ON g.case_id = a.case_id"""
RANKED = """SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY l_returnflag NULLS LAST,
    l_linestatus NULLS LAST, n NULLS LAST, sum_qty NULLS LAST) AS pos FROM {side}"""
ALIGNED = f"""SELECT coalesce(g.case_id, a.case_id) AS case_id, coalesce(g.pos, a.pos) AS pos,
    g.case_id IS NOT NULL AS has_g, a.case_id IS NOT NULL AS has_a,
    g.l_returnflag AS g_flag, a.l_returnflag AS a_flag, g.l_linestatus AS g_status, a.l_linestatus AS a_status,
    g.n AS g_n, a.n AS a_n, g.sum_qty AS g_sum_qty, a.sum_qty AS a_sum_qty
  FROM ({RANKED.replace('{side}', '{golden_results}')}) g
  FULL JOIN ({RANKED.replace('{side}', '{agent_results}')}) a ON g.case_id = a.case_id AND g.pos = a.pos"""
MARKED = f"""SELECT *, coalesce(has_g AND has_a AND g_flag = a_flag AND g_status = a_status
    AND {TOLERANT.format(c='n')} AND {TOLERANT.format(c='sum_qty')}, false) AS ok,
  coalesce(has_g AND has_a AND g_flag = a_flag AND g_status = a_status AND g_n = a_n
    AND g_sum_qty = a_sum_qty, false) AS same FROM ({ALIGNED})"""
VALUE_COUNTS = f"""SELECT case_id, count(*) FILTER (WHERE NOT ok) AS apart,
  count(*) FILTER (WHERE NOT same) AS mismatched_rows FROM ({MARKED}) GROUP BY case_id"""
LAYOUT = """SELECT g.case_id, g.cols AS golden_cols, a.cols AS agent_cols,
    CASE WHEN a.cols <> g.cols THEN 'sum_qty' ELSE '' END AS only_golden,
    CASE WHEN a.cols <> g.cols THEN 'total_qty' ELSE '' END AS only_agent
  FROM {result_columns} g JOIN {result_columns} a ON g.case_id = a.case_id AND g.side = 'golden' AND a.side = 'agent'"""
QUOTED = "concat('[''', replace({c}, ',', ''', '''), ''']')"
OUTCOMES = f"""SELECT l.case_id, l.golden_cols = l.agent_cols AS columns_match, l.only_golden, l.only_agent,
    golden_cols, agent_cols, n_golden, n_agent, n_agent - n_golden AS row_delta, mismatched_rows,
    CASE WHEN golden_cols <> agent_cols THEN 'columns' WHEN n_golden <> n_agent THEN 'row_count'
         WHEN apart > 0 THEN 'values' ELSE 'match' END AS outcome
  FROM ({LAYOUT}) l JOIN ({COUNTS}) c ON l.case_id = c.case_id JOIN ({VALUE_COUNTS}) v ON l.case_id = v.case_id"""
CELL = "CASE WHEN g_{c} <> a_{c} THEN concat('{name} peak=', CAST(g_{c} AS STRING), ' agent=', CAST(a_{c} AS STRING)) END"
FIRST_ROWS = f"""SELECT case_id, string_agg(concat('row ', pos, ': ', concat_ws('; ', {CELL.format(c='flag', name='l_returnflag')},
    {CELL.format(c='status', name='l_linestatus')}, {CELL.format(c='n', name='n')}, {CELL.format(c='sum_qty', name='sum_qty')})),
    chr(10) ORDER BY pos) AS shown
  FROM (SELECT * FROM ({MARKED}) WHERE NOT same QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY pos) <= 5) GROUP BY case_id"""
SUMMARY = f"""SELECT case_id, outcome = 'match' AS matched, outcome, CASE outcome
    WHEN 'columns' THEN concat('column mismatch (peak: ', {QUOTED.format(c='golden_cols')}, ', agent: ',
                               {QUOTED.format(c='agent_cols')}, ')')
    WHEN 'row_count' THEN concat('row count differs: peak=', n_golden, ', agent=', n_agent, ' (',
                                 CASE WHEN row_delta > 0 THEN '+' ELSE '' END, row_delta, ')')
    WHEN 'values' THEN concat('values differ in ', n_golden, ' rows (', mismatched_rows, ' mismatched)')
    ELSE 'results match' END AS summary, CASE outcome
    WHEN 'columns' THEN concat('missing in agent: [''', only_golden, ''']', chr(10),
                               'extra in agent: [''', only_agent, ''']')
    WHEN 'row_count' THEN concat('agent returned ', abs(row_delta), CASE WHEN row_delta > 0 THEN ' extra' ELSE ' fewer' END, ' rows')
    WHEN 'values' THEN concat('first mismatching rows:', chr(10), shown)
    ELSE '' END AS detail FROM ({OUTCOMES}) LEFT JOIN ({FIRST_ROWS}) USING (case_id)"""


def _rows(t):
    return diff.both_sides(t.golden_results, t.agent_results)


def _layouts(t):
    return t.result_columns.withColumn("cols", F.split("cols", ","))


def _diffs(t):
    return diff.diff_batch(_rows(t), KEYS, VALUES, _layouts(t))


@query("diff_columns", f"""
SELECT case_id, golden_cols = agent_cols AS columns_match, only_golden, only_agent FROM ({LAYOUT})""")
def diff_columns(t):
    return diff.layout_diff(_layouts(t), KEYS).select(
        "case_id", "columns_match", F.array_join("only_golden", ",").alias("only_golden"),
        F.array_join("only_agent", ",").alias("only_agent"),
    )


@query("diff_counts", f"SELECT *, n_agent - n_golden AS row_delta FROM ({COUNTS})")
def diff_counts(t):
    return diff.result_sizes(_rows(t), KEYS).withColumn("row_delta", F.col("n_agent") - F.col("n_golden"))


@query("row_cap_guard", """
SELECT l_returnflag, count(*) AS n_rows,
  CASE WHEN count(*) > 10000 THEN concat('returned ', format('{{:,}}', count(*)), ' rows — exceeds 10,000 row cap') END AS reason
FROM {lineitem} GROUP BY l_returnflag""".replace("{{:,}}", "{:,}"))
def row_cap_guard(t):
    return diff.row_cap_guard(t.lineitem, ["l_returnflag"])


@query("aligned_rows", f"""
SELECT case_id, pos, g_flag, a_flag, g_status, a_status, g_n, a_n, round(g_sum_qty, 4) AS g_sum_qty,
  round(a_sum_qty, 4) AS a_sum_qty FROM ({ALIGNED})""")
def aligned_rows(t):
    return diff.aligned_rows(_rows(t), KEYS, VALUES).select(
        "case_id", "pos",
        F.col("g.l_returnflag").alias("g_flag"), F.col("a.l_returnflag").alias("a_flag"),
        F.col("g.l_linestatus").alias("g_status"), F.col("a.l_linestatus").alias("a_status"),
        F.col("g.n").alias("g_n"), F.col("a.n").alias("a_n"),
        F.round("g.sum_qty", 4).alias("g_sum_qty"), F.round("a.sum_qty", 4).alias("a_sum_qty"),
    )


@query("exec_match", f"SELECT case_id, outcome = 'match' AS matched, outcome FROM ({OUTCOMES})")
def exec_match(t):
    return _diffs(t).select("case_id", "matched", "outcome")


@query("exec_match_encoded", f"""
SELECT case_id, n_golden = n_agent AND apart = 0 AS matched,
  CASE WHEN n_golden = n_agent THEN mismatched_rows END AS mismatched_rows FROM ({COUNTS}) JOIN ({VALUE_COUNTS}) USING (case_id)""")
def exec_match_encoded(t):
    """The same comparison over encoded rows, as used when results differ in schema."""
    rows = diff.both_sides(encode_rows(t.golden_results, KEYS), encode_rows(t.agent_results, KEYS))
    counted = F.when(F.col("row_delta") == 0, F.col("mismatched_rows")).alias("mismatched_rows")
    return diff.diff_batch(rows, KEYS, [diff.CELLS]).select("case_id", "matched", counted)


@query("diff_summary", SUMMARY)
def diff_summary(t):
    return _diffs(t).select("case_id", "matched", "outcome", "summary", "detail")


@query("diff_mismatch_count", f"SELECT case_id, apart, mismatched_rows FROM ({VALUE_COUNTS})")
def diff_mismatch_count(t):
    judged = diff.judged_rows(diff.aligned_rows(_rows(t), KEYS, VALUES), VALUES)
    return judged.groupBy("case_id").agg(
        F.count_if(~F.col("ok")).alias("apart"), F.count_if(~F.col("same")).alias("mismatched_rows")
    )


@query("diff_sample", f"""
WITH differing AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS nth
  FROM ({MARKED}) JOIN ({COUNTS}) USING (case_id) WHERE n_golden = n_agent AND NOT same QUALIFY nth <= 5)
SELECT case_id, pos, 'l_returnflag' AS "column", g_flag AS golden_value, a_flag AS agent_value
FROM differing WHERE g_flag <> a_flag
UNION ALL SELECT case_id, pos, 'l_linestatus', g_status, a_status FROM differing WHERE g_status <> a_status
UNION ALL SELECT case_id, pos, 'n', CAST(g_n AS STRING), CAST(a_n AS STRING) FROM differing WHERE g_n <> a_n
UNION ALL SELECT case_id, pos, 'sum_qty', CAST(round(g_sum_qty, 4) AS STRING), CAST(round(a_sum_qty, 4) AS STRING)
FROM differing WHERE g_sum_qty <> a_sum_qty""")
def diff_sample(t):
    # values are rounded for display only after the comparison
    sample = diff.diff_sample(_rows(t), KEYS, VALUES)
    shown = {
        side: F.when(F.col("column") == "sum_qty", F.round(F.col(side).try_cast("double"), 4).cast("string"))
        .otherwise(F.col(side))
        for side in ("golden_value", "agent_value")
    }
    return sample.withColumns(shown)


@query("sub_signals", f"""
SELECT case_id, columns_match, CASE WHEN columns_match THEN n_golden = n_agent END AS row_count_match,
  CASE WHEN columns_match AND n_golden = n_agent THEN outcome = 'match' END AS values_match
FROM ({OUTCOMES})""")
def sub_signals(t):
    return diff.sub_signals(_diffs(t), KEYS)


PAIR_GROUPS = """SELECT coalesce(g.l_returnflag, a.l_returnflag) AS l_returnflag, g.k IS NOT NULL AS has_g,
    a.k IS NOT NULL AS has_a, coalesce(abs(g.l_quantity - a.l_quantity)
      <= greatest(1e-5 * greatest(abs(g.l_quantity), abs(a.l_quantity)), 1e-8), false) AS ok,
    coalesce(g.o, a.o) AS o, coalesce(g.l, a.l) AS l
  FROM (SELECT 1 AS k, l_orderkey AS o, l_linenumber AS l, l_returnflag, l_quantity, row_number() OVER (
          PARTITION BY l_orderkey, l_linenumber, l_returnflag ORDER BY l_quantity) AS pos FROM {lineitem}) g
  FULL JOIN (SELECT 1 AS k, l_orderkey AS o, l_linenumber AS l, l_returnflag, l_quantity, row_number() OVER (
          PARTITION BY l_orderkey, l_linenumber, l_returnflag ORDER BY l_quantity) AS pos FROM {perturbed_lineitem}) a
    ON g.o = a.o AND g.l = a.l AND g.l_returnflag = a.l_returnflag AND g.pos = a.pos"""


@query("exec_match_multiset", f"""
SELECT l_returnflag, CAST(sum(n_golden) AS BIGINT) AS n_golden, CAST(sum(n_agent) AS BIGINT) AS n_agent,
  count(*) FILTER (WHERE NOT matched) AS differing_groups, bool_and(matched) AS matched
FROM (SELECT l_returnflag, o, l, count(*) FILTER (WHERE has_g) AS n_golden, count(*) FILTER (WHERE has_a) AS n_agent,
        bool_and(ok) AS matched FROM ({PAIR_GROUPS}) GROUP BY l_returnflag, o, l)
GROUP BY l_returnflag""")
def exec_match_multiset(t):
    return multiset_match(
        t.lineitem, t.perturbed_lineitem, ["l_returnflag"], ["l_orderkey", "l_linenumber"], ["l_quantity"]
    )


# quantities are whole and discounts whole percents, far apart beside the tolerance, so rounding undoes the noise
CANONICAL = """SELECT l_returnflag, l_linestatus, round(q) AS q, round(d, 2) AS d, count(*) AS n FROM {side} GROUP BY ALL"""


@query("exec_match_multiset_numbers", f"""
SELECT l_returnflag, CAST(sum(n_golden) AS BIGINT) AS n_golden, CAST(sum(n_agent) AS BIGINT) AS n_agent,
  count(*) FILTER (WHERE NOT matched) AS differing_groups, bool_and(matched) AS matched
FROM (SELECT coalesce(g.l_returnflag, a.l_returnflag) AS l_returnflag, coalesce(g.l_linestatus, a.l_linestatus) AS l_linestatus,
        sum(coalesce(g.n, 0)) AS n_golden, sum(coalesce(a.n, 0)) AS n_agent, bool_and(coalesce(g.n = a.n, false)) AS matched
      FROM ({CANONICAL.replace('{side}', '{noisy_golden}')}) g FULL JOIN ({CANONICAL.replace('{side}', '{noisy_agent}')}) a
        ON g.l_returnflag = a.l_returnflag AND g.l_linestatus = a.l_linestatus AND g.q = a.q AND g.d = a.d
      GROUP BY ALL)
GROUP BY l_returnflag""")
def exec_match_multiset_numbers(t):
    """Two noisy numbers, a sixth of all rows in one group, nearly all rows tied in either number."""
    return multiset_match(t.noisy_golden, t.noisy_agent, ["l_returnflag"], ["l_linestatus"], ["q", "d"])


@query("exec_match_pair", """
WITH g AS (SELECT l_returnflag, l_linestatus, l_quantity, l_orderkey, row_number() OVER (ORDER BY l_returnflag, l_linestatus,
       l_quantity, l_orderkey) AS pos FROM {lineitem}),
a AS (SELECT l_returnflag, l_linestatus, q AS l_quantity, l_orderkey, row_number() OVER (ORDER BY l_returnflag, l_linestatus,
       q, l_orderkey) AS pos FROM (SELECT *, CASE WHEN l_orderkey % 1000 = 1 THEN l_quantity + 1 ELSE l_quantity END AS q
       FROM {lineitem}))
SELECT false AS matched, 'values' AS outcome, concat('values differ in ', count(*), ' rows (',
    count(*) FILTER (WHERE g.l_returnflag <> a.l_returnflag OR g.l_linestatus <> a.l_linestatus
                     OR g.l_quantity <> a.l_quantity OR g.l_orderkey <> a.l_orderkey), ' mismatched)') AS summary,
  count(*) FILTER (WHERE g.l_returnflag <> a.l_returnflag OR g.l_linestatus <> a.l_linestatus
                     OR g.l_quantity <> a.l_quantity OR g.l_orderkey <> a.l_orderkey) AS mismatched_rows
FROM g JOIN a ON g.pos = a.pos""")
def exec_match_pair(t):
    columns = ["l_returnflag", "l_linestatus", "l_quantity", "l_orderkey"]
    golden = t.lineitem.select(*columns)
    changed = F.when(F.col("l_orderkey") % 1000 == 1, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    return diff.diff_frames(golden, golden.withColumn("l_quantity", changed)).select(
        "matched", "outcome", "summary", "mismatched_rows"
    )
