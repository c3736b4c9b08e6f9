"""DuckDB statements that compute every registered query independently of Spark.

Money is counted in whole cents and rounded means and shares are integer divisions, so the
statements share no rounding code with the engine.
"""

from __future__ import annotations

from skumetry.policy import (
    ABC_CLASSES, ABC_IMPLICATIONS, ACTIONS_SCRIPT, ACTIONS_SQL, CELL_TERMS, PROTECT,
    RATIONALISE_SCRIPT, RATIONALISE_SQL, SINGLE_EVENT_SCRIPT, SINGLE_EVENT_SQL, XYZ_APPROACHES,
    XYZ_CLASSES, XYZ_THRESHOLDS,
)


def ratio(part: str, whole: str, digits: int) -> str:
    """part / whole for positive integers, rounded half up to ``digits`` decimals."""
    unit = 10**digits
    return (
        f"(CAST((({part})::HUGEINT * {2 * unit} + ({whole})::HUGEINT) // (2 * ({whole})::HUGEINT) AS DOUBLE)"
        f" / {unit}.0)"
    )


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], name: str, columns: str) -> str:
    body = ", ".join("(" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {name}({columns})"


TX = """
tx AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice_no,
         to_base(l_partkey * 10000 + year(l_shipdate) + 60466176, 36) AS stock_code,
         p_name AS description,
         CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS INTEGER) AS quantity,
         l_shipdate AS invoice_date,
         (2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS cents,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         n_name AS country
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
)"""

CLEAN = TX + """,
clean AS (
  SELECT *, CAST(quantity AS BIGINT) * cents AS line_cents
  FROM tx
  WHERE NOT starts_with(invoice_no, 'C') AND quantity > 0 AND cents > 0
    AND regexp_full_match(stock_code, '[0-9A-Z]{5,}')
)"""

WEEKLY = CLEAN + """,
weekly AS (
  SELECT stock_code, CAST(date_trunc('week', invoice_date) AS DATE) AS week_start,
         CAST(sum(quantity) AS BIGINT) AS qty
  FROM clean GROUP BY ALL
)"""

_STATS_SQL = f"""
stats AS (
  SELECT stock_code, count(*) AS weeks, {ratio('sum(qty)', 'count(*)', 2)} AS mean,
         round(stddev_samp(qty), 2) AS std, round(stddev_samp(qty) / avg(qty), 4) AS cv
  FROM weekly GROUP BY stock_code
)"""

_STATS_SCRIPT = """
moments AS (
  SELECT stock_code, count(*) AS weeks, sum(qty)::HUGEINT AS s, sum(qty::HUGEINT * qty)::HUGEINT AS ss
  FROM weekly GROUP BY stock_code
),
stats AS (
  SELECT stock_code, weeks, s::DOUBLE / weeks::DOUBLE AS mean,
         CASE WHEN weeks > 1 THEN sqrt((weeks * ss - s * s)::DOUBLE / (weeks * (weeks - 1))::DOUBLE) ELSE 0 END AS std,
         std / mean AS cv
  FROM moments
)"""


def stats_cte(script: bool) -> str:
    return WEEKLY + "," + (_STATS_SCRIPT if script else _STATS_SQL)


def sales_cte(script: bool) -> str:
    price = (
        "(sum(cents)::DOUBLE / 100) / count(*)::DOUBLE" if script else ratio("sum(cents)", "count(*) * 100", 4)
    )
    description = (
        "coalesce(mode(description ORDER BY description), '')" if script else "max(description)"
    )
    kind = "TIMESTAMP" if script else "DATE"
    return f"""
sales AS (
  SELECT stock_code, {description} AS description, CAST(sum(quantity) AS BIGINT) AS units,
         CAST(sum(line_cents) AS BIGINT) AS rev, count(DISTINCT invoice_no) AS invoices,
         count(DISTINCT customer_id) AS customers, {price} AS price,
         CAST(min(invoice_date) AS {kind}) AS first_sale, CAST(max(invoice_date) AS {kind}) AS last_sale
  FROM clean GROUP BY stock_code
)"""


def graded_cte(script: bool = False) -> str:
    cum_share = "cum::DOUBLE / tot::DOUBLE" if script else ratio("cum", "tot", 4)
    actions = ACTIONS_SCRIPT if script else ACTIONS_SQL
    return f"""{stats_cte(script)},{sales_cte(script)},
ranked AS (
  SELECT *, sum(rev) OVER w AS cum, sum(rev) OVER () AS tot, row_number() OVER w AS rnk, count(*) OVER () AS n
  FROM sales
  WINDOW w AS (ORDER BY rev DESC, stock_code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
shared AS (SELECT *, {cum_share} AS cum_pct FROM ranked),
classed AS (
  SELECT *, CASE WHEN cum_pct <= 0.80 THEN 'A' WHEN cum_pct <= 0.95 THEN 'B' ELSE 'C' END AS abc,
         CASE WHEN cv IS NULL THEN 'Z' WHEN cv <= 0.5 THEN 'X' WHEN cv <= 1.0 THEN 'Y' ELSE 'Z' END AS xyz
  FROM shared LEFT JOIN stats USING (stock_code)
),
graded AS (
  SELECT *, abc || xyz AS cell, coalesce(action, 'Unclassified') AS strategic_action
  FROM classed LEFT JOIN {values(list(actions.items()), 'actions', 'acell, action')} ON abc || xyz = acell
)"""


def cz_cte(script: bool = False) -> str:
    single, rational = (
        (SINGLE_EVENT_SCRIPT, RATIONALISE_SCRIPT) if script else (SINGLE_EVENT_SQL, RATIONALISE_SQL)
    )
    return f"""{graded_cte(script)},
cz AS (
  SELECT *, weeks = 1 AS single_event, invoices > 3 OR customers > 2 AS loyal,
         CASE WHEN weeks = 1 THEN {text(single)}
              WHEN invoices > 3 OR customers > 2 THEN {text(PROTECT)}
              ELSE {text(rational)} END AS recommended_action
  FROM graded WHERE cell = 'CZ'
)"""


def rop_cte(script: bool = False) -> str:
    return f"{graded_cte(script)},{rop_tables(script)}"


def rop_tables(script: bool) -> str:
    rounding = "round_even" if script else "round"
    return f"""
top80 AS (
  SELECT * FROM graded WHERE weeks >= 3 AND cv IS NOT NULL ORDER BY rev DESC, stock_code LIMIT 80
),
rop AS (
  SELECT *, {rounding}(mean * lt, 0) AS lead_demand, {rounding}(z * std * sqrt(lt), 0) AS buffer,
         {rounding}(mean * lt + z * std * sqrt(lt), 0) AS point, cv > 1.2 AS risk
  FROM top80 JOIN (VALUES ('A', 2.0::DOUBLE, 2.054::DOUBLE, 98), ('B', 3.0::DOUBLE, 1.645::DOUBLE, 95),
                          ('C', 4.0::DOUBLE, 1.281::DOUBLE, 90)) AS p(pclass, lt, z, level)
    ON abc = pclass
)"""


def money(cents: str) -> str:
    return f"({cents})::DOUBLE / 100"


def whole(cents: str) -> str:
    """Cents rounded to whole currency units."""
    return ratio(cents, "100", 0)


def matrix_counts_select(name: str) -> str:
    cells = ", ".join(
        f"coalesce(count(*) FILTER (xyz = '{x}'), 0) AS \"{x}\"" for x in XYZ_CLASSES
    )
    return f"SELECT abc, {cells} FROM {name} GROUP BY abc"


ABC_SPINE = values([(c, ABC_IMPLICATIONS[c]) for c in ABC_CLASSES], "spine", "abc_class, implication")
XYZ_SPINE = values(
    [(c, XYZ_THRESHOLDS[c], XYZ_APPROACHES[c]) for c in XYZ_CLASSES], "spine", "xyz_class, cv_threshold, approach"
)
CELL_SPINE = values(
    [(c.abc_xyz, c.zone, c.service_level, c.review_cycle, c.instruction) for c in CELL_TERMS],
    "spine", "abc_xyz, zone, service_level, review_cycle, instruction",
)


def _master(script: bool) -> str:
    def number(column: str) -> str:
        return f"round({column}, 9)" if script else column

    return f"""WITH {graded_cte(script)}
SELECT stock_code, description, units AS total_qty_sold, {money('rev')} AS total_revenue,
       invoices AS n_invoices, customers AS n_customers, {number('price')} AS avg_unit_price,
       CAST(first_sale AS VARCHAR) AS first_sale_date, CAST(last_sale AS VARCHAR) AS last_sale_date,
       {number('mean')} AS weekly_demand_mean, {number('std')} AS weekly_demand_std, {number('cv')} AS cv,
       weeks AS weeks_with_demand, weeks / 52.0::DOUBLE AS weeks_active_pct, {money('cum')} AS revenue_cumsum,
       {number('cum_pct')} AS revenue_cum_pct, abc AS abc_class, xyz AS xyz_class, cell AS abc_xyz,
       strategic_action,
       CASE WHEN cell <> 'CZ' THEN NULL WHEN weeks = 1 THEN 'SINGLE_EVENT'
            WHEN invoices > 3 OR customers > 2 THEN 'PROTECT' ELSE 'RATIONALISE' END AS rationalisation_flag
FROM graded"""


def _reorder_points(script: bool, head: str = "", tail: str = "") -> str:
    shown = ("round_even(mean, 1)", "round_even(std, 1)") if script else ("mean", "std")

    def number(column: str) -> str:
        return f"round({column}, 9)" if script else column

    return f"""WITH {rop_cte(script)}
SELECT {head or 'stock_code'}, description, abc AS abc_class, xyz AS xyz_class, cell AS abc_xyz,
       level AS service_level_pct, lt AS lead_time_weeks, {shown[0]} AS avg_weekly_demand,
       {shown[1]} AS demand_std_weekly, lead_demand AS avg_demand_lt, buffer AS safety_stock,
       point AS reorder_point, risk AS stockout_risk_flag, {money('rev')} AS annual_revenue,
       {number('price')} AS avg_unit_price, units AS total_qty_sold, {number('mean')} AS weekly_demand_mean,
       {number('std')} AS weekly_demand_std, {number('cv')} AS cv
FROM rop {tail}"""


def _abc_summary(script: bool) -> str:
    if script:
        columns = f"""{money('sum(rev)')} AS total_revenue,
       round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS pct_skus,
       round(sum(rev)::DOUBLE / (sum(sum(rev)) OVER ())::DOUBLE, 9) AS pct_revenue, round(avg(price), 6) AS avg_price"""
    else:
        columns = f"""{whole('sum(rev)')} AS total_revenue,
       {ratio('count(*) * 100', '(sum(count(*)) OVER ())', 1)} AS pct_skus,
       {ratio('sum(rev) * 100', '(sum(sum(rev)) OVER ())', 1)} AS pct_revenue,
       {ratio('sum(round(price * 10000)::BIGINT)', 'count(*) * 10000', 4)} AS avg_price"""
    return f"WITH {graded_cte(script)} SELECT abc AS abc_class, count(*) AS sku_count, {columns} FROM graded GROUP BY abc"


def _xyz_summary(script: bool) -> str:
    share = (
        "round(count(*)::DOUBLE / sum(count(*)) OVER (), 9)" if script
        else ratio("count(*) * 100", "(sum(count(*)) OVER ())", 1)
    )
    return f"""WITH {graded_cte(script)}
SELECT xyz AS xyz_class, count(*) AS sku_count, round(avg(cv), 6) AS cv_mean, round(median(cv), 6) AS cv_median,
       {share} AS pct_skus
FROM graded GROUP BY xyz"""


def _matrix_long(script: bool) -> str:
    if script:
        columns = f"""{money('sum(rev)')} AS revenue,
       round(sum(rev)::DOUBLE / (sum(sum(rev)) OVER ())::DOUBLE, 9) AS pct_revenue,
       round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS pct_skus"""
    else:
        columns = f"""{whole('sum(rev)')} AS revenue,
       {ratio('sum(rev) * 100', '(sum(sum(rev)) OVER ())', 2)} AS pct_revenue,
       {ratio('count(*) * 100', '(sum(count(*)) OVER ())', 2)} AS pct_skus"""
    return f"""WITH {graded_cte(script)}
SELECT abc AS abc_class, xyz AS xyz_class, count(*) AS sku_count, round(avg(cv), 6) AS avg_cv, {columns}
FROM graded GROUP BY abc, xyz"""


def _cz_list(script: bool) -> str:
    def number(column: str) -> str:
        return f"round({column}, 9)" if script else column

    return f"""WITH {cz_cte(script)}
SELECT stock_code, description, cell AS abc_xyz, {money('rev')} AS total_revenue, invoices AS n_invoices,
       customers AS n_customers, {number('mean')} AS weekly_demand_mean, {number('cv')} AS cv,
       weeks AS weeks_with_demand, single_event AS single_event_flag, loyal AS loyal_customer_flag,
       recommended_action
FROM cz"""


def _cz_summary(script: bool) -> str:
    if script:
        columns = f"""{money('sum(rev)')} AS total_revenue, round({money('avg(rev)')}, 6) AS avg_revenue_per_sku,
       round(avg(cv), 6) AS avg_cv, round(avg(customers), 6) AS avg_customers"""
    else:
        columns = f"""{whole('sum(rev)')} AS total_revenue, {ratio('sum(rev)', 'count(*) * 100', 0)} AS avg_revenue_per_sku,
       CASE WHEN count(cv) > 0 THEN {ratio('sum(round(cv * 10000)::BIGINT)', 'greatest(count(cv), 1) * 10000', 3)} END AS avg_cv,
       {ratio('sum(customers)', 'count(*)', 1)} AS avg_customers"""
    return f"""WITH {cz_cte(script)}
SELECT recommended_action, count(*) AS sku_count, {columns} FROM cz GROUP BY recommended_action"""


def _actions() -> str:
    def starts(prefix: str) -> str:
        return f"starts_with(recommended_action, '{prefix}')"

    def revenue(condition: str) -> str:
        return money(f"coalesce(sum(rev) FILTER ({condition}), 0)")

    names = {"protect": "PROTECT", "rationalise": "RATIONALISE", "single_event": "SINGLE"}
    counts = ", ".join(f"count(*) FILTER ({starts(p)}) AS {n}_skus" for n, p in names.items())
    money_columns = ", ".join(f"{revenue(starts(p))} AS {n}_revenue" for n, p in names.items())
    return f"""SELECT count(*) AS cz_skus, {counts}, {revenue('loyal')} AS protected_revenue,
       {revenue('NOT loyal')} AS unprotected_revenue, {money_columns} FROM cz"""


def _summary_stats(script: bool = False) -> str:
    def amount(position, metric, value, detail, shown) -> str:
        return (
            f"SELECT {position} AS position, {text(metric)} AS metric, CAST({value} AS DOUBLE) AS amount,"
            f" CAST({detail} AS DOUBLE) AS detail, {shown} AS value"
        )

    def integer(value: str) -> str:
        return f"format('{{:,}}', CAST({value} AS BIGINT))"

    def pounds(value: str, digits: int) -> str:
        return f"'£' || format('{{:,.{digits}f}}', {value})"

    def percent(value: str) -> str:
        return f"format('{{:.1f}}%', ({value}) * 100)"

    def klass(position, metric, condition) -> str:
        n = f"count(*) FILTER ({condition})"
        part = f"{n}::DOUBLE / count(*)"
        return amount(position, metric, n, part, f"{integer(n)} || ' (' || {percent(part)} || ')'") + " FROM graded"

    total, volatile = money("sum(rev)"), money("coalesce(sum(rev) FILTER (cell IN ('AZ', 'BZ')), 0)")
    a_share = "coalesce(sum(rev) FILTER (abc = 'A'), 0)::DOUBLE / sum(rev)::DOUBLE"
    n_volatile = "count(*) FILTER (cell IN ('AZ', 'BZ'))"

    def action(position, metric, prefix, loyal) -> str:
        n = f"count(*) FILTER (starts_with(recommended_action, '{prefix}'))"
        rev = money(f"coalesce(sum(rev) FILTER ({loyal}), 0)")
        return amount(position, metric, n, rev, f"{integer(n)} || ' (' || {pounds(rev, 0)} || ' revenue)'") + " FROM cz"

    parts = [
        amount(1, "Total SKUs analysed", "count(*)", "NULL", integer("count(*)")) + " FROM graded",
        amount(2, "Total transactions (clean)", "count(*)", "NULL", integer("count(*)")) + " FROM clean",
        amount(3, "Date range", "NULL", "NULL",
               "CAST(CAST(min(invoice_date) AS DATE) AS VARCHAR) || ' to ' || CAST(CAST(max(invoice_date) AS DATE) AS VARCHAR)")
        + " FROM clean",
        amount(4, "Total annual revenue", total, "NULL", pounds(total, 2)) + " FROM graded",
        klass(5, "A-class SKUs", "abc = 'A'"),
        amount(6, "A-class revenue share", a_share, "NULL", percent(a_share)) + " FROM graded",
        klass(7, "B-class SKUs", "abc = 'B'"),
        klass(8, "C-class SKUs", "abc = 'C'"),
        klass(9, "X-class SKUs (predictable)", "xyz = 'X'"),
        klass(10, "Y-class SKUs (moderate)", "xyz = 'Y'"),
        klass(11, "Z-class SKUs (intermittent)", "xyz = 'Z'"),
        klass(12, "CZ SKUs (rationalisation candidates)", "cell = 'CZ'"),
        action(13, "CZ → rationalise (low loyalty)", "RATIONALISE", "NOT loyal"),
        action(14, "CZ → protect (loyal accounts)", "PROTECT", "loyal"),
        amount(15, "AZ+BZ SKUs (management attention)", n_volatile, "NULL", integer(n_volatile)) + " FROM graded",
        amount(16, "AZ+BZ revenue at risk", volatile, "NULL", pounds(volatile, 0)) + " FROM graded",
        amount(17, "Top 80 ROP model: avg safety stock (A)", "avg(buffer) FILTER (abc = 'A')", "NULL",
               "format('{:.0f} units', round_even(avg(buffer) FILTER (abc = 'A'), 0))") + " FROM rop",
        amount(18, "SKUs with stockout risk flag", "count(*) FILTER (risk)", "NULL",
               "CAST(count(*) FILTER (risk) AS VARCHAR) || ' of ' || count(*) || ' SKUs'") + " FROM rop",
    ]
    return (
        f"WITH {cz_cte(script)},{rop_tables(script)} SELECT position, metric, round(amount, 9) AS amount, round(detail, 9) AS detail, value FROM ("
        + " UNION ALL ".join(parts) + ")"
    )


def _kpi_strip(script: bool = False) -> str:
    def tile(position, label, value, shown, note) -> str:
        return (
            f"SELECT {position} AS position, {text(label)} AS label, CAST({value} AS DOUBLE) AS amount,"
            f" {shown} AS value, {note if note.startswith('(SELECT') else text(note)} AS note FROM graded"
        )

    def count(condition: str) -> str:
        return f"count(*) FILTER ({condition})"

    def integer(value: str) -> str:
        return f"format('{{:,}}', CAST({value} AS BIGINT))"

    def millions(value: str) -> str:
        return f"'£' || format('{{:.1f}}', ({value}) / 1e6) || 'M'"

    volatile = "cell IN ('AZ', 'BZ')"
    total, at_risk = money("sum(rev)"), money(f"coalesce(sum(rev) FILTER ({volatile}), 0)")
    tiles = [
        tile(1, "Total SKUs", "count(*)", integer("count(*)"), "After data cleaning"),
        tile(2, "Total Revenue", total, millions(total),
             "(SELECT CAST(CAST(round(months + 0.5) AS INTEGER) AS VARCHAR) || '-month period' FROM period)"),
        tile(3, "A-Class SKUs", count("abc = 'A'"), integer(count("abc = 'A'")), "Drive 80% of revenue"),
        tile(4, "AZ+BZ SKUs", count(volatile), integer(count(volatile)), "High value, unpredictable demand"),
        tile(5, "AZ+BZ Revenue", at_risk, millions(at_risk), "At risk from stockouts"),
        tile(6, "CZ SKUs", count("cell = 'CZ'"), integer(count("cell = 'CZ'")), "Rationalisation candidates"),
        tile(7, "Z-Class SKUs", count("xyz = 'Z'"), integer(count("xyz = 'Z'")), "Intermittent demand (CV>1)"),
        tile(8, "ROP Model", "(SELECT count(*) FROM rop)", "(SELECT 'Top ' || count(*) || ' SKUs' FROM rop)", "95-98% service level targets"),
        tile(9, "Data Source", "NULL", "(SELECT first_date || ' to ' || last_date FROM period)",
             "(SELECT format('{:,}', n) || ' transactions' FROM period)"),
    ]
    # An aggregate without aggregate functions would return every row.
    tiles = tiles[:7] + [t + " HAVING count(*) >= 0" for t in tiles[7:]]
    # Whole months plus the days over them in 31sts; two last days of months are whole months apart.
    period = """
period AS (
  SELECT CAST(f AS VARCHAR) AS first_date, CAST(l AS VARCHAR) AS last_date, n,
         (year(l) - year(f)) * 12 + month(l) - month(f)
         + CASE WHEN day(f) = day(l) OR (f = last_day(f) AND l = last_day(l)) THEN 0 ELSE (day(l) - day(f)) / 31.0 END AS months
  FROM (SELECT CAST(min(invoice_date) AS DATE) AS f, CAST(max(invoice_date) AS DATE) AS l, count(*) AS n FROM clean)
)"""
    return f"WITH {rop_cte(script)},{period} " + " UNION ALL ".join(tiles)


def _histogram(script: bool = False) -> str:
    return f"""WITH {graded_cte(script)},
clipped AS (SELECT least(greatest(cv, 0.0::DOUBLE), 3.0::DOUBLE) AS v FROM graded WHERE cv IS NOT NULL),
extent AS (
  SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
         CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM clipped
),
placed AS (
  SELECT least(CAST(floor((v - (SELECT lo FROM extent)) * 60.0::DOUBLE
               / ((SELECT hi FROM extent) - (SELECT lo FROM extent))) AS INTEGER), 59) AS bin
  FROM clipped
)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 60 * b.bin, 9) AS bin_low,
       round(lo + (hi - lo) / 60 * (b.bin + 1), 9) AS bin_high, count(placed.bin) AS sku_count
FROM range(60) AS b(bin) CROSS JOIN extent LEFT JOIN placed ON placed.bin = b.bin
GROUP BY b.bin, lo, hi"""


def _both(script: bool) -> dict[str, str]:
    """Queries that read the same under both variants, over the tables of one of them."""
    graded, cz, rop = graded_cte(script), cz_cte(script), rop_cte(script)
    counts = matrix_counts_select("graded")
    revenue_cells = ", ".join(
        f"{money(f'''coalesce(sum(rev) FILTER (xyz = '{x}'), 0)''')} AS \"{x}\"" for x in XYZ_CLASSES
    )
    abc_names = values([(c,) for c in ABC_CLASSES], "spine", "abc_class")
    zeros = ", ".join(f'coalesce("{x}", 0) AS "{x}"' for x in XYZ_CLASSES)
    clipped = "least(greatest(cv, 0.0::DOUBLE), 2.5::DOUBLE)"
    return {
        "sku_distribution": f"""WITH {graded}
SELECT round(median(mean), 6) AS median_weekly_demand, round(avg(cv), 6) AS mean_cv FROM graded""",
        "xyz_sheet": f"""SELECT xyz_class, cv_threshold, approach, coalesce(sku_count, 0) AS sku_count, cv_mean, cv_median,
       coalesce(pct_skus, 0) AS pct_skus
FROM {XYZ_SPINE} LEFT JOIN ({_xyz_summary(script)}) AS s USING (xyz_class)""",
        "matrix_counts": f"""WITH {graded}
SELECT abc_class, {zeros} FROM {abc_names} LEFT JOIN ({counts}) AS c ON abc_class = abc""",
        "matrix_revenue": f"""WITH {graded}
SELECT abc_class, {zeros} FROM {abc_names} LEFT JOIN (SELECT abc, {revenue_cells} FROM graded GROUP BY abc) AS c ON abc_class = abc""",
        "rop_profile": f"""WITH {rop}
SELECT count(*) AS skus, round(avg(buffer) FILTER (abc = 'A'), 6) AS avg_safety_stock_a,
       count(*) FILTER (risk) AS stockout_risk_skus FROM rop""",
        "cz_protected_revenue": f"WITH {cz} {_actions()}",
        "cz_scatter": f"""WITH {cz}
SELECT stock_code, customers AS n_customers, {money('rev')} AS total_revenue, loyal AS loyal_customer_flag FROM cz""",
        "cz_axis_caps": f"""WITH {cz}
SELECT 'n_customers' AS measure, round(quantile_cont(customers::DOUBLE, 0.98), 6) AS p98,
       round(quantile_cont(customers::DOUBLE, 0.98) + 2, 6) AS axis_limit FROM cz
UNION ALL SELECT 'total_revenue', round(quantile_cont({money('rev')}, 0.98), 6),
       round(quantile_cont({money('rev')}, 0.98) * 1.1, 6) FROM cz""",
        "summary_stats": _summary_stats(script),
        "kpi_strip": _kpi_strip(script),
        "pareto_points": f"""WITH {graded}
SELECT stock_code, round(rnk::DOUBLE / n::DOUBLE * 100, 9) AS sku_rank_pct, round(cum_pct * 100, 9) AS revenue_pct FROM graded""",
        "pareto_cutoffs": f"""WITH {graded}
SELECT round(count(*) FILTER (cum_pct <= 0.80) / count(*)::DOUBLE * 100, 9) AS a_cutoff,
       round(count(*) FILTER (cum_pct <= 0.95) / count(*)::DOUBLE * 100, 9) AS b_cutoff FROM graded""",
        "cv_histogram": _histogram(script),
        "heatmap_cells": f"""WITH {graded}
SELECT abc_xyz[1] AS abc_class, abc_xyz[2] AS xyz_class, zone, count(g.stock_code) AS sku_count,
       round(coalesce(sum(g.rev), 0)::DOUBLE / 100 / 1000, 9) AS revenue_thousands
FROM {CELL_SPINE} LEFT JOIN graded AS g ON abc_xyz = cell GROUP BY abc_xyz, zone""",
        "quadrant_sample": f"""WITH {graded}
SELECT stock_code, cell AS abc_xyz, {f'round({clipped}, 9)' if script else clipped} AS cv,
       round(log10({money('rev')} + 1), 9) AS log_revenue
FROM graded WHERE cv IS NOT NULL AND rev > 0 ORDER BY md5('42:' || stock_code), stock_code LIMIT 1500""",
    }


def oracle_sql() -> dict[str, str]:
    counts = matrix_counts_select("graded")
    abc_names = values([(c,) for c in ABC_CLASSES], "spine", "abc_class")
    zeros = ", ".join(f'coalesce("{x}", 0) AS "{x}"' for x in XYZ_CLASSES)
    names = ["invoice_no", "stock_code", "quantity", "invoice_date", "unit_price"]
    abc_complete = _abc_summary(False)
    export = _reorder_points(False).replace("AS abc_class", 'AS "ABC"').replace("AS xyz_class", 'AS "XYZ"')
    for old, new in (("AS abc_xyz", '"ABC_XYZ"'), ("AS annual_revenue", '"Annual Revenue (£)"'),
                     ("AS avg_unit_price", '"Avg Unit Price (£)"'), ("AS total_qty_sold", '"Annual Units Sold"')):
        export = export.replace(old, f"AS {new}")
    export = export.replace("SELECT stock_code, description, abc AS", 'SELECT stock_code AS "StockCode", description AS "Description", abc AS')
    return {
        "clean_transactions": f"""WITH {CLEAN}
SELECT invoice_no, stock_code, description, quantity, CAST(invoice_date AS VARCHAR) AS invoice_date,
       {money('cents')} AS unit_price, customer_id, country, {money('line_cents')} AS revenue FROM clean""",
        "clean_lines_script": f"""WITH {CLEAN}
SELECT invoice_no, stock_code, description, quantity, CAST(invoice_date AS VARCHAR) AS invoice_date,
       {money('cents')} AS unit_price, customer_id, country, {money('line_cents')} AS revenue FROM clean""",
        "clean_profile": f"""WITH {TX}
SELECT count(*) AS raw_lines, count(*) FILTER (starts_with(invoice_no, 'C')) AS cancelled_lines,
       count(*) FILTER (quantity <= 0) AS nonpositive_quantity_lines,
       count(*) FILTER (cents <= 0) AS nonpositive_price_lines,
       count(*) FILTER (NOT regexp_full_match(stock_code, '[0-9A-Z]{{5,}}')) AS malformed_code_lines,
       count(*) FILTER (NOT starts_with(invoice_no, 'C') AND quantity > 0 AND cents > 0
                        AND regexp_full_match(stock_code, '[0-9A-Z]{{5,}}')) AS clean_lines
FROM tx""",
        "dataset_profile": f"""WITH {CLEAN}
SELECT count(*) AS clean_lines, CAST(CAST(min(invoice_date) AS DATE) AS VARCHAR) AS first_date,
       CAST(CAST(max(invoice_date) AS DATE) AS VARCHAR) AS last_date, count(DISTINCT stock_code) AS n_skus,
       count(DISTINCT customer_id) AS n_customers, {money('sum(line_cents)')} AS total_revenue FROM clean""",
        "dq_not_null": f"WITH {TX} " + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({'cents' if c == 'unit_price' else c} IS NULL) AS violations FROM tx"
            for c in names),
        "dq_unique": f"""WITH {rop_cte()}
SELECT 'sku_master' AS table_name, count(*) AS n_keys, count(*) FILTER (k > 1) AS duplicate_keys
FROM (SELECT count(*) AS k FROM graded GROUP BY stock_code)
UNION ALL SELECT 'reorder_points', count(*), count(*) FILTER (k > 1) FROM (SELECT count(*) AS k FROM rop GROUP BY stock_code)
UNION ALL SELECT 'weekly_demand', count(*), count(*) FILTER (k > 1)
FROM (SELECT count(*) AS k FROM weekly GROUP BY stock_code, strftime(week_start, '%G-%V'))""",
        "dq_duplicate_lines": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
        "sku_revenue": f"""WITH {CLEAN},{sales_cte(False)}
SELECT stock_code, description, units AS total_qty_sold, {money('rev')} AS total_revenue, invoices AS n_invoices,
       customers AS n_customers, price AS avg_unit_price, CAST(first_sale AS VARCHAR) AS first_sale_date,
       CAST(last_sale AS VARCHAR) AS last_sale_date FROM sales""",
        "sku_description_mode": f"""WITH {CLEAN}
SELECT stock_code, coalesce(mode(description ORDER BY description), '') AS description FROM clean GROUP BY stock_code""",
        "sku_weekly_demand": f"""WITH {WEEKLY}
SELECT stock_code, CAST(week_start AS VARCHAR) AS week_start, strftime(week_start, '%G-%V') AS year_week,
       qty AS qty_sold FROM weekly""",
        "sku_demand_stats": f"""WITH {stats_cte(False)}
SELECT stock_code, mean AS weekly_demand_mean, std AS weekly_demand_std, weeks AS weeks_with_demand, cv FROM stats""",
        "sku_abc": f"""WITH {graded_cte()}
SELECT stock_code, description, units AS total_qty_sold, {money('rev')} AS total_revenue, invoices AS n_invoices,
       customers AS n_customers, price AS avg_unit_price, CAST(first_sale AS VARCHAR) AS first_sale_date,
       CAST(last_sale AS VARCHAR) AS last_sale_date, {money('cum')} AS revenue_cumsum, cum_pct AS revenue_cum_pct,
       abc AS abc_class FROM graded""",
        "abc_summary": _abc_summary(False),
        "abc_sheet": f"""SELECT abc_class, implication, coalesce(sku_count, 0) AS sku_count, coalesce(pct_skus, 0) AS pct_skus,
       coalesce(total_revenue, 0) AS total_revenue, coalesce(pct_revenue, 0) AS pct_revenue, avg_price
FROM {ABC_SPINE} LEFT JOIN ({abc_complete}) AS s USING (abc_class)""",
        "sku_xyz": f"""WITH {graded_cte()}
SELECT stock_code, abc AS abc_class, mean AS weekly_demand_mean, std AS weekly_demand_std,
       weeks AS weeks_with_demand, cv, xyz AS xyz_class FROM graded""",
        "xyz_summary": _xyz_summary(False),
        "sku_abc_xyz": f"""WITH {graded_cte()}
SELECT stock_code, {money('rev')} AS total_revenue, rnk AS revenue_rank, abc AS abc_class, xyz AS xyz_class,
       cell AS abc_xyz, strategic_action FROM graded""",
        "matrix_long": _matrix_long(False),
        "matrix_margins": f"""WITH {graded_cte()}
SELECT abc_class, {zeros}, coalesce("X" + "Y" + "Z", 0) AS row_total, coalesce(revenue, 0) AS revenue,
       coalesce(pct_revenue, 0) AS pct_revenue
FROM {abc_names} LEFT JOIN ({counts}) AS c ON abc_class = abc
LEFT JOIN (SELECT abc AS rabc, {money('sum(rev)')} AS revenue,
                  {ratio('sum(rev) * 100', '(sum(sum(rev)) OVER ())', 1)} AS pct_revenue FROM graded GROUP BY abc) AS r
       ON abc_class = rabc""",
        "cell_policy": f"""WITH {graded_cte()}
SELECT abc_xyz, zone, service_level, review_cycle, instruction, coalesce(sku_count, 0) AS sku_count,
       coalesce(revenue, 0) AS revenue
FROM {CELL_SPINE} LEFT JOIN (SELECT cell, count(*) AS sku_count, {money('sum(rev)')} AS revenue
                             FROM graded GROUP BY cell) AS c ON abc_xyz = cell""",
        "high_value_volatile": f"""WITH {graded_cte()}
SELECT count(*) AS sku_count, {money('coalesce(sum(rev), 0)')} AS revenue FROM graded WHERE cell IN ('AZ', 'BZ')""",
        "class_revenue_floor": f"""WITH {graded_cte()}
SELECT abc AS abc_class, {money('min(rev)')} AS min_revenue, round(log10({money('min(rev)')}), 9) AS log_min_revenue
FROM graded WHERE abc IN ('A', 'B') GROUP BY abc""",
        "sku_master": _master(False),
        "refreshed_master": _master(False),
        "refreshed_demand_stats": f"""WITH {stats_cte(False)}
SELECT stock_code, mean AS weekly_demand_mean, std AS weekly_demand_std, weeks AS weeks_with_demand, cv FROM stats""",
        "master_export": f"""SELECT stock_code AS "StockCode", description, abc_class AS "ABC", xyz_class AS "XYZ",
       abc_xyz AS "ABC_XYZ", total_revenue, total_qty_sold, n_invoices, n_customers, avg_unit_price, weekly_demand_mean,
       weekly_demand_std, cv, weeks_with_demand, weeks_active_pct, first_sale_date, last_sale_date, revenue_cum_pct
FROM ({_master(False)}) AS m""",
        "matrix_export": f"""SELECT abc_class AS "ABC", xyz_class AS "XYZ", sku_count, revenue AS total_revenue, avg_cv,
       pct_revenue, pct_skus FROM ({_matrix_long(False)}) AS m""",
        "reorder_points": _reorder_points(False),
        "rop_export": export,
        "rop_sheet": _reorder_points(False)
        .replace("stock_code, description,", "stock_code, substr(description, 1, 40) AS description,", 1)
        .replace("risk AS stockout_risk_flag", "CASE WHEN risk THEN '⚠ YES' ELSE 'OK' END AS stockout_risk_flag")
        .replace("mean AS weekly_demand_mean,", "").replace("\n       std AS weekly_demand_std,", "\n      "),
        "rop_summary": f"""WITH {rop_cte()}
SELECT abc AS abc_class, count(*) AS skus, {ratio('sum(round(mean * 100)::BIGINT)', 'count(*) * 100', 0)} AS avg_weekly_demand,
       {ratio('sum(buffer::BIGINT)', 'count(*)', 0)} AS avg_safety_stock, {ratio('sum(point::BIGINT)', 'count(*)', 0)} AS avg_rop,
       count(*) FILTER (risk) AS stockout_risk_skus
FROM rop GROUP BY abc""",
        "rop_top20": f"""WITH {rop_cte()}
SELECT stock_code, description, cell AS abc_xyz, mean AS avg_weekly_demand,
       buffer AS safety_stock, point AS reorder_point, risk AS stockout_risk_flag, {money('rev')} AS annual_revenue, cv
FROM rop ORDER BY point DESC, stock_code LIMIT 20""",
        "rop_top5": f"""WITH {rop_cte()}
SELECT stock_code, substr(description, 1, 40) AS description, cell AS abc_xyz, mean AS avg_weekly_demand,
       buffer AS safety_stock, point AS reorder_point, risk AS stockout_risk_flag, {money('rev')} AS annual_revenue, cv
FROM rop ORDER BY point DESC, stock_code LIMIT 5""",
        "rop_chart": f"""WITH {rop_cte()}
SELECT stock_code || ': ' || substr(description, 1, 30) AS label, abc AS abc_class, point AS reorder_point,
       buffer AS safety_stock, cv, risk AS stockout_risk_flag, {money('rev')} / 500 AS bubble_size
FROM rop ORDER BY rev DESC, stock_code LIMIT 20""",
        "cz_rationalisation": _cz_list(False),
        "cz_export": f"""SELECT stock_code AS "StockCode", description, abc_xyz AS "ABC_XYZ", total_revenue, n_customers,
       n_invoices, weekly_demand_mean, cv, loyal_customer_flag, recommended_action AS action
FROM ({_cz_list(False)}) AS c""",
        "cz_summary": _cz_summary(False),
        "cz_action_sheet": f"""SELECT substr(recommended_action, 1, 55) AS recommended_action, sku_count, total_revenue,
       avg_revenue_per_sku, avg_cv, avg_customers,
       CASE WHEN contains(upper(recommended_action), 'PROTECT') THEN 'PROTECT'
            WHEN contains(upper(recommended_action), 'RATIONALISE') THEN 'RATIONALISE' ELSE 'SINGLE' END AS action_key
FROM ({_cz_summary(False)}) AS s""",
        "cz_candidates": f"""WITH {cz_cte()}
SELECT stock_code, substr(description, 1, 40) AS description, {money('rev')} AS total_revenue, invoices AS n_invoices,
       customers AS n_customers, mean AS weekly_demand_mean, cv, substr(recommended_action, 1, 40) AS action
FROM cz WHERE starts_with(recommended_action, 'RATIONALISE')""",
        "abc_top30": f"""WITH {graded_cte()}
SELECT row_number() OVER (ORDER BY rev DESC, stock_code) AS rank, stock_code, substr(description, 1, 50) AS description,
       {money('rev')} AS total_revenue, units AS total_qty_sold, price AS avg_unit_price, xyz AS xyz_class, cell AS abc_xyz
FROM graded WHERE abc = 'A' ORDER BY rev DESC, stock_code LIMIT 30""",
        "ext_recent_spike": f"""WITH {WEEKLY}
SELECT stock_code, recent AS recent_qty, total AS total_qty, weeks AS weeks_with_demand,
       recent * weeks > 2 * 4 * total AS spike_flag
FROM (
  SELECT stock_code, CAST(sum(qty) AS BIGINT) AS total, count(*) AS weeks,
         CAST(coalesce(sum(qty) FILTER (date_diff('day', week_start, (SELECT max(week_start) FROM weekly)) < 28), 0) AS BIGINT) AS recent
  FROM weekly GROUP BY stock_code
)""",
        "ext_lead_time_safety_stock": f"""WITH {rop_cte()}, spread AS (
  SELECT *, CASE abc WHEN 'A' THEN 0.5::DOUBLE WHEN 'B' THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS sl FROM rop
)
SELECT stock_code, abc AS abc_class, xyz AS xyz_class, sl AS lead_time_std,
       round(z * sqrt(lt * std * std + mean * mean * sl * sl), 6) AS safety_stock,
       round(mean * lt + z * sqrt(lt * std * std + mean * mean * sl * sl), 6) AS reorder_point FROM spread""",
        "ext_percentile_safety_stock": f"""WITH {graded_cte()}
SELECT stock_code, abc AS abc_class, round(p, 6) AS weekly_percentile, round(greatest((p - m) * sqrt(lt), 0), 6) AS safety_stock
FROM (
  SELECT g.stock_code, abc, avg(qty) AS m, CASE abc WHEN 'A' THEN 2.0::DOUBLE WHEN 'B' THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END AS lt,
         CASE abc WHEN 'A' THEN quantile_cont(qty::DOUBLE, 0.98) WHEN 'B' THEN quantile_cont(qty::DOUBLE, 0.95)
                  ELSE quantile_cont(qty::DOUBLE, 0.90) END AS p
  FROM graded AS g JOIN weekly AS w ON g.stock_code = w.stock_code
  WHERE weeks >= 3 AND cv IS NOT NULL AND xyz = 'Z' GROUP BY g.stock_code, abc
)""",
        "ext_stock_gap": f"""WITH {rop_cte()}, moves AS (
  SELECT stock_code, CAST(invoice_date AS DATE) AS day, sum(CASE WHEN quantity < 0 THEN -quantity ELSE 0 END) AS back,
         sum(CASE WHEN quantity > 0 THEN quantity ELSE 0 END) AS out
  FROM tx WHERE stock_code IN (SELECT stock_code FROM rop) GROUP BY ALL
), balance AS (
  SELECT stock_code, day, sum(back) OVER w AS back, sum(out) OVER w AS out FROM moves WINDOW w AS (PARTITION BY stock_code ORDER BY day)
), reviews AS (
  SELECT stock_code, last_day(unnest(generate_series(date_trunc('month', min(day)), date_trunc('month', max(day)), INTERVAL 1 MONTH))) AS review
  FROM moves GROUP BY stock_code
), found AS (
  SELECT rop.*, review, CAST(ceil(mean * 4) AS BIGINT) AS opening, CAST(coalesce(back, 0) AS BIGINT) AS back, CAST(coalesce(out, 0) AS BIGINT) AS out
  FROM reviews ASOF LEFT JOIN balance ON reviews.stock_code = balance.stock_code AND review >= day JOIN rop ON reviews.stock_code = rop.stock_code
)
SELECT stock_code, abc AS abc_class, cell AS abc_xyz, CAST(review AS VARCHAR) AS review_day, opening AS opening_stock, back AS received_to_date,
       out AS issued_to_date, opening + back - out AS stock_on_hand, CAST(point AS BIGINT) AS reorder_point,
       CAST(opening + back - out - point AS BIGINT) AS stock_gap, opening + back - out < point AS below_reorder_point
FROM found""",
        "ext_measured_lead_time": f"""WITH {rop_cte()}, days AS (
  SELECT clean.stock_code, date_diff('day', CAST(o_orderdate AS DATE), CAST(invoice_date AS DATE)) AS d
  FROM clean JOIN orders ON CAST(o_orderkey AS VARCHAR) = invoice_no WHERE clean.stock_code IN (SELECT stock_code FROM rop)
), own AS (SELECT stock_code, count(*) AS events, avg(d) AS m, var_samp(d) AS v FROM days WHERE d >= 0 GROUP BY ALL),
of_class AS (
  SELECT abc, count(*) AS cn, avg(d) AS cm, var_samp(d) AS cv2 FROM days JOIN rop USING (stock_code) WHERE d >= 0 GROUP BY ALL
), filled AS (
  SELECT rop.stock_code, rop.abc, mean, std, z, coalesce(events, 0) AS n, CASE WHEN cn > 1 THEN cm ELSE lt * 7 END AS m0, m,
         CASE WHEN cn > 1 THEN cv2 ELSE pow(CASE rop.abc WHEN 'A' THEN 3.5 WHEN 'B' THEN 5.25 ELSE 7.0 END, 2) END AS v0, v
  FROM rop LEFT JOIN own USING (stock_code) LEFT JOIN of_class ON rop.abc = of_class.abc
), shrunk AS (
  SELECT *, (n * coalesce(m, m0) + 10 * m0) / (n + 10) / 7 AS lm, (n * coalesce(v, v0) + 10 * v0) / (n + 10) / 49 AS lv FROM filled
)
SELECT stock_code, abc AS abc_class, n AS n_lead_times, round(lm, 6) AS lead_time_weeks, round(sqrt(lv), 6) AS lead_time_std_weeks,
       round(z * sqrt(lm * std * std + mean * mean * lv), 6) AS safety_stock,
       round(mean * lm + z * sqrt(lm * std * std + mean * mean * lv), 6) AS reorder_point FROM shrunk""",
        "ext_lead_time_percentile": f"""WITH {graded_cte()}, erratic AS (
  SELECT stock_code, abc, CASE abc WHEN 'A' THEN 2 WHEN 'B' THEN 3 ELSE 4 END AS lead, CASE abc WHEN 'A' THEN 0.98 WHEN 'B' THEN 0.95 ELSE 0.90 END AS level
  FROM graded WHERE weeks >= 3 AND cv IS NOT NULL AND xyz = 'Z'
), calendar AS (
  SELECT stock_code, abc, lead, level, unnest(generate_series(first_week, last_week, INTERVAL 7 DAY))::DATE AS week_start
  FROM erratic JOIN (SELECT stock_code, min(week_start) AS first_week, max(week_start) AS last_week FROM weekly GROUP BY ALL) USING (stock_code)
), series AS (
  SELECT calendar.*, coalesce(qty, 0) AS qty, count(*) OVER (PARTITION BY calendar.stock_code) AS n,
         row_number() OVER (PARTITION BY calendar.stock_code ORDER BY calendar.week_start) AS place
  FROM calendar LEFT JOIN weekly ON calendar.stock_code = weekly.stock_code AND calendar.week_start = weekly.week_start
), sums AS (
  SELECT a.stock_code, a.abc, a.lead, a.level, a.n, a.place, sum(b.qty)::DOUBLE AS demand
  FROM series AS a JOIN series AS b ON a.stock_code = b.stock_code AND b.place BETWEEN a.place AND a.place + a.lead - 1
  WHERE a.place <= greatest(1, a.n - a.lead + 1) GROUP BY ALL
), points AS (
  SELECT stock_code, abc, lead, n, CASE abc WHEN 'A' THEN quantile_cont(demand, 0.98) WHEN 'B' THEN quantile_cont(demand, 0.95) ELSE quantile_cont(demand, 0.90) END AS point
  FROM sums GROUP BY stock_code, abc, lead, n
)
SELECT p.stock_code, abc AS abc_class, CAST(n AS INTEGER) AS series_weeks, round(point, 6) AS reorder_point,
       round(greatest(point - total * least(lead, n) / n, 0), 6) AS safety_stock
FROM points AS p JOIN (SELECT stock_code, sum(qty)::DOUBLE AS total FROM weekly GROUP BY ALL) AS t ON p.stock_code = t.stock_code""",
        "sku_master_script": _master(True),
        "abc_summary_script": _abc_summary(True),
        "xyz_summary_script": _xyz_summary(True),
        "matrix_long_script": _matrix_long(True),
        "reorder_points_script": _reorder_points(True),
        "cz_rationalisation_script": _cz_list(True),
        "cz_summary_script": _cz_summary(True),
    } | _both(False) | {f"{name}_script": sql for name, sql in _both(True).items()}
