"""The spreadsheet operators over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.functions import criteria as crit
from gridspark.functions import number_format as nf
from gridspark.functions.references import letters_column
from gridspark.functions.values import number, text
from gridspark.operators import aggregates as agg
from gridspark.operators import charts, grid, hierarchy, lookup, outline, pivot_filters, range_criteria, recalculate, rectangles, sheet
from gridspark.operators import conditional_format as cf
from gridspark.operators.numbering import numbered
from gridspark.plans.formula import aggregate_formulas, with_formulas
from gridspark.plans.rule_expression import Cell, rule_expression
from gridspark.streaming import selections

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The order of line items, and what is read of them to number them.
_LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
_LINES = (*_LINE_ORDER, "l_returnflag")


def _rounded(df: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@_query("""SELECT l_returnflag, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high
FROM lineitem GROUP BY l_returnflag""")
def sum_avg_min_max(spark, sf_dir):
    out = aggregate_formulas(_t(spark, sf_dir, "lineitem"), {"total": "=SUM([l_quantity])", "mean": "=AVERAGE([l_quantity])", "low": "=MIN([l_extendedprice])", "high": "=MAX([l_extendedprice])"}, ["l_returnflag"], errors=False)
    return _rounded(_rounded(out, "total"), "mean", digits=6)


@_query("""SELECT event_type, count(value) AS n_numbers, count(CASE WHEN props <> '' THEN 1 END) AS n_filled FROM events GROUP BY event_type""")
def count_counta(spark, sf_dir):
    return aggregate_formulas(_t(spark, sf_dir, "events"), {"n_numbers": "=COUNT([value])", "n_filled": "=COUNTA([props])"}, ["event_type"], errors=False)


@_query("""SELECT l_linestatus, round(sum(CASE WHEN lower(l_returnflag) = 'r' THEN l_extendedprice ELSE 0 END), 2) AS returned,
round(sum(CASE WHEN l_quantity >= 25 THEN l_quantity ELSE 0 END), 2) AS large, round(sum(CASE WHEN lower(l_returnflag) <> 'r' THEN l_extendedprice ELSE 0 END), 2) AS others
FROM lineitem GROUP BY l_linestatus""")
def sumif(spark, sf_dir):
    out = aggregate_formulas(_t(spark, sf_dir, "lineitem"), {"returned": '=SUMIF([l_returnflag],"r",[l_extendedprice])', "large": '=SUMIF([l_quantity],">=25")', "others": '=SUMIF([l_returnflag],"<>R",[l_extendedprice])'}, ["l_linestatus"], errors=False)
    return _rounded(out, "returned", "large", "others")


@_query("""SELECT count(CASE WHEN l_quantity >= 25 THEN 1 END) AS large, count(CASE WHEN lower(l_returnflag) <> 'a' THEN 1 END) AS not_a,
count(CASE WHEN l_linenumber = 1 THEN 1 END) AS first_lines, count(*) AS odd FROM lineitem""")
def countif(spark, sf_dir):
    return aggregate_formulas(_t(spark, sf_dir, "lineitem"), {"large": '=COUNTIF([l_quantity],">=25")', "not_a": '=COUNTIF([l_returnflag],"<>A")', "first_lines": "=COUNTIF([l_linenumber],1)", "odd": '=COUNTIF([l_quantity],"<>foo")'}, errors=False)


@_query("""WITH numbered AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS r FROM lineitem)
SELECT count(*) FILTER (WHERE r BETWEEN 11 AND 400 AND l_quantity <> 5) AS unlike, count(*) FILTER (WHERE r BETWEEN 11 AND 400 AND l_returnflag = '') AS blank,
round(coalesce(sum(l_extendedprice) FILTER (WHERE r BETWEEN 11 AND 400 AND l_quantity <> 5), 0), 2) AS paired,
round(coalesce(sum(l_extendedprice) FILTER (WHERE r BETWEEN 11 AND 200 AND lower(l_returnflag) <> 'r'), 0), 2) AS shorter FROM numbered""")
def countif_row_ranges(spark, sf_dir):
    """Criteria that nulls meet, on ranges of rows: what is outside is no blank cell."""
    li = numbered(_t(spark, sf_dir, "lineitem").select(*_LINES), *_LINE_ORDER, into="r").select("l_quantity", "l_returnflag", "l_extendedprice", "r")
    formulas = {"unlike": '=COUNTIF(A11:A400,"<>5")', "blank": '=COUNTIF(B11:B400,"")', "paired": '=SUMIF(A11:A400,"<>5",C11:C400)', "shorter": '=SUMIF(B11:B400,"<>r",C11:C200)'}
    return _rounded(aggregate_formulas(li, formulas, row="r", errors=False), "paired", "shorter")


@_query("""SELECT l_returnflag, bool_and(l_tax > 0) AS all_taxed, bool_or(l_discount > 0.09) AS any_high FROM lineitem GROUP BY l_returnflag""")
def and_or_agg(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumns({"taxed": F.col("l_tax") > 0, "high": F.col("l_discount") > 0.09})
    from gridspark.functions.values import boolean

    return li.groupBy("l_returnflag").agg(agg.every(boolean(F.col("taxed"))).plain().alias("all_taxed"), agg.some(boolean(F.col("high"))).column.alias("any_high"))


@_query("""SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey""")
def concat_range(spark, sf_dir):
    return _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(agg.joined(text(F.col("n_name")), F.col("n_nationkey")).column.alias("names"))


@_query("""WITH firsts AS (SELECT c_custkey, c_name, row_number() OVER (PARTITION BY c_custkey ORDER BY c_custkey, c_name) AS rn FROM customer)
SELECT o_orderkey, c_name AS found, CASE WHEN c_custkey IS NULL THEN '#N/A' END AS found_error FROM orders LEFT JOIN firsts ON o_custkey = c_custkey AND rn = 1""")
def vlookup_first(spark, sf_dir):
    table = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return lookup.vlookup(_t(spark, sf_dir, "orders"), "o_custkey", table, 2).select("o_orderkey", "found", "found_error")


@_query("""WITH firsts AS (SELECT lower(p_brand) AS k, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1),
wanted AS (SELECT n_nationkey, 'BRAND#' || CAST(n_nationkey AS VARCHAR) AS brand FROM nation)
SELECT n_nationkey, p_name AS found, CASE WHEN k IS NULL THEN '#N/A' END AS found_error FROM wanted LEFT JOIN firsts ON lower(brand) = k""")
def vlookup_text(spark, sf_dir):
    wanted = _t(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("BRAND#"), F.col("n_nationkey").cast("string")).alias("brand"))
    table = _t(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey")
    return lookup.vlookup(wanted, "brand", table, 2, order=["p_partkey"]).select("n_nationkey", "found", "found_error")


@_query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS size_class,
CASE WHEN o_totalprice > 300000 THEN 3.0::DOUBLE WHEN o_totalprice > 100000 THEN 2.0::DOUBLE WHEN true THEN 1.0::DOUBLE END AS tier,
CASE lower(o_orderstatus) WHEN 'o' THEN 'open' WHEN 'f' THEN 'filled' ELSE 'other' END AS status FROM orders""")
def if_ifs_switch(spark, sf_dir):
    out = with_formulas(_t(spark, sf_dir, "orders"), {"size_class": '=IF([o_totalprice]>200000,"high","low")', "tier": "=IFS([o_totalprice]>300000,3,[o_totalprice]>100000,2,TRUE,1)", "status": '=SWITCH([o_orderstatus],"o","open","F","filled","other")'})
    return out.select("o_orderkey", "size_class", "tier", "status")


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN -1 ELSE l_tax / l_discount END AS ratio, CASE WHEN l_discount = 0 THEN '#DIV/0!' END AS raw_error FROM lineitem""")
def iferror_div(spark, sf_dir):
    out = with_formulas(_t(spark, sf_dir, "lineitem"), {"ratio": "=IFERROR([l_tax]/[l_discount],-1)", "raw": "=[l_tax]/[l_discount]"})
    return out.select("l_orderkey", "l_linenumber", "ratio", "raw_error")


@_query("""SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 10 + 0.5) / 10 AS r1, floor(l_extendedprice * 0.01 + 0.5) / 0.01 AS r2, ceil(l_extendedprice * 10) / 10 AS up, floor(l_extendedprice * 10) / 10 AS down FROM lineitem""")
def round_family(spark, sf_dir):
    out = with_formulas(_t(spark, sf_dir, "lineitem"), {"r1": "=ROUND([l_extendedprice],1)", "r2": "=ROUND([l_extendedprice],-2)", "up": "=ROUNDUP([l_extendedprice],1)", "down": "=ROUNDDOWN([l_extendedprice],1)"})
    return out.select("l_orderkey", "l_linenumber", "r1", "r2", "up", "down")


@_query("""SELECT c_custkey, c_acctbal - floor(c_acctbal / 7) * 7 AS m, floor(c_acctbal) AS i, abs(c_acctbal) AS a, CASE WHEN c_acctbal < 0 THEN NULL ELSE round(sqrt(c_acctbal), 9) END AS s,
CASE WHEN c_acctbal < 0 THEN '#NUM!' END AS s_error, round(power(c_acctbal / 1000, 2), 6) AS p FROM customer""")
def mod_int_abs_sqrt_power(spark, sf_dir):
    out = with_formulas(_t(spark, sf_dir, "customer"), {"m": "=MOD([c_acctbal],7)", "i": "=INT([c_acctbal])", "a": "=ABS([c_acctbal])", "s": "=SQRT([c_acctbal])", "p": "=POWER([c_acctbal]/1000,2)"})
    return _rounded(_rounded(out.select("c_custkey", "m", "i", "a", "s", "s_error", "p"), "s", digits=9), "p", digits=6)


@_query("""SELECT p_partkey, left(p_name, 4) AS l, right(p_name, 3) AS r, substr(p_name, 2, 5) AS m, CAST(length(p_name) AS DOUBLE) AS n, trim(regexp_replace(p_name || '  x ', ' +', ' ', 'g'), ' ') AS t, upper(p_type) AS u, lower(p_brand) AS w,
p_brand || '-' || CAST(p_size AS VARCHAR) AS c FROM part""")
def text_family(spark, sf_dir):
    out = with_formulas(_t(spark, sf_dir, "part"), {"l": "=LEFT([p_name],4)", "r": "=RIGHT([p_name],3)", "m": "=MID([p_name],2,5)", "n": "=LEN([p_name])", "t": '=TRIM([p_name]&"  x ")', "u": "=UPPER([p_type])", "w": "=LOWER([p_brand])", "c": '=[p_brand]&"-"&[p_size]'})
    return out.select("p_partkey", "l", "r", "m", "n", "t", "u", "w", "c")


@_query("""SELECT o_orderkey, lower(o_orderstatus) = 'f' AS same, false AS cross_type, o_totalprice >= 150000 AS ge, lower(o_orderpriority) < '3-' AS lt FROM orders""")
def compare_mixed(spark, sf_dir):
    out = with_formulas(_t(spark, sf_dir, "orders"), {"same": '=[o_orderstatus]="f"', "cross_type": '=[o_totalprice]="150000"', "ge": "=[o_totalprice]>=150000", "lt": '=[o_orderpriority]<"3-"'})
    return out.select("o_orderkey", "same", "cross_type", "ge", "lt")


@_query("""SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 10 AND 20 AS inside, NOT (l_quantity BETWEEN 10 AND 20) AS outside, lower(l_returnflag) = 'n' AS is_n FROM lineitem""")
def cf_cellis_between(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cf.cell_is(F.col("l_quantity"), "between", 10, 20).alias("inside"), cf.cell_is(F.col("l_quantity"), "notBetween", 10, 20).alias("outside"), cf.cell_is(F.col("l_returnflag"), "equal", "n").alias("is_n"))


@_query("""SELECT p_partkey, contains(lower(p_type), 'steel') AS has, NOT contains(lower(p_type), 'steel') AS has_not, starts_with(lower(p_type), 'st') AS starts, ends_with(lower(p_brand), '3') AS ends_3 FROM part""")
def cf_text_rules(spark, sf_dir):
    c = F.col("p_type")
    return _t(spark, sf_dir, "part").select("p_partkey", cf.text_rule(c, "contains", "STEEL").alias("has"), cf.text_rule(c, "notContains", "steel").alias("has_not"), cf.text_rule(c, "beginsWith", "St").alias("starts"), cf.text_rule(F.col("p_brand"), "endsWith", "3").alias("ends_3"))


@_query("""SELECT p_partkey, count(*) OVER (PARTITION BY p_name) > 1 AS duplicate, count(*) OVER (PARTITION BY p_retailprice) = 1 AS single FROM part""")
def cf_duplicate_unique(spark, sf_dir):
    once = cf.repeated(_t(spark, sf_dir, "part"), "p_name", into="duplicate")
    return cf.repeated(once, "p_retailprice", unique=True, into="single").select("p_partkey", "duplicate", "single")


@_query("""SELECT o_orderkey, o_totalprice >= (SELECT min(o_totalprice) FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 10)) AS top_10,
o_totalprice <= (SELECT max(o_totalprice) FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice LIMIT 25)) AS bottom_25 FROM orders""")
def cf_top_n(spark, sf_dir):
    one = cf.top(_t(spark, sf_dir, "orders"), "o_totalprice", 10, into="top_10")
    return cf.top(one, "o_totalprice", 25, bottom=True, into="bottom_25").select("o_orderkey", "top_10", "bottom_25")


@_query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC) AS r, ceil(count(*) OVER () * 10 / 100.0) AS k FROM orders),
g AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS gr, greatest(1, ceil(count(*) OVER (PARTITION BY o_orderpriority) * 10 / 100.0)) AS gk FROM n),
lim AS (SELECT min(o_totalprice) AS t FROM n WHERE r <= k), glim AS (SELECT o_orderpriority, min(o_totalprice) AS t FROM g WHERE gr <= gk GROUP BY 1)
SELECT o_orderkey, o_totalprice >= (SELECT t FROM lim) AS top_all, o_totalprice >= glim.t AS top_group FROM g JOIN glim USING (o_orderpriority)""")
def cf_top_pct(spark, sf_dir):
    one = cf.top(_t(spark, sf_dir, "orders"), "o_totalprice", 10, percent=True, into="top_all")
    return cf.top(one, "o_totalprice", 10, percent=True, by=["o_orderpriority"], into="top_group").select("o_orderkey", "top_all", "top_group")


@_query("""SELECT c_custkey, c_acctbal > avg(c_acctbal) OVER () AS above, c_acctbal <= avg(c_acctbal) OVER w + stddev_pop(c_acctbal) OVER w AS below_1 FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""")
def cf_above_avg_stddev(spark, sf_dir):
    one = cf.average_rule(_t(spark, sf_dir, "customer"), "c_acctbal", into="above")
    return cf.average_rule(one, "c_acctbal", above=False, inclusive=True, deviations=1, by=["c_mktsegment"], into="below_1").select("c_custkey", "above", "below_1")


@_query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, DATE '1996-03-15' AS today FROM orders)
SELECT o_orderkey, day = today AS t0, day = today - 1 AS t1, day >= today - 6 AND day <= today AS last7, day >= DATE '1996-03-10' AND day < DATE '1996-03-17' AS this_week,
day >= DATE '1996-03-03' AND day < DATE '1996-03-10' AS last_week, day >= DATE '1996-03-01' AND day < DATE '1996-04-01' AS this_month, day >= DATE '1996-02-01' AND day < DATE '1996-03-01' AS last_month, day >= DATE '1996-04-01' AND day < DATE '1996-05-01' AS next_month FROM d""")
def cf_time_period(spark, sf_dir):
    day, today = F.col("o_orderdate").cast("date"), F.lit("1996-03-15").cast("date")
    periods = {"t0": "today", "t1": "yesterday", "last7": "last7Days", "this_week": "thisWeek", "last_week": "lastWeek", "this_month": "thisMonth", "last_month": "lastMonth", "next_month": "nextMonth"}
    return _t(spark, sf_dir, "orders").select("o_orderkey", *[cf.time_period(day, p, today).alias(n) for n, p in periods.items()])


@_query("""SELECT o_orderkey, o_orderkey % 2 = 0 AND o_totalprice > 100000 AS hit, left(o_orderpriority, 1) = '1' AS urgent FROM orders""")
def cf_expression(spark, sf_dir):
    df = _t(spark, sf_dir, "orders")
    out = with_formulas(df, {"hit": "=AND(MOD([o_orderkey],2)=0,[o_totalprice]>100000)", "urgent": '=LEFT([o_orderpriority],1)="1"'})
    return out.select("o_orderkey", "hit", "urgent")


@_query("""WITH s AS (SELECT min(c_acctbal) AS a, quantile_cont(c_acctbal, 0.5) AS b, max(c_acctbal) AS c FROM customer),
v AS (SELECT c_custkey, c_acctbal AS x, a, b, c, CASE WHEN c_acctbal <= b THEN (c_acctbal - a) / (b - a) ELSE (c_acctbal - b) / (c - b) END AS t FROM customer, s)
SELECT c_custkey, CASE WHEN x <= b THEN '#ff' || printf('%02x', CAST(floor(255 * t + 0.5) AS INT)) || '00' ELSE '#' || printf('%02x', CAST(floor(255 - 255 * t + 0.5) AS INT)) || 'ff00' END AS colour FROM v""")
def cf_color_scale(spark, sf_dir):
    stops = [(cf.Stop("min"), "#ff0000"), (cf.Stop("percentile", 50), "#ffff00"), (cf.Stop("max"), "#00ff00")]
    return cf.colour_scale(_t(spark, sf_dir, "customer"), "c_acctbal", stops).select("c_custkey", "colour")


@_query("""SELECT c_custkey, round(10 + 80 * (c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 6) AS percent FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""")
def cf_data_bar(spark, sf_dir):
    return _rounded(cf.data_bar(_t(spark, sf_dir, "customer"), "c_acctbal", by=["c_mktsegment"]).select("c_custkey", "percent"), "percent", digits=6)


@_query("""WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, quantile_cont(p_retailprice, 0.67) AS p FROM part)
SELECT p_partkey, CAST(CASE WHEN p_retailprice >= p THEN 2 WHEN p_retailprice >= lo + (hi - lo) * 0.33 THEN 1 ELSE 0 END AS INTEGER) AS icon FROM part, s""")
def cf_icon_set(spark, sf_dir):
    return cf.icon_set(_t(spark, sf_dir, "part"), "p_retailprice", [cf.Stop("percent", 0), cf.Stop("percent", 33), cf.Stop("percentile", 67)]).select("p_partkey", "icon")


@_query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'big' WHEN l_returnflag = 'R' THEN 'returned' WHEN l_quantity > 20 THEN 'middle' END AS rule,
CASE WHEN l_quantity > 45 THEN 'background:#f00' WHEN l_returnflag = 'R' THEN 'background:#ff0' WHEN l_quantity > 20 THEN 'color:#00f' END AS rule_style FROM lineitem""")
def cf_priority_winner(spark, sf_dir):
    q = F.col("l_quantity")
    rules = [cf.Rule("middle", 3, cf.cell_is(q, "greaterThan", 20), "color:#00f"), cf.Rule("returned", 2, cf.cell_is(F.col("l_returnflag"), "equal", "R"), "background:#ff0"), cf.Rule("unstyled", 0, cf.cell_is(q, "greaterThan", 0), None), cf.Rule("big", 1, cf.cell_is(q, "greaterThan", 45), "background:#f00")]
    return cf.winner(_t(spark, sf_dir, "lineitem"), rules).select("l_orderkey", "l_linenumber", "rule", "rule_style")


@_query("""SELECT c_custkey, c_mktsegment FROM customer WHERE trim(c_mktsegment) IN ('BUILDING', 'MACHINERY') OR trim(c_mktsegment) = '' OR c_mktsegment IS NULL""")
def slicer_filter(spark, sf_dir):
    return pivot_filters.slicer(_t(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


@_query("""SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31' OR o_orderdate IS NULL""")
def timeline_filter(spark, sf_dir):
    return pivot_filters.timeline(_t(spark, sf_dir, "orders"), "o_orderdate", "1995-12-31", "1995-01-01").select("o_orderkey")


@_query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN format('({:,.2f})', -c_acctbal) ELSE format('{:,.2f}', c_acctbal) END AS money,
CASE WHEN c_acctbal < 0 THEN '#ff0000' END AS money_colour, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:.1f}', abs(c_acctbal) / 10000 * 100) || '%' AS share FROM customer""")
def numfmt_thousands_pct_neg(spark, sf_dir):
    money, colour = nf.format_code(F.col("c_acctbal"), "#,##0.00;[Red](#,##0.00)", half_even=True, signed_zero=True)
    share, _ = nf.format_code(F.col("c_acctbal") / 10000, "0.0%", half_even=True)
    return _t(spark, sf_dir, "customer").select("c_custkey", money.alias("money"), colour.alias("money_colour"), share.alias("share"))


@_query("""SELECT o_orderkey, strftime(o_orderdate, '%-d-%b-%y') AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS t, strftime(o_orderdate, '%A, %B %d') AS w FROM orders""")
def numfmt_date(spark, sf_dir):
    serial = nf.serial_of(F.col("o_orderdate"))
    made = {"d": "d-mmm-yy", "t": "yyyy-mm-dd hh:mm", "w": "dddd, mmmm dd"}
    return _t(spark, sf_dir, "orders").select("o_orderkey", *[nf.format_code(serial, code)[0].alias(n) for n, code in made.items()])


@_query("""SELECT o_orderkey, CAST(datediff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS BIGINT) AS serial FROM orders""")
def serial_dates(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.floor(nf.serial_of(F.col("o_orderdate"))).cast("long").alias("serial"))


@_query("""SELECT o_orderkey, CASE WHEN n = 8 THEN CAST(CAST(w + 1 AS BIGINT) AS VARCHAR) WHEN n = 0 THEN CAST(CAST(w AS BIGINT) AS VARCHAR)
ELSE CAST(CAST(w AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(n AS BIGINT) AS VARCHAR) || '/8' END AS eighths
FROM (SELECT o_orderkey, floor(o_totalprice) AS w, floor((o_totalprice - floor(o_totalprice)) * 8 + 0.5) AS n FROM orders)""")
def numfmt_fraction(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", nf.format_code(F.col("o_totalprice"), "# ?/8")[0].alias("eighths"))


@_query("""SELECT l_returnflag, round(sum(l_quantity) + sum(l_extendedprice) + sum(l_discount), 2) AS three_columns, max(greatest(l_quantity, l_discount)) AS largest FROM lineitem GROUP BY l_returnflag""")
def range_sum(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return _rounded(aggregate_formulas(df, {"three_columns": "=SUM(B:D)", "largest": "=MAX(B:B,D:D)"}, ["l_returnflag"], errors=False), "three_columns")


@_query("""SELECT l_linestatus, round(sum(CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE 0 END), 2) AS built, count(CASE WHEN l_discount = 0.05 THEN 1 END) AS computed, count(CASE WHEN l_tax <> -1 THEN 1 END) AS signed FROM lineitem GROUP BY l_linestatus""")
def sumif_built(spark, sf_dir):
    wanted = {"built": '=SUMIF([l_quantity],">"&20+5,[l_extendedprice])', "computed": "=COUNTIF([l_discount],10/200)", "signed": '=COUNTIF([l_tax],"<>"&-1)'}
    return _rounded(aggregate_formulas(_t(spark, sf_dir, "lineitem"), wanted, ["l_linestatus"], errors=False), "built")


@_query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS class, CASE WHEN p_size > 20 AND p_size <= 40 THEN '#DIV/0!' END AS class_error,
  CASE p_size WHEN 1 THEN 10 WHEN 2 THEN NULL ELSE 0 END::DOUBLE AS code, CASE WHEN p_size = 2 THEN '#NUM!' END AS code_error FROM part""")
def ifs_errors(spark, sf_dir):
    df = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    return with_formulas(df, {"class": '=IFS([p_size]>40,"large",[p_size]>20,1/0,TRUE,[p_size])', "code": "=SWITCH([p_size],1,10,2,SQRT(-1),0)"}).drop("p_size")


@_query("""SELECT l_linestatus, arg_min(l_extendedprice, l_orderkey * 10 + l_linenumber) FILTER (WHERE l_quantity = 7) AS price, CAST(NULL AS VARCHAR) AS price_error, CAST(NULL AS DOUBLE) AS missing, '#N/A' AS missing_error FROM lineitem GROUP BY l_linestatus""")
def vlookup_formula(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_extendedprice").alias("price"))
    df = df.select("l_linestatus", "q", "price", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return aggregate_formulas(df, {"price": "=VLOOKUP(3+4,B:C,2)", "missing": "=VLOOKUP(-1,B:C,2)"}, ["l_linestatus"], row="line")


@_query("""WITH p AS (SELECT p_partkey, p_retailprice AS x, CASE WHEN p_retailprice < 1000 THEN 0 ELSE 3 END AS e3, CASE WHEN p_retailprice > 999.5 AND p_retailprice < 1000 THEN 3 ELSE floor(log10(p_retailprice)) END AS e FROM part),
m AS (SELECT *, x / power(10, e) AS m, x / power(10, e3) AS n FROM p)
SELECT p_partkey, format('{:.2f}', CASE WHEN m * 200 = floor(m * 200) AND m * 8 = floor(m * 8) THEN m + 0.001 ELSE m END) || 'E+' || printf('%02d', CAST(e AS INTEGER)) AS scientific,
format('{:.1f}', CASE WHEN n * 20 = floor(n * 20) AND n * 4 = floor(n * 4) THEN n + 0.01 ELSE n END) || 'E+' || e3 AS engineering, CAST(floor(x) AS INTEGER) || ':' || printf('%02d', CAST(floor(round((x - floor(x)) * 3600) / 60) AS INTEGER)) AS elapsed FROM m""")
def numfmt_scientific(spark, sf_dir):
    p = F.col("p_retailprice")
    return _t(spark, sf_dir, "part").select("p_partkey", nf.format_code(p, "0.00E+00")[0].alias("scientific"), nf.format_code(p, "##0.0E+0")[0].alias("engineering"), nf.format_code(p / 24, "[h]:mm")[0].alias("elapsed"))


@_query("""SELECT year(l_shipdate) AS ship_year, round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 2) AS A, round(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END), 2) AS N, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 2) AS R
FROM lineitem GROUP BY 1""")
def chart_pivot_series(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("ship_year", F.year("l_shipdate").cast("long"))
    return charts.series(li, "ship_year", "l_returnflag", F.round(F.sum("l_extendedprice"), 2), ["A", "N", "R"])


@_query("""WITH g AS (SELECT n_regionkey AS region, c_mktsegment AS segment, round(sum(c_acctbal) - 400000, 2) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(CASE WHEN v >= 0 THEN v END) OVER b, 0) AS up, coalesce(sum(CASE WHEN v < 0 THEN v END) OVER b, 0) AS down, sum(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY region) AS pos FROM g WINDOW b AS (PARTITION BY region ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT region, segment, v, round(CASE WHEN v >= 0 THEN up ELSE down END, 2) AS base, round(CASE WHEN v >= 0 THEN up ELSE down END + v, 2) AS top, round(coalesce(v / pos * 100, 0), 6) AS share FROM w""")
def chart_stack_pct(spark, sf_dir):
    named = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = named.groupBy(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.round(F.sum("c_acctbal") - 400000, 2).alias("v"))
    out = charts.shares(charts.stacks(g, "region", "segment", "v"), "region", "v")
    return _rounded(_rounded(out, "base", "top"), "share", digits=6)


@_query("""WITH g AS (SELECT p_brand, p_size, round(sum(p_retailprice), 2) AS v FROM part GROUP BY 1, 2), t AS (SELECT *, sum(v) OVER (PARTITION BY p_brand) AS total, sum(v) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto FROM g)
SELECT p_brand, p_size, round((upto - v) / total * 2 * pi() - pi() / 2, 6) AS "start", round(upto / total * 2 * pi() - pi() / 2, 6) AS "end" FROM t""")
def chart_pie_angles(spark, sf_dir):
    g = _t(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.round(F.sum("p_retailprice"), 2).alias("v"))
    return _rounded(charts.pie(g, "p_size", "v", "p_brand").select("p_brand", "p_size", "start", "end"), "start", "end", digits=6)


@_query("""WITH r AS (SELECT c_mktsegment, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1),
u AS (SELECT *, power(10, floor(log10(abs(low)))) AS ul, power(10, floor(log10(abs(high)))) AS uh FROM r)
SELECT c_mktsegment, low, high, sign(low) * ul * CASE WHEN abs(low) / ul <= 1 THEN 1 WHEN abs(low) / ul <= 2 THEN 2 WHEN abs(low) / ul <= 5 THEN 5 ELSE 10 END AS axis_low,
sign(high) * uh * CASE WHEN abs(high) / uh <= 1 THEN 1 WHEN abs(high) / uh <= 2 THEN 2 WHEN abs(high) / uh <= 5 THEN 5 ELSE 10 END AS axis_high FROM u""")
def chart_axis_nice(spark, sf_dir):
    r = charts.series_range(_t(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"])
    return r.withColumn("axis_low", charts.nice(F.col("low"))).withColumn("axis_high", charts.nice(F.col("high")))


@_query("""SELECT l_orderkey, l_linenumber, coalesce(sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_quantity END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM lineitem""")
def grid_offsets(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("hidden", F.col("l_linestatus") == "F").withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return grid.offsets(li, "l_quantity", by=["l_orderkey"], order="place", hidden="hidden").select("l_orderkey", "l_linenumber", "offset")


@_query("""WITH cells AS (SELECT DISTINCT o_custkey % 5 AS sheet, o_orderkey AS "row", o_custkey % 26 AS col FROM orders),
m AS (SELECT n_regionkey AS sheet, n_nationkey * 400 AS "row", n_nationkey * 400 + 150 AS end_row, n_nationkey % 10 AS col, n_nationkey % 10 + 8 AS end_col FROM nation)
SELECT sheet, "row", col FROM cells c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.sheet = c.sheet AND c."row" BETWEEN m."row" AND m.end_row AND c.col BETWEEN m.col AND m.end_col)""")
def range_join_merge_anti(spark, sf_dir):
    cells = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("sheet"), F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 26).alias("col")).distinct()
    n = F.col("n_nationkey").cast("long")
    merges = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("sheet"), (n * 400).alias("row"), (n * 400 + 150).alias("end_row"), (n % 10).alias("col"), (n % 10 + 8).alias("end_col"))
    return grid.in_ranges(cells, merges, by=["sheet"], how="left_anti").select("sheet", "row", "col")


@_query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS thread FROM conversations GROUP BY conv_id""")
def thread_in_turn(spark, sf_dir):
    return hierarchy.in_turn(_t(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")), "conv_id", "turn", "text")


@_query("""SELECT a.conv_id, a.turn, count(b.turn) AS n_replies FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role <> 'assistant' OR NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = a.conv_id AND p.turn = a.turn - 1 AND p.role = 'user') GROUP BY 1, 2""")
def thread_tree(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    parent = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("turn").alias("up"))
    linked = c.join(parent, ["conv_id", "turn", "role"], "left")
    comments = linked.select("conv_id", F.col("turn").cast("string").alias("id"), F.col("up").cast("string").alias("parent_id"), F.lpad(F.col("turn").cast("string"), 8, "0").alias("date"), "text")
    return hierarchy.threads(comments, ["conv_id"]).select("conv_id", F.col("id").cast("long").alias("turn"), F.size("replies").cast("long").alias("n_replies"))


@_query("""SELECT 'r' || r_regionkey AS id, CAST(0 AS INTEGER) AS level, lpad(CAST(r_regionkey AS VARCHAR), 19, '0') AS path FROM region
UNION ALL SELECT 'n' || n_nationkey, 1, lpad(CAST(n_regionkey AS VARCHAR), 19, '0') || '.' || lpad(CAST(n_nationkey AS VARCHAR), 19, '0') FROM nation
UNION ALL SELECT 's' || s_suppkey, 2, lpad(CAST(n_regionkey AS VARCHAR), 19, '0') || '.' || lpad(CAST(n_nationkey AS VARCHAR), 19, '0') || '.' || lpad(CAST(s_suppkey AS VARCHAR), 19, '0') FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def hierarchy_recursive(spark, sf_dir):
    r, n, s = (_t(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = r.select(F.lit("top").alias("src"), name("r", "r_regionkey").alias("dst"), F.col("r_regionkey").cast("long").alias("ord"))
    edges = edges.union(n.select(name("r", "n_regionkey"), name("n", "n_nationkey"), F.col("n_nationkey").cast("long"))).union(s.select(name("n", "s_nationkey"), name("s", "s_suppkey"), F.col("s_suppkey").cast("long")))
    return hierarchy.levels(spark.sql("SELECT 'top' AS id, 'doc' AS kind"), edges)


@_query("""SELECT n_nationkey, CAST(r AS INTEGER) AS cell_row, CAST(c AS INTEGER) AS cell_col FROM nation, unnest(range(0, n_regionkey + 1)) AS x(r), unnest(range(n_nationkey, n_nationkey + 3)) AS y(c)""")
def hyperlink_expand(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    ranges = n.select("n_nationkey", F.lit(0).alias("row"), F.col("n_regionkey").alias("end_row"), F.col("n_nationkey").alias("col"), (F.col("n_nationkey") + 2).alias("end_col"))
    return grid.expanded(ranges).select("n_nationkey", "cell_row", "cell_col")


@_query("""SELECT n_nationkey, n_name AS "left", 'Page ' || n_nationkey AS center, 'A&B' AS "right" FROM nation""")
def header_zones(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    code = F.concat(F.lit("&L&A&CPage &P&RA&&B"))
    fill = lambda z: grid.header_text(z, date="", time="", sheet=F.col("n_name"), page=F.col("n_nationkey"), pages=F.lit(1), file=F.lit(""))
    zones = grid.header_zones(code)
    return n.select("n_nationkey", *[fill(zones[z]).alias(z) for z in ("left", "center", "right")])


@_query("""SELECT p_partkey, CASE WHEN k < 26 THEN chr(CAST(65 + k AS INTEGER)) WHEN k < 702 THEN chr(CAST(65 + (k - 26) // 26 AS INTEGER)) || chr(CAST(65 + (k - 26) % 26 AS INTEGER)) ELSE chr(CAST(65 + (k - 702) // 676 AS INTEGER)) || chr(CAST(65 + (k - 702) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (k - 702) % 26 AS INTEGER)) END AS letters
FROM (SELECT p_partkey, p_partkey % 16384 AS k FROM part)""")
def column_letters(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", letters_column(F.col("p_partkey") % 16384).alias("letters"))


@_query("""SELECT o_custkey, '<tr>' || string_agg('<td>' || o_orderstatus || '</td>', '' ORDER BY o_orderkey) || '</tr>' AS html FROM orders GROUP BY o_custkey""")
def html_rows(spark, sf_dir):
    cells = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row"), F.col("o_orderkey").alias("col"), F.col("o_orderstatus").alias("value"))
    return grid.html_rows(cells, by=[]).select(F.col("row").alias("o_custkey"), "html")


@_query("""SELECT user_id, arg_max(event_type, (ts, event_type)) AS item, max(ts) AS at FROM events GROUP BY user_id""")
def latest_selection(spark, sf_dir):
    return selections.latest_selection(_t(spark, sf_dir, "events"))


@_query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS "start", event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_counts(spark, sf_dir):
    return selections.windowed_counts(_t(spark, sf_dir, "events"), "1 hour")


@_query("""SELECT event_id FROM events WHERE lower(event_type) = 'click' OR value > 50""")
def criteria_filter(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.where(crit.criteria(text(F.col("event_type")), "Click") | crit.criteria(number(F.col("value")), ">50")).select("event_id")


# Orders as the cells of five sheets, eight columns wide, one order a place.
_CELLS_SQL = """cells AS (SELECT o_orderkey % 5 AS sheet, o_orderkey // 40 AS "row", o_orderkey // 5 % 8 AS col, o_orderkey,
CASE o_custkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END WHEN 3 THEN '#N/A' ELSE '' END AS value,
CASE o_custkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' WHEN 3 THEN 'error' ELSE 'empty' END AS kind FROM orders)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey")
    value = F.when(c % 5 == 0, F.col("o_orderpriority")).when(c % 5 == 1, c.cast("string")).when(c % 5 == 2, F.when(c % 2 == 0, F.lit("TRUE")).otherwise(F.lit("FALSE"))).when(c % 5 == 3, F.lit("#N/A")).otherwise(F.lit(""))
    kind = F.when(c % 5 == 0, F.lit("string")).when(c % 5 == 1, F.lit("number")).when(c % 5 == 2, F.lit("boolean")).when(c % 5 == 3, F.lit("error")).otherwise(F.lit("empty"))
    return _t(spark, sf_dir, "orders").select((k % 5).alias("sheet"), F.floor(k / 40).alias("row"), (F.floor(k / 5) % 8).alias("col"), k.alias("o_orderkey"), value.alias("value"), kind.alias("kind"))


def _boxes(spark: SparkSession, sf_dir: str, *, every: int, height: int, col: int, width: int) -> DataFrame:
    """A range a nation, on the sheet of its region."""
    n = F.col("n_nationkey").cast("long")
    return _t(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("sheet"), n.alias("n"), (n * every).alias("row"), (n * every + height - 1).alias("end_row"), (n % col).alias("col"), (n % col + width - 1).alias("end_col"))


@_query(f"""WITH {_CELLS_SQL}, n AS (SELECT *, CASE WHEN kind = 'boolean' THEN CASE WHEN value = 'TRUE' THEN 1 ELSE 0 END WHEN value = '' THEN 0 ELSE try_cast(value AS DOUBLE) END AS v FROM cells)
SELECT o_orderkey, "row" % 2 = 1 AND kind <> 'empty' AS filled_even_row, kind = 'error' OR contains(lower(value), 'urgent') AS error_or_urgent, contains(lower(value), 'high') AS high, NOT contains(lower(value), 'high') AS not_high,
left(value, 2) = '1-' AS first_two, right(value, 1) <> 'E' AS last_one, (col + 1) % 3 = 1 AS third_column, coalesce(v >= 100, false) AS large, NOT coalesce(v >= 100, false) AS not_large, kind IN ('number', 'boolean') AS numeric, coalesce(v % 2 = 1, false) AS odd, false AS unknown FROM n""")
def cf_expression_forms(spark, sf_dir):
    df = _cells(spark, sf_dir)
    cell = Cell(F.col("value"), F.col("kind"), F.col("row") + 1, F.col("col") + 1)
    forms = {
        "filled_even_row": "=AND(ISEVEN(ROW()),NOT(ISBLANK(A1)))", "error_or_urgent": '=OR(ISERROR(B2),SEARCH("Urgent",$B2))', "high": '=ISNUMBER(SEARCH("high",A1))', "not_high": 'SEARCH("high",A1)<>1',
        "first_two": 'LEFT(A1,2)="1-"', "last_one": 'RIGHT(A1)<>"E"', "third_column": "MOD(COLUMN(),3)=1", "large": "$A$1>=100", "not_large": "NOT(A1>=100)", "numeric": "ISNUMBER(C3)", "odd": "ISODD(C3)", "unknown": "VLOOKUP(A1,B1:C9,2)=1",
    }
    return df.select("o_orderkey", *[rule_expression(f, cell).alias(n) for n, f in forms.items()])


@_query(f"""WITH {_CELLS_SQL}, size AS (SELECT sheet, max("row") + 1 AS rows FROM cells GROUP BY sheet), spine AS (SELECT sheet, r AS "row", c AS col FROM size, unnest(range(0, rows)) AS a(r), unnest(range(0, 8)) AS b(c))
SELECT sheet, "row", col, coalesce(kind = 'empty' OR value = '', true) AS is_blank, coalesce(kind = 'error', false) AS is_error FROM spine LEFT JOIN cells USING (sheet, "row", col)""")
def cf_blanks_errors(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    size = cells.groupBy("sheet").agg((F.max("row") + 1).alias("rows")).withColumn("cols", F.lit(8))
    places = sheet.dense(size, cells, by=["sheet"])
    return places.select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), (cf.blank(F.col("value")) | (F.col("kind") == "empty")).alias("is_blank"), cf.erroneous(F.col("kind")).alias("is_error"))


@_query(f"""WITH {_CELLS_SQL}, size AS (SELECT sheet, max("row") + 1 AS rows FROM cells GROUP BY sheet), spine AS (SELECT sheet, r AS "row", c AS col FROM size, unnest(range(0, rows)) AS a(r), unnest(range(0, 8)) AS b(c)),
m AS (SELECT n_regionkey AS sheet, n_nationkey * 3 AS "row", n_nationkey * 3 + 1 AS end_row, n_nationkey % 5 AS col, n_nationkey % 5 + 2 AS end_col FROM nation),
l AS (SELECT n_regionkey AS sheet, n_nationkey * 5 AS "row", n_nationkey * 5 + 2 AS end_row, n_nationkey % 4 AS col, n_nationkey % 4 + 1 AS end_col FROM nation),
notes AS (SELECT s_suppkey % 5 AS sheet, s_suppkey // 40 AS "row", s_suppkey // 5 % 8 AS col, s_name AS author FROM supplier)
SELECT sheet, "row", col, value, CASE WHEN m.sheet IS NULL THEN 1 ELSE 2 END AS row_span, CASE WHEN m.sheet IS NULL THEN 1 ELSE 3 END AS col_span, author,
EXISTS (SELECT 1 FROM l WHERE l.sheet = s.sheet AND s."row" BETWEEN l."row" AND l.end_row AND s.col BETWEEN l.col AND l.end_col) AS listed
FROM spine s LEFT JOIN cells USING (sheet, "row", col) LEFT JOIN notes USING (sheet, "row", col) LEFT JOIN m USING (sheet, "row", col)
WHERE NOT EXISTS (SELECT 1 FROM m c WHERE c.sheet = s.sheet AND s."row" BETWEEN c."row" AND c.end_row AND s.col BETWEEN c.col AND c.end_col AND NOT (c."row" = s."row" AND c.col = s.col))""")
def dense_grid(spark, sf_dir):
    cells, k = _cells(spark, sf_dir), F.col("s_suppkey").cast("long")
    size = cells.groupBy("sheet").agg((F.max("row") + 1).alias("rows")).withColumn("cols", F.lit(8))
    notes = _t(spark, sf_dir, "supplier").select((k % 5).alias("sheet"), F.floor(k / 40).alias("row"), (F.floor(k / 5) % 8).alias("col"), F.col("s_name").alias("author"))
    merges = _boxes(spark, sf_dir, every=3, height=2, col=5, width=3).drop("n")
    lists = _boxes(spark, sf_dir, every=5, height=3, col=4, width=2).drop("n")
    out = sheet.dense(size, cells.select("sheet", "row", "col", "value"), by=["sheet"], merges=merges, sides={"note": notes}, ranges={"listed": lists})
    return out.select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value", F.col("row_span").cast("int").alias("row_span"), F.col("col_span").cast("int").alias("col_span"), F.col("note.author").alias("author"), "listed")


@_query(f"""WITH {_CELLS_SQL} SELECT o_orderkey, CASE WHEN col < 2 AND "row" < 3 THEN 'both' WHEN "row" < 3 THEN 'row' WHEN col < 2 THEN 'col' END AS frozen, "row" = 1 AND col BETWEEN 2 AND 5 AS header,
col BETWEEN sheet AND sheet + 1 OR EXISTS (SELECT 1 FROM nation WHERE n_regionkey = sheet AND n_nationkey * 2 = "row") AS hidden FROM cells""")
def grid_flags(spark, sf_dir):
    region = F.col("r_regionkey").cast("long")
    columns = _t(spark, sf_dir, "region").select(region.alias("sheet"), region.alias("first_col"), (region + 1).alias("last_col"))
    rows = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("sheet"), (F.col("n_nationkey").cast("long") * 2).alias("row"))
    places = sheet.with_hidden(_cells(spark, sf_dir), by=["sheet"], rows=rows, columns=columns)
    r, c = F.col("row"), F.col("col")
    return places.select("o_orderkey", sheet.frozen(r, c, F.lit(2), F.lit(3)).alias("frozen"), sheet.filter_header(r, c, first_row=F.lit(1), first_col=F.lit(2), last_col=F.lit(5)).alias("header"), "hidden")


@_query(r"""WITH p AS (SELECT p_partkey, p_retailprice AS x, CASE p_partkey % 5 WHEN 0 THEN '' ELSE CAST(p_retailprice AS VARCHAR) END AS value, CASE WHEN p_partkey % 3 = 0 THEN 'A' || p_partkey || '*2' END AS formula, p_partkey % 4 AS f FROM part)
SELECT p_partkey, CASE WHEN value = '' THEN coalesce('=' || formula, '') WHEN f = 0 THEN regexp_replace(CAST(x AS VARCHAR), '\.0$', '') WHEN f = 1 THEN format('{:.2f}', x) WHEN f = 2 THEN format('{:,.2f}', x) ELSE format('{:.2f}', x * 100) || '%' END AS shown,
value = '' AND formula IS NOT NULL AS is_formula, NOT (value = '' AND formula IS NOT NULL) AS is_numeric FROM p""")
def displayed_value(spark, sf_dir):
    k, x = F.col("p_partkey"), F.col("p_retailprice")
    value = F.when(k % 5 == 0, F.lit("")).otherwise(x.cast("string"))
    formula = F.when(k % 3 == 0, F.concat(F.lit("A"), k.cast("string"), F.lit("*2")))
    # Built-in formats by number: none (99 is no format), 0.00, #,##0.00, 0.00%.
    code = nf.code_of(F.element_at(F.array(*[F.lit(i) for i in (99, 2, 4, 10)]), (k % 4 + 1).cast("int")))
    shown, _ = nf.format_by(x, code, ["0.00", "#,##0.00", "0.00%"])
    d = sheet.displayed(value, F.lit("number"), formula, shown)
    return _t(spark, sf_dir, "part").select("p_partkey", d["text"].alias("shown"), d["formula"].alias("is_formula"), d["numeric"].alias("is_numeric"))


@_query("""SELECT o_custkey, o_orderstatus AS kind, o_orderkey AS place, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey % 3 DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def cf_graphic_winner(spark, sf_dir):
    hits = _t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 3).alias("priority"), F.col("o_orderkey").alias("place"), F.col("o_totalprice").alias("value"))
    return cf.last_graphic(hits, by=["o_custkey"]).select("o_custkey", "kind", "place", "value")


@_query(f"""WITH {_CELLS_SQL}, c AS (SELECT *, CASE WHEN kind = 'boolean' THEN CASE WHEN value = 'TRUE' THEN 1 ELSE 0 END WHEN value = '' THEN 0 ELSE try_cast(value AS DOUBLE) END AS v FROM cells),
r AS (SELECT n_nationkey AS n, n_regionkey AS sheet, n_nationkey * 2 AS "row", n_nationkey * 2 + 19 AS end_row, n_nationkey % 3 AS col, n_nationkey % 3 + 5 AS end_col FROM nation)
SELECT n, o_orderkey, coalesce(CASE n % 8 WHEN 0 THEN v BETWEEN 100 AND 900 WHEN 1 THEN v > 500 WHEN 2 THEN lower(value) = '#n/a' WHEN 3 THEN contains(lower(value), 'high') WHEN 4 THEN NOT contains(lower(value), 'high') WHEN 5 THEN starts_with(lower(value), '1-u') WHEN 6 THEN value <> '' ELSE false END, false) AS holds
FROM c JOIN r ON c.sheet = r.sheet AND c."row" BETWEEN r."row" AND r.end_row AND c.col BETWEEN r.col AND r.end_col""")
def cf_rules_by_range(spark, sf_dir):
    # type, operator, first, second, text of a rule, by the nation's number
    rules = [("cellIs", "between", "100", "900", None), ("cellIs", "greaterThan", "500", None, None), ("cellIs", "equal", '"#n/a"', None, None), ("containsText", None, None, None, "High"), ("notContainsText", None, None, None, "High"), ("beginsWith", None, None, None, "1-U"), ("notContainsBlanks", None, None, None, None), ("sparkle", None, None, None, None)]
    rule = F.element_at(F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("type", "operator", "first", "second", "text"), r, strict=True)]) for r in rules]), (F.col("n") % 8 + 1).cast("int"))
    ranges = _boxes(spark, sf_dir, every=2, height=20, col=3, width=6).withColumn("rule", rule)
    hits = grid.in_ranges(_cells(spark, sf_dir), ranges, by=["sheet"]).select("*", "range_rule.*")
    return hits.select(F.col("range_n").alias("n"), "o_orderkey", cf.holding(hits).alias("holds"))


@_query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '#' || n_regionkey END AS negative FROM nation""")
def cf_bar_extension(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    rules = n.select("n_nationkey", F.lit(1).alias("book"), F.concat(F.lit("{"), F.lower("n_name"), F.lit("}")).alias("guid"))
    extensions = n.where("n_nationkey % 2 = 0").select(F.lit(1).alias("book"), F.upper("n_name").alias("guid"), F.concat(F.lit("#"), F.col("n_regionkey").cast("string")).alias("negative"))
    return cf.with_extensions(rules, extensions, by=["book"]).select("n_nationkey", "negative")


@_query("""SELECT n_nationkey, '<ruby>' || substr(n_name, 1, 2) || '<rt>a</rt></ruby>' || substr(n_name, 3, 1) || '<ruby>' || substr(n_name, 4, 2) || '<rt>c</rt></ruby>' || substr(n_name, 6) AS html FROM nation""")
def phonetic_ruby(spark, sf_dir):
    run = lambda a, b, p: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(p).alias("phonetic"))
    runs = F.array(run(3, 5, "c"), run(1, 3, "b"), run(-1, 2, "a"), run(4, 4, "d"), run(90, 99, "e"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", sheet.ruby_html(sheet.ruby(F.col("n_name"), runs)).alias("html"))


@_query(f"""WITH {_CELLS_SQL} SELECT n_nationkey AS control, string_agg(value, '|' ORDER BY "row", col) AS offered FROM cells JOIN nation ON n_regionkey = sheet AND "row" BETWEEN n_nationkey * 2 AND n_nationkey * 2 + 5 AND col BETWEEN n_nationkey % 3 AND n_nationkey % 3 + 1 WHERE value <> '' GROUP BY 1""")
def control_values(spark, sf_dir):
    ranges = _boxes(spark, sf_dir, every=2, height=6, col=3, width=2).withColumnRenamed("n", "control")
    return sheet.input_values(_cells(spark, sf_dir), by=["sheet"], ranges=ranges).select("control", F.array_join("values", "|").alias("offered"))


@_query(f"""WITH {_CELLS_SQL} SELECT o_orderkey, CASE WHEN s_suppkey IS NULL THEN value ELSE s_name END AS text FROM cells LEFT JOIN supplier ON s_suppkey = o_orderkey""")
def control_update(spark, sf_dir):
    places = _cells(spark, sf_dir).withColumnRenamed("value", "text")
    k = F.col("s_suppkey").cast("long")
    updates = _t(spark, sf_dir, "supplier").select((k % 5).alias("sheet"), F.floor(k / 40).alias("row"), (F.floor(k / 5) % 8).alias("col"), F.col("s_name").alias("new"))
    return sheet.with_updates(places, updates, by=["sheet"]).select("o_orderkey", "text")


#: A sheet for each nation, a row for each of its customers: balances, segments, a text and a number in the first columns.
_SHEETS = """WITH placed AS (SELECT 'n' || c_nationkey AS sheet, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row, c_acctbal AS a, c_mktsegment AS b, c_custkey % 7 AS c FROM customer),
noted AS (SELECT *, row + 1 AS r, regexp_replace(CAST(floor(a * 10 + 0.5) / 10 AS VARCHAR), '\\.0$', '') AS tenth FROM placed)"""


def _nation_sheets(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    return _t(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("sheet"), place.alias("row"), F.col("c_acctbal").alias("a"), F.col("c_mktsegment").alias("b"), (F.col("c_custkey") % 7).alias("c"))


def _sheet_cells(spark, sf_dir, formulas, cached=None):
    """Cells of the sheets of nations: values in A to C, then formulas, in which ``#`` stands for the row's number; ``cached`` columns hold a value."""
    rows, cached = _nation_sheets(spark, sf_dir), cached or {}
    cell = lambda col, kind, value, formula: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), formula.cast("string").alias("formula"))
    none, number = F.lit(None), (F.col("row") + 1).cast("string")
    cells = [cell(0, "number", F.col("a"), none), cell(1, "string", F.col("b"), none), cell(2, "number", F.col("c"), none)]
    cells += [cell(3 + i, "number" if i in cached else "empty", F.lit(cached.get(i, "")), F.replace(F.lit(f), F.lit("#"), number)) for i, f in enumerate(formulas)]
    return rows.select("sheet", "row", F.explode(F.array(*cells)).alias("cell")).select("sheet", "row", "cell.*")


@_query(_SHEETS + """, made AS (
SELECT sheet, row, 3 AS col, tenth AS value, 'number' AS kind FROM noted
UNION ALL SELECT sheet, row, 4, CASE WHEN a < 0 THEN 'debt' WHEN c = 0 THEN '#DIV/0!' ELSE b END, CASE WHEN a >= 0 AND c = 0 THEN 'error' ELSE 'string' END FROM noted
UNION ALL SELECT sheet, row, 5, CAST(sum(c) OVER w AS VARCHAR), 'number' FROM noted WINDOW w AS (PARTITION BY sheet ORDER BY row)
UNION ALL SELECT sheet, row, 6, CAST(count(*) OVER (PARTITION BY sheet, b ORDER BY row) AS VARCHAR), 'number' FROM noted
UNION ALL SELECT sheet, row, 7, CAST(first_value(c) OVER (PARTITION BY sheet, b ORDER BY row) AS VARCHAR), 'number' FROM noted
UNION ALL SELECT sheet, row, 8, CAST(max(c) OVER (PARTITION BY sheet ORDER BY row ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS VARCHAR), 'number' FROM noted QUALIFY row >= 2
UNION ALL SELECT sheet, row, 9, CAST(coalesce(sum(CASE WHEN c > 3 THEN c END) OVER (PARTITION BY sheet ORDER BY row), 0) AS VARCHAR), 'number' FROM noted
UNION ALL SELECT sheet, row, 10, '7', 'number' FROM noted
UNION ALL SELECT sheet, row, 11, '8', 'number' FROM noted
UNION ALL SELECT sheet, row, 12, '1', 'number' FROM noted)
SELECT sheet, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, kind, value FROM made""")
def sheet_recalculation(spark, sf_dir):
    """One pass: what has a value keeps it, and a formula sees other formulas' cells as they were."""
    formulas = ["=ROUND(A#,1)", '=IF(A#<0,"debt",IF(C#=0,1/0,B#))', "=SUM(C$1:C#)", "=COUNTIF(B$1:B#,B#)", "=VLOOKUP(B#,$B$1:$C$99999,2)", "=MAX(OFF)", '=SUMIF(C$1:C#,">3")', "=1/0", "=K#+1", "=M#+1"]
    cells = _sheet_cells(spark, sf_dir, formulas, {7: "7"})
    third = F.when(F.col("row") >= 2, F.concat(F.lit("=MAX(C"), (F.col("row") - 1).cast("string"), F.lit(":C"), (F.col("row") + 1).cast("string"), F.lit(")")))
    cells = cells.withColumn("formula", F.when(F.col("col") == 8, third).otherwise(F.col("formula"))).where("NOT (col = 8 AND row < 2)")
    return recalculate.recalculate(cells).where("col > 2").select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "kind", "value")


@_query(_SHEETS + """SELECT sheet, CAST(row AS BIGINT) AS row, CAST(c * 2 AS VARCHAR) AS twice, CAST(6 AS VARCHAR) AS next FROM noted""")
def sheet_recalculation_forced(spark, sf_dir):
    """``force``: cached values are replaced; the formula beside still sees the cached one."""
    cells = _sheet_cells(spark, sf_dir, ["=C#*2", "=D#+1"], {0: "5", 1: "9"})
    out = recalculate.recalculate(cells, force=True).where("col > 2")
    return out.groupBy("sheet", F.col("row").cast("long").alias("row")).agg(F.max(F.when(F.col("col") == 3, F.col("value"))).alias("twice"), F.max(F.when(F.col("col") == 4, F.col("value"))).alias("next"))


@_query("""WITH placed AS (SELECT l_returnflag AS sheet, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS row, l_quantity, l_tax FROM lineitem),
ranges AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS sheet, p_partkey * 3 % 900 AS low, p_partkey * 3 % 900 + p_size * 40 AS high, p_partkey % 2 AS first, 1 AS last FROM part)
SELECT id, round(coalesce(sum(CASE WHEN first = 0 THEN l_quantity ELSE 0 END + l_tax), 0), 2) AS total, CAST(count(row) * (last - first + 1) AS DOUBLE) AS n FROM ranges LEFT JOIN placed ON placed.sheet = ranges.sheet AND row BETWEEN low AND high GROUP BY id, first, last""")
def rectangle_totals(spark, sf_dir):
    """Sums and counts of a rectangle for each part, over sheets of line items with two columns."""
    rows = numbered(_t(spark, sf_dir, "lineitem").select(*_LINES, "l_tax"), *_LINE_ORDER, by=["l_returnflag"]).withColumn("row", F.col("row") - 1)
    cells = rows.select(F.col("l_returnflag").alias("sheet"), "row", F.posexplode(F.array("l_quantity", "l_tax")).alias("col", "total")).withColumn("n", F.lit(1.0))
    key = F.col("p_partkey")
    ranges = _t(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 3 == 0, "A").when(key % 3 == 1, "N").otherwise("R").alias("sheet"), (key * 3 % 900).alias("row"), (key % 2).alias("col"), (key * 3 % 900 + F.col("p_size") * 40).alias("end_row"), F.lit(1).alias("end_col"))
    return _rounded(rectangles.rectangle_sums(cells, ranges, ["total", "n"]).select("id", "total", "n"), "total")


@_query("""WITH amounts AS (SELECT l_returnflag AS flag, l_quantity AS q, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL),
asked AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS flag, p_partkey % 7 AS k, p_size AS w FROM part),
met AS (SELECT id, n, s FROM asked JOIN amounts USING (flag) WHERE CASE k WHEN 0 THEN q = w WHEN 1 THEN q <> w WHEN 2 THEN q < w WHEN 3 THEN q <= w WHEN 4 THEN q > w WHEN 5 THEN q >= w ELSE q = w END)
SELECT id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, round(coalesce(sum(s), 0), 2) AS total FROM asked LEFT JOIN met USING (id) GROUP BY id""")
def criteria_per_row(spark, sf_dir):
    """A criterion for each part, over the quantities of the line items of a flag."""
    key = F.col("p_partkey")
    sign = F.element_at(F.array(*map(F.lit, ("=", "<>", "<", "<=", ">", ">=", ""))), (key % 7 + 1).cast("int"))
    asked = _t(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 3 == 0, "A").when(key % 3 == 1, "N").otherwise("R").alias("l_returnflag"), F.concat(sign, F.col("p_size").cast("string")).alias("criterion"))
    out = range_criteria.by_criteria(asked, _t(spark, sf_dir, "lineitem"), by=["l_returnflag"], criterion="criterion", value="l_quantity", summed="l_extendedprice")
    return _rounded(out.select("id", "n", "total"), "total")


@_query("""WITH names AS (SELECT p_size AS size, lower(p_brand) AS brand FROM part),
asked AS (SELECT s_suppkey AS id, s_suppkey % 50 + 1 AS size, s_suppkey % 6 AS k, 'brand#' || (s_suppkey % 25) AS w FROM supplier),
met AS (SELECT id FROM asked JOIN names USING (size) WHERE CASE k WHEN 0 THEN brand = w WHEN 1 THEN brand <> w WHEN 2 THEN brand < w WHEN 3 THEN brand <= w WHEN 4 THEN brand > w ELSE brand >= w END)
SELECT asked.id AS id, count(met.id) AS n FROM asked LEFT JOIN met ON asked.id = met.id GROUP BY asked.id""")
def criteria_per_row_text(spark, sf_dir):
    """Criteria that are texts: a brand for each supplier, among the parts of a size."""
    key = F.col("s_suppkey")
    sign = F.element_at(F.array(*map(F.lit, ("", "<>", "<", "<=", ">", ">="))), (key % 6 + 1).cast("int"))
    asked = _t(spark, sf_dir, "supplier").select(key.alias("id"), (key % 50 + 1).alias("p_size"), F.concat(sign, F.lit("Brand#"), (key % 25).cast("string")).alias("criterion"))
    parts = _t(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("long"))
    return range_criteria.by_criteria(asked, parts, by=["p_size"], criterion="criterion", value="p_brand").select("id", "n")


@_query("""WITH g AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS b, count(*) OVER (PARTITION BY o_orderpriority) AS n,
avg(o_totalprice) OVER (PARTITION BY o_orderpriority) + stddev_pop(o_totalprice) OVER (PARTITION BY o_orderpriority) AS t, count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) AS same, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p FROM orders),
l AS (SELECT o_orderpriority, min(o_totalprice) FILTER (WHERE r <= greatest(1, ceil(n * 15 / 100.0))) AS high, max(o_totalprice) FILTER (WHERE b <= 25) AS low FROM g GROUP BY 1)
SELECT o_orderkey, CASE p WHEN 1 THEN o_totalprice >= high WHEN 2 THEN o_totalprice <= low WHEN 3 THEN o_totalprice > t WHEN 4 THEN same > 1 ELSE same = 1 END AS holds FROM g JOIN l USING (o_orderpriority)""")
def cf_rules_of_ranges(spark, sf_dir):
    """Rules as rows, one for each range of orders: top 15 %, lowest 25, above average by a deviation, duplicates, unique values."""
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    hits = _t(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("value"),
        F.when(p <= 2, "top10").when(p == 3, "aboveAverage").when(p == 4, "duplicateValues").otherwise("uniqueValues").alias("type"),
        F.when(p == 1, 15).otherwise(25).alias("rank"), (p == 1).alias("percent"), (p == 2).alias("bottom"), F.lit(False).alias("below"), F.lit(False).alias("equal"), F.when(p == 3, 1.0).alias("deviations"),
    )
    return cf.holding_in_range(hits, by=["o_orderpriority"]).select("o_orderkey", "holds")


@_query("""WITH t AS (SELECT l_returnflag, min(l_extendedprice) AS t0, quantile_cont(l_extendedprice, 0.5) AS t1, quantile_cont(l_extendedprice, 0.9) AS t2, max(l_extendedprice) AS t3 FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(t0, 4) AS t0, round(t1, 4) AS t1, round(t2, 4) AS t2, round(t3, 4) AS t3 FROM t""")
def cf_percentiles_by_range(spark, sf_dir):
    """Thresholds of ranges that hold a third of all rows each."""
    stops = [cf.Stop("min"), cf.Stop("percentile", 50), cf.Stop("percentile", 90), cf.Stop("max")]
    return _rounded(cf.thresholds(_t(spark, sf_dir, "lineitem"), "l_extendedprice", stops, ["l_returnflag"]), "t0", "t1", "t2", "t3", digits=4)


_OUTLINE = """WITH placed AS (SELECT l_returnflag AS sheet, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS row, l_linenumber - 1 AS level, l_linenumber = 1 AND l_quantity > 40 AS collapsed FROM lineitem),
deep AS (SELECT sheet, row, collapsed, unnest(range(1, level + 1)) AS level FROM placed),
runs AS (SELECT *, row - row_number() OVER (PARTITION BY sheet, level ORDER BY row) AS island FROM deep),
found AS (SELECT sheet, level, min(row) AS first_row, max(row) AS last_row FROM runs GROUP BY sheet, level, island),
shut AS (SELECT found.*, coalesce(placed.collapsed, false) AS collapsed FROM found LEFT JOIN placed ON placed.sheet = found.sheet AND placed.row = found.last_row + 1)
"""


def _outline_rows(spark, sf_dir):
    level = F.col("l_linenumber") - 1
    rows = numbered(_t(spark, sf_dir, "lineitem").select(*_LINES), *_LINE_ORDER, by=["l_returnflag"])
    return rows.select(F.col("l_returnflag").alias("sheet"), "row", level.alias("level"), ((level == 0) & (F.col("l_quantity") > 40)).alias("collapsed"))


@_query(_OUTLINE + "SELECT sheet, CAST(level AS INTEGER) AS level, first_row, last_row, collapsed FROM shut")
def outline_groups(spark, sf_dir):
    """Nested groups of rows from their levels, over sheets of line items."""
    return outline.groups(_outline_rows(spark, sf_dir))


@_query(_OUTLINE + """SELECT sheet, row, level, EXISTS (SELECT 1 FROM shut WHERE shut.sheet = placed.sheet AND shut.collapsed AND row BETWEEN first_row AND last_row) AS hidden FROM placed""")
def outline_hidden_rows(spark, sf_dir):
    return outline.with_hidden(_outline_rows(spark, sf_dir)).select("sheet", F.col("row").cast("long").alias("row"), "level", "hidden")
