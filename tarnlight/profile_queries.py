"""Registered profiling queries over the supplied tables, and the SQL that each must equal.

The tables have no nulls and no repeated rows, so some queries make them with nullif or by projection.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distributions import normal_quantile
from .operators import charts, collinearity, outliers, quality, relationships, shape, target, types, univariate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, as sums in another order differ in the last ones; a negative zero becomes zero."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _numeric_sql(source: str, columns: list[str], digits: int = 6) -> str:
    r = lambda x, a: f"round({x}, {digits}) + 0 AS {a}"
    one = lambda c: f"""SELECT '{c}' AS "column", count(x) AS count, count(*) - count(x) AS missing, {r("avg(x)", "mean")}, {r("quantile_cont(x, 0.5)", "median")}, {r("stddev_samp(x)", "std")}, {r("min(x)", "min")}, {r("quantile_cont(x, 0.25)", "q25")}, {r("quantile_cont(x, 0.75)", "q75")}, {r("max(x)", "max")}, {r("quantile_cont(x, 0.75) - quantile_cont(x, 0.25)", "iqr")}, {r("skewness(x)", "skewness")}, {r("kurtosis(x)", "kurtosis")}, {r("CASE WHEN avg(x) = 0 THEN 0 ELSE stddev_samp(x) / avg(x) * 100 END", "cv")}, count(*) FILTER (WHERE x = 0) AS zeros, count(*) FILTER (WHERE x < 0) AS negatives FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {source})"""
    return " UNION ALL ".join(one(c) for c in columns)


@query(_numeric_sql("lineitem", LINE))
def numeric_profile(spark, sf_dir):
    return rounded(univariate.numeric_profile(table(spark, sf_dir, "lineitem"), LINE))


@query(_numeric_sql("(SELECT p_size, p_retailprice FROM part)", ["p_size", "p_retailprice"]))
def numeric_profile_part(spark, sf_dir):
    return rounded(univariate.numeric_profile(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]))


@query(_numeric_sql("(SELECT nullif(l_linenumber, 3) AS l_linenumber, CASE WHEN l_tax > 0.05 THEN NULL ELSE l_extendedprice END AS price FROM lineitem)", ["l_linenumber", "price"]))
def numeric_profile_nulls(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.nullif("l_linenumber", F.lit(3)).alias("l_linenumber"), F.expr("CASE WHEN l_tax > 0.05 THEN NULL ELSE l_extendedprice END").alias("price"))
    return rounded(univariate.numeric_profile(df, ["l_linenumber", "price"]))


def _pearson_sql(source: str, pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs)


def _holes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.nullif("l_linenumber", F.lit(3)).alias("a"), F.expr("CASE WHEN l_discount > 0.07 THEN NULL ELSE l_returnflag END").alias("b"), F.expr("CASE WHEN l_linenumber = 3 AND l_discount > 0.07 THEN NULL ELSE l_tax END").alias("c"))


HOLES = "(SELECT nullif(l_linenumber, 3) AS a, CASE WHEN l_discount > 0.07 THEN NULL ELSE l_returnflag END AS b, CASE WHEN l_linenumber = 3 AND l_discount > 0.07 THEN NULL ELSE l_tax END AS c FROM lineitem)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct FROM {HOLES}" for c in "abc"))
def missing_per_column(spark, sf_dir):
    return rounded(quality.missing_per_column(_holes(spark, sf_dir)))


@query(f"SELECT CAST(a IS NULL AS INT) + CAST(b IS NULL AS INT) + CAST(c IS NULL AS INT) AS n_missing, count(*) AS n_rows FROM {HOLES} GROUP BY 1")
def missing_per_row_hist(spark, sf_dir):
    return quality.missing_per_row(_holes(spark, sf_dir))


@query(f"SELECT count(*) AS empty_rows FROM {HOLES} WHERE a IS NULL AND b IS NULL AND c IS NULL")
def fully_empty_rows(spark, sf_dir):
    return quality.missing_per_row(_holes(spark, sf_dir)).where("n_missing = 3").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("empty_rows"))


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, CAST(sum(n) AS BIGINT) AS n_member_rows, count(*) AS n_groups FROM (SELECT count(*) AS n FROM documents GROUP BY text) WHERE n > 1")
def duplicate_rows(spark, sf_dir):
    return quality.duplicate_counts(table(spark, sf_dir, "documents").select("text"))


@query(f"SELECT a, b, round(c, 6) AS c, count(*) AS n FROM {HOLES} GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return rounded(quality.duplicate_groups(_holes(spark, sf_dir)))


PARTS = "(SELECT p_brand AS brand, CASE WHEN p_retailprice > 999.5 THEN 'b' ELSE 'a' END AS nearly, 'x' AS one, CAST(NULL AS VARCHAR) AS nothing, CASE WHEN p_size > 1 THEN NULL ELSE 'y' END AS rare FROM part)"


def _parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_brand AS brand", "CASE WHEN p_retailprice > 999.5 THEN 'b' ELSE 'a' END AS nearly", "'x' AS one", "CAST(NULL AS STRING) AS nothing", "CASE WHEN p_size > 1 THEN NULL ELSE 'y' END AS rare")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) <= 1 AS constant, count(*) > 1 AND coalesce(max(n) FILTER (WHERE v IS NOT NULL), 0) / sum(n) > 0.99 AS quasi_constant, round(max(n) FILTER (WHERE v IS NOT NULL) / sum(n), 6) AS top_share FROM (SELECT {c} AS v, count(*) AS n FROM {PARTS} GROUP BY 1)""" for c in ("brand", "nearly", "one", "nothing", "rare")))
def constants_quasi(spark, sf_dir):
    return rounded(quality.constants(_parts(spark, sf_dir)))


@query("SELECT 'p_name' AS \"column\", count(DISTINCT p_name) AS nunique FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part")
def cardinality(spark, sf_dir):
    return quality.cardinality(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type", "p_size"])


@query("SELECT * FROM (SELECT 'c_name' AS \"column\", count(DISTINCT c_name) AS nunique FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer) WHERE nunique > 100")
def high_cardinality(spark, sf_dir):
    return quality.high_cardinality(table(spark, sf_dir, "customer"))


TEXTS = "(SELECT CAST(l_quantity AS VARCHAR) AS q, l_returnflag AS f, CASE WHEN l_linenumber = 1 THEN 'n/a' ELSE ' ' || CAST(l_linenumber AS VARCHAR) END AS k FROM lineitem)"


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) FILTER (WHERE regexp_matches(trim({c}), '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$')) AS numeric_count, count(*) FILTER (WHERE regexp_matches(trim({c}), '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$')) > 0.8 * count({c}) AS numeric_as_text FROM {TEXTS}""" for c in "qfk"))
def numeric_as_text(spark, sf_dir):
    return quality.numeric_as_text(table(spark, sf_dir, "lineitem").selectExpr("CAST(l_quantity AS STRING) AS q", "l_returnflag AS f", "CASE WHEN l_linenumber = 1 THEN 'n/a' ELSE ' ' || CAST(l_linenumber AS STRING) END AS k"))


@query("SELECT '?' AS placeholder, count(*) AS n FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT '--', count(*) FROM lineitem WHERE l_linenumber = 2")
def placeholder_counts(spark, sf_dir):
    from .sources.placeholders import placeholder_counts as counts

    df = table(spark, sf_dir, "lineitem").selectExpr("CASE l_linenumber WHEN 1 THEN ' ?' WHEN 2 THEN '-- ' ELSE l_returnflag END AS v")
    return counts(df).select("placeholder", "n")


def _frequency_sql(source: str, columns: list[str], top: int = 20) -> str:
    return " UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {top}""" for c in columns)


@query(_frequency_sql("part", ["p_brand", "p_type", "p_size"]))
def frequency_table_top20(spark, sf_dir):
    return univariate.frequency_table(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(sum(n) FILTER (WHERE v IS NOT NULL) AS BIGINT) AS count, CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS missing, count(v) AS nunique, arg_min(v, (-n, v)) FILTER (WHERE v IS NOT NULL) AS mode, max(n) FILTER (WHERE v IS NOT NULL) AS mode_frequency FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {HOLES} GROUP BY 1)""" for c in "ab"))
def mode_per_column(spark, sf_dir):
    return univariate.categorical_profile(_holes(spark, sf_dir).select("a", "b"), ["a", "b"])


@query("SELECT event_type AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def category_shares(spark, sf_dir):
    return rounded(charts.shares(table(spark, sf_dir, "events"), "event_type"))


def _text_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS nunique, round(avg(length({c})), 6) AS mean_length, CAST(quantile_cont(length({c}), 0.5) AS DOUBLE) AS median_length, CAST(min(length({c})) AS BIGINT) AS min_length, CAST(max(length({c})) AS BIGINT) AS max_length, count(*) FILTER (WHERE length({c}) = 0) AS empty_strings FROM {source}""" for c in columns)


@query(_text_sql("documents", ["text", "source"]))
def text_stats_documents(spark, sf_dir):
    return rounded(univariate.text_profile(table(spark, sf_dir, "documents"), ["text", "source"]))


@query(_text_sql("pages", ["url", "html"]))
def text_stats_pages(spark, sf_dir):
    return rounded(univariate.text_profile(table(spark, sf_dir, "pages"), ["url", "html"]))


@query("SELECT 'o_orderdate' AS \"column\", count(o_orderdate) AS count, count(*) - count(o_orderdate) AS missing, strftime(min(o_orderdate), '%Y-%m-%d') AS min_date, strftime(max(o_orderdate), '%Y-%m-%d') AS max_date, date_diff('day', min(o_orderdate), max(o_orderdate)) AS n_days FROM orders")
def datetime_stats(spark, sf_dir):
    return univariate.datetime_profile(table(spark, sf_dir, "orders"), ["o_orderdate"])


@query("SELECT strftime(b, '%Y-%m-%d') AS gap_from, strftime(x, '%Y-%m-%d') AS gap_to FROM (SELECT x, lag(x) OVER (ORDER BY x) AS b FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS x FROM orders)) WHERE x > b + INTERVAL 7 DAY ORDER BY x LIMIT 5")
def datetime_gaps(spark, sf_dir):
    return univariate.datetime_gaps(table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("m")), "m")


def _period_sql(unit: str) -> str:
    return f"""WITH c AS (SELECT date_trunc('{unit}', o_orderdate) AS p, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT unnest(generate_series(min(p), max(p), INTERVAL 1 {unit.upper()})) AS p FROM c) SELECT CAST(CAST(s.p AS DATE) AS VARCHAR) AS period, coalesce(n, 0) AS n FROM s LEFT JOIN c ON CAST(s.p AS DATE) = CAST(c.p AS DATE)"""


def _periods(unit: str) -> None:
    def f(spark, sf_dir):
        return charts.rows_per_period(table(spark, sf_dir, "orders"), "o_orderdate", unit).select(F.col("period").cast("string").alias("period"), "n")

    f.__name__ = f"rows_per_{unit}"
    query(_period_sql(unit))(f)


for _unit in ("day", "week", "month", "year"):
    _periods(_unit)


@query("SELECT CAST(h AS INT) AS hour, count(ts) AS n FROM generate_series(0, 23) t(h) LEFT JOIN events ON hour(ts) = h GROUP BY h")
def hour_counts(spark, sf_dir):
    return univariate.hour_counts(table(spark, sf_dir, "events"), "ts")


#: Times in the last minute of an hour are made malformed, which a time of day must not count.
def _clocks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr("CASE WHEN minute(ts) = 59 THEN '25:61' ELSE date_format(ts, 'H:mm:ss') END").alias("t"))


@query("SELECT CAST(h AS INT) AS hour, count(t) AS n FROM generate_series(0, 23) g(h) LEFT JOIN (SELECT hour(ts) AS t FROM events WHERE minute(ts) <> 59) ON t = h GROUP BY h")
def time_of_day_hours(spark, sf_dir):
    return univariate.hour_counts(_clocks(spark, sf_dir), "t")


@query("SELECT count(*) FILTER (WHERE minute(ts) <> 59) AS count, strftime(min(ts::TIME) FILTER (WHERE minute(ts) <> 59) + DATE '2000-01-01', '%H:%M:%S') AS earliest, strftime(max(ts::TIME) FILTER (WHERE minute(ts) <> 59) + DATE '2000-01-01', '%H:%M:%S') AS latest FROM events")
def time_of_day_stats(spark, sf_dir):
    r = univariate.time_profile(_clocks(spark, sf_dir), "t")
    return spark.createDataFrame([(r["count"], r["earliest"], r["latest"])], "count long, earliest string, latest string")


@query()
def datetime_frequency(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return spark.createDataFrame([("d", univariate.datetime_frequency(df, "d"))], "column string, frequency string")


def _uniform(spark: bool) -> list[str]:
    """Twelve values for each event, from three digests; their sum is nearly normal, so p is neither 0 nor 1 on few rows."""
    words = [(f"md5(concat(event_id, 's{k // 4}'))", 1 + 8 * (k % 4)) for k in range(12)]
    return [f"CAST(conv(substr({m}, {at}, 8), 16, 10) AS DOUBLE) / 4294967296" if spark else f"CAST(CAST('0x' || substr({m}, {at}, 8) AS BIGINT) AS DOUBLE) / 4294967296" for m, at in words]


def _normal_columns(spark: bool) -> dict[str, str]:
    return {"near_normal": " + ".join(_uniform(spark)), "one_uniform": _uniform(spark)[0]}


def _normality_sql(column: str, x: str) -> str:
    return f"""SELECT * FROM (WITH m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x) AS a FROM (SELECT {x} AS x FROM events)),
d AS (SELECT any_value(n) AS n, avg(pow(x - a, 3)) / pow(avg(pow(x - a, 2)), 1.5) AS g1, avg(pow(x - a, 4)) / pow(avg(pow(x - a, 2)), 2) AS b2 FROM (SELECT {x} AS x FROM events), m),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS k, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM d),
t AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS f FROM s),
z AS (SELECT asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS z1, (1 - 2 / (9 * f) - cbrt((1 - 2 / f) / (1 + k * sqrt(2 / (f - 4))))) / sqrt(2 / (9 * f)) AS z2 FROM t)
SELECT '{column}' AS "column", round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p FROM z)"""


@query(" UNION ALL ".join(_normality_sql(c, x) for c, x in _normal_columns(False).items()))
def normality_tests(spark, sf_dir):
    p = univariate.normality(table(spark, sf_dir, "events").selectExpr(*(f"{x} AS {c}" for c, x in _normal_columns(True).items())), list(_normal_columns(True)))
    return rounded(spark.createDataFrame(list(p.items()), "column string, p double"))


@query("WITH p AS (" + _pearson_sql("lineitem", list(combinations(LINE, 2))) + ") SELECT var1, var2, r FROM p ORDER BY abs(r) DESC LIMIT 2")
def strongest_pairs(spark, sf_dir):
    return rounded(charts.strongest_pairs(table(spark, sf_dir, "lineitem"), list(combinations(LINE, 2)), 2))


def _type_sql(source: str, column: str) -> str:
    """The rules that these tables meet: one value, a whole number that counts or names the rows, few or many numbers, moments, two
    truth values, codes, free text, categories."""
    return f"""SELECT '{column}' AS "column", CASE WHEN u <= 1 THEN 'constant' WHEN t LIKE 'TIMESTAMP%' THEN 'datetime'
WHEN t <> 'VARCHAR' THEN CASE WHEN t IN ('INTEGER', 'BIGINT') AND u = n AND (u - 1.0) / (hi - lo) BETWEEN 0.9 AND 1 THEN 'identifier' WHEN u <= 20 THEN 'numeric_discrete' ELSE 'numeric_continuous' END
ELSE 'categorical' END AS type FROM (SELECT any_value(typeof({column})) AS t, count(DISTINCT {column}) AS u, count({column}) AS n, TRY_CAST(max({column})::VARCHAR AS DOUBLE) AS hi, TRY_CAST(min({column})::VARCHAR AS DOUBLE) AS lo FROM {source})"""


_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(" UNION ALL ".join(_type_sql("lineitem", c) for c in _LINEITEM))
def semantic_types(spark, sf_dir):
    found = types.infer_types(table(spark, sf_dir, "lineitem"))
    return spark.createDataFrame(list(found.items()), "column string, type string")


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(" UNION ALL ".join(_type_sql("orders", c) for c in _ORDERS))
def semantic_types_orders(spark, sf_dir):
    found = types.infer_types(table(spark, sf_dir, "orders"))
    return spark.createDataFrame(list(found.items()), "column string, type string")


PINNED = "(SELECT CASE WHEN l_quantity <= 20 THEN 0 ELSE l_quantity * l_quantity END AS pinned, l_extendedprice AS price, l_quantity AS q FROM lineitem)"


def _pinned(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_quantity <= 20 THEN 0D ELSE l_quantity * l_quantity END AS pinned", "l_extendedprice AS price", "l_quantity AS q")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT 'value' AS "column", round(a - 1.5 * (b - a), 6) AS low, round(b + 1.5 * (b - a), 6) AS high, (SELECT count(*) FROM events WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS n_outliers FROM q""")
def iqr_outliers(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return _fence_rows(df, ["value"])


def _fence_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    f = outliers.fences(df, columns)
    n = df.agg(*(F.count_if(outliers.beyond_fence(f[c])).alias(str(i)) for i, c in enumerate(columns))).first()
    return rounded(df.sparkSession.createDataFrame([(c, f[c].low, f[c].high, n[i]) for i, c in enumerate(columns)], "column string, low double, high double, n_outliers long"))


@query(f"""WITH q AS (SELECT quantile_cont(pinned, 0.25) AS a, quantile_cont(pinned, 0.75) AS b FROM {PINNED} WHERE pinned <> 0) SELECT 'pinned' AS "column", round(a - 1.5 * (b - a), 6) AS low, round(b + 1.5 * (b - a), 6) AS high, (SELECT count(*) FROM {PINNED} WHERE pinned < a - 1.5 * (b - a) OR pinned > b + 1.5 * (b - a)) AS n_outliers FROM q""")
def iqr_pinned(spark, sf_dir):
    return _fence_rows(_pinned(spark, sf_dir), ["pinned"])


@query("""WITH m AS (SELECT median(value) AS m FROM events), d AS (SELECT median(abs(value - m)) AS d, any_value(m) AS m FROM events, m) SELECT 'value' AS "column", round(m, 6) AS median, round(d, 6) AS mad, (SELECT count(*) FROM events WHERE abs(0.6745 * (value - m) / d) > 3.0) AS n_outliers FROM d""")
def mad_outliers(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    d = outliers.deviations(df, ["value"])["value"]
    n = df.agg(F.count_if(outliers.beyond_deviation(d))).first()[0]
    return rounded(spark.createDataFrame([("value", d.median, d.mad, n)], "column string, median double, mad double, n_outliers long"))


@query(f"""WITH m AS (SELECT median(pinned) AS mp, median(price) AS mr, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM {PINNED}), p AS (SELECT quantile_cont(pinned, 0.25) AS pa, quantile_cont(pinned, 0.75) AS pb FROM {PINNED} WHERE pinned <> 0), d AS (SELECT median(abs(pinned - mp)) AS dp, median(abs(price - mr)) AS dr FROM {PINNED}, m)
SELECT count(*) AS n_rows FROM {PINNED}, m, p, d WHERE pinned < pa - 1.5 * (pb - pa) OR pinned > pb + 1.5 * (pb - pa) OR price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a) OR abs(0.6745 * (pinned - mp) / dp) > 3 OR abs(0.6745 * (price - mr) / dr) > 3""")
def outlier_union(spark, sf_dir):
    out = outliers.analyze_outliers(_pinned(spark, sf_dir), ["pinned", "price"], forest=False)
    return out.flagged.agg(F.count_if("any").alias("n_rows"))


@query()
def isolation_forest(spark, sf_dir):
    out = outliers.analyze_outliers(table(spark, sf_dir, "lineitem").select(*LINE), LINE)
    return spark.createDataFrame([(out.forest_count, out.forest_note)], "n_outliers long, note string")


@query(_pearson_sql("(SELECT nullif(l_linenumber, 3) AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)", list(combinations(["l_linenumber", *LINE], 2))))
def pearson_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.nullif("l_linenumber", F.lit(3)))
    return rounded(relationships.pearson_pairs(df, list(combinations(["l_linenumber", *LINE], 2))))


@query("WITH p AS (" + _pearson_sql("lineitem", [(a, b) for a in LINE for b in LINE]) + ") SELECT var1, var2, r FROM p")
def pearson_matrix(spark, sf_dir):
    return rounded(relationships.correlation_matrix(table(spark, sf_dir, "lineitem"), LINE))


@query("WITH p AS (" + _pearson_sql("(SELECT l_quantity, l_extendedprice, l_quantity * 2 + l_tax AS twice FROM lineitem)", list(combinations(["l_quantity", "l_extendedprice", "twice"], 2))) + ") SELECT var1, var2, r FROM p WHERE abs(r) >= 0.95")
def redundant_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_quantity", "l_extendedprice", "l_quantity * 2 + l_tax AS twice")
    return rounded(relationships.pearson_pairs(df, list(combinations(df.columns, 2)))).where("abs(r) >= 0.95").select("var1", "var2", "r")


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT 'l_quantity' AS var1, 'l_extendedprice' AS var2, count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def spearman_pairs(spark, sf_dir):
    return rounded(relationships.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


FLAGS = "(SELECT nullif(l_returnflag, 'A') AS l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem)"


def _cramers_sql(source: str, pairs: list[tuple[str, str]]) -> str:
    one = lambda a, b: f"""SELECT * FROM (WITH c AS (SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS o FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), f AS (SELECT x.x, y.y, coalesce(o, 0) AS o, rt * ct / t AS e FROM (SELECT x, sum(o) AS rt FROM c GROUP BY 1) x CROSS JOIN (SELECT y, sum(o) AS ct FROM c GROUP BY 1) y CROSS JOIN (SELECT sum(o) AS t FROM c) LEFT JOIN c ON c.x = x.x AND c.y = y.y), s AS (SELECT sum(o) AS n, count(DISTINCT x) AS r, count(DISTINCT y) AS k, sum((o - e) ** 2 / e) AS chi2, sum(greatest(0, abs(o - e) - 0.5) ** 2 / e) AS yates FROM f)
SELECT '{a}' AS var1, '{b}' AS var2, CAST(n AS BIGINT) AS n, r, k, round(chi2, 4) AS chi2, round(CASE WHEN r = 2 AND k = 2 THEN yates ELSE chi2 END, 4) AS chi2_yates, round(CASE WHEN r < 2 OR k < 2 THEN NULL ELSE least(1, sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / least(k - (k - 1) ** 2 / (n - 1) - 1, r - (r - 1) ** 2 / (n - 1) - 1))) END, 4) AS cramers_v FROM s)"""  # noqa: E731
    return " UNION ALL ".join(one(a, b) for a, b in pairs)


FLAG_PAIRS = list(combinations(["l_returnflag", "l_linestatus", "l_linenumber"], 2))


@query(_cramers_sql(FLAGS, FLAG_PAIRS))
def cramers_v_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("nullif(l_returnflag, 'A') AS l_returnflag", "l_linestatus", "CAST(l_linenumber AS STRING) AS l_linenumber")
    return rounded(relationships.cramers_pairs(df, FLAG_PAIRS), 4)


@query(_cramers_sql("(SELECT nullif(l_returnflag, 'A') AS f, l_linestatus AS s FROM lineitem)", [("f", "s")]))
def chi2_yates(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("nullif(l_returnflag, 'A') AS f", "l_linestatus AS s")
    return rounded(relationships.cramers_pairs(df, [("f", "s")]), 4)


def _eta_sql(source: str, pairs: list[tuple[str, str]]) -> str:
    one = lambda c, x: f"""SELECT * FROM (WITH v AS (SELECT {c} AS c, CAST({x} AS DOUBLE) AS x FROM {source} WHERE {c} IS NOT NULL AND {x} IS NOT NULL), m AS (SELECT avg(x) AS m, count(*) AS n, var_pop(x) * count(*) AS t FROM v), g AS (SELECT count(*) AS n, avg(x) AS a FROM v GROUP BY c), e AS (SELECT sum(g.n * (a - m) ** 2) / any_value(t) AS e2, any_value(m.n) AS n, count(*) AS g FROM g, m)
SELECT '{c}' AS category, '{x}' AS number, n, g, round(sqrt(e2), 6) AS eta, round(sqrt(greatest(0, 1 - (1 - e2) * (n - 1) / (n - g))), 6) AS adjusted_eta FROM e)"""  # noqa: E731
    return " UNION ALL ".join(one(c, x) for c, x in pairs)


ETA = [(c, x) for c in ("l_returnflag", "l_linestatus") for x in LINE]


@query(_eta_sql("lineitem", ETA))
def eta_pairs(spark, sf_dir):
    return rounded(relationships.eta_pairs(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], LINE))


@query("SELECT category, number, adjusted_eta FROM (" + _eta_sql("events", [("event_type", "value")]) + ")")
def adjusted_eta(spark, sf_dir):
    return rounded(relationships.eta_pairs(table(spark, sf_dir, "events"), ["event_type"], ["value"])).select("category", "number", "adjusted_eta")


@query(
    "WITH h AS (SELECT a AS var1, b AS var2, v FROM (SELECT var1 AS a, var2 AS b, r AS v FROM (" + _pearson_sql("lineitem", [("l_quantity", "l_extendedprice")]) + ") UNION ALL SELECT var1, var2, cramers_v FROM (" + _cramers_sql("lineitem", [("l_returnflag", "l_linestatus")]) + ") UNION ALL SELECT category, number, adjusted_eta FROM (" + _eta_sql("lineitem", [(c, x) for c in ("l_returnflag", "l_linestatus") for x in ("l_quantity", "l_extendedprice")]) + "))) SELECT var1, var2, round(v, 4) AS value FROM h UNION ALL SELECT var2, var1, round(v, 4) FROM h UNION ALL SELECT c, c, 1.0 FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_returnflag'), ('l_linestatus')) t(c)"
)
def association_matrix(spark, sf_dir):
    m = relationships.association_matrix(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus"])
    return spark.createDataFrame([(a, b, round(v, 4)) for (a, b), v in m.items()], "var1 string, var2 string, value double")


@query("""WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS k FROM lineitem), t AS (SELECT sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity)), s AS (SELECT count(*) AS n, sum(k) AS s FROM r GROUP BY g), q AS (SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS g, sum(s * s / n) AS q FROM s)
SELECT 'l_returnflag' AS "group", 'l_quantity' AS value, CAST(n AS BIGINT) AS n, g AS groups, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)), 4) AS h FROM q, t""")
def kruskal_h(spark, sf_dir):
    return rounded(relationships.kruskal(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity"), 4)


@query("SELECT l_returnflag AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1")
def class_balance(spark, sf_dir):
    return rounded(target.class_balance(table(spark, sf_dir, "lineitem"), "l_returnflag"))


def _kruskal_sql(x: str) -> str:
    return f"""SELECT '{x}' AS feature, 'kruskal_wallis' AS test, h AS statistic, exp(-h / 2) AS p, adjusted_eta AS effect, CAST(n AS BIGINT) AS rows FROM (WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 AS k FROM lineitem), t AS (SELECT sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (SELECT count(*) AS c FROM lineitem GROUP BY {x})), s AS (SELECT count(*) AS n, sum(k) AS s FROM r GROUP BY g), q AS (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(s * s / n) AS q FROM s) SELECT n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h FROM q, t), (SELECT adjusted_eta FROM ({_eta_sql("lineitem", [("l_returnflag", x)])}))"""


#: Three classes, and categories of two values: both tests have two degrees of freedom, where p = exp(-statistic / 2).
@query("SELECT feature, test, round(statistic, 4) AS statistic, round(p, 4) AS p, round(effect, 4) AS effect, rows FROM (" + " UNION ALL ".join(_kruskal_sql(x) for x in ("l_quantity", "l_extendedprice", "l_discount")) + " UNION ALL SELECT var1, 'chi2', chi2_yates, exp(-chi2_yates / 2), cramers_v, n FROM (" + _cramers_sql("lineitem", [("l_linestatus", "l_returnflag")]) + "))")
def target_ranking(spark, sf_dir):
    report = target.analyze_target(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"), "l_returnflag")
    return rounded(spark.createDataFrame([(r.feature, r.test, r.statistic, r.p, r.effect, r.rows) for r in report.relations], "feature string, test string, statistic double, p double, effect double, rows long"), 4)


_LEAKY = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "noisy": "l_quantity * 3 + 12 * l_linenumber", "negative": "1 - l_quantity"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({x}, l_quantity * 3 + l_tax)) > 0.99 AS leaks FROM lineitem" for c, x in _LEAKY.items()))
def leakage_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(*(f"{x} AS {c}" for c, x in _LEAKY.items()), "l_quantity * 3 + l_tax AS y")
    found = target.leaks(df, "y", list(_LEAKY))
    return spark.createDataFrame([(c, any(m.startswith(f"'{c}'") for m in found)) for c in _LEAKY], "feature string, leaks boolean")


@query("WITH c AS (SELECT dense_rank() OVER (ORDER BY l_returnflag) AS a, dense_rank() OVER (ORDER BY lower(l_returnflag)) AS b FROM lineitem) SELECT count(*) FILTER (WHERE a = b) AS rows_on_diagonal, CAST(max(a) AS INT) AS n_x, CAST(max(b) AS INT) AS n_y, count(*) AS n_target FROM c")
def leakage_categorical(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS y", "lower(l_returnflag) AS x")
    return target.same_labels(df, "x", "y")


SKEWED = "(SELECT exp(l_quantity / 6) AS wide, CASE WHEN l_quantity <= 20 THEN 0 ELSE exp(l_extendedprice / 9000) END AS floor FROM lineitem)"


def _skewed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("exp(l_quantity / 6) AS wide", "CASE WHEN l_quantity <= 20 THEN 0D ELSE exp(l_extendedprice / 9000) END AS floor")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", round(central, 6) AS central, round(log, 6) AS central_log, nonpositive, central < 0.3 AND log >= 2 * central AND log > central AND nonpositive * 100.0 / n <= 5 AS needed FROM (SELECT (quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05)) / (max({c}) - min({c})) AS central, count(*) AS n, count(*) FILTER (WHERE {c} <= 0) AS nonpositive, (quantile_cont(log10({c}), 0.95) FILTER (WHERE {c} > 0) - quantile_cont(log10({c}), 0.05) FILTER (WHERE {c} > 0)) / (max(log10({c})) FILTER (WHERE {c} > 0) - min(log10({c})) FILTER (WHERE {c} > 0)) AS log FROM (SELECT {c} FROM {SKEWED}))""" for c in ("wide",)))
def log_scale_check(spark, sf_dir):
    got = shape.log_scale_checks(_skewed(spark, sf_dir), ["wide"])
    return rounded(spark.createDataFrame([(c, x.central, x.central_log, x.nonpositive, x.needed) for c, x in got.items()], "column string, central double, central_log double, nonpositive long, needed boolean"))


@query(f"""SELECT 'floor' AS "column", round(min(floor), 6) AS floor, count(*) FILTER (WHERE floor = m) AS floor_count, round(count(*) FILTER (WHERE floor = m) * 100.0 / count(*), 6) AS floor_pct, count(*) FILTER (WHERE floor > m) AS rest_count, count(DISTINCT floor) FILTER (WHERE floor > m) AS rest_distinct FROM {SKEWED}, (SELECT min(floor) AS m FROM {SKEWED})""")
def floor_split_check(spark, sf_dir):
    got = shape.floor_splits(_skewed(spark, sf_dir), ["floor"])
    return rounded(spark.createDataFrame([(c, x.floor, x.floor_count, x.floor_pct, x.rest_count, x.rest_distinct) for c, x in got.items()], "column string, floor double, floor_count long, floor_pct double, rest_count long, rest_distinct long"))


@query(f"SELECT round(skewness(ln(1 + wide)), 6) AS skew_after, round(skewness(wide), 6) AS skew_before FROM {SKEWED}")
def log1p_skew(spark, sf_dir):
    df = _skewed(spark, sf_dir)
    return rounded(spark.createDataFrame([(shape.skew_of(df, F.log1p("wide")), shape.skew_of(df, F.col("wide")))], "skew_after double, skew_before double"))


_P = [(i - 0.5) / 1000 for i in range(1, 1001)]


@query(f"SELECT unnest(generate_series(1, 1000)) AS i, round(unnest(quantile_cont(value, {_P})), 6) AS quantile, round(unnest(CAST({[normal_quantile(p) for p in _P]} AS DOUBLE[])), 6) AS normal FROM events")
def qq_points(spark, sf_dir):
    theory, seen, *_ = shape.qq_points(table(spark, sf_dir, "events"), F.col("value"))
    return rounded(spark.createDataFrame([(i, float(y), float(x)) for i, (x, y) in enumerate(zip(theory, seen), 1)], "i long, quantile double, normal double"))


@query()
def transforms_plan(spark, sf_dir):
    checks = [shape.check_transform(_skewed(spark, sf_dir), c) for c in ("wide",)]
    return rounded(spark.createDataFrame([(c.column, c.method, c.skew_before, c.skew_after, c.lmbda) for c in checks if c], "column string, method string, skew_before double, skew_after double, lmbda double"), 4)


@query("WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT CAST(least(29, floor((l_extendedprice - lo) / ((hi - lo) / 30))) AS INT) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1) SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n FROM generate_series(0, 29) t(i) LEFT JOIN b ON bin = i")
def histogram_30(spark, sf_dir):
    return charts.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("bin", "n")


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75 FROM events) SELECT 'value' AS \"column\", round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, (SELECT round(min(value), 6) FROM events WHERE value >= q25 - 1.5 * (q75 - q25)) AS low_whisker, (SELECT round(max(value), 6) FROM events WHERE value <= q75 + 1.5 * (q75 - q25)) AS high_whisker FROM q")
def box_stats(spark, sf_dir):
    return rounded(charts.boxes(table(spark, sf_dir, "events"), ["value"]))


@query("WITH c AS (SELECT p_brand AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1) SELECT CASE WHEN r <= 20 THEN v ELSE 'Other' END AS category, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def category_bars(spark, sf_dir):
    return charts.bars(table(spark, sf_dir, "part"), "p_brand")


@query("WITH c AS (SELECT CAST(l_linenumber AS VARCHAR) AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(l_linenumber AS VARCHAR)) AS r FROM lineitem GROUP BY 1) SELECT l_returnflag AS class, CASE WHEN r <= 4 THEN v ELSE 'Other' END AS category, count(*) AS n FROM lineitem JOIN c ON CAST(l_linenumber AS VARCHAR) = v GROUP BY 1, 2")
def target_bars(spark, sf_dir):
    return charts.class_bars(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", top=4)


@query()
def scatter_sample(spark, sf_dir):
    return charts.scatter(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query()
def missing_mask(spark, sf_dir):
    return charts.missing_mask(_holes(spark, sf_dir))


@query("SELECT x.a AS var1, x.b AS var2, round(x.r, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a in LINE for b in LINE) + ") x")
def correlation_moments(spark, sf_dir):
    rows = collinearity._numbers(table(spark, sf_dir, "lineitem"), LINE).dropna()
    _, _, _, c = collinearity.correlation_of(rows)
    return rounded(spark.createDataFrame([(a, b, float(c[i, j])) for i, a in enumerate(LINE) for j, b in enumerate(LINE)], "var1 string, var2 string, r double"))


VIF = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "mix": "l_quantity + 4 * l_linenumber"}


def _determinant(of: list[str]) -> str:
    """The determinant of the correlations of some columns of VIF, written out."""
    at, terms = [list(VIF).index(c) for c in of], []
    for p in permutations(range(len(of))):
        odd = sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) % 2
        terms.append(("-" if odd else "+") + " * ".join("1" if a == b else f"r_{min(at[a], at[b])}_{max(at[a], at[b])}" for a, b in enumerate(p)))
    return "(" + " ".join(terms) + ")"


@query("WITH c AS (SELECT " + ", ".join(f"corr({VIF[a]}, {VIF[b]}) AS r_{list(VIF).index(a)}_{list(VIF).index(b)}" for a, b in combinations(VIF, 2)) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{x}' AS \"column\", round({_determinant([y for y in VIF if y != x])} / {_determinant(list(VIF))}, 6) AS vif FROM c" for x in VIF))
def vif(spark, sf_dir):
    report = collinearity.analyze_collinearity(table(spark, sf_dir, "lineitem").selectExpr(*(f"{x} AS {c}" for c, x in VIF.items())), dict.fromkeys(VIF, "numeric_continuous"))
    return rounded(spark.createDataFrame(list(report.vif.items()), "column string, vif double"))


@query("SELECT 'total = l_quantity + l_linenumber + l_suppkey' AS equation, count(*) FILTER (WHERE abs(total - (a + b + c)) <= 1e-9 * greatest(1, size)) AS n_rows, count(*) AS rows_checked FROM (SELECT l_quantity AS a, l_linenumber AS b, l_suppkey AS c, l_quantity + l_linenumber + l_suppkey AS total, avg(abs(l_quantity + l_linenumber + l_suppkey)) OVER () AS size FROM lineitem)")
def exact_identity_rows(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_quantity", "CAST(l_linenumber AS DOUBLE) AS l_linenumber", "CAST(l_suppkey AS DOUBLE) AS l_suppkey", "l_quantity + l_linenumber + l_suppkey AS total")
    report = collinearity.analyze_collinearity(df, dict.fromkeys(df.columns, "numeric_continuous"))
    return spark.createDataFrame([(c.equation, c.rows, c.rows_checked) for c in report.exact], "equation string, n_rows long, rows_checked long")


@query()
def recommendations(spark, sf_dir):
    from .plans.pipeline import analyze

    report = analyze(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"), charts=False)
    return spark.createDataFrame([(r.step, r.column, r.action, r.evidence) for r in report.recommendations] or [("none", None, "", "")], "step string, column string, action string, evidence string")
