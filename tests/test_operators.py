import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnlight.functions.quantiles import exact_quantiles, running
from tarnlight.operators import charts, collinearity, forest, outliers, quality, relationships, shape, target, types, univariate


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_numeric_profile_matches_pandas(spark):
    x = pd.Series(np.random.default_rng(0).lognormal(1, 1, 500)).round(3)
    r = univariate.numeric_profile(frame(spark, x=x), ["x"]).first()
    assert r["skewness"] == pytest.approx(x.skew()) and r["kurtosis"] == pytest.approx(x.kurtosis())
    assert r["std"] == pytest.approx(x.std()) and r["q25"] == pytest.approx(x.quantile(0.25)) and r["cv"] == pytest.approx(x.std() / x.mean() * 100)


def test_numeric_profile_edges(spark):
    df = spark.createDataFrame([(1.0, None, 5.0, 0.0), (float("nan"), None, 5.0, -1.0), (None, None, 5.0, 1.0)], "a double, b double, c double, d double")
    r = {x["column"]: x for x in univariate.numeric_profile(df, df.columns).collect()}
    assert (r["a"]["count"], r["a"]["missing"]) == (1, 2)
    assert r["b"]["count"] == 0 and r["b"]["mean"] is None
    assert r["c"]["skewness"] == 0.0 and r["c"]["std"] == 0.0
    assert r["d"]["cv"] == 0.0 and r["d"]["zeros"] == 1 and r["d"]["negatives"] == 1
    assert univariate.numeric_profile(df.limit(0), ["a"]).first()["count"] == 0


@pytest.mark.parametrize("inside", [5, 60])
def test_quantiles_by_narrowing_equal_direct(spark, inside):
    rng = np.random.default_rng(2)
    df = frame(spark, a=rng.normal(size=700), b=np.repeat([1.0, 2.0, 3.0, 9.0], [400, 100, 100, 100]), c=rng.integers(0, 40, 700).astype(float))
    want = {c: [0.0, 0.05, 0.25, 0.5, 0.77, 1.0] for c in "abc"}
    direct, narrowed = exact_quantiles(df, want, direct=True), exact_quantiles(df, want, direct=False, inside=inside, accuracy=50)
    for c in "abc":
        assert narrowed[c] == pytest.approx(direct[c])


def test_running_totals_in_parts_equal_one_window(spark):
    df = frame(spark, x=np.arange(300.0), n=np.arange(300) % 7)
    assert sorted(rows(running(df, "x", "n", direct=False).select("x", "n", "upto"))) == sorted(rows(running(df, "x", "n", direct=True).select("x", "n", "upto")))


def test_mode_is_smallest_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    r = univariate.categorical_profile(df, ["x"]).first()
    assert (r["mode"], r["mode_frequency"], r["nunique"], r["missing"], r["count"]) == ("a", 2, 2, 1, 4)


def test_duplicates_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (2, "x"), (3, "y")], "a int, b string")
    assert rows(quality.duplicate_counts(df)) == [(3, 5, 2)]


def test_row_keys_tell_nulls_and_zeros(spark):
    df = spark.createDataFrame([(None, "a", 0.0), ("a", None, 0.0), ("a", None, -0.0), (None, None, None), (None, None, None)], "a string, b string, c double")
    assert rows(quality.duplicate_counts(df)) == [(2, 4, 2)]


def test_distinct_counts_of_empty_columns(spark):
    df = spark.createDataFrame([("x", None), ("y", None), ("x", None)], "a string, b string")
    assert dict(rows(univariate.distinct_counts(df, ["a", "b"]))) == {"a": 2, "b": 0}
    assert rows(quality.constants(df.limit(0)))[0][1]


def test_constants_count_null_as_value(spark):
    df = spark.createDataFrame([("x", "x", None)] * 199 + [("x", None, None)], "one string, gap string, none string")
    r = {x["column"]: x for x in quality.constants(df).collect()}
    assert r["one"]["constant"] and r["none"]["constant"] and not r["gap"]["constant"] and r["gap"]["quasi_constant"]
    assert r["gap"]["top_share"] == pytest.approx(0.995)


def test_numbers_kept_as_text(spark):
    df = spark.createDataFrame([("1", "nan"), ("2.5", "1d"), (" 3e4 ", "inf"), ("x", "1"), ("-7", "2"), ("8", None)], "a string, b string")
    r = {x["column"]: x for x in quality.numeric_as_text(df).collect()}
    assert r["a"]["numeric_count"] == 5 and r["a"]["numeric_as_text"] and not r["b"]["numeric_as_text"]


def test_fence_none_without_spread(spark):
    x = [0.0] * 77 + [0.1] * 17 + [0.2] * 3 + [0.3] * 3
    df = frame(spark, x=x)
    f, d = outliers.fences(df, ["x"])["x"], outliers.deviations(df, ["x"])["x"]
    assert f.note == "IQR = 0" or f.pinned is not None
    assert d.note == "MAD = 0" and df.where(outliers.beyond_deviation(d)).count() == 0


def test_fence_flags_far_value(spark):
    df = frame(spark, x=[10.0, 11, 12, 13, 14, 15, 16, 500])
    f = outliers.fences(df, ["x"])["x"]
    assert rows(df.where(outliers.beyond_fence(f))) == [(500.0,)] and f.note == ""


def test_pinned_value_is_set_aside(spark):
    rng = np.random.default_rng(0)
    df = frame(spark, x=np.concatenate([np.zeros(650), rng.lognormal(4, 1.3, 350)]))
    f = outliers.fences(df, ["x"])["x"]
    share = df.where(outliers.beyond_fence(f)).count() / 1000
    assert 0 < share < 0.08 and "65.0%" in f.note


def test_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(1)
    data = np.vstack([rng.normal(size=(1000, 3)), np.full((10, 3), 8.0)])
    df = spark.createDataFrame(pd.DataFrame(data, columns=list("abc")))
    out = outliers.analyze_outliers(df, list("abc"))
    assert out.flagged.where("a = 8 AND forest").count() == 10 and out.forest_count < 0.05 * 1010
    assert outliers.analyze_outliers(df.limit(20), list("abc")).forest_count == 0
    assert outliers.analyze_outliers(df, list("abc"), contamination=0.1).forest_count == pytest.approx(101, abs=1)


def test_forest_path_constant():
    assert float(forest.path_constant(256)) == pytest.approx(10.2448, abs=1e-3) and float(forest.path_constant(1)) == 0.0


def test_cramers_v_known(spark):
    cells = [("a", "x", 30), ("a", "y", 20), ("b", "x", 20), ("b", "y", 30)]
    df = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "p string, q string")
    r = relationships.cramers_pairs(df, [("p", "q")]).first()
    assert r["cramers_v"] == pytest.approx(0.1738, abs=1e-4) and r["chi2"] == pytest.approx(4.0) and r["chi2_yates"] == pytest.approx(3.24)


def test_cramers_v_zero_by_chance(spark):
    df = spark.createDataFrame([(c, str(i % 4)) for i, c in enumerate("abcdefgh")], "p string, q string")
    assert relationships.cramers_pairs(df, [("p", "q")]).first()["cramers_v"] == 0.0


def test_yates_with_an_empty_cell(spark):
    df = spark.createDataFrame([("a", "x")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 4, "p string, q string")
    o = np.array([[5, 0], [3, 4]])
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    r = relationships.cramers_pairs(df, [("p", "q")]).first()
    assert r["chi2"] == pytest.approx(((o - e) ** 2 / e).sum()) and r["chi2_yates"] == pytest.approx((np.maximum(0, abs(o - e) - 0.5) ** 2 / e).sum())


def test_eta_edges(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(6)], "c string, x double")
    r = relationships.eta_pairs(df, ["c"], ["x"]).first()
    assert r["adjusted_eta"] == 0.0 and r["eta"] == pytest.approx(1.0)
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "c string, x double")
    assert relationships.eta_pairs(flat, ["c"], ["x"]).first()["eta"] is None


def test_pearson_and_spearman_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 9.0), (None, 5.0, 1.0)], "a double, b double, c double")
    r = {(x["var1"], x["var2"]): x for x in relationships.pearson_pairs(df, [("a", "b"), ("a", "c")]).collect()}
    assert r["a", "b"]["r"] is None and r["a", "c"]["n"] == 3
    assert relationships.spearman(df, "a", "c").first()["rho"] == pytest.approx(1.0)


def test_kruskal_matches_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, x double")
    r = relationships.kruskal(df, "g", "x").first()
    assert r["h"] == pytest.approx(3.857142857) and relationships.kruskal_p(r["h"], 2) == pytest.approx(0.0495, abs=1e-4)


def test_matrix_equals_pairs(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, edad=rng.normal(size=200), gasto=rng.normal(size=200), grupo=rng.choice(list("abc"), 200), activo=rng.choice(["si", "no"], 200))
    m = relationships.association_matrix(df, ["edad", "gasto"], ["grupo", "activo"])
    assert m["edad", "gasto"] == pytest.approx(relationships.pearson_pairs(df, [("edad", "gasto")]).first()["r"], abs=1e-12)
    assert m["grupo", "grupo"] == 1.0 and m["grupo", "edad"] == m["edad", "grupo"]


def test_exact_combination(spark):
    rng = np.random.default_rng(4)
    a, b, c = (rng.integers(0, 100, 400).astype(float) for _ in range(3))
    df = frame(spark, a=a, b=b, c=c, total=a + b + c)
    r = collinearity.analyze_collinearity(df, dict.fromkeys(df.columns, "numeric_continuous"))
    assert [x.equation for x in r.exact] == ["total = a + b + c"] and r.exact[0].rows == 400
    assert math.isinf(r.vif["total"]) and r.drops[0].column == "total"


def test_linear_identity_and_one_hot(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(20, 5, 300).round(1)
    df = frame(spark, celsius=c, fahrenheit=1.8 * c + 32, humidity=rng.random(300))
    r = collinearity.analyze_collinearity(df, dict.fromkeys(df.columns, "numeric_continuous"))
    assert [x.equation for x in r.exact] == ["fahrenheit = 1.8*celsius + 32"]
    k = rng.integers(0, 3, 300)
    df = frame(spark, red=(k == 0).astype(int), green=(k == 1).astype(int), blue=(k == 2).astype(int))
    r = collinearity.analyze_collinearity(df, dict.fromkeys(df.columns, "boolean"))
    assert len(r.exact) == 1 and abs(r.exact[0].intercept) == pytest.approx(1)


def test_target_ranking_and_leak(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 300)
    df = frame(spark, strong=y + rng.normal(0, 0.1, 300), noise=rng.normal(size=300), copy=y * 2.0, y=y, label=np.where(y == 1, "p", "q"), same=np.where(y == 1, "P", "Q"))
    r = target.analyze_target(df, "y", types={"label": "categorical"})
    assert r.kind == "classification" and r.relations[-1].feature == "noise" and r.leakage
    assert target.leaks(df, "label", ["same"]) and not target.leaks(df, "label", ["noise"])


def test_types_of_golden_columns(spark):
    n = 210
    df = frame(
        spark,
        age=np.random.default_rng(0).normal(40, 15, n), children=np.arange(n) % 5, gender=np.array(["M", "F", "Otro"])[np.arange(n) % 3], premium=np.arange(n) % 2 == 0, flag=np.array(["yes", "no"])[np.arange(n) % 2],
        comment=[f"Comment number {i} is long" for i in range(n)], code=[f"USR{i:06d}" for i in range(n)], constant=["X"] * n, user_id=np.arange(n)[::-1] * 7, day=[f"{1 + i % 28:02d}/03/07" for i in range(n)], clock=[f"{i % 24}:15:00" for i in range(n)], over=[f"{25 + i % 30}:30" for i in range(n)],
    )
    got = types.infer_types(df)
    want = {"age": "numeric_continuous", "children": "numeric_discrete", "gender": "categorical", "premium": "boolean", "flag": "boolean", "comment": "text", "code": "identifier", "constant": "constant", "user_id": "identifier", "day": "datetime", "clock": "time", "over": "categorical"}
    assert got == want


def test_day_first_and_two_digit_years(spark):
    df = spark.createDataFrame([("05/03/07",), ("06/03/07",), ("07/03/69",)], "d string")
    got = [str(r[0])[:10] for r in types.to_moment(df, "d").collect()]
    assert got == ["2007-03-05", "2007-03-06", "1969-03-07"]
    us = spark.createDataFrame([(f"11/{d}/{y:02d}",) for y in (7, 8, 9) for d in range(9, 29)], "d string")
    assert {str(r[0])[:10] for r in types.to_moment(us, "d").agg(F.min("d"), F.max("d")).select(F.explode(F.array("min(d)", "max(d)"))).collect()} == {"2007-11-09", "2009-11-28"}


def test_time_of_day(spark):
    df = spark.createDataFrame([("09:15:00",), ("18:30:10",), ("18:45:00",), ("21:05:59",), (None,)], "t string")
    r = univariate.time_profile(df, "t")
    assert (r["count"], r["missing"], r["peak_hour"], r["earliest"], r["latest"]) == (4, 1, 18, "09:15:00", "21:05:59")


def test_periods_and_gaps(spark):
    df = spark.createDataFrame([("2023-01-01",), ("2023-01-01",), ("2023-01-03",), ("2023-01-17",)], "d string").select(F.col("d").cast("timestamp_ntz").alias("d"))
    p = rows(charts.rows_per_period(df, "d"))
    assert len(p) == 17 and sum(n for _, n in p) == 4
    assert rows(univariate.datetime_gaps(df, "d")) == [("2023-01-03", "2023-01-17")]
    daily = spark.range(10).select(F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("d"))
    assert univariate.datetime_frequency(daily, "d") == "D" and univariate.datetime_frequency(df, "d") is None


def test_transform_is_found(spark):
    x = np.random.default_rng(7).lognormal(2, 1, 800)
    t = shape.check_transform(frame(spark, x=x), "x")
    assert t.method == "log1p" or t.method == "yeo_johnson"
    assert abs(t.skew_after) < 0.5 and shape.check_transform(frame(spark, x=np.random.default_rng(0).normal(size=300)), "x") is None


def test_yeo_johnson_maximises_likelihood(spark):
    x = np.random.default_rng(8).gamma(2.0, 2.0, 400)
    lam = shape.yeo_johnson_lambda(frame(spark, x=x), F.col("x"))

    def like(l):
        return -len(x) / 2 * np.log(np.var(shape.yeo_johnson_values(x, l))) + (l - 1) * np.log1p(x).sum()

    assert like(lam) >= max(like(lam - 0.01), like(lam + 0.01))


def test_log_scale_and_floor(spark):
    rng = np.random.default_rng(9)
    df = frame(spark, wide=rng.lognormal(3, 2, 500), even=rng.random(500), floor=np.where(rng.random(500) < 0.5, 0.0, rng.lognormal(3, 2, 500)))
    s = shape.log_scale_checks(df, ["wide", "even"])
    assert s["wide"].needed and not s["even"].needed
    assert shape.floor_splits(df, ["floor"])["floor"].needed and shape.log_scale_checks(df.limit(5), ["wide"])["wide"] is None


def test_chart_tables(spark):
    df = spark.createDataFrame([(str(i % 25), float(i), None if i % 10 else 1) for i in range(100)], "c string, x double, m int")
    assert sum(r["n"] for r in charts.histogram(df, "x").collect()) == 100
    assert {r["category"] for r in charts.bars(df, "c", 3).collect()} == {"0", "1", "10", "Other"}
    assert charts.scatter(df, "x", "x", 10).count() == 10 and charts.missing_mask(df, 50).count() == 50 and charts.missing_mask(df.select("c"), 50).count() == 0
    assert charts.choose_columns(list("abcd"), 2, "d", {"a": 0.1, "b": 0.9})[0] == ["b", "d"]


def test_collinearity_of_several_relations(spark):
    rng = np.random.default_rng(8)
    n = 400
    a, b, c, d = (rng.normal(i, 1 + i, n).round(2) for i in range(4))
    df = frame(spark, a=a, b=b, sum=a + b, c=c, twice=2 * c + 1, d=d, far=3 * (a + b) - d, near=d + rng.normal(0, 0.2, n))
    r = collinearity.analyze_collinearity(df, dict.fromkeys(df.columns, "numeric_continuous"))
    assert len(r.exact) == 3 and all(x.rows == x.rows_checked == n for x in r.exact)
    written = [x.column for x in r.exact]
    assert all(t not in written for x in r.exact for t, _ in x.terms)  # by independent columns only
    assert "twice = 2*c + 1" in [x.equation for x in r.exact]
    # VIF and drops by their definition, on the independent columns
    left = [x for x in df.columns if x not in written]
    m = df.toPandas()

    def vif(columns):
        return dict(zip(columns, np.diag(np.linalg.inv(np.corrcoef(m[columns].T)))))

    exact_parts = {t for x in r.exact for t in [x.column, *(t for t, _ in x.terms)]}
    for k, v in vif(left).items():
        assert r.vif[k] == (math.inf if k in exact_parts else pytest.approx(v))
    dropped = []
    while len(left) > 1 and max(vif(left).values()) >= 10:
        worst = max(left, key=lambda k: (vif(left)[k], left.index(k)))
        dropped.append((worst, pytest.approx(vif(left)[worst])))
        left.remove(worst)
    assert [(x.column, x.vif) for x in r.drops[3:]] == dropped and dropped
    assert r.vif_after == {k: pytest.approx(v) for k, v in vif(left).items()}


def test_transform_outcomes():
    t = shape.Transform("x", 100, 3.0, 0.9, log1p_skew=0.4, log1p_qq=0.9049, yeo_johnson_skew=0.1, yeo_johnson_qq=0.99)
    assert shape.outcome(t, "log1p") is shape.Outcome.CROOKED and shape.outcome(t, "yeo_johnson") is shape.Outcome.WORKS
    t.log1p_skew, t.yeo_johnson_skew = None, 0.5
    assert shape.outcome(t, "log1p") is shape.Outcome.IMPOSSIBLE and shape.outcome(t, "yeo_johnson") is shape.Outcome.SKEWED
    assert "can't" in shape.verdict_text(t, "log1p") and "0.50" in shape.verdict_text(t, "yeo_johnson")


def test_top_share_below_a_majority(spark):
    df = frame(spark, a=["x"] * 5 + ["y"] * 3 + ["z"] * 4, b=[None] * 6 + ["p"] * 2 + ["q"] * 4, c=list(map(str, range(12))))
    got = {r["column"]: r for r in quality.constants(df, threshold=0.4).collect()}
    assert got["a"]["top_share"] == pytest.approx(5 / 12) and got["a"]["quasi_constant"]
    assert got["b"]["top_share"] == pytest.approx(4 / 12) and not got["b"]["quasi_constant"] and got["c"]["top_share"] == pytest.approx(1 / 12)
    assert quality.constants(df.limit(0)).where("top_share IS NULL").count() == 3


def test_counters_with_a_row_order(spark):
    df = spark.range(2000).selectExpr("id AS row", "id * 1 + 5 AS counter", "pmod(id * 7919, 2003) AS mixed", "CASE WHEN id % 15 = 0 THEN id + 9 ELSE id END AS mostly", "CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS gaps").repartition(7)
    assert types._counters(df, ["counter", "mixed", "gaps"], "row") == {"counter", "gaps"}  # steps from or to a null are none
    assert types._counters(df.limit(0), ["counter"], "row") == set()
    assert "mostly" not in types._counters(df, ["mostly"], "row")


def test_pearson_with_nulls_constants_and_large_offsets(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e9, 1, 400)
    p = pd.DataFrame({"x": x, "y": x * 2 + rng.normal(0, 1, 400), "flat": np.full(400, 0.1), "holes": np.where(rng.random(400) < 0.3, np.nan, rng.normal(size=400) + x), "few": [1.0, 2.0] + [np.nan] * 398})
    pairs = [(a, b) for i, a in enumerate(p.columns) for b in p.columns[i + 1 :]]
    for r in relationships.pearson_pairs(spark.createDataFrame(p), pairs).collect():
        both = p[[r["var1"], r["var2"]]].dropna()
        want = both.corr().iloc[0, 1] if len(both) >= 3 and "flat" not in (r["var1"], r["var2"]) else None
        assert r["n"] == len(both) and (r["r"] is None if want is None else r["r"] == pytest.approx(want, abs=1e-6))


@pytest.mark.parametrize("freq", ["D", "2D", "h", "W-WED", "3W-MON", "B", "MS", "ME", "2MS", "QS-OCT", "QE-DEC", "QS-NOV", "2QS-DEC", "YS-JAN", "YE-DEC", "YS-MAR", "2YS-JUL"])
def test_frequency_names_equal_pandas(spark, freq):
    days = pd.date_range("2019-01-03", periods=24, freq=freq)
    assert univariate.datetime_frequency(frame(spark, d=days), "d") == pd.infer_freq(days)


def test_irregular_days_have_no_frequency(spark):
    days = pd.bdate_range("2019-01-03", periods=30)
    assert univariate.datetime_frequency(frame(spark, d=days.delete(7)), "d") is None
    assert univariate.datetime_frequency(frame(spark, d=days + pd.Timedelta(hours=1)), "d") != "B"


def test_kruskal_of_many_columns_equals_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    g = rng.choice(["a", "b", "c"], 300)
    df = frame(spark, g=g, x=rng.integers(0, 9, 300).astype(float), y=rng.normal(size=300), z=np.where(rng.random(300) < 0.5, np.nan, 1.5), e=np.full(300, np.nan))
    one = {c: relationships.kruskal(df, "g", c).first() for c in "xyz"}
    for limit in (32 << 20, 0):
        monkeypatch.setattr(relationships, "small", lambda d, n=limit: n > 0)
        many = {r["value"]: r for r in relationships.kruskal_many(df, "g", ["x", "y", "z"]).collect()}
        assert many.keys() == one.keys()
        for c in one:
            assert (many[c]["n"], many[c]["groups"]) == (one[c]["n"], one[c]["groups"]) and many[c]["h"] == (None if one[c]["h"] is None else pytest.approx(one[c]["h"]))
    assert relationships.kruskal_many(df, "g", []).count() == 0
