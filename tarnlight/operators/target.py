"""A target column against every feature: balance, tests and effects, and signs of leakage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.columns import col, is_number, is_text, number
from ..functions.distributions import chi2_tail, correlation_p
from .relationships import contingency, cramers_pairs, eta_pairs, kruskal, kruskal_many, kruskal_p, pearson_pairs, spearman

#: Most classes, share of an imbalanced class, correlation of a leak; types without a test.
CLASSES, IMBALANCE, LEAK = 20, 0.8, 0.99
UNTESTED = frozenset({"identifier", "text", "datetime", "time", "constant"})


@dataclass
class Balance:
    counts: dict[str, int]
    shares: dict[str, float]
    imbalanced: bool
    ratio: float


@dataclass
class Relation:
    feature: str
    test: str
    statistic: float | None
    p: float | None
    effect: float | None
    rows: int


@dataclass
class TargetReport:
    target: str
    kind: str
    rows: int
    missing: int
    balance: Balance | None = None
    relations: list[Relation] = field(default_factory=list)
    leakage: list[str] = field(default_factory=list)


def _numeric(df: DataFrame, name: str) -> bool:
    return is_number(df, name) or isinstance(df.schema[name].dataType, BooleanType)


def target_kind(df: DataFrame, target: str) -> str:
    """classification for up to 20 distinct numbers, booleans and text; regression for more numbers; else unknown."""
    n = df.agg(F.count_distinct(col(target))).first()[0]
    if n == 0:
        return "unknown"
    if _numeric(df, target):
        return "classification" if n <= CLASSES else "regression"
    return "classification" if is_text(df, target) else "unknown"


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """value, n, share of each class; nulls don't count."""
    counts = df.select(col(target).cast("string").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def balance_of(rows: list, threshold: float = IMBALANCE) -> Balance | None:
    if not rows:
        return None
    n = {r["value"]: r["n"] for r in rows}
    share = {r["value"]: r["share"] for r in rows}
    return Balance(n, share, max(share.values()) > threshold, max(n.values()) / (min(n.values()) + 1e-10))


def _as_number(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, col(name).cast("int")) if isinstance(df.schema[name].dataType, BooleanType) else df


def relate(df: DataFrame, features: list[str], target: str, numeric_target: bool) -> list[Relation]:
    """For each feature the test that fits the two columns' kinds, in passes over all features of a kind; a feature that can't
    be measured is left out."""
    if numeric_target and not _numeric(df, target):
        return []
    for c in {*features, target}:
        df = _as_number(df, c)
    numbers = [c for c in features if _numeric(df, c)]
    texts = [c for c in features if c not in numbers]
    out = []
    if numeric_target:
        for c in numbers:
            if (r := spearman(df, c, target).first())["rho"] is not None:
                out.append(Relation(c, "spearman", r["rho"], correlation_p(r["rho"], r["n"]), abs(r["rho"]), r["n"]))
        effect = {r["category"]: r["adjusted_eta"] for r in eta_pairs(df, texts, [target]).collect()}
        tests = {c: kruskal(df, c, target).first() for c in texts}
    else:
        classes = df.withColumn("__class", col(target).cast("string"))
        effect = {r["number"]: r["adjusted_eta"] for r in eta_pairs(classes, ["__class"], numbers).collect()} if numbers else {}
        tests = {r["value"]: r for r in kruskal_many(classes, "__class", numbers).collect()}
        for r in cramers_pairs(df, [(c, target) for c in texts]).collect():
            if r["n"] >= 2:
                free = (r["r"] - 1) * (r["k"] - 1)
                out.append(Relation(r["var1"], "chi2", r["chi2_yates"] if free else 0.0, chi2_tail(r["chi2_yates"], free) if free else 1.0, r["cramers_v"], r["n"]))
    out += [Relation(c, "kruskal_wallis", k["h"], kruskal_p(k["h"], k["groups"]), effect.get(c), k["n"]) for c, k in tests.items() if k["h"] is not None]
    return sorted(out, key=lambda r: features.index(r.feature))


def same_labels(df: DataFrame, feature: str, target: str) -> DataFrame:
    """rows_on_diagonal, n_target, categories of both: the diagonal pairs the categories by their sorted places."""
    cells = contingency(df, target, feature)
    places = lambda c: cells.select(c).distinct().withColumn(f"p_{c}", F.row_number().over(Window.orderBy(c)))  # noqa: E731  categories only
    on = cells.join(places("x"), "x").join(places("y"), "y")
    got = on.agg(F.coalesce(F.sum(F.when(F.col("p_x") == F.col("p_y"), F.col("n"))), F.lit(0)).alias("rows_on_diagonal"), F.max("p_x").alias("n_x"), F.max("p_y").alias("n_y"))
    return got.crossJoin(df.agg(F.count(col(target)).alias("n_target")))


def leaks(df: DataFrame, target: str, features: list[str]) -> list[str]:
    """Messages on features that nearly equal the target: |r| above 0.99, or the same rows in every category."""
    out = []
    numeric = [c for c in features if _numeric(df, c)] if _numeric(df, target) else []
    nums = df
    for c in {*numeric, target} if numeric else ():
        nums = _as_number(nums, c)
    strong = {r["var1"]: r["r"] for r in pearson_pairs(nums, [(c, target) for c in numeric]).collect() if r["r"] is not None and abs(r["r"]) > LEAK}
    for c in features:
        if c in strong:
            out.append(f"'{c}' and '{target}' correlate {strong[c]:.3f}: it may be the target in other form")
        elif is_text(df, c) and is_text(df, target):
            r = same_labels(df, c, target).first()
            if r["n_x"] and r["n_x"] == r["n_y"] and r["rows_on_diagonal"] == r["n_target"]:
                out.append(f"'{c}' has the same categories on the same rows as '{target}'")
    return out


def analyze_target(df: DataFrame, target: str, *, kind: str | None = None, types: dict[str, str] | None = None, features: list[str] | None = None, threshold: float = IMBALANCE) -> TargetReport:
    if target not in df.columns:
        raise ValueError(f"no column {target!r}")
    rows, present = df.agg(F.count(F.lit(1)), F.count(col(target))).first()
    kind = kind or target_kind(df, target)
    out = TargetReport(target, kind, rows, rows - present)
    if kind == "classification":
        out.balance = balance_of(class_balance(df, target).collect(), threshold)
    features = [c for c in (features or df.columns) if c != target and (types or {}).get(c) not in UNTESTED]
    out.relations = sorted(relate(df, features, target, kind != "classification"), key=lambda r: (-(r.effect or 0.0), float("inf") if r.p is None else r.p))
    out.leakage = leaks(df, target, features)
    return out
