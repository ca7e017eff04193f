"""The whole analysis of a table, step by step, each step kept apart from the failure of another."""

from __future__ import annotations

import dataclasses
import difflib
import json
import logging
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.quantiles import small, spread
from ..operators import charts as chart_data
from ..operators import collinearity, outliers, quality, relationships, shape, target, univariate
from ..operators.types import apply_overrides, infer_types
from ..sources import batch, load
from ..sources.placeholders import replace_placeholders
from .config import Config
from .recommendations import Recommendation, build

log = logging.getLogger(__name__)
KEPT_BYTES = 1 << 30


@dataclass
class Analysis:
    rows: int = 0
    types: dict[str, str] = field(default_factory=dict)
    placeholders: dict[str, dict[str, int]] = field(default_factory=dict)
    lost: dict[str, int] = field(default_factory=dict)
    unknown: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    chart_notes: dict[str, str] = field(default_factory=dict)  # charts that don't show every column, and which they do
    quality: quality.QualityReport = field(default_factory=quality.QualityReport)
    numeric: dict[str, dict] = field(default_factory=dict)
    categorical: dict[str, dict] = field(default_factory=dict)
    frequencies: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    datetime: dict[str, dict] = field(default_factory=dict)
    time: dict[str, dict] = field(default_factory=dict)
    text: dict[str, dict] = field(default_factory=dict)
    numeric_pairs: list[dict] = field(default_factory=list)
    categorical_pairs: list[dict] = field(default_factory=list)
    mixed_pairs: list[dict] = field(default_factory=list)
    correlations: dict[tuple[str, str], float] = field(default_factory=dict)
    associations: dict[tuple[str, str], float] = field(default_factory=dict)
    collinearity: collinearity.CollinearityReport | None = None
    outliers: outliers.OutlierReport | None = None
    target: target.TargetReport | None = None
    log_scale: dict[str, shape.LogScale | None] = field(default_factory=dict)
    floor_split: dict[str, shape.FloorSplit | None] = field(default_factory=dict)
    transforms: shape.TransformReport | None = None
    pair_plot: chart_data.PairPlot | None = None
    charts: dict[str, Any] = field(default_factory=dict)
    recommendations: list[Recommendation] = field(default_factory=list)
    preview: list[dict] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)

    def of(self, *kinds: str) -> list[str]:
        return [c for c, t in self.types.items() if t in kinds]

    @property
    def numbers(self) -> list[str]:
        return self.of("numeric_continuous", "numeric_discrete")

    @property
    def categories(self) -> list[str]:
        """Few-valued numbers are categories as well."""
        return self.of("categorical", "boolean", "numeric_discrete")


def _describe(df: DataFrame, a: Analysis) -> None:
    if a.numbers:
        p = univariate.normality(df, a.numbers)
        a.numeric = {r["column"]: r.asDict() | {"normality_p": p.get(r["column"])} for r in univariate.numeric_profile(df, a.numbers).collect()}
    cats = a.of("categorical", "boolean")
    if cats:
        a.categorical = {r["column"]: r.asDict() for r in univariate.categorical_profile(df, cats).collect()}
        for r in univariate.frequency_table(df, cats).orderBy("column", "rank").collect():
            a.frequencies.setdefault(r["column"], []).append((r["value"], r["n"]))
    if dates := a.of("datetime"):
        for c in dates:
            # text that holds dates is read in its own format
            from ..operators.types import to_moment

            m = to_moment(df.select(col(c)), c)
            a.datetime[c] = univariate.datetime_profile(m, [c]).first().asDict() | {"gaps": [tuple(r) for r in univariate.datetime_gaps(m, c).collect()], "frequency": univariate.datetime_frequency(m, c)}
    a.time = {c: univariate.time_profile(df, c) for c in a.of("time")}
    if words := a.of("text", "identifier"):
        a.text = {r["column"]: r.asDict() for r in univariate.text_profile(df, words).collect()}


def _relate(df: DataFrame, a: Analysis, c: Config) -> None:
    floor = c.visualizations.correlation_threshold
    rows = relationships.pearson_pairs(df, [(x, y) for i, x in enumerate(a.numbers) for y in a.numbers[i + 1 :]]).collect()
    a.correlations = {k: r["r"] for r in rows for k in ((r["var1"], r["var2"]), (r["var2"], r["var1"]))}
    a.numeric_pairs = sorted((r for r in relationships.with_p(rows) if r["r"] is not None and abs(r["r"]) > floor), key=lambda r: -abs(r["r"]))
    cats = a.categories
    rows = relationships.cramers_pairs(df, [(x, y) for i, x in enumerate(cats) for y in cats[i + 1 :]]).collect()
    a.categorical_pairs = sorted((r.asDict() for r in rows if r["cramers_v"] is not None and r["cramers_v"] > floor), key=lambda r: -r["cramers_v"])
    rows = relationships.eta_pairs(df, cats, a.numbers).collect()
    a.mixed_pairs = sorted((r.asDict() for r in rows if r["adjusted_eta"] is not None and r["adjusted_eta"] > floor), key=lambda r: -r["adjusted_eta"])
    a.associations = relationships.association_matrix(df, a.numbers, cats)


def _alerts(a: Analysis, c: Config, batch_run: bool, columns: list[str]) -> None:
    extra = [quality.Alert("low", k, f"'{k}' has {sum(n.values())} cells that stand for a gap ({', '.join(n)})", "They were taken as missing") for k, n in a.placeholders.items()]
    extra += [quality.Alert("medium", k, f"{n} values of '{k}' don't fit the type asked for", "They were taken as missing") for k, n in a.lost.items()]
    if t := a.target:
        if t.balance and t.balance.imbalanced:
            extra.append(quality.Alert("high", t.target, f"the largest class of '{t.target}' has {max(t.balance.shares.values()) * 100:.1f}% of the rows", "Weigh the classes, or sample them evenly"))
        extra += [quality.Alert("high", t.target, m, "Leave the feature out unless it is known before the target") for m in t.leakage]
    elif c.target.target_column and c.target.target_column not in columns and batch_run:
        extra.append(quality.Alert("medium", None, f"there is no column '{c.target.target_column}' here", "The target was not analysed"))
    a.quality.alerts = quality.sort_alerts(a.quality.alerts + extra)


def _charts(df: DataFrame, a: Analysis, c: Config) -> None:
    """Rows of every chart's numbers; a failing chart leaves the others."""
    v, t = c.visualizations, a.target.target if a.target else None
    effects = {r.feature: r.effect or 0.0 for r in a.target.relations} if a.target else None
    cont = a.of("numeric_continuous")
    logs = {x for x, s in a.log_scale.items() if s and s.needed}
    classes = chart_data.class_order(list(a.target.balance.counts)) if a.target and a.target.balance else []

    def draw(name: str, make: Callable[[], Any]) -> None:
        try:
            if (got := make()) not in (None, [], {}):
                a.charts[name] = got
        except Exception:
            log.exception("chart %s failed", name)

    for name, names, most in (("histograms", cont, v.max_histograms), ("boxplots", a.numbers, v.max_boxplots), ("correlation_heatmap", a.numbers, v.max_correlation_heatmap_size)):
        if note := chart_data.choose_columns(names, most, t, effects)[1]:
            a.chart_notes[name] = note
    draw("correlations", lambda: {(x, y): 1.0 if x == y else a.correlations.get((x, y)) for some in [chart_data.choose_columns(a.numbers, v.max_correlation_heatmap_size, t, effects)[0]] if len(some) > 1 for x in some for y in some})
    draw("associations", lambda: a.associations)
    for x in chart_data.choose_columns(cont, v.max_histograms, t, effects)[0]:
        draw(f"histogram_{x}", lambda x=x: [tuple(r) for r in chart_data.histogram(df, x).orderBy("bin").collect()])
        if (s := a.log_scale.get(x)) and s.needed:
            draw(f"histogram_log_{x}", lambda x=x: [tuple(r) for r in chart_data.histogram(df, x, x=F.when(col(x) > 0, F.log10(col(x).cast("double")))).orderBy("bin").collect()])
        elif (s := a.floor_split.get(x)) and s.needed:
            draw(f"histogram_rest_{x}", lambda x=x, s=s: [tuple(r) for r in chart_data.histogram(df, x, x=F.when(col(x) > s.floor, col(x).cast("double"))).orderBy("bin").collect()])
    if some := chart_data.choose_columns(a.numbers, v.max_boxplots, t, effects)[0]:
        logged, split = ([x for x in some if (got := checks.get(x)) and got.needed] for checks in (a.log_scale, a.floor_split))
        split = [x for x in split if x not in logged]
        draw("boxes", lambda: [tuple(r) for r in chart_data.boxes(df, some).collect()])
        draw("boxes_log", lambda: [tuple(r) for r in chart_data.boxes(df.select(*(F.when(col(x) > 0, F.log10(col(x).cast("double"))).alias(x) for x in logged)), logged).collect()] if logged else None)
        draw("boxes_rest", lambda: [tuple(r) for r in chart_data.boxes(df.select(*(F.when(col(x) > a.floor_split[x].floor, col(x).cast("double")).alias(x) for x in split)), split).collect()] if split else None)
    for x in a.of("categorical", "boolean"):
        draw(f"bars_{x}", lambda x=x: [tuple(r) for r in chart_data.bars(df, x).orderBy(F.desc("n")).collect()])
        if chart_data.PIE_LEAST <= (a.categorical.get(x) or {}).get("nunique", 0) <= chart_data.PIE_MOST:
            draw(f"shares_{x}", lambda x=x: [tuple(r) for r in chart_data.shares(df, x).orderBy(F.desc("n")).collect()])
        if t and a.target.kind == "classification" and x != t and len(a.target.balance.counts if a.target.balance else {}) <= chart_data.BAR_CLASSES:
            draw(f"class_bars_{x}", lambda x=x: sorted((tuple(r) for r in chart_data.class_bars(df, x, t).collect()), key=lambda r: (classes.index(r[0]), r[1] == "Other", r[1])))
    if t and a.target.kind in ("classification", "regression"):
        draw(f"target_{t}", lambda: [tuple(r) for r in chart_data.target_distribution(df, t, a.target.kind).collect()])
        for x in chart_data.choose_columns([x for x in cont if x != t], v.max_boxplots, t, effects)[0] if a.target.kind == "classification" else ():
            draw(f"class_boxes_{x}", lambda x=x: sorted((tuple(r) for r in chart_data.class_boxes(df, x, t).collect()), key=lambda r: classes.index(r[0])))
    draw("missing", lambda: [[bool(x) for x in r] for r in chart_data.missing_mask(df).collect()])
    best = [p for p in a.numeric_pairs if p["var1"] in cont and p["var2"] in cont][: v.max_scatter_pairs]
    for p in best:
        draw(f"scatter_{p['var1']}_{p['var2']}", lambda p=p: {"points": [tuple(r) for r in chart_data.scatter(df, p["var1"], p["var2"]).collect()], "log": (p["var1"] in logs, p["var2"] in logs)})
    for x in a.of("datetime")[: chart_data.CALENDARS]:
        from ..operators.types import to_moment

        draw(f"periods_{x}", lambda x=x: [(str(r[0]), r[1]) for rows in chart_data.frame_of_period(to_moment(df.select(col(x)), x), [x]).values() for r in rows.orderBy("period").collect()])
    for x in a.of("time"):
        draw(f"hours_{x}", lambda x=x: sorted(a.time[x]["hour_counts"].items()))
    for x, s in (a.transforms.columns if a.transforms else {}).items():
        if s.method:
            y = F.log1p(col(x).cast("double")) if s.method == "log1p" else shape.yeo_johnson(col(x).cast("double"), s.lmbda)
            draw(f"qq_{x}", lambda x=x, y=y: {when: [(float(p), float(q)) for p, q in zip(*shape.qq_points(df, v)[:2])] for when, v in (("before", col(x).cast("double")), ("after", y))})
    if a.pair_plot:
        shown = [*a.pair_plot.columns, *([a.pair_plot.hue] if a.pair_plot.hue else [])]
        draw("pair_plot", lambda: {"columns": a.pair_plot.columns, "log": [], "rows": [tuple(r) for r in chart_data.sample(df.select(*(col(x) for x in shown)).dropna(), a.pair_plot.rows).collect()]})
        if a.pair_plot.log and "pair_plot" in a.charts:
            draw("pair_plot_log", lambda: a.charts["pair_plot"] | {"log": a.pair_plot.log})


def _plan(a: Analysis, t: str | None) -> list[Recommendation]:
    modes = {c: (r["mode"], r["mode_frequency"] / r["count"] * 100) for c, r in a.categorical.items() if r["count"]}
    rare = {c: sum(1 for _, n in a.frequencies.get(c, []) if n / r["count"] * 100 < 1) for c, r in a.categorical.items() if r["count"]}
    cats = {c: (r["nunique"], r["count"], rare.get(c, 0)) for c, r in a.categorical.items()}
    present = {c: round(a.rows * (1 - (p or 0) / 100)) for c, p in a.quality.missing_per_column.items()}
    logs = {c for c, s in a.log_scale.items() if s and s.needed}
    return build(a.types, a.quality, numeric=a.numeric, correlations=a.correlations, modes=modes, categories=cats, present=present, log=logs, transform_report=a.transforms, target=t)


def analyze(df: DataFrame, config: Config | None = None, *, charts: bool = True, batch_run: bool = False, order: str | None = None) -> Analysis:
    """Every step over one table. A step that fails is named in `failed` and leaves its part empty; strict mode raises.

    Each step acts inside its own guard, as a lazy table would fail in a later one.
    """
    c = config or Config()
    a = Analysis()
    df, a.placeholders = replace_placeholders(df)
    a.types = infer_types(df, order=order, codes=c.data_quality.cardinality_threshold)
    df, a.types, a.lost, a.unknown = apply_overrides(df, a.types, c.column_types.wanted())
    a.ignored = [x for x, kind in c.column_types.wanted().items() if kind == "ignore" and x not in a.unknown]
    df = df.drop(order) if order else df
    wanted = c.target.target_column
    if wanted and wanted not in df.columns and not batch_run:
        near = difflib.get_close_matches(wanted, df.columns)
        raise ValueError(f"no column {wanted!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    t = wanted if wanted in df.columns else None
    df = spread(df)
    kept = small(df, KEPT_BYTES)  # a larger table is read again from its files, not held
    if kept:
        df.persist()
    try:
        a.rows = df.count()

        def step(name: str, run: Callable[[], None]) -> None:
            try:
                run()
            except Exception:
                if c.strict_mode:
                    raise
                log.exception("step %s failed", name)
                a.failed.append(name)

        q, o = c.data_quality, c.outliers
        step("data_quality", lambda: setattr(a, "quality", quality.analyze_quality(df, a.types, missing_threshold=q.missing_threshold, cardinality_threshold=q.cardinality_threshold, constant_threshold=q.constant_threshold, duplicate_threshold=q.duplicate_threshold)))
        step("univariate", lambda: _describe(df, a))
        step("relationships", lambda: _relate(df, a, c))
        step("multicollinearity", lambda: setattr(a, "collinearity", collinearity.analyze_collinearity(df, a.types, t)))
        step("outliers", lambda: setattr(a, "outliers", outliers.analyze_outliers(df, a.numbers, multiplier=o.iqr_multiplier, z=o.z_score_threshold, forest=o.isolation_forest_enabled, contamination=o.isolation_forest_contamination)))
        if t:
            step("target", lambda: setattr(a, "target", target.analyze_target(df, t, kind=c.target.target_type, types=a.types, threshold=c.target.class_imbalance_threshold)))
        _alerts(a, c, batch_run, df.columns)
        cont = a.of("numeric_continuous")
        step("log_scale", lambda: setattr(a, "log_scale", shape.log_scale_checks(df, cont)))
        step("floor_split", lambda: setattr(a, "floor_split", shape.floor_splits(df, cont)))
        step("transforms", lambda: setattr(a, "transforms", shape.analyze_transforms(df, a.types, t, a.target.kind if a.target else None)))
        if charts:
            step("pair_plot", lambda: setattr(a, "pair_plot", chart_data.choose_pair_plot(df, a.types, a.categories, t, a.target.kind if a.target else None, {k: bool(s and s.needed) for k, s in a.log_scale.items()})))
        step("recommendations", lambda: setattr(a, "recommendations", _plan(a, t)))
        if charts:
            step("visualizations", lambda: _charts(df, a, c))
        a.preview = [{k: None if v is None else str(v)[:200] for k, v in r.asDict().items()} for r in df.limit(10).collect()]
    finally:
        if kept:
            df.unpersist()
    return a


def _plain(x: Any) -> Any:
    """Something that JSON can hold."""
    if dataclasses.is_dataclass(x):
        return {f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x) if not isinstance(getattr(x, f.name), DataFrame) and f.name not in ("forest", "flagged")}
    if isinstance(x, dict):
        return {" / ".join(map(str, k)) if isinstance(k, tuple) else str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    if isinstance(x, float):
        return x if math.isfinite(x) else str(x)
    return x if x is None or isinstance(x, (str, int, bool)) else str(x)


def summary(a: Analysis, name: str, run_id: str) -> dict:
    """What summary.json holds. Its keys are a fixed format that other programs read."""
    q, o, m, t = a.quality, a.outliers, a.collinearity, a.target
    relations = None
    if m:
        relations = {"columns": m.columns, "rows_used": m.rows_used, "note": m.note, "chance_r_squared": m.chance_r_squared, "vif": m.vif, "explained_by": m.partners, "vif_after": m.vif_after}
        relations["exact"] = [{"equation": c.equation, "rows": c.rows, "rows_checked": c.rows_checked} for c in m.exact]
        relations["drops"] = [dataclasses.asdict(d) for d in m.drops]
    marked = lambda checks: {c: dataclasses.asdict(x) for c, x in checks.items() if x and x.needed}
    out = {
        "dataset_name": name,
        "correlation_id": run_id,
        "timestamp": datetime.now().isoformat(),
        "shape": [a.rows, len(q.missing_per_column) or len(a.types)],
        "column_types": a.types,
        "column_overrides": {"ignored_columns": a.ignored, "coercion_failures": a.lost, "unknown_columns": a.unknown},
        "data_quality": {
            **{k: getattr(q, k) for k in ("missing_per_column", "duplicates", "constant_columns", "quasi_constant_columns", "high_cardinality_columns", "mixed_type_columns")},
            "duplicate_rows_count": q.duplicate_members,
            "missing_placeholders": a.placeholders,
        },
        "alerts": [dataclasses.asdict(x) for x in q.alerts],
        "univariate": {f"{kind}_columns": len(getattr(a, kind)) for kind in ("numeric", "categorical", "datetime", "time", "text")},
        "relationships": {**{f"{kind}_pairs_count": len(getattr(a, f"{kind}_pairs")) for kind in ("numeric", "categorical", "mixed")}, "multicollinearity_vif": m.vif if m else {}},
        "multicollinearity": relations,
        "outliers": {"total_outlier_rows": o.union_count if o else 0, "isolation_forest": {"outlier_rows": o.forest_count if o else 0, "note": o.forest_note if o else None}},
        "pair_plot": dataclasses.asdict(a.pair_plot) if a.pair_plot else None,
        "log_scale_columns": marked(a.log_scale),
        "floor_split_columns": marked(a.floor_split),
        "transforms": {"columns": {c: dataclasses.asdict(x) for c, x in a.transforms.columns.items()}, "target": a.transforms.target and dataclasses.asdict(a.transforms.target)} if a.transforms else None,
        "chart_columns": a.chart_notes,
        "recommendations": [dataclasses.asdict(r) for r in a.recommendations],
        "failed_steps": a.failed,
    }
    if t:
        balance = t.balance and {"counts": t.balance.counts, "is_imbalanced": t.balance.imbalanced, "imbalance_ratio": t.balance.ratio}
        out["target"] = {"target_column": t.target, "target_type": t.kind, "n_missing": t.missing, "class_balance": balance, "leakage_alerts": t.leakage}
    return _plain(out)


class Pipeline:
    """Analyses files: tables, summary and page for each under the output folder."""

    def __init__(self, config: Config, spark: SparkSession | None = None):
        self.config, self.spark = config, spark
        self.run_id = uuid.uuid4().hex[:8]

    def setup(self) -> Pipeline:
        self.config.validate()
        form, level = f"%(asctime)s {self.run_id} %(levelname)s %(message)s", logging.DEBUG if self.config.verbose else logging.INFO
        logging.basicConfig(level=level, format=form)
        folder = Path(self.config.output_dir)
        folder.mkdir(parents=True, exist_ok=True)
        to_file = logging.FileHandler(folder / f"run_{self.run_id}.log", encoding="utf-8")
        to_file.setFormatter(logging.Formatter(form))
        ours = logging.getLogger("tarnlight")
        ours.setLevel(level)
        ours.addHandler(to_file)
        self.spark = self.spark or SparkSession.builder.appName("tarnlight").getOrCreate()
        return self

    def _load(self, path: Path) -> DataFrame:
        c = self.config
        kind = (c.file_format or load.detect.file_format(path)).replace("xlsx", "excel")
        if not path.exists():
            raise FileNotFoundError(path)
        if kind == "csv":
            df = load.load_csv(self.spark, path, sep=c.delimiter, charset=c.encoding, decimal=c.decimal)
        elif kind == "excel":
            sheet = c.excel_sheet
            df = load.load_excel(self.spark, path, int(sheet) if sheet is not None and str(sheet).isdigit() else sheet)
        else:
            df = {"parquet": load.load_parquet, "json": load.load_json}[kind](self.spark, path)
        df = load.normalise(df)
        return chart_data.sample(df, c.sample_size) if c.sample_size else df

    def one(self, path: Path, name: str, folder: Path, batch_run: bool = False) -> dict:
        from .report import chart, drawings, file_name, page
        from .tables import write_tables

        began = time.time()
        a = analyze(self._load(path), self.config, batch_run=batch_run)
        folder.mkdir(parents=True, exist_ok=True)
        html, tables = folder / "report.html", []
        drawn: set[str] = set()

        def draw() -> None:
            (folder / "charts").mkdir(exist_ok=True)
            for label, data in a.charts.items():
                for svg in drawings(chart(label, data)):
                    (folder / "charts" / f"{file_name(label, drawn)}.svg").write_text(svg, encoding="utf-8")

        for step, run in (("chart_files", draw), ("tables", lambda: tables.extend(write_tables(a, folder / "tables"))), ("html_report", lambda: html.write_text(page(a, name, self.run_id), encoding="utf-8"))):
            try:
                run()
            except Exception:
                if self.config.strict_mode:
                    raise
                log.exception("step %s failed", step)
                a.failed.append(step)
        target_file = folder / "summary.json"
        target_file.write_text(json.dumps(summary(a, name, self.run_id), ensure_ascii=False, indent=1), encoding="utf-8")
        log.info("%s done in %.1f s", name, time.time() - began)
        return {"success": True, "dataset_name": name, "output_dir": str(folder), "html_report": str(html) if html.exists() else None, "summary_json": str(target_file), "tables": tables, "n_alerts": len(a.quality.alerts), "n_plots": len(a.charts), "chart_files": sorted(drawn), "failed_steps": a.failed}

    def run(self) -> dict[str, dict]:
        if self.spark is None:
            self.setup()
        c = self.config
        stamp = datetime.now().strftime("%Y%m%d_%H%M%S")
        if c.input_file:
            path = Path(c.input_file)
            name = batch.slug(path.stem)
            return {name: self.one(path, name, Path(c.output_dir) / f"{name}_{stamp}")}
        if not c.input_folder:
            raise ValueError("input_file or input_folder is needed")
        top = Path(c.input_folder)
        paths = batch.discover(top, c.batch_recursive)
        if c.batch_pattern:
            paths = [p for p in paths if p.match(c.batch_pattern)]
        if not c.batch_recursive and (text := batch.skipped_text(batch.skipped_folders(top))):
            log.warning(text)
        out: dict[str, dict] = {}
        folder = Path(c.output_dir) / f"{batch.slug(top.resolve().name)}_batch_{stamp}"
        for path, name in batch.names_of(paths, top).items():
            try:
                out[name] = self.one(path, name, folder / name, batch_run=True)
            except Exception as error:
                if c.strict_mode:
                    raise
                log.exception("%s failed", path)
                out[name] = {"success": False, "dataset_name": name, "error": str(error)}
        return out
