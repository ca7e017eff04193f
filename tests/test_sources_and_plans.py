import json
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pytest

from tarnlight import cli
from tarnlight.plans import recommendations, report
from tarnlight.plans.config import Config, ConfigError, merged, template
from tarnlight.plans.pipeline import Pipeline, analyze
from tarnlight.sources import batch, detect, load
from tarnlight.sources.placeholders import replace_placeholders


def test_detects_latin_semicolon_decimal_comma(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("nombre;región;valor\nJosé;Ñuñoa;1,5\nAna;León;22,25\n".encode("latin-1"))
    assert detect.encoding(p) == "cp1252" and detect.delimiter(p) == ";" and detect.decimal_sign(p, ";") == ","
    df = load.load(spark, p)
    assert df.columns == ["nombre", "región", "valor"] and [r["valor"] for r in df.collect()] == [1.5, 22.25] and df.first()["nombre"] == "José"


def test_cp1252_characters(spark, tmp_path):
    p = tmp_path / "w.csv"
    p.write_bytes("precio €;n\n“uno”;1\n–;2\n".encode("cp1252"))
    df = load.load(spark, p)
    assert df.columns == ["precio €", "n"] and [r[0] for r in df.collect()] == ["“uno”", "–"]


def test_late_accent_and_free_text(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_bytes(b"id;nombre\n" + b"".join(b"%d;abc\n" % i for i in range(3000)) + "9;Peña\n".encode("cp1252"))
    assert detect.encoding(p) == "cp1252"
    q = tmp_path / "c.csv"
    q.write_text('id,comment,score\n1,"a b, c",2\n2,"d e",3\n')
    assert detect.delimiter(q) == "," and load.load(spark, q).count() == 2


def test_json_forms(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_text(json.dumps([{"id": 1, "address": {"city": "x", "zip": "1"}, "tags": ["p", "q"]}, {"id": 2, "address": {"city": "y", "zip": "2"}, "tags": []}]))
    df = load.load(spark, a)
    assert set(df.columns) == {"id", "address.city", "address.zip", "tags"} and df.where("id = 1").select("tags").first()[0] == '["p","q"]'
    b = tmp_path / "b.jsonl"
    b.write_text('{"id": 1}\n{"id": 2}\n')
    assert load.load(spark, b).count() == 2


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load.load(spark, tmp_path / "no.csv")
    with pytest.raises(ValueError):
        detect.file_format("x.doc")


def test_placeholders(spark):
    df = spark.createDataFrame([("MALE", "3750"), ("FEMALE", "?"), (".", "3800.5"), ("MALE", "4100"), (" - ", None), (None, None)], "s string, n string")
    got, found = replace_placeholders(df)
    assert found["s"] == {".": 1, "-": 1} and found["n"] == {"?": 1}
    assert got.where("s IS NULL").count() == 3 and dict(got.dtypes)["n"] == "double" and got.groupBy().sum("n").first()[0] == 11650.5


def test_batch_names(tmp_path):
    for p in ("x/train.csv", "y/train.csv", "a.csv", "a.parquet", ".hidden/z.csv", "n.doc"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("a\n1\n")
    found = batch.discover(tmp_path, recursive=True)
    names = batch.names_of(found, tmp_path)
    assert len(found) == 4 and len({n.lower() for n in names.values()}) == 4 and "x_train" in names.values()
    assert batch.skipped_folders(tmp_path) == {"x": 1, "y": 1}
    paths = [tmp_path / "raw" / "train.csv", tmp_path / "houses" / "test.csv"]
    assert list(batch.names_of(paths, tmp_path).values()) == ["train", "houses_test"]  # a container's name says nothing


def test_load_folder_leaves_out_what_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.json").write_text("{")
    assert list(load.load_folder(spark, tmp_path)) == ["a"]


def test_config():
    c = Config.of(merged({"target": {"target_column": "a"}, "sample_size": 5}, {"target": {"target_type": "regression", "target_column": None}}))
    assert c.target.target_column == "a" and c.target.target_type == "regression" and "iqr_multiplier" in template()
    with pytest.raises(ConfigError):
        Config.of({"nothing": 1})
    with pytest.raises(ConfigError):
        Config.of({"data_quality": {"missing_threshold": 2}})


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 300
    y = rng.integers(0, 2, n)
    return spark.createDataFrame(pd.DataFrame({"amount": rng.lognormal(3, 1, n), "measure": rng.normal(50, 5, n) + y * 10, "third": rng.normal(size=n), "group": rng.choice(["norte", "sur", "centro"], n), "when": pd.date_range("2020-01-01", periods=n), "name": [f"<b>row {i} & more</b>" for i in range(n)], "y": y}))


def test_analysis_end_to_end(table):
    a = analyze(table, Config.of({"target": {"target_column": "y"}}))
    assert a.failed == [] and a.types["when"] == "datetime" and a.target.relations[0].feature == "measure"
    assert a.datetime["when"]["frequency"] == "D" and any(r.step == "scale" for r in a.recommendations) and a.charts
    html = report.page(a, "a <table>", "r")
    assert "<b>row" not in html and "&lt;b&gt;row" in html and "a &lt;table&gt;" in html


def test_failing_step_is_named(table, monkeypatch):
    from tarnlight.plans import pipeline

    def broken(*_, **__):
        raise RuntimeError("no")

    monkeypatch.setattr(pipeline.outliers, "analyze_outliers", broken)
    small = table.select("measure", "group")
    assert analyze(small, charts=False).failed == ["outliers"]
    with pytest.raises(RuntimeError):
        analyze(small, Config.of({"strict_mode": True}), charts=False)
    with pytest.raises(ValueError, match="measure"):
        analyze(small, Config.of({"target": {"target_column": "measur"}}))


def test_pipeline_writes_outputs(spark, table, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    table.select("measure", "group", "y").toPandas().to_csv(src / "one.csv", index=False)
    (src / "bad.json").write_text("{")
    got = Pipeline(Config.of({"input_folder": str(src), "output_dir": str(tmp_path / "out"), "target": {"target_column": "y"}}), spark).run()
    assert got["one"]["success"] and not got["bad"]["success"] and len(got["one"]["tables"]) == 7
    made = json.loads(Path(got["one"]["summary_json"]).read_text())
    assert made["shape"] == [300, 3] and made["dataset_name"] == "one" and made["data_quality"]["duplicate_rows_count"] >= made["data_quality"]["duplicates"]
    assert made["target"]["class_balance"]["counts"].keys() == {"0", "1"} and set(made["column_types"]) == {"measure", "group", "y"} and made["univariate"]["numeric_columns"] == 1
    files = sorted((tmp_path / "out").rglob("*.svg"))
    assert len(files) >= 6 and all(ElementTree.fromstring(f.read_text(encoding="utf-8")).tag.endswith("svg") for f in files)


def test_every_chart_is_drawn(spark):
    rng = np.random.default_rng(1)
    n = 400
    x = rng.normal(size=n)
    wide = np.exp(rng.normal(0, 2.5, n))
    floor = np.where(rng.random(n) < 0.5, 0.0, np.exp(rng.normal(3, 1, n)))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "near": x + rng.normal(0, 0.3, n), "wide": wide, "floor": floor, "kind": rng.choice(["a", "b", "c"], n), "holes": np.where(rng.random(n) < 0.2, None, "v"), "when": pd.date_range("2020-01-01", periods=n), "once": pd.to_datetime(["2020-01-01"] * n), "label": np.where(x > 0, "10", "9")}))
    a = analyze(df, Config.of({"target": {"target_column": "label"}, "visualizations": {"max_correlation_heatmap_size": 3}}))
    assert a.failed == [] and a.log_scale["wide"].needed
    for start in ("histogram_x", "histogram_log_wide", "boxes", "boxes_log", "bars_kind", "shares_kind", "class_bars_kind", "class_boxes_x", "target_label", "scatter_", "qq_", "periods_when", "correlations", "associations", "missing", "pair_plot"):
        found = [k for k in a.charts if k.startswith(start)]
        assert found, start
        for k in found:
            svgs = report.drawings(report.chart(k, a.charts[k]))
            assert svgs and all(ElementTree.fromstring(s).tag.endswith("svg") for s in svgs), k
    assert "periods_once" not in a.charts and "correlation_heatmap" in a.chart_notes
    assert len({p for p, _ in a.charts["correlations"]}) == 3
    assert set(next(v for k, v in a.charts.items() if k.startswith("qq_"))) == {"before", "after"}
    assert [r[0] for r in a.charts["class_bars_kind"]] == sorted((r[0] for r in a.charts["class_bars_kind"]), key=float)
    html = report.page(a, "t", "r")
    assert 'href="#charts"' in html and 'id="charts"' in html


def test_shares_and_slices():
    svg = report.chart("shares_x", [("a", 96, 0.96), ("b", 4, 0.0395), ("c", 0, 0.0005)])
    assert "96.0 %" in svg and "&lt;0.1 %" in svg and svg.count("<path") == 3 and svg.count('text-anchor="middle"') == 1
    assert report.chart("scatter_x_y", {"points": [(1, -5), (10, 5), (None, 1)], "log": (True, True)}).count("<circle") == 1
    assert report.chart("boxes", []) == "" and report.chart("unknown", [1]) == ""


def test_csv_cells_over_lines_and_other_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"one\ntwo"\n2,"say ""x"""\n')
    (tmp_path / "b.csv").write_text("id;t\n" + "".join(f"{i};é{i}\n" for i in range(2000)))
    (tmp_path / "c.csv").write_bytes("id;v\n1;caf\xe9 1,5\n2;x\n".encode("cp1252"))
    assert load.goes_over_lines(spark, tmp_path / "a.csv") and not load.goes_over_lines(spark, tmp_path / "b.csv")
    assert [tuple(r) for r in load.load_csv(spark, tmp_path / "a.csv").collect()] == [(1, "one\ntwo"), (2, 'say "x"')]
    for p in ("a.csv", "b.csv", "c.csv"):  # a path with a scheme goes through the session's file systems
        there = load.load_csv(spark, f"file://{tmp_path / p}")
        assert there.collect() == load.load_csv(spark, tmp_path / p).collect() and there.columns[0] == "id"


def test_plan_rules():
    q = recommendations.QualityReport(rows=100, missing_per_column={"a": 10.0, "b": 2.0, "c": 70.0})
    r = recommendations.build({"a": "numeric_continuous", "b": "categorical", "c": "categorical"}, q, numeric={"a": {"mean": 2.0, "median": 1.0, "std": 2.0, "iqr": 1.0}}, correlations={}, modes={"b": ("x", 60.0)}, categories={"b": (2, 98, 0)}, present={})
    assert {(x.step, x.column) for x in r} == {("drop", "c"), ("impute", "a"), ("impute", "b"), ("encode", "b")}


def test_report_helpers():
    assert report.p_value(0.00001) == "<0.0001" and report.vif_text(float("inf")) == "∞" and report.list_text(["a'b"]) == '["a\'b"]'
    used = set()
    assert report.file_name("a/b", used) == "a_b" and report.file_name("A:B", used) == "A_B_2"


def test_cli(tmp_path, capsys):
    assert cli.main(["init-config", str(tmp_path / "c.yaml")]) == 0 and cli.main(["init-config", str(tmp_path / "c.yaml")]) == 1
    (tmp_path / "bad.yaml").write_text("nothing: 1\n")
    assert cli.main(["analyze-file", "x.csv", "--config", str(tmp_path / "bad.yaml")]) == 2
    with pytest.raises(SystemExit):
        cli.main(["--help"])
