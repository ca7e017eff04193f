"""Settings from defaults, a YAML file and the command line, in rising order of precedence."""

from __future__ import annotations

import dataclasses
import logging
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

log = logging.getLogger(__name__)
OBSOLETE = ("language",)


class ConfigError(ValueError):
    """A setting that isn't known, or has a value it can't have."""


@dataclass
class ColumnTypes:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)

    def wanted(self) -> dict[str, str]:
        return {c: f.name for f in dataclasses.fields(self) for c in getattr(self, f.name)}


# The defaults of all settings.
@dataclass
class DataQuality:
    missing_threshold: float = 0.95
    cardinality_threshold: int = 100
    duplicate_threshold: float = 0.1
    constant_threshold: float = 0.99


@dataclass
class Outliers:
    iqr_multiplier: float = 1.5
    z_score_threshold: float = 3.0
    isolation_forest_enabled: bool = True
    isolation_forest_contamination: float | None = None


@dataclass
class Visualizations:
    max_histograms: int = 20
    max_boxplots: int = 20
    max_correlation_heatmap_size: int = 30
    max_scatter_pairs: int = 10
    correlation_threshold: float = 0.05


@dataclass
class Target:
    target_column: str | None = None
    target_type: str | None = None
    class_imbalance_threshold: float = 0.8


@dataclass
class Config:
    input_file: str | None = None
    input_folder: str | None = None
    file_format: str | None = None
    delimiter: str | None = None
    encoding: str | None = None
    decimal: str | None = None
    excel_sheet: str | None = None
    sample_size: int | None = None
    batch_pattern: str | None = None
    batch_recursive: bool = False
    column_types: ColumnTypes = field(default_factory=ColumnTypes)
    data_quality: DataQuality = field(default_factory=DataQuality)
    outliers: Outliers = field(default_factory=Outliers)
    visualizations: Visualizations = field(default_factory=Visualizations)
    target: Target = field(default_factory=Target)
    output_dir: str = "reports"
    strict_mode: bool = False
    verbose: bool = False

    @classmethod
    def of(cls, settings: dict[str, Any]) -> Config:
        out = _fill(cls(), settings, "")
        out.validate()
        return out

    def validate(self) -> None:
        q, o, v, t = self.data_quality, self.outliers, self.visualizations, self.target
        for name in ("missing_threshold", "duplicate_threshold", "constant_threshold"):
            _need(0 <= getattr(q, name) <= 1, f"data_quality.{name} must be between 0 and 1")
        _need(q.cardinality_threshold > 0, "data_quality.cardinality_threshold must be positive")
        _need(o.iqr_multiplier > 0 and o.z_score_threshold > 0, "outliers: multiplier and threshold must be positive")
        _need(o.isolation_forest_contamination is None or 0 < o.isolation_forest_contamination <= 0.5, "outliers.isolation_forest_contamination must be over 0, and 0.5 at most")
        _need(min(v.max_histograms, v.max_boxplots, v.max_correlation_heatmap_size, v.max_scatter_pairs) >= 0 and 0 <= v.correlation_threshold <= 1, "visualizations: limits must not be negative, and the threshold between 0 and 1")
        _need(t.target_type in (None, "classification", "regression"), "target.target_type must be classification or regression")
        _need(0 < t.class_imbalance_threshold <= 1, "target.class_imbalance_threshold must be over 0, and 1 at most")
        _need(self.decimal in (None, ".", ","), "decimal must be . or ,")
        _need(self.sample_size is None or self.sample_size > 0, "sample_size must be positive")
        _need(self.file_format in (None, "csv", "excel", "xlsx", "parquet", "json"), "file_format must be csv, xlsx, parquet or json")


def _need(good: bool, message: str) -> None:
    if not good:
        raise ConfigError(message)


def _fill(target: Any, settings: dict[str, Any], path: str) -> Any:
    known = {f.name for f in dataclasses.fields(target)}
    for k, v in (settings or {}).items():
        if k in OBSOLETE and not path:
            log.warning("setting %r is no longer used", k)
            continue
        _need(k in known, f"unknown setting: {path}{k}")
        if v is None:
            continue
        now = getattr(target, k)
        if dataclasses.is_dataclass(now):
            _need(isinstance(v, dict), f"{path}{k} must have settings of its own")
            _fill(now, v, f"{path}{k}.")
        else:
            setattr(target, k, v)
    return target


def merged(*layers: dict[str, Any] | None) -> dict[str, Any]:
    """Later layers win, section by section; None leaves what is there."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = merged(out[k], v)
            elif v is not None:
                out[k] = v
    return out


def read_config(path: str | Path) -> dict[str, Any]:
    import yaml

    try:
        got = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as error:
        raise ConfigError(f"can't read {path}: {error}") from error
    _need(got is None or isinstance(got, dict), f"{path} must hold settings")
    return got or {}


def template() -> str:
    import yaml

    return yaml.safe_dump(dataclasses.asdict(Config()), sort_keys=False)
