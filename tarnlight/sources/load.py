"""Tables from CSV, Excel, Parquet and JSON files, normalised for profiling."""

from __future__ import annotations

import logging
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, is_text
from ..operators.charts import sample
from . import batch, detect

log = logging.getLogger(__name__)


def _real(path: str | Path) -> str:
    return str(path) if re.match(r"^[a-z0-9]+://", str(path)) else f"file://{Path(path).resolve()}"


def valid_utf8(spark: SparkSession, path: str | Path) -> bool:
    return not spark.read.text(_real(path)).where(~F.call_function("is_valid_utf8", F.col("value"))).limit(1).count()


def goes_over_lines(spark: SparkSession, path: str | Path) -> bool:
    """Whether a line has an odd number of quotes, as only a cell with a line's end inside leaves one open."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(_real(path)).where(quotes % 2 == 1).limit(1).count() > 0


def load_csv(spark: SparkSession, path: str | Path, *, sep: str | None = None, charset: str | None = None, decimal: str | None = None) -> DataFrame:
    """A CSV file with a header; what isn't given is detected. A decimal comma makes numbers of text columns.

    A file is split among tasks unless a quoted cell goes over a line's end, which one pass over its lines finds out: only
    then must one task read it.
    """
    if not charset and not detect.is_local(path) and valid_utf8(spark, path):
        charset = "utf-8"  # found out by the executors; a local file is read through on the driver
    charset = charset or detect.encoding(path, spark)
    sep = sep or detect.delimiter(path, charset, spark)
    decimal = decimal or detect.decimal_sign(path, sep, charset, spark)
    windows = charset.lower().replace("-", "").replace("_", "") in ("cp1252", "windows1252")
    # the reader takes few encodings: cp1252 is read as latin-1, and the characters where the two differ are put right
    df = spark.read.csv(_real(path), header=True, sep=sep, encoding="iso-8859-1" if windows else charset, inferSchema=True, multiLine=charset.lower().startswith(("utf-16", "utf-32")) or goes_over_lines(spark, path), escape='"')
    if windows:
        pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
        wrong, right = ("".join(x) for x in zip(*((a, b) for a, b in pairs if b)))
        table = str.maketrans(wrong, right)
        df = df.select(*((F.translate(col(c), wrong, right) if is_text(df, c) else col(c)).alias(c.translate(table)) for c in df.columns))
    if decimal == ",":
        written = r"^\s*[+-]?\d+(,\d+)?([eE][+-]?\d+)?\s*$"
        text = [c for c in df.columns if is_text(df, c)]
        if text:
            row = df.agg(*(f.alias(f"{k}_{i}") for i, c in enumerate(text) for k, f in (("n", F.count(col(c))), ("x", F.count_if(col(c).rlike(written)))))).first()
            df = df.withColumns({c: F.replace(F.trim(col(c)), F.lit(","), F.lit(".")).cast("double") for i, c in enumerate(text) if row[f"n_{i}"] and row[f"n_{i}"] == row[f"x_{i}"]})
    return df


def excel_sheets(path: str | Path) -> list[str]:
    import pandas as pd

    return list(pd.ExcelFile(path).sheet_names)


def load_excel(spark: SparkSession, path: str | Path, sheet: str | int | None = None) -> DataFrame:
    """The first sheet, or the one with that name or number. Needs a spreadsheet engine of pandas on the driver."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=0 if sheet is None else sheet)
    except ImportError as error:
        raise RuntimeError("reading spreadsheets needs openpyxl (or xlrd for .xls)") from error
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None))


def load_parquet(spark: SparkSession, path: str | Path) -> DataFrame:
    return spark.read.parquet(_real(path))


def flatten(df: DataFrame) -> DataFrame:
    """Structs as dotted columns."""
    def fields(c: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in fields(c.getField(f.name), f.dataType, f"{name}.{f.name}")]
        return [c.alias(name)]

    return df.select(*(x for f in df.schema.fields for x in fields(col(f.name), f.dataType, f.name)))


def load_json(spark: SparkSession, path: str | Path) -> DataFrame:
    """A JSON document (an object or an array of them), or one object a line; nested objects become dotted columns."""
    def read(many: bool) -> DataFrame:
        df = spark.read.json(_real(path), multiLine=many)
        if "_corrupt_record" in df.columns:
            raise ValueError(f"{path} isn't JSON")
        return flatten(df)

    if str(path).lower().endswith(".jsonl"):
        return read(False)
    try:
        return read(True)
    except ValueError:
        return read(False)


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null, and arrays, maps and structs become JSON text."""
    out = []
    for f in df.schema.fields:
        x = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            x = F.nanvl(x, F.lit(None).cast(f.dataType))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            x = F.to_json(x)
        out.append(x.alias(f.name))
    return df.select(*out)


def load(spark: SparkSession, path: str | Path, *, sheet: str | int | None = None, sample_size: int | None = None) -> DataFrame:
    """Any supported file, normalised; with sample_size, that many rows of a larger one, the same on every run."""
    kind = detect.file_format(path)
    if detect.is_local(path) and not Path(path).exists():
        raise FileNotFoundError(path)
    df = {"csv": load_csv, "parquet": load_parquet, "json": load_json}[kind](spark, path) if kind != "excel" else load_excel(spark, path, sheet)
    df = normalise(df)
    return sample(df, sample_size) if sample_size and df.count() > sample_size else df


def load_folder(spark: SparkSession, folder: str | Path, recursive: bool = False) -> dict[str, DataFrame]:
    """Every supported file of a folder by its name; files that can't be read are logged and left out."""
    paths, out = batch.discover(folder, recursive), {}
    for path, name in batch.names_of(paths, folder).items():
        try:
            out[name] = load(spark, path)
        except Exception:
            log.exception("%s can't be read", path)
    return out
