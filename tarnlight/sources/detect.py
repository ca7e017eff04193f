"""Format, encoding, delimiter and decimal sign of a file, from its bytes on the driver."""

from __future__ import annotations

import codecs
import csv
import re
from pathlib import Path

from pyspark.sql import SparkSession

#: Formats by extension, delimiters, and how much of a file is looked at.
FORMATS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".xlsx": "excel", ".xls": "excel", ".parquet": "parquet", ".json": "json", ".jsonl": "json"}
DELIMITERS = (",", ";", "\t", "|")
DELIMITER_LINES, DECIMAL_LINES, GUESS_BYTES = 20, 30, 200_000


def file_format(path: str | Path) -> str:
    try:
        return FORMATS[Path(path).suffix.lower()]
    except KeyError:
        raise ValueError(f"unsupported file: {path}; known are {', '.join(FORMATS)}") from None


def is_local(path: str | Path) -> bool:
    return re.match(r"^[a-z0-9]+://", str(path)) is None


def head_bytes(path: str | Path, n: int, spark: SparkSession | None = None) -> bytes:
    """The first n bytes of a file; one that isn't local is opened by the session's file systems."""
    if is_local(path):
        with open(path, "rb") as f:
            return f.read(n)
    if spark is None:
        raise ValueError(f"{path} needs a session to be read")
    target = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def encoding(path: str | Path, spark: SparkSession | None = None) -> str:
    """utf-8 if all bytes are; else a 16 or 32 bit form by its byte order mark; else cp1252. Of a file that isn't local, the
    first bytes decide."""
    head = head_bytes(path, GUESS_BYTES, spark)
    for mark, name in ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if head.startswith(mark):
            return name
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        decoder.decode(head)
        if is_local(path):
            with open(path, "rb") as f:
                f.seek(len(head))
                while block := f.read(1 << 20):
                    decoder.decode(block)
            decoder.decode(b"", final=True)
        return "utf-8"
    except UnicodeDecodeError:
        return "cp1252"


def head_lines(path: str | Path, charset: str, n: int, spark: SparkSession | None = None) -> list[str]:
    """The first n lines, of as many bytes as they need."""
    size = GUESS_BYTES
    while True:
        data = head_bytes(path, size, spark)
        found = data.decode(charset, "replace").splitlines()
        if len(found) > n or len(data) < size:
            return found[:n]
        size *= 4


def delimiter(path: str | Path, charset: str | None = None, spark: SparkSession | None = None) -> str:
    """The sniffed delimiter if every line has it equally often; else the one that does, with most on line 1; else a comma."""
    found = [x for x in head_lines(path, charset or encoding(path, spark), DELIMITER_LINES, spark) if x.strip()]
    if len(found) < 2:
        return ","
    even = lambda d: len({x.count(d) for x in found}) == 1 and d in found[0]
    try:
        sniffed = csv.Sniffer().sniff("\n".join(found), "".join(DELIMITERS)).delimiter
        if sniffed in DELIMITERS and even(sniffed):
            return sniffed
    except csv.Error:
        pass
    return max((d for d in DELIMITERS if even(d)), key=lambda d: found[0].count(d), default=",")


def decimal_sign(path: str | Path, sep: str, charset: str | None = None, spark: SparkSession | None = None) -> str:
    """A comma if at least as many cells of the first data lines are written with one as with a point, and some are."""
    if sep == ",":
        return "."
    comma = point = 0
    for row in csv.reader(head_lines(path, charset or encoding(path, spark), DECIMAL_LINES + 1, spark)[1:], delimiter=sep):
        for cell in row:
            comma += bool(re.fullmatch(r"-?\d+,\d+", cell.strip()))
            point += bool(re.fullmatch(r"-?\d+\.\d+", cell.strip()))
    return "," if comma and comma >= point else "."
