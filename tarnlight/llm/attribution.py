"""Token counts of document sections, by offsets.

A whole document is encoded once. Token character spans come from the ids' byte lengths; they are joined to
the document's sorted, disjoint sections by binary search. A token inside one section counts there. A token
that crosses a boundary is allocated by an explicit rule:
  majority  the section with most of the token's characters; on a tie the earlier one
  first     the section with the token's first character
  last      the section with the token's last character
Tokens, or ends of tokens, outside every section count in the section named null.

Defined cases: a null or empty text has its sections with no tokens; a null id is carried; repeated rows each
give their rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scratch import ship, spread
from .tokens import default_tokenizer, encoder

Sections = list[tuple[str, int, int]]
RULES = ("majority", "first", "last")


def title_and_body(text: str) -> Sections:
    """The first line, and the rest from the line feed on."""
    cut = text.find("\n")
    return [("title", 0, len(text))] if cut < 0 else [("title", 0, cut), ("body", cut, len(text))]


def lines(text: str) -> Sections:
    """Each line with its line feed."""
    out, at = [], 0
    for i, line in enumerate(text.split("\n")):
        out.append((f"line{i}", at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    return out


def token_spans(text: str, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens; a token of part of a character has that character."""
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(byte_lengths)
    return char[ends - byte_lengths], char[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, sections: Sections, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section index of each token, -1 for none; whether the token crosses a boundary)."""
    at = np.array([s for _, s, _ in sections], np.int64)
    to = np.array([e for _, _, e in sections], np.int64)

    def section(pos: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.full(len(pos), -1)
        i = np.searchsorted(at, pos, side="right") - 1
        return np.where((i >= 0) & (pos < to[np.maximum(i, 0)]), i, -1)

    a, b = section(starts), section(ends - 1)
    crosses = (a != b) | ((ends - starts > 1) & (a < 0) & _touches(starts, ends, at, to))
    out = {"first": a, "last": b}.get(rule, a.copy())
    if rule == "majority":
        for t in np.flatnonzero(crosses):
            share: dict[int, int] = {}
            for c in section(np.arange(starts[t], ends[t])).tolist():
                share[c] = share.get(c, 0) + 1
            out[t] = max(share, key=lambda c: share[c])  # the first of equals is the earliest in the text
    return out, crosses


def _touches(starts, ends, at, to) -> np.ndarray:
    """Whether any section begins inside the span."""
    if not len(at):
        return np.zeros(len(starts), bool)
    return np.searchsorted(at, ends, side="left") > np.searchsorted(at, starts, side="left")


def attribute_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[str], Sections] = title_and_body, rule: str = "majority", tokenizer: str | None = None) -> DataFrame:
    """One row for each section of each document: id, section, section_no, start, end, n_tokens, n_crossing
    (tokens allocated here that cross a boundary), doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("section", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("section_no", "start", "end", "n_tokens", "n_crossing", "doc_tokens")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for k, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                parts = sections(text)
                ids = enc.ids(text)
                starts, ends = token_spans(text, enc.byte_lengths[ids]) if len(ids) else (np.zeros(0, np.int64),) * 2
                where, crosses = allocate(starts, ends, parts, rule)
                n = np.bincount(where + 1, minlength=len(parts) + 1)
                x = np.bincount(where[crosses] + 1, minlength=len(parts) + 1)
                if n[0]:
                    rows.append((k, None, None, None, None, int(n[0]), int(x[0]), len(ids)))
                rows += [(k, name, i, s, e, int(n[i + 1]), int(x[i + 1]), len(ids)) for i, (name, s, e) in enumerate(parts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return spread(docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))).mapInArrow(run, schema)
