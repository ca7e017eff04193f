"""Secret spans of whole texts, from all rules in one pass of one automaton.

A rule is a head and a body: the head's pattern, then one or more body characters, of which at least `least`
must follow for the span to count. Matches are leftmost, longest and do not overlap those of the same rule; a
match whose body is too short still uses up its text. All rules are compiled into one minimal automaton; its
pass over the bytes gives the places where a rule's head and first body character (or its counted body) end. At
such a place, a second and local step runs the reversed rule's own automaton to the leftmost start, and the rule's to the longest
end; texts without such places are read once only. Spans are in code points, end exclusive.

Defined cases: a null or empty text has no spans; a null id is carried; repeated rows each give a row; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrowtext import chunks, text_buffers
from .automaton import Automaton, parse, reverse
from .scratch import ship, spread


@dataclass(frozen=True)
class Rule:
    name: str
    head: str
    body: str = ""  # a class of characters; without it, the head is all
    least: int = 1
    counted: bool = False  # the automaton counts to `least`: for rules without a head

    @property
    def probe(self) -> str:
        """What the common automaton looks for: the shortest form of the rule, so that few states are needed."""
        return self.head + (f"{self.body}{{{self.least}}}" if self.counted else self.body)

    @property
    def pattern(self) -> str:
        return self.head + (f"{self.body}{{{self.least},}}" if self.counted else f"{self.body}+" if self.body else "")


BASE = (
    Rule("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 6),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24, True),
)
MORE = (
    Rule("hosting", "gh[opusr]_", "[A-Za-z0-9]", 36),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]", 20),
    Rule("payment", "[rs]k_(live|test)_", "[A-Za-z0-9]", 16),
    Rule("cloud", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("bearer", "(?i:bearer)\\x20+", "[A-Za-z0-9._~+/=-]", 20),
    Rule("webtoken", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.]", "[A-Za-z0-9_-]", 1),
    Rule("private_key", "-----BEGIN\\x20([A-Z]+\\x20)?PRIVATE\\x20KEY-----"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        probes = [parse(r.probe) for r in rules]
        self.rules = rules
        self.all = Automaton(probes, search=True)
        self.forward = [Automaton([parse(r.pattern)], search=False) for r in rules]
        self.backward = [Automaton([reverse(t)], search=False) for t in probes]
        self.head = [Automaton([parse(r.head)], search=False) if r.head and r.body and not r.counted else None for r in rules]
        self.separator = next(b for b in (10, *range(256)) if self.all.resets[b])

    def resolve(self, k: int, text: bytes, ends: list[int]) -> list[tuple[int, int]]:
        """Byte spans of rule k, from the places where it ends."""
        out, done, rule = [], 0, self.rules[k]
        for e in ends:
            if e <= done:
                continue
            start = self.backward[k].longest(text, e, done, -1)
            if start < 0:
                continue
            done = self.forward[k].longest(text, start, len(text))
            head = self.head[k].longest(text, start, done) if self.head[k] else start
            if not rule.body or done - head >= rule.least:
                out.append((start, done))
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each row its (start, end, rule), in code points, by start, then rule."""
        n = len(offsets) - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        # texts one after another, each followed by a byte that resets the automaton
        sizes = np.diff(offsets)
        joined = np.full(len(data) + n, self.separator, np.uint8)
        joined[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = data
        at, rules = self.all.ends(joined)
        row = np.searchsorted(offsets[:-1] + np.arange(n), at - 1, side="right") - 1
        for r in np.unique(row).tolist():
            mine = row == r
            text = data[offsets[r] : offsets[r + 1]].tobytes()
            place, bits = at[mine] - offsets[r] - r, rules[mine]
            found = [(s, e, k) for k in range(len(self.rules)) for s, e in self.resolve(k, text, place[bits >> k & 1 == 1].tolist())]
            if found:
                char = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                out[r] = sorted((int(char[s]), int(char[e]), k) for s, e, k in found)
                out[r].sort(key=lambda x: (x[0], x[2]))
        return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """id and spans: array of (kind, start, end) of each document, by start, then by the rules' order."""
    ship(docs.sparkSession)
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(item))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules)
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            rows: list = []
            for a, b in chunks(offs, 1 << 22):
                rows += [[{"kind": rules[k].name, "start": s, "end": e} for s, e, k in own] for own in find.spans(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow.field(1).type)], schema=arrow)

    return spread(docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))).mapInArrow(run, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans (text) of scan()'s rows."""
    names = [r.name for r in BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(names))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda name: F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    counts = [count(n) for n in names]
    return found.select(id_col, *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def spans_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
