"""Benchmark decontamination: a prefix-filtered containment join of benchmark windows with documents.

A window is `size` consecutive words of an item (an item of fewer words is one window). A document contains a
window if the same words stand in it one after another. Steps:
1. Windows are cut into shingles of `shingle` words. One pass over the documents counts how often each of the
   benchmark's shingles occurs in them; shingles are ordered by that count, then by key.
2. Containment is full, so the necessary prefix of a window is its one rarest shingle. Only prefix shingles
   are joined with the documents' shingles, and the shingle's place in the window gives the one start a match
   can have (positional bound), which with the window's length must lie in the document (length bound).
3. Each candidate is verified word for word; the words of true matches are hit.
Benchmark tables go to the executors in blocks of at most `block_windows` windows and `block_bytes` bytes of their
words (or one longer window), both checked before; each block is held against all documents, so a larger benchmark
takes more passes and loses nothing.

Defined cases: a null or empty text has no words, and a null or empty item no window; an item with a null id is
ignored; equal item ids are one item; repeated documents give a row each; a null doc_id is carried; other
columns are ignored or carried, under any names but those that begin with __b_, which are this module's; empty
tables give no rows, or rows without hits.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrowtext import WORD_PATTERN, chunks, text_buffers, windows, words
from .scratch import materialise, ship

WORD = re.compile(WORD_PATTERN)
TO_LOWER = {c: c + 32 for c in range(65, 91)}
FILTER_BITS = 22


def split_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(TO_LOWER))


def item_windows(item: list[str], size: int) -> list[tuple[str, ...]]:
    if not item:
        return []
    return [tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))]


def word_keys(item: list[str] | tuple[str, ...]) -> np.ndarray:
    data = " ".join(item).encode()
    return words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]


class Blocks:
    """Windows of the items, with their items; reads the benchmark in bounded blocks."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str, size: int, block_windows: int, block_bytes: int):
        self.source = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
        self.size, self.most, self.most_bytes = size, block_windows, block_bytes

    def __iter__(self) -> Iterator[dict[tuple[str, ...], set[str]]]:
        found: dict[tuple[str, ...], set[str]] = defaultdict(set)
        held = 0
        for row in self.source.toLocalIterator():
            for w in item_windows(split_words(row["t"]), self.size):
                size = sum(map(len, w)) + 4 * len(w)
                if w not in found:
                    if found and (len(found) >= self.most or held + size > self.most_bytes):
                        yield dict(found)
                        found, held = defaultdict(set), 0
                    held += size
                if row["i"] not in found[w]:
                    found[w].add(row["i"])
                    held += len(row["i"]) + 8
        if found:
            yield dict(found)


def sizes_of(wins: list[tuple[str, ...]], shingle: int) -> dict[int, list[int]]:
    """Window numbers by the length of their shingles."""
    by: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(wins):
        by[min(shingle, len(w))].append(i)
    return by


def membership(keys: np.ndarray) -> np.ndarray:
    """A bitmap of fixed size that rejects most keys that aren't among `keys`."""
    table = np.zeros(1 << FILTER_BITS, bool)
    table[keys >> np.uint64(64 - FILTER_BITS)] = True
    return table


def found_at(every: np.ndarray, keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in `every`, positions in sorted `keys`) of equal values."""
    at = np.flatnonzero(table[every >> np.uint64(64 - FILTER_BITS)])
    if not len(at):
        return at, at
    where = np.minimum(np.searchsorted(keys, every[at]), len(keys) - 1)
    same = keys[where] == every[at]
    return at[same], where[same]


def count_shingles(docs: DataFrame, text_col: str, keys_by_size: Broadcast) -> dict[tuple[int, int], int]:
    """How often each of the given shingles occurs in the documents; as many rows reach the driver as are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = {s: (k, membership(k), np.zeros(len(k), np.int64)) for s, k in keys_by_size.value.items()}
        for batch in batches:
            data, offs = text_buffers(batch.column(0))
            for a, b in chunks(offs):
                keys, bounds = words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                for s, (known, table, n) in given.items():
                    at, where = found_at(windows(keys, s), known, table)
                    inside = np.searchsorted(bounds, at, side="right") == np.searchsorted(bounds, at + s - 1, side="right")
                    n += np.bincount(where[inside], minlength=len(n))
        for s, (_, _, n) in given.items():
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_pydict({"s": [s] * len(some), "k": some, "n": n[some]})

    counted = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "s long, k long, n long")
    return {(r["s"], r["k"]): r["n"] for r in counted.groupBy("s", "k").agg(F.sum("n").alias("n")).toLocalIterator()}


def build_index(wins: list[tuple[str, ...]], docs: DataFrame, text_col: str, shingle: int) -> dict[int, tuple]:
    """For each shingle length: sorted prefix keys, first and last entry of each, and entries (window, place)."""
    sc = docs.sparkSession.sparkContext
    parts = {i: windows(word_keys(w), min(shingle, len(w))) for i, w in enumerate(wins)}
    by = sizes_of(wins, shingle)
    known = {s: np.unique(np.concatenate([parts[i] for i in own])) for s, own in by.items()}
    sent = sc.broadcast(known)
    counts = count_shingles(docs, text_col, sent)
    sent.unpersist()
    index = {}
    for s, own in by.items():
        n = np.array([counts.get((s, k), 0) for k in range(len(known[s]))], np.int64)
        prefix = defaultdict(list)
        for i in own:
            at = np.searchsorted(known[s], parts[i])
            place = min(range(len(at)), key=lambda j: (n[at[j]], at[j], j))
            prefix[int(at[place])].append((i, place))
        order = sorted(prefix)
        entries = [e for k in order for e in prefix[k]]
        ends = np.cumsum([len(prefix[k]) for k in order])
        index[s] = (known[s][order], np.concatenate([[0], ends]), np.array([e[0] for e in entries]), np.array([e[1] for e in entries]))
    return index


def find_windows(docs: DataFrame, text_col: str, carry: list[str], wins: Broadcast, index: Broadcast) -> DataFrame:
    """carry, __b_n_words, __b_hits (word positions hit, as [from, to) pairs, disjoint and sorted), __b_items (sorted, distinct)."""
    # carried columns go through Python under plain names, as mapInArrow can't resolve a name with a dot
    schema = T.StructType([T.StructField(f"__b_c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)] + [T.StructField("__b_n_words", T.LongType()), T.StructField("__b_hits", T.ArrayType(T.LongType())), T.StructField("__b_items", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = list(wins.value.items())
        length = np.array([len(w) for w, _ in listed], np.int64)
        given = [(s, keys, membership(keys), *rest) for s, (keys, *rest) in index.value.items()]
        for batch in batches:
            column = batch.column(len(carry))
            data, offs = text_buffers(column)
            n_words, hits, items = [], [[] for _ in range(len(column))], [[] for _ in range(len(column))]
            for a, b in chunks(offs):
                keys, bounds = words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                n_words.append(np.diff(bounds))
                pairs = []
                for s, known, table, ends, window, place in given:
                    at, where = found_at(windows(keys, s), known, table)
                    n = ends[where + 1] - ends[where]
                    entry = np.repeat(ends[where], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    start, win = np.repeat(at, n) - place[entry], window[entry]
                    row = np.searchsorted(bounds, np.repeat(at, n), side="right") - 1
                    fits = (start >= bounds[row]) & (start + length[win] <= bounds[row + 1])
                    pairs.append(np.stack([row[fits], start[fits] - bounds[row[fits]], win[fits]]))
                if not pairs:
                    continue
                row, start, win = np.concatenate(pairs, axis=1)
                order = np.lexsort((start, row))
                row, start, win = row[order], start[order], win[order]
                cut = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    r = a + int(row[lo])
                    own, spans, met = split_words(column[r].as_py()), [], set()
                    for p, w in zip(start[lo:hi].tolist(), win[lo:hi].tolist()):
                        q = p + len(listed[w][0])
                        if tuple(own[p:q]) == listed[w][0]:
                            met |= listed[w][1]
                            if spans and p <= spans[-1]:
                                spans[-1] = max(spans[-1], q)
                            else:
                                spans += [p, q]
                    hits[r], items[r] = spans, sorted(met)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *(pa.array(x, f.type) for x, f in zip((np.concatenate(n_words) if n_words else [], hits, items), list(arrow)[len(carry) :]))], schema=arrow)

    source = docs.select(*(F.col(f"`{c}`").alias(f"__b_c{i}") for i, c in enumerate(carry)), F.col(f"`{text_col}`").cast("string").alias("__b_text"))
    return source.mapInArrow(run, schema).toDF(*carry, *schema.names[len(carry) :])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", carry: list[str] | None = None, size: int = 10, shingle: int = 5, block_windows: int = 200_000, block_bytes: int = 32 << 20) -> DataFrame:
    """The carried columns (by default the id) with __b_n_words, __b_hits and __b_items of each document."""
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    carry = carry or [id_col]
    blocks = iter(Blocks(benchmark, item_id_col, item_text_col, size, block_windows, block_bytes))
    first, second = next(blocks, {}), next(blocks, None)
    if second is None:
        return find_windows(docs, text_col, carry, sc.broadcast(first), sc.broadcast(build_index(list(first), docs, text_col, shingle)))
    # several blocks: rows get a number of their own, as each block meets all of them
    docs = materialise(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*carry, text_col]))).withColumn("__b_row", F.monotonically_increasing_id()), "decontam")
    out = None
    for block in (x for group in ([first, second], blocks) for x in group):
        part = find_windows(docs, text_col, ["__b_row"], sc.broadcast(block), sc.broadcast(build_index(list(block), docs, text_col, shingle)))
        out = part if out is None else out.unionByName(part)
    merged = out.groupBy("__b_row").agg(F.max("__b_n_words").alias("__b_n_words"), F.flatten(F.collect_list("__b_hits")).alias("__b_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__b_items")))).alias("__b_items"))
    return docs.join(merged, "__b_row").select(*(F.col(f"`{c}`") for c in carry), "__b_n_words", _disjoint(F.col("__b_hits")).alias("__b_hits"), "__b_items")


def _disjoint(hits):
    """Sorted disjoint [from, to) pairs of pairs in any order."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(hits) / 2 - 1).cast("int")), lambda i: F.struct(F.get(hits, 2 * i).alias("a"), F.get(hits, 2 * i + 1).alias("b"))))
    merged = F.aggregate(
        pairs,
        F.array().cast("array<long>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["a"] <= F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), x["b"])))).otherwise(F.concat(acc, F.array(x["a"], x["b"]))),
    )
    return F.when(F.size(hits) > 0, merged).otherwise(F.array().cast("array<long>"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of decontaminate()'s rows."""
    n_hit = F.aggregate("__b_hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda a, x: F.struct(F.when(a["s"] < 0, a["n"]).otherwise(a["n"] + x - a["s"]).alias("n"), F.when(a["s"] < 0, x).otherwise(F.lit(-1)).cast("long").alias("s")))["n"]
    return found.select(id_col, F.col("__b_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__b_items").cast("long").alias("n_items"), F.sha2(F.array_join("__b_items", ","), 256).alias("items_sha256"), (F.size("__b_hits") > 0).alias("contaminated"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT r, i, k, item_id FROM dw JOIN bw USING (k, s)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT r, i, k FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
