"""Similarity join of documents on word shingles, with Bayesian pruning of candidates.

1. One pass gives each document its shingle set's key (128 bits), 32 band keys of 4 MinHash values each and a
   sketch of 64 MinHash values of 8 bits. Documents with one set are a class; the rest works on classes.
2. Classes that share a band key are candidates: at the threshold a pair is missed with probability 5e-8.
   Buckets of the same members are kept once. A bucket's pairs are compared on the sketch 16 values at a time,
   and a pair is dropped when the posterior probability that its similarity reaches the threshold (uniform
   prior, beta posterior) falls below `tolerance`. What stays is returned as a spanning forest, not as pairs: a block's
   own forest, and for two blocks the edges between their trees.
3. The forest's components are clusters. Each cluster's pairs are verified exactly on shingle sets, and give
   each class its number of links and a spanning forest of true links, whose components are the groups.
Large buckets and clusters are cut into blocks of bounded rows and shingles; a task gets two blocks. So no task
holds a whole group and no pairs within a group become rows.

Defined cases: a null or empty text, or one without words, has no shingle: it has no link, no class and is its
own group; fewer words than the shingle size make one shingle; repeated rows are copies; a null id is carried
and never names a group unless all its members' ids are null; other columns are ignored; an empty table gives
no rows. A shingle is known by a 64-bit key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrowtext import chunks, mix, shingle_sets, stream, text_buffers
from .components import connected_components
from .scratch import materialise, ship, spread

BANDS, ROWS, SKETCH, STEP = 32, 4, 64, 16
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20
_MULTIPLIERS = stream(BANDS * ROWS, 3) | np.uint64(1)
_BAND = stream(BANDS, 4)
_ROW = stream(ROWS, 5) | np.uint64(1)


def signature(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set keys as 2 x 64 bits, sizes, band keys, sketches) of shingle sets that aren't empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    at = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        key = np.stack([np.add.reduceat(flat, at) + sizes.astype(np.uint64), mix(np.add.reduceat(mix(flat), at))], axis=1)
        low = np.empty((len(sets), BANDS * ROWS), np.uint64)
        for j, m in enumerate(_MULTIPLIERS):
            low[:, j] = np.minimum.reduceat(flat * m, at)
        low = mix(low)
        bands = mix((low.reshape(len(sets), BANDS, ROWS) * _ROW).sum(axis=2, dtype=np.uint64) + _BAND)
    return key, sizes, bands.view(np.int64), (low[:, :SKETCH] >> np.uint64(56)).astype(np.uint8)


def describe(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, th (hash of the text), key, n, bands, sketch of each document."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("th", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(2))
            for a, b in chunks(offs):
                sets = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], size)
                some = [i for i, s in enumerate(sets) if len(s)]
                key, n, bands, sketch = [None] * len(sets), [0] * len(sets), [None] * len(sets), [None] * len(sets)
                if some:
                    for i, k, c, x, y in zip(some, *signature([sets[i] for i in some])):
                        key[i], n[i], bands[i], sketch[i] = k.tobytes(), int(c), x, y.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(x, f.type) for x, f in zip((key, n, bands, sketch), list(arrow)[2:]))], schema=arrow)

    text = F.col(text_col).cast("string")
    return spread(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))).mapInArrow(run, schema)


@lru_cache(maxsize=16)
def least_matches(threshold: Fraction, tolerance: float) -> tuple[int, ...]:
    """For STEP, 2 STEP, ... compared values: the fewest matches with which a pair stays.

    A value of 8 bits matches with probability s = J + (1 - J) / 256. With a uniform prior on s and m matches of
    n, P(s >= t) = P(Binomial(n + 1, t) <= m).
    """
    t = float(threshold + (1 - threshold) / 256)
    out = []
    for n in range(STEP, SKETCH + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def likely_pairs(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that survive comparing more and more of the sketch."""
    n = np.zeros(len(i), np.int16)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        n = n + (sketch[i, part] == sketch[j, part]).sum(axis=1, dtype=np.int16)
        stay = n >= need
        i, j, n = i[stay], j[stay], n[stay]
    return i, j


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The lowest member of each one's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    while (label != label[label]).any():
        label = label[label]
    return label


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, exact, over slices of the shingles."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((m, m), np.int64)
    top = int(col[-1]) + 1
    for c in range(0, top, width):
        lo, hi = np.searchsorted(col, (c, c + width))
        grid = np.zeros((m, min(width, top - c)), np.float32)
        grid[row[lo:hi], col[lo:hi] - c] = 1
        out += np.rint(grid @ grid.T).astype(np.int64)
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first `keys` columns, from sorted input."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if rows:
                    yield rows
                now, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield rows


def dealt(df: DataFrame, group: str, blocks: F.Column, member: str, columns: list[str]) -> DataFrame:
    """group, i, j, side and columns: each row once for each pair of blocks with its own."""
    df = df.withColumn("__nb", blocks.cast("int")).withColumn("side", F.pmod(F.xxhash64(F.col(member), F.col(group)), F.col("__nb")).cast("int"))
    df = df.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
    df = df.select(F.col(group).alias("g"), F.least("side", "__o").alias("i"), F.greatest("side", "__o").alias("j"), "side", *columns)
    return df.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def emit(rows: Iterator[tuple], names: list[tuple[str, pa.DataType]], most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), names)], names=[n for n, _ in names])

    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield out()
            held = []
    if held:
        yield out()


def prune(threshold: Fraction, tolerance: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold, tolerance)

        def edges() -> Iterator[tuple]:
            for rows in runs(batches, 3):
                sketch = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), SKETCH)
                side = np.array([r[3] for r in rows])
                i, j = likely_pairs(sketch, *np.triu_indices(len(rows), 1), least)
                root = roots(len(rows), i, j)
                if rows[0][1] == rows[0][2]:
                    ends = np.arange(len(rows))
                else:  # what a block's own task joins needs one edge here
                    inside = side[i] == side[j]
                    ends = np.unique(roots(len(rows), i[inside], j[inside]))
                for a in ends.tolist():
                    if a != root[a]:
                        yield rows[a][4], rows[root[a]][4]

        yield from emit(edges(), [("u", pa.binary()), ("v", pa.binary())])

    return run


def verify(threshold: Fraction) -> Callable:
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple]:
            for rows in runs(batches, 3):
                rows = list({r[4]: r for r in rows}.values())  # a class may come with copies of its text
                sets = [np.frombuffer(r[6], np.uint64) for r in rows]
                n, copies, side = np.array([len(s) for s in sets]), np.array([r[5] for r in rows]), np.array([r[3] for r in rows])
                both = n[:, None] + n[None, :]
                near = overlaps(sets) * (p + q) >= p * both  # |A & B| / |A | B| >= p / q
                np.fill_diagonal(near, False)
                if rows[0][1] != rows[0][2]:
                    near &= side[:, None] != side[None, :]
                root = roots(len(rows), *np.nonzero(near)).tolist()
                for r, a, c in zip(rows, root, (near @ copies).tolist()):
                    if c:
                        yield r[4], rows[a][4], c

        yield from emit(links(), [("u", pa.binary()), ("v", pa.binary()), ("links", pa.int64())])

    return run


def shingled(texts: DataFrame, size: int) -> DataFrame:
    """key, g, copies, nb, shingles of rows (key, g, copies, nb, t) whose text has that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_pylist()
            data, offs = text_buffers(batch.column(4))
            for a, b in chunks(offs):
                sets = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], size)
                own = signature_keys(sets)
                some = [i for i in range(len(sets)) if own[i] == key[a + i]]
                part = batch.slice(a, b - a).take(pa.array(some, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([sets[i].tobytes() for i in some], pa.binary())], names=["key", "g", "copies", "nb", "shingles"])

    return texts.mapInArrow(run, "key binary, g binary, copies long, nb long, shingles binary")


def signature_keys(sets: list[np.ndarray]) -> list[bytes | None]:
    out: list[bytes | None] = []
    with np.errstate(over="ignore"):
        for s in sets:
            out.append(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), mix(mix(s).sum(dtype=np.uint64, keepdims=True))[0]], np.uint64).tobytes() if len(s) else None)
    return out


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: Fraction = Fraction(4, 5), tolerance: float = 1e-6, text_hash: bool = False) -> DataFrame:
    """One row for each document: id, class_id (the smallest id of its group), n_links (other documents at or above
    the threshold), n_copies (documents with its shingle set), class_size. text_hash: also __j_th (xxhash64 of the
    text) and __j_first, the id and text hash (as a struct id, th) of the group's first document: that with the
    smallest id (a null last), then the smallest text hash."""
    ship(docs.sparkSession)
    each = materialise(describe(docs, id_col, text_col, size), "shingles")
    have = each.where("key IS NOT NULL")
    classes = materialise(have.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("own"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")

    banded = classes.select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.expr("bit_xor(xxhash64(key))").alias("x"), F.expr("bit_xor(xxhash64(key, 1))").alias("y")).where("size > 1")
    buckets = buckets.groupBy("size", "x", "y").agg(F.min("band").alias("band")).select("band", "size")
    members = banded.join(buckets, "band").join(classes.select("key", "sketch"), "key")
    pairs = dealt(members, "band", F.ceil(F.col("size") / BLOCK_ROWS), "key", ["key", "sketch"])
    clusters = connected_components(pairs.mapInArrow(prune(threshold, tolerance), "u binary, v binary"))

    inside = clusters.join(classes.select("key", "copies", "own", "n"), F.col("node") == F.col("key")).select("key", F.col("component").alias("g"), "copies", "own", "n")
    sums = inside.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("nb"))
    inside = inside.join(sums, "g").select("key", "g", "copies", "nb", F.col("own.id").alias("__i"), F.col("own.th").alias("__h"))
    text = docs.select(F.col(id_col).alias("__d"), F.col(text_col).cast("string").alias("t")).withColumn("__t", F.xxhash64("t"))
    texts = text.join(inside, F.col("__d").eqNullSafe(F.col("__i")) & (F.col("__t") == F.col("__h"))).select("key", "g", "copies", "nb", "t")
    found = dealt(shingled(texts, size), "g", F.col("nb"), "key", ["key", "copies", "shingles"]).mapInArrow(verify(threshold), "u binary, v binary, links long")
    found = materialise(found, "links")
    groups = connected_components(found)

    links = found.groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
    named = classes.select("key", "copies", "id", "own").join(groups.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = named.groupBy("component").agg(F.min("id").alias("class_id"), F.min("own").alias("first"), F.sum("copies").alias("class_size"))
    named = named.join(names, "component").select("key", "copies", "class_id", "class_size", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = each.select("id", "th", "key").join(named, "key", "left")
    whole = F.col("key").isNull()
    first = F.struct(F.when(whole, F.col("id")).otherwise(F.col("first.id")).alias("id"), F.when(whole, F.col("th")).otherwise(F.col("first.th")).alias("th"))
    more = [F.col("th").alias("__j_th"), first.alias("__j_first")] if text_hash else []
    return out.select(F.col("id").alias(id_col), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("class_size", F.lit(1)).alias("class_size"), *more)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y, k = m.n AND k = o.n AS copy FROM p JOIN n m ON x = m.doc_id JOIN n o ON y = o.doc_id WHERE 9 * k >= 4 * (m.n + o.n)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
g AS (SELECT x AS doc_id, min(y) AS class_id, count(*) AS class_size FROM r GROUP BY x)
SELECT g.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 0) + 1 AS n_copies, class_size
FROM g LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links, count(*) FILTER (WHERE copy) AS n_copies FROM l GROUP BY x) USING (doc_id)
"""
