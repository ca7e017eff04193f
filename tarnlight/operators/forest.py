"""Isolation forest (Liu, Ting and Zhou, 2008): fitted on a bounded sample, scored on every row by its workers."""

from __future__ import annotations


from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import number

#: Trees, rows of a tree's sample, seed.
TREES, SAMPLE, SEED = 300, 256, 42
EULER = 0.5772156649015329


def path_constant(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


BLOCK = 4096  # rows scored together, so that their values stay in the processor's cache


@dataclass
class Forest:
    """Trees as full binary trees of one depth: node k has children 2k + 1 and 2k + 2.

    Where a tree ends early, its nodes below split on nothing and all lead to the same path length.
    """

    columns: list[str]
    sample: int
    column: np.ndarray  # tree, node: the column it splits on
    value: np.ndarray  # tree, node: values up to it go left
    length: np.ndarray  # tree, leaf: path length

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """In (0, 1]: the higher, the more isolated."""
        inner = self.column.shape[1]
        levels = (inner + 1).bit_length() - 1
        out = np.empty(len(rows))
        for a in range(0, len(rows), BLOCK):
            part = np.ascontiguousarray(rows[a : a + BLOCK].T)
            n = part.shape[1]
            flat, at = part.ravel(), np.arange(n)
            total = np.zeros(n)
            for column, value, length in zip(self.column * n, self.value, self.length):
                node = np.zeros(n, np.int64)
                for _ in range(levels):
                    right = flat.take(column.take(node) + at) > value.take(node)
                    node = 2 * node + 1 + right
                total += length.take(node - inner)
            out[a : a + BLOCK] = total
        return 2.0 ** (-out / len(self.column) / max(float(path_constant(self.sample)), 1e-12))


def grow(data: np.ndarray, columns: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(sample, len(data))
    limit = int(np.ceil(np.log2(max(size, 2))))
    inner = 2**limit - 1
    column, value, length = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        todo = [(data[rng.choice(len(data), size, replace=False)], 0, 0)]
        while todo:
            rows, depth, at = todo.pop()
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
            if depth >= limit or not len(spread):
                # the leaves below node `at`, all at the last level
                first = (at + 1) * 2 ** (limit - depth) - 1 - inner
                length[t, first : first + 2 ** (limit - depth)] = depth + float(path_constant(len(rows)))
                continue
            c = int(rng.choice(spread))
            v = float(rng.uniform(rows[:, c].min(), rows[:, c].max()))
            column[t, at], value[t, at] = c, v
            low = rows[:, c] <= v
            todo += [(rows[low], depth + 1, 2 * at + 1), (rows[~low], depth + 1, 2 * at + 2)]
    return Forest(columns, size, column, value, length)


def fit_forest(complete: DataFrame, columns: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest over at most trees * sample rows, those with the lowest hash of their values: the same on every run."""
    rows = complete.select(*(number(c).alias(f"x{i}") for i, c in enumerate(columns)))
    rows = rows.orderBy(F.xxhash64(*rows.columns, F.lit(seed)), *rows.columns).limit(trees * sample)
    return grow(np.array([tuple(r) for r in rows.collect()], dtype=float), columns, trees, sample, seed)


def score(df: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """df with the score of each row that is complete in the forest's columns, else null."""
    sent = df.sparkSession.sparkContext.broadcast(forest)  # of fixed size: trees and sample bound its nodes
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    @F.pandas_udf(DoubleType())
    def scored(*columns: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
        out = np.full(len(rows), np.nan)
        full = ~np.isnan(rows).any(axis=1)
        if full.any():
            out[full] = sent.value.scores(rows[full])
        return pd.Series(out).where(full, None)

    return df.withColumn(name, F.nanvl(scored(*(number(c) for c in forest.columns)), F.lit(None).cast("double"))).select(*schema.names)
