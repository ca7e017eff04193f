"""Vector bin packing of documents into training sequences (dot-product heuristic).

Every sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. Items are
remainders of documents; an open sequence takes, again and again, the item whose demand vector (tokens, one segment,
loss tokens, each as a share of its limit) has the largest dot product with what the sequence has left of each, among
those that fit whole. A document may be cut anywhere: an item that not even an empty sequence could hold begins one
with a cut piece, and what no item fits is filled with cut pieces, chosen by the dot product of what can be taken.
A sequence that nothing more fits, as its segments or loss tokens are used up, is cut into ones of power-of-two
lengths, which need no padding. Packing runs inside each input partition over a bounded buffer of items, so no row
is shuffled and a lost task can be repeated by itself; which pieces are together depends on the partitions.

Which tokens bear loss: those from a document's loss start on (a column), or all but the first `prompt_share` of its
tokens, the stand-in for the prompt of instruction data where a table has no such column.

Defined cases: a null or empty text is the end id alone; a null id is carried as null; repeated rows are
packed once each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scratch import ship, spread
from .tokens import EOS_ID, default_tokenizer, encoder

OUT = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "sequence_tokens")


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 8
    loss_tokens: int = 1664
    buffer: int = 1024  # items weighed at a time


#: No loss limit of its own: every token may bear loss.
TOKENS_ONLY = Limits(segments=64, loss_tokens=2048)


class Packer:
    """Packs a stream of documents; `closed` holds the pieces of finished sequences."""

    def __init__(self, limits: Limits, first_sequence: int = 0):
        self.lim = limits
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=float)
        self.next_id = first_sequence
        self.docs: list[tuple] = []  # (id, ids, loss_start) of each buffered item
        self.spans: list[tuple[int, int]] = []  # its start and end
        self.closed: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        """pieces: (document, start, end), in order."""
        used = sum(e - s for _, s, e in pieces)
        at = 0
        for (key, ids, loss_start), s, e in pieces:
            crc = zlib.crc32(ids[s:e].astype("<u4").tobytes())
            self.closed.append((key, s, e - s, crc, len(ids), self.next_id, at, max(0, e - max(s, loss_start)), used))
            at += e - s
        self.next_id += 1

    def add(self, key, ids: np.ndarray, loss_start: int) -> None:
        self.docs.append((key, ids, loss_start))
        self.spans.append((0, len(ids)))
        if len(self.docs) >= 2 * self.lim.buffer:
            self.pack(keep=self.lim.buffer)

    def score(self, have: np.ndarray, size: np.ndarray, loss: np.ndarray) -> np.ndarray:
        """The dot product of demands and what is left, each as a share of its limit."""
        left = have / self.cap
        return size * (left[0] / self.cap[0]) + left[1] / self.cap[1] + loss * (left[2] / self.cap[2])

    def pack(self, keep: int = 0) -> None:
        """Fill sequences until at most `keep` items wait; with keep = 0 all items are placed."""
        docs, span = self.docs, np.array(self.spans, np.int64).reshape(-1, 2)
        loss_start = np.array([d[2] for d in docs], np.int64)
        size = span[:, 1] - span[:, 0]
        free = np.clip(loss_start - span[:, 0], 0, size)  # tokens before the first that bears loss
        left = len(docs)
        most = np.array([self.lim.tokens, self.lim.segments, self.lim.loss_tokens], np.int64)
        while left > keep:
            have, pieces = most.copy(), []
            while have[0] > 0 and have[1] > 0 and left:
                loss = size - free
                take = np.minimum(np.minimum(size, have[0]), free + have[2])
                whole = (take == size) & (size > 0)
                large = (size > most[0]) | (loss > most[2])
                if not pieces and large.any():
                    pool = large
                elif have[1] == 1:  # the last piece should fill the sequence
                    pool = take == have[0]
                    pool = pool & whole if (pool & whole).any() else pool
                else:
                    pool = whole
                if not pool.any():
                    pool = take > 0
                    if not pool.any():
                        break
                i = int(np.argmax(np.where(pool, self.score(have, take, np.maximum(0, take - free)), -1.0)))
                n, s = int(take[i]), int(span[i, 0])
                pieces.append((docs[i], s, s + n))
                have -= (n, 1, max(0, n - int(free[i])))
                span[i, 0] += n
                size[i] -= n
                free[i] = max(0, int(free[i]) - n)
                left -= size[i] == 0
            if have[0] > 0:
                self.split(pieces)
            else:
                self.close(pieces)
        alive = size > 0
        self.docs = [d for d, a in zip(docs, alive) if a]
        self.spans = [(int(a), int(b)) for a, b in span[alive]]

    def split(self, pieces: list[tuple]) -> None:
        """An unfilled sequence becomes sequences of power-of-two lengths, which need no padding."""
        total = sum(e - s for _, s, e in pieces)
        while total:
            want, part = 1 << (total.bit_length() - 1), []
            total -= want
            while want:
                doc, s, e = pieces.pop(0)
                if e - s > want:
                    pieces.insert(0, (doc, s + want, e))
                    e = s + want
                part.append((doc, s, e))
                want -= e - s
            self.close(part)


def pack_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", loss_start_col: str | None = None, prompt_share: float = 0.25, limits: Limits = Limits(), tokenizer: str | None = None, eos_id: int = EOS_ID
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens,
    sequence_tokens. loss_start_col: the token position from which a document's tokens bear loss (null: 0); without
    it, that is the first `prompt_share` of its tokens, rounded down."""
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    loss = F.coalesce(F.col(f"`{loss_start_col}`").cast("long"), F.lit(0)) if loss_start_col else F.lit(-1).cast("long")
    source = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"), loss.alias("l"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in OUT])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, p = encoder(path), Packer(limits, TaskContext.get().partitionId() << 36)

        def out() -> pa.RecordBatch:
            rows, p.closed = p.closed, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for k, t, at in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.append(enc.ids(t), np.int32(eos_id))
                p.add(k, ids, max(0, at) if loss_start_col else int(len(ids) * prompt_share))
            if len(p.closed) >= 1000:
                yield out()
        if p.docs:
            p.pack()
        if p.closed:
            yield out()

    return spread(source).mapInArrow(run, schema)
