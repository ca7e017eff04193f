"""Token sequences in training order, as fixed-stride binary shards.

1. Documents are encoded and cut into sequences of `stride` ids inside each partition; the last one of a
   partition is padded. They are written once to the shared folder, so later steps read the same rows.
2. Sequences are numbered 0..N-1 by partition counts: one count for each partition reaches the driver, and their
   running total goes back as a table of that many rows, broadcast up to `BROADCAST_PARTS` of them.
3. A keyed Feistel permutation of the smallest even-bit domain over N, walked until it lands below N, gives
   each sequence its slot in training order: a bijection without a sort key column or a shuffle of its own.
4. Slots are range-partitioned by shard, by bounds that N gives without a sample, and sorted; each shard is `shard_sequences` sequences of `stride`
   little-endian ids, so sequence k of a shard begins at byte k * stride * width. In the shuffle ids are packed.
5. Each shard is written as a file and the digest is taken from the files as a reader finds them: it goes through
   them in order and can begin at any slot, as a slot alone says the file and the byte.

Defined cases: a null or empty text is the end id alone; repeated rows are written once each; other columns
are ignored; an empty table gives no sequence and no shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix
from .scratch import drop_at_end, shared_dir, ship, spread
from .tokens import EOS_ID, default_tokenizer, encoder


BROADCAST_PARTS = 1_000_000  # rows of two numbers in the table of first sequence numbers that is broadcast


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Slot of each index: a keyed permutation of 0..n-1."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    with np.errstate(over="ignore"):
        keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

        def once(x: np.ndarray) -> np.ndarray:
            left, right = x >> np.uint64(half), x & mask
            for k in keys:
                left, right = right, left ^ (mix(right + k) & mask)
            return (left << np.uint64(half)) | right

        out = once(np.asarray(index).astype(np.uint64))
        while (far := out >= np.uint64(n)).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def sequences(docs: DataFrame, *, text_col: str = "text", stride: int = 2048, tokenizer: str | None = None, eos_id: int = EOS_ID) -> DataFrame:
    """part, local (number in the partition), n_tokens (before padding), ids (binary)."""
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, made = encoder(path), TaskContext.get().partitionId(), 0
        width = "<u2" if len(enc.byte_lengths) <= 1 << 16 else "<u4"
        rest = np.zeros(0, width)

        def rows(ids: np.ndarray, used: list[int]) -> pa.RecordBatch:
            size = stride * ids.itemsize
            raw = pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(np.arange(0, size * len(used) + 1, size, dtype=np.int32)), pa.py_buffer(ids.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array([part] * len(used), pa.int64()), pa.array(range(made, made + len(used)), pa.int64()), pa.array(used, pa.int64()), raw], names=["part", "local", "n_tokens", "ids"])

        for batch in batches:
            ids = [rest]
            for t in batch.column(0).to_pylist():
                ids += [enc.ids(t).astype(width), np.array([eos_id], width)]
            flat = np.concatenate(ids)
            full = len(flat) // stride
            for a in range(0, full, 4096):
                b = min(full, a + 4096)
                yield rows(flat[a * stride : b * stride], [stride] * (b - a))
                made += b - a
            rest = flat[full * stride :].copy()
        if len(rest):
            yield rows(np.concatenate([rest, np.full(stride - len(rest), eos_id, width)]), [len(rest)])

    return spread(docs.select(F.col(text_col).cast("string").alias("t"))).mapInArrow(run, "part long, local long, n_tokens long, ids binary")


def pack(ids: list[bytes]) -> list[bytes]:
    """Each sequence's ids compressed by themselves, as the shuffle's own codec leaves them a third larger."""
    codec = pa.Codec("zstd", 3)
    return [codec.compress(x, asbytes=True) for x in ids]


def ordered(docs: DataFrame, *, key: int = 20240229, shard_sequences: int = 256, **options) -> DataFrame:
    """shard, slot, n_tokens, n_bytes, packed (ids): range-partitioned by shard and sorted by slot."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tarnlight-sequences-{uuid.uuid4().hex}"
    made = sequences(docs, **options)
    made.write.option("compression", "zstd").parquet(path)
    drop_at_end(spark, path)
    made = spark.read.schema(made.schema).parquet(path)
    counts = sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    total, first = 0, []
    for part, n in counts:
        first.append((part, total))
        total += n
    n_shards = -(-total // shard_sequences)
    n = max(1, min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bases = spark.createDataFrame(first, "part long, base long")
    numbered = made.join(F.broadcast(bases) if len(first) <= BROADCAST_PARTS else bases, "part").select((F.col("base") + F.col("local")).alias("number"), "n_tokens", "ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, n_tokens, ids = batch.columns
            slot = feistel(number.to_numpy(), total, key)
            shard, ids = slot // shard_sequences, ids.to_pylist()
            yield pa.RecordBatch.from_pydict({"range": pa.array(shard * n // max(1, n_shards), pa.int32()), "shard": shard, "slot": slot, "n_tokens": n_tokens, "n_bytes": pa.array(map(len, ids), pa.int64()), "packed": pa.array(pack(ids), pa.binary())})

    placed = numbered.mapInArrow(place, "range int, shard long, slot long, n_tokens long, n_bytes long, packed binary")
    return placed.repartitionById(n, F.col("range")).sortWithinPartitions("slot").drop("range")


def shard_blobs(seqs: DataFrame) -> DataFrame:
    """One row for each shard of ordered(): shard, first_slot, n_sequences, n_tokens, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, codec = None, [], pa.Codec("zstd")

        def out() -> pa.RecordBatch:
            slots = [r[0] for r in rows]
            assert slots == list(range(slots[0], slots[0] + len(slots))), "a shard's slots must be contiguous"
            return pa.RecordBatch.from_pydict({"shard": [now], "first_slot": [slots[0]], "n_sequences": [len(rows)], "n_tokens": [sum(r[1] for r in rows)], "payload": pa.array([b"".join(codec.decompress(r[3], r[2], asbytes=True) for r in rows)], pa.binary())})

        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now and rows:
                    yield out()
                    rows = []
                now = shard
                rows.append(row)
        if rows:
            yield out()

    return seqs.mapInArrow(run, "shard long, first_slot long, n_sequences long, n_tokens long, payload binary")


def write_shards(blobs: DataFrame, uri: str) -> DataFrame:
    """Write each shard to uri/shard-NNNNNNNN.bin and return the manifest (shard, first_slot, n_sequences, n_tokens,
    n_bytes, crc32). A file appears under its name only when whole; one that is there with its full size and the
    same checksum is left, so an interrupted job can be run again. uri: a place all executors can write to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                data = row.pop("payload")
                path = f"{root}/shard-{row['shard']:08d}.bin"
                info = fs.get_file_info(path)
                crc = zlib.crc32(data)
                whole = info.type == pafs.FileType.File and info.size == len(data)
                if whole:
                    with fs.open_input_stream(path) as f:
                        whole = zlib.crc32(f.read()) == crc
                if not whole:
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(part) as f:
                        f.write(data)
                    fs.move(part, path)
                yield pa.RecordBatch.from_pylist([row | {"n_bytes": len(data), "crc32": crc}])

    return blobs.mapInArrow(run, "shard long, first_slot long, n_sequences long, n_tokens long, n_bytes long, crc32 long")


def read_shard(fs, path: str, size: int, first: int = 0) -> Iterator[bytes]:
    """The sequences (of `size` bytes) of one shard in order, beginning with number `first`."""
    with fs.open_input_file(path) as f:
        if f.size() % size:
            raise ValueError(f"{path} is not of whole sequences")
        f.seek(first * size)
        while data := f.read(size):
            yield data


def read_sequences(uri: str, size: int, shard_sequences: int = 256, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(slot, ids) of all shards of write_shards in training order from slot `start` on; a reader that was stopped
    goes on with the slot after its last one. A shard that is missing or short, other than the last, is an error."""
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(uri)
    files = {f.base_name: f.size for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".bin")}
    names = [f"shard-{k:08d}.bin" for k in range(len(files))]
    if files.keys() != set(names) or any(files[n] != size * shard_sequences for n in names[:-1]):
        raise ValueError(f"{uri} has missing or short shards")
    for k in range(start // shard_sequences, len(names)):
        first = max(0, start - k * shard_sequences)
        for i, data in enumerate(read_shard(fs, f"{root}/{names[k]}", size, first), k * shard_sequences + first):
            yield i, data


def written_digest(manifest: DataFrame, uri: str) -> DataFrame:
    """The columns of sequence_digest, read back from the files that write_shards reports in the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for r in batch.to_pylist():
                n, size, whole, crcs = r["n_sequences"], r["n_bytes"] // r["n_sequences"], 0, []
                for data in read_shard(fs, f"{root}/shard-{r['shard']:08d}.bin", size):
                    crcs.append(zlib.crc32(data))
                    whole = zlib.crc32(data, whole)
                if len(crcs) != n or whole != r["crc32"]:
                    raise ValueError(f"shard {r['shard']} is not as written")
                yield pa.RecordBatch.from_pydict({"slot": [r["first_slot"] + i for i in range(n)], "shard": [r["shard"]] * n, "byte_offset": [i * size for i in range(n)], "n_bytes": [size] * n, "ids_crc32": crcs})

    return manifest.mapInArrow(run, "slot long, shard long, byte_offset long, n_bytes long, ids_crc32 long")


def sequence_digest(blobs: DataFrame, stride: int = 2048) -> DataFrame:
    """One row for each sequence of the shards: slot, shard, byte_offset, n_bytes, ids_crc32 (of the payload's bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data, n = r["payload"], r["n_sequences"]
                size = len(data) // n
                at = range(0, len(data), size)
                yield pa.RecordBatch.from_pydict({"slot": [r["first_slot"] + i for i in range(n)], "shard": [r["shard"]] * n, "byte_offset": list(at), "n_bytes": [size] * n, "ids_crc32": [zlib.crc32(data[a : a + size]) for a in at]})

    return blobs.mapInArrow(run, "slot long, shard long, byte_offset long, n_bytes long, ids_crc32 long")
