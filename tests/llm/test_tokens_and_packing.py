import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlight.llm import attribution, packing, shards
from tarnlight.llm.packing import Limits, Packer
from tarnlight.llm.tokens import default_tokenizer, encoder

ENC = encoder(default_tokenizer())
SCHEMA = "doc_id long, text string"


def slow(text):
    return ENC.slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_fast_ids_equal_the_tokenizers_ids(text):
    assert ENC.ids(text).tolist() == slow(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_any_text_and_its_bytes(text):
    ids = ENC.ids(text)
    assert ids.tolist() == slow(text) and ENC.byte_lengths[ids].sum() == len(text.encode())


def test_special_form():
    assert ENC.ids("a<|endoftext|>b").tolist() == slow("a<|endoftext|>b")


DOCS = [(1, "one two three " * 900), (2, None), (3, ""), (4, "short"), (4, "short"), (None, "no id"), (5, "é日本語 " * 300)] + [(i, f"document {i} " * (i % 37)) for i in range(6, 200)]


def check_packing(rows, docs, limits):
    texts = {}
    for k, t in docs:
        texts.setdefault(k, []).append(np.append(ENC.ids(t), 1))
    sequences = {}
    for r in rows:
        ids = texts[r["doc_id"]][0]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        at = 0
        for r in parts:
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(parts) <= limits.segments and sum(r["loss_tokens"] for r in parts) <= limits.loss_tokens
        assert all(r["sequence_tokens"] == at for r in parts)
    for k, copies in texts.items():
        spans = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == k)
        assert sum(n for _, n in spans) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for s, n in spans:
                assert s == at
                at += n
    return sequences


def test_packing_places_each_id_once(spark):
    rows = packing.pack_documents(spark.createDataFrame(DOCS, SCHEMA)).collect()
    sequences = check_packing(rows, DOCS, Limits())
    sizes = [sum(r["length"] for r in p) for p in sequences.values()]
    assert not [n for n in sizes if n & (n - 1)]  # no padding
    for n in (1, 3, 40):
        rows = packing.pack_documents(spark.createDataFrame(DOCS, SCHEMA).repartition(n)).collect()
        assert not [r for r in rows if r["sequence_tokens"] & (r["sequence_tokens"] - 1)]
        check_packing(rows, DOCS, Limits())


def brute_pack(items, lim, largest=False):
    """(key, start, length, sequence, offset) of items (key, tokens, loss start), one candidate at a time."""
    todo = [[k, 0, n, at] for k, n, at in items]
    most, out, number = (lim.tokens, lim.segments, lim.loss_tokens), [], 0

    def cut(x, have):
        """Tokens that can be taken, and those of them that bear loss."""
        n = 0
        while n < x[2] - x[1] and n < have[0] and max(0, x[1] + n + 1 - max(x[1], x[3])) <= have[2]:
            n += 1
        return n, max(0, x[1] + n - max(x[1], x[3]))

    def whole(x, have):
        return cut(x, have)[0] == x[2] - x[1]

    while todo:
        have, pieces = list(most), []
        while have[0] and have[1] and todo:
            pool = [x for x in todo if not whole(x, most)] if not pieces else []
            if not pool and have[1] == 1:
                pool = [x for x in todo if cut(x, have)[0] == have[0]]
                pool = [x for x in pool if whole(x, have)] or pool
            elif not pool:
                pool = [x for x in todo if whole(x, have)]
            pool = pool or [x for x in todo if cut(x, have)[0]]
            if not pool:
                break
            left = [h / m for h, m in zip(have, most)]
            points = lambda n, loss: n if largest else n * (left[0] / most[0]) + left[1] / most[1] + loss * (left[2] / most[2])
            x = max(pool, key=lambda x: points(*cut(x, have)))
            n, loss = cut(x, have)
            pieces.append([x[0], x[1], n])
            have = [have[0] - n, have[1] - 1, have[2] - loss]
            x[1] += n
            todo = [y for y in todo if y[1] < y[2]]
        total = sum(n for *_, n in pieces)
        sizes = [total] if not have[0] else [1 << b for b in range(30, -1, -1) if total >> b & 1]
        for size in sizes:
            at = 0
            while at < size:
                k, start, n = pieces.pop(0)
                if n > size - at:
                    pieces.insert(0, [k, start + size - at, n - size + at])
                    n = size - at
                out.append((k, start, n, number, at))
                at += n
            number += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_brute_force(seed):
    r = random.Random(seed)
    lim = Limits(tokens=r.choice([16, 40, 64]), segments=r.choice([2, 3, 6]), loss_tokens=r.choice([8, 12, 16]), buffer=1000)
    items = [(i, n, r.choice([0, n // 4, n // 2, n, n + 5])) for i in range(40) for n in [r.choice([1, 2, 5, 9, 17, 30, 90])]]
    p = Packer(lim)
    for k, n, at in items:
        p.add(k, np.zeros(n, np.int32), at)
    p.pack()
    assert [(c[0], c[1], c[2], c[5], c[6]) for c in p.closed] == brute_pack(items, lim)


def test_the_dot_product_decides_and_packs_better():
    class LargestFirst(Packer):
        def score(self, have, size, loss):
            return size

    texts = [r for _, r in DOCS] + [f"more text {i} " * (i * 7 % 90) for i in range(400)]
    made = {}
    for kind in (Packer, LargestFirst):
        p = kind(Limits(tokens=256, segments=6, loss_tokens=208))
        for i, t in enumerate(texts):
            ids = np.append(ENC.ids(t), np.int32(1))
            p.add(i, ids, len(ids) // 4)
        p.pack()
        made[kind] = [(c[0], c[1], c[5]) for c in p.closed]
    assert made[Packer] != made[LargestFirst]
    assert made[Packer][-1][2] < made[LargestFirst][-1][2]  # fewer sequences


def test_prompt_share_and_loss_column(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta " * 30, 7), (2, None, None), (3, "x", -5)], SCHEMA + ", `at.x` int")
    for options, start in (({}, lambda n: int(n * 0.25)), ({"prompt_share": 0.5}, lambda n: n // 2)):
        for r in packing.pack_documents(df, **options).collect():
            assert r["loss_tokens"] == max(0, r["start"] + r["length"] - max(r["start"], start(r["doc_tokens"])))
    got = {r["doc_id"]: r["loss_tokens"] for r in packing.pack_documents(df, loss_start_col="at.x").groupBy("doc_id").sum("loss_tokens").withColumnRenamed("sum(loss_tokens)", "loss_tokens").collect()}
    assert got == {1: len(ENC.ids("alpha beta gamma delta " * 30)) + 1 - 7, 2: 1, 3: 2}


def test_packing_limits_bind(spark):
    limits = Limits(tokens=256, segments=3, loss_tokens=100, buffer=16)
    docs = spark.createDataFrame([(k, t, 40) for k, t in DOCS], SCHEMA + ", prompt int")
    rows = packing.pack_documents(docs, loss_start_col="prompt", limits=limits).collect()
    check_packing(rows, DOCS, limits)
    assert all(r["loss_tokens"] == max(0, r["start"] + r["length"] - max(r["start"], 40)) for r in rows)


def test_packing_fits_well_without_cutting():
    r = random.Random(0)
    p = Packer(Limits(tokens=100, segments=10, loss_tokens=100, buffer=64))
    for i in range(500):
        p.add(i, np.zeros(r.randint(1, 60), np.int32), 0)
    p.pack()
    used = {x[5]: x[8] for x in p.closed}
    assert sum(used.values()) / sum(100 if n & (n - 1) else n for n in used.values()) > 0.97


def test_packing_empty_table_and_clashing_columns(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, start int, `k` int")
    assert packing.pack_documents(df).first()["start"] == 0


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_equals_brute_force(spark, rule):
    docs = [(1, "Title here\nbody of the  text\n\nmore"), (2, "日本\n語é x"), (3, None), (4, ""), (5, "\n\n"), (None, "x")]
    got = {(r["doc_id"], r["section_no"]): r for r in attribution.attribute_tokens(spark.createDataFrame(docs, SCHEMA), sections=attribution.lines, rule=rule).collect()}
    for k, t in docs:
        t = t or ""
        parts = attribution.lines(t)
        want = [0] * len(parts)
        for a, b in ENC.slow.encode(t, add_special_tokens=False).offsets:
            share = [sum(s <= c < e for c in range(a, b)) for _, s, e in parts]
            where = [i for i, n in enumerate(share) if n]
            want[{"first": where[0], "last": where[-1], "majority": share.index(max(share))}[rule]] += 1
        assert [got[k, i]["n_tokens"] for i in range(len(parts))] == want
        assert sum(want) == got[k, 0]["doc_tokens"]


def test_attribution_gaps_and_empty(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma")], SCHEMA)
    got = {r["section"]: r["n_tokens"] for r in attribution.attribute_tokens(df, sections=lambda t: [("mid", 6, 10)]).collect()}
    assert got["mid"] + got[None] == len(ENC.ids("alpha beta gamma"))
    assert attribution.attribute_tokens(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_keyed_permutation(n):
    out = shards.feistel(np.arange(n), n, 7)
    assert sorted(out.tolist()) == list(range(n))
    if n > 50:
        assert out.tolist() != shards.feistel(np.arange(n), n, 8).tolist() and out.tolist() != list(range(n))


def test_shards_round_trip_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i} " * (i % 50)) for i in range(300)] + [(1, None), (1, "")], SCHEMA).repartition(3)
    stride = 64
    blobs = shards.shard_blobs(shards.ordered(df, stride=stride, shard_sequences=16)).cache()
    manifest = shards.write_shards(blobs, f"file://{tmp_path}").collect()
    first = {r["shard"]: (tmp_path / f"shard-{r['shard']:08d}.bin").stat().st_mtime_ns for r in manifest}
    (tmp_path / "shard-00000000.bin").write_bytes(b"broken")
    again = shards.write_shards(blobs, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, manifest)) == sorted(map(tuple, again))
    assert {s for s, t in first.items() if (tmp_path / f"shard-{s:08d}.bin").stat().st_mtime_ns != t} == {0}
    assert [r["first_slot"] for r in sorted(manifest)] == [16 * i for i in range(len(manifest))]
    found = []
    for r in sorted(manifest):
        data = np.frombuffer((tmp_path / f"shard-{r['shard']:08d}.bin").read_bytes(), "<u2")
        assert len(data) == r["n_sequences"] * stride and zlib.crc32(data.tobytes()) == r["crc32"]
        found += data.reshape(-1, stride).tolist()
    made = [np.frombuffer(r["ids"], "<u2").tolist() for r in shards.sequences(df, stride=stride).collect()]
    assert sorted(found) == sorted(made) and found != made
    total = sum(r["n_tokens"] for r in manifest)
    assert total == sum(len(ENC.ids(t)) + 1 for _, t in df.collect())
    digest = shards.sequence_digest(blobs).collect()
    assert sorted(r["slot"] for r in digest) == list(range(len(found)))


@pytest.mark.parametrize("broadcast", [True, False])
def test_each_slot_holds_the_sequence_that_the_permutation_sends_there(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(shards, "BROADCAST_PARTS", 0)
    docs = [(i, f"text number {i} " * (i * 13 % 60), 1, "x") for i in range(200)] + [(None, None, None, None), (1, "日本語 " * 500, 2, "y")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(docs, 5), "doc_id long, text string, slot long, ids string")
    stride, key = 32, 99
    # brute force: the documents of each partition one after another, cut at every stride, the last padded
    flat = []
    for k in range(5):
        ids = [x for r in df.where(F.spark_partition_id() == k).collect() for x in [*ENC.slow.encode(r["text"] or "", add_special_tokens=False).ids, 1]]
        flat += [(ids[a : a + stride] + [1] * stride)[:stride] for a in range(0, len(ids), stride)]
    want = dict(zip(shards.feistel(np.arange(len(flat)), len(flat), key).tolist(), flat))
    monkeypatch.setattr(shards, "spread", lambda x: x)
    rows = shards.ordered(df, stride=stride, shard_sequences=8, key=key)
    got = {r["first_slot"] + i: np.frombuffer(r["payload"], "<u2").reshape(-1, stride)[i].tolist() for r in shards.shard_blobs(rows).collect() for i in range(r["n_sequences"])}
    assert got == want


def test_shards_of_an_empty_table(spark):
    assert shards.shard_blobs(shards.ordered(spark.createDataFrame([], SCHEMA))).count() == 0


def test_training_order_query_writes_shards(spark):
    from tarnlight.llm import registry
    from tarnlight.llm.scratch import shared_dir

    base = "/root/testdata/sf0.001"
    made = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("training-order-*"))
    before = made()
    digest = sorted(registry.op9_training_order(spark, base).collect())
    (folder,) = made() - before
    blobs = shards.shard_blobs(shards.ordered(spark.read.parquet(f"{base}/documents.parquet")))
    assert digest == sorted(shards.sequence_digest(blobs).collect())
    read = list(shards.read_sequences(str(folder), 4096))
    assert [(i, zlib.crc32(x)) for i, x in read] == [(r["slot"], r["ids_crc32"]) for r in digest]
    for start in (1, 256, len(read) - 1, len(read)):
        assert list(shards.read_sequences(str(folder), 4096, start=start)) == read[start:]
    last = max(folder.glob("*.bin"))
    last.write_bytes(last.read_bytes()[:-1])
    with pytest.raises(ValueError):
        list(shards.read_sequences(str(folder), 4096))
