"""Every operator over documents on the same awkward rows: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

import pytest

from tarnlight.llm import attribution, decontam, jaccard, linedup, packing, quality, secrets, shards

CLASH = "doc_id long, text string, lang string, source string, k int, t string, h string, n int, g string, i int, `key` string, c string, slot long, kept string, spans string, run int, `a.b` int"
r = random.Random(12)
LONG = "\n".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(200)) for _ in range(600))
TEXTS = [(1, "alpha beta gamma " * 8), (1, "alpha beta gamma " * 8), (2, None), (3, ""), (None, "alpha beta gamma " * 8), (None, None), (4, LONG), (5, LONG), (6, "x" * 200_000), (7, "\n" * 5000), (8, "日本語 é " * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None, 1, "t", "h", 2, "g", 3, "key", "c", 4, "kept", "spans", 5, 6) for i, t in TEXTS]
    return spark.createDataFrame(rows, CLASH)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


ALL = sorted((i for i, _ in TEXTS), key=str)


def test_packing(docs):
    rows = packing.pack_documents(docs).collect()
    for i in (1, 4, 5, 6, 7, 8):
        copies = sum(k == i for k, _ in TEXTS)
        assert sum(x["length"] for x in rows if x["doc_id"] == i) == copies * next(x["doc_tokens"] for x in rows if x["doc_id"] == i)
    assert {x["doc_tokens"] for x in rows if x["doc_id"] in (2, 3)} == {1}


def test_token_counts(docs):
    rows = attribution.attribute_tokens(docs).collect()
    assert {x["doc_id"] for x in rows} == {i for i, _ in TEXTS}
    long = [x for x in rows if x["doc_id"] == 4]
    assert sum(x["n_tokens"] for x in long) == long[0]["doc_tokens"] > 100_000


def test_decontamination(spark, docs):
    words = LONG.split()
    bench = spark.createDataFrame([(1, " ".join(words[50_000:50_030])), (None, "alpha beta gamma"), (2, None), (3, "")], "item_id long, text string")
    rows = {(x["doc_id"], x["n_hit"], x["n_items"]) for x in decontam.digest(decontam.decontaminate(docs, bench, carry=[c for c in docs.columns if c != "text"])).collect()}
    assert {(4, 30, 1), (5, 30, 1), (1, 0, 0), (2, 0, 0)} <= rows


def test_secrets(docs):
    assert ids(secrets.scan(docs)) == ALL


def test_quality(docs):
    got = quality.judge(docs)
    assert ids(got) == ALL and set(docs.columns) <= set(got.columns)
    assert {x["doc_id"] for x in got.where("__q_n_words = 0").collect()} == {2, 3, 7, None}


def test_similarity(docs):
    rows = jaccard.similar_documents(docs, text_hash=True).collect()
    assert sorted((x["doc_id"] for x in rows), key=str) == ALL
    assert {(x["doc_id"], x["class_id"], x["n_links"]) for x in rows} >= {(1, 1, 2), (5, 4, 1), (4, 4, 1), (2, 2, 0), (7, 7, 0)}


def test_lines(docs):
    done = linedup.dedup_lines(docs)
    rows = done.collect()
    assert sorted((x["doc_id"] for x in rows), key=str) == ALL and set(docs.columns) <= set(done.columns)
    assert {x["doc_id"]: x["text"] for x in rows if x["doc_id"] in (4, 5)} == {4: LONG, 5: ""} and next(x["text"] for x in rows if x["doc_id"] == 7) == "\n" * 5000


def test_training_order(docs):
    rows = shards.shard_blobs(shards.ordered(docs, stride=512, shard_sequences=64)).collect()
    assert sum(x["n_tokens"] for x in rows) == packing.pack_documents(docs).groupBy().sum("length").first()[0]
