import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlight.llm import decontam, jaccard, secrets
from tarnlight.llm.arrowtext import text_buffers, words
from tarnlight.llm.automaton import Automaton, parse
from tarnlight.llm.components import connected_components
from tarnlight.llm.scratch import shared_dir

SCHEMA = "doc_id long, text string"
VOCAB = ["The", "cat", "sat", "on", "mat", "é", "日本", "x1", "dog's", "RAN", "far", "away", "b", "c"]


def text(r, n):
    return " ".join(r.choice(VOCAB) + r.choice(["", ",", ".", "\n"]) for _ in range(n))


def test_word_keys_follow_the_pattern():
    import pyarrow as pa

    r = random.Random(0)
    texts = [text(r, r.randint(0, 30)) for _ in range(50)] + [None, "", "  ", "ABC abc", "a" * 5000]
    data, offs = text_buffers(pa.array(texts))
    keys, bounds = words(data, offs)
    known = {}
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        own = decontam.split_words(t)
        assert len(own) == b - a
        for w, k in zip(own, keys[a:b].tolist()):
            assert known.setdefault(w, k) == k
    assert len(set(known.values())) == len(known)


def brute_hits(docs, items, size=10):
    wins = defaultdict(set)
    for i, t in items:
        if i is not None:
            for w in decontam.item_windows(decontam.split_words(t), size):
                wins[w].add(str(i))
    out = []
    for k, t in docs:
        own, hit, met = decontam.split_words(t), set(), set()
        for w, ids in wins.items():
            for p in range(len(own) - len(w) + 1):
                if tuple(own[p : p + len(w)]) == w:
                    hit |= set(range(p, p + len(w)))
                    met |= ids
        out.append((k, len(own), len(hit), len(met), decontam.items_digest(list(met)), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontamination_equals_brute_force(spark, block):
    r = random.Random(1)
    items = [(i, text(r, r.choice([3, 8, 12, 25]))) for i in range(12)] + [(12, None), (13, ""), (None, "cat sat on mat"), (3, "far away far away"), (99, "dog's")]
    docs = [(i, text(r, r.randint(0, 60)) + " " + (items[r.randrange(12)][1] if r.random() < 0.5 else "")) for i in range(60)] + [(100, None), (101, ""), (5, "cat"), (5, "cat"), (None, items[0][1])]
    got = decontam.decontaminate(spark.createDataFrame(docs, SCHEMA + "").withColumn("n_hit", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    assert sorted(map(tuple, decontam.digest(got).collect()), key=str) == brute_hits(docs, items)


def test_decontamination_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert tuple(decontam.digest(decontam.decontaminate(docs, none)).first())[:4] == (1, 3, 0, 0)
    assert decontam.decontaminate(docs.limit(0), none).count() == 0


def test_automaton_agrees_with_re():
    r = random.Random(2)
    for p in ("ab+c?", "(a|bc)*d", "[a-c]{2,3}d", "(?i:ab)c", "a{2,}b|c", "x[^ab]y"):
        a, rx = Automaton([parse(p)], search=False), re.compile(p.encode())
        for _ in range(300):
            s = bytes(r.choice(b"abcdxyAB") for _ in range(r.randint(0, 8)))
            want = max((e for e in range(len(s) + 1) if rx.fullmatch(s[:e])), default=-1)
            assert a.longest(s, 0, len(s)) == (want if want else -1)


RX = {"assign": re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def brute_spans(t):
    out = []
    for k, (name, p) in enumerate(RX.items()):
        for m in p.finditer(t or ""):
            if len(m[2]) >= 6 if name == "assign" else len(m[0]) >= (20 if name == "access" else 24):
                out.append((m.start(), k, name, m.end()))
    return [(n, s, e) for s, _, n, e in sorted(out)]


def secret_texts():
    r = random.Random(3)
    bits = ["token", "Secret", "api_key", "APIKEY", "passwd", " ", "  ", "=", ":", '"', "'", "AKIA", "A1B2C3D4E5", "0123456789abcdef", "abcdef", "é", "x", "\n", ".", "-", "日", "PASSWORD"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(800)] + [None, "", "token=" + "a" * 20_000, "0" * 30_000]


def test_secret_scan_equals_regexes(spark):
    texts = secret_texts()
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "AKIA" + "A" * 16)], SCHEMA).withColumn("spans", F.lit(0))
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs)).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert got[i]["base_sha256"] == secrets.spans_digest(want), t
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(x[0] == n for x in want) for n in RX)


@pytest.mark.parametrize("rule", secrets.BASE + secrets.MORE, ids=lambda r: r.name)
def test_each_rule_equals_its_regex(rule):
    whole = re.compile(f"{rule.head}(?P<body>{rule.body + '+' if rule.body else ''})", re.ASCII)
    r = random.Random(rule.name)
    heads = {"assign": ["token=", "api_key: '", "Secret  ="], "access": ["AKIA"], "hex": [""], "hosting": ["ghp_", "ghx_", "gho_"], "chat": ["xoxb-", "xoxz-"], "payment": ["sk_live_", "rk_test_", "sk_dev_"], "cloud": ["AIza", "AIz"], "bearer": ["Bearer ", "bearer  ", "bearer"], "webtoken": ["eyJab.eyJcd.", "eyJ.eyJ.", "eyJa.eyJ"], "private_key": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN RSA2 PRIVATE KEY-----"]}[rule.name]
    bits = [*heads * 3, "a1B2", "0123456789abcdef", "ABCDEF0123", "-", "_", ".", "=", " ", "\n", "é", "日本", "z" * 9]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(2000)]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    found = secrets.scanner(secrets.BASE + secrets.MORE).spans(np.frombuffer(b"".join(data), np.uint8), offsets)
    k, hits = (secrets.BASE + secrets.MORE).index(rule), 0
    for t, spans in zip(texts, found):
        want = [m.span() for m in whole.finditer(t) if m[0] and len(m['body']) >= (rule.least if rule.body else 0)]
        assert [(s, e) for s, e, own in spans if own == k] == want, t
        hits += len(want)
    assert hits > 10


def test_several_rules_in_one_text_and_empty(spark):
    t = f"ghp_{'a' * 36} then Bearer {'x' * 24} -----BEGIN RSA PRIVATE KEY----- sk_live_{'9' * 20}"
    df = spark.createDataFrame([(1, t)], SCHEMA)
    want = [("hosting", "ghp_" + "a" * 36), ("hex", "a" * 36), ("bearer", "Bearer " + "x" * 24), ("private_key", "-----BEGIN RSA PRIVATE KEY-----"), ("payment", "sk_live_" + "9" * 20)]
    assert [(s["kind"], t[s["start"] : s["end"]]) for s in secrets.scan(df).first()["spans"]] == want
    assert secrets.scan(df.limit(0)).count() == 0


def test_long_stretch_without_resets_is_scanned():
    sc = secrets.scanner(secrets.BASE + secrets.MORE)
    data = ("a" * 50_000 + "token=abcdefghi").encode()
    assert (50_000, 50_015, 0) in sc.spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]


def brute_groups(docs, size=5, p=4, q=5):
    sets = []
    for _, t in docs:
        w = decontam.split_words(t)
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    near = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) * q >= p * len(a | b)] for i, a in enumerate(sets)]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [docs[j][0] for j in seen if docs[j][0] is not None]
        group[i] = (min(ids) if ids else None, len(near[i]), len(seen))
    return [(k, *g) for (k, _), g in zip(docs, group)]


def near_docs(r):
    docs, n = [], 0
    for _ in range(25):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([4, 9, 30, 80, 200]))]
        for _ in range(r.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                own[r.randrange(len(own))] = f"v{r.randrange(400)}"
            docs.append((n, " ".join(own).upper() if r.random() < 0.2 else ", ".join(own)))
            n += 1
    return docs


@pytest.mark.parametrize("seed", [0, 1])
def test_similarity_equals_brute_force(spark, seed):
    docs = near_docs(random.Random(seed)) + [(1000, None), (1001, ""), (1002, "!!"), (1003, "a b"), (1004, "A, b"), (7, "a b")]
    got = jaccard.similar_documents(spark.createDataFrame(docs, SCHEMA).withColumn("key", F.lit(1)))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["class_size"]) for r in got.collect()) == sorted(brute_groups(docs))


def test_similarity_in_blocks_equals_brute_force(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(90):
        own = list(base)
        own[r.randrange(150)] = f"u{i}"
        docs.append((i, " ".join(own)))
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    got = jaccard.similar_documents(spark.createDataFrame(docs, SCHEMA))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["class_size"]) for r in got.collect()) == sorted(brute_groups(docs))


def test_similarity_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (3, "a b c d e f g"), (None, None)], SCHEMA)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.similar_documents(df).collect()), key=str)
    assert got == sorted([(None, 3, 1), (3, 3, 1), (None, None, 0)], key=str)
    assert jaccard.similar_documents(df.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    from fractions import Fraction

    rng = np.random.default_rng(0)
    least = jaccard.least_matches(Fraction(4, 5), 1e-6)
    n = 20_000
    a = rng.integers(0, 256, (n, 64), dtype=np.uint8)
    same = rng.random((n, 64)) < 0.8
    b = np.where(same, a, rng.integers(0, 256, (n, 64), dtype=np.uint8))
    both = np.concatenate([a, b])
    i, _ = jaccard.likely_pairs(both, np.arange(n), np.arange(n) + n, least)
    assert len(i) >= n - 1
    far = np.where(rng.random((n, 64)) < 0.3, a, rng.integers(0, 256, (n, 64), dtype=np.uint8))
    i, _ = jaccard.likely_pairs(np.concatenate([a, far]), np.arange(n), np.arange(n) + n, least)
    assert len(i) < n / 1000


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(40)] + [(r.randrange(300, 340), r.randrange(300, 340)) for _ in range(25)] + [(7, 7), (None, 1)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in label}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_benchmark_blocks_are_bounded_by_bytes(spark):
    r = random.Random(9)
    items = [(i, text(r, 25)) for i in range(12)] + [(50, "w" * 5000)]
    docs = [(i, items[i][1]) for i in range(12)] + [(20, "x " + "w" * 5000)]
    source = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontam.Blocks(source, "item_id", "text", 10, 500_000, 2000))
    assert len(blocks) > 3 and all(len(b) == 1 or sum(sum(map(len, w)) + 4 * len(w) + sum(len(i) + 8 for i in ids) for w, ids in b.items()) <= 2100 for b in blocks)
    got = decontam.decontaminate(spark.createDataFrame(docs, SCHEMA).withColumn("hits", F.lit(1)).withColumn("n_words", F.lit(2)), source, carry=["doc_id", "hits", "n_words"], block_bytes=2000)
    assert sorted(map(tuple, decontam.digest(got).collect()), key=str) == brute_hits(docs, items)
    assert got.select("hits", "n_words").distinct().count() == 1


def test_salted_joins_lose_and_double_nothing(spark):
    from tarnlight.llm.scratch import Salts

    rows = [("hot", i) for i in range(300)] + [(f"k{i % 50}", i) for i in range(200)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k string, i int")
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    values = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c"), ("k7", "d"), ("none", "e")], "k string, v string")
    for share in (1, 3, 1000):
        salts = Salts(counts, "k", share=share, salts=5)
        left = salts.left(df, ["i"])
        assert left.where("k = 'hot'").select("__salt").distinct().count() == (1 if share == 1 else 5)
        got = left.join(salts.right(values), ["k", "__salt"]).select("k", "i", "v").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, df.join(values, "k").select("k", "i", "v").collect()))
        assert left.join(salts.right(values), ["k", "__salt"], "left_semi").count() == 308
