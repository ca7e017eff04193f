import corpus_pipeline
import pytest

from tarnlight.llm import decontam, packing, registry
from tests.llm.test_filters import brute_dedup, brute_kept
from tests.llm.test_matching import brute_groups, brute_hits
from tests.llm.test_tokens_and_packing import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).write.parquet(str(folder / name))
        made = spark.read.parquet(str(folder / name))
        out[name] = (docs, made)
        docs = made
    return out


def test_stages_keep_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "benchmark_decontamination", "packing"]
    assert all(made.columns == columns for n, (_, made) in stages.items() if n != "packing")


def test_quality_stage(stages):
    docs, made = stages["quality_rules"]
    want = brute_kept([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()])
    assert sorted(r["doc_id"] for r in made.collect()) == sorted(want)


def test_line_dedup_stage(stages):
    docs, made = stages["line_dedup"]
    want = brute_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = [(k, t) for k, t in want if t.strip() or t == before[k]]
    rows = made.collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == want and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_jaccard_stage_keeps_one_of_each_group(stages):
    docs, made = stages["jaccard_join"]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in made.collect()) == sorted({g[1] for g in groups})


def test_decontamination_stage(spark, stages):
    docs, made = stages["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert sorted(r["doc_id"] for r in made.collect()) == sorted(h[0] for h in hits if not h[-1])


def test_packing_stage_and_run(spark, stages):
    docs, made = stages["packing"]
    check_packing(made.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], packing.Limits())
    run = corpus_pipeline.run(spark, SF)
    pieces = lambda df: sorted((r["doc_id"], r["length"]) for r in df.groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "length").collect())
    assert pieces(run) == pieces(made)


CLASH = "doc_id long, text string, lang string, source string, n_chars int, hits string, items int, n_words string, kept int, n int, g string, `key` int, id int, `a.b` string"


def test_stages_with_clashing_columns_and_nulls(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, "en", "a", 1, "h", 2, "w", 3, 4, "g", 5, 6, "x"), (None, None, None, None, None, None, None, None, None, None, None, None, None, None), (2, "", "en", "a", 0, None, 1, "", 1, 1, "", 1, 1, "")]
    docs = spark.createDataFrame(rows, CLASH)
    for _, f in corpus_pipeline.STAGES[:-1]:
        made = f(spark, docs, SF)
        assert made.columns == docs.columns and 1 in {r["doc_id"] for r in made.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, docs, SF).collect()} == {1, 2, None}


def test_jaccard_stage_knows_rows_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a, "en", "s"), (3, a, "en", "s"), (5, b, "en", "s"), (7, c, "x", "s"), (7, c, "en", "t"), (None, c + " end", "en", "s"), (None, "q r s t u", "en", "s"), (None, "q r s t u", "en", "s"), (9, None, "en", "s"), (9, "", "en", "s")]
    made = corpus_pipeline.jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), SF)
    got = sorted(map(tuple, made.collect()), key=str)
    assert got == sorted([(3, a, "en", "s"), (5, b, "en", "s"), (7, c, "en", "t"), (None, "q r s t u", "en", "s"), (9, None, "en", "s"), (9, "", "en", "s")], key=str)


def test_decontamination_stage_with_an_empty_benchmark(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).count() == docs.count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).count() == 0


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11)) and decontam.ORACLE_SQL
