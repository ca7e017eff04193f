"""Quality rules with adaptive thresholds, in DataFrame operations only.

1. Counts of each whole text: words, symbols, repeated lines, words in repeated 8-word windows and so on.
2. Fixed base rules: too few words, or too many words in repeated windows.
3. Each rate of documents that pass the base goes into a quantile sketch for its language and source: integers
   are cut to eight leading bits and counted, so an entry is off by less than 1/128, and sketches merge by adding
   counts. A pair of language and source with fewer than `least_docs` documents takes its language's sketch, and
   a small language the sketch of all.
4. The group's upper limit of a rate is median + spread * (third quartile - median) of its sketch, and for the mean
   word length there is a lower limit in the same way. No rate has a cutoff of its own.
5. Limits are joined to the documents by language and source. A document goes if one of its counts is further from
   what the limit gives for its length than `spread` standard deviations of a Poisson count (of one event at least):
   one symbol in a short text says little, even where the group's limit is 0. In `repeats`, an event is a window.
The joined table has one row for each language and source. They are counted, and up to `BROADCAST_GROUPS` rows
are broadcast, so the documents aren't shuffled; more are joined by shuffle, where the engine splits hot groups.
What is written between the two passes holds the columns asked for, the language, the source and the counts.

Defined cases: a null or empty text has no words and fails the base; null languages and sources are values of
their own; a null id is carried; repeated rows are judged alike; other columns are kept where asked for (names
that begin with __q_ are this module's); an empty table gives no rows. Windows are known by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import materialise, spread

SPACE = r"[\x20\x09-\x0D]+"
WINDOW, LEAST_WORDS, MOST_REPEAT = 8, 20, 30
LEAST_DOCS, SPREAD, SKETCH_BITS = 100, 6, 8
BROADCAST_GROUPS = 50_000  # rows of the table of limits that is broadcast; beyond, the join shuffles
#: name -> (count, what it is a share of, factor of the sketched rate, size of one event)
RATES = {
    "symbols": ("n_symbols", "n_words", 1000, 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 1),
    "repeats": ("n_repeat_words", "n_words", 1000, WINDOW),
    "capitals": ("n_capitals", "word_chars", 1000, 1),
    "stutter": ("n_stutter", "n_words", 1000, 1),
    "length": ("word_chars", "n_words", 100, 1),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_stutter")


def q(name: str) -> str:
    return f"__q_{name}"


def counted(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with the COUNTS of each text, each under its name after __q_."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    made = [F.col(q(c)) for c in COUNTS]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # steps are projections of their own: arrays that several expressions read are made once
    df = spread(docs.select(*keep, text.alias(q("text"))))
    df = df.select(*keep, q("text"), F.array_remove(F.split(q("text"), SPACE), "").alias(q("words")), F.filter(F.split(q("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(q("list")))
    df = df.select(
        *keep,
        F.transform(q("words"), lambda w: F.xxhash64(w)).alias(q("hash")),
        F.size(q("words")).cast("long").alias(q("n_words")),
        F.length(F.array_join(q("words"), "")).cast("long").alias(q("word_chars")),
        F.regexp_count(F.col(q("text")), F.lit(r"[#*$%&|<>]")).cast("long").alias(q("n_symbols")),
        F.regexp_count(F.col(q("text")), F.lit(r"[A-Z]")).cast("long").alias(q("n_capitals")),
        F.size(q("list")).cast("long").alias(q("n_lines")),
        (F.size(q("list")) - F.size(F.array_distinct(q("list")))).cast("long").alias(q("n_dup_lines")),
    )
    done = [q(c) for c in COUNTS if c not in ("n_repeat_words", "n_stutter")]
    none = F.array().cast("array<bigint>")
    last = (F.col(q("n_words")) - WINDOW).cast("int")
    df = df.select(
        *keep,
        *done,
        F.size(F.filter(q("hash"), lambda h, i: h == F.get(q("hash"), i - 1))).cast("long").alias(q("n_stutter")),
        F.when(last >= 1, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(q("hash"), i, WINDOW)))).otherwise(none).alias(q("win")),
    )
    done.append(q("n_stutter"))
    # only texts with a repeated window sort their windows by hash and place
    pairs = F.sort_array(F.transform(q("win"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*keep, *done, F.when(F.size(F.array_distinct(q("win"))) < F.size(q("win")), pairs).alias(q("pairs")))
    same = lambda a, b: F.coalesce(F.get(q("pairs"), a)["h"] == b["h"], F.lit(False))
    twice = F.filter(q("pairs"), lambda p, k: same(k - 1, p) | same(k + 1, p))
    df = df.select(*keep, *done, F.sort_array(F.transform(twice, lambda p: p["i"])).alias(q("at")))
    covered = F.transform(q("at"), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q("at"), k + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*keep, *done, F.coalesce(total, F.lit(0)).alias(q("n_repeat_words"))).select(*keep, *made)


def base_failed() -> Column:
    return (F.col(q("n_words")) < LEAST_WORDS) | (100 * F.col(q("n_repeat_words")) > MOST_REPEAT * F.col(q("n_words")))


def rate(name: str) -> Column:
    top, bottom, factor, _ = RATES[name]
    return F.expr(f"{q(top)} * {factor} div greatest({q(bottom)}, 1)")


def entry(v: Column) -> Column:
    """The sketch's entry of an integer: its leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - SKETCH_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketch(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rate, entry, n: mergeable by adding n."""
    rows = counts.where(~base_failed()).select(*keys, F.explode(F.array(*(F.struct(F.lit(name).alias("rate"), rate(name).alias("v")) for name in RATES))).alias("r"))
    return rows.select(*keys, "r.rate", entry(F.col("r.v")).alias("entry")).groupBy(*keys, "rate", "entry").agg(F.count(F.lit(1)).alias("n"))


def limits(sk: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """One row for each value of keys: n documents, high_<rate>, low_length, each with the tag."""
    part = Window.partitionBy(*keys, "rate")
    run = sk.groupBy(*keys, "rate", "entry").agg(F.sum("n").alias("n")).withColumn("below", F.sum("n").over(part.orderBy("entry"))).withColumn("all", F.sum("n").over(part))
    quart = [F.min(F.when(F.col("below") * 4 >= F.col("all") * k, F.col("entry"))).alias(f"q{k}") for k in (1, 2, 3)]
    each = run.groupBy(*keys, "rate").agg(F.first("all").alias("n"), *quart)
    high = [F.max(F.when(F.col("rate") == name, F.col("q2") + SPREAD * (F.col("q3") - F.col("q2")))).alias(f"{tag}high_{name}") for name in RATES]
    low = F.max(F.when(F.col("rate") == "length", F.greatest(F.col("q2") - SPREAD * (F.col("q2") - F.col("q1")), F.lit(0)))).alias(f"{tag}low_length")
    return each.groupBy(*keys).agg(F.max("n").alias(f"{tag}n"), *high, low)


def off_limit(name: str, limit: str, side: int) -> Column:
    """Whether a count is further above (side 1) or below (-1) the limit than chance explains; false without a limit."""
    top, bottom, factor, unit = RATES[name]
    given = F.col(q(limit)).cast("double") * F.col(q(bottom))
    far = (F.col(q(top)).cast("double") * factor - given) * side
    return F.coalesce(far > SPREAD * F.sqrt(float(unit * factor) * F.greatest(given, F.lit(float(unit * factor)))), F.lit(False))


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (by default all) with __q_<count> for the COUNTS, __q_base_failed and __q_kept."""
    cols = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    made = counted(docs.select(*cols, F.col(f"`{lang_col}`").alias(q("lang")), F.col(f"`{source_col}`").alias(q("source")), F.col(f"`{text_col}`").alias(q("input"))), q("input"))
    counts = materialise(made.drop(q("input")), "quality")
    lang, source = F.col(q("lang")), F.col(q("source"))
    fine = materialise(sketch(counts.select(lang.alias("g_lang"), source.alias("g_source"), *(q(c) for c in COUNTS)), ["g_lang", "g_source"]), "sketch")
    pairs = limits(fine, ["g_lang", "g_source"], "__q_a_")
    langs = limits(fine, ["g_lang"], "__q_b_").withColumnRenamed("g_lang", "b_lang")
    every = limits(fine.withColumn("g_all", F.lit(0)), ["g_all"], "__q_c_")
    names = [f"high_{n}" for n in RATES] + ["low_length"]
    pairs = pairs.join(langs, F.col("g_lang").eqNullSafe(F.col("b_lang"))).withColumn("every", every.select(F.struct(*(f"__q_c_{n}" for n in names))).scalar())
    pick = lambda n: F.when(F.col("__q_a_n") >= LEAST_DOCS, F.col(f"__q_a_{n}")).when(F.col("__q_b_n") >= LEAST_DOCS, F.col(f"__q_b_{n}")).otherwise(F.col(f"every.__q_c_{n}")).alias(q(n))
    table = pairs.select(F.col("g_lang").alias("__q_lim_lang"), F.col("g_source").alias("__q_lim_source"), *map(pick, names))
    if fine.select("g_lang", "g_source").distinct().count() <= BROADCAST_GROUPS:
        table = F.broadcast(table)
    joined = counts.join(table, lang.eqNullSafe(F.col("__q_lim_lang")) & source.eqNullSafe(F.col("__q_lim_source")), "left")
    over = off_limit("length", "low_length", -1)
    for name in RATES:
        over = over | off_limit(name, f"high_{name}", 1)
    return joined.select(*cols, *(F.col(q(c)) for c in COUNTS), base_failed().alias(q("base_failed")), (~base_failed() & ~over).alias(q("kept")))


def digest(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return judged.select(id_col, *(F.col(q(c)).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def _level(name: str, keys: str) -> str:
    over = f"PARTITION BY {keys + ', ' if keys else ''}rate"
    group = f"{keys + ', ' if keys else ''}rate"
    return f"""
{name}0 AS (SELECT {group}, entry, count(*) AS n FROM e GROUP BY ALL),
{name}1 AS (SELECT *, sum(n) OVER ({over} ORDER BY entry) AS below, sum(n) OVER ({over}) AS al FROM {name}0),
{name} AS (SELECT {group}, max(al) AS n, min(entry) FILTER (WHERE below * 4 >= al) AS q1, min(entry) FILTER (WHERE below * 4 >= al * 2) AS q2, min(entry) FILTER (WHERE below * 4 >= al * 3) AS q3 FROM {name}1 GROUP BY {group})"""


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS k FROM g) WHERE k > 1),
p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(generate_series(i, i + 7)) AS j FROM t) GROUP BY r),
c AS (SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
 len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len([i for i in generate_series(2, len(w)) if w[i] = w[i - 1]]) AS n_stutter
 FROM d JOIN w USING (r) LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT} * n_words AS base_failed FROM c),
x AS (SELECT r, lang, source, base_failed, unnest([{", ".join(f"{{'rate': '{n}', 'top': CAST({top} AS DOUBLE), 'bottom': CAST({bottom} AS DOUBLE), 'factor': {fa}, 'unit': {u}, 'v': CAST(({top} * {fa}) // greatest({bottom}, 1) AS BIGINT)}}" for n, (top, bottom, fa, u) in RATES.items())}], recursive := true) FROM f),
e AS (SELECT lang, source, rate, (v >> greatest(length(bin(v)) - {SKETCH_BITS}, 0)) << greatest(length(bin(v)) - {SKETCH_BITS}, 0) AS entry FROM x WHERE NOT base_failed),{_level("a", "lang, source")},{_level("b", "lang")},{_level("cc", "")},
lim AS (SELECT a.lang, a.source, rate, CASE WHEN a.n >= {LEAST_DOCS} THEN a.q1 WHEN b.n >= {LEAST_DOCS} THEN b.q1 ELSE cc.q1 END AS q1, CASE WHEN a.n >= {LEAST_DOCS} THEN a.q2 WHEN b.n >= {LEAST_DOCS} THEN b.q2 ELSE cc.q2 END AS q2, CASE WHEN a.n >= {LEAST_DOCS} THEN a.q3 WHEN b.n >= {LEAST_DOCS} THEN b.q3 ELSE cc.q3 END AS q3 FROM a JOIN b USING (lang, rate) JOIN cc USING (rate)),
h AS (SELECT r, rate, top * factor AS got, (q2 + {SPREAD} * (q3 - q2)) * bottom AS high, greatest(q2 - {SPREAD} * (q2 - q1), 0) * bottom AS low, CAST(unit * factor AS DOUBLE) AS one FROM x JOIN lim USING (lang, source, rate)),
o AS (SELECT r, bool_or(got - high > {SPREAD} * sqrt(one * greatest(high, one)) OR rate = 'length' AND low - got > {SPREAD} * sqrt(one * greatest(low, one))) AS over FROM h GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(over, false) AS kept FROM f LEFT JOIN o USING (r)
"""
