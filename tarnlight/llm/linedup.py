"""Removal of repeated passages by content-defined chunks of lines, in DataFrame operations only.

A text's lines are hashed, and a line's own hash says whether a chunk ends after it, after seven lines in eight and
never after an empty one; so the boundaries inside a passage are the same wherever it stands, and nearly any passage
of several lines holds whole chunks. A line of `long_words` words or more is a chunk of its own. Of equal chunks the first (by id, text hash, place)
stays. The others are grouped into runs of neighbours, and a run goes if it is a passage: two lines with text or
more, of `least_words` words together, or a line of `long_words`. So a single short line that many texts share stays.

1. Hashes of all chunks with text are counted; partial counts are combined before the shuffle.
2. Chunks whose hash occurs twice are grouped by their bytes, so a hash collision removes nothing. Groups are combined
   before the shuffle, and in the joins chunks that very many texts share are salted.
3. Each document's repeated chunks are grouped into runs, by one shuffle of places.
4. The chunks to remove are joined to the documents by id and text hash; a document gathers its own places only.

Defined cases: a null text stays null; a text whose passages are all removed is empty; null ids are one value;
rows with the same id and text are one occurrence and are treated alike; other columns are kept; an empty table
gives no rows. Names that begin with __l_ are this module's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Salts, materialise

FILLED = r"[^\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
LONG_WORDS, LEAST_WORDS = 50, 25
CUTS = tuple("0123456789abce")  # first digits of the line hash that end a chunk: all but two, one of them an empty line's


def is_long(line: Column, long_words: int) -> Column:
    # so many words take at least that many characters and one between each two
    return F.when(F.length(line) >= 2 * long_words - 1, F.regexp_count(line, F.lit(WORD)) >= long_words).otherwise(False)


def chunked(docs: DataFrame, keep: list[Column], text_col: str, long_words: int) -> DataFrame:
    """keep, __l_lines and __l_chunks: array of (k, text, n lines, filled), which joined by line feeds are the text."""
    text = F.col(f"`{text_col}`").cast("string")
    df = docs.select(*keep, F.split(F.coalesce(text, F.lit("")), "\n").alias("__l_lines"))
    own = [F.col(f"`{n}`") for n in df.columns]
    # one array that is read more than once, so that it is made once and not anew for every line
    flags = F.transform("__l_lines", lambda x: F.struct(F.substring(F.md5(x), 1, 1).isin(*CUTS).alias("ends"), is_long(x, long_words).alias("long")))
    df = df.select(*own, flags.alias("__l_flags"))
    last = F.size("__l_lines") - 1
    flag = lambda i: F.get("__l_flags", i)
    cut = lambda i: (i == last) | flag(i)["ends"] | flag(i)["long"] | F.coalesce(flag(i + 1)["long"], F.lit(False))
    df = df.select(*own, F.filter(F.sequence(F.lit(0), last), cut).alias("__l_cuts"))

    def chunk(c: Column, k: Column) -> Column:
        start = F.coalesce(F.get("__l_cuts", k - 1) + 1, F.lit(0))
        joined = F.array_join(F.slice("__l_lines", start + 1, c - start + 1), "\n")
        return F.struct(k.alias("k"), joined.alias("text"), (c - start + 1).cast("long").alias("n"))

    return df.select(*own, F.transform("__l_cuts", chunk).alias("__l_chunks"))


def repeated_chunks(docs: DataFrame, id_col: str, text_col: str, long_words: int, least_words: int) -> DataFrame:
    """__l_id, __l_th and __l_gone: the places of the chunks to remove, of documents that have any."""
    text = F.col(f"`{text_col}`").cast("string")
    chunks = chunked(docs, [F.col(f"`{id_col}`").alias("__l_id"), F.xxhash64(text).alias("__l_th")], text_col, long_words)
    # the outer form, as the other has a filter on the array's size put together from all the steps above
    chunks = chunks.select("__l_id", "__l_th", F.explode_outer("__l_chunks").alias("c")).where(F.col("c.text").rlike(FILLED))
    chunks = chunks.select("__l_id", "__l_th", F.col("c.k").alias("k"), F.col("c.text").alias("text"), F.xxhash64("c.text").alias("h"))
    often = materialise(chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    salts = Salts(often, "h")
    repeated = salts.left(chunks, ["__l_id", "__l_th", "k"]).join(salts.right(often.select("h")), ["h", "__salt"], "left_semi")
    place = F.struct("__l_id", "__l_th", "k")
    first = repeated.groupBy("text").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("h").alias("h")).where("n > 1")
    lines = F.split("text", "\n")
    first = first.select("h", F.sha2("text", 256).alias("d"), "first", F.size(F.filter(lines, lambda x: x.rlike(FILLED))).alias("lines"), F.regexp_count("text", F.lit(WORD)).alias("words"), F.exists(lines, lambda x: is_long(x, long_words)).alias("long"))
    # the bytes were compared above; a digest finds a chunk's group again without sending the text once more
    found = repeated.select("h", "__salt", "__l_id", "__l_th", "k", F.sha2("text", 256).alias("d")).join(salts.right(first), ["h", "__salt", "d"]).where(~place.eqNullSafe(F.col("first")))
    found = found.groupBy("__l_id", "__l_th").agg(F.sort_array(F.collect_set(F.struct("k", "lines", "words", "long"))).alias("all"))
    found = found.select("__l_id", "__l_th", F.posexplode_outer("all").alias("i", "c")).withColumn("run", F.col("c.k") - F.col("i"))
    runs = found.groupBy("__l_id", "__l_th", "run").agg(F.sum("c.lines").alias("lines"), F.sum("c.words").alias("words"), F.max("c.long").alias("long"), F.collect_list("c.k").alias("ks"))
    runs = runs.where((F.col("lines") >= 2) & (F.col("words") >= least_words) | F.col("long"))
    return runs.groupBy("__l_id", "__l_th").agg(F.flatten(F.collect_list("ks")).alias("__l_gone"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the new text, and __l_lines (lines before), __l_removed_lines, __l_removed_chunks."""
    gone = repeated_chunks(docs, id_col, text_col, long_words, least_words).withColumnsRenamed({"__l_id": "__l_i", "__l_th": "__l_t"})
    cols = [F.col(f"`{c}`") for c in docs.columns]
    df = docs.withColumns({"__l_id": F.col(f"`{id_col}`"), "__l_th": F.xxhash64(F.col(f"`{text_col}`").cast("string"))})
    df = df.join(gone, F.col("__l_id").eqNullSafe(F.col("__l_i")) & F.col("__l_th").eqNullSafe(F.col("__l_t")), "left")
    df = chunked(df, [*cols, F.col("__l_gone")], text_col, long_words)
    stay = F.array_except(F.sequence(F.lit(0), F.size("__l_chunks") - 1), "__l_gone")
    df = df.select(*cols, "__l_gone", F.size("__l_lines").cast("long").alias("__l_lines"), "__l_chunks", F.when(F.col("__l_gone").isNotNull(), stay).alias("__l_stay"))
    kept = F.transform("__l_stay", lambda k: F.get("__l_chunks", k))
    lines = F.aggregate(F.transform(kept, lambda c: c["n"]), F.lit(0).cast("long"), lambda a, x: a + x)
    new = F.when(F.col("__l_gone").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.transform(kept, lambda c: c["text"]), "\n"))
    made = F.struct(new.alias("text"), (F.col("__l_lines") - F.coalesce(lines, F.col("__l_lines"))).alias("lines"), F.coalesce(F.size("__l_gone"), F.lit(0)).cast("long").alias("chunks"))
    # a generator, so that no later filter is pushed below and put together from all the steps above again and again
    df = df.select(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), "__l_lines", F.explode(F.array(made)).alias("__l_new"))
    out = [F.col("__l_new.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return df.select(*out, "__l_lines", F.col("__l_new.lines").alias("__l_removed_lines"), F.col("__l_new.chunks").alias("__l_removed_chunks"))


def digest(done: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return done.select(id_col, text_col, F.col("__l_lines").alias("n_lines"), F.col("__l_removed_lines").alias("n_removed_lines"), F.col("__l_removed_chunks").alias("n_removed_chunks"))


ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))),
c AS (SELECT *, words >= {LONG_WORDS} AS long, words >= {LONG_WORDS} OR coalesce(lead(words) OVER w >= {LONG_WORDS}, true) OR substr(md5(x), 1, 1) IN ({", ".join(f"'{x}'" for x in CUTS)}) AS cut FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c),
p AS (SELECT doc_id, k, string_agg(x, chr(10) ORDER BY i) AS t, count(*) AS n, count(*) FILTER (WHERE words > 0) AS filled, sum(words) AS words, bool_or(long) AS long FROM n GROUP BY doc_id, k),
r AS (SELECT *, filled > 0 AND row_number() OVER (PARTITION BY filled > 0, t ORDER BY doc_id, k) > 1 AS twin FROM p),
g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, twin ORDER BY k) AS run FROM r),
o AS (SELECT *, twin AND (sum(filled) OVER w >= 2 AND sum(words) OVER w >= {LEAST_WORDS} OR bool_or(long) OVER w) AS gone FROM g WINDOW w AS (PARTITION BY doc_id, twin, run))
SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed_lines, count(*) FILTER (WHERE gone) AS n_removed_chunks
FROM o GROUP BY doc_id
"""
