import random
import re
from collections import Counter
from functools import cache

import pytest
from pyspark.sql import functions as F

from tarnlight.llm import htmldiff, linedup, quality, urlrules

DOCS = "doc_id long, text string, lang string, source string"


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def brute_kept(docs):
    """Ids of rows (id, text, lang, source) that stay."""
    rows = []
    for k, t, lang, source in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, chars, symbols, dup, rep = brute_counts(t)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (t or "").split("\n"))
        caps, stutter = len(re.findall("[A-Z]", t or "")), sum(a == b for a, b in zip(w, w[1:]))
        rates = [("symbols", symbols, n, 1000, 1), ("dup", dup, lines, 1000, 1), ("rep", rep, n, 1000, 8), ("caps", caps, chars, 1000, 1), ("stutter", stutter, n, 1000, 1), ("length", chars, n, 100, 1)]
        rows.append((k, lang, source, n < 20 or 100 * rep > 30 * n, rates))

    def entry(v):
        shift = max(v.bit_length() - 8, 0)
        return v >> shift << shift

    def quartiles(rate, fits):
        v = sorted(entry(a * f // max(b, 1)) for _, lang, source, bad, rs in rows if not bad and fits(lang, source) for name, a, b, f, _ in rs if name == rate)
        return len(v), [v[-(-len(v) * k // 4) - 1] if v else None for k in (1, 2, 3)]

    @cache
    def limit(rate, lang, source):
        n, found = quartiles(rate, lambda x, y: (x, y) == (lang, source))
        if n < 100:
            n, found = quartiles(rate, lambda x, y: x == lang)
        return found if n >= 100 else quartiles(rate, lambda x, y: True)[1]

    stay = []
    for k, lang, source, bad, rates in rows:
        for name, a, b, f, unit in () if bad else rates:
            q1, q2, q3 = limit(name, lang, source)
            high, low = (q2 + 6 * (q3 - q2)) * b, max(q2 - 6 * (q2 - q1), 0) * b
            one = unit * f
            bad |= a * f - high > 6 * (one * max(high, one)) ** 0.5 or name == "length" and low - a * f > 6 * (one * max(low, one)) ** 0.5
        if not bad:
            stay.append(k)
    return stay


def quality_docs():
    r = random.Random(0)
    vocab = [f"wort{i}" for i in range(300)] + ["é", "日本語", "x"]
    out = []
    for i in range(150):
        words = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        if r.random() < 0.2:
            words = words[:12] * 4 + words
        if i % 20 == 0:
            words = [w + "###" for w in words]
        t = "".join(w + r.choice([" ", " ", "\t", "\n", " \n\n"]) for w in words)
        out.append((i, t + (t[:40] if r.random() < 0.1 else ""), r.choice(["en", "de", None]), r.choice(["a", "b", None])))
    return out + [(900, None, "en", "a"), (901, "", None, None), (902, "\n \t", "en", "a"), (None, "x " * 30, "en", "a"), (5, "same same", "en", "a"), (5, "same same", "en", "a"), (903, "a" * 30_000 + " b" * 20_000, "en", "a")]


def test_quality_counts_equal_brute_force(spark):
    docs = quality_docs()
    df = spark.createDataFrame(docs, DOCS).withColumn("n_words", F.lit(-1)).withColumn("kept", F.lit("x"))
    rows = quality.digest(quality.judge(df)).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows), key=str)
    assert got == sorted(((k, *brute_counts(t)) for k, t, *_ in docs), key=str)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert sorted((r["doc_id"] for r in rows if r["kept"]), key=str) == sorted(brute_kept(docs), key=str)


def test_quality_limits_adapt_and_both_joins_agree(spark, monkeypatch):
    r = random.Random(1)
    words = lambda n, tail="": " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6)}{tail}" for _ in range(n))
    # a source whose every text has symbols keeps them; elsewhere they stand out
    docs = [(i, words(60, "#"), "en", "code") for i in range(150)] + [(1000 + i, words(60), "en", "prose") for i in range(150)] + [(5000, words(60, "#"), "en", "prose"), (5001, words(60, "#"), "fr", "rare")]
    df = spark.createDataFrame(docs, DOCS)
    kept = lambda: {r["doc_id"] for r in quality.judge(df).where("__q_kept").select("doc_id").collect()}
    first = kept()
    assert set(range(150)) | set(range(1000, 1150)) <= first and 5000 not in first
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert kept() == first == set(brute_kept(docs))
    # no fixed cutoff does that: one text is kept here and goes there
    assert 5000 not in first and docs[0][1].count("#") == 60 and 0 in first
    # where a group's distribution changes, so do the verdicts of the same documents
    moved = [(k, t, lang, "prose" if source == "code" else source) for k, t, lang, source in docs]
    mixed = {r["doc_id"] for r in quality.judge(spark.createDataFrame(moved, DOCS), carry=["doc_id"]).where("__q_kept").select("doc_id").collect()}
    assert 5000 in mixed and mixed == set(brute_kept(moved))
    assert quality.judge(df.limit(0)).count() == 0


def test_sketch_merges_and_bounds_error(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id")).alias("v"))
    e = df.select("v", quality.entry(F.col("v")).alias("e"))
    assert e.where("e > v OR v > e + e / 128").count() == 0


def test_quality_finds_low_labels(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = quality.digest(quality.judge(docs)).join(labels, "doc_id")
    low, clean = got.where("quality = 0"), got.where("quality = 1 AND NOT base_failed")
    assert low.where("kept").count() <= 0.05 * low.count() and clean.where("NOT kept").count() <= 0.02 * clean.count()


# ---------------------------------------------------------------- urls
def brute_verdicts(pages, rules, edges):
    def split(u):
        s = (u or "").partition("://")[2] if "://" in (u or "") else ""
        m = re.match(r"([^/?#]*)([^?#]*)", s)
        return "".join(c.lower() if c.isascii() else c for c in m[1]), m[2], s

    def rule(h, p):
        fit = [(len(x + y), x + y, v) for v, x, y in rules if (h == x or h.endswith("." + x)) and p.startswith(y)]
        return max(fit, default=(0, None, None))[1:]

    def node(u):
        h, _, s = split(u)
        rest = re.match(r"[^/?#]*([^#]*)", s)[1]
        return h and h + (rest if rest.startswith("/") else "/" + rest)

    near, forms = {}, {}
    for pair in edges:
        for u in pair:
            if node(u):
                forms.setdefault(node(u), set()).add(split(u)[:2])
        a, b = map(node, pair)
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for i, u in pages:
        h, p, _ = split(u)
        name, verdict = rule(h, p)
        if verdict is None:
            todo, seen = ([node(u)], {node(u)}) if node(u) in near else ([], set())
            while todo:
                for x in near.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            met = {rule(*f)[1] for x in seen if x for f in forms[x]}
            verdict = "block" if "block" in met and "allow" not in met else "allow"
        out.append((i, h, p, name, verdict))
    return sorted(out, key=str)


PAGES = [(1, "http://A.net/x"), (2, "https://www.example.net/en/1?q"), (3, "http://example.net"), (4, None), (5, "nothing"), (6, "http://b.example.com/de/"), (7, "http://c.example.com/fr/1#t"), (8, "http://d.org/fr/"), (9, "http://e.org/xx"), (9, "http://e.org/xx"), (10, "HTTP://F.com?x=1"), (11, "http://g.com/1"), (12, "http://h.com/2"), (13, "http://notnet/x"), (None, "http://k.com/"), (14, "")]
REDIRECTS = [("http://g.com/1", "http://A.net/x"), ("http://h.com/2", "http://g.com/1#frag"), ("http://e.org/xx", "http://d.org/fr/"), ("http://e.org/xx", "http://A.net/x"), ("http://F.com?x=1", "http://m.com/"), (None, "http://q.net/"), ("http://k.com/", "http://far.net/not-a-page")]


@pytest.mark.parametrize("inline", [64, 0])
def test_url_verdicts_equal_brute_force(spark, monkeypatch, inline):
    monkeypatch.setattr(urlrules, "INLINE", inline)
    pages = spark.createDataFrame([(i, u, None) for i, u in PAGES], "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = urlrules.judge_urls(pages, urlrules.rule_table(spark), redirects=spark.createDataFrame(REDIRECTS, "src string, dst string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_verdicts(PAGES, urlrules.RULES, REDIRECTS)


def test_canonical_links_and_refreshes(spark):
    pages = [(1, "http://a.com/p/1", '<link href="http://bad.net/x" rel="canonical">'), (2, "http://a.com/p/2", "<LINK REL='canonical' HREF='1'>"), (3, "http://a.com/p/3", '<meta http-equiv="refresh" content="0; url=/p/2">'), (4, "http://a.com/p/4", '<a href="http://bad.net/x">'), (5, "http://a.com/p/5", None)]
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), urlrules.rule_table(spark)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    # a url without a path has no rule, so it blocks nothing; several links, and links that no browser follows
    pages = [(1, "http://x.net", '<link rel="canonical" href="http://y.com/">'), (2, "http://y.com/", ""), (3, "http://z.com/1", '<!-- <link rel="canonical" href="http://bad.net/x"> --><script>"<link rel=canonical href=http://bad.net/x>"</script>'), (4, "http://z.com/2", '<link rel="alternate canonical" href="/3"><link data-a=">" rel="canonical" href="http://bad.net/x">'), (5, "http://z.com/3", None), (6, "http://z.com/4", "<!-- <link rel='canonical' href='http://bad.net/x'>")]
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), urlrules.rule_table(spark)).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow"}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlrules.judge_mirrored(empty, urlrules.rule_table(spark)).count() == 0
    assert urlrules.judge_urls(empty, urlrules.rule_table(spark)).count() == 0


def test_mirrors_take_over_a_block_but_not_an_allow(spark):
    art = "<nav>{}</nav><article class=x>{}</article>".format
    pages = [(1, "http://a.com/1", art(1, "A")), (2, "http://b.net/2", art(2, "A")), (3, "http://c.com/3", art(3, "B")), (4, "http://d.net/4", art(4, "B")), (5, "http://e.org/fr/5", art(5, "B")), (6, "http://f.com/6", art(6, "C")), (7, None, art(7, "A")), (8, "http://a.com/1#x", art(8, "D")), (9, "https://g.com/9", art(9, "D")), (10, "http://h.com/", "<article></article>"), (11, "http://i.net/", "<article></article>")]
    got = [tuple(r) for r in urlrules.judge_mirrored(spark.createDataFrame(pages, "page_id long, url string, html string"), urlrules.rule_table(spark)).collect()]
    edges = [(a[1], b[1]) for a in pages for b in pages if a[0] < b[0] and a[1] and b[1] and (x := re.search("<article[^>]*>(.+)</article>", a[2])) and (y := re.search("<article[^>]*>(.+)</article>", b[2])) and x[1] == y[1]]
    assert sorted(got, key=str) == brute_verdicts([p[:2] for p in pages], urlrules.RULES, edges)
    assert {r[0]: r[4] for r in got} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "allow", 11: "block"}


# ---------------------------------------------------------------- lines
def brute_dedup(docs, long_words=50, least_words=25):
    from hashlib import md5

    count = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    chunks = {}
    for k, t in docs:
        lines, out, now = (t or "").split("\n"), [], []
        long = [count(x) >= long_words for x in lines]
        for i, x in enumerate(lines):
            now.append(i)
            if i == len(lines) - 1 or long[i] or long[i + 1] or md5(x.encode()).hexdigest()[0] not in "df":
                own = [lines[j] for j in now]
                out.append(("\n".join(own), sum(count(x) > 0 for x in own), sum(map(count, own)), len(now) == 1 and long[i]))
                now = []
        chunks[k, t] = out
    first = {}
    for (k, t), cs in sorted(chunks.items(), key=lambda x: x[0][0]):
        for n, (c, filled, *_) in enumerate(cs):
            if filled:
                first.setdefault(c, (k, n))
    out = []
    for k, t in docs:
        keep, run = [], []
        for n, (c, filled, words, long) in enumerate([*chunks[k, t], ("", 0, 0, False)]):
            if filled and first[c] != (k, n):
                run.append((c, filled, words, long))
                continue
            if not (sum(x[1] for x in run) >= 2 and sum(x[2] for x in run) >= least_words or any(x[3] for x in run)):
                keep += [x[0] for x in run]
            run = []
            if n < len(chunks[k, t]):
                keep.append(c)
        out.append((k, None if t is None else "\n".join(keep)))
    return sorted(out)


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(2)
    pool = [f"line {i} of " + "text " * (i % 12) for i in range(60)] + ["", " ", "word " * 55]
    passages = [[r.choice(pool) for _ in range(r.randint(3, 9))] for _ in range(6)]
    docs = []
    for i in range(60):
        lines = [f"own {i} {j}" for j in range(r.randint(0, 8))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(lines))
            lines[at:at] = r.choice(passages)
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[3][1]), (104, "word " * 55)]
    docs += [docs[7]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("__new", F.lit(1)).withColumn("c", F.lit("z"))
    done = linedup.dedup_lines(df)
    assert sorted((r["doc_id"], r["text"]) for r in done.collect()) == brute_dedup(docs)
    assert done.where("__l_removed_lines > 0").count() > 10
    assert linedup.dedup_lines(df.limit(0)).count() == 0
    assert done.where("text = ''").count() >= 1  # a filter on the result can be planned


def test_line_dedup_finds_passages_of_a_few_lines(spark):
    r = random.Random(6)
    line = lambda n: " ".join(f"{r.choice('abcdefg')}{r.randrange(10**6)}" for _ in range(n))
    docs, least = [], {2: 0.55, 3: 0.85, 4: 0.93, 6: 0.98, 8: 0.98}
    for k in least:
        for trial in range(60):
            passage = [line(60 // k + 1) for _ in range(k)]
            for j in range(2):
                docs.append((10_000 * k + 10 * trial + j, "\n".join([line(12), line(12), *passage, line(12), line(12)])))
    got = {x["doc_id"]: x for x in linedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, share in least.items():
        found = [got[10_000 * k + 10 * t + 1]["__l_removed_lines"] for t in range(60)]
        assert sum(n > 0 for n in found) >= share * 60, k
        assert max(found) <= k and all(got[10_000 * k + 10 * t]["__l_removed_lines"] == 0 for t in range(60))
    # single short lines that all share stay
    shared = [(i, f"The licence of all texts.\n{line(30)}\nThe end.") for i in range(20)]
    assert {x["__l_removed_lines"] for x in linedup.dedup_lines(spark.createDataFrame(shared, "doc_id long, text string")).collect()} == {0}


def test_line_dedup_null_ids(spark):
    t = "first line here\nsecond line here\n" + "word " * 60
    df = spark.createDataFrame([(None, t), (1, t)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(df).collect()}
    assert "word word" in got[None] and "word word" not in got[1]


# ---------------------------------------------------------------- pages
def test_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(1500):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        for bits in (1 << 20, 4):
            own = [x for x, m in zip(a, htmldiff.common(a, b, bits)) if m]
            it = iter(b)
            assert len(own) == size[-1][-1] and all(x in it for x in own)


def main(html):
    return htmldiff.main_text(htmldiff.page_lines(html), None)


def test_main_text_of_an_article():
    html = """<!DOCTYPE html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>menu</a></nav><!-- x --><div class="ad">buy</div>
    <article><header>by someone<h1>Title &amp; <i>more</i></h1></header><p>One<b>two</b>
    three &lt;x&gt;&nbsp;four<br>five<p>six<ul><li>a<li>b</ul><aside>side</aside><form>f<input></form><div id="comments">r</div><p hidden>h</p></article><footer>foot</footer>"""
    assert main(html) == "Title & more Onetwo three <x> four five six a b"


def test_broken_and_empty_pages():
    assert main(None) == "" and main("") == "" and main("plain text") == "plain text"
    assert main("<article>open <b>text") == "open text" and main("<article>a<script>x") == "a" and main('<article>a <p class="x>y') == "a y"
    assert main("<main>m<p>n</main><p>out") == "m n" and main("<p>a < b &am; c</p>") == "a < b &am; c"


def test_differencing_deletes_shared_lines(spark):
    shell = "<body><div>Site name</div><p>{}</p><p>{}</p><div>Terms apply</div></body>"
    pages = [(1, "http://a.com/x/1", shell.format("alpha", "beta")), (2, "http://a.com/x/2", shell.format("gamma", "delta")), (3, "http://b.com/x/2", shell.format("gamma", "delta")), (4, None, None), (5, "http://c.com/1", "<article>same</article>"), (6, "http://c.com/2", "<article>same</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1)).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["page_id"]: r["text"] for r in htmldiff.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {1: "alpha beta", 2: "gamma delta", 3: "Site name gamma delta Terms apply", 4: "", 5: "same", 6: "same"}
    assert htmldiff.extract(df.limit(0)).count() == 0


def extracted(spark, pages, partitions="1"):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        return {r["page_id"]: r["text"] for r in htmldiff.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_copies_keep_their_main_text(spark):
    shell = "<body><div>Site name</div><p>{}</p><p>{}</p><div>Terms apply</div></body>"
    long = "a paragraph of some length " * 20
    twins = [(i, f"http://a.com/x?from={i}", shell.format("alpha", "beta")) for i in range(3)]
    assert extracted(spark, twins) == dict.fromkeys(range(3), "Site name alpha beta Terms apply")
    # a page of another text tells what is the site's, however many copies are between
    other = [(9, "http://a.com/y", shell.format("gamma", "delta")), (10, "http://b.com/y", shell.format("gamma", "delta"))]
    assert extracted(spark, twins + other) == dict.fromkeys(range(3), "alpha beta") | {9: "gamma delta", 10: "Site name gamma delta Terms apply"}
    near = [(i, f"http://a.com/x/{i}", shell.format(long, f"print {i}")) for i in range(3)]
    assert extracted(spark, near + other) == {i: f"{long}print {i}" for i in range(3)} | {9: "gamma delta", 10: "Site name gamma delta Terms apply"}
    # a version without the site's lines
    bare = [(1, "http://a.com/x", shell.format(long, "beta")), (2, "http://a.com/x?print", f"<p>{long}</p><p>beta</p>")]
    assert extracted(spark, bare) == {1: f"Site name {long}beta Terms apply", 2: f"{long}beta"}


def test_pairing_is_the_same_at_every_partition_count(spark):
    r = random.Random(8)
    pages = []
    for i in range(90):
        host, kind = f"h{r.randrange(6)}.com", r.randrange(4)
        body = "".join(f"<p>{r.choice(['own', 'other'])} {i} {j} text</p>" for j in range(3)) if kind else "<p>the same copy</p><p>of a page</p>"
        pages.append((i, f"http://{host}/{r.choice('ab')}/{r.randrange(30)}", f"<div>Site {host}</div>{body}<div>Terms of {host}</div>"))
    pages += [(200 + i, "http://h7.com/x", "<div>Site</div><p>copied text</p>") for i in range(40)] + [(300, "http://h7.com/y", "<div>Site</div><p>another</p>")]
    pages += [(400, "http://two.com/1", "<div>Two</div><p>first</p>"), (401, "http://two.com/2", "<div>Two</div><p>second</p>")]
    one = extracted(spark, pages)
    assert one[200] == one[239] == "copied text" and one[400] == "first" and one[401] == "second"
    assert not any("Site" in t for t in one.values())
    for n in ("3", "7", "50"):
        assert extracted(spark, pages, n) == one


def test_names_do_not_drop_the_main_text():
    for wrap in ('<div class="content-sidebar-wrap">', '<div class="page has-sidebar">', '<div class="with-nav">', '<div class="sidebar">', '<div id="widget"><section class="social">'):
        assert main(f"<div class='nav'>n</div>{wrap}<article>One<p>two</article></div><p>out") == "One two"
        assert main(f"{wrap}x<main>One<p>two</main>") == "One two"
    assert main('<article class="post comment-open">a</article>') == "a" and main('<article id="notice">a</article>') == "a"
    for name in ("content-sidebar-wrap", "page has-sidebar", "with-nav"):  # no article at all
        assert main(f'<div class="{name}"><p>text</div>') == "text"
    for name in ("sidebar", "sidebar-left", "site-nav x", "nav-menu", "widget_2", "post-comments", "comments-area", "AD"):
        assert main(f'<p>text<div class="{name}"><p>no</div>') == "text"
        assert main(f'<article>text <header><h1>h</h1><div class="{name}"><h2>no</h2></div></header></article>') == "text h"
    assert main('<p>a<span class="ad">no</span>b') == "ab"
    # other people's and pages' articles
    assert main('<p>text<div id="comments"><article class="comment">no</article></div>') == "text"
    assert main('<main>text</main><div class="sidebar"><article>no</article></div>') == "text"


def test_a_main_element_with_teasers_is_taken_whole():
    assert main("<main><p>the long text of the page</p><article class='teaser'>more</article></main><p>out") == "the long text of the page more"
    assert main("<main><p>by x</p><article>the long text of the page</article></main>") == "the long text of the page"


def brute_pages(pages):
    """Texts by the definition, over pages (id, url, own lines, site lines before and after), none with an article."""
    rows = []
    for k, u, lines in pages:
        m = re.match(r"[^:]*://([^/?#]*)([^?#]*)", u)
        rows.append((m[1].lower(), m[2], u, str(k), k, lines))
    rows.sort(key=lambda r: r[:4])
    chars = lambda x: sum(map(len, x))

    def both(a, b):
        return sum(len(x) * n for x, n in (Counter(a) & Counter(b)).items())

    def shared(a, b):
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
        i = j = 0
        out = set()
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.add(i)
                i, j = i + 1, j + 1
            elif size[i + 1][j] >= size[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    same = [False] + [x[0] == y[0] and 20 * both(x[5], y[5]) >= 19 * max(chars(x[5]), chars(y[5])) for x, y in zip(rows, rows[1:])] + [False]
    got = {}
    for i, (host, path, *_, k, lines) in enumerate(rows):
        a, b = i, i
        while same[a]:
            a -= 1
        while same[b + 1]:
            b += 1
        near = [x for x in (rows[a - 1] if a else None, rows[b + 1] if b + 1 < len(rows) else None) if x and x[0] == host]
        near.sort(key=lambda x: -htmldiff.prefix_length(path, x[1]))
        other = next((x[5] for x in near if 20 * both(lines, x[5]) < 19 * min(chars(lines), chars(x[5]))), [])
        gone = shared(lines, other)
        got[k] = " ".join(x for j, x in enumerate(lines) if j not in gone)
    return got


@pytest.mark.parametrize("partitions", ["1", "6", "64"])
def test_pairing_and_differencing_equal_brute_force(spark, partitions):
    r = random.Random(11)
    pages = []
    for i in range(120):
        host = f"h{r.randrange(8)}.com"
        top, end = [f"{host} top {j}" for j in range(3)], [f"{host} end {j}" for j in range(2)]
        own = [f"own {i} {j} " + "text " * r.randrange(9) for j in range(r.randrange(1, 5))]
        if r.random() < 0.3 and pages:
            own = [x for x in r.choice(pages)[2] if x.startswith("own")]  # a copy's lines
        if r.random() < 0.3:
            own.insert(0, f"{host} news of the day")
        pages.append((i, f"http://{host}/{r.choice(['a', 'a/b', 'c'])}/{r.randrange(20)}{r.choice(['', '?q', '#t'])}", [" ".join(x.split()) for x in top[: r.randrange(4)] + own + end]))
    html = [(k, u, "".join(r.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>"]).format(x) for x in lines)) for k, u, lines in pages]
    assert extracted(spark, html, partitions) == brute_pages(pages)


def test_differencing_counts_what_it_deletes(spark):
    shell = "<nav><li>Home</li><li>About {0}</li></nav><article><p>Text {0}</p><p>Shared words</p></article><footer>Terms</footer><script>x</script>"
    pages = spark.createDataFrame([(i, f"http://a.com/{i}", shell.format(i)) for i in range(3)], "page_id long, url string, html string")
    rows = htmldiff.extract(pages).collect()
    # Home and Terms are shared, About is only hinted at, and an article keeps what it shares
    assert {(r["page_id"], r["text"], r["n_lines"], r["n_shared_lines"], r["n_hinted_lines"]) for r in rows} == {(i, f"Text {i} Shared words", 5, 2, 1) for i in range(3)}
    assert {(r["page_id"], r["text"]) for r in htmldiff.extract(pages, hints=False).collect()} == {(i, f"About {i} Text {i}") for i in range(3)}


def test_very_long_and_odd_pages(spark):
    pages = [(1, "http://a.com/1", "<p>" + "word " * 200_000 + "</p>"), (2, "http://a.com/2", "<p>x</p>" * 20_000), (3, "http://a.com/3", "<div>" * 3000 + "deep"), (4, "http://b.com", ""), (None, "http://b.com/1", None), (5, "", "<p>no url")]
    got = extracted(spark, pages)
    assert len(got[1]) == 5 * 200_000 - 1 and got[2] == " ".join("x" * 20_000) and (got[3], got[4], got[None], got[5]) == ("deep", "", "", "no url")
