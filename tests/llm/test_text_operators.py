"""Text operators against brute force, and on awkward rows."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import duck_rows, spark_rows
from voxframe.llm import bpe_chunks, components, decontaminate, html_text, jaccard_join, kneser_ney, line_dedup, mpeg_audio, pii, queries, quotes, token_files, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    long = "word " * 40_000 + "x" * 30_000
    data = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, " \t\n ", "en", "s", 4), (3, long, "en", "s", 1), (4, long, "en", "s", 1), (5, "a b", "de", "s", 3), (5, "a b", "de", "s", 3), (6, "a b", "de", "s", 3), (7, "line one is long enough\nline one is long enough\n\n", "fr", "s", 1), (8, "LINE ONE IS LONG ENOUGH ", "xx", "s", 1), (None, "no id at all here", "en", "s", 1), (9, "é́ \U0001f600 <|endoftext|> it's", "es", "s", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    extra = "ids long, shared long, keys string, n_lines long, component string, rep long, role string, held boolean, decoded long"
    return df.selectExpr("*", *[f"cast(1 as {x.split()[1]}) AS {x.split()[0]}" for x in extra.split(", ")])


def labels_of(spark, n=0):
    return spark.createDataFrame([(i, 1, 0) for i in range(n)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck_rows(queries.ORACLES[name], SF)


# --- quality ----------------------------------------------------------------------------------------------------


def brute_model(texts, order):
    """P(last byte | context) by the definition, from dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        b = b"\0" * (order - 1) + t.encode() + b"\0"
        for i in range(len(b) - order + 1):
            counts[order][b[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    discounts, totals, gammas = {}, [defaultdict(int) for _ in range(order + 1)], [defaultdict(float) for _ in range(order + 1)]
    for k in range(1, order + 1):
        n = [sum(c == i for c in counts[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        discounts[k] = [0] + [min(max((i - (i + 1) * y * n[i + 1] / n[i]) if n[i] else 0.5 * i, 0.1), 0.95 * i) for i in (1, 2, 3)]
        for g, c in counts[k].items():
            totals[k][g[:-1]] += c
            gammas[k][g[:-1]] += discounts[k][min(c, 3)]

    def p(g):
        if not g:
            return 1 / 256
        k, low = len(g), p(g[1:])
        u = g[:-1]
        if u not in totals[k]:
            return low
        c = counts[k][g]
        return (c - discounts[k][min(c, 3)] if c else 0) / totals[k][u] + gammas[k][u] / totals[k][u] * low

    return p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_equals_brute_force(spark, order):
    r = random.Random(order)
    texts = ["".join(r.choice("abcd é") for _ in range(r.randint(0, 60))) for _ in range(40)]
    docs = docs_of(spark, texts)
    model = kneser_ney.train(docs.where("doc_id < 30"), order)
    got = {x["doc_id"]: (x["n_grams"], x["loss"]) for x in kneser_ney.losses(docs, model, order, 3).collect()}
    p = brute_model(texts[:30], order)
    for i, t in enumerate(texts):
        b = b"\0" * (order - 1) + t.encode() + b"\0"
        want = -sum(np.log(p(b[j : j + order])) for j in range(len(b) - order + 1))
        assert got[i] == (len(t.encode()) + 1, pytest.approx(want, rel=1e-9))


def test_classifier_separates(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    told = {x["doc_id"]: x["rejected"] for x in kneser_ney.classify(docs, labels).collect()}
    rows = [x for x in labels.collect() if x["toxic"] == 0]
    good, bad = [told[x["doc_id"]] for x in rows if x["quality"] == 1], [told[x["doc_id"]] for x in rows if x["quality"] == 0]
    assert len(told) == docs.count() and np.mean(good) < 0.08 and np.mean(bad) > 0.8


def test_classifier_on_awkward_rows(spark):
    df = awkward(spark)
    got = kneser_ney.classify(df, labels_of(spark, 12)).collect()
    assert {x["doc_id"] for x in got} <= set(range(10))
    assert kneser_ney.keep_good(df, labels_of(spark)).columns == df.columns
    assert kneser_ney.keep_good(df.limit(0), labels_of(spark)).count() == 0
    assert kneser_ney.keep_good(df, labels_of(spark).limit(0)).count() == df.count()


def test_toxic_documents_are_rejected(spark):
    """English documents with toxic words among good text, of which every other one was not trained on."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    told = {x["doc_id"]: x["rejected"] for x in kneser_ney.classify(docs, labels.where("toxic = 0 OR doc_id % 2 = 0")).collect()}
    rows = labels.join(docs.select("doc_id", "lang"), "doc_id").where("quality = 1 AND lang = 'en'").collect()
    unseen, clean = [told[x["doc_id"]] for x in rows if x["toxic"] == 1 and x["doc_id"] % 2], [told[x["doc_id"]] for x in rows if x["toxic"] == 0]
    assert len(unseen) > 5 and np.mean(unseen) > 0.9 and np.mean(clean) < 0.08


def test_windows_equal_brute_force():
    r = np.random.default_rng(3)
    sizes = np.array([1, 3, 4, 5, 40, 2])
    starts, values = np.cumsum(sizes) - sizes, r.normal(size=sizes.sum())
    want = [max(v[i : i + 4].sum() for i in range(max(1, len(v) - 3))) for v in np.split(values, starts[1:])]
    assert kneser_ney.peaks(values, starts, 4) == pytest.approx(want)


def test_model_sees_more_than_trigrams(spark):
    """The second text has the trigrams of the first, in other words."""
    docs = docs_of(spark, ["pxyzq   rxyzs   " * 30, "pxyzs   rxyzq   " * 30])
    loss = {x["doc_id"]: x["loss"] for x in kneser_ney.losses(docs, kneser_ney.train(docs.where("doc_id = 0"))).collect()}
    assert loss[1] > 1.5 * loss[0]


def test_untrained_languages_have_rows(spark):
    docs = docs_of(spark, ["good text of one language " * 3] * 12 + ["keiner kennt diese Sprache", None, ""], {12: "xx", 13: "yy", 14: None})
    got = {x["doc_id"]: x for x in kneser_ney.classify(docs, labels_of(spark, 12)).collect()}
    assert sorted(got) == list(range(15))
    for i in (12, 13, 14):
        assert got[i]["perplexity"] is None and got[i]["threshold"] is None and got[i]["rejected"] is False and got[i]["n_grams"] >= 1


# --- html -------------------------------------------------------------------------------------------------------


def test_html_of_all_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    for p in pages.collect():
        inner = p["html"].split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", inner.replace("<b>", "").replace("<br>", " "))
        want = "\n".join(b for b in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in blocks) if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


BODY = "".join(f"<p>Sentence number {i} of an article that goes on for some while.</p>" for i in range(6))


@pytest.mark.parametrize("before, after", [
    ('<div id="menu"><a href=x>Home</a><a href=y>News</a></div>', '<div class="comments"><p>' + "nice post " * 30 + "</p></div>"),
    ("<header><h2>Site</h2></header><nav><ul><li><a href=q>One</a></ul></nav>", "<footer>Imprint</footer>"),
    ('<div class="cookie-notice">We use cookies ' + "and more " * 30 + "</div>", '<aside class="sidebar">Other ' + "things " * 20 + "</aside>"),
    ('<div class="header"><p>Welcome to our pages</p></div><p class="notice">We have moved.<p style="display:none">secret</p>', '<ol class="comment-list"><li>First!</li></ol><ul><li class="ad">Buy</li></ul>'),
    ('<form><label>Mail</label><input name=m><textarea>write here</textarea></form><script>var x = "<p>no</p>";</script>', '<div class="ad banner">Buy now</div><!-- no -->'),
])
def test_html_regions(before, after):
    want = "\n".join(f"Sentence number {i} of an article that goes on for some while." for i in range(6))
    assert html_text.extract(f"<html><head><title>t</title></head><body>{before}<article>{BODY}</article>{after}</body></html>") == want
    assert html_text.extract(f'<body>{before}<div class="content">{BODY}</div>{after}') == want


def test_html_odd_pages(spark):
    for page, want in ((None, ""), ("", ""), ("just text", "just text"), ("<p>a &amp;  &#233;\n b", "a & é b"), ("<script>x", ""), ("<nav><ul><li>m<article><p>Body</p></article>", "Body"), ("<b>" * 3000 + "deep", "deep"), ("</div></p></html>", "")):
        assert html_text.extract(page) == want
    empty = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert html_text.main_text(empty).count() == 0


@pytest.mark.parametrize("page", [
    "<html><head><title>t</title><script>var x;</script><body><article>{}</article>",
    "<html><head><meta charset=utf-8><noscript><img src=x></noscript><title>t</title><article>{}</article>",
    "<head><title>t</title></head><body><article>{}</article>",
])
def test_html_head_without_end(page):
    assert html_text.extract(page.format(BODY)) == "\n".join(re.findall("<p>(.*?)</p>", BODY))


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "content-area no-sidebar", "single comments-open"])
def test_html_layout_wrappers(wrapper):
    want = "\n".join(re.findall("<p>(.*?)</p>", BODY))
    for tag in ("article", "main"):
        assert html_text.extract(f'<body><div class="{wrapper}"><{tag}>{BODY}<div class="share">Share it</div></{tag}><div class="sidebar">Other things</div><article class="comment">Nice</article></div>') == want
    assert html_text.extract(f'<body><div class="{wrapper}" hidden><article>{BODY}</article></div>') == ""
    assert html_text.extract(f'<body><article>{BODY}</article><div class="related"><article><p>{"Another one. " * 90}</p></article></div>') == want


PROSE = [
    "The ferry left the harbour at six and reached the island before the fog had lifted from the cliffs.",
    "Nobody on board had slept, and the cook handed out coffee in tin mugs as if it were medicine.",
    "Short one.",
    "By noon the wind had turned, so the crew tied everything down and waited below for the rain to pass.",
    "What they saw the next morning is described in the second part of this report, with a map.",
]
P = "".join(f"<p>{x}</p>" for x in PROSE)
SOUP = "".join(f"<div>{x}</div>" for x in PROSE)
LINKS = "".join(f'<div><a href="/{i}">Topic {i}</a></div>' for i in range(9))
LIST = "<ul><li>two ropes</li><li>one lamp</li></ul>"
#: Where the article is, and what its text is: layouts of all ages, most of which do not say what is content.
LAYOUTS = {
    "article": ("<article><h1>Fog</h1>{p}</article>", ["Fog", *PROSE]),
    "main": ("<main><h1>Fog</h1>{p}{list}</main>", ["Fog", *PROSE, "two ropes", "one lamp"]),
    "named div": ('<div class="post-body"><h2>Fog</h2>{p}</div>', ["Fog", *PROSE]),
    "plain div": ("<div><h2>Fog</h2>{p}</div>", ["Fog", *PROSE]),
    "list inside": ("<div><h2>Fog</h2><p>" + PROSE[0] + "</p>{list}{p}</div>", ["Fog", PROSE[0], "two ropes", "one lamp", *PROSE]),
    "div soup": ("<div><div>{soup}</div></div>", PROSE),
    "deep": ('<div id="a1"><div id="b2"><div id="c3"><h1>Fog</h1>{p}</div></div></div>', ["Fog", *PROSE]),
    "table": ("<table><tr><td><h1>Fog</h1>{p}</td></tr></table>", ["Fog", *PROSE]),
    "own header": ("<article><header><h1>Fog</h1><p>by a passenger</p></header>{p}</article>", ["Fog", "by a passenger", *PROSE]),
    "own sections": ('<article><h1>Fog</h1><section id="discussion">{p}</section><h2 class="related-work">Work</h2><div class="legal">' + PROSE[3] + "</div></article>", ["Fog", *PROSE, "Work", PROSE[3]]),
    "side by side": ('<div class="row layout has-sidebar"><div class="col"><h1>Fog</h1>{p}</div><div class="sidebar">' + PROSE[1] + "</div></div>", ["Fog", *PROSE]),
    "no ads": ('<div class="page no-ads"><div class="article-footer">Filed under sea</div><div><h1>Fog</h1>{p}</div></div>', ["Fog", *PROSE]),
    "advert inside": ('<article><h1>Fog</h1>{p}<div class="ad-slot">Buy one boat, get one free</div><p>' + PROSE[0] + '</p><div class="share-buttons">Share this</div></article>', ["Fog", *PROSE, PROSE[0]]),
    "unclosed button": ("<div><button>Print<h1>Fog</h1>{p}</div>", ["Fog", *PROSE]),
    "unclosed select": ("<div><div><select><option>A<option>B</div><h1>Fog</h1>{p}</div>", ["Fog", *PROSE]),
    "quotation": ("<div><h1>Fog</h1><blockquote>{p}</blockquote><p>" + PROSE[4] + "</p></div>", ["Fog", *PROSE, PROSE[4]]),
}
AROUND = {
    "nothing": ("", ""),
    "named": ('<div class="site-header">The Sea</div><div id="navigation">' + LINKS + "</div>", '<div class="comments"><p>' + PROSE[0] + "</p><p>" + PROSE[1] + '</p></div><div id="footer">Imprint</div>'),
    "elements": ("<header><h2>The Sea</h2></header><nav>" + LINKS + "</nav>", "<aside>" + PROSE[3] + "</aside><footer>Imprint</footer>"),
    "unnamed": ("<div>" + LINKS + "</div>", "<div>" + LINKS + "</div><div><div>About</div><div>Terms</div><div>Press</div></div>"),
}


@pytest.mark.parametrize("around", sorted(AROUND))
@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_html_layouts(layout, around):
    body, want = LAYOUTS[layout]
    before, after = AROUND[around]
    page = "<!doctype html><html><head><title>Fog</title><body>" + before + body.format(p=P, soup=SOUP, list=LIST) + after
    assert html_text.extract(page) == "\n".join(want)


def test_html_density_decides(monkeypatch):
    """Without smoothing and clustering, pages whose parts have no names give other texts."""
    pages = [AROUND["unnamed"][0] + body.format(p=P, soup=SOUP, list=LIST) + AROUND["unnamed"][1] for body, _ in LAYOUTS.values()]
    told = [html_text.extract(p) for p in pages]
    monkeypatch.setattr(html_text, "dense_lines", lambda ratio: np.ones(len(ratio), bool))
    assert sum(html_text.extract(p) != t for p, t in zip(pages, told, strict=True)) > 3
    monkeypatch.setattr(html_text, "dense_lines", lambda ratio: np.zeros(len(ratio), bool))
    assert sum(html_text.extract(p) != t for p, t in zip(pages, told, strict=True)) > 3


def test_html_awkward_rows(spark):
    long = "<article>" + "<p>a paragraph of a very long page</p>" * 20_000 + "</article>"
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, "<p>y"), (2, None, None), (3, "v", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in html_text.main_text(df).collect())
    assert got == [(0, "", 1), (1, "u", 1), (1, "u", 1), (2, "", 0), (3, "v", 20_000 * 32 - 1)]


# --- chats ------------------------------------------------------------------------------------------------------

CHAT = [
    (1, 0, "user", "The boiler in the north hall has stopped again.\nCould someone have a look at it?"),
    (1, 1, "assistant", "> The boiler in the north hall has stopped again.\nI will send a technician this afternoon."),
    (1, 2, "user", "On Monday A wrote:\n> > The boiler in the north hall has stopped again.\n> I will send a technician this afternoon.\nThank you, that suits us well."),
    (1, 3, "user", "An unrelated question about the parking spaces."),
    (1, 4, "assistant", "> Could someone have a look at it?\n>\nYes, of course we can."),
    (1, 5, "assistant", ">The boiler in the\n> north hall has stopped again. Could someone have a look at it?\nWhole message quoted, wrapped anew."),
    (2, 0, "user", "> nothing that anybody said before\nalone"),
    (3, 0, None, None), (None, 1, "user", "> no conversation\nx"), (3, 1, "", ""), (3, 1, "", ""),
]


def test_quotes(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS path", "2 AS key")
    rows = quotes.reply_ordered(df).collect()
    assert len(rows) == len(CHAT)
    one = {r["turn"]: r for r in rows if r["conv_id"] == 1}
    assert [one[t]["parent_turn"] for t in range(6)] == [None, 0, 1, None, 0, 0]
    assert [one[t]["depth"] for t in range(6)] == [0, 1, 2, 0, 1, 1]
    assert one[2]["content"] == "Thank you, that suits us well." and one[2]["n_passages"] == 2
    assert sorted(one, key=lambda t: (one[t]["root_turn"], one[t]["position"])) == [0, 1, 2, 4, 5, 3]
    assert one[3]["formatted"] == "<|user|>\nAn unrelated question about the parking spaces."
    assert next(r for r in rows if r["conv_id"] == 2)["parent_turn"] is None
    assert quotes.reply_ordered(df.limit(0)).count() == 0


def test_quotes_equal_sql_on_quotes(spark, tmp_path):
    import duckdb

    r = random.Random(2)
    short = ["yes", "no", "maybe so", "I see", "ok"]
    more = [(c, t, "user", "\n".join(["> " * r.randint(0, 2) + r.choice(short) for _ in range(r.randint(1, 4))])) for c in (7, 8) for t in range(25)]
    chat = [c for c in CHAT if c[0] is not None] + more
    spark.createDataFrame(chat, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations/*.parquet'")
    r = con.sql(queries.ORACLES["op3_quotes"])
    names, got = spark_rows(quotes.reply_ordered(spark.read.parquet(f"{tmp_path}/conversations")))
    at = [r.columns.index(n) for n in names]
    assert got == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)


def test_long_reply_chain(spark):
    say = [f"Message number {i} says something of its own." for i in range(40)]
    rows = [(1, i, "user", (f"> {say[i - 1]}\n" if i else "") + say[i]) for i in range(40)]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["turn"]: (r["root_turn"], r["depth"], r["position"]) for r in got} == {i: (0, i, i) for i in range(40)}


def test_short_passages_link(spark):
    rows = [(1, 0, "user", "Shall I send it?\nYes please"), (1, 1, "user", "> Yes please\nDone."), (1, 2, "user", "> ...\nWhat?"), (1, 3, "user", ">ok\nok"), (1, 4, "user", "> ok\nfine")]
    got = {r["turn"]: r["parent_turn"] for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: 0, 2: None, 3: None, 4: 3}


def test_reply_trees_equal_a_walk(spark):
    r = random.Random(8)
    parents = [(c, t, r.randrange(max(0, t - 6), t)) for c in range(5) for t in range(1, 80) if r.random() < 0.8]
    got = {(x["conv_id"], x["turn"]): (x["root_turn"], x["depth"], x["position"]) for x in quotes.trees(spark.createDataFrame(parents, "conv_id long, turn long, parent long")).collect()}
    below, up = defaultdict(list), {(c, t): p for c, t, p in parents}
    for c, t, p in parents:
        below[c, p].append(t)
    want = {}

    def walk(c, t, root, depth, count):
        want[c, t] = (root, depth, next(count))
        for child in sorted(below[c, t]):
            walk(c, child, root, depth + 1, count)

    for c, t in list(below):
        if (c, t) not in up:
            walk(c, t, t, 0, iter(range(1000)))
    assert got == {k: v for k, v in want.items() if k in up}


# --- similarity -------------------------------------------------------------------------------------------------


def brute_classes(texts, percent=80):
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("most", [2_000_000, 600])
def test_similarity_equals_brute_force(spark, most):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    bases = [[r.choice(vocab) for _ in range(r.choice([3, 6, 30, 120]))] for _ in range(12)]
    texts = []
    for _ in range(160):
        t = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            t[r.randrange(len(t))] = r.choice(vocab).upper()
        texts.append(r.choice([" ", "\t", "\n "]).join(t))
    texts += ["", None, " ", "one", "ONE", "one two"]
    got = {x[0]: (x[1], x[2]) for x in jaccard_join.join_similar(docs_of(spark, texts), most=most).collect()}
    assert got == brute_classes(list(enumerate(texts)))


@pytest.mark.parametrize("most, frequent", [(300, 2), (1500, 3), (10**6, 2)])
def test_similarity_of_shared_passages(spark, monkeypatch, most, frequent):
    """Two groups of near copies that share a passage with many other documents: several leaders, frequent shingles last."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage, bases, texts = [word() for _ in range(25)], [[word() for _ in range(80)] for _ in range(3)], []
    for i in range(150):
        t = list(bases[i % 3]) if i % 5 else [word() for _ in range(60)]
        for _ in range(r.choice([0, 1, 2, 3])):
            t[r.randrange(len(t))] = word()
        texts.append(" ".join(t[:20] + passage + t[20:]))
    got = {x[0]: (x[1], x[2]) for x in jaccard_join.join_similar(docs_of(spark, texts), most=most).collect()}
    assert got == brute_classes(list(enumerate(texts)))


def test_similarity_of_a_chain_in_blocks(spark):
    """Neighbours are linked, the ends share nothing: no leader holds them together."""
    texts = [" ".join(f"w{j}" for j in range(8 * i, 8 * i + 100)) for i in range(60)]
    got = {x[0]: (x[1], x[2]) for x in jaccard_join.join_similar(docs_of(spark, texts), most=900).collect()}
    assert got == brute_classes(list(enumerate(texts))) and {v[1] for v in got.values()} == {0}


def test_similarity_on_awkward_rows(spark):
    df = awkward(spark)
    got = sorted((x[0], x[2]) for x in jaccard_join.join_similar(df).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9)]
    kept = jaccard_join.keep_first(df)
    assert kept.columns == df.columns and sorted(x[0] for x in kept.where("doc_id IS NOT NULL").select("doc_id").collect()) == [0, 1, 2, 3, 5, 5, 7, 8, 9]
    assert jaccard_join.join_similar(df.limit(0)).count() == 0


def test_possible_never_rejects_a_link():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(40)]
    sets += [s[r.random(len(s)) < 0.9] for s in sets if len(s) > 5]
    tree = jaccard_join.SignatureTree(sets, 256)
    i, j = (x.ravel() for x in np.indices((len(sets),) * 2))
    ok = jaccard_join.possible(tree.levels[0], tree.levels[0], i, j, 80)
    for a, b, o in zip(i, j, ok, strict=True):
        assert o or not jaccard_join.linked(sets[a], sets[b], 80) or not len(sets[a])


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        return x if top[x] == x else find(top[x])

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            top[max(p, q)] = min(p, q)
    got = {x[0]: x[1] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(top)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- audio ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [192, 960, 937 * 2, 192 * 51, 192 * 400])
def test_audio_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = mpeg_audio.write_audio(payload)
    audio = mpeg_audio.read_audio(data)
    assert mpeg_audio.payload_of(data, audio) == payload and audio.crc_bad == 0 and audio.skipped == 0
    assert audio.vbr["frames"] == len(audio.headers) and audio.vbr["bytes"] == len(data) - mpeg_audio.id3_end(data, {})
    assert audio.duration == mpeg_audio.Fraction(1152 * len(audio.headers), 48000)
    assert [audio.seek(i * mpeg_audio.Fraction(1152, 48000)) for i in range(len(audio.headers))] == audio.offsets


def test_audio_after_damage():
    payload = b"\xff\xfb\x94\xc0" * 2400
    data = mpeg_audio.write_audio(payload)
    whole = mpeg_audio.read_audio(data)
    hurt = data[: whole.offsets[2]] + b"\0" * 77 + data[whole.offsets[2] :]
    assert len(mpeg_audio.read_audio(hurt).headers) >= len(whole.headers) - 1
    bad = bytearray(data)
    bad[whole.offsets[1] + 8] ^= 1
    assert mpeg_audio.read_audio(bytes(bad)).crc_bad == 1
    assert mpeg_audio.read_audio(b"").headers == [] and mpeg_audio.read_audio(b"\xff" * 500).headers == []
    assert mpeg_audio.header(b"\xff\xfb\x90\x00").size == 417 and mpeg_audio.header(b"\xff\xfb\xf0\x00") is None


def test_audio_columns(spark):
    df = awkward(spark)
    got = {r["doc_id"]: r for r in mpeg_audio.described(mpeg_audio.to_audio(df)).collect()}
    for r in df.collect():
        raw = (r["text"] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        x = got[r["doc_id"]]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert mpeg_audio.described(mpeg_audio.to_audio(df.limit(0))).count() == 0


def test_audio_with_tag_letters_in_the_text():
    for n, at in ((n, at) for n in (192, 384, 576, 768, 960) for at in range(n - 2)):
        payload = (b"x" * at + b"TAG").ljust(n, b"y")
        data = mpeg_audio.write_audio(payload)
        assert mpeg_audio.payload_of(data, mpeg_audio.read_audio(data)) == payload
    payload = b"MONTAG" * 3000
    data = mpeg_audio.write_audio(payload)
    tagged = mpeg_audio.read_audio(data + b"TAG".ljust(128, b"\xff"))
    assert tagged.offsets == mpeg_audio.read_audio(data).offsets and tagged.skipped == 0 and mpeg_audio.payload_of(data, tagged) == payload


def crc_of_bits(bits):
    crc = 0xFFFF
    for b in bits:
        crc = ((crc << 1) & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ b else 0)
    return crc


def frame_of(second, third, fourth, bits, size):
    """A protected frame whose checksum covers the header's last bytes and the given bits."""
    word = bytes([0xFF, second, third, fourth])
    flat = [b >> i & 1 for b in word[2:] for i in range(7, -1, -1)] + bits
    padded = bits + [0] * (-len(bits) % 8)
    body = bytes(int("".join(map(str, padded[j : j + 8])), 2) for j in range(0, len(padded), 8))
    return (word + crc_of_bits(flat).to_bytes(2, "big") + body).ljust(size, b"\x55")


@pytest.mark.parametrize("layer, mode, mode_ext, widths", [
    (1, 3, 0, [(4, 1)] * 32),  # mono: one allocation a subband
    (1, 0, 0, [(4, 2)] * 32),
    (1, 1, 1, [(4, 2)] * 8 + [(4, 1)] * 24),  # joint: shared from subband 8 on
    (2, 3, 0, [(4, 1)] * 11 + [(3, 1)] * 12 + [(2, 1)] * 4),
    (2, 0, 0, [(4, 2)] * 11 + [(3, 2)] * 12 + [(2, 2)] * 4),
    (2, 1, 0, [(4, 2)] * 4 + [(4, 1)] * 7 + [(3, 1)] * 12 + [(2, 1)] * 4),
])
def test_checksums_of_other_layers(layer, mode, mode_ext, widths):
    r = random.Random(layer + mode)
    third, fourth = 0xA0 | 1 << 2, mode << 6 | mode_ext << 4  # 48 kHz
    size = mpeg_audio.header(bytes([0xFF, 0xF8 | (4 - layer) << 1, third, fourth])).size
    data, scales = b"", 0
    for _ in range(3):
        bits = []
        scales = 0
        for width, n in widths:
            for _ in range(n):
                value = r.choice([0, r.randrange(1 << width)])
                bits += [value >> i & 1 for i in range(width - 1, -1, -1)]
                scales += bool(value) * (1 if n == 2 or mode == 3 else 2)
        if layer == 2:
            bits += [r.randrange(2) for _ in range(2 * scales)]
        data += frame_of(0xF8 | (4 - layer) << 1, third, fourth, bits, size)
    audio = mpeg_audio.read_audio(data)
    assert (audio.crc_good, audio.crc_bad, len(audio.headers)) == (3, 0, 3)
    hurt = bytearray(data)
    hurt[size + 8] ^= 0x10
    assert mpeg_audio.read_audio(bytes(hurt)).crc_bad == 1


def test_free_format_and_resync():
    one = bytes([0xFF, 0xFB, 1 << 2, 0xC0]) + bytes(700)
    audio = mpeg_audio.read_audio(b"".join([one] * 5))
    assert audio.offsets == [704 * i for i in range(5)] and audio.duration == 5 * mpeg_audio.Fraction(1152, 48000)
    ours = mpeg_audio.write_audio(bytes(3000))
    start = mpeg_audio.read_audio(ours).offsets
    noise = bytes([0xFF, 0xFB, 0x90, 0xC0]) + bytes(60)  # a header of another rate in between
    again = mpeg_audio.read_audio(ours[: start[1]] + noise + ours[start[1] :])
    assert len(again.offsets) == len(start) and again.skipped == 64


# --- personal data ----------------------------------------------------------------------------------------------


def patterns(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or pii.luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_patterns():
    r = random.Random(0)
    for alphabet in ("a1@.-+ ()0", "0123456789 -", "a@b.c ", "é1.2+٣"):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(t) == patterns(t), t
    pii.base_spans("a" * 300_000 + "1" * 300_000 + "@" * 1000)  # linear on long runs


def test_model_on_held_out_examples():
    r = random.Random(12345)
    rows = [pii.example(r) for _ in range(300)]
    found = pii.all_spans([t for t, _ in rows], pii.trained())
    hits = sum(len(set(got) & set(spans)) for (_, got), (_, spans) in zip(found, rows, strict=True))
    given, said = sum(len(s) for _, s in rows), sum(len(got) for _, got in found)
    base = sum(len(set(own) & set(spans)) for (own, _), (_, spans) in zip(found, rows, strict=True))
    assert hits / given > 0.8 and hits / said > 0.85 and hits > 1.5 * base


def test_gradients_are_right():
    g = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii.trained(3, 2).items()}
    x, y = pii.windows(random.Random(1), 2)
    x, y = x[:, :12], y[:, :12]
    _, grads = pii._loss(p, x, y)
    for name in p:
        spot = tuple(g.integers(0, n) for n in p[name].shape)
        if name == "embed":
            spot = (int(x[0, 3]), spot[1])
        keep = p[name][spot]
        p[name][spot] = keep + 1e-5
        up = pii._loss(p, x, y)[0]
        p[name][spot] = keep - 1e-5
        down = pii._loss(p, x, y)[0]
        p[name][spot] = keep
        assert grads[name][spot] == pytest.approx((up - down) / 2e-5, abs=1e-5, rel=1e-3)


def test_decoding_is_the_best_path():
    import itertools

    g = np.random.default_rng(1)
    moves = g.normal(size=(pii.TAGS,) * 2).astype(np.float32)
    tables = [g.normal(size=(n, pii.TAGS)).astype(np.float32) for n in (1, 3, 4)]
    for s, path in zip(tables, pii.decode(tables, moves), strict=True):
        value = lambda q, s=s: sum(s[i, t] for i, t in enumerate(q)) + sum(moves[a, b] for a, b in zip(q, q[1:], strict=False))
        assert value(path.tolist()) == pytest.approx(max(map(value, itertools.product(range(pii.TAGS), repeat=len(s)))), abs=1e-4)


def test_personal_columns(spark):
    df = awkward(spark).union(awkward(spark).limit(1).selectExpr("77L", "'a.b@c.de 1.2.3.4 and 4111 1111 1111 1111 or +49 30 1234567'", *awkward(spark).columns[2:]))
    got = {r["doc_id"]: r for r in pii.find_personal(df).collect()}
    x = got[77]
    assert (x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]) == (1, 1, 1, 1)
    own = pii.as_text(patterns("a.b@c.de 1.2.3.4 and 4111 1111 1111 1111 or +49 30 1234567"))
    assert x["base_sha256"] == hashlib.sha256(own.encode()).hexdigest() and set(own.split(",")) <= set(x["spans"].split(","))
    assert got[0]["spans"] == "" and got[3]["n_card"] == 0
    assert pii.find_personal(df.limit(0)).count() == 0


@pytest.mark.parametrize("before", [0, 1000, 1031])
def test_address_without_digits_or_at_sign(before):
    text = ("and so on " * 110)[:before] + " jane.doe (at) example dot com " + "and so on " * 100
    (own, spans), = pii.all_spans([text], pii.trained())
    assert own == [] and [(k, text[s:e]) for s, k, e in spans] == [(0, "jane.doe (at) example dot com")]


def test_unread_windows_hold_no_span(monkeypatch):
    """Reading every window finds no span, of those that are kept, away from the signs that open windows."""
    r = random.Random(12)
    texts = [" ".join(pii.example(r)[0] + " and so on" * r.choice([0, 20]) for _ in range(3)) for _ in range(60)]
    signs = [[m.span() for m in pii._OPENS.finditer(t)] for t in texts]
    monkeypatch.setattr(pii, "_OPENS", re.compile("(?s)."))
    for (_, spans), at in zip(pii.all_spans(texts, pii.trained()), signs, strict=True):
        assert all(any(s <= x and y <= e for x, y in at) for s, _, e in spans)


@pytest.mark.parametrize("kind", range(5))
def test_recall_of_the_model(kind):
    """On generated texts that were not trained on, exact spans."""
    r = random.Random(77)
    rows = [pii.example(r) for _ in range(400)]
    found = pii.all_spans([t for t, _ in rows], pii.trained())
    hits = [x in set(s) for (_, want), (_, s) in zip(rows, found, strict=True) for x in want if x[1] == kind]
    assert len(hits) > 100 and np.mean(hits) >= 0.95


def test_secrets_have_their_own_column(spark):
    text = 'Un token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" est la. Version 3.12 of a token'
    row = pii.find_personal(docs_of(spark, [text])).collect()[0]
    assert row["secrets"] == f"secret:{text.index('2321')}:{text.index('2321') + 40}" and row["n_found"] == 1 and row["spans"] == ""


# --- tokens -----------------------------------------------------------------------------------------------------

ODD = ["", "  ", "á\n ̈b", "ΑΣ Σ ΑΣ. Σ", "<|endoftext|>x <|start oftext|> <|endoftext|>", "it's we're'll 'd", "\t\x0b日本語 🎉👩‍👩‍👧 12 34", "x" * 5000, "İstanbul ǅ", "a b　c ͅ Å", "'", " s", "Ünïcode, Straße!! (ok)... --- a_b 3.14", "İ ß ﬁ ẞ"]


def fuzzed(n=300):
    r = random.Random(5)
    some = string.printable + "éüßÑ́‍日🎉İΣ  "
    return ["".join(r.choice(some) for _ in range(r.randint(0, 120))) for _ in range(n)]


def rows_of(ids, at):
    return [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_words_and_chunks_equal_the_library(monkeypatch, bits):
    monkeypatch.setattr(bpe_chunks, "CUT_BITS", bits)
    library = words.tokenizer()
    texts = ODD + [t * 40 for t in ODD] + fuzzed()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert rows_of(*words.ColumnEncoder().column(pa.array([*texts, None]))) == [*want, []]
    encoder = bpe_chunks.ChunkEncoder()
    assert rows_of(*encoder.column(pa.array([*texts, None]))) == [*want, []]
    made = encoder.chunks.made
    assert rows_of(*encoder.column(pa.array(texts))) == want and encoder.chunks.made == made and encoder.whole == 0
    small = bpe_chunks.ChunkEncoder(most=500)
    assert rows_of(*small.column(pa.array(texts))) == want and rows_of(*small.column(pa.array(texts[::-1]))) == want[::-1]


def test_chunks_are_encoded_once():
    """The encoder is given each distinct chunk once; of a second text with the same passage, only what is new and the joins."""
    given, one = [], words.ColumnEncoder()

    def counted(texts):
        given.append(sum(len(t.encode()) for t in texts.to_pylist()))
        return one.column(texts)

    r = random.Random(4)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(4000))
    encoder = bpe_chunks.ChunkEncoder(encode=counted)
    encoder.column(pa.array([passage]))
    first, given[:] = sum(given), []
    text = "Something else before it, " + passage + " and after it."
    assert rows_of(*encoder.column(pa.array([text]))) == [words.tokenizer().encode(text, add_special_tokens=False).ids]
    assert given[0] < 0.1 * len(passage) and sum(given) < 0.6 * first


def test_joins_grow_until_they_agree():
    """With a vocabulary whose tokens hold blanks, and an encoder that joins some neighbouring words, a window must grow."""
    import public_tokenizers

    library = words.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))

    def plain(texts):
        got = [e.ids for e in library.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)

    r = random.Random(6)
    texts = [" ".join(r.choice(["the", "a", "of", "it's", "x1", "(so)", "é", "\n", "\n\nno"]) for _ in range(r.randint(0, 600))) for _ in range(60)]
    encoder = bpe_chunks.ChunkEncoder(encode=plain)
    assert rows_of(*encoder.column(pa.array(texts))) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.grown > 0


def test_cuts_follow_content(monkeypatch):
    monkeypatch.setattr(bpe_chunks, "CUT_BITS", 6)
    a, b = random.Random(1).randbytes(4000), random.Random(2).randbytes(531)
    letters = lambda raw: np.frombuffer(bytes(97 + c % 26 for c in raw), np.uint8)
    one, two = bpe_chunks.cuts(letters(a)), bpe_chunks.cuts(letters(b + a))
    assert len(one) > 30 and set(one[one > 16].tolist()) <= {c - 531 for c in two.tolist()}
    assert not set(bpe_chunks.cuts(np.frombuffer("日本語".encode() * 500, np.uint8)).tolist()) & {i for i in range(4500) if i % 3}


def test_round_trip_columns(spark):
    df, library = awkward(spark), words.tokenizer()
    got = {r["doc_id"]: r for r in bpe_chunks.round_trip(df, with_ids=True).collect()}
    stored = {r["doc_id"]: r for r in bpe_chunks.decode(bpe_chunks.encode(df)).collect()}
    for r in df.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        x = got[r["doc_id"]]
        text = library.decode(ids, skip_special_tokens=False)
        assert (x["n_tokens"], x["ids"]) == (len(ids), ids)
        assert x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and x["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert stored[r["doc_id"]]["ids"] == ids and stored[r["doc_id"]]["decoded"] == text
    assert bpe_chunks.round_trip(df.limit(0)).count() == 0


def test_token_files(spark, tmp_path):
    df, library = awkward(spark), words.tokenizer()
    folder = f"file://{tmp_path}/ids"
    token_files.write(df, folder)
    got = sorted((tuple(r) for r in token_files.offsets(token_files.read(spark, folder)).collect()), key=lambda r: r[1])
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))  # rows 5 are equal
    start = 0
    for (doc, text), g in zip(rows, got, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert g == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_files.read(spark, folder, [3, 9, 1234])
    assert sorted(r["doc_id"] for r in some.collect()) == [3, 9]
    assert "doc_id" in some._jdf.queryExecution().toString().split("PushedFilters")[1][:120]
    assert token_files.written_and_read(df.limit(0)).count() == 0


def test_token_files_with_repeated_ids(spark, tmp_path):
    """Equal ids start where they lie: no two rows overlap, and the files hold at each start what the row says."""
    rows = [(i // 5, f"word{i} " * (i % 11), "en", "s", 0) for i in range(300)]
    folder = f"file://{tmp_path}/ids"
    token_files.write(spark.createDataFrame(rows, SCHEMA).repartition(3), folder)
    flat = [i for p in sorted((r for r in token_files.read(spark, folder).selectExpr("*", "_metadata.file_name AS f", "monotonically_increasing_id() AS m").collect()), key=lambda r: (r["doc_id"] // 1, r["f"], r["m"])) for i in p["ids"]]
    got = sorted(tuple(r) for r in token_files.offsets(token_files.read(spark, folder)).select("start", "n_tokens", "ids_crc32").collect())
    at = 0
    for start, n, crc in got:
        assert start == at and crc == zlib.crc32(np.array(flat[start : start + n], "<u4").tobytes())
        at += n
    assert at == len(flat)


def test_runs_of_letters_that_the_vocabulary_splits(monkeypatch):
    encoder = words.ColumnEncoder()
    monkeypatch.setattr(encoder, "ends", np.zeros_like(encoder.ends))
    texts = ["some words and others", "words again"]
    assert rows_of(*encoder.column(pa.array(texts))) == [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_token_files_with_and_without_a_shuffle(spark, tmp_path):
    texts = [f"text number {i} " * (i % 7) for i in range(200)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    random.Random(0).shuffle(rows)
    mixed = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sorted_ = mixed.repartitionByRange(5, "doc_id")
    assert not token_files.in_order(mixed) and token_files.in_order(sorted_)
    got = [sorted(map(tuple, token_files.written_and_read(d).collect())) for d in (mixed, sorted_)]
    assert got[0] == got[1] and len(got[0]) == 200
    mixed.select("doc_id", F.array(F.lit(2)).alias("ids")).write.orc(f"{tmp_path}/wrong")
    with pytest.raises(Exception, match="order of doc_id"):
        token_files.offsets(token_files.read(spark, f"{tmp_path}/wrong")).collect()


# --- decontamination --------------------------------------------------------------------------------------------


def best_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        before, row[0] = row[0], 0
        for i in range(1, len(item) + 1):
            before, row[i] = row[i], min(before + (item[i - 1] != c), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def test_leaks_equal_brute_force():
    r = random.Random(3)
    items = [(i, "".join(r.choice("abcde ") for _ in range(r.choice([10, 45, 64, 65, 130, 200])))) for i in range(12)]
    docs = []
    for _ in range(90):
        t = list(r.choice(items)[1])
        for _ in range(r.randrange(0, int(len(t) * 0.12) + 1)):
            j = r.randrange(len(t))
            t[j : j + r.randint(0, 1)] = r.choice(["", "a", "b", "xy"])
        docs.append("".join(r.choice("abcde ") for _ in range(r.randrange(150))) + " " + "".join(t).upper() + " " + "".join(r.choice("abcde ") for _ in range(r.randrange(150))))
    m = decontaminate.Matcher(items)
    raw, at = decontaminate.normal_texts(pa.array(docs))
    want = {}
    for row in range(len(docs)):
        text = raw[at[row] : at[row + 1]].tolist()
        for j, item in enumerate(m.ids):
            d = best_distance(m.texts[j].tolist(), text)
            if d <= m.budgets[j]:
                want[row, item] = d
    assert {(row, item): d for row, item, d in m.batch(raw, at)} == want and any(want.values())


def test_leaks_on_awkward_rows(spark):
    df = awkward(spark)
    items = spark.createDataFrame([(1, "Line one, is long enough"), (2, None), (None, "no id at all here"), (3, ""), (4, "zz"), (5, "It's")], "item_id long, text string")
    got = {(r[0], r[1]) for r in decontaminate.find_leaks(df, items, pass_bytes=30).collect()}
    assert got == {(7, 1), (8, 1), (9, 5)}
    assert decontaminate.keep_clean(df, items).columns == df.columns
    assert decontaminate.find_leaks(df, items.limit(0)).count() == 0 and decontaminate.find_leaks(df.limit(0), items).count() == 0


def test_short_items_have_a_budget(spark):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over a dog"), (2, "a short item")], "item_id long, text string")
    texts = ["Then the quick, brown fox jumped over a dog again.", "This is a short  ITEM!", "a shore item", "The slow brown fox sat on a dog"]
    got = sorted(tuple(r) for r in decontaminate.find_leaks(docs_of(spark, texts), items).collect())
    assert got == [(0, 1, 2), (1, 2, 0)]


def test_passes_of_a_large_benchmark(spark):
    r = random.Random(3)
    items = [(i, " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(r.randint(1, 30)))) for i in range(40)]
    texts = [f"before {items[i % 40][1]} and after {items[(7 * i) % 40][1]}" for i in range(60)]
    one, many = (sorted(map(tuple, decontaminate.find_leaks(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), pass_bytes=n).collect())) for n in (10**6, 900))
    assert one == many and len(one) >= 100


# --- lines ------------------------------------------------------------------------------------------------------


def brute_lines(texts):
    blank = " \t\n\x0b\x0c\r"
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    owner = {}
    for d, t in texts:
        for line in (t or "").split("\n"):
            k = line.strip(blank).translate(low)
            if len(k) >= 10:
                owner[k] = min(d, owner.get(k, d))
    out = {}
    for d, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(x.strip(blank).translate(low), d) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_lines_equal_brute_force(spark, batches):
    r = random.Random(2)
    pool = [" ".join(r.choice(["ab", "Éé", "ÀB", "longer", "x"]) for _ in range(r.randint(1, 6))) for _ in range(40)]
    texts = [None, ""] + ["\n".join(r.choice(["", " ", "\t"]) + r.choice(pool) + r.choice(["", " \r"]) for _ in range(r.randint(1, 8))) for _ in range(120)]
    got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["text"]) for x in line_dedup.dedup_lines(docs_of(spark, texts), batches, 2).collect()}
    assert got == brute_lines(list(enumerate(texts)))


def test_lines_on_awkward_rows(spark):
    df = awkward(spark)
    got = line_dedup.dedup_lines(df)
    assert set(got.columns) == set(df.columns) - {"keys"} | {"n_dropped"}
    rows = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()}
    assert rows[7] == (4, 0, "line one is long enough\nline one is long enough\n\n") and rows[8] == (1, 1, "") and rows[4] == (1, 1, "") and rows[None] == (1, 0, "no id at all here") and rows[0] == (1, 0, "")
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_runs_are_reopened_by_a_later_job(spark, tmp_path):
    """Three jobs over one folder drop what one job over all documents drops; a job lost on the way leaves the runs as they were."""
    r = random.Random(9)
    pool = [f"a line that repeats, number {i}" for i in range(60)]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 6))) for _ in range(90)]
    folder = f"file://{tmp_path}/runs"
    docs, got = docs_of(spark, texts), {}
    for lo in (0, 30, 60):
        part = docs.where(f"doc_id >= {lo} AND doc_id < {lo + 30}")
        got |= {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["text"]) for x in line_dedup.dedup_lines(part, 2, 2, folder).collect()}
    assert got == brute_lines(list(enumerate(texts)))
    runs = line_dedup.LineRuns(spark, folder, 2)
    known = runs.all().count()
    assert known == len({x for t in texts for x in t.split("\n")}) and sum(map(len, runs.levels.values())) <= 3
    runs._write(runs.all(), 0)  # a run that no manifest lists
    assert line_dedup.LineRuns(spark, folder, 2).all().count() == known
