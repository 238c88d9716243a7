"""Queries and rules that SQL can't express, against plain versions in Python."""

import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import registry
from millrace.functions import money, text
from millrace.operators import matching, evals, extract
from millrace.sources import feeds

QUERIES = registry.queries()


def table(spark, small, name):
    return spark.read.parquet(f"{small}/{name}.parquet").collect()


class Markup(HTMLParser):
    """Tags with their attributes, and the text outside scripts and styles."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.tags, self.texts, self.hidden = [], [], 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.tags.append((tag, attrs))

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        self.texts += [] if self.hidden else [data]

    def handle_entityref(self, name):
        self.texts += [] if self.hidden else [f"&{name};"]


def check_clean(dirty, clean):
    parsed = Markup(clean)
    for tag, attrs in parsed.tags:
        assert tag in text.KEPT_TAGS, clean
        assert all(tag == "a" and name in ("href", "title") for name, _ in attrs), clean
        for name, value in attrs:
            bare = "".join(c for c in (value or "").lower() if c > " ")
            assert name != "href" or bare.startswith(("http:", "https:", "mailto:")) or ":" not in bare.split("/")[0].split("?")[0].split("#")[0], clean
    return parsed


def test_sanitized_pages_hold_kept_markup_alone(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("html", text.sanitized("html").alias("clean")).collect()
    for r in pages:
        want, got = Markup(r.html), check_clean(r.html, r.clean)
        assert "".join(got.texts).split() == "".join(want.texts).split()
        assert [t for t, _ in got.tags] == [t for t, _ in want.tags if t in text.KEPT_TAGS]


BAD = [
    ('<a href="javascript:alert(1)">x</a>', "<a>x</a>"),
    ('<a href="jav&#x09;ascript:alert(1)">x</a>', "<a>x</a>"),
    ("<a href=' JavaScript:alert(1)' title='t'>x</a>", '<a title="t">x</a>'),
    ("y <img src=x onerror=e() ", "y &lt;img src=x onerror=e() "),
    (f'<a href="/{"u" * 4100}" onclick="e()">x</a>', f'<a href="/{"u" * 4100}">x</a>'),
    ('<p title="a>b" onclick="x">y</p>', "<p>y</p>"),
    ("<script>let a = '<p>'", ""),
    ("<scr<script></script>ipt>alert(1)</scr<script></script>ipt>", "alert(1)"),
    ("a < b and c > d", "a &lt; b and c > d"),
    ('<a data-x="href=javascript:1" href="https://a.b/?q=1&x=2">k</a><br/>', '<a href="https://a.b/?q=1&x=2">k</a><br/>'),
    ("<!-- <p>x</p> --><B>b</B><P>c", "b<p>c"),
    ("", ""),
]


def test_sanitized_cases(spark):
    got = spark.createDataFrame([(h,) for h, _ in BAD], "h string").select("h", text.sanitized("h").alias("s")).collect()
    assert [(r.h, r.s) for r in got] == BAD
    for r in got:
        check_clean(r.h, r.s)


def test_sanitized_random_markup(spark):
    dice, parts = random.Random(3), ["<", ">", "<p", "</p>", "<a ", 'href="', "javascript:", "x", '"', "'", " onclick=", "<script>", "</script>", "<!--", "-->", "<img src=x", "/", " ", "title='"]
    dirty = ["".join(dice.choice(parts) for _ in range(dice.randint(1, 14))) for _ in range(600)]
    for r in spark.createDataFrame([(h,) for h in dirty], "h string").select("h", text.sanitized("h").alias("s")).collect():
        check_clean(r.h, r.s)


def plain_similarity(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    if a and b and (a in b or b in a):
        return max(0.6, min(len(a), len(b)) / max(len(a), len(b)))
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def greedy(left, right, least):
    free, out = dict(right), []
    for pos, title in left:
        best, at = 0.0, None
        for other, candidate in free.items():
            if (s := plain_similarity(title, candidate)) >= least and s > best:
                best, at = s, other
        free.pop(at, None)
        out.append((pos, at, round(best, 6)))
    return out


def test_fuzzy_match(spark, small):
    left, right = defaultdict(list), defaultdict(list)
    for r in sorted(table(spark, small, "supplier"), key=lambda r: r.s_suppkey):
        left[r.s_nationkey].append((r.s_suppkey, r.s_name))
    for r in sorted(table(spark, small, "customer"), key=lambda r: r.c_custkey):
        right[r.c_nationkey].append((r.c_custkey, r.c_name.replace("Customer", "Supplier")))
    want = {(site, *m) for site in left for m in greedy(left[site], right[site], 0.8)}
    assert {(r.site, r.pos, r.matched, r.similarity) for r in QUERIES["fuzzy_match"](spark, small).collect() if r.pos is not None} == want


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_greedy_match_of_odd_titles(spark, least):
    dice = random.Random(least)
    words = ["red", "blue shoe", "Shoe", "lamp", "a", "", "lamp shade", "blue"]
    left, right = ([(i, " ".join(dice.choice(words) for _ in range(dice.randint(0, 3)))) for i in range(30)] for _ in range(2))
    frames = [spark.createDataFrame([(1, p, t) for p, t in side], "site int, pos bigint, title string") for side in (left, right)]
    for most in (100_000, 3):  # in one task, and in rounds
        got = evals.greedy_match(*frames, "site", least, most).collect()
        assert [(r.pos, r.matched, r.similarity) for r in sorted(got, key=lambda r: r.pos)] == greedy(left, right, least)


def test_greedy_match_keeps_short_lists(spark):
    """Titles that are all alike: a list for each title, not all pairs, continued where others have taken all that is in it."""
    left = [(i, f"lamp {i % 45:03d}") for i in range(60)]
    right = [(i, f"lamp {(i * 7) % 90:03d}" if i % 3 else "lamp") for i in range(150)]
    frames = [spark.createDataFrame([("v", p, t) for p, t in side], "_g string, pos bigint, title string") for side in (left, right)]
    wanted = frames[0].select("_g", F.col("pos").alias("c"), "title", F.lit(3).cast("bigint").alias("k"), F.lit(2.0).alias("s_last"), F.lit(matching.FIRST).alias("x_last"))
    lists = matching.listed(wanted, frames[1].withColumn("held", F.lit(matching.LAST)), 0.5).collect()
    best = {p: sorted((-plain_similarity(t, u), x) for x, u in right)[:3] for p, t in left}
    assert {p: sorted((-r.s, r.x) for r in lists if r.c == p) for p in best} == best and len(lists) == 180
    for most in (100_000, 3):
        got = matching.assigned(*frames, 0.5, most).collect()
        assert sorted((r.e, r.x, round(r.s, 6)) for r in got) == greedy(left, right, 0.5)


def test_few_similarities_are_worked_out(monkeypatch):
    """The best of 3,000 numbered titles, by a few comparisons: bounds settle the others."""
    calls, whole = [], matching.similarity
    monkeypatch.setattr(matching, "similarity", lambda a, b: calls.append(b) or whole(a, b))
    titles = [f"item {i:06d}" for i in range(0, 90_000, 30)] + ["", "item", "x" * 300, "item 000040" * 20, "\U0001f600\ud800"]
    offers = matching.Offers(titles)
    for title in ("item 012345", "item", "item 000040" * 9, "\ud800", ""):
        calls.clear()
        got = offers.best(title, 5, 0.5, np.ones(len(titles), bool), lambda s, row: True)
        want = sorted((-s, i) for i, t in enumerate(titles) if title and t and (s := whole(title, t)) >= 0.5)[:5]
        assert got == want and len(calls) < 100


def merged(rows, alike):
    """Rows (pos, title, kind) of one page, merged one after the other."""
    kept = []
    for r in sorted(rows):
        r = list(r)
        a = (r[1] or "").strip().lower()
        if not a:
            if len(rows) == 1:
                kept.append(r)
            continue
        base = next((b for b in kept if (o := b[1].strip().lower()).startswith(a) or a.startswith(o) or SequenceMatcher(None, o, a).ratio() > alike), None)
        if base is None:
            kept.append(r)
        elif not base[2]:
            base[2] = r[2] or base[2]
    return [tuple(r) for r in kept]


@pytest.mark.parametrize("most", [100_000, 5])
def test_chunks_in_one_task_and_in_rounds(spark, most):
    dice = random.Random(most)
    words = ["red", "blue", "green", "shoe", "shirt", "lamp"]
    pages = {p: [(i, " ".join(dice.choice(words) for _ in range(dice.randint(0, 4))).title() or None, dice.choice([None, "", f"k{i}"])) for i in range(n)] for p, n in (("a", 60), ("b", 40), ("c", 1), (None, 25))}
    frame = spark.createDataFrame([(p, *r) for p, rows in pages.items() for r in rows], "page string, pos int, title string, kind string")
    got = evals.merge_chunks(frame, "page", ["kind"], 0.6, most).collect()
    assert {tuple(r) for r in got} == {(p, *r) for p, rows in pages.items() for r in merged(rows, 0.6)}


def test_a_large_page_is_compared_in_many_tasks(spark):
    """One page of 3,000 titles: blocks of 256 by 256, whose results are those of one task."""
    rows = [("p", i, f"item {i % 700:04d} {'x' * (i % 3)}") for i in range(3000)]
    titles = spark.createDataFrame(rows, "_g string, pos bigint, title string")
    pairs = matching.blocked(titles, titles, lambda a, b, upto: matching.repeats(a, b, upto, 0.97), later=True)
    assert pairs.count() == sum(n * (n - 1) // 2 for n in Counter(i % 700 for i in range(3000)).values()) and len(pairs.inputFiles()) > 1
    a, b = (sorted(map(tuple, matching.bases(pairs, most).collect())) for most in (10**9, 100))
    assert a == b == sorted(("p", i, i % 700) for i in range(700, 3000))


def test_chunk_merge(spark, small):
    pages = defaultdict(list)
    for r in sorted(table(spark, small, "part"), key=lambda r: r.p_partkey):
        pages[f"{r.p_brand}/{r.p_size}"].append({"pos": r.p_partkey, "title": r.p_name, "kind": r.p_type if r.p_partkey % 2 == 0 else None})
    want = set()
    for page, rows in pages.items():
        kept = []
        for r in rows:
            a = r["title"].strip().lower()
            base = next((b for b in kept if (o := b["title"].strip().lower()).startswith(a) or a.startswith(o) or SequenceMatcher(None, o, a).ratio() > 0.7), None)
            if base is None:
                kept.append(r)
            elif not base["kind"]:
                base["kind"] = r["kind"]
        want |= {(page, r["pos"], r["title"], r["kind"]) for r in kept}
    assert {(r.page, r.pos, r.title, r.kind) for r in QUERIES["chunk_merge"](spark, small).collect()} == want


def test_pages_of_few_titles_compare_each_title_once(spark, monkeypatch):
    """4,000 rows of 40 titles, some blank in odd ways: the first of each title stands for the others."""
    names = [f"{c} {n}" for c in ("red", "blue", "old", "hot") for n in ("ring", "rings", "gear", "bolt", "anvil", "gizmo", "rod", "plate", "Rod ")] + ["\xa0", " \u3000", "", None]
    rows = [(i, names[(i * 31 + i // 7) % 40], None if i % 3 else f"k{i}") for i in range(4000)]
    compared, whole = [], matching.blocked
    monkeypatch.setattr(matching, "blocked", lambda one, other, *a, **b: compared.append(one.count()) or whole(one, other, *a, **b))
    frame = spark.createDataFrame([("p", *r) for r in rows], "page string, pos int, title string, kind string")
    for most in (100_000, 5):
        assert {tuple(r) for r in evals.merge_chunks(frame, "page", ["kind"], 0.7, most).collect()} == {("p", *r) for r in merged(rows, 0.7)}
    assert compared == [39, 39]


def test_chunks_of_odd_pages(spark):
    rows = [("a", 2, None, "x", 1), ("b", 1, "", None, 2), ("b", 0, "Red", "", 3), ("b", 2, "red", "r", 4), ("b", 3, "RED HAT", "s", 5), ("c", 0, None, None, 6), ("c", 1, " ", None, 7), (None, 0, "Lamp", None, 8)]
    got = evals.merge_chunks(spark.createDataFrame(rows, "page string, pos int, title string, kind string, row int"), "page", ["kind"])
    assert got.columns == ["page", "pos", "title", "kind", "row"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 2, None, "x", 1), ("b", 0, "Red", "r", 3), (None, 0, "Lamp", None, 8)], key=str)
    assert evals.merge_chunks(got.limit(0), "page", ["kind"]).count() == 0


def test_greedy_match_without_a_partner(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "site string, pos bigint, title string")
    got = evals.greedy_match(frame(("a", 0, "lamp"), ("b", 0, None)), frame(("b", 0, None), ("c", 0, "lamp")), "site")
    assert sorted(map(tuple, got.collect())) == [("a", 0, None, 0.0), ("b", 0, None, 0.0)]


def test_seeded_sample_doesnt_depend_on_the_layout(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").orderBy(F.desc("doc_id")).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    one, two = ([r.doc_id for r in QUERIES["seeded_sample"](spark, where).collect()] for where in (small, str(tmp_path)))
    assert one == two and len(set(one)) == 100


def test_delimited_records(spark):
    """Quoted cells hold line ends, separators and quotes, whichever the separator; a quote inside a cell is text, one that never closes is dropped."""
    tsv = 'id\ttitle\tprice\n1\t"Two\nlines\tand ""quotes"""\t5\n2\tA 5" screen\t6\n\n3\t"open\t7'
    csv = "﻿id,title,price\r\n1,\"a,b\",5\r\n2,plain,\r\n"
    rows = feeds.delimited_feed(spark.createDataFrame([("t", tsv), ("c", csv)], "n string, body string"), "body", "n").orderBy("n", "pos").collect()
    assert [(r.n, r.id, r.title, r.price) for r in rows] == [("c", "1", "a,b", "5"), ("c", "2", "plain", None), ("t", "1", 'Two\nlines\tand "quotes"', "5"), ("t", "2", 'A 5" screen', "6"), ("t", "3", "open", "7")]
    xml = "<rss><item><title>&#65;&#x1F600; &amp;#66; &#xZ;</title></item></rss>"
    assert [r.title for r in feeds.xml_feed(spark.createDataFrame([(xml,)], "body string"), "body").collect()] == ["A😀 &#66; &#xZ;"]


def test_products_keep_their_own_fields(spark):
    page = '<script type="application/ld+json">[{"@type":"Product","name":"Zed","gtin13":"4006381333931","offers":{"price":9.5}},{"@type":"Product","name":"Abe","offers":{"price":1.5}}]</script>'
    nodes = extract.products(spark.createDataFrame([(1, page)], "page_id int, html string"), "html", "page_id")
    named = nodes.select("*", F.expr("try_variant_get(node, '$.name', 'string')").alias("name"))
    assert {(r.name, r.gtin) for r in extract.product_identifiers(named, "page_id", "name").collect()} == {("Zed", "4006381333931"), ("Abe", None)}


class Parts(HTMLParser):
    """What the rules for pages look at, gathered by a parser: title, text outside scripts and styles, and all tags with their attributes and scripts."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.tags, self.scripts, self.text, self.titles, self.inside = [], [], [], [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in attrs}))
        if tag not in ("meta", "img", "link", "br", "input", "hr"):
            self.inside.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        while self.inside and self.inside.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if self.inside and self.inside[-1][0] in ("script", "style"):
            self.scripts.append((self.inside[-1][1].get("type") or "", data))
        else:
            if self.inside and self.inside[-1][0] == "title":
                self.titles.append(data)
            self.text.append(data)

    handle_entityref = handle_charref = lambda self, name: self.text.append("?" * (len(name) + 2))


def plain_class(html):
    """Rejection, confidence and is_product of a page."""
    p = Parts(html)
    title = "".join(p.titles).strip().lower()
    home = any(t == "meta" and a.get("http-equiv", "").lower() == "refresh" and re.search(r"url\s*=\s*/*\s*$", a.get("content", ""), re.I) for t, a in p.tags)
    rejection = "error_page_title" if any(x in title for x in ("404", "not found", "page not available")) else "redirect_to_homepage" if home else "insufficient_content" if len(re.sub(r"\s", "", "".join(p.text))) < 500 else ""
    score = 0.4 * any("ld+json" in kind and re.search(r'"@type"\s*:\s*"Product"', body) for kind, body in p.scripts)
    score += 0.3 * any(t == "meta" and a.get("property") == "product:price:amount" for t, a in p.tags)
    score += 0.2 * any(t in ("button", "input", "form") and any("cart" in a.get(k, "").lower() for k in ("name", "action", "id", "class")) for t, a in p.tags)
    score += 0.15 * any(a.get("itemprop") == "price" or "price" in a.get("class", "").split() or "data-price" in a for _, a in p.tags)
    score += 0.1 * any(a.get("itemprop") == "name" or "product-title" in a.get("class", "").split() or t == "h1" and "product-name" in a.get("class", "").split() for t, a in p.tags)
    confidence = 0.0 if rejection else round(min(1.0, score), 4)
    return rejection, confidence, not rejection and confidence >= 0.3


LONG = "<p>" + "some words of text " * 60 + "</p>"
PAGES = [
    "<html><title>404</title>" + LONG,
    "<html><title>A Page Not Found here</title>" + LONG,
    "<title>ok</title><meta http-equiv='refresh' content='0; url=/'>" + LONG,
    '<title>ok</title><meta http-equiv="refresh" content="5; URL=/shop">' + LONG,
    "<title>short</title><script>" + "x" * 900 + "</script><p>few words</p>",
    '<title>p</title><script type="application/ld+json">{"@type" : "Product"}</script>' + LONG,
    '<title>p</title><script type="application/ld+json">{"@type":"Thing"}</script><p>"@type": "Product"</p>' + LONG,
    '<title>p</title><meta property="product:price:amount" content="5"><form action="/Cart/add"></form>' + LONG,
    '<title>p</title><b class="big price now">5</b><h1 class="product-name">x</h1><i itemprop="name">n</i>' + LONG,
    '<title>p</title><b class="prices">5</b><button id="go">cart</button>' + LONG,
    '<title>p</title><span data-price="5"></span><div class="product-title"></div><input name="cart"><meta property="product:price:amount"><script type="application/ld+json">[{"@type":"Product"}]</script>' + LONG,
    "",
]


def test_page_classes(spark, small):
    rows = [(r.page_id, r.html) for r in table(spark, small, "pages")] + [(1000 + i, h) for i, h in enumerate(PAGES)]
    got = spark.createDataFrame(rows, "i long, html string").select("i", F.inline(F.array(extract.page_class("html")))).collect()
    assert {r.i: (r.rejection, r.confidence, r.is_product) for r in got} == {i: plain_class(h) for i, h in rows}
    assert {plain_class(h)[0] for h in PAGES} == {"", "error_page_title", "redirect_to_homepage", "insufficient_content"} and {plain_class(h)[2] for h in PAGES} == {True, False}
    ours = {r.page_id: (r.rejection, r.confidence, r.is_product, r.platform) for r in QUERIES["page_classes"](spark, small).collect()}
    assert ours == {i: (*plain_class(h), "generic" if "shopify" not in h else ours[i][3]) for i, h in rows if i < 1000}


def plain_price(t):
    """The first credible price of a text as (amount, currency)."""

    def listed(raw):
        raw = raw.replace(" ", "")
        raw = raw.replace(".", "").replace(",", ".") if re.search(r",\d{2}$", raw) else raw.replace(",", "")
        try:
            value = float(raw)
        except ValueError:
            return None
        return f"{value:.2f}" if 0 < value <= 1_000_000 else None

    for m in re.finditer(rf"([A-Z]{{3}})\s+({money.AMOUNT})", t):
        if m[1] in money.ISO_CODES and (amount := listed(m[2])):
            return amount, m[1]
    signs = r"[€£¥₹₩₽]|R\$|A\$|C\$|NZ\$|HK\$|S\$|\$|kr|zł|CHF"
    for line in t.split("\n"):
        if re.search(money.NOISE, line):
            continue
        for m in re.finditer(rf"(?:(?:{signs})\s*)?(?:{money.AMOUNT})(?:\s*(?:[€£¥₹₩₽]|kr|zł))?(?:\s+[A-Z]{{3}})?", line):
            if amount := listed(re.search(money.AMOUNT, m[0])[0]):
                code, sign = re.search(r"\s([A-Z]{3})$", m[0]), re.search(signs, m[0])
                return amount, code[1] if code and code[1] in money.ISO_CODES else money.SYMBOLS.get(sign[0]) if sign else None
    return None


def test_text_prices(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents") if r.text]
    odd = ["USD 12.50", "now EUR 1.299,99!", "XYZ 5.00 then $ 7.25", "free shipping over $50.00\n$ 9.99", "only 19,95 € today", "1,299.00 SEK", "kr 200,00", "price: 0.00", "$2,000,000.00", "no price", "", "£5.00 GBP"]
    rows += [(10_000 + i, t) for i, t in enumerate(odd)]
    got = spark.createDataFrame(rows, "i long, t string").select("i", money.text_price("t").alias("p")).collect()
    assert {r.i: tuple(r.p) if r.p else None for r in got} == {i: plain_price(t) for i, t in rows}
    ours = {r.doc_id: (r.amount, r.currency) for r in QUERIES["text_prices"](spark, small).collect()}
    assert ours == {i: p for i, t in rows if i < 10_000 and (p := plain_price(t))}


def test_profile_scores(spark, small):
    from millrace.plans.page_queries import enriched

    want = {}
    for r in enriched(spark, small).collect():
        bare = re.sub(r"(?s)<!--.*?-->", "", r.html)
        footers = " ".join(re.sub(r"<[^>]+>", " ", m[0]) for m in re.finditer(r"(?is)<(footer|address)\b.*?</\1>", bare))
        main = re.search(r"(?is)<main\b.*?</main>|<article\b.*?</article>", bare)
        shown = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", main[0]))).strip() if main else ""
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", r.html)
        score = 0.25 * bool(title and title[1].strip()) + 0.05 * (len(shown) > 50) + 0.15 * bool(re.search(r"[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}", footers)) + 0.10 * bool(re.search(r"G-[A-Z0-9]{6,}", bare))
        want[r.page_id] = round(score, 4)
    assert {r.page_id: r.confidence for r in QUERIES["profile_scores"](spark, small).collect()} == want and len(set(want.values())) > 1
