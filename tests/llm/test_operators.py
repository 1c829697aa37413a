"""The ten operators against brute force, libraries, planted cases and edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL
from veristrata.llm import bpe, licenses, merkle, neardup, neighbours, packing, passages, pii, pii_cases, queries, toxicity, wrappers

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    d = pd.read_parquet(f"{SMALL}/documents.parquet")
    return dict(zip(d.doc_id, d.text, strict=True))


#: Nulls, empty and long texts, repeated rows, and columns whose names clash with those inside.
def odd_rows(spark):
    rows = [(1, None, "rep"), (2, "", "x"), (3, "one", "y"), (3, "one", "y"), (4, "word " * 30_000, "z"), (None, "one two three four five six", "n"), (5, " \n\t ", "w"), (6, "Released under the MIT License. a@b.co", "v")]
    return spark.createDataFrame(rows, "doc_id long, text string, rep string").withColumn("group", F.lit(1)).withColumn("id", F.lit("k")).withColumn("node", F.lit(0)).withColumn("lang", F.lit("en"))


# ---- 1 ----


def test_license_sql(same):
    same(queries.op1_license_scan, licenses.oracle())


def test_license_windows(spark):
    rng = random.Random(3)
    noise = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows = [(i, f"{noise(rng.randrange(200))} {t} {noise(rng.randrange(200))}") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    got = {(r["doc_id"], r["template_id"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, i) for i in range(len(rows))} <= got


def test_license_bands(spark):
    """Templates of which a tenth of the words are replaced, in their places, in long texts: retrieval loses none that containment accepts."""
    rng = random.Random(5)
    noise = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    texts = [t for _, t in licenses.TEMPLATES if len(t.split()) > 20]
    rows = []
    for i in range(150):
        w = rng.choice(texts).split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join([*noise(rng.randrange(300)), *w, *noise(rng.randrange(300))])))
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    bank = [grams(plain(t)) for _, t in licenses.TEMPLATES]
    want = {(i, k) for i, t in rows for k, g in enumerate(bank) if len(g & grams(plain(t))) / len(g) >= 0.8}
    got = {(r["doc_id"], r["template_id"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and len(want - got) <= 1 and len(want) > 100


def test_license_edges(spark):
    assert [r["license"] for r in licenses.scan(odd_rows(spark)).collect()] == ["MIT"]
    assert licenses.scan(odd_rows(spark).limit(0)).count() == 0


# ---- 2 ----


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    p = df.toPandas()
    ids, x = p.vec_id.to_numpy(), np.stack(p.embedding.to_numpy()).astype(float)
    got = defaultdict(list)
    for r in neighbours.nearest_of_hundredth(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert [v for v, _ in got[q]] == sorted((v for v, _ in got[q]), key=lambda v: (d[ids == v][0], v))
        hits += len({v for v, _ in got[q]} & set(ids[order]))
        total += 10
        assert all(s == pytest.approx(d[ids == v][0], rel=1e-12) for v, s in got[q])
    assert hits / total >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0]), (7, [1.0, 0.1]), (None, [1.0, 1.0])]
    got = neighbours.nearest_of_hundredth(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("codes", F.lit(1))).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 7, 100]
    assert neighbours.nearest_of_hundredth(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_large_groups_of_copies(spark):
    """A group of copies larger than ``KEEP``: ties go to the smaller ids, and the group doesn't crowd out what is nearer."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    group = rng.permutation(3000)[:1000]
    x[group] = x[group[0]]
    beside = [i for i in range(3000) if i % 100 == 50 and i not in set(group)][:5]
    x[beside] = x[group[0]] + 1e-3 * rng.normal(size=(5, 16))
    order = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "vec_id long, embedding array<double>").coalesce(1)
    index, book = neighbours.build_index(df)
    queries_ = [int(i) for i in range(3000) if i % 100 == 0 and i in set(group)] + beside
    got = defaultdict(list)
    for r in neighbours.search(index, book, index.where(F.col("id").isin(queries_)).select("id", "vector")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert len(queries_) > 5
    for q in queries_:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert got[q] == [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]


def spread(kind, n, rng):
    x = rng.normal(size=(n, 32))
    return {"norms": x * np.exp(rng.normal(size=(n, 1)) * 0.7), "moved": x + 20.0, "clusters": rng.normal(size=(40, 32))[rng.integers(0, 40, n)] + 0.1 * x}[kind]


@pytest.mark.parametrize("kind", ["norms", "moved", "clusters"])
def test_neighbours_recall_in_full_blocks(spark, monkeypatch, kind):
    """More than one full block, with varied norms, far from the origin, and in clusters; several query blocks."""
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 8 * 32 * 64)
    n = 10_000
    x = spread(kind, n, np.random.default_rng(3))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").coalesce(1)
    got = defaultdict(list)
    for r in neighbours.nearest_of_hundredth(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, n, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({v for v, _ in got[q]} & set(np.argsort(d)[:10].tolist()))
        assert len(got[q]) == 10 and all(s == pytest.approx(d[v], rel=1e-12) for v, s in got[q])
    assert len(got) == n // 100 and hits / (n / 10) >= 0.9


def test_neighbours_repeated_ids_and_ties(spark):
    """A repeated query id is searched once, by its smallest vector; the tenth place goes to the smaller ids."""
    rows = [(0, [5.0, 5.0]), (0, [1.0, 0.0])] + [(i, [1.0, 1.0] if i % 2 else [1.0, -1.0]) for i in range(1, 31)]
    got = neighbours.nearest_of_hundredth(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 1.0) for i in range(1, 11)]


# ---- 3 ----

PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>Title {i}</h1><p><b>Fish &amp; chips {i}.<br><p>More   text\n {i}<p>End</article><aside>Side</aside><div class="comments"><p>First!</p></div><div id="cookie-notice">Cookies</div><form><input><button>Go</button></form><footer>&copy; x</footer></body></html>'


def test_wrappers(spark):
    pages = [(i, f"https://h{i % 2}.org/{i}", PAGE.replace("{i}", str(i)) if i % 3 else PAGE.replace("{i}", str(i)).replace("<aside>Side</aside>", "")) for i in range(12)]
    got = {r["page_id"]: r for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i]["text"] == f"Title {i}\nFish & chips {i}.\nMore text {i}\nEnd"
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_wrappers_align():
    """Equal tokens stay, differing texts become slots, extra elements optional items, and repeated ones a group."""
    one = "<ul><li>Home</li><li>About</li></ul><div><p>a</p><p>b</p><h2>c</h2></div>"
    two = "<ul><li>Home</li><li>About</li></ul><div><p>x</p><p>y</p><p>z</p></div><div><table><td>t</table></div>"
    a, b = (wrappers.expression(wrappers.Page(x)) for x in (one, two))
    menu, first, *more = wrappers.align(a, b)
    assert [x[0] for li in menu[2] for x in li[2]] == [wrappers.TEXT] * 2 and len(menu[2][0][2][0][2]) == 2
    assert first[1] == "div" and first[2][0][0] == wrappers.GROUP and [x[1] for x in first[2][0][1]] == ["p"] and [x[1] for x in first[2][1:]] == ["h2", "p"]
    assert [wrappers.head(x) for x in more] == ["div"]
    assert wrappers.align(a, a)[1][2] and [wrappers.same(x) for x in wrappers.align(a, a)] == [wrappers.same(x) for x in a]


def site(rng, n, flat=False, menu=("Home", "About us", "Our shop"), foot="All rights reserved by the owners of this site, who wish you a good day."):
    """Pages of a host whose elements have names that say nothing: (html, main text)."""
    names = [f"x{rng.randrange(10**6)}" for _ in range(6)]
    words = lambda k: " ".join(f"word{rng.randrange(5000)}" for _ in range(k))
    out = []
    for _ in range(n):
        parts = [("h2" if rng.random() < 0.2 else "p", words(rng.randrange(8, 40))) for _ in range(rng.randrange(3, 9))]
        lead = words(12)
        tags = "".join(f'<{tag} class="{names[5]}">{text}</{tag}>' for tag, text in parts)
        links = "".join(f"<span><a href=#>{words(2)}</a></span>" for _ in range(rng.randrange(1, 3)))
        article = f"<h1>{lead}</h1>{tags}" if flat else f'<div class="{names[1]}"><h1>{lead}</h1><div class="{names[2]}">{tags}</div></div><div class="{names[3]}">{links}</div>'
        out.append((f'<body><div class="{names[0]}">{"".join(f"<div>{m}</div>" for m in menu)}</div>{article}<div class="{names[4]}">{foot}</div></body>', "\n".join([lead, *(t for _, t in parts)])))
    return out


def test_wrappers_of_pages_without_names(spark):
    """Random class names: the menu and the foot are told from the article by alignment alone, and stay where wrappers are withheld."""
    rng = random.Random(8)
    rows, want = [], {}
    for host in range(6):
        for html, text in site(rng, 12, flat=host % 2 == 0):
            want[len(rows)] = text
            rows.append((len(rows), f"https://h{host}.org/{len(rows)}", html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(df).collect()}
    assert got == want
    without = [wrappers.extract(html) for _, url, html in rows if int(url[9]) % 2 == 0]
    assert len(without) == 36 and all("About us" in t and "All rights reserved" in t for t in without)


def test_wrappers_need_proof():
    """Texts of a host of one page, of copies, or of two pages aren't held to be template."""
    rng = random.Random(9)
    for pages in (site(rng, 1), site(rng, 1) * 5, site(rng, 2)):
        items = None
        for html, _ in pages:
            e = wrappers.expression(wrappers.Page(html))
            items = e if items is None else wrappers.align(items, e)
        wrapper = wrappers.finish(items, len(pages))
        assert all(all(line in wrappers.extract(html, wrapper).split("\n") for line in text.split("\n")) for html, text in pages)


def test_wrappers_align_in_any_order():
    """Wrappers of parts of a host give the texts that one pass over it gives."""
    rng = random.Random(10)
    pages = site(rng, 20)
    whole, parts = None, [None, None, None]
    for i, (html, _) in enumerate(pages):
        e = wrappers.expression(wrappers.Page(html))
        whole = e if whole is None else wrappers.align(whole, e)
        parts[i % 3] = e if parts[i % 3] is None else wrappers.align(parts[i % 3], e)
    met = wrappers.align(wrappers.align(parts[0], parts[1]), parts[2])
    one, other = wrappers.finish(whole, 20), wrappers.finish(met, 20)
    assert all(wrappers.extract(html, one) == wrappers.extract(html, other) == text for html, text in pages)


@pytest.mark.parametrize("n", [1, 2, 15, 25])
def test_wrappers_keep_repeated_texts_of_an_article(n):
    """A byline inside an article stays, however many pages the host has."""
    pages = [f"<body><nav>Menu</nav><article><p>By the staff</p><p>Text number {i} of the article.</p></article></body>" for i in range(n)]
    items = None
    for html in pages:
        e = wrappers.expression(wrappers.Page(html))
        items = e if items is None else wrappers.align(items, e)
    wrapper = wrappers.finish(items, n)
    assert [wrappers.extract(html, wrapper) for html in pages] == [f"By the staff\nText number {i} of the article." for i in range(n)]


def test_wrappers_by_what_elements_are():
    text = "The price of shares rose again today, as many had hoped it would. " * 3
    for name in ("share-price-news", "has-sidebar", "form-and-function", "menu-of-the-day"):
        assert wrappers.extract(f'<div class="{name}"><p>{text}</p></div><div class="cookie-notice">We use cookies.</div><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul>') == text.strip()
    for name in ("cookie-notice", "ad", "comment-list", "site-footer", "left sidebar"):
        assert wrappers.extract(f'<div><p>{text}</p><div class="{name}">Something else.</div></div>') == text.strip()
    assert wrappers.extract(f"<article><header><h1>Title</h1></header><p>{text}</p></article><header>Site</header>") == f"Title\n{text.strip()}"
    assert wrappers.extract(f"<form><div>{text}</div></form>") == text.strip()


def test_wrappers_of_deep_and_long_pages(spark):
    deep = "<div>" * 20_000 + "<p>At the bottom.</p>" + "</div>" * 20_000
    odd = "<div><section>" * 3000 + "text" + "</section></p></em>" * 3000
    long = "<body>" + "".join(f"<p>Paragraph {i}.</p><h3>Head {i}</h3>" for i in range(20_000)) + "</body>"
    rows = [(i, "https://a.org", x) for i, x in enumerate([deep, odd, long, long.replace("Head", "Other"), deep.replace("bottom", "end"), "<p>short</p>"])]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[0] == "At the bottom." and got[4] == "At the end." and got[1] == "text" and got[5] == "short"
    assert got[2].count("\n") == got[3].count("\n") == 39_999 and got[3].startswith("Paragraph 0.\nOther 0\n")


def test_wrappers_keep_the_whole_article():
    lead, text, more = "A heading. " * 4, "The article's text. " * 8, "Another section. " * 8
    inner = f'<div class="post"><h1>{lead}</h1><div class="entry-content"><p>{text}</p></div><section><p>{more}</p></section></div>'
    beside = f'<div><div class="post a"><p>{text}</p></div><div class="story b"><p>{more}</p></div></div>'
    apart = f'<div><div class="text"><p>{text}</p></div><div class="left"><p>{more}</p></div></div>'
    assert wrappers.extract(inner, None) == "\n".join(t.strip() for t in (lead, text, more))
    assert wrappers.extract(beside, None) == wrappers.extract(apart, None) == f"{text.strip()}\n{more.strip()}"


def test_wrappers_root_of_the_host_is_that_of_the_page():
    """A page that has the host's content element for little of its text keeps the rest."""
    less, most = "Less of the text. " * 3, "Most of the text is here. " * 9
    page = f'<div class="x"><p>{less}</p></div><div class="y"><p>{most}</p></div>'
    assert wrappers.extract(page, {"items": [], "template": False, "path": ["div.x"]}) == f"{less.strip()}\n{most.strip()}"
    assert wrappers.extract(page.replace(less, most * 20), {"items": [], "template": False, "path": ["div.x"]}) == (most * 20).strip()


def test_wrappers_odd_pages(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (3, "https://a.org", "plain &lt;text&gt;"), (4, "https://a.org", "<p>open <b"), (None, "https://a.org", "<p>x</p>" * 5000), (4, "https://a.org", "<p>open <b")]
    got = [(r["page_id"], r["text"]) for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("wrapper", F.lit("w"))).collect()]
    by = dict(got)
    assert len(got) == 6 and by[1] == by[2] == "" and by[3] == "plain <text>" and by[4] == "open" and by[None].count("\n") == 4999


def test_pages_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    import html as h

    for r in queries.op3_html_text(spark, SMALL).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (re.sub(r"\s+", " ", h.unescape(re.sub(r"</?b>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)[^>]*>", article))
        assert r["text"] == "\n".join(b for b in blocks if b)


# ---- 4 ----


def test_toxicity_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.query(d, labels).join(labels, "doc_id").where("held_out").toPandas()
    ranks, toxic = got.score.rank(), got.toxic == 1
    area = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area > 0.9 and ((got.score >= 0) & (got.score <= 1)).all()
    assert all(toxicity.held_out(i) for i in got.doc_id)


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.query(odd_rows(spark), none).collect()
    assert len(got) == 8 and {r["score"] for r in got} == {0.0}
    assert toxicity.vector(None, {}) == toxicity.vector("", {}) == [0.0] * len(toxicity.NAMES)
    assert toxicity.vector("you 1d10t", {"idiot": 1.0})[9] == 1.0


def test_first_split_is_the_best_of_all(spark):
    """The root of a tree against every cut of every feature, and its leaves' values."""
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 9, 200), rng.normal(size=200), rng.integers(0, 2, 200)], axis=1).astype(float)
    y = ((x[:, 1] > 0.3) ^ (rng.random(200) < 0.1)).astype(float)
    p = np.full(200, y.mean())
    slope, curve = y - p, p * (1 - p)
    cuts = [np.unique(c)[:-1] for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    feature, cut, value = toxicity.grow(x, slope, curve, cuts, binned)

    def gain(f, c):
        left = x[:, f] <= c
        if min(left.sum(), (~left).sum()) < toxicity.LEAST_LEAF:
            return -1.0
        part = lambda rows: slope[rows].sum() ** 2 / (curve[rows].sum() + toxicity.RIDGE)
        return part(left) + part(~left) - part(np.ones(200, dtype=bool))

    best = max((gain(f, c), -f, -c) for f, edges in enumerate(cuts) for c in edges)
    assert (feature[0], cut[0]) == (-best[1], -best[2]) and feature[0] == 1
    at = np.zeros(200, dtype=int)
    for _ in range(toxicity.DEPTH):
        at = 2 * at + 1 + (x[np.arange(200), feature[at]] > cut[at])
    for leaf in set(at.tolist()):
        rows = at == leaf
        assert value[leaf] == pytest.approx(toxicity.RATE * slope[rows].sum() / (curve[rows].sum() + toxicity.RIDGE))
    model = toxicity.boost(x, y)
    assert ((model.margin(x) > 0) == (y == 1)).mean() > 0.85


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 1)), min_size=1, max_size=20))
def test_isotonic_fit(rows):
    """Pooled blocks against the least greatest mean: each margin's level is max over starts of min over ends of the means."""
    margin, y = np.array([float(m) for m, _ in rows]), np.array([float(v) for _, v in rows])
    knots, levels = toxicity.isotonic(margin, y)
    values = sorted(set(margin))
    mean = lambda a, b: y[(margin >= values[a]) & (margin <= values[b])].mean()
    want = [max(min(mean(a, b) for b in range(i, len(values))) for a in range(i + 1)) for i in range(len(values))]
    blocks = {}
    for v, w in zip(values, want, strict=True):
        blocks.setdefault(round(w, 9), []).append(v)
    for inside in blocks.values():
        rows_ = (margin >= inside[0]) & (margin <= inside[-1])
        assert np.interp(inside[0], knots, levels) == pytest.approx((y[rows_].sum() + 0.5) / (rows_.sum() + 1)) or (np.diff(levels) >= 0).all()
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all()


def test_toxicity_sample_of_repeated_ids(spark):
    """A sampled id that stands in many rows is one row of the sample."""
    rows = [(i % 7, f"you idiot {i % 3}" if i % 7 < 3 else f"a fine day {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, 0, int(i < 3)) for i in range(7)], "doc_id long, quality int, toxic int")
    got = toxicity.query(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == 300 and len({(r["doc_id"], r["score"]) for r in got}) <= 300


# ---- 5 ----


def brute_tree(text):
    """Sections, paragraphs and leaves of a text, as nested tuples of texts."""
    return tuple(tuple((p, tuple(re.findall(merkle.LEAVES, p))) for p in s.split("\n")) for s in text.split("\n\n"))


def brute_fingerprint(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out, tops = [], ""
    for s in brute_tree(text):
        head = sha("".join(sha(p) for p, _ in s))
        tops += head
        out.append((head, sum(len(p) for p, _ in s), [(sha(p), len(p), [len(x) for x in parts]) for p, parts in s]))
    return sha(tops), out


def parsed_fingerprint(print_):
    top, *sections = print_.split("|")
    out = []
    for s in sections:
        head, n, inner = re.fullmatch(r"(\w{64})\.(\d+)\{(.*)\}", s).groups()
        paragraphs = [re.fullmatch(r"(\w{64})\.(\d+):(.*)", p).groups() for p in inner.split(";")]
        out.append((head, int(n), [(h, int(m), [int(x.split(".")[1]) for x in parts.split(",") if x]) for h, m, parts in paragraphs]))
    return top, out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    both = one = 0
    x, y = set(brute_tree(a)), set(brute_tree(b))
    both += sum(len(p) for s in x & y for p, _ in s)
    x, y = ({p for s in side for p in s} for side in (x - y, y - x))
    both += sum(len(p) for p, _ in x & y)
    x, y = ({leaf for _, parts in side for leaf in parts} for side in (x - y, y - x))
    both += sum(map(len, x & y))
    one = sum(map(len, x ^ y))
    return 2 * both / (2 * both + one) if both + one else 0.0


@pytest.mark.parametrize("gaps", [False, True])
def test_fingerprints(spark, gaps):
    """Every column against brute force; with gaps, ids are far apart and the texts' rows are repeated over several buckets."""
    texts = {(k**3 if k % 5 else -(k**4)) if gaps else k: t for k, t in documents().items()}
    ids = sorted(texts, reverse=True)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in merkle.compare_with_edits(df, bucket_rows=16 if gaps else 512).collect()}
    assert got.keys() == texts.keys()
    for i, k in enumerate(ids):
        n, after = len(texts[k]), texts[ids[(i + 1) % len(ids)]]
        edited = texts[k][: n - n // 2] + after[: n // 2]
        assert got[k]["n_chars"] == n and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert parsed_fingerprint(got[k]["fingerprint"]) == brute_fingerprint(texts[k])
        assert parsed_fingerprint(got[k]["edited_fingerprint"]) == brute_fingerprint(edited)
        assert got[k]["near_edited"] == pytest.approx(brute_likeness(texts[k], edited)) and got[k]["near_next"] == pytest.approx(brute_likeness(texts[k], after))
    by_text = defaultdict(set)
    for k, t in texts.items():
        by_text[t].add(got[k]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)


def test_fingerprint_buckets_are_even(spark):
    """One far id doesn't put all other rows into one bucket, and null ids and a repeated id are cut by their texts."""
    rows = [(i, f"t{i}") for i in range(400)] + [(1 << 60, "far")] + [(None, f"n{i}") for i in range(300)] + [(7, f"r{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"known": F.col("doc_id").isNotNull(), "at": F.coalesce("doc_id", F.lit(0).cast("long")), "tie": F.xxhash64("text")})
    sizes = [r["count"] for r in df.groupBy(merkle.bucket_of(df, 1001, 50).alias("b")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 150


def test_fingerprint_locates_edits(spark):
    rows = spark.createDataFrame([("a\nb\n\nc\nd", "a\nX\n\nc\nd")], "a string, b string")
    got = rows.select(merkle.differing(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("d"), merkle.likeness(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("a"))).alias("same")).first()
    assert [tuple(x) for x in got["d"]] == [(0, 1)] and got["same"] == 1.0


def test_fingerprint_edges(spark):
    got = merkle.compare_with_edits(odd_rows(spark), bucket_rows=2).collect()
    assert len(got) == 8
    one = merkle.compare_with_edits(odd_rows(spark).where("doc_id = 6")).first()
    assert one["near_next"] == 1.0
    assert merkle.compare_with_edits(odd_rows(spark).limit(0)).count() == 0


# ---- 6 ----


def brute_components(texts, size, percent):
    sets = {}
    for k, t in texts.items():
        w = t.encode().lower().split()
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    for k, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < k).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in texts}


def chained(seed, families, members, words, edits):
    rng, out = random.Random(seed), {}
    for f in range(families):
        base = [f"f{f}w{rng.randrange(40)}x{i}" for i in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
            out[len(out) + 1] = " ".join(own)
    return out


@pytest.mark.parametrize(("size", "group"), [(2, None), (5, None), (2, 2000)])
def test_near_duplicates(spark, monkeypatch, size, group):
    if group:
        monkeypatch.setattr(neardup, "GROUP_SHINGLES", group)
        monkeypatch.setattr(neardup, "BATCH_SHINGLES", 4000)
    texts = chained(size, 6, 25, 60, 9) if group else documents() | {10_000 + k: t for k, t in chained(size, 8, 12, 80, 8).items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, size, 80).collect()}
    assert got == brute_components(texts, size, 80)


def test_dense_nodes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_NODE", 40)
    texts = chained(5, 2, 150, 200, 2) | {1000 + k: t for k, t in chained(6, 40, 2, 50, 1).items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 2, 80).collect()}
    assert got == brute_components(texts, 2, 80)


def test_groups_of_many_short_documents(spark, monkeypatch):
    """A sketch group of many short documents is confirmed by pivots, however few its shingles."""
    monkeypatch.setattr(neardup, "GROUP_DOCS", 12)
    texts = chained(9, 4, 40, 12, 3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 2, 80).collect()}
    assert got == brute_components(texts, 2, 80)


def test_miss_probability():
    """As the docstring states: pairs at the threshold, in trees and by the sketches' floor."""
    for depth in (1, 2, 3, 4):
        p = neardup.survival(0.8, depth + neardup.FURTHER)
        trees = int(np.ceil(np.log(neardup.MISS) / np.log(1 - p)))
        assert (1 - p) ** trees <= neardup.MISS and (1 - neardup.survival(0.85, depth + neardup.FURTHER)) ** trees < neardup.MISS / 10
    need = int(np.ceil(neardup.floor_of(80) * neardup.COMPARED))
    from math import comb

    below = sum(comb(neardup.COMPARED, i) * 0.8**i * 0.2 ** (neardup.COMPARED - i) for i in range(need))
    assert below < 5e-6


def test_near_duplicate_edges(spark):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd_rows(spark), 2, 80).collect()), key=repr)
    assert (False, 1, 0, 1, True) in got and (False, 4, 1, 4, True) in got and (True, 0, 5, None, True) in got and len(got) == 8
    assert neardup.near_duplicates(odd_rows(spark).limit(0), 2, 80).count() == 0
    assert neardup.keep_one(odd_rows(spark)).columns == odd_rows(spark).columns


# ---- 7 ----


def test_passages_sql(same):
    same(queries.op7_passages, passages.oracle())


def test_passages_of_rows_without_ids(spark):
    """Rows of no id, and of one id, are told apart by their texts; the first by id and text hash keeps a passage."""
    p = " ".join(f"Sentence number {i} of the shared passage has some words." for i in range(4))
    rows = [(None, f"One. {p}"), (None, f"Two. {p}"), (None, "Own text that nobody has. At all. Here."), (7, "Clean."), (7, "Clean.")]
    got = passages.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0, 0, 0, 4] and all(list(r["copied_from"]) == [] for r in got)


def test_passages(spark):
    p = " ".join(f"Sentence number {i} of the shared passage has some words." for i in range(8))
    rows = [(1, f"Own start here. {p} Own end."), (2, f"Another one begins. {p} It ends."), (3, p + " " + p), (4, "Clean text. Be. Is. Clean text. Be. Is.")]
    got = {r["doc_id"]: r for r in passages.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert got[2]["text"] == "Another one begins. It ends." and list(got[2]["copied_from"]) == [1]
    assert got[3]["text"] == "" and got[4]["text"] == rows[3][1]


def test_passages_of_short_sentences(spark):
    """A list whose lines have three words or fewer is a repeated passage too, to its last line."""
    rng = random.Random(2)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    shared = "".join(f"{x}\n" for x in [*lines, "ten words stand in this one line before the end", "a", "b"])
    rows = [(1, "Mine.\n" + shared + "Own end.\n"), (2, "Other.\n" + shared + "Its end.\n"), (3, "a\nb\nc d\n" * 2)]
    got = {r["doc_id"]: r for r in passages.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "Other.\nIts end.\n" and list(got[2]["copied_from"]) == [1]
    assert got[3]["text"] == rows[2][1]


@given(st.lists(st.integers(0, 14), max_size=30), st.integers(0, 10), st.integers(0, 30))
def test_passage_spans_cover_every_stretch(counts, a, size):
    """Any stretch of enough sentences and words has each sentence with words under a span inside it, and no span occurs twice."""
    text = "".join(" ".join(f"w{i}" for _ in range(c)) + "\x0b.\n" for i, c in enumerate(counts))
    found = [len(x.strip(passages.TRIM).split()) for x in passages._SENTENCE.findall(text)]
    got = [(i, n) for i, n, _ in passages.runs(text)]
    assert len(set(got)) == len(got)
    stretch = range(a, min(a + size, len(found)))
    if len(stretch) >= passages.RUN and sum(found[i] for i in stretch) >= passages.RUN_WORDS:
        under = {j for i, n in got if i >= stretch[0] and i + n <= stretch[-1] + 1 for j in range(i, i + n)}
        assert {i for i in stretch if found[i]} <= under


def test_passage_edges(spark):
    out = passages.remove_repeated(odd_rows(spark))
    assert out.columns == [*odd_rows(spark).columns, "n_sentences", "n_removed", "copied_from"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] is None and got[2] == "" and len(got) == 7
    assert passages.remove_repeated(odd_rows(spark).limit(0)).count() == 0


# ---- 8 ----


def check_packing(rows, length=4096):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in pieces.values():
        at = 0
        for start, n, total in sorted(parts):
            assert start == at
            at += n
        assert at == total
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences)


def test_packing(spark):
    rows = queries.op8_packing(spark, SMALL).collect()
    n = check_packing(rows)
    assert sum(r["length"] for r in rows) / (4096 * n) > 0.97
    codec = bpe.load(bpe.default_path())
    texts = documents()
    for r in rows:
        ids = (codec.encode(texts[r["doc_id"]]) + (2).to_bytes(4, "little"))[4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(ids) == r["ids_crc32"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_tournament_is_first_fit(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths), 40)
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(40)
        want[i] = (b, 40 - free[b])
        free[b] -= lengths[i]
    assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets, strict=True))} == want


def test_packing_edges(spark):
    rows = packing.pack(odd_rows(spark).where("doc_id is not null").dropDuplicates(["doc_id"]), with_ids=True).collect()
    check_packing(rows)
    assert {r["doc_id"]: r["doc_tokens"] for r in rows}[1] == 1
    assert len(packing.pack(odd_rows(spark)).collect()) >= 8
    assert packing.pack(odd_rows(spark).limit(0)).count() == 0


# ---- 9 ----


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


ODD_TEXTS = ["", " ", "a<|endoftext|>b", "<|startoftext|>", "ΣΑΣ it's Don't 12²½ ''s \x1c  é İ x", "a\x1cb\x85c", "日本語 テスト 😀😀!!??", "ﬁ­x​z y", "é ẞ", "x" * 3000, "don'T we'LL 'S", "!!!###$$$", " a　b"]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_bpe_odd_texts(library, text):
    codec = bpe.load(bpe.default_path())
    want = library.encode(text, add_special_tokens=False).ids
    ids = codec.encode(text)
    assert np.frombuffer(ids, dtype="<u4").tolist() == want
    assert codec.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abehinorst'12 .,-éß\n", max_size=80))
def test_bpe_random_texts(library, text):
    assert np.frombuffer(bpe.load(bpe.default_path()).encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_every_character(library):
    """Every code point alone, beside a letter and before a letter: white space, classes, lower case and normal form are the library's."""
    codec = bpe.load(bpe.default_path())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        texts = [f"a{c}a {c}" for c in points[i : i + 20_000]]
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(codec.encode(text), dtype="<u4").tolist() == want.ids, ascii(text)
        codec.memo.clear()


def test_bpe_documents(spark, library):
    texts = documents()
    for r in queries.op9_bpe(spark, SMALL).collect():
        e = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(e) and r["ids_sha256"] == hashlib.sha256(np.array(e, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()
    assert len(bpe.digests(odd_rows(spark)).collect()) == len(bpe.encode_decode(odd_rows(spark)).collect()) == 8


# ---- 10 ----


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1234 5@.-+()_é", max_size=60))
def test_base_spans(text):
    assert sorted(pii.base_spans(text)) == sorted(brute_spans(text))


def test_personal_data(spark):
    texts = documents()
    rows = queries.op10_pii(spark, SMALL).collect()
    for r in rows:
        base = sorted(brute_spans(texts[r["doc_id"]]), key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(",")) | {""}
    assert len(rows) == len(texts)


def test_field_adds_spans(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weight = pii.fit(d)
    text = "Call (974) 555-3436 today, room 12."
    assert [(k, text[s:e]) for k, s, e in pii.added_spans(text, pii.base_spans(text), weight)] == [("phone", "(974) 555-3436")]
    clean = "Chapter 12, page 340. In 1999 we had 1,250 of 3.14 or 2024-05-06."
    assert pii.added_spans(clean, pii.base_spans(clean), weight) == []
    out = pii.redact(odd_rows(spark), weight)
    assert out.columns == odd_rows(spark).columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[6] == "Released under the MIT License. <email>" and got[1] is None and got[2] == ""
    assert pii.find(odd_rows(spark).limit(0)).count() == 0


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def found_by(field, text):
    base = pii.base_spans(text)
    return set(base), set(pii.added_spans(text, base, field))


#: Forms that no written case has.
HELD_OUT = [
    ("id", "her SSN: 123-45-6789 was lost"), ("id", "social security no 219 09 9999 on file"), ("phone", "call 555-123-4567 now"), ("phone", "phone 020 7946 0958 after six"), ("phone", "mobile: 0171 5550 123."), ("phone", "tel (206) 555 0147 x"),
    ("iban", "pay to DE89 3704 0044 0532 0130 00 please"), ("iban", "NL91ABNA0417164300 is mine"), ("email", "mail john.smith at gmail dot com today"), ("email", "ask info [at] cern [dot] ch then"), ("email", "jane (at) web.de answers"),
    ("ip", "from 2001:db8::ff00:42:8329 again"), ("ip", "fe80::1ff:fe23:4567:890a is local"), ("secret", 'aws_secret = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLE1KEY"'), ("secret", "password: hunter2hunter2 yes"), ("secret", "token = '04dbebab91ab85687d33eeaaf9ac699e1188f962'"),
]
CLEAN = [
    "Chapter 12, page 340. In 1999 we had 1,250 of 3.14 or 2024-05-06.", "Version 2.0.1 of 12/05/2021 at 12:30:45, room 12-14.", "He looked at home. The dot on it was red.", "ISBN 978-3-16-148410-0 costs $12,499.00", "1234567 units, 99.9 % of 10,000,000",
    "the well-known-and-very-long-hyphenated-word", "SOME_CONSTANT_NAME_OF_A_PROGRAM", "order 9807915762804490 shipped", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", "0.123 0.456 0.789 1.234 5.678", "CC BY-NC 4.0 and Apache-2.0", "550e8400-e29b-41d4-a716-446655440000",
]


def test_field_on_held_out_forms(field):
    """Recall and precision as the README states them; nothing is found that no base pattern gives in clean texts."""
    hits = [kind for kind, text in HELD_OUT if kind in {k for k, *_ in found_by(field, text)[1]}]
    assert len(hits) / len(HELD_OUT) >= 0.75, hits  # measured: 13 of 16
    assert not any(found_by(field, text)[1] for text in CLEAN)
    right = wrong = missed = 0
    for text, truth in pii_cases.cases(700, seed=99):
        base, more = found_by(field, text)
        right, wrong, missed = right + len((base | more) & truth), wrong + len(more - truth), missed + len(truth - base - more)
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.85


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 5), st.sampled_from(["phone", "id"]), st.integers(1, 9)), max_size=8))
def test_field_decodes_jointly(found):
    """The segments chosen are those, of all sets of segments that are apart, whose scores sum highest."""
    spans = [(s, s + n, kind, float(score)) for s, n, kind, score in found]
    best = max((sum(x[3] for x in some) for r in range(len(spans) + 1) for some in itertools.combinations(spans, r) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2))), default=0.0)
    got = pii.decode(spans)
    assert all(a[2] <= b[1] for a, b in itertools.pairwise(got))
    assert sum(max(x[3] for x in spans if (x[2], x[0], x[1]) == y) for y in got) == best


def test_field_on_very_long_texts(field):
    """A megabyte of numbers, of digits, or of text that nearly matches takes seconds."""
    import time

    for unit in ("123 456 7890 12 ", "1", "12.5 ", "a1b2", "john at example dot ", "12:30:", "((+", "DE12 "):
        began = time.time()
        pii.added_spans(unit * (300_000 // len(unit)), [], field)
        assert time.time() - began < 20, unit
    tail = "x " * 200_000 + "call 555-123-4567 now"
    assert found_by(field, tail)[1] == {("phone", 400_005, 400_017)}


def test_layout_words_and_captions():
    page = '<body class="no-sidebar"><div class="content has-sidebar"><p>Long enough text of the article.</p><figure><img src="x"><figcaption>A caption.</figcaption></figure></div><div class="sidebar">Side</div></body>'
    assert wrappers.extract(page, None) == "Long enough text of the article.\nA caption."
