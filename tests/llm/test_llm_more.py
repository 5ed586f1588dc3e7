"""Language, nearest neighbours, wrappers and fixity against brute force and held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fixity, language_id, nearest, wrappers

MORE = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    from itertools import product

    r = np.random.default_rng(1)
    lengths = np.array([3, 1, 4, 2])
    local, step, start = r.random((lengths.sum(), 3)) + 0.1, r.random((3, 3)) + 0.1, r.random(3) + 0.1
    got, at = language_id.forward_backward(local, step, start, lengths), 0
    same, left, right = language_id.forward_backward(local, step, start, lengths, True)
    assert np.allclose(got, same)
    for n in lengths:
        want, pairs = np.zeros((n, 3)), np.zeros((max(n - 1, 0), 3, 3))
        for path in product(range(3), repeat=int(n)):
            w = start[path[0]] * local[at, path[0]]
            for t in range(1, n):
                w *= step[path[t - 1], path[t]] * local[at + t, path[t]]
            for t in range(n):
                want[t, path[t]] += w
            for t in range(n - 1):
                pairs[t, path[t], path[t + 1]] += w
        for t in range(n - 1):
            joint = left[at + t][:, None] * step * right[at + t + 1][None, :]
            assert np.allclose(joint / joint.sum(), pairs[t] / pairs[t].sum())
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_language_held_out_accuracy_and_und(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    rows = language_id.query(docs).where("held_out").join(docs, "doc_id").toPandas()
    assert (rows["lang_pred"] == rows["lang"]).mean() > 0.97 and rows["score"].between(0, 1).all()
    field = language_id.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 345 ½ _"), (None, "the and of"), (5, "the and of " * 9000), (5, "x")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"], r["lang_score"]) for r in language_id.label(odd, field).collect()]
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and got[3][1] == "en" and got[4][1] == "en" and len(got) == 6
    mixed = spark.createDataFrame([(1, "the and of the with are und der die nicht und das mit")], "doc_id long, text string")
    langs = [r["lang"] for r in language_id.label_words(mixed, field).orderBy("place").collect()]
    assert langs[0] == "en" and langs[-1] == "de"


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert language_id.query(docs).first()["lang_pred"] == "und"
    assert language_id.query(docs.limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def exact_lists(rows, k=5, every=50):
    """(query, rank, vec_id, score) by comparison with all."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    norm, out = np.linalg.norm(x, axis=1), []
    for i in np.flatnonzero(ids % every == 0):
        score = (x * x[i]).sum(axis=1) / (norm * norm[i])
        order = sorted((-s, j) for s, j, m in zip(score, ids, range(len(ids))) if m != i)[:k]
        out += [(int(ids[i]), r + 1, int(j), float(-s)) for r, (s, j) in enumerate(order)]
    return out


def test_nearest_of_very_large_and_small_components(spark):
    rows = [(50, [1e200, 0.0, 1e200], 0), (1, [1e200, 0.0, 9e199], 0), (2, [1e-200, 1e-200, 0.0], 0), (3, [3.0, 0.0, -3.0], 0)]
    got = [(r["vec_id"], round(r["score"], 9)) for r in nearest.neighbours(vectors(spark, rows)).orderBy("rank").collect()]
    assert got == [(1, round(1.9 / (2 * 1.81) ** 0.5, 9)), (2, 0.5), (3, 0.0)]


def test_nearest_recall_and_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    exact = exact_lists([(r["vec_id"], r["embedding"]) for r in e.collect()])
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in nearest.neighbours(e, leaf=256).collect()}
    want = {(q, v): s for q, _, v, s in exact}
    assert len(got) == len(want) and len(got.keys() & want.keys()) / len(want) >= 0.9
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got.keys() & want.keys())


def test_nearest_ties_copies_and_odd_vectors(spark):
    r = random.Random(2)
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, same, 0) for i in range(120)] + [(200 + i, [r.gauss(0, 1) for _ in range(4)], 0) for i in range(60)]
    rows += [(300, None, 0), (350, [0.0] * 4, 0), (400, [1.0, None, 1.0, 1.0], 0), (450, [float("nan")] * 4, 0), (500, [1.0], 0), (None, same, 0), (7, same, 0)]
    got = [tuple(x) for x in nearest.neighbours(vectors(spark, rows), leaf=32).orderBy("query_id", "rank").collect()]
    exact = exact_lists([(i, v) for i, v, _ in rows[:180]])
    assert [g[:3] for g in got if g[0] < 200] == [x[:3] for x in exact if x[0] < 200] and {g[0] for g in got} == {0, 50, 100, 200, 250}
    assert nearest.neighbours(vectors(spark, rows).limit(0)).count() == 0 and nearest.neighbours(vectors(spark, [(50, same, 0)])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site <a href=/>home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="sidebar"><p>Side</p></div>%s<form><p>Mail <input name=x></p></form><section class="comments"><p>First!</p></section><footer>&copy; x</footer>"""


def alone(page):
    """The text of a page that is its host's only one."""
    return wrappers.main_text(page, wrappers.decided(wrappers.tree(page)[0]))


def test_main_text_of_articles():
    body = "<article><h1>Head &amp; line</h1><p>One  two<br>three <b>bo</b>ld<p>Four<aside>no</aside><div class='ad'>buy</div><ul><li>i<li>ii</ul><div id=comments><p>me</p></div></article>"
    assert alone(PAGE % body) == "Head & line\n\nOne two three bold\n\nFour\n\ni\n\nii"
    assert alone(None) == "" and alone("<p") in ("", "<p") and alone("a < b") == "a < b"
    assert alone("<article><p>x<script>if (a<b) document.write('<p>y</p>')") == "x"
    assert alone("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert alone("<div class=related-links-box><p>side</p></div><article><p>A longer text</p></article><div class=outbrain><p>more</p></div>") == "A longer text"


def test_wrappers_tell_template_from_slots(spark, monkeypatch):
    pages = [(i, f"http://h.example/{i}", f"<html><body><div class=top><p>Always the same</p></div><div class=post><p>Text {i} here</p><p>More {i}</p></div><div class=links><p><a href=/x>one {i}</a></p></div></body></html>") for i in range(150)]
    pages += [(None, None, None), (900, "odd", ""), (901, "http://solo.example/", "<div><p>Only page</p></div>"), (1, pages[1][1], pages[1][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("wrapper", F.lit(2))
    for sent, part in ((wrappers.SENT, wrappers.PART), (0, 20)):  # by broadcast, and by parts of hosts
        monkeypatch.setattr(wrappers, "SENT", sent)
        monkeypatch.setattr(wrappers, "PART", part)
        got = [(r["page_id"], r["text"], r["n_chars"]) for r in wrappers.extract(df).collect()]
        assert (3, "Text 3 here\n\nMore 3", 19) in got and got.count((1, "Text 1 here\n\nMore 1", 19)) == 2
        assert (None, "", 0) in got and (900, "", 0) in got and (901, "Only page", 9) in got and len(got) == len(pages)
        assert wrappers.extract(df.limit(0)).count() == 0


def shape(nodes):
    """Labels with ? for optional and + for repeated ones, and children in brackets."""
    return " ".join(k.label.split("(")[0] + ("?" if k.optional else "") + ("+" if k.repeated else "") + (f"[{shape(k.kids)}]" if k.kids else "") for k in nodes)


def wrapper_of(*pages):
    out = wrappers.tree(pages[0])[0]
    for p in pages[1:]:
        out = wrappers._merged(out, wrappers.tree(p)[0], True)
    return out


def test_repeated_groups_nest_and_align():
    row = lambda n: "<section>" + "<div class=q>q</div><div class=a>a</div>" * n + "</section>"
    assert shape(wrappers.tree(row(3) + row(2))[0].kids) == "section+[+[div q[#] div a[#]]]"
    # one turn on one page, several on the other; an element that one page lacks
    assert shape(wrapper_of(row(1), row(4)).kids) == "section[+[div q[#] div a[#]]]"
    assert shape(wrapper_of("<div class=x>1</div><div class=y>2</div>", "<div class=x>1</div><div class=z>3</div><div class=y>4</div>").kids) == "div x[#] div z?[#] div y[#]"
    deep = lambda n, m: "<section>" + ("<div class=h>h</div>" + "<div class=q>q</div><div class=a>a</div>" * m) * n + "</section>"
    assert shape(wrapper_of(deep(3, 2), deep(2, 2)).kids) == "section[+[div h[#] +[div q[#] div a[#]]]]"
    w = wrapper_of("<div class=x>same</div><p>one", "<div class=x>same</div><p>two")
    assert w.kids[0].kids[0].texts and not w.kids[1].texts


def naive(pages):
    """Texts by an aligner that knows paths only: a text is constant if all pages that have its path have it, on three at least."""
    import html.parser

    class Paths(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.out = [], []

        def handle_starttag(self, tag, attrs):
            self.open.append(tag + "." + dict(attrs).get("class", ""))

        def handle_endtag(self, tag):
            self.open.pop()

        def handle_data(self, data):
            self.out.append(("/".join(self.open), data))

    rows = []
    for p in pages:
        parser = Paths()
        parser.feed(p)
        rows.append(parser.out)
    having = lambda path: [{t for q, t in r if q == path} for r in rows if any(q == path for q, _ in r)]
    constant = {path: set.intersection(*having(path)) if len(having(path)) >= 3 else set() for path in {q for r in rows for q, _ in r}}
    return ["\n\n".join(t for q, t in r if t not in constant[q] and "nav." not in q and "/footer." not in q and "div.ad" not in q) for r in rows]


def test_wrappers_agree_with_a_naive_aligner_without_articles(spark):
    import random

    r = random.Random(3)
    some = lambda: " ".join(r.choice("abcdefgh") * 3 + str(r.randrange(999)) for _ in range(r.randrange(4, 30)))
    pages = []
    for i in range(140):
        rows = "".join(f"<div class=q><div class=who>Asked by</div><div class=what>{some()}</div></div>" for _ in range(r.randrange(4)))
        note = "<div class=hint>Read this first</div>" if i % 3 else ""
        ad = f"<div class=ad><div class=x>{some()}</div></div>" if i % 2 else ""
        pages.append(f"<body><nav><div class=m>{some()}</div></nav><div class=top>Welcome to us</div>{ad}<section><div class=title>{some()}</div>{note}<div class=text>{some()}</div>{rows}</section><footer><div class=c>{some()}</div></footer></body>")
    got = texts_of(spark, pages)
    assert [got[i] for i in range(140)] == naive(pages)


def test_extraction_over_pages(spark):
    pages = spark.read.parquet(f"{MORE}/pages.parquet")
    rows = wrappers.query(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        assert r["text"] and "var t" not in r["text"] and "&copy;" not in r["text"] and r["n_chars"] == len(r["text"]) and len(r["text"]) <= len(inside)


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}


def test_wrapper_decides_inside_and_beside_an_article(spark):
    inside = [f"<body><article><h1>Head {i}</h1><p>Text {i}</p><p>Share this with friends</p><div class=bio>Written by our desk</div></article></body>" for i in range(90)]
    got = texts_of(spark, inside)
    # what recurs within an article is the article's
    assert all(got[i] == f"Head {i}\n\nText {i}\n\nShare this with friends\n\nWritten by our desk" for i in range(90))
    summary = [f"<body><article><h2>Summary</h2><p>Text {i}</p></article></body>" for i in range(30)]
    assert texts_of(spark, summary)[7] == "Summary\n\nText 7"
    beside = [f"<body><div class=story><p>{'Long main text ' * 9}{i}</p><p>Always here</p></div><article><p>Teaser {i}</p></article></body>" for i in range(90)]
    got = texts_of(spark, beside)
    assert all(f"{'Long main text ' * 9}{i}" in got[i] and "Always here" not in got[i] for i in range(90))
    assert "Long main text" in texts_of(spark, beside[:1])[0]
    assert set(texts_of(spark, ["<article><p>The same page</p></article>"] * 20).values()) == {"The same page"}


def test_class_names_count_as_whole_tokens_and_never_above_an_article():
    for name in ("content has-sidebar", "no-comments", "with-menu", "page-header"):
        assert alone(f"<div class='{name}'><article><h1>Head</h1><p>Text</p></article></div>") == "Head\n\nText"
        assert alone(f"<div class='{name}'><p>Text</p></div>") == "Text"
    assert alone("<div class='sidebar'><p>Side</p><article><p>Text</p></article></div>") == "Text"
    assert alone("<div class='site-footer'><p>x</p></div><div class=comments><article class=comment><p>me</p></article></div><p>Text</p>") == "Text"


def test_comments_and_adverts_under_longer_names_and_at_any_depth():
    for name in ("user-comments", "reader-responses", "comment-table", "adsense", "ad-slot", "promo-article", "search-results", "comments-thread"):
        assert alone(f"<article><h1>Head</h1><p>Text</p><div class='{name}'><p>other</p></div></article>") == "Head\n\nText", name
    deep = "<div>" * 90
    for inner in ("<aside><p>side</p></aside>", "<div class=comments><p>me</p></div>", "<nav><p>menu</p></nav>"):
        assert alone(f"<article><p>Text</p>{deep}<p>Deep</p>{inner}<p>End</p>{'</div>' * 90}</article>") == "Text\n\nDeep\n\nEnd", inner


def test_long_irregular_pages_lose_no_text():
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    page = lambda i: "<body>" + "".join(f"<div class=k{letters(1000 * i + j)}><p>t{i} {j}</p></div>" for j in range(900)) + f"<div class=note><p>Always here</p></div><div class=story><p>Story {i}</p></div><div class=note><p>Always here</p></div><div class=story><p>More {i}</p></div></body>"
    pages = [page(i) for i in range(6)]
    out = wrapper_of(*pages)
    assert len(out.kids[0].kids) <= 2 * wrappers.LONGEST + 10
    known = wrappers.decided(wrappers.Node.of(wrappers.json.loads(wrappers.json.dumps(out.plain()))))
    for i, p in enumerate(pages):
        text = wrappers.main_text(p, known)
        assert "Always here" not in text and text.endswith(f"Story {i}\n\nMore {i}") and all(f"t{i} {j}" in text for j in range(900))


def record(i, html):
    return (i, f"http://x/{i}", html)


def test_fixity_finds_every_fault(spark):
    rows = [record(i, f"page {i}") for i in range(5000)] + [record(None, "lost"), record(70_000_000, "far"), record(-3, "below"), record(12, "twice"), record(12, "twice")]
    bad = [record(i, t + ("!" if i in (17, 4999, -3) else "")) for i, _, t in rows if i not in (100, 2048)] + [record(9000, "new")]
    make = lambda x: spark.createDataFrame(x, "page_id long, url string, html string").withColumn("file", F.lit(1))
    got = {(r["page_id"], r["state"]) for r in fixity.audit(make(rows), make(bad)).collect()}
    assert got == {(17, "changed"), (4999, "changed"), (-3, "changed"), (100, "missing"), (2048, "missing"), (9000, "extra")}
    assert {(r["page_id"], r["state"]) for r in fixity.audit(make(rows), make(rows[:-1])).collect()} == {(12, "changed")}
    r = random.Random(1)
    assert fixity.audit(make(rows), make(r.sample(rows, len(rows)))).count() == 0
    assert fixity.audit(make(rows[:0]), make(rows[:0])).count() == 0
    assert {x["state"] for x in fixity.audit(make(rows[:0]), make(rows[:3])).collect()} == {"extra"}


@pytest.mark.parametrize("name", ["op1_language_crf", "op9_nearest", "op7_wrappers", "op3_merkle_fixity"])
def test_queries_are_registered(name):
    from plumbline.llm import queries

    assert name in queries.queries()
