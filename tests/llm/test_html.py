import pytest

from tessera.llm import html


@pytest.fixture(scope="module")
def model():
    return html.model()


def test_article_without_its_surroundings(model):
    page = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
    <div class=ad>Buy now, it is cheap.</div><article><h1>A &amp; B</h1><p><b>First   line<br>goes on.<p>Second &eacute;t&#233; one.</p></article>
    <aside class="sidebar"><h3>Related</h3><a href=/x>Other</a></aside><section class="comments"><p>I agree with all of this.</p></section>
    <form class="search"><input name=q> Find it</form><footer>&copy; me &middot; All rights reserved.</footer></body></html>"""
    assert html.main_text(page, model) == "A & B\nFirst line goes on.\nSecond été one."


def test_markup_of_any_kind_is_read(model):
    assert html.main_text(None, model) == html.main_text("", model) == ""
    assert html.main_text("<!-- open <p>x", model) == ""
    assert html.main_text("<p>One.<p>Two &lt;b&gt;", model) == "One.\nTwo <b>"
    assert "deep" in html.main_text("<div>" * 6 + "<p>deep and long enough to be content, surely.</p>", model)
    assert html.main_text("<div>" * 20_000 + "<p>x</p>", model) in ("", "x")
    assert html.main_text("<article><p>a</b></i></p></div>text.</article>", model) == "a\ntext."
    assert html.main_text("<article><pre>a\n  b</pre><table><tr><td>c<td>d</table></article>", model) == "a b\nc\nd"


def test_what_belongs_and_what_does_not(model):
    body = "<p>First of some plain sentences here, and it goes on a while.</p><p>A second one that says a little more than that.</p>"
    want = "First of some plain sentences here, and it goes on a while.\nA second one that says a little more than that."
    linked = '<p><a href="/x">All of this paragraph is a link to somewhere else on the site.</a></p>'
    text = lambda inner, after="": html.main_text(f"<html><body><article><h1>Title of it</h1>{inner}</article>{after}</body></html>", model)
    assert text(body + linked).endswith("\nAll of this paragraph is a link to somewhere else on the site.")
    assert text("<ul><li><a href=/1>Part one of it</a></li><li><a href=/2>Part two of it</a></li></ul>" + body).startswith("Title of it\nPart one of it\nPart two of it\n")
    assert text(body, "<div>Copyright 2020 Example Press. All rights reserved.</div>") == f"Title of it\n{want}"
    assert text(f"<p hidden>Not to be seen by anyone.</p>{body}<div style='display: none'>Nor is this one here.</div>") == f"Title of it\n{want}"
    assert text(f"<label>Your name</label>{body}") == f"Title of it\n{want}"
    assert text("<p>Seen <span style='display:none'>unseen </span>again &am<b>p;T</b> and so on, for a while.</p>") == "Title of it\nSeen again &amp;T and so on, for a while."


def test_unclosed_elements_end_with_their_parent(model):
    for tag in ("button", "select", "video", "object"):
        assert html.main_text(f"<article><p>Some words before it. <{tag}>inside</p><p>And some words after it.</p></article>", model) == "Some words before it.\nAnd some words after it."
    assert html.main_text("<article><p>The sum <math><mi>x</mi></math> is small, as it were.</p><video/><p>More of the same text.</p></article>", model) == "The sum x is small, as it were.\nMore of the same text."
    assert html.main_text("<article><p>Kept words, some of them.</p><script>x<p>lost", model) == "Kept words, some of them."
    assert html.parse("<button>" * 20_000)


def test_held_out_pages(model):
    right = total = 0
    for page in html.labelled_pages(80, seed=1234):
        nodes = html.parse(page)
        labels = []
        for n, p in zip(nodes, model.marginals(nodes)):
            y = html._attributes(n.attributes).get("data-y")
            labels.append(int(y) if y else labels[n.parent] if n.parent >= 0 else 0)
            if n.text is not None:
                total += 1
                right += (p >= 0.5) == labels[-1]
    assert right / total > 0.96


def test_marginals_equal_enumeration(model):
    """Sum-product against all labellings of a small tree."""
    nodes = html.parse('<div class="menu"><a href=/x>y</a></div><article><p>Some text, longer.</p></article>')
    n = len(nodes)
    import itertools
    import math

    own = []
    for x in nodes:
        z = sum(model.signs.get(s, 0.0) for s in html.signs(x, nodes[max(0, x.parent)]))
        p = 1 / (1 + math.exp(-max(-25.0, min(25.0, z))))
        own.append((1 - p, p))
    weights, content = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n):
        w = (model.root if labels[0] else 1 - model.root) * own[0][labels[0]]
        for i in range(1, n):
            w *= own[i][labels[i]] * model.pair(html.link(nodes[i], nodes[nodes[i].parent]))[labels[nodes[i].parent]][labels[i]]
        weights += w
        for i in range(n):
            content[i] += w * labels[i]
    for got, want in zip(model.marginals(nodes), (c / weights for c in content)):
        assert abs(got - want) < 1e-6


def test_table_cases(spark, model):
    df = spark.createDataFrame([(1, "u", None, 0), (1, "u", None, 0), (2, None, "<p>Hello there, reader.</p>", 9)], "page_id long, url string, html string, text int")
    rows = html.extract(df, model, ["page_id", "url"]).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in rows) == [(1, "", 0), (1, "", 0), (2, "Hello there, reader.", 20)]
    assert html.extract(df.limit(0), model, ["page_id"]).count() == 0


@pytest.mark.parametrize("odd", [False, True])
def test_unseen_names(monkeypatch, odd):
    """Trained on pages with every second name of menus, adverts, comments and articles, judged on pages with the others: by
    characters, nearly all of the article is found, and most of what is found is of the article."""
    named, articles = html.OTHERS, html.ARTICLES

    def half(names, second):
        parts = names.split(";")
        return ";".join(parts[1::2] if second else parts[::2])

    def use(second):
        monkeypatch.setattr(html, "OTHERS", {k: half(v, second) for k, v in named.items()})
        monkeypatch.setattr(html, "ARTICLES", half(articles, second))

    use(odd)
    model = html.train(html.labelled_pages(400))
    use(not odd)
    right = found = there = 0
    for page in html.labelled_pages(80, seed=99):
        nodes, labels = html.parse(page), []
        for n, p in zip(nodes, model.marginals(nodes)):
            y = html._attributes(n.attributes).get("data-y")
            labels.append(int(y) if y else labels[n.parent] if n.parent >= 0 else 0)
            if n.text is not None:
                w = len(n.text.strip())
                right, found, there = right + w * (p >= 0.5 and labels[-1]), found + w * (p >= 0.5), there + w * labels[-1]
    assert right / found > 0.7 and right / there > 0.95
