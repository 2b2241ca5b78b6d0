"""Differencing decides which articles are a page's own."""

from candora.llm import html_text


def test_repeated_articles_are_furniture(spark):
    box = "<article class='x'><h2>Read our magazine</h2><p>Every week</p></article>"

    def page(k):
        return f"<body><div>Menu</div>{box}<article><h1>Title {k}</h1><p>Same remark</p><p>Text {k}</p></article><p>Tail {k}</p></body>"

    rows = [(k, f"http://h.example/n/{k}.html", page(k)) for k in range(5)]
    # one article on pages that differ in their furniture: nothing in it is the page's own, and it stays
    rows += [(10 + k, f"http://copies.example/n/{k}.html", f"<p>Ad {k}</p><article><p>The one text</p></article>") for k in range(4)]
    # no neighbour on the host: nothing is shared
    rows += [(20, "http://alone.example/1", page(20))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_text.extract_text(pages).collect()}
    for k in range(5):
        assert got[k] == [f"Title {k}", "Same remark", f"Text {k}"]
    assert all(got[10 + k] == ["The one text"] for k in range(4))
    assert got[20] == ["Read our magazine", "Every week", "Title 20", "Same remark", "Text 20"]


def test_articles_are_numbered():
    lines, kinds = html_text.page_lines("<p>o<main><article>a</article><article>b</article></main><nav>n</nav><article>c<form>f</form></article>")
    assert lines == ["o", "a", "b", "n", "c", "f"]
    assert kinds == [html_text.OUTSIDE, 1, 1, html_text.FURNITURE, 2, html_text.FURNITURE]
    assert html_text.main_lines(lines, kinds, [False, True, True, True, False, False]) == ["c"]
    assert html_text.main_lines(lines, kinds, [True, True, False, True, True, True]) == ["a", "b"]
    assert html_text.main_lines(lines, kinds, [False, True, True, True, True, True]) == ["a", "b", "c"]
