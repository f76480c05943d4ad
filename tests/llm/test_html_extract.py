"""HTML extraction on hand-made pages."""

from twinlens.llm import html_extract


def texts(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_extract.extract(df, **kw).collect()}


PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
        '<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad --><div class="ad">buy</div>'
        '<article><h1>Head &amp; tail</h1><p><b>One&nbsp; two\n three<br><p>Four &am five</p>'
        '<aside>side</aside><div class="comments"><p>nice!</p></div><form>name</form><p>{}</p></article>'
        '<footer>&copy; host</footer></body></html>')


def test_article_without_boilerplate(spark):
    got = texts(spark, [(1, "http://a.example/x", PAGE.format("last"))])
    want = "Head & tail\nOne two three\nFour &am five\nlast"
    assert got == {(1, "http://a.example/x"): (want, len(want))}


def test_template_subtrees_go_where_no_article_is_marked(spark):
    page = '<body><div><p>Welcome to our site</p></div><div><p>story {}</p></div><div id="x"><p>Call us</p></div></body>'
    rows = [(i, "https://www.b.example/" + str(i), page.format(i)) for i in range(6)]
    rows.append((99, "https://c.example/", page.format(99)))          # another host: seen once there
    for kw in ({}, {"broadcast_rows": -1}):                           # both ways the templates travel
        got = texts(spark, rows, **kw)
        assert all(got[i, "https://www.b.example/" + str(i)][0] == f"story {i}" for i in range(6))
        assert got[99, "https://c.example/"][0] == "Welcome to our site\nstory 99\nCall us"


def test_copied_articles_keep_their_text(spark):
    rows = [(i, "http://a.example/" + str(i), PAGE.format("same")) for i in range(8)]
    assert {t for t, _ in texts(spark, rows).values()} == {"Head & tail\nOne two three\nFour &am five\nsame"}


def test_copies_and_shared_passages_without_a_marked_article_stay(spark):
    copy = '<head><title>{}</title></head><body><div><h1>Title</h1><p>The whole story</p></div><nav>{}</nav></body>'
    rows = [(i, "http://a.example/" + str(i), copy.format(i, i)) for i in range(8)]
    quote = "<body><div><p>story {}</p>{}</div><div><p>Call us</p></div></body>"
    rows += [(i, "http://b.example/" + str(i), quote.format(i, "<p>To be or not</p>" if i % 8 == 0 else "")) for i in range(40)]
    for kw in ({}, {"broadcast_rows": -1}):
        got = {k: t for k, (t, _) in texts(spark, rows, **kw).items()}
        assert all(got[i, "http://a.example/" + str(i)] == "Title\nThe whole story" for i in range(8))
        assert all(got[i, "http://b.example/" + str(i)] == f"story {i}" + ("\nTo be or not" if i % 8 == 0 else "") for i in range(40))


def test_hints_spare_the_article_and_what_holds_it(spark):
    article = '<article class="post has-comments"><h1>Head</h1><p>Text</p></article>'
    pages = ['<div class="layout with-sidebar">%s</div><div class="sidebar">no</div>', '<form id="aspnetForm"><p>menu</p>%s</form>',
             '<div class="sidebar"><div>%s</div></div>', '<main><form id="f">%s</form></main>',
             '%s<div class="related"><article><p>teaser</p></article></div><aside><article>teaser</article></aside>']
    inside = ('<article><h2 id="related-work">Related work</h2><h2 id="share">Shares</h2><p class="ad-hoc">Ad hoc</p>'
              '<section id="social-history"><p>History</p></section><div class="comments-area">no</div>'
              '<div class="ad-slot">no</div><div class="share-buttons">no</div><p id="newsletter">no</p><div class="site-nav">no</div></article>')
    plain = '<div><p>Story</p></div><aside><article><p>teaser</p></article></aside>'
    rows = [(i, f"http://h{i}/", f"<body>{p}</body>") for i, p in enumerate([p % article for p in pages] + [inside, plain])]
    got = texts(spark, rows)
    assert [got[i, f"http://h{i}/"][0] for i in range(7)] == [
        *["Head\nText"] * 5, "Related work\nShares\nAd hoc\nHistory", "Story"]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "", ""), (None, "x", "plain text"), (4, "http://h/", "<p>a<p>b<p"), (4, "http://h/", "<p>a<p>b<p"),
            (5, "h", "<article>" + "w " * 50_000), (6, "h", deep), (7, "h", "</div></p><table><tr><td>1<td>2<tr><td>3</table>")]
    got = texts(spark, rows)
    assert got[1, None] == ("", 0) and got[2, ""] == ("", 0)
    assert got[None, "x"][0] == "plain text"
    assert got[4, "http://h/"][0].startswith("a\nb")
    assert got[5, "h"][1] == 99_999 and got[6, "h"][0] == "deep" and got[7, "h"][0] == "1 2\n3"
    assert texts(spark, []) == {}


def test_hosts():
    assert [html_extract.host_of(u) for u in ("https://u:p@A.Example:8/x", "a.example/y", "//a.example?z", None, "")] == \
        ["a.example"] * 3 + ["", ""]
