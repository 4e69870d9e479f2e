"""Links (F3, F10, F11), markdown rules, question hygiene (F14), query rewrite."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from askbatch.functions.links import resolve_url
from askbatch.operators.links import extract_links, find_pdf_links
from askbatch.operators.markdown import html_to_markdown
from askbatch.operators.questions import normalize_query, valid_questions

F3_HTML = """
<html><body>
  <a href="test1.pdf">PDF 1</a>
  <a href="test2.pdf">PDF 2</a>
  <a href="not-a-pdf.txt">Not a PDF</a>
</body></html>"""


def test_f3_pdf_links(spark):
    pages = spark.createDataFrame([("http://example.com", F3_HTML)], "url string, html string")
    got = sorted(r.link_url for r in find_pdf_links(pages).collect())
    assert got == ["http://example.com/test1.pdf", "http://example.com/test2.pdf"]


def test_f10_resolution_matches_urljoin(spark):
    bases = ["http://example.com", "http://e.com/a/b/c?x=1#f", "https://e.com/a/"]
    hrefs = ["t.pdf", "/t.pdf", "../t.pdf", "../../../t.pdf", "./x/./t.pdf", "//o.com/t.pdf",
             "https://z.org/q.pdf", "?p=t.pdf", "#t.pdf", "x/../y.pdf", "a/..", "", ".", ".."]
    rows = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(rows, "base string, href string")
    got = {(r.base, r.href): r.u for r in df.select("base", "href", resolve_url("base", "href").alias("u")).collect()}
    for b, h in rows:
        assert got[(b, h)] == urljoin(b, h), (b, h)


F11_HTML = """<html><a href="X.PDF">One</a> <a href='x.pdf?dl=1'>q</a> <A HREF= x.pdf >  spaced
  text </a><a href=" x.pdf ">dup</a><a href="e.pdf"></a>
<!-- <a href="c.pdf">c</a> --><script>var s='<a href="s.pdf">';</script>
<a data-href="d.pdf">d</a><abbr href="ab.pdf">ab</abbr>
<a class="k" href="a.pdf?x=1&amp;y=2.pdf">amp</a><a href="open.pdf">unclosed <a href="next.pdf">next</a></html>"""


def test_f11_link_edge_cases(spark):
    pages = spark.createDataFrame([("http://h.org/dir/p.html", F11_HTML)], "url string, html string")
    links = extract_links(pages).orderBy("pos").collect()
    assert [r.href for r in links] == ["X.PDF", "x.pdf?dl=1", "x.pdf", "x.pdf", "e.pdf",
                                       "a.pdf?x=1&y=2.pdf", "open.pdf", "next.pdf"]
    texts = {r.href: r.text for r in links}
    assert texts["e.pdf"] == "Unnamed link"
    assert "spaced text" in [r.text for r in links]
    pdf = sorted(r.link_url for r in find_pdf_links(pages).collect())
    assert pdf == ["http://h.org/dir/X.PDF", "http://h.org/dir/a.pdf?x=1&y=2.pdf", "http://h.org/dir/e.pdf",
                   "http://h.org/dir/next.pdf", "http://h.org/dir/open.pdf", "http://h.org/dir/x.pdf"]


def test_null_page_has_no_links(spark):
    pages = spark.createDataFrame([("http://x", None)], "url string, html string")
    assert find_pdf_links(pages).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style>
<script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li><li>B</li></ul></nav>
<!-- c --><h1>Head &amp; more</h1><p><b>bold</b> and <i>it</i><br>line &copy; &middot; &quot;q&quot; &amp;lt;
<img src="x.png"><p>two   spaces
here</p></body></html>"""


def test_markdown_rules(spark):
    pages = spark.createDataFrame([("http://p", PAGE)], "url string, html string")
    md = html_to_markdown(pages).first().markdown
    assert md.startswith("source: http://p \n")
    assert md.endswith("\n\n")
    assert "<" not in md.replace("&lt;", "") or "&lt;" in md
    assert "var t" not in md and "p{}" not in md and "T\n" not in md
    assert "# Head & more" in md
    assert "* A" in md and "* B" in md
    assert "**bold** and _it_\nline © · \"q\" &lt;" in md
    assert "two spaces here" in md
    assert "\n\n\n" not in md


def test_f14_valid_questions(spark):
    qs = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, "\t"), (5, "ok?")],
                               "question_id long, question string")
    assert [r.question_id for r in valid_questions(qs).collect()] == [5]


def test_normalize_query_drops_site_and_stop_words(spark):
    qs = spark.createDataFrame([(1, "How do I make a Cake? site:example.com cake"), (2, "the of and"),
                                (3, "site:x.org")], "question_id long, question string")
    got = {r.question_id: r.query for r in normalize_query(qs).collect()}
    assert got[1] == "make cake"
    assert got[2] == "the of and"      # nothing left: distinct tokens
    assert got[3] == "site:x.org"      # no tokens at all: the question itself


def test_q12_missing_page_gives_failure_row(spark):
    from askbatch.operators.links import link_failures
    pages = spark.createDataFrame([("http://x", None), ("http://y", "<a href='a.pdf'>a</a>")], "url string, html string")
    assert [(r.key, r.reason) for r in link_failures(pages).collect()] == [("http://x", "no_content")]
    assert [r.page_url for r in find_pdf_links(pages).collect()] == ["http://y"]


def test_scan_pages_defaults_status(spark):
    from askbatch.session import scratch_path
    from askbatch.sources.pages import scan_pages
    path = scratch_path(spark, "snapshot")
    spark.createDataFrame([(1, "http://a", "<p>a</p>")], "page_id long, url string, html string").write.parquet(path)
    assert [r.status for r in scan_pages(spark, path).collect()] == [200]


def test_markdown_tables_and_rules(spark):
    html = "<table><tr><td>a</td><td>b</td></tr><tr><th>c</th><td>d</td></tr></table><hr>end"
    md = html_to_markdown(spark.createDataFrame([("u", html)], "url string, html string")).first().markdown
    assert "a b" in md and "c d" in md and "* * *" in md and md.rstrip().endswith("end")


def test_unclosed_blocks_reach_the_end_of_the_page(spark):
    tails = ["<script>var s='<a href=\"s.pdf\">';", "<style>p { <a href=\"s.pdf\">", "<!-- <a href=\"s.pdf\">c"]
    pages = spark.createDataFrame(
        [(f"http://h.org/{i}", f'<html><body><a href="k.pdf">kept</a>{t}') for i, t in enumerate(tails)],
        "url string, html string")
    assert [r.href for r in extract_links(pages).collect()] == ["k.pdf"] * 3
    assert [r.markdown.split()[2:] for r in html_to_markdown(pages).collect()] == [["kept"]] * 3
