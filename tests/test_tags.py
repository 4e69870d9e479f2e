"""Links, character references and markdown structure: against the standard
library's HTML parser and on literal pages."""

import html
import random
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import functions as F

from askbatch.functions.references import decode_references
from askbatch.operators.links import extract_links, find_pdf_links, link_failures
from askbatch.operators.markdown import html_to_markdown

SF = "/root/testdata/sf0.01"


class Hrefs(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)         # the last of equal names counts
        if tag == "a" and "href" in given:
            self.found.append((given["href"] or "").strip(" \t\n\r\f\v"))


def parsed(page):
    p = Hrefs()
    p.feed(page)
    p.close()
    return p.found


def hrefs(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i long, html string").withColumn("url", F.lit("http://h/"))
    out = {}
    for r in extract_links(df, keep=("i",)).orderBy("i", "pos").collect():
        out.setdefault(r.i, []).append(r.href)
    return [out.get(i, []) for i in range(len(pages))]


LITERALS = [
    '<a href="y.pdf" title="see href=x.pdf">y</a>',
    '<a title="a>b" href="z.pdf">z</a>',
    '<a/href="q.pdf">q</a>',
    '<p title="<a href=fake.pdf>">none</p>',
    "<a href='one' href=two>", "<a href>", '<A CLASS=k HREF = "up.pdf" >', "<a\nhref=line.pdf\n>", "<a href=a&amp;b>",
    '<a href="&#x41;&eacute;">', "<abbr href=no>", "<a data-href=no>", "<a title=it's href=yes>", "<a href=x/>t</a>",
    '<!-- <a href="c"> --><a href=k>', '<script>"<a href=s>"</script><a href=k>', '<style><a href=s></style>',
    '<p title="<!-- "><a href=shown></p><p title=" -->">', '<a x="1"href="tight">', "text < 3 <a href=k>", "<!doctype a><a href=k>",
]


def test_hrefs_equal_the_standard_parser(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rng = random.Random(6)
    bits = ['<a ', 'href=', '"x.pdf"', "'y'", "z", " title=", '">"', '"<a href=f>"', ">", "</a>", "text", "<p>", "<b class='k'>",
            "<!-- c -->", " ", "&amp;", "/"]
    made = ["<a href=" + rng.choice(["'q'", '"r"', "s"]) + " " + "".join(
        rng.choice([" title='a>b'", ' class="k"', " id=7", " hidden", '\nrel="x y"', " data-href=no", ' alt="<a href=f>"'])
        for _ in range(rng.randint(0, 4))) + rng.choice([">", " >", "/>"]) + rng.choice(["t</a>", "t", "<b title='>'>t</b></a>", "<!-- <a href=c> -->"])
        for _ in range(300)]
    mixed = ["".join(rng.choices(bits, k=12)) + "<p>" for _ in range(200)]
    got = hrefs(spark, LITERALS + pages + made)
    assert got == [parsed(p) for p in LITERALS + pages + made]
    assert got[:4] == [["y.pdf"], ["z.pdf"], ["q.pdf"], []]
    hrefs(spark, mixed)             # ill-formed pages do not fail


def test_long_pages_do_not_overflow(spark):
    pages = ["<a " + "k='v' " * 50000 + "href=last>x</a>", "<p>" * 100000 + "<a href=x>" + "y" * 300000,
             "<!-- " + "x" * 500000, "<a title='" + ">" * 300000 + "' href=q>"]
    assert hrefs(spark, pages) == [["last"], ["x"], [], ["q"]]


def test_references_equal_the_standard_library(spark):
    rng = random.Random(1)
    texts = ["&amp;lt;", "&amp", "&am", "&", "&&", "&;", "&#65;", "&#x41;", "&#X41", "&#0;", "&#128;", "&#x9f;", "&#xD800;",
             "&#x110000;", "&#99999999999999999999;", "&#1;", "&#xfdd0;", "&#x1F600;", "&#xFFFF;", "&notit;", "&notin;", "&ampx",
             "&copyright", "&lt&gt", "& amp;", "&#", "&#x", "&#;", "a&b&c=1&copy=2", "&AMP;&Amp;", "&eacute;t&eacute", "", "none"]
    texts += ["".join(rng.choice(["&", "#", "x", ";", "amp", "lt", "1", "9f", "A", " ", "é"]) for _ in range(rng.randint(1, 12)))
              for _ in range(1000)]
    texts += [f"a&{k}b" for k in html5]
    texts += [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in df.select("t", decode_references(F.col("t")).alias("d")).collect():
        assert r.d == (None if r.t is None else html.unescape(r.t)), r.t


def markdown(spark, page):
    df = spark.createDataFrame([("u", page)], "url string, html string")
    return html_to_markdown(df).first().markdown.removeprefix("source: u \n").removesuffix("\n\n")


def test_lists_nest_and_count(spark):
    assert markdown(spark, "<ol><li>a</li><li>b<ul><li>c<li>d</ul></li><li>e</li></ol>x") == \
        "1. a\n2. b\n  * c\n  * d\n\n3. e\n\nx".replace("d\n\n3", "d\n3")
    assert markdown(spark, "<ul><li>a<ol><li>b</li><li>c<ol><li>d</ol></ol></li></ul><ol><li>e</ol>") == \
        "* a\n  1. b\n  2. c\n    1. d\n\n1. e"
    assert markdown(spark, "<li>loose</li></ul>tail") == "* loose\n\ntail"


def test_quotes_and_pre(spark):
    quoted = markdown(spark, "p<blockquote>a<br>b<blockquote>c</blockquote>d</blockquote>e").split("\n")
    assert "> a" in quoted and "> b" in quoted and "> > c" in quoted and "> d" in quoted and quoted[-1] == "e"
    code = markdown(spark, "<p>t</p><pre>if  x:\n\ty &lt; 1\n<b>z</b></pre><p>  after   all</p>")
    assert code == "t\n\n    if  x:\n        y < 1\n    z\n\nafter all"
    assert markdown(spark, '<p title="a > b">k</p><ul class="x > y"><li id=1>m</li></ul>') == "k\n\n* m"
    assert markdown(spark, "") == "" and markdown(spark, "\x01\x02<p>a\x03b") == "ab"


def test_pdf_links_only_of_downloaded_pages(spark):
    page = "<a href='a.pdf'>a</a>"
    pages = spark.createDataFrame([("http://ok/", page, 200), ("http://gone/", page, 404), ("http://none/", None, 200),
                                   ("http://what/", page, None)], "url string, html string, status int")
    assert [r.page_url for r in find_pdf_links(pages).collect()] == ["http://ok/"]
    assert sorted((r.key, r.reason) for r in link_failures(pages).collect()) == [
        ("http://gone/", "http_status 404"), ("http://none/", "no_content"), ("http://what/", "http_status -")]
