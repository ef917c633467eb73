"""Main text of pages: wrappers on hosts with and without telling tags, against plain readings of the templates."""

import html as references
import random
import re

from mailspark.llm import html_extract as he
from mailspark.llm import queries

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def rows(spark, pages, **kw):
    return {r[0]: r.text for r in he.extract(spark.createDataFrame(pages, SCHEMA).repartition(3), columns=["page_id"], **kw).collect()}


def test_given_pages_whole(spark):
    got = {r.page_id: r for r in queries.op12_html_extraction(spark, FOLDER).collect()}
    for page in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        blocks = (" ".join(references.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", body))
        want = "\n".join(b for b in blocks if b)
        assert (got[page.page_id].text, got[page.page_id].n_chars, got[page.page_id].url) == (want, len(want), page.url)


WORDS = "alder birch cedar elm fir hazel larch maple oak pine rowan spruce willow yew".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_wrapper_finds_the_article_where_no_tag_tells_it(spark):
    """Hosts whose pages share a layout of bare divs: links above, the same offer below, paragraphs in between."""
    rnd, pages, want = random.Random(3), [], {}
    for host in range(4):
        for k in range(12):
            i = host * 100 + k
            parts = [prose(rnd, rnd.randint(20, 60)) for _ in range(rnd.randint(1, 6))]
            title = prose(rnd, 5) + f" {i}"
            table = f"<table><tr><td>{prose(rnd, 9)} t{i}</td></tr></table>" if k % 3 == 0 else ""
            top = "".join(f"<div><a href='/{w}'>{w}</a></div>" for w in rnd.sample(WORDS, 4))
            body = "".join(f"<p>{p}</p>" for p in parts)
            pages.append((i, f"http://h{host}.example/{i}", f"<html><body><div class=a>{top}</div><div class=b{i}><h1>{title}</h1>{body}{table}</div><div class=c>Our great offer for all</div><div class=c>&copy; {host}</div></body></html>"))
            want[i] = "\n".join([title, *parts, *re.findall(r"<td>(.*)</td>", table)])
    assert rows(spark, pages) == want


def test_comments_notices_forms_and_scripts_go(spark):
    page = (
        "<!doctype html><html class='no-sidebar'><body class='with-sidebar'><header><h1>Site</h1></header><div id='cookie-notice'>We use cookies</div><div role=navigation>Menu</div><main class='page-content'>"
        "<article class='post has-comments'><h1>Title &amp; more</h1><p>One <b>bold</b>word&nbsp;here<br>and   there.<script>if (a < b) document.write('<p>no</p>')</script></p><!-- <p>hidden</p> -->"
        "<div class='advert'>Buy<div>this</div></div><p>Two &lt;tags&gt; &am &amp;amp; 1 < 2<form><input>Send <button>now</button></form><ul><li>first<li>second</ul>"
        "<section class='comments'><article class='comment'><p>Nice!</p></article></section></article></main><aside>Aside</aside><footer>Foot</footer></body></html>"
    )
    assert rows(spark, [(1, "https://a.example/x", page)]) == {1: "Title & more\nOne boldword here and there.\nTwo <tags> &am &amp; 1 < 2\nfirst\nsecond"}


def test_optional_and_repeated_parts():
    page = lambda body: he.page_stream(f"<article>{body}</article>")[0]
    wrapper = he.unified(page("<h2>a</h2><p>b</p><p>c</p><h2>d</h2><p>e</p>"), page("<h2>f</h2><p>g</p><h2>h</h2><p>i</p><h2>j</h2><p>k</p><hr><table><tr><td>x</td></tr></table>"), True)
    (article,) = wrapper.kids
    assert [(k.label, k.many, k.optional) for k in article.kids] == [("(h2 p)", True, False), ("table", False, True)]
    assert [(k.label, [s.text for s in k.kids]) for k in article.kids[0].kids] == [("h2", [None]), ("p", [None])]
    same = he.unified(page("<p>a</p>"), page("<p>a</p>"), True)
    assert same.kids[0].kids[0].kids[0].text == "a"


def test_edge_cases(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    wide = "".join(f"<h{i % 6 + 1} class={'x' * (i % 300)}>w{i}</h{i % 6 + 1}>" for i in range(2000))
    long = "<article><p>" + "word " * 300_000 + "</p></article>"
    hostile = "<p title='" * 3000 + "end"
    cases = [(1, None, None), (2, None, ""), (3, "no host", "<p></p>"), (4, "http://d.example", deep), (5, "http://w.example", f"<article>{wide}</article>"), (6, "http://l.example", long), (7, None, "just text"), (7, None, "just text"), (None, "http://q.example", "<p>a"), (8, "http://x.example", hostile), (9, "://", "</p></div>x<")]
    got = rows(spark, cases)
    assert (got[1], got[2], got[3], got[4], got[7], got[None]) == ("", "", "", "deep", "just text", "a")
    assert got[5].split("\n") == [f"w{i}" for i in range(2000)] and len(got[6]) == 300_000 * 5 - 1 and got[9] == "x<"
    assert he.extract(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame([(1, "http://a.example", "<p>t</p>", "old", 5)], SCHEMA + ", text string, page_host int")
    assert [r.asDict() for r in he.extract(clash).collect()] == [{"page_id": 1, "url": "http://a.example", "page_host": 5, "text": "t"}]


def test_many_hosts_join_salted(spark, monkeypatch):
    monkeypatch.setattr(he, "BROADCAST", 10)
    pages = [(i, f"http://h{i % 3}.example/", f"<body><nav>m</nav><article><p>text {i}</p></article></body>") for i in range(50)]
    assert rows(spark, pages) == {i: f"text {i}" for i in range(50)}
