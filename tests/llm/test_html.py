import random
import time

import pytest
from pyspark.sql import functions as F

from tracelake.llm import html

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b &amp; c&nbsp;d", "a\n\nb & c d"), ("<article><h1>T</h1><p>x <b>y</b><br>z</article>after", "T\n\nx y z"),
        ("<nav><a>m</a></nav><main><p>x</p></main><footer>f</footer>", "x"), ("<div class='ad big'>buy</div><div id=content><p>x</div>", "x"), ("<script>var a='</p><p>no'</script><p>x<style>p{}</style>", "x"),
        ("<!-- <p>no</p> --><p>x<!-- unclosed", "x"), ("<article><p>x</p><section class='comments'><p>no</p></section><aside>no</aside><form><input></form></article>", "x"),
        ("<article class=comment><p>a very long comment that goes on</p></article><article><p>x</p></article>", "x"), ("<p>1 < 2 and <a title='a > b'>link</a>", "1 < 2 and link"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb\n\n1 2\n\n3"), ("<p hidden>no</p><p style='display: none'>no</p><p>x", "x"), ("<title>no</title><header>no</header><p>x", "x"), ("<article><header><h1>T</h1></header><p>x</p></article>", "T\n\nx"),
        ("<p>&copy; &#233;&#x41; &unknown;</p>", "© éA &unknown;"), ("<div><p>x</div></span></p>y", "x\n\ny"), ("<textarea><p>no</textarea><p>x", "x"), ("<p>a\n\t b</p>", "a b"), ("<" * 50 + "p", "<" * 50 + "p"),
        ("<article><p>let <math><mi>x</mi>=<mn>2</mn></math> <label>be</label> so</p></article>", "let x=2 be so"),
        ("<article><section class=related-work><p>a</section><section class=discussion><p>b</section><div class=side-effects><p>c</div><div class='share-box'>no</div><div id=relatedLinks>no</div></article>", "a\n\nb\n\nc"),
        ("<div><ul><li><a href=/a>a</a><li><a href=/b>b</a><li><a href=/c>c</a></ul></div><p>x <a>y</a> <a>z</a> <a>q</a></p>", "x y z q"),
        ("<article><ul><li><a href=/a>a</a><li><a href=/b>b</a><li><a href=/c>c</a></ul></article>", "a\n\nb\n\nc"),
        ("<xmp>a <b> &amp; c</xmp>", "a <b> &amp; c"), ("<p title='x>y'>a", "a"), ("<p title=\"x>y'>a", "y'>a"), ("<svg><text>label</text></svg>", "label"),
    ],
)
def test_main_text(page, text):
    assert html.extract(page) == text


def test_deep_and_broken_pages():
    assert html.extract("<div>" * 20_000 + "x") == "x"
    assert html.extract('<a "' * 5_000 + "<p>x</p>").endswith("x")
    assert html.extract("<!--" * 20_000) == ""


@pytest.mark.parametrize("unit", ["<a ", "<a \"", "<a \">\"", "<a x=\"", "<p x=\"'>", "<div></x>", "<main>", "<ul><b><li></li>", "<b><div></div>", "<!--", "<"])
def test_time_follows_length(unit):
    def seconds(n):
        start = time.process_time()
        html.extract(unit * n + ">")
        return time.process_time() - start

    n = 200_000 // len(unit)
    assert seconds(4 * n) < 12 * max(seconds(n), 0.05)


def test_templates_by_brute_force(spark):
    """Blocks at every frequency, in and out of articles; the rule is applied to the sets of pages that hold each block."""
    rng, rows, want = random.Random(6), [], {}
    for host, pages in (("a", 40), ("b", 7), ("c", 120)):
        blocks = {(kind, k): rng.choice([0.02, 0.04, 0.1, 0.3, 0.6, 0.85, 0.95, 1.0]) for kind in "OIT" for k in range(8)}
        has = [{b for b, share in blocks.items() if rng.random() < share} for _ in range(pages)]
        count = {b: sum(b in h for h in has) for b in blocks}
        least = {"O": max(5, 0.05 * pages), "I": max(10, 0.5 * pages), "T": max(20, 0.9 * pages)}
        for i, h in enumerate(has):
            some = sorted(b for b in h)
            show = lambda b: f"<div>{b[0]} {b[1]}</div>" if b[0] != "T" else f"<p>{b[0]} {b[1]}</p>"
            page = f"<article><p>own text {host} {i}</p>{''.join(show(b) for b in some if b[0] != 'O')}</article>{''.join(show(b) for b in some if b[0] == 'O')}"
            rows.append((len(rows), f"http://{host}/{i}", page))
            want[len(rows) - 1] = "\n\n".join([f"own text {host} {i}", *(f"{b[0]} {b[1]}" for b in some if b[0] != "O" and count[b] < least[b[0]])])
    got = texts(spark, rows)
    assert got == want
    plain_body = [(i, f"http://d/{i}", f"<body><div>own {i}</div>{'<div>menu</div>' if i < 5 else ''}{'<div>seldom</div>' if i < 4 else ''}</body>") for i in range(90)]
    assert texts(spark, plain_body)[0] == "own 0\n\nseldom"


def site(n, extra=""):
    menu = "<div class=k1><p>About us and our many friends</p></div>"
    return [(i, f"http://h.com/{i}", f"<body>{menu}<div class=k2><p>Story number {i} is told here.</p>{extra}</div><div class=k3>Written at the foot of every page</div></body>") for i in range(n)]


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, PAGES)).collect()}


def test_templates_of_a_site_go(spark):
    got = texts(spark, site(12) + [(99, "http://other.com/", site(1)[0][2])])
    assert got[3] == "Story number 3 is told here." and "About us" in got[99]


def test_few_pages_have_no_template(spark):
    assert "About us" in texts(spark, site(4))[0]


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><div><p>One story, printed at many addresses.</p></div></body>"
    got = texts(spark, [(i, f"http://h.com/{i}", page) for i in range(30)])
    assert set(got.values()) == {"One story, printed at many addresses."}


def test_article_text_stays_though_it_recurs(spark):
    shared = lambda i: "<p>A passage that very many pages share.</p>" if i % 5 else ""
    rows = [(i, f"http://h.com/{i}", f"<article><p>Story {i}.</p>{shared(i)}<p>Subscribe today!</p><div class=tail><span>Read more from this site</span></div></article>") for i in range(40)]
    assert texts(spark, rows)[7] == "Story 7.\n\nA passage that very many pages share."


def test_a_template_may_leave_nothing(spark):
    rows = [*site(12), (50, "http://h.com/", "<body><div class=k3>Written at the foot of every page</div></body>")]
    assert texts(spark, rows)[50] == ""


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None), (1, None, None), (None, "http://h.com/", "<p>x"), (2, "no url", ""), (3, "http://h.com/", "<p>" + "y " * 50_000)]
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("clash")).withColumn("page", F.lit(1))
    got = sorted((r["page_id"] or -1, r["text"][:3]) for r in html.main_texts(df).collect())
    assert got == [(-1, "x"), (1, ""), (1, ""), (2, ""), (3, "y y")]
    assert html.main_texts(spark.createDataFrame([], PAGES)).count() == 0
    df.write.parquet(str(tmp_path / "pages.parquet"))
    assert {(r["page_id"], r["n_chars"]) for r in html.op6_main_text(spark, str(tmp_path)).collect()} == {(None, 1), (1, 0), (2, 0), (3, 99_999)}
