import collections

import pytest
from pyspark.sql import functions as F

from factloom.llm import htmlmain, queries, quotes

SF = "/root/testdata/sf0.001"

SHELL = "<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class='ad-box'>Buy</div><article><h1>{0}</h1><p>Share this page</p><p>{1}<br>more &amp; more</p><div id=comments><p>first!</p></div></article><footer>f</footer></body></html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_slots_go(spark):
    rows = [(k, f"http://a.org/{k}", SHELL.format(f"Title {k}", f"Body   {k}\n x")) for k in range(9)]
    got = {r.page_id: r.text for r in htmlmain.extract_main_text(pages(spark, rows)).collect()}
    assert got == {k: f"Title {k}\n\nBody {k} x more & more" for k in range(9)}


def test_few_pages_have_no_template(spark):
    got = htmlmain.extract_main_text(pages(spark, [(1, "http://b.org/", SHELL.format("T", "B"))])).first()
    assert got.text == "T\n\nShare this page\n\nB more & more"
    assert got.n_chars == len(got.text)


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "x", ""), (3, "//h", "plain < text &copy;"), (4, "http://h/", "<p>a<b>b<p>c</i></p>d"), (5, "http://h/", "<script>x</script"), (6, "http://h/", "<div>a<!-- c"), (7, "http://h/", "<p>cut</p><a href='"),
        (None, "http://h/", "<ul><li>1<li>2</ul>"), (8, "http://h/", "<p a=\">\">q</p>"), (8, "http://h/", "<p a=\">\">q</p>"), (9, "http://h/", "<style>p{}</style>x<aside>y</aside><div hidden>z</div>"),
    ]
    got = sorted(((r.page_id, r.text) for r in htmlmain.extract_main_text(pages(spark, rows)).collect()), key=str)
    want = [(1, ""), (2, ""), (3, "plain < text ©"), (4, "ab\n\nc\n\nd"), (5, ""), (6, "a"), (7, "cut"), (None, "1\n\n2"), (8, "q"), (8, "q"), (9, "x")]
    assert got == sorted(want, key=str)
    assert htmlmain.extract_main_text(pages(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><article><p>Teaser</p></article><div><p>The story is long</p><p>and goes on.</p></div></body>", "Teaser\n\nThe story is long\n\nand goes on."),
        ("<body><form id=page><nav>menu</nav><article><p>Text</p></article><input></form></body>", "Text"),
        ("<body><form id=page><div><p>Paragraphs without an article</p></div></form></body>", "Paragraphs without an article"),
        ("<p>Text of the page</p><form><p>Reply</p></form>", "Text of the page"),
        ("<article><p>A</p><div class='legal'><p>B</p></div></article><div class='legal'>C</div>", "A\n\nB"),
        ("<div data-role=\"main\"><p>A</p></div><p title='role=main'>B</p>", "A\n\nB"),
        ("<p>B</p><div ROLE = 'Main'><p>A long text</p></div>", "A long text"),
    ],
)
def test_marks_that_hold_the_text(page, text):
    assert htmlmain.main_text(page) == text


PLAIN = "<body><div><div><a>Menu {0}</a></div><div><a>More</a></div></div><div>Buy {0}</div><div><h1>Title {0}</h1>{1}</div><div>&copy; {0}</div></body>"


def test_pages_without_marks(spark):
    body = lambda k: "".join(f"<p>Page {k} says {'much ' * 20}in part {i} of {k}.</p>" for i in range(2 + k % 3))
    rows = [(k, "http://a.org/", PLAIN.format(k, body(k))) for k in range(4)] + [(9, "http://b.org/", PLAIN.format(9, body(9)))]
    got = {r.page_id: r.text.split("\n\n") for r in htmlmain.extract_main_text(pages(spark, rows)).collect()}
    for k in range(4):
        assert got[k][0] == f"Title {k}" and len(got[k]) == 3 + k % 3
    assert got[9][:3] == ["Menu 9", "More", "Buy 9"]  # one page of a host shows nothing


def test_near_copies_are_no_template(spark):
    body = "".join(f"<p>Sentence {i} that all copies have.</p>" for i in range(20))
    rows = [(k, "http://a.org/", f"<article>{body}<p>Copy {k}</p></article>") for k in range(7)]
    wide = pages(spark, rows).withColumns({"pivot": F.lit(1), "host": F.lit("x"), "slots": F.lit(2), "node": F.lit(3), "text": F.lit("t")})
    got = htmlmain.extract_main_text(wide)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert all(r.text.count("\n\n") == 20 and r.text.endswith(f"Copy {r.page_id}") for r in got.collect())


def test_given_pages_without_marks_keep_their_texts(spark):
    """The given pages with every element and class plain: the wrapper finds what the marks said, wherever a host has four pages."""
    given = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").select("page_id", "url", "html")
    bare = F.regexp_replace("html", r"""(<[a-z0-9]+[^>]*?) (?:class|id|role)=(?:"[^"]*"|[^\s>]+)""", "$1")
    bare = F.regexp_replace(bare, r"<(/?)(?:nav|ul|li|article|footer|aside|header|section|main|h[2-6]|form)\b[^>]*>", "<$1div>")
    texts = [{r.page_id: r for r in htmlmain.extract_main_text(p).collect()} for p in (given, given.withColumn("html", bare))]
    of = collections.Counter(h.host for h in given.select(htmlmain.host(F.col("url")).alias("host")).collect())
    large = [r.page_id for r in given.select("page_id", htmlmain.host(F.col("url")).alias("host")).collect() if of[r.host] >= 4]
    assert len(large) > 100 and all(texts[0][k].text == texts[1][k].text for k in large)


def test_simple_tree_matching():
    a, _, _ = htmlmain.parse("<div><p>1</p><ul><li>2</ul><p>3</p></div>")
    b, _, _ = htmlmain.parse("<div><p>1</p><p>3</p><p>4</p></div>")
    assert htmlmain.align(a, b)[0] == 4  # root, div and two p
    assert htmlmain.align(a, b, most_cells=0)[0] == 4


def test_whole_table_keeps_articles_only(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op4_main_text(spark, SF).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.text and r.n_chars == len(r.text)
        assert "<" not in r.text and "©" not in r.text


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there.\n\nHow do you   do?"), (1, 1, "a", "On Monday u wrote:\n> Hello there.\n>\n> How do you do?\nFine."), (1, 2, "u", "New topic"), (1, 3, "a", ">> how do YOU do?\n> Fine.\nGood!"), (1, 4, "x", None),
        (2, 0, "u", "> nope\nx"), (None, None, None, "> x"), (1, 4, "x", None),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.position): (r.turn, r.parent_turn, r.branch, r.text, r.n_quotes, r.n_linked) for r in quotes.reply_ordered(m, block=2).collect()}
    assert got == {
        (1, 0): (0, None, 0, "Hello there.\n\nHow do you   do?", 0, 0), (1, 1): (1, 0, 0, "Fine.", 1, 1), (1, 2): (3, 1, 0, "Good!", 2, 2), (1, 3): (2, None, 2, "New topic", 0, 0),
        (1, 4): (4, None, 4, "", 0, 0), (1, 5): (4, None, 4, "", 0, 0), (2, 0): (0, None, 0, "x", 1, 0), (None, 0): (None, None, None, "", 1, 0),
    }
    assert quotes.reply_ordered(m.limit(0)).count() == 0


def test_a_long_chain_of_replies(spark):
    rows = [(1, k, "u", (f"> message {k - 1}\n" if k else "") + f"message {k}") for k in range(50)]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("position").collect()
    assert [(r.turn, r.branch, r.text) for r in got] == [(k, 0, f"message {k}") for k in range(50)]


def test_whole_conversations(spark):
    n = spark.read.parquet(f"{SF}/conversations.parquet").count()
    got = queries.op6_quotation_linking(spark, SF).collect()
    assert len(got) == n
    assert len({(r.conv_id, r.position) for r in got}) == n


def test_long_and_deep_pages_align_exactly():
    items = "".join(f"<p>{k}</p>" for k in range(150))
    heads = "".join(f"<h2>{k}</h2><p>{k}</p>" for k in range(80))
    a, _, _ = htmlmain.parse(f"<div>{items}<section><p>t</p></section>{heads}<section><ul><li>x</ul></section></div>")
    b, _, _ = htmlmain.parse(f"<div>{items}<section><ul><li>ad</ul></section><section><p>t</p></section>{heads}<section><ul><li>x</ul></section></div>")
    exact = htmlmain.align(a, b, most_cells=10**9)
    found = htmlmain.align(a, b)
    assert found[0] == exact[0] == len(found[1]) == 2 + 150 + 2 + 160 + 3
    deep, texts, _ = htmlmain.parse("<font>" * 5000 + "x")
    assert htmlmain.align(deep, htmlmain.parse("<font>" * 4000 + "x")[0])[0] == 4001


def test_names_that_only_mention_other_parts():
    for name in ("content has-sidebar", "no-sidebar", "layoutWithSidebar", "ad-free", "single-post comments-closed", "legal-news"):
        assert htmlmain.main_text(f'<div class="{name}"><p>text</p></div>') == "text"
        assert htmlmain.main_text(f'<article><div class="{name}"><p>text</p></div></article>') == "text"
    for name in ("ad", "ad-box", "mainNav", "col sidebar-left", "post-comments", "footer-links", "related-posts"):
        assert htmlmain.main_text(f'<div class="{name}"><p>x</p></div><p>text</p>') == "text"
    assert htmlmain.main_text("<div class=widget><article><p>text</p><div class=ad>x</div></article></div><div class=sidebar>y</div>") == "text"
    assert htmlmain.main_text("<div class=sidebar><article>x</article></div><main><p>text</p></main>") == "text"
