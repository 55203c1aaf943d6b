import pytest

from ledgerloom.llm import html_extraction as he
from tests.llm.support import by_id

TREE = he.train()
ARTICLE = "<article><h1>Title</h1><p>First para.</p><p>Second &amp; last.</p></article>"
TEXT = "Title\n\nFirst para.\n\nSecond & last."


def text(page):
    return he.main_text(page, TREE)[0]


@pytest.mark.parametrize("page", [
    ARTICLE,
    f"<body><nav><ul><li><a href='/'>Home</a></ul></nav>{ARTICLE}<footer>&copy; x. Some long text in a footer here.</footer>",
    f"<header>Site name and slogan</header>{ARTICLE}<aside><p>Other long text that is not of the article at all.</p></aside>",
    f"<div class='sidebar-left'><p>Long text of a sidebar, with many words and no link.</p></div>{ARTICLE}",
    f"<div id=cookie-notice>We use cookies to make this better for everybody.</div>{ARTICLE}",
    f"<div class=ad>Buy this now, it is better than others.</div><!-- <p>no</p> -->{ARTICLE}",
    f"<form><p>Name</p><input><button>Send</button></form>{ARTICLE}<script>var a='<p>x</p>';</script><style>p{{}}</style>",
    f"{ARTICLE}<section id='comments'><article class='comment'><p>I liked this article very much, thank you.</p></article></section>",
    ARTICLE.replace("</article>", "<div class='share'>Share this</div><div class='comments'><p>Me too.</p></div></article>"),
    ARTICLE.replace("<p>First para.</p>", "<p><b>First\n  para.<br><p hidden>not seen</p>"),
    ARTICLE.replace("First", "<em>Fi</em>rst").replace("last.", "l&#97;st."),
    f"<html><head><title>T</title><script>var t=\"</p>\";</script></head><body><main>{ARTICLE}</main>",
    ARTICLE.replace("</article>", "<aside>Read more here</aside><nav>1 2 3</nav></article>"),
])
def test_only_the_article(page):
    assert text(page) == TEXT


def test_pages_without_an_article_element():
    long = "This is a paragraph of some thirty words that tells a story about things which happened long ago in a country that nobody knows any more today."
    page = f"<div><a href=x>One</a> <a href=y>Two</a></div><div><p>{long}</p><p>{long}</p></div><div><a href=z>Next page</a></div>"
    assert text(page) == f"{long}\n\n{long}"


LONG = "It was told for many years that the river once ran on the other side of the hill, where old stones still mark its bed."


@pytest.mark.parametrize("inner", [
    ["<h1>Title here</h1>", f"<p>{LONG}</p>", "<p>Short one.</p>", f"<p>{LONG}</p>"],
    ["<h1>Head</h1>", f"<p>{LONG}</p>", "<ul><li>One thing</li>", "<li>Another</li>", "<li>Third</li></ul>", f"<p>{LONG}</p>"],
    ["<h1>Head</h1>", "<h2>Lower head</h2>", f"<p>{LONG}</p>", "<h2>Next</h2>", "<p>Yes.</p>", "<p>No.</p>", f"<p>{LONG}</p>"],
])
def test_headings_and_short_blocks_of_pages_without_an_article(inner):
    """Everything of the article stays, the menu before it and the links after it go."""
    before = "<div><a href=x>One</a></div><div><a href=y>Two more</a></div>"
    after = "<div><a href=z>Next page</a></div><div>Site of 2020</div>"
    expected = [he.blocks(x)[0].text for x in inner]
    assert text(f"{before}<div>{''.join(inner)}</div>{after}") == "\n\n".join(expected)


def test_subjects_in_names_of_an_articles_parts():
    part = f"<section class='related-work'><h2>Related work</h2><p>{LONG}</p></section>"
    assert text(f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>").count(LONG) == 3
    links = "<div class='related-posts'><a href=x>Other text</a><p><a href=y>One more here</a></p></div>"
    assert text(f"<article><p>{LONG}</p>{links}</article>") == LONG
    for name in ("comment-body", "ad-slot", "share", "related", "newsletter-box"):
        assert text(f"<article><p>{LONG}</p><div class='{name}'><p>Buy this.</p></div></article>") == LONG


def test_neighbours_decide():
    """Without the neighbours' columns the tree cannot tell the labelled blocks, with them it tells all."""
    right = lambda rows: sum(he.train(rows).decide(r[:-1]) == r[-1] for r in rows) / len(rows)
    rows = [r for r in he.table() if r[0] in (1, 2)]
    blind = [tuple(0 if i in he.NEIGHBOURS else v for i, v in enumerate(r)) for r in rows]
    assert right(he.table()) == right(rows) == 1.0 and right(blind) < 0.9
    # One short block, beside prose and among links.
    assert TREE.decide((2, 3, 0.0, 40, 0.0, 45, 0.0)) == 1 and TREE.decide((2, 3, 0.0, 2, 1.0, 2, 1.0)) == 0


@pytest.mark.parametrize("page", ["", "<", "<p", "</p></div>", "<!-- open", "<script>open", "<a href='x", "&#0;&bad;", "<article>", "<p>" * 20_000, "<div><b>" * 5_000 + "x"])
def test_broken_pages_do_not_fail(page):
    text(page)


def test_table(spark):
    rows = [(1, "u", ARTICLE), (2, None, None), (3, "v", ""), (1, "u", ARTICLE), (4, "w", "<article>" + "<p>word word</p>" * 30_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "1 AS n_chars")
    got = he.extract(pages)
    assert got.where("page_id = 1").count() == 2
    found = by_id(got.dropDuplicates(["page_id"]), "page_id")
    assert found[1]["text"] == TEXT and found[1]["n_chars"] == len(TEXT) and found[2]["text"] == "" and found[3]["n_chars"] == 0
    assert found[4]["text"].count("word word") == 30_000
    assert he.extract(pages.where("false")).count() == 0
