import pytest

from tidetrace.llm.html_text import extract_main_text, main_text, parse

PAGES = "page_id long, url string, html string"


def texts(spark, pages, **settings):
    return {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, PAGES), **settings).collect()}


def test_running_text_on_most_pages_of_a_host_leaves_the_article(spark):
    notice, quote = "<p>Get our newsletter</p>", "<blockquote>To be</blockquote>"
    pages = [(i, f"http://a.com/{i}", f"<body><article><h2>Story</h2>{quote if i < 6 else ''}<p>text {i}</p>{notice}"
              f"<table><tr><td>Price<td>{i}</table></article>") for i in range(14)]
    # One article beside eight adverts is one different article; its text stays.
    pages += [(20 + i, f"http://b.com/{i}", f"<div class='ad'>advert {i}</div><article><p>copied</p><div class='ad'>{i}</div>"
               "</article>") for i in range(8)]
    pages += [(30 + i, f"http://b.com/o{i}", f"<article><p>other {i}</p></article>") for i in range(3)]
    got = texts(spark, pages)
    assert got[3] == "Story To be text 3 Price 3" and got[9] == "Story text 9 Price 9"
    assert got[20] == "copied" and got[31] == "other 1"


@pytest.mark.parametrize("settings", [{}, {"broadcast_marks": 0}])  # marks broadcast, and joined by page
def test_section_templates_of_a_large_host(spark, settings):
    pages = [(i, f"http://a.com/{i % 20}/{i}", f"<body><div><ul><li>All of section {i % 20}</ul></div><p>Notice {i % 30}</p>"
              f"<p>text {i}</p>") for i in range(300)]
    pages += [(400 + i, f"http://b.com/{i}", f"<body><p>Notice 1</p><p>text {i}</p>") for i in range(4)]
    got = texts(spark, pages, **settings)
    assert all(got[i] == f"text {i}" for i in range(300)) and got[400] == "Notice 1 text 0"


def test_slugs_in_an_article_are_no_names():
    def text(h):
        return main_text(parse(h), set())

    page = ('<div class="sidebar-layout"><article><h2 id="related-work">Related</h2><section id="search-algorithms"><p>A*</section>'
            '<div class="section" id="social-impact">wide</div><p id="reply-to-critics">no</p><div class="comment-list">x</div>'
            '<div class="share-buttons">x</div><div id="sidebar">x</div><h2 class="notice">end</h2></article></div>')
    assert text(page) == "Related A* wide no end"
    assert text('<main><div id="social-impact">wide</div><div class="sidebar-left">x</div><p>in</main>') == "wide in"
    assert text('<div id="cookie-banner">x</div><p>plain</p>') == "plain"


def test_comment_articles_are_no_articles():
    def text(h):
        return main_text(parse(h), set())

    comments = '<section id="comments"><article class="comment"><p>first!</p></article></section>'
    assert text(f"<article><p>story</p>{comments}</article>") == text(f"<article><p>story</p></article>{comments}") == "story"
    assert text(f"<p>story</p>{comments}") == "story"
    assert text('<article><p>story</p><article class="related-article">x</article></article>') == "story"
    assert text('<article><p>story</p><section class="comments"><article><p>x</p></article></section></article>') == "story"
    assert text('<div class="widget"><article class="post comment-count-3"><p>story</p></article></div>') == "story"


STORY = "<p>The story goes on.</p>"


@pytest.mark.parametrize("page", [
    f"<article><svg-icon></svg-icon>{STORY}</article>",
    f"<article><svg class='i'/>{STORY}</article>",
    f"<article><svg class='i'><path d='M0'/></svg>{STORY}</article>",
    f"<body><div id='content' class='content with-sidebar'>{STORY}</div></body>",
    f"<main><div class='with-sidebar'>{STORY}</div></main>",
    f"<body><div class='content-sidebar-wrap'>{STORY}</div></body>",
    f"<body><div id='social-history'>{STORY}</div></body>",
    f"<body><form id='aspnetForm'><div class='nav-bar'>Home</div><article>{STORY}</article></form></body>",
    f"<article>{STORY}<p hidden title=\"x>gone</article>",
    f"<body><div class='site-footer'>f</div><div class='ad-slot'>a</div><div id='related-1'>r</div><div>{STORY}</div></body>",
    f"<article>{STORY}<form><input><p>Sign up</p></form><svg><title>t</title></svg></article>"])
def test_pages_whose_story_must_stay(page):
    assert main_text(parse(page), set()) == "The story goes on."


def test_recurrence_decides_where_no_element_names_the_article(spark):
    frame = ("<body><div><a href=/>Home</a> <a href=/a>About</a></div><div class='x1'><p>Weather: sunny</p><ul><li>Top story"
             "<li>Most read</ul></div><div class='c'><h1>Title {0}</h1><p>Body of {0}.</p></div><div class='z'>All rights reserved"
             "</div></body>")
    pages = [(i, f"http://a.com/{i}", frame.format(i)) for i in range(12)]
    got = texts(spark, pages)
    assert all(got[i] == f"Title {i} Body of {i}." for i in range(12))
