"""Names and depth of elements against the main text."""

import pytest

from whence.llm.page_text import inside, lines_of


def text(page):
    lines = lines_of(page)
    return [t for t, p in lines if p == inside(lines)]


@pytest.mark.parametrize(
    "before, after",
    [
        ('<article class="post comments-open">', "</article>"),
        ('<main class="content has-sidebar">', "</main>"),
        ('<article class="post comments">', "</article>"),
        ('<div id="no-sidebar"><article>', "</article></div>"),
        ('<div class="search-result"><article>', "</article></div>"),
        ('<div class="search"><p>lead</p><section class="widget"><article>', "</article></section></div>"),
        ('<div class="sidebar"><div role="main">', "</div></div>"),
        ('<div class="post comments-open">', "</div>"),
    ],
)
def test_names_keep_the_text(before, after):
    assert text(f"<body>{before}<p>One</p><p>Two</p>{after}</body>") == ["One", "Two"]


def test_marked_elements_without_an_article_go():
    page = '<script>1</script><div class="ad big">no</div><article><p>One</p><div class="Comments"><p>no</p></div>Two</article><div id=ads>no</div>'
    assert text(page) == ["One", "Two"]
    assert text('<div class="sidebar"><div><aside><article>no</article></aside></div></div><p>One</p>') == ["One"]


def test_formulas_stay_in_their_line():
    page = "<article><p>As <math><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow></math> holds</p><canvas>a chart</canvas></article>"
    assert text(page) == ["As a=2 holds", "a chart"]


def test_depth_does_not_matter():
    deep = "<div>" * 5000
    assert text(f"<article><p>One</p>{deep}x{'</div>' * 5000}<p>Two</p></article>") == ["One", "x", "Two"]
    assert text(f"<div>{deep}<nav>menu</nav><article>One</article>{'</div>' * 5000}</div>tail") == ["One"]
