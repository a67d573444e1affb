import time

import pytest

from cadenza.llm.html_extract import extract_text


@pytest.mark.parametrize(
    "page,text",
    [
        ('<article style="overflow:hidden"><p>whole text</p></article>', "whole text"),
        ('<div style="overflow: hidden"><p>whole text</p></div>', "whole text"),
        ('<article><p>one <a href="/hidden-valley">link</a> two</p></article>', "one link two"),
        ('<article><p title="The hidden costs">a</p><p data-hidden="false">b</p><p data-role="menu" data-id=ad>c</p></article>', "a\n\nb\n\nc"),
        ("<article><p>a</p><p hidden>no</p><p HIDDEN=''>no</p><p aria-hidden = \"true\">no</p><p title='x'hidden>no</p></article>", "a"),
        ("<article><p class=x class=ad>the text</p><p class=ad class=x>no</p></article>", "the text"),
        # wrappers of the page
        ('<div class="content has-sidebar"><p>The text of the page, all of it.</p></div>', "The text of the page, all of it."),
        ('<header>a very long header, longer than the text</header><div class="layout no-sidebar"><p>The text.</p></div>', "The text."),
        ('<div class="content has-sidebar"><article><p>The post.</p></article><div class="sidebar">links</div></div>', "The post."),
        ('<main><div class="layout no-sidebar"><p>The text of the page.</p></div></main>', "The text of the page."),
        # what still goes
        ("<div class='ad'>buy<p class=ad>this</div><div class='story'><p>One two three, much longer.</p></div>", "One two three, much longer."),
        ("<div><p class=ad>buy<p>One two three, much longer.</div>", "One two three, much longer."),
        ("<article><p>The post itself, with some length.</p><div id=comments><article><p>c</p></article></div></article>", "The post itself, with some length."),
        ("<article><p>post</p></article><section id=comments><p>a very long comment, much longer</p></section>", "post"),
    ],
)
def test_attributes(page, text):
    assert extract_text(page) == text


def test_deep_wrappers():
    start = time.process_time()
    assert extract_text("<div class='has-sidebar'>" * 3000 + "<p>deep</p>" + "</div>" * 3000) == "deep"
    assert time.process_time() - start < 10
