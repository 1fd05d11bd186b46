"""Expected texts of usual page layouts, and pages that nest deeply."""

import time

import pytest

from kinfold.llm.html_text import main_text

LONG = " ".join(["A paragraph of an article has plain words and hardly any links in it, and goes on for a while."] * 3)
PARAGRAPHS = [f"{i} {LONG}" for i in range(6)]
ARTICLE = "<h1>A headline</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANTED = "\n".join(["A headline", *PARAGRAPHS])
APART = (
    '<div class="sidebar"><p>About the authors of this site.</p></div>'
    f'<div id="comments"><p>{LONG}</p><p>{LONG}</p></div><footer>All rights reserved</footer>'
)


@pytest.mark.parametrize(
    "names",
    [
        "has-sidebar", "no-sidebar", "with-sidebar", "search-results", "widget Blog", "page-with-comments", "nav-open",
        "post related", "comments-closed", "social-post", "tabs", "notice", "banner story", "menu-enabled", "modal",
    ],
)
def test_a_wrapper_named_after_its_layout_keeps_its_article(names):
    for around in ("{}", "<div>{}</div>", "<main>{}</main>"):
        page = around.format(f'<div class="{names}">{ARTICLE}</div>')
        assert main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}{APART}</body></html>") == WANTED


def test_wrappers_inside_each_other_and_parts_of_one_name():
    nested = f'<div class="widget"><div class="tabs"><div class="related post">{ARTICLE}</div></div></div>'
    assert main_text(f"<body>{nested}{APART}</body>") == WANTED
    parts = "".join(f'<div class="builder-widget text"><p>{p}</p></div>' for p in PARAGRAPHS)
    assert main_text(f"<body><div>{parts}</div>{APART}</body>") == "\n".join(PARAGRAPHS)


def test_suspected_elements_beside_an_article_go():
    for name in ("sidebar", "related", "widget", "comments", "newsletter-box", "promo", "search"):
        beside = f'<div class="{name}"><p>{LONG}</p></div>'
        for page in (f"<div>{ARTICLE}</div>{beside}", f"<div>{ARTICLE}{beside}</div>", f"<article>{ARTICLE}{beside}</article>"):
            assert main_text(f"<body>{page}</body>") == WANTED
    # However much there is beside an article element; comments are none, whatever they outweigh.
    much = "".join(f"<p>{LONG}</p>" for _ in range(40))
    for name in ("sidebar", "related"):
        assert main_text(f'<body><article>{ARTICLE}</article><div class="{name}">{much}</div></body>') == WANTED
    assert main_text(f'<body><div>{ARTICLE}</div><div class="comments">{much}</div></body>') == WANTED
    assert main_text(f'<body><div class="comments">{much}</div></body>') == ""


def test_suspected_pieces_inside_a_block():
    page = f'<body><div>{ARTICLE}<p>One <span class="share">share it</span>two<br>three</p></div></body>'
    assert main_text(page) == WANTED + "\nOne two three"


@pytest.mark.parametrize("tag", ["<div>", '<div class="widget">', "<li>", "<p><span>", "<ul><li>", "<b>", "</x><i>"])
def test_deep_pages_take_time_by_their_length(tag):
    took = time.process_time()
    assert main_text("<body>" + tag * 100_000 + f"<p>{LONG}</p>") == LONG
    assert time.process_time() - took < 60


def test_many_parts_below_the_body():
    page = "<body>" + f"<div><p>{LONG}</p></div>" * 5_000 + "</body>"
    assert main_text(page).count("\n") == 4_999
