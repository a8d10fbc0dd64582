"""HTML extraction: broken pages, names of classes, and densities against
plain recursion."""

import math
import time

import pytest

from vitalspan.llm import html_text

LONG = "Words of the article that go on for a while and say something new each time. " * 4


@pytest.mark.parametrize("piece", ["<a ", "<b>", "<div></x>", "<p><td><div>", "<li><div>", "<!--", "<a \"", "</p>", "<option>", "<div class='ad'>x"])
def test_broken_pages_are_read_in_linear_time(piece):
    took = []
    for size in (100_000, 1_000_000):
        page = "<p>Start.</p>" + piece * (size // len(piece))
        start = time.process_time()
        text = html_text.main_text(page)
        took.append(time.process_time() - start)
        assert text.startswith("Start.") or piece.startswith("<div class")
    assert took[1] < 40 * max(took[0], 0.05)


def test_reader_comments_are_never_the_article():
    thread = "".join(f"<div class='comment'><p>{LONG} comment {i}</p></div>" for i in range(6))
    page = f"<body><div class='post'><p>{LONG} one</p><p>{LONG} two</p></div><div class='comments'>{thread}</div></body>"
    text = html_text.main_text(page)
    assert text.count("Words") == 8 and "comment" not in text


def test_a_page_inside_a_layout_class_is_kept():
    page = f"<body><div class='no-sidebar'><p>{LONG} one</p><p>{LONG} two</p></div><div class='sidebar'><p>short</p></div></body>"
    text = html_text.main_text(page)
    assert "one" in text and "two" in text and "short" not in text


def test_hint_words_in_longer_names_do_not_remove_article_text():
    kept = ["<h2 id='comment-on-law'>Law</h2>", "<div class='social-history'>History</div>", "<p class='search-theory'>Theory</p>", "<p class='notices-of-1848'>Eighteen</p>"]
    gone = ["<div class='related-posts'>Other</div>", "<div class='ad-slot-3'>Buy</div>", "<div class='share-buttons'>Send</div>", "<div id='comments'>Said</div>", "<p class='alert alert-info'>Attention</p>"]
    text = html_text.main_text(f"<article><p>{LONG}</p>{''.join(kept)}{''.join(gone)}<p>{LONG}</p></article>")
    assert all(w in text for w in ("Law", "History", "Theory", "Eighteen")) and not any(w in text for w in ("Other", "Buy", "Send", "Said", "Attention"))


def plain(node):
    """Characters, link characters, tags and link tags below a node."""
    chars = sum(len(" ".join(p.split())) for p in node.pieces if isinstance(p, str))
    links = tags = link_tags = 0
    for c in node.children:
        a, b, t, u = plain(c)
        chars, links, tags, link_tags = chars + a, links + (a if c.tag == "a" else b), tags + t + 1, link_tags + u + (c.tag == "a")
    return chars, (chars if node.tag == "a" else links), tags, link_tags


def test_densities_equal_plain_recursion():
    page = f"""<body><div><a href=x>Home page</a> <a href=y>News</a></div><div><h1>Title</h1><p>{LONG}</p><p>{LONG} <a href=z>more <b>here</b></a></p><ul><li><a>one</a><li>two</ul></div>
      <div><p>short</p></div></body>"""
    root = html_text.parse(page)
    nodes = html_text._measure(root)
    whole_chars, whole_links, _, _ = plain(root)
    for n in nodes:
        chars, links, tags, link_tags = plain(n)
        assert (n.chars, n.links, n.tags, n.link_tags) == (chars, links, tags, link_tags)
        want = 0.0
        if chars:
            link, tag, link_tag = max(links, 1), max(tags, 1), max(link_tags, 1)
            base = math.log(chars / max(chars - links, 1) * link + whole_links / max(whole_chars, 1) * chars + math.e)
            want = chars / tag * max(math.log(chars / link * tag / link_tag), 0) / max(math.log(base), 1e-3)
        assert n.density == pytest.approx(want) and n.total == pytest.approx(sum(c.density for c in n.children))
    assert max(nodes, key=lambda n: n.total).children[0].tag == "h1"
    assert html_text.main_text(page).startswith("Title Words")
