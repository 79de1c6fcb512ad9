"""Tag-path ratios: names of page furniture in classes and ids, and a plain version on random pages."""

import random

import pytest

from lapsegrid.llm import html

STORY = "<h1>Title</h1><p>A first paragraph, long enough to be text, with commas, and a stop.</p><p>A second one is here; it is as long as the first, or so.</p>"
TEXT = "Title\nA first paragraph, long enough to be text, with commas, and a stop.\nA second one is here; it is as long as the first, or so."
SIDE = "<ul><li>Latest news, shortly told.</li><li><a href=/>Archive of all</a></li></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f'<article class="post category-social">{STORY}</article>',
        f'<article class="comment" id="sidebar">{STORY}</article>',
        f'<div class="site-content right-sidebar">{STORY}</div>',
        f'<main id="menu">{STORY}</main>',
        f'<div class="commentary">{STORY}</div>',
        f'<div class="sidebar">{STORY}</div>',  # nothing else on the page
        f'<section id="related-work">{STORY}</section>',
        f'<article>{STORY.replace("<h1>", "<h1 class=banner>")}</article>',
        f'<div class="page"><div class="text">{STORY}</div><div class="leftSidebar">{SIDE}</div></div>',
        f'<div class="page"><div class="Comments"><p>I was here, before you all, and I say so at length, as ever.</p></div><div class="text">{STORY}</div></div>',
        f'<div class="page">{STORY}<div class="leftSidebar">{SIDE}</div></div>',
        f'<div class="page">{STORY}<div id="userComments">{SIDE}</div><div class="COOKIE-notice"><p>We use cookies, of course. Please accept them all.</p></div></div>',
    ],
)
def test_article_is_whole_and_furniture_goes(page):
    assert html.main_text(f"<html><body><nav>Home</nav>{page}</body></html>") == TEXT


def test_section_beside_others_keeps_its_text():
    more = "<section id=related-work><h2>Related work</h2><p>Others have done this too, and well, as we say here. See them, please.</p></section>"
    assert html.main_text(f"<body><article><section>{STORY}</section>{more}</article></body>") == TEXT + "\nRelated work\nOthers have done this too, and well, as we say here. See them, please."


@pytest.mark.parametrize("name", ["commentary", "post social-science", "article related-topic", "content notice", "story share-price", "main alert", "essay comment", "comment", "sponsor"])
def test_bulk_of_the_text_wins_against_its_name(name):
    assert html.main_text(f'<body><nav><a href=/>Home</a></nav><div class="{name}">{STORY}</div><div class="ad">Buy!</div><footer>End</footer></body>') == TEXT


def test_linked_paragraphs_and_forms_around_pages_stay():
    linked = STORY + "<p><a href=x>All of this paragraph is a link, and it stays.</a></p><p>The last one, long enough to be text.</p>"
    want = TEXT + "\nAll of this paragraph is a link, and it stays.\nThe last one, long enough to be text."
    for page in (linked, f"<div class=x>{linked}</div>", f"<form action=x><div>{linked}</div></form>", f"<article>{linked}</article>", f"<div class=x>{linked.replace('<p>', '<p id=q>').replace('id=q', 'id=one', 1)}</div>"):
        assert html.main_text(f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul>{page}</body>") == want


def test_deep_paths_are_told_apart():
    deep = "<div>" * 200 + "<div class=content>" + STORY + "</div><div class=sidebar><p>Some long text beside the article, which must go, in any case.</p></div>" + "</div>" * 200
    assert html.main_text(f"<body>{deep}</body>") == TEXT


def random_page(rnd, depth=0):
    tags = ["div", "p", "section", "ul", "li", "h2", "article", "nav", "form", "table", "tr", "td", "a", "span", "header", "aside"]
    names = ["", "", "", ' class="content"', ' class="comment"', ' id="sidebar"', ' class="main alert"', ' class="related-work x"', " hidden"]
    words = ["one", "two, three.", "A sentence, of some length; with marks!", "x", "more &amp; more"]
    out = []
    for _ in range(rnd.randint(1, 4)):
        if depth < 5 and rnd.random() < 0.7:
            tag = rnd.choice(tags)
            out.append(f"<{tag}{rnd.choice(names)}>{random_page(rnd, depth + 1)}" + (f"</{tag}>" if rnd.random() < 0.9 else ""))
        else:
            out.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))))
    return "".join(out)


def test_random_pages_give_blocks_in_order_and_lose_no_single_text():
    rnd = random.Random(12)
    texts = 0
    for _ in range(300):
        page = f"<body>{random_page(rnd)}</body>"
        got, own = html.main_text(page), [b.text for b in html.read_page(page).blocks]
        rest = iter(own)
        assert all(line in rest for line in got.split("\n") if got)
        texts += bool(got)
    assert texts > 200


def test_article_among_unnamed_furniture():
    story = "".join(f"<p>Paragraph number {k} of the story goes on for a while, with commas, and it has more to tell; see <a href=x>this</a>.</p>" for k in range(5))
    comments = "".join(f"<li class=c{k}><div class=author>Bob {k}</div><p>I think that this is a very good story, and I would like to say so, again and again.</p></li>" for k in range(6))
    page = f"""<body><div id=wrap><div id=top><a href=1>Home</a> <a href=2>About</a></div><div id=cols><div class=col1><h1>Title</h1>{story}<h2>Part two</h2><p>Short.</p>
<blockquote>A quote.</blockquote><table><tr><td>1</td><td>2</td></tr></table><div class=share>Share: <a href=x>Tw</a></div><div id=comments><h3>6 Comments</h3><ol>{comments}</ol></div></div>
<div class=col2><h4>Archive</h4><ul><li><a href=1>May</a></li></ul><p>About me: I write.</p></div></div><div id=bottom>Copyright 2020 Foo Inc. All rights reserved.</div></div></body>"""
    got = html.main_text(page).split("\n")
    assert got[0] == "Title" and got[6:] == ["Part two", "Short.", "A quote.", "1", "2"] and len(got) == 11


def test_main_part_by_role():
    linked = "<ul><li><a href=1>First reference of it</a></li><li><a href=2>Second one</a></li></ul>"
    page = f"<body><ul><li><a href=x>One</a></li></ul><div role=main>{STORY}{linked}</div></body>"
    assert html.main_text(page) == TEXT + "\nFirst reference of it\nSecond one"
