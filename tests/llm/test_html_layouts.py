"""Main text against an independent parser, on pages whose article is known: recall and precision by layout."""

import random
from collections import Counter
from html.parser import HTMLParser

import pytest

from lapsegrid.llm import html

SKIP = {"script", "style"}
INLINE = {"a", "b", "em", "span", "i", "strong", "small", "time"}


class Blocks(HTMLParser):
    """All text of a page outside scripts, by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.piece, self.skip = [], [], 0

    def cut(self):
        if text := " ".join("".join(self.piece).split()):
            self.blocks.append(text)
        self.piece = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIP
        if tag == "br":
            self.piece.append(" ")
        elif tag not in INLINE:
            self.cut()

    def handle_endtag(self, tag):
        self.skip -= tag in SKIP
        if tag not in INLINE:
            self.cut()

    def handle_data(self, data):
        if not self.skip:
            self.piece.append(data)


def blocks_of(page):
    own = Blocks()
    own.feed(page)
    own.close()
    own.cut()
    return own.blocks


COMMENTS = "".join(f"<div><b class=who>Reader {k}</b><p>I think that this is a very good story, and I would like to say so, again and again, at some length.</p></div>" for k in range(12))
SHORT = "<h1>Title</h1><p>A short article, just this one line.</p>"
LIST = "".join(f"<li><a href=r{k}>Reference number {k} of them</a></li>" for k in range(4))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article>{SHORT}</article><section class=comments>{COMMENTS}</section>", ["Title", "A short article, just this one line."]),
        (f"<div class=post>{SHORT}</div><section id=comments>{COMMENTS}</section>", ["Title", "A short article, just this one line."]),
        (f"<div class=post>{SHORT}</div><section id=voices>{COMMENTS}</section>", ["Title", "A short article, just this one line."]),
        (f"<div class=post>{SHORT}</div><aside>" + "<p>Something long beside it, which goes on and on, with commas.</p>" * 9 + "</aside>", ["Title", "A short article, just this one line."]),
        ("<article>" + "".join(f"<div id=d{k}><p>{t}</p></div>" for k, t in enumerate(["A long one, with many words in it, and commas, and more of them."] * 4 + ["Brief one."])) + "</article>",
         ["A long one, with many words in it, and commas, and more of them."] * 4 + ["Brief one."]),
        ("<article><section><h2>Head 1</h2><p>A long section, with many words in it, and with commas, and it goes on, and on, to the end.</p></section><section><h2>Head 2</h2><p>Brief.</p></section></article>",
         ["Head 1", "A long section, with many words in it, and with commas, and it goes on, and on, to the end.", "Head 2", "Brief."]),
        (f"<article>{SHORT}<div class=footnotes><ol><li>Note one.</li><li>Note two.</li></ol></div><h2>References</h2><ul>{LIST}</ul></article>",
         ["Title", "A short article, just this one line.", "Note one.", "Note two.", "References", *(f"Reference number {k} of them" for k in range(4))]),
        (f"<article>{SHORT}</article><div id=discussion>{COMMENTS}</div>", ["Title", "A short article, just this one line."]),
        ("<header><h1>Title</h1></header><div class=content><p>The text of it, with a comma.</p><p>And more of it, as long.</p></div>", ["Title", "The text of it, with a comma.", "And more of it, as long."]),
        ("<header><h1><a href=/>Site</a></h1><p>Slogan, here.</p></header><article><p>The text of it, with a comma.</p></article>", ["The text of it, with a comma."]),
        (f"<main><article>{SHORT}</article><div>{COMMENTS}</div></main>", ["Title", "A short article, just this one line."]),
        ("<article class=card><h2>Other</h2><p>Teaser.</p></article>" * 4 + f"<article class=full>{SHORT}<p>It has more to tell, in a second paragraph.</p></article>",
         ["Title", "A short article, just this one line.", "It has more to tell, in a second paragraph."]),
        (f"<div class=thread>{COMMENTS}</div>", blocks_of(COMMENTS)),  # nothing else on the page
    ],
)
def test_the_article_is_never_lost(page, want):
    assert html.main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}<footer>End of it.</footer></body></html>").split("\n") == want


WORDS = "time house river light paper stone morning window garden letter winter music bridge market silver story number field island engine".split()


def sentence(rnd, least=5, most=18):
    words = [rnd.choice(WORDS) for _ in range(rnd.randint(least, most))]
    return (", ".join([" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])])).capitalize() + rnd.choice(".?!")


def article(rnd):
    """(html, texts) of an article: paragraphs, short ones, lists, headings, a quote, a table, notes, references."""
    out, texts = [], []

    def add(tag, text, inner=None):
        out.append(f"<{tag}>{inner or text}</{tag}>")
        texts.append(text)

    add("h1", sentence(rnd, 3, 6)[:-1])
    for _ in range(rnd.randint(2, 7)):
        kind = rnd.random()
        if kind < 0.6:
            text = " ".join(sentence(rnd) for _ in range(rnd.randint(1, 5)))
            add("p", text, text.replace("river", "<a href=x>river</a>").replace("stone", "<b>stone</b>"))
        elif kind < 0.7:
            add("p", sentence(rnd, 1, 3))
        elif kind < 0.8:
            add("h2", sentence(rnd, 2, 4)[:-1])
            add("p", sentence(rnd))
        elif kind < 0.9:
            out.append("<ul>")
            for _ in range(rnd.randint(2, 5)):
                add("li", sentence(rnd, 2, 6))
            out.append("</ul>")
        else:
            add("blockquote", sentence(rnd))
    add("p", " ".join(sentence(rnd) for _ in range(3)))
    return "".join(out), texts


def comments(rnd, tag="div"):
    body = "".join(f"<{tag}><span class=by>{rnd.choice(WORDS).title()} wrote on {k} May</span><p>{' '.join(sentence(rnd) for _ in range(rnd.randint(1, 4)))}</p></{tag}>" for k in range(rnd.randint(3, 15)))
    return body


def menu(rnd, n=6):
    return "<ul>" + "".join(f"<li><a href=/{k}>{rnd.choice(WORDS)} {rnd.choice(WORDS)}</a></li>" for k in range(n)) + "</ul>"


LAYOUTS = {
    "article": lambda r, a: f"<nav>{menu(r)}</nav><article>{a}</article><div id=discussion>{comments(r)}</div><footer>{sentence(r)}</footer>",
    "blog": lambda r, a: f"<div id=header><a href=/>Home</a></div><div class=wrap><div class='post entry'>{a}</div><div class=sidebar>{menu(r)}<p>{sentence(r)}</p></div></div><section id=comments>{comments(r)}</section>",
    "plain": lambda r, a: f"{menu(r)}{a}<div class=footer><p>{sentence(r)}</p></div>",
    "table": lambda r, a: f"<table><tr><td>{menu(r)}</td><td>{a}</td></tr></table><div class=copyright>{sentence(r)}</div>",
    "unnamed": lambda r, a: f"<div><div>{menu(r)}</div><div class=c7>{a}</div><div class=c9>{menu(r)}</div></div><div class=k3>{comments(r, 'section')}</div>",
    "main": lambda r, a: f"<header>{menu(r)}</header><main><div class=body>{a}</div><aside>{sentence(r)} {sentence(r)}</aside><div class=x1>{comments(r)}</div></main>",
    "form": lambda r, a: f"<form action=x><div class=top>{menu(r)}</div><div id=content3>{a}</div><div class=newsletter><p>{sentence(r)}</p></div></form>",
    "cards": lambda r, a: f"<main><article class=full>{a}</article>" + "".join(f"<article class=card><h3>{sentence(r, 2, 3)}</h3><p>{sentence(r, 3, 6)}</p></article>" for _ in range(4)) + "</main>",
    "ads": lambda r, a: f"<div class=page><div class=cookie-notice>{sentence(r)}</div><div class=text>{a}</div><div class=ad>{sentence(r)}</div><div class=related-posts>{menu(r)}</div></div>",
}


def scores(layout, pages=60):
    """(recall, precision) of words of the known articles."""
    rnd, held, found, both = random.Random(5), 0, 0, 0
    for _ in range(pages):
        body, texts = article(rnd)
        got = Counter(html.main_text(f"<html><body>{LAYOUTS[layout](rnd, body)}</body></html>").split())
        want = Counter(" ".join(texts).split())
        held, found, both = held + want.total(), found + got.total(), both + (got & want).total()
    return both / held, both / found


@pytest.mark.parametrize("layout", LAYOUTS)
def test_recall_and_precision_by_layout(layout):
    recall, precision = scores(layout)
    assert recall >= 0.95 and precision >= 0.95, (recall, precision)


def test_blocks_are_those_of_another_parser():
    """Every line is a block as the library parser of Python cuts the page, in its order."""
    rnd = random.Random(8)
    for layout in LAYOUTS.values():
        for _ in range(10):
            page = layout(rnd, article(rnd)[0])
            rest = iter(blocks_of(page))
            assert all(line in rest for line in html.main_text(page).split("\n"))
