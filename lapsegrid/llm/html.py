"""Main-text extraction from HTML by tag-path ratios.

A page is cut into text blocks, each filed under its root-to-leaf path of block elements (tag
and first class, or a container's id without its number). Per path the text length and the punctuation are aggregated and
divided by the number of blocks. Both ratios are smoothed over sibling paths in page order, fused with each
other, with the share of text outside links and with a weight of the path, and
lifted where the path lies in a container of content. Paths at or above a threshold are content
paths; the deepest container that holds nearly all of their text is the article's. An article element with
text is the container wherever there is one, else a main element.

In the container everything stays, short sections, notes and references too, but what weighs little.
Elements that are page furniture by tag or role (menus, footers, scripts, ...) are left out. Names - classes
and ids - and tags that may hold an article as well (forms, asides, headers) only weigh, and weigh
nothing where nothing else on the page could be the article. Repeated records outside an article element, such as readers'
comments or teasers, weigh as little as a name of furniture, whatever they are called and however long they are.
Articles, main elements and headings are never judged by their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lapsegrid.llm.common import bounded_batches, columns

#: Weights of a path and its sibling paths next to it in page order.
SMOOTHING = (0.25, 0.5, 0.25)
#: Content paths have at least this share of the mean fused ratio, weighted by text and ratio.
THRESHOLD = 0.12
#: Share of a container's own ratio that its paths have at least, and what is left of it a level further down.
LIFT, FADE = 0.5, 0.5
#: The article is the deepest container with this share of the content.
COVERAGE = 0.9

BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main map menu nav noscript object ol optgroup option p pre search section "
    "select summary svg table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without article text.
FURNITURE = frozenset(
    "audio button canvas dialog footer frameset head iframe map menu nav noscript object optgroup option search select svg template textarea title video".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar".split())
#: Elements and roles that seldom hold the article; they weigh like a name.
SELDOM = frozenset("aside fieldset form alert dialog".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus sidebar "
    "footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login comment "
    "comments disqus respond replies share sharing social related recommended widget widgets toolbar pagination pager copyright skip".split()
)
#: Longer words of these and a part count too, as in "commentlist" or "advertbox".
FURNITURE_STEMS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "footer", "masthead", "navbar", "newsletter", "sidebar", "sponsor")
FURNITURE_PARTS = frozenset(" area bar block bottom box container group holder inner item items left link links list outer panel right s section text top wrap wrapper".split(" "))
#: Words that articles have in their names too, and words that speak for an article.
WEAK_NAMES = frozenset("alert banner copyright header login masthead notice notices promotion related recommended replies respond search share sharing signup skip social subscription".split())
CONTENT_NAMES = frozenset("article blog body content document entry essay main news page post story text".split())
#: Weight of an element all of whose names are furniture, of one with such a name or word among others, and
#: of one that has a name of content too or such words only as articles have.
NAMED, HINT, WEAK = 0.003, 0.05, 0.8
#: With this share of the page's text a hint in an element's names counts for nothing.
BULK = 0.8
#: Least weight of what stays in the container, share of links above which a path outside article and main elements is a
#: list of them, and length of text that may be an article's without punctuation.
STAYS, LINKED, SOME = 0.3, 0.8, 40
#: Repeated records: so many siblings of which this share hold two kinds of blocks or more, at most so many blocks, one of
#: them as short as a name and a date, and no heading.
RECORDS, ALIKE, RECORD_BLOCKS, BYLINE = 3, 0.8, 40, 80
RECORD_TAGS = frozenset("article blockquote div li section".split())
#: Another article element belongs to the page's text if it has the same path and this share of the largest one's text.
PART = 0.5
#: Weight of paths in an article or main element.
ARTICLE = 5.0
#: Elements that are parts of a text, not containers of one.
INNER = frozenset("p li ul ol dl dt dd table tbody tr td th blockquote pre figure h1 h2 h3 h4 h5 h6".split())
ROOTS = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of the same kind.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head", "title"},
}
#: An implied end doesn't reach beyond these.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|xmp|noembed|noframes)\b(?:[^'\">]|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^'\">]|\"[^\"]*\"|'[^']*')*+>|[^>]*+(?:>|\Z))",
    re.IGNORECASE | re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NUMBER = re.compile(r"[\W_]*\d+$")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，]")


@dataclass
class Block:
    path: int
    """Number of the path in the page."""
    text: str
    link_chars: int


@dataclass
class _Open:
    """An open element."""

    tag: str
    path: int
    furniture: bool
    inside: bool
    """Within an article or main element, or the main part by its role."""
    element: int
    """Number of the element."""


@dataclass
class Element:
    """A block element: the element around it, its path, and its blocks."""

    parent: int
    path: int
    first: int
    end: int = -1


@dataclass
class Page:
    """Blocks and paths of a page. Paths are numbered, parents before children; number 0 is the page itself."""

    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: [""])
    names: list[float] = field(default_factory=lambda: [1.0])
    """The least weight of the names on each path."""
    inside: list[bool] = field(default_factory=lambda: [False])
    """Whether the path leads through an article or main element."""
    articles: list[bool] = field(default_factory=lambda: [False])
    """Whether the path leads through an article element."""
    elements: list[Element] = field(default_factory=list)
    numbers: dict[tuple[int, str, float], int] = field(default_factory=dict)
    stack: list[_Open] = field(default_factory=list)
    open: Counter = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)
    links: int = 0
    link_text: list[str] = field(default_factory=list)

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text and not (self.stack and self.stack[-1].furniture):
            inside = len(" ".join("".join(self.link_text).split()))
            self.blocks.append(Block(self.stack[-1].path if self.stack else 0, text, min(inside, len(text))))
        self.pieces, self.link_text = [], []

    def push(self, tag: str, rest: str) -> None:
        above = self.stack[-1] if self.stack else _Open("", 0, False, False, -1)
        label, furniture, weight, article = judged(tag, rest, above.inside)
        inside = above.inside or article
        weight = min(weight, self.names[above.path])
        key = (above.path, label, weight)
        if key not in self.numbers:
            self.numbers[key] = len(self.parents)
            self.parents.append(above.path)
            self.tags.append(tag)
            self.names.append(weight)
            self.inside.append(inside)
            self.articles.append(self.articles[above.path] or tag == "article")
        self.stack.append(_Open(tag, self.numbers[key], above.furniture or furniture, inside, len(self.elements)))
        self.elements.append(Element(above.element, self.numbers[key], len(self.blocks)))
        self.open[tag] += 1

    def pop(self, at: int) -> None:
        """Close the elements from ``at`` on."""
        while len(self.stack) > at:
            gone = self.stack.pop()
            self.open[gone.tag] -= 1
            self.elements[gone.element].end = len(self.blocks)

    def close(self, tags: set[str], scope: set[str]) -> None:
        """Close the innermost open element of ``tags``, and what is in it, within the scope."""
        if not any(self.open[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag in tags:
                return self.pop(at)
            if self.stack[at].tag in scope:
                return


def _furniture_word(word: str) -> bool:
    """A name of furniture, or one with a part of a page put to it."""
    return word in FURNITURE_NAMES or any(word.startswith(x) and word[len(x) :].removeprefix("s") in FURNITURE_PARTS for x in FURNITURE_STEMS)


def _kind(name: str, inside: bool) -> tuple[str, bool]:
    """What one class name or id is - "furniture", "hint", "content" or "" - and whether its words of furniture are weak."""
    words = [w.lower() for w in _SPLIT.split(name) if w]
    own = [w for w in words if _furniture_word(w) or (w == "header" and not inside)]
    weak = WEAK_NAMES.issuperset(own)
    if not own:
        return "" if CONTENT_NAMES.isdisjoint(words) else "content", False
    if words[-1] in own or all(w in own or w in FURNITURE_PARTS or w in CONTENT_NAMES for w in words):
        return "furniture", weak  # the last word says what it is, unless it is a part of a page or text
    return "hint", weak


def name_weight(names: list[str], inside: bool) -> float:
    """The weight that an element's class names and id give it: 1 without a word of furniture."""
    kinds = [_kind(n, inside) for n in names if n]
    found = {k for k, _ in kinds}
    if not found & {"furniture", "hint"}:
        return 1.0
    if "content" in found:
        return WEAK
    if found == {"furniture"}:
        return NAMED
    return WEAK if all(weak for k, weak in kinds if k in ("furniture", "hint")) else HINT


def judged(tag: str, rest: str, inside: bool) -> tuple[str, bool, float, bool]:
    """Path label of an element, whether it is page furniture, its weight, and whether it is an article or the main part."""
    attrs = {m[1].lower(): entities.unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in _ATTR.finditer(rest)} if "=" in rest or "hidden" in rest else {}
    names = attrs.get("class", "").split()
    label = f"{tag}.{names[0]}" if names else f"{tag}#{_NUMBER.sub('', attrs['id'])}" if attrs.get("id") and tag not in INNER else tag
    furniture = tag in FURNITURE or "hidden" in attrs or attrs.get("aria-hidden", "") == "true"
    furniture |= "display:none" in attrs.get("style", "").replace(" ", "").lower()
    role, weight = attrs.get("role", "").lower(), 1.0
    if tag not in ROOTS or tag == "article":
        furniture |= role in FURNITURE_ROLES
    if tag not in ROOTS and tag not in HEADINGS:
        weight = name_weight([*names, attrs.get("id", "")], inside)
        if tag in SELDOM or role in SELDOM or (tag == "header" and not inside):
            weight = NAMED
    return label, furniture, weight, tag in ("article", "main") or role == "main"


def read_page(page: str) -> Page:
    """Text blocks of a page in order, and its paths. White space in a block is one space; character
    references are decoded; comments, scripts, styles, markup and furniture are gone."""
    state, at = Page(), 0

    def text(piece: str) -> None:
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            state.pieces.append(piece)
            if state.links:
                state.link_text.append(piece)

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        tag, end, rest = m["name"].lower(), bool(m["end"]), m["rest"]
        if tag == "a":
            state.links = 0 if end else 1
        if tag == "br":
            text(" ")
        if tag not in BLOCKS:
            continue
        state.flush()
        if end:
            state.close({tag}, ROOTS - {tag} if tag not in ROOTS else set())
            continue
        if tag not in VOID:
            if state.stack and state.stack[-1].tag == "head" and tag not in ("title", "noscript", "template"):
                state.pop(len(state.stack) - 1)
            if state.stack and state.stack[-1].tag == "p":
                state.pop(len(state.stack) - 1)
            if tag in CLOSES and tag != "p":
                state.close(CLOSES[tag], SCOPES.get(tag, set()))
            state.push(tag, rest)
    text(page[at:])
    state.flush()
    state.pop(0)
    return state


def _smooth(values: list[float]) -> list[float]:
    left, mid, right = SMOOTHING
    out = []
    for k, v in enumerate(values):
        a = values[k - 1] if k else v
        b = values[k + 1] if k + 1 < len(values) else v
        out.append(left * a + mid * v + right * b)
    return out


def _is_record(page: Page, e: Element) -> bool:
    """A byline and a text, or the like: blocks of several paths, few, one of them short, none a heading."""
    own = page.blocks[e.first : e.end]
    if not 2 <= len(own) <= RECORD_BLOCKS or len({b.path for b in own}) < 2:
        return False
    return min(len(b.text) for b in own) <= BYLINE and not any(page.tags[b.path] in HEADINGS for b in own)


def record_paths(page: Page) -> set[int]:
    """Paths of repeated records outside article elements, and of articles that repeat like records."""
    groups: dict[tuple[int, int], list[Element]] = {}
    for e in page.elements:
        tag = page.tags[e.path]
        if tag in RECORD_TAGS and (tag == "article" or not page.articles[e.path]):
            groups.setdefault((e.parent, e.path), []).append(e)
    found = set()
    for (_, path), own in groups.items():
        if len(own) >= RECORDS and sum(_is_record(page, e) for e in own) >= ALIKE * len(own):
            found.add(path)
    return found


def _candidate(page: Page, b: Block) -> bool:
    """A block that may be an article's: not a heading, not links, with punctuation or some length."""
    return page.tags[b.path] not in HEADINGS and 2 * b.link_chars < len(b.text) and (len(b.text) >= SOME or _PUNCTUATION.search(b.text) is not None)


def path_weights(page: Page) -> list[float]:
    """Weight of each path: that of the names on it and of being a record. If all that could be the article weighs little, the
    elements that hold most text are freed of their weights, from the outside, until something could be."""
    n = len(page.parents)
    text, some = [0] * n, [0] * n
    for b in page.blocks:
        text[b.path] += len(b.text)
        some[b.path] += _candidate(page, b)
    for p in range(n - 1, 0, -1):
        text[page.parents[p]] += text[p]
    records = record_paths(page)
    own = [1.0] * n
    for p in range(1, n):
        named = page.names[p] / page.names[page.parents[p]]
        own[p] = min(1.0 if named > NAMED and text[p] >= BULK * text[0] else named, NAMED if p in records else 1.0)
    while True:
        out = [1.0] * n
        for p in range(1, n):
            out[p] = out[page.parents[p]] * own[p]
        low = [p for p in range(1, n) if own[p] < STAYS and out[page.parents[p]] >= STAYS and text[p]]
        if not low or any(some[p] and out[p] >= STAYS for p in range(n)):
            break
        own[max(low, key=lambda p: (text[p], -p))] = 1.0
    return [w * (ARTICLE if inside else 1.0) for w, inside in zip(out, page.inside, strict=True)]


def fused_ratios(page: Page, weights: list[float]) -> tuple[dict[int, float], dict[int, int]]:
    """Per path with text its smoothed, fused and lifted ratio, and its text length."""
    held: dict[int, list[int]] = {}
    for b in page.blocks:
        own = held.setdefault(b.path, [0, 0, 0, 0])
        own[0] += len(b.text)
        own[1] += len(_PUNCTUATION.findall(b.text))
        own[2] += b.link_chars
        own[3] += 1
    siblings: dict[int, list[int]] = {}
    for path in held:  # in page order
        siblings.setdefault(page.parents[path], []).append(path)
    length, marks = {}, {}
    for group in siblings.values():
        length.update(zip(group, _smooth([held[p][0] / held[p][3] for p in group]), strict=True))
        marks.update(zip(group, _smooth([held[p][1] / held[p][3] for p in group]), strict=True))
    plain = {p: v[0] and weights[p] * length[p] * (1 + marks[p]) * (1 - v[2] / v[0]) for p, v in held.items()}
    # a container's own ratio: the mean of its text and of the paths right in it
    sums, texts = [0.0] * len(page.parents), [0] * len(page.parents)
    for p, v in held.items():
        for at in (p, page.parents[p]):
            if at >= 0:
                sums[at] += plain[p] * v[0]
                texts[at] += v[0]
    around = [0.0] * len(page.parents)
    for p in range(len(around)):  # parents come first
        above = around[page.parents[p]] * weights[p] / weights[page.parents[p]] if p else 0.0
        around[p] = max(sums[p] / texts[p] if texts[p] else 0.0, FADE * above)
    out = {}
    for p, v in held.items():
        lift = LIFT * around[max(0, page.parents[p])] * weights[p] / weights[max(0, page.parents[p])] * (1 - v[2] / v[0] * (0.5 if page.inside[p] else 1.0))
        out[p] = max(plain[p], lift)
    return out, {p: v[0] for p, v in held.items()}


def content_paths(page: Page, weights: list[float]) -> dict[int, float]:
    """Paths whose fused ratio reaches the threshold, and how much content is on each: its ratio times its text."""
    ratio, text = fused_ratios(page, weights)
    total = sum(ratio[p] * n for p, n in text.items())
    mean = sum(ratio[p] ** 2 * n for p, n in text.items()) / total if total else 0.0
    return {p: f * text[p] for p, f in ratio.items() if f >= THRESHOLD * mean and f > 0}


def container(page: Page, paths: dict[int, float]) -> int:
    """The deepest path of containers that holds COVERAGE of the content on these paths."""
    held = [paths.get(p, 0.0) for p in range(len(page.parents))]
    for p in range(len(held) - 1, 0, -1):
        held[page.parents[p]] += held[p]
    root, least = 0, COVERAGE * held[0]
    for p in range(1, len(held)):  # a child comes after its parent
        if page.parents[p] == root and held[p] >= least and page.tags[p] not in INNER:
            root = p
    return root


def marked(page: Page, weights: list[float]) -> list[Element]:
    """The page's article elements, else its main ones: the outermost that hold text of weight. Of several the
    largest, and those of its path with a good part of its text."""
    above = [False] * len(page.elements)
    for wanted in (lambda p: page.tags[p] == "article", lambda p: page.inside[p] and not page.articles[p]):
        found = []
        for k, e in enumerate(page.elements):
            around = page.parents[e.path]
            above[k] = e.parent >= 0 and (above[e.parent] or wanted(page.elements[e.parent].path))
            if wanted(e.path) and not above[k] and weights[e.path] >= STAYS and weights[around] >= STAYS:
                size = sum(len(b.text) - b.link_chars for b in page.blocks[e.first : e.end] if weights[b.path] >= STAYS)
                found += [(size, e)] if size else []
        if found:
            most, best = max(found, key=lambda f: f[0])
            return [e for size, e in found if e is best or (e.path == best.path and size >= PART * most)]
    return []


def _title(page: Page, first: int) -> list[str]:
    """A heading in a page header, if the header has nothing else, before a text that doesn't begin with one."""
    for k in range(first - 1, -1, -1):
        if page.tags[page.blocks[k].path] in HEADINGS:
            around = page.parents[page.blocks[k].path]
            alone = all(b.path == page.blocks[k].path or page.parents[b.path] != around for b in page.blocks)
            return [page.blocks[k].text] if page.tags[around] == "header" and alone and not page.blocks[k].link_chars else []
    return []


def main_text(html: str | None) -> str:
    """The article of a page: what stays in its container in page order, joined by a newline. Headings right before
    the container belong to it, and so does the heading of a header that holds nothing else, where it has none of its own.

    Null and empty pages, and pages without text outside furniture, give "".
    """
    page = read_page(html or "")
    weights = path_weights(page)
    n, blocks = len(page.parents), page.blocks
    roots = marked(page, weights)
    paths = {} if roots else content_paths(page, weights)
    root = roots[0].path if roots else container(page, paths)
    within, rest = [False] * n, [0.0] * n  # in the container, and the weight from there on
    within[root], rest[root] = True, 1.0
    for p in range(root + 1, n):
        if within[page.parents[p]]:
            within[p], rest[p] = True, rest[page.parents[p]] * weights[p] / weights[page.parents[p]]
    links = [0] * n
    for b in blocks:
        links[b.path] += b.link_chars
    text = [0] * n
    for b in blocks:
        text[b.path] += len(b.text)
    whole = page.tags[root] in ("", "html", "body")  # the page itself is the container: paths decide
    inner = [page.tags[p] in INNER and page.parents[p] == root for p in range(n)]

    def stays(b: Block) -> bool:
        p = b.path
        if not within[p] or rest[p] < STAYS:
            return False
        if roots or p in paths:
            return True
        return links[p] < LINKED * text[p] and (not whole or inner[p] or p == root)

    places = [k for e in roots for k in range(e.first, e.end)] if roots else range(len(blocks))
    kept = [k for k in places if stays(blocks[k])]
    first = kept[0] if kept else 0
    heads: list[str] = []
    while first and page.tags[blocks[first - 1].path] in HEADINGS and weights[blocks[first - 1].path] >= STAYS:
        first -= 1
        heads.insert(0, blocks[first].text)
    if kept and not heads and page.tags[blocks[kept[0]].path] not in HEADINGS:
        heads = _title(page, kept[0])
    return "\n".join(heads + [blocks[k].text for k in kept])


def _extract(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for (h,) in columns(batch, "html")]
        yield pa.record_batch(
            {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). Map only.

    Null html counts as empty; null ids and urls pass through; repeated rows stay repeated and
    have equal texts; pages of any length and depth are read whole; equal ratios pass the threshold
    together. Other columns are ignored. An empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
