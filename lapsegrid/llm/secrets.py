"""Secret scans: base patterns plus assignment-aware lexing.

Wherever a name is followed by an assignment operator, a small lexer reads what is assigned: quoted
strings of several kinds, over several lines in parentheses or block scalars, joined by operators
or put side by side, with comments between; types between name and operator are passed over.
Assignments are followed in order: a name stands for what was last assigned to it, concatenations of
literals and names are folded, and a name that is bound only further down is looked up at the
end. Keys of nested tables and sections lend their sensitivity to what is in them. Each literal is scored by how
sensitive the names are that it reaches and how random it looks, folded. Literals that reach the
threshold add spans of kind ``literal``; base spans stay.

Names are cut at case and underscores, and glued ones into the words that they are made of. Nothing is counted
off: an expression is read to its end, and what a value stands for is gathered once per value, however many stand in a chain.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from lapsegrid.llm.common import bounded_batches, columns

KINDS = ("assign", "access", "hex", "literal")
# Fixed patterns of the base scan.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

_TYPE = r"&?+(?:'\w++[ \t]++)?+(?:[A-Za-z_]\w*+(?:(?:\.|::)\w++){0,16}+)(?:[\[<][^\n=;\"'`]{0,1000}[\]>])?+[?!]?+"
#: Name, an optional type, and the operator. The type's inside is bounded and the rest possessive, so linear in the text.
_TARGET = re.compile(
    r"(?<![\w.\-$])(?P<name>[A-Za-z_$][\w.\-]*+)(?:"
    rf"[?!]?+[ \t]*+:[ \t]*+(?P<type>{_TYPE}(?:[ \t]*+\|[ \t]*+{_TYPE}){{0,32}}+)[ \t]*+=(?![=>])"
    r"|[\"'\]]{0,2}+[ \t]*+(?P<op>:=|=>|===?|[+.]=|=|:(?!:))|>(?P<element>[^<>\n]++)</(?P=name)>)"
)
_STRING = re.compile(
    r"[bBfFrRuUlL@$]{0,2}(?:\"\"\"(?P<t1>.*?)\"\"\"|'''(?P<t2>.*?)'''|\"(?P<d>[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+)\"|'(?P<s>[^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|`(?P<b>[^`\\]*+(?:\\.[^`\\]*+)*+)`)",
    re.DOTALL,
)
_SPACE = re.compile(r"[ \t]*+(?:\\\r?\n[ \t]*+)*+")
_GAP = re.compile(r"(?:[ \t\r\n]++|\\\r?\n|\#[^\n]*+|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)*+")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>|]++")
_IDENTIFIER = re.compile(r"\$?\{?\{?[ \t]?([A-Za-z_][\w.\-]*)[ \t]?\}?\}?")
_REFERENCE = re.compile(r"\$\{[ ]?[A-Za-z_][\w.]*[ ]?\}|\{\{[ ]?[A-Za-z_][\w.]*[ ]?\}\}")
_JOIN = re.compile(r"\+|\.\.|\.(?=[ \t]*[\"'$])|&(?!&)|\|\||<<(?=[ \t]*\")")
_NEXT_LINE = re.compile(r"[ \t]*+(?:\#[^\n]*+|//[^\n]*+)?\r?\n[ \t]*+(?:\+|\.|&|\.\.)[ \t]*+(?=[\"'`])")
_CHAIN = re.compile(r"([A-Za-z_$][\w.\-]*+)(?:[ \t]++=(?![=>~])[ \t]*+|=)(?=[\"'`\w$(])")
_BLOCK = re.compile(r"[ \t]*+[|>][+\-\d]{0,2}[ \t]*+(?:\#[^\n]*+)?\r?\n")
_HEREDOC = re.compile(r"[ \t]*+(?:\$\([ \t]*+cat[ \t]++)?<<[-~]?[ \t]*+[\"']?(?P<end>[A-Za-z_]\w*+)[\"']?[^\n]*+\n")
_LINE_WORD = re.compile(r"^[ \t]*+([A-Za-z_]\w*+)", re.MULTILINE)
_NESTED = re.compile(r"[ \t]*+(?:\#[^\n]*+)?(?:\r?\n[ \t]*+(?:\#[^\n]*+)?(?=\r?\n))*+\r?\n(?P<indent>[ ]*+)(?=[\w\"'$-])")
_SECTION = re.compile(r"^[ \t]*+\[{1,2}(?P<name>[\w.\- \"]+)\]{1,2}[ \t]*+(?:[#;][^\n]*+)?$", re.MULTILINE)
_COMMENT = re.compile(r"(?:^|[\s;])(?:\#|//|--|;)|/\*|<!--")
_DEFINE = re.compile(r"^[ \t]*+\#[ \t]*+define[ \t]++(?P<name>[A-Za-z_]\w*+)[ \t]++(?=[\"'(LuU])", re.MULTILINE)
_KEYWORD = re.compile(r"(?:new|await|return|const)[ \t]++(?=[\w\"'`$(])")
#: Words and marks after which another value may stand for the one before: ``a or "b"``, ``x ? "a" : "b"``.
_OTHERWISE = re.compile(r"(?:or|and|else)[ \t]++(?=[\w\"'`$(])|\?\?[ \t]*+|\?(?=[ \t\"'`])[ \t]*+")
_TUPLE = re.compile(r"[A-Za-z_$][\w.\-]*+[ \t]*+,")
_ITEM = re.compile(r"(?P<indent>[ \t]*+)-[ \t]++")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Sensitivity of the words in a target name.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "bearer": 3,
    "auth": 2, "private": 2, "access": 1, "key": 2, "signing": 1, "session": 1, "salt": 1, "api": 1, "client": 1, "pass": 2, "secrets": 3, "tokens": 3, "passwords": 3,
}
#: Keys whose literal names what the key ``value`` beside them holds.
NAMING, VALUE = frozenset("name key id".split()), frozenset("value val default".split())
THRESHOLD = 5.0
#: Literals shorter than this, or with white space, are often words: see ``doubt``.
LONG = 12
#: Folded literals up to this length are scored as they are; of longer ones only the counts are carried on.
FOLD = 1024
#: Words that a glued name may be made of besides the sensitive ones.
GLUED = frozenset(
    "admin app aws azure b bot cfg conf config db default dev enc encryption env file ftp gh git github google hash hmac host http https id jwt ldap login mail main "
    "master my mysql oauth ops pg postgres prod redis root s server service shared sign slack smtp sql ssh str stripe svc test text tls user usr val value web wifi x".split()
)
#: Sensitive words that end a glued name whatever is before them.
ENDINGS = ("password", "passwd", "passphrase", "secret", "secrets", "token", "tokens", "credential", "credentials", "apikey", "passwords")
_WORD = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[._'-](?:[A-Z]?[a-z]+|[A-Z]+))*[.,;:!?]*")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


@lru_cache(maxsize=1 << 14)
def glued(word: str) -> tuple[str, ...]:
    """The sensitive words that a word is made of: of ways to cut it into sensitive and GLUED words that with the fewest pieces;
    else what it ends with; else none."""
    if word in SENSITIVE:
        return (word,)
    if len(word) <= 40:
        best: list[tuple[int, tuple[str, ...]] | None] = [(0, ())] + [None] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(max(0, end - 12), end):
                piece, before = word[begin:end], best[begin]
                if before is not None and (piece in SENSITIVE or piece in GLUED):
                    new = (before[0] + 1, before[1] + ((piece,) if piece in SENSITIVE else ()))
                    if best[end] is None or new[0] < best[end][0]:
                        best[end] = new
        if best[-1] is not None:
            return best[-1][1]
    return next(((x,) for x in ENDINGS if word.endswith(x)), ())


def sensitivity(name: str) -> int:
    """Sum of the weights of the sensitive words in a name, each once."""
    parts = {w for p in _NAME_PART.findall(name) for w in glued(p.lower())}
    return sum(SENSITIVE[p] for p in parts)


def randomness(literal: str) -> float:
    """Bits of entropy per character plus one for each of three character classes."""
    counts = Counter(literal)
    bits = -sum(c / len(literal) * math.log2(c / len(literal)) for c in counts.values())
    kinds = any(c.islower() for c in literal) + any(c.isupper() for c in literal) + any(c.isdigit() for c in literal)
    return bits + kinds - 3


def doubt(literal: str) -> float:
    """What a short or spaced literal loses: up to two for plain words, and more the shorter it is."""
    n, parts = len(literal), literal.split()
    if n >= LONG and len(parts) == 1 and not any(c.isspace() for c in literal):
        return 0.0
    return 2 * sum(_WORD.fullmatch(p) is not None for p in parts) / max(1, len(parts)) + max(0, LONG - n) / 8 + max(0, 8 - n) / 2


def enough(weight: int, literal: str, quoted: bool) -> bool:
    """Whether a literal that reaches names of this weight is a secret: weight and randomness less doubt reach the threshold, or a
    quoted one without white space, five characters or more, has a digit or a mark and isn't a plain word, under a plainly
    sensitive name."""
    if not literal:
        return False
    if weight + randomness(literal) - doubt(literal) >= THRESHOLD:
        return True
    marks = any(c.isdigit() or not (c.isalnum() or c in "-_./:") for c in literal)
    return weight >= 3 and quoted and len(literal) >= 5 and marks and not any(c.isspace() for c in literal) and not _WORD.fullmatch(literal)


class _Fold:
    """What is known of folded literals: the text while it is short, else counts that can be added up."""

    __slots__ = ("counts", "n", "plain", "quoted", "space", "text", "words")

    def __init__(self, text: str = "", quoted: bool = True):
        self.text: str | None = text
        self.n, self.quoted, self.counts = len(text), quoted, None

    def spread(self) -> None:
        """Carry on counts in place of the text: characters (beyond ASCII by their last seven bits), words, plain words."""
        if self.counts is None:
            text = self.text or ""
            self.counts = Counter(c if c < "\x80" else chr(128 + (ord(c) & 127)) for c in text)
            parts = text.split()
            self.words, self.plain = len(parts), sum(_WORD.fullmatch(p) is not None for p in parts)
            self.space = any(c.isspace() for c in text)

    def add(self, other: _Fold) -> None:
        self.quoted = self.quoted and other.quoted
        self.n += other.n
        if self.text is not None and other.text is not None and self.n <= FOLD:
            self.text += other.text
            return
        self.spread()
        other.spread()
        self.counts.update(other.counts)
        self.words, self.plain, self.space = self.words + other.words, self.plain + other.plain, self.space or other.space
        self.text = None

    def enough(self, weight: int) -> bool:
        if self.text is not None:
            return enough(weight, self.text, self.quoted)
        bits = -sum(c / self.n * math.log2(c / self.n) for c in self.counts.values())
        kinds = sum(any(f(c) for c in self.counts) for f in (str.islower, str.isupper, str.isdigit))
        unsure = 2 * self.plain / max(1, self.words) if self.space or self.words > 1 else 0.0
        return weight + bits + kinds - 3 - unsure >= THRESHOLD


class _Value:
    """What an expression stands for: literals (start, end, whether quoted) and other values in order."""

    __slots__ = ("joined", "parts", "weight")

    def __init__(self, parts: list, joined: bool = True):
        self.parts, self.joined, self.weight = parts, joined, 0

    def only(self) -> tuple[int, int, bool] | None:
        """The literal that the value stands for, if it is a single one."""
        at = self
        for _ in range(8):
            if len(at.parts) != 1:
                return None
            if not isinstance(at.parts[0], _Value):
                return at.parts[0]
            at = at.parts[0]
        return None


class _Lexer:
    """Assignments of one text, in order."""

    def __init__(self, text: str):
        self.text = text
        self.bound: dict[str, _Value] = {}
        self.values: list[_Value] = []
        self.later: list[tuple[_Value, str, tuple[int, int]]] = []  # names not bound when they were read
        self.scopes: list[tuple[str, int, int]] = []  # kind, indent or depth, sensitivity
        self.depth = 0
        self.braces_at = 0
        self.words: dict[str, list[int]] | None = None
        self.else_in = (-1, -1)  # the last " else " of a line, and the line's end
        # what is known of the line of the last target: start, indent, read so far, whether a comment has begun
        self.start, self.indent, self.read, self.comment = 0, 0, -1, False

    # -- where a target stands
    def _line(self, at: int) -> None:
        """Move on to the line of ``at``. A list dash indents like a space. No character is looked at twice."""
        text = self.text
        new = text.rfind("\n", max(0, self.read), at) + 1
        if new or self.read < 0:
            self.start = self.read = new
            k = new
            while k < at and text[k] in " \t-\"'":
                k += 1
            self.indent, self.comment = k - new, False
        if not self.comment:  # one character back: a comment's mark follows white space
            self.comment = _COMMENT.search(text, max(self.start, self.read - 2), at) is not None
        self.read = at

    def _enter(self, at: int) -> int:
        """Leave the scopes that have ended before ``at``; returns the greatest sensitivity of the others."""
        self.depth += self.text.count("{", self.braces_at, at) - self.text.count("}", self.braces_at, at)
        self.braces_at = max(self.braces_at, at)
        self._line(at)
        if self.scopes:
            while self.scopes and (self.scopes[-1][1] >= self.indent if self.scopes[-1][0] == "indent" else self.scopes[-1][0] == "brace" and self.scopes[-1][1] > self.depth):
                self.scopes.pop()
        return max((s for _, _, s in self.scopes), default=0)

    # -- what is assigned
    def expression(self, at: int, braces: bool = False) -> tuple[_Value | None, int, str | None]:
        """(value, end, chained name) of the expression at ``at``; with ``braces`` it is a list in braces."""
        text, parts, depth, joined, open_, last, asked = self.text, [], 0, True, False, None, False
        while True:
            at = (_GAP if depth or open_ else _SPACE).match(text, at).end()
            c = text[at : at + 1]
            if c in ("(", "[") or (c == "{" and braces):
                depth, joined, at, open_ = depth + 1, joined and c == "(", at + 1, False
                continue
            if m := _KEYWORD.match(text, at):
                at = m.end()
            if m := _STRING.match(text, at):
                a, b = m.span(m.lastgroup)
                parts.append((a, b, True))
                at, last = m.end(), "string"
            elif not parts and not depth and (m := _CHAIN.match(text, at)):
                return None, at, m[1]
            elif m := _BARE.match(text, at):
                token, last = m[0], "name"
                end = m.end()
                if text[end : end + 1] == "(" and _IDENTIFIER.fullmatch(token):  # a call: what it is given
                    depth, joined, at = depth + 1, False, end + 1
                    continue
                pieces = token.split("+")
                if len(pieces) > 1 and all(p in self.bound for p in pieces):
                    parts.extend(self.bound[p] for p in pieces)
                else:
                    parts.append((token, (at, end)))
                at = end
            elif m := _REFERENCE.match(text, at):
                parts.append((m[0], m.span()))
                at, last = m.end(), "name"
            elif not (depth and c in (")", "]", "}")):
                break
            while depth:
                end = _GAP.match(text, at).end()
                if text[end : end + 1] not in (")", "]", "}" if braces else ")"):
                    break
                depth, at = depth - 1, end + 1
            gap = (_GAP if depth else _SPACE).match(text, at).end()
            if m := _JOIN.match(text, gap):
                at, open_ = m.end(), True
            elif depth and text[gap : gap + 1] == ",":
                at, joined, open_ = gap + 1, False, True
            elif last == "string" and (m := _NEXT_LINE.match(text, at)):
                at, open_ = m.end(), True
            elif last == "string" and _STRING.match(text, gap):
                at, open_ = gap, False
            elif m := _OTHERWISE.match(text, gap):
                at, joined, open_, asked = m.end(), False, False, asked or m[0][0] == "?"
            elif asked and text[gap : gap + 1] == ":":
                at, joined, open_, asked = gap + 1, False, False, False
            elif last == "string" and (end := self._else(gap)):
                at, joined, open_ = end, False, False
            else:
                break
        return self._resolved(parts, joined), at, None

    def _else(self, at: int) -> int:
        """Where the other value begins of ``"a" if b else "c"`` with the ``if`` at ``at``; 0 if it isn't one. The last ``else`` of a
        line is looked for once."""
        text = self.text
        if text[at : at + 3] != "if ":
            return 0
        if at >= self.else_in[1]:
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            self.else_in = (text.rfind(" else ", at, end), end)
        found = text.find(" else ", at, self.else_in[1]) if at < self.else_in[0] + 1 else -1
        return found + 6 if found >= 0 else 0

    def _resolved(self, parts: list, joined: bool) -> _Value | None:
        """A value of the parts, with what names stand for at this place."""
        out, unknown = [], []
        for p in parts:
            if isinstance(p, _Value) or len(p) == 3:
                out.append(p)
                continue
            token, span = p
            m = _IDENTIFIER.fullmatch(token)
            if m and m[1] in self.bound:
                out.append(self.bound[m[1]])
            else:
                unknown.append((len(out), m[1] if m else None, span))
                out.append(None)
        if len(out) == 1 and isinstance(out[0], _Value):
            return out[0]
        value = _Value(out, joined)
        for k, name, span in unknown:
            out[k] = (*span, False) if name is None else _Value([(*span, False)])
            if name is not None:
                self.later.append((out[k], name, span))
        return value if out else None

    def _line_words(self) -> dict[str, list[int]]:
        """Where the lines begin that begin with each word."""
        if self.words is None:
            self.words = {}
            for m in _LINE_WORD.finditer(self.text):
                self.words.setdefault(m[1], []).append(m.start())
        return self.words

    def _block(self, at: int, indent: int) -> tuple[_Value | None, int]:
        """The lines below ``at`` that are indented deeper than ``indent``."""
        begin = end = None
        while at < len(self.text):
            stop = self.text.find("\n", at)
            stop = len(self.text) if stop < 0 else stop
            line = self.text[at:stop]
            body = line.lstrip(" \t")
            if body.strip():
                if len(line) - len(body) <= indent:
                    break
                begin = stop - len(body) if begin is None else begin
                end = at + len(line.rstrip())
            at = stop + 1
        return (None if begin is None else _Value([(begin, end, True)])), min(at, len(self.text))

    # -- assignments
    def bind(self, names: list[str], value: _Value, scope: int, live: bool) -> None:
        own = max(sensitivity(n) for n in names)
        value.weight = max(value.weight, own or max(0, scope - 1))
        self.values.append(value)
        if live:
            for n in names:
                self.bound[n.lstrip("$")] = value

    def _braces(self, at: int) -> bool:
        """Whether the brace at ``at`` begins a list of literals."""
        m = _STRING.match(self.text, _GAP.match(self.text, at + 1).end())
        return m is not None and self.text[(end := _GAP.match(self.text, m.end()).end()) : end + 1] in (",", "}")

    def _items(self, at: int, names: list[str], scope: int) -> None:
        """Bind the plain items of the list whose first line begins at ``at``."""
        text, parts, indent = self.text, [], None
        while (m := _ITEM.match(text, at)) and indent in (None, len(m["indent"])):
            indent, end = len(m["indent"]), text.find("\n", at)
            end = len(text) if end < 0 else end
            own = _STRING.match(text, m.end()) or _BARE.match(text, m.end())
            if own and own.end() <= end and text[own.end() : own.end() + 1] in ("", "\n", "\r", " ", "\t") and not own[0].endswith(":"):
                parts.append((*own.span(own.lastgroup or 0), own.lastgroup is not None))
            at = end + 1
        if parts:
            self.bind(names, _Value(parts, False), scope, False)

    def _tuple(self, at: int) -> list[str]:
        """Names with commas after them right before ``at`` on its line."""
        text, start = self.text, self.start
        if text[at - 1 : at] not in (" ", ",", "\t") or "," not in text[max(start, at - 2) : at]:
            return []
        names, place = [], start
        while place < at and text[place] in " \t":
            place += 1
        while m := _TUPLE.match(text, place, at):
            names.append(m[0].rstrip(", \t"))
            place = m.end()
            while place < at and text[place] in " \t":
                place += 1
        return names if place == at else []

    def _pairs(self, names: list[str], at: int, scope: int, live: bool) -> int:
        """Bind each name to the value in its place."""
        for k, name in enumerate(names):
            value, at, _ = self.expression(at)
            if value is not None:
                self.bind([name], value, scope, live)
            comma = _SPACE.match(self.text, at).end()
            if k + 1 < len(names):
                if self.text[comma : comma + 1] != ",":
                    break
                at = comma + 1
        return at

    def run(self) -> None:
        text, at, pending = self.text, 0, []
        sections = [(m.start(), sensitivity(m["name"])) for m in _SECTION.finditer(text)] if "[" in text else []
        starts = [a for a, _ in sections]
        named: tuple[int, str] | None = None  # indent and literal of a key ``name``
        for m in _DEFINE.finditer(text) if "define" in text else ():
            if (value := self.expression(m.end())[0]) is not None:
                self.bind([m["name"]], value, 0, True)
        while m := _TARGET.search(text, at):
            name, op = m["name"], m["op"]
            scope = self._enter(m.start())
            if starts and (k := bisect_right(starts, m.start())):
                scope = max(scope, sections[k - 1][1])
            if m["element"] is not None:
                self.bind([name], _Value([(*m.span("element"), True)]), scope, False)
                at = m.end()
                continue
            indent, live = self.indent, not self.comment and op not in ("==", "===")
            value, chained, end = None, None, m.end()
            if op == ":" and (b := _BLOCK.match(text, end)):
                value, end = self._block(b.end(), indent)
            elif b := _HEREDOC.match(text, end):
                ends = self._line_words().get(b["end"], [])
                if (k := bisect_right(ends, b.end() - 1)) < len(ends):
                    value, end = _Value([(b.end(), max(b.end(), ends[k] - 1), True)]), text.find(b["end"], ends[k]) + len(b["end"])
            elif op == ":" and (b := _NESTED.match(text, end)):
                if len(b["indent"]) > indent or text.startswith("- ", b.end()):
                    self._items(b.end() - len(b["indent"]), [name], scope)
                if len(b["indent"]) > indent:
                    self.scopes.append(("indent", indent, max(scope, sensitivity(name))))
                at, pending = end, []
                continue
            elif text[(b := _SPACE.match(text, end).end()) : b + 1] == "{" and self._braces(b):
                value, end, _ = self.expression(b, True)
            elif text[b : b + 1] == "{" and not text.startswith("{{", b):
                self.scopes.append(("brace", self.depth + 1, max(scope, sensitivity(name))))
                at, pending = b, []
                continue
            elif op == "=" and (before := self._tuple(m.start())):
                end = self._pairs([*before, name], end, scope, live)
                at, pending = end, []
                self.braces_at = max(self.braces_at, at)
                continue
            else:
                value, end, chained = self.expression(end)
            if chained is not None:
                pending.append(name)
                at = end
                continue
            if m["type"] is not None and (head := _BARE.match(text, m.start("type"))):
                self.bind([name], _Value([(*head.span(), False)]), scope, False)
            names, pending = [*pending, name], []
            if value is not None:
                if op in ("+=", ".=") and name.lstrip("$") in self.bound:
                    value = _Value([self.bound[name.lstrip("$")], value])
                low = name.lower()
                if low in VALUE and named is not None and named[0] == indent:
                    names.append(named[1])
                self.bind(names, value, scope, live)
                if low in NAMING and (leaf := value.only()) is not None:
                    named = (indent, text[leaf[0] : leaf[1]])
            at = max(end, m.end())
            self.braces_at = max(self.braces_at, at)

    def found(self) -> set[tuple[int, int, int]]:
        """Spans of the literals that reach the threshold."""
        text = self.text
        for value, name, span in self.later:  # bound further down, or a bare literal
            if name in self.bound and self.bound[name] is not value:
                value.parts = [self.bound[name]]
        # weights go down to the values that a value stands for
        queue = sorted(self.values, key=lambda v: -v.weight)
        seen: dict[int, int] = {}
        while queue:
            rest = []
            for v in queue:
                if seen.get(id(v), -1) >= v.weight:
                    continue
                seen[id(v)] = v.weight
                if len(v.parts) == 1 and isinstance(v.parts[0], _Value):
                    under = v.parts[0]
                    if under.weight < v.weight:
                        under.weight = v.weight
                        rest.append(under)
            queue = rest
            self.values.extend(rest)
        order = self._children_first()
        wanted = {id(v) for v in order if v.weight >= 2 and v.joined}
        marked = self._folded(order, wanted)
        out: set[tuple[int, int, int]] = set()
        single: dict[int, int] = {}  # weight that reaches the literals below one by one
        for v in reversed(order):  # values before those that they are made of
            alone = max(single.get(id(v), 0), 0 if v.joined else v.weight)
            for p in v.parts:
                if isinstance(p, _Value):
                    if id(v) in marked:
                        marked.add(id(p))
                    single[id(p)] = max(single.get(id(p), 0), alone)
                elif p is not None and p[1] > p[0] and self._literal(p):
                    if id(v) in marked or (alone >= 2 and enough(alone, text[p[0] : p[1]], p[2])):
                        out.add((p[0], 3, p[1]))
        return out

    def _literal(self, p: tuple[int, int, bool]) -> bool:
        return p[2] or self._bare_literal(self.text[p[0] : p[1]])

    def _children_first(self) -> list[_Value]:
        """All values, each after those that it is made of; a value made of itself is looked at once."""
        out, state = [], {}
        for top in self.values:
            stack = [(top, iter(top.parts))] if id(top) not in state else []
            state.setdefault(id(top), 1)
            while stack:
                v, parts = stack[-1]
                under = next((p for p in parts if isinstance(p, _Value) and id(p) not in state), None)
                if under is None:
                    out.append(v)
                    stack.pop()
                else:
                    state[id(under)] = 1
                    stack.append((under, iter(under.parts)))
        return out

    def _folded(self, order: list[_Value], wanted: set[int]) -> set[int]:
        """Those of the wanted values whose literals, folded, are a secret. What is folded is let go after its last use."""
        uses = Counter(id(p) for v in order for p in v.parts if isinstance(p, _Value))
        folds: dict[int, _Fold] = {}
        found = set()
        for v in order:
            own = _Fold()
            for p in v.parts:
                if isinstance(p, _Value):
                    if id(p) in folds:
                        own.add(folds[id(p)])
                    uses[id(p)] -= 1
                    if not uses[id(p)]:
                        folds.pop(id(p), None)
                elif p is not None and self._literal(p):
                    own.add(_Fold(self.text[p[0] : p[1]], p[2]))
            if id(v) in wanted and own.enough(v.weight):
                found.add(id(v))
            if uses[id(v)]:
                folds[id(v)] = own
        return found

    def _bare_literal(self, token: str) -> bool:
        """A short bare word without digits, or one that is bound in the text, is a name."""
        return len(token) >= LONG or (token not in self.bound and any(c.isdigit() for c in token))


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of literals bound, directly or through other names, to sensitive names."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    lexer = _Lexer(text)
    lexer.run()
    return sorted(lexer.found())


def spans_of(text: str) -> tuple[list, list]:
    """Base spans, and all spans: a literal that a base span covers adds nothing."""
    base = base_spans(text)
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))  # furthest end of the spans so far
    extra = [s for s in lexed_spans(text) if not (k := bisect_right(starts, s[0])) or reach[k - 1] < s[2]]
    return base, sorted(base + extra)


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str) -> str:
    """The text with each maximal run of overlapping spans replaced by a mark naming its first kind."""
    out, at = [], 0
    _, spans = spans_of(text)
    k = 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"[REDACTED:{KINDS[kind]}]"]
        at = end
        k += 1
    return "".join([*out, text[at:]])


def _scan(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for (text,) in columns(batch, "text"):
            base, every = spans_of(text or "")
            n = Counter(k for _, k, _ in base)
            rows.append((n[0], n[1], n[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
        yield pa.record_batch([batch.column("doc_id"), *made], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. Map only.

    Null texts count as empty; texts of any length are read whole, in linear time; repeated rows and
    null ids stay; spans that start together go by kind; a name that is assigned to twice stands for what was assigned last
    before its use. Other columns are ignored. An empty table
    gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in text replaced by marks; every row and column stays, null texts, null ids, repeated rows and
    columns of any other name too. Map only; texts of any length are read whole. An empty table gives an empty result."""
    bounded_batches(docs.sparkSession)

    def clean(batches):
        for batch in batches:
            out = {n: batch.column(n) for n in batch.schema.names}
            out["text"] = pa.array([None if t is None else redact(t) for (t,) in columns(batch, "text")], pa.string())
            yield pa.record_batch(out)

    return docs.mapInArrow(clean, docs.schema)
