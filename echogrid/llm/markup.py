"""Pages of HTML as flat trees: elements with their roles, runs of text, and what is boilerplate by its name.

A role is what tells occurrences of a tag apart: the path of elements from the
root with their class names and ids, numbers of pages left out. Parsing is one pass in
time linear in the page; missing end tags are implied as browsers imply them.
"""

from __future__ import annotations

import html as entities
import re
import sys

import xxhash

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their end tag, and none of it is shown.
RAW = frozenset("script style noscript iframe noembed noframes textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li listing main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Elements that start here close an open p.
CLOSES_P = BLOCK - {"body", "caption", "head", "html", "legend", "optgroup", "option", "tbody", "tfoot", "thead", "tr"} | {"hr"}
CELLS = frozenset(("td", "th"))
SCOPES = frozenset(("td", "th", "table", "caption", "object", "html", "template"))
#: An element ends where one of these starts beside it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody"), "thead": ("tr",)}
LISTS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CONTAINERS = frozenset("html body div section article main td center blockquote table tbody tr form fieldset".split())

# Elements, roles and words in class names and ids that mark what is no article text.
DROPPED = frozenset("head nav aside footer form dialog menu select button template svg canvas object audio video search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin share sharing social related recommended recommendations toolbar pagination pager search masthead topbar copyright sitemap".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies trackback trackbacks pingback pingbacks".split())
#: A class name with one of these tells of something else than the element itself.
ABOUT = frozenset("with without has no hide hides enable enabled".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>?|<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
_OF_NOTE = re.compile(r"class|id|role|hidden|style", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Numbers of pages, not of layouts: any in an id, long ones in a class name.
_DIGITS, _LONG = re.compile(r"\d+"), re.compile(r"\d{3,}")
_END = {n: re.compile(f"</{n}(?=[\\s/>]|\\Z)", re.I) for n in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

PLAIN, BOILER, COMMENT = 0, 1, 2


def _marks(names: list[str]) -> int:
    """What class names and ids say of their element."""
    found = PLAIN
    for name in names:
        words = {w.lower() for w in _NAMES.findall(name)}
        if words & ABOUT:
            continue
        if words & COMMENTS:
            return COMMENT
        if words & WORDS or ("header" in words and not words & {"entry", "post", "article", "content", "section"}):
            found = BOILER
    return found


def _attributes(text: str) -> tuple[str, int]:
    """The part of an element's role that its attributes make, and what they say of it."""
    a: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        a.setdefault(name.lower(), entities.unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    names = [*a.get("class", "").split(), *a.get("id", "").split()]
    role = a.get("role", "").lower()
    mark = _marks(names)
    if role in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        mark = mark or BOILER
    classes = sorted({_LONG.sub("#", n) for n in a.get("class", "").split()})
    return " ".join([".".join(classes), _DIGITS.sub("#", a.get("id", "")), role]).rstrip(), mark


class Names:
    """What a task has worked out of attributes and paths; forgotten when it grows."""

    def __init__(self, most: int = 100_000):
        self.most, self.attributes, self.roles = most, {}, {}

    def attribute(self, text: str) -> tuple[str, int]:
        if not _OF_NOTE.search(text):
            return "", PLAIN
        got = self.attributes.get(text)
        if got is None:
            if len(self.attributes) > self.most or len(text) > 1000:
                self.attributes.clear()
            got = self.attributes[text] = _attributes(text)
        return got

    def role(self, parent: int, tag: str, sign: str) -> int:
        key = (parent, tag, sign)
        got = self.roles.get(key)
        if got is None:
            if len(self.roles) > self.most:
                self.roles.clear()
            got = self.roles[key] = xxhash.xxh64_intdigest(f"{tag}\0{sign}", parent & 0x7FFFFFFFFFFFFFFF) >> 1
        return got


class Page:
    """tag, role, parent, mark of each element, an element before those in it; items in page order.

    An item is (element, text), or (element, None) where a block begins or
    ends, or (element, "") where the element begins; white space that separates
    (br, cells) is the text " ".
    """

    def __init__(self, html: str | None, names: Names):
        self.tag, self.role, self.parent, self.mark = ["#page"], [0], [-1], [PLAIN]
        self.items: list[tuple[int, str | None]] = [(0, "")]
        self._parse(html or "", names)
        self._settle()

    def _parse(self, html: str, names: Names) -> None:
        stack, where = [0], {}  # open elements; positions in it by name
        scopes, blocks = [0], [0]  # positions of scopes and of blocks
        tags, roles, items = self.tag, self.role, self.items

        def close(to: int) -> None:
            while len(stack) > to:
                tag = tags[stack.pop()]
                where[tag].pop()
                if tag in SCOPES:
                    scopes.pop()
                if tag in BLOCK:
                    blocks.pop()
                    items.append((stack[-1], None))
                elif tag in CELLS:
                    items.append((stack[-1], " "))

        def at(tag: str) -> int:
            got = where.get(tag)
            return got[-1] if got else 0

        pos, n = 0, len(html)
        while pos < n:
            m = _TAG.search(html, pos)
            start = m.start() if m else n
            if start > pos:
                text = entities.unescape(html[pos:start])
                if at("head") and not text.isspace():
                    close(at("head"))
                items.append((stack[-1], text))
            if not m:
                break
            pos, end = m.end(), m[1]
            tag = m[2]
            if tag is None:
                continue
            tag = sys.intern(tag.lower())
            if end:
                if tag == "br":
                    items.append((stack[-1], " "))
                elif tag not in ("html", "body"):
                    p = at(tag)
                    within = scopes[-1] if tag not in SCOPES else scopes[-2] if len(scopes) > 1 and p == scopes[-1] else scopes[-1] if p > scopes[-1] else 0
                    if p and p >= within and (tag in BLOCK or tag in CELLS or tag in SCOPES or p > blocks[-1]):
                        close(p)
                    elif tag == "p":
                        items.append((stack[-1], None))
                continue
            if at("head") and tag not in HEAD and tag != "head":
                close(at("head"))
            if tag in ("html", "body", "head") and at(tag):
                continue
            if tag in CLOSES_P and at("p") > scopes[-1]:
                close(at("p"))
            if tag in ENDS:
                wall = max([scopes[-1] if tag in LISTS else at("table"), *[at(t) for t in LISTS.get(tag, ())]])
                to = min([p for t in ENDS[tag] if (p := at(t)) > wall], default=0)
                if to:
                    close(to)
            if tag in VOID:
                if tag in ("br", "hr"):
                    items.append((stack[-1], " " if tag == "br" else None))
                continue
            sign, mark = names.attribute(m[3]) if m[3] else ("", PLAIN)
            if tag in RAW:
                stop = _END[tag].search(html, pos)
                pos = html.find(">", stop.end()) + 1 or n if stop else n
                continue
            node = len(tags)
            up = stack[-1]
            tags.append(tag)
            roles.append(names.role(roles[up], tag, sign))
            self.parent.append(up)
            self.mark.append(mark)
            where.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
                items.append((node, None))
            items.append((node, ""))
            stack.append(node)

    def _settle(self) -> None:
        """From what names say to what is boilerplate: of an element, all that is in it too."""
        n, tag, parent, mark = len(self.tag), self.tag, self.parent, self.mark
        holds = [False] * n  # an article, main or a headline
        whole = [False] * n  # an article or main
        for i in range(n - 1, 0, -1):
            if tag[i] in ("article", "main") and mark[i] != COMMENT:
                holds[i] = whole[i] = True
            holds[i] = holds[i] or tag[i] == "h1"
            if holds[i]:
                holds[parent[i]] = True
            if whole[i]:
                whole[parent[i]] = True
        inside = [False] * n
        for i in range(1, n):
            up, t = parent[i], tag[i]
            if mark[up]:
                mark[i] = mark[up]
                continue
            inside[i] = inside[up] or t in ("article", "main")
            if t in ("html", "body", "main") or (t == "article" and mark[i] != COMMENT):
                mark[i] = PLAIN
            elif mark[i] == BOILER and whole[i]:
                mark[i] = PLAIN
            elif not mark[i] and (t in DROPPED or (t == "header" and not inside[i])):
                mark[i] = PLAIN if whole[i] or (t == "form" and holds[i]) else BOILER

    def text(self, keep) -> str:
        """The blocks of the elements for which keep(element) holds, by one line end; white space inside is one space."""
        out: list[str] = []
        block: list[str] = []
        for node, text in self.items:
            if text is None:
                if block:
                    out.append(" ".join("".join(block).split()))
                    block = []
            elif text and keep[node]:
                block.append(text)
        if block:
            out.append(" ".join("".join(block).split()))
        return "\n".join(b for b in out if b)
