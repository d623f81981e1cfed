"""HTML to leaf blocks: the runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element classes of HTML.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes iframe noembed xmp".split())
#: Forms of a formula beside the one that is shown.
ANNOTATION = frozenset({"annotation", "annotation-xml"})
UNSEEN = ANNOTATION | frozenset("head script style noscript template svg select datalist object canvas audio video title textarea".split())
MATHML = frozenset(
    "math maction maligngroup malignmark menclose merror mfenced mfrac mglyph mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom "
    "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
INLINE = MATHML | ANNOTATION | frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr nobr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: An element that opens ends an open one of these, unless one of the elements behind "within" lies between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPE = frozenset({"annotation-xml", "table", "td", "th", "button", "object", "caption", "html"})
#: What may stand in head; anything else ends it, as its end tag may be left out.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
#: Elements inside which '/>' ends an element, those inside them that hold HTML again, and those that end them all.
FOREIGN = frozenset({"svg", "math"})
HTML_AGAIN = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BREAKS_OUT = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 hr li menu ol p pre table ul".split())

# A tag's end is in "end" if it has few attributes and short values; _Tags finds it otherwise.
_TOKEN = re.compile(
    r"<!--(?P<comment>)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?:(?P<attrs>(?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]{0,1024}+\"|'[^']{0,1024}+'|[^\s>\"'][^\s>]*+|(?=>))|(?!\s*+=))){0,32}+[\s/]*+)(?P<end>>))?+"
    r"|<[!?/][^>]*>"
)
_NAME_AND_VALUE = re.compile(r"[\s/]*+(?:(?P<end>>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:(?P<quote>[\"'])|[^\s>\"'][^\s>]*+)?+)?+)")
_ATTR = re.compile(r"(?<![^\s\"'/>=])([^\s\"'/>=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_WORDS = re.compile(r"[a-z]+")
_LAST_WORD = re.compile(r"(?<![a-zA-Z-])[a-zA-Z-]*+$")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class Element:
    tag: str
    words: tuple[str, ...] = ()
    """Words of class, id and role."""
    hidden: bool = False


@dataclass
class Block:
    text: str
    path: tuple[Element, ...]
    linked: int
    """Characters inside links."""


def _element(tag: str, attrs: str) -> Element:
    if "=" not in attrs:
        return Element(tag, (), bool(re.search(r"\bhidden\b", attrs)))
    found = {_LAST_WORD.search(k)[0].lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    words: list[str] = []
    for key in ("class", "id", "role", "itemprop"):
        if key in found:
            words += _WORDS.findall(_CAMEL.sub(" ", html.unescape(found[key])).lower())
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "display:none" in style or "visibility:hidden" in style or found.get("aria-hidden", "").lower() == "true"
    if "hidden" in attrs:
        attrs = _ATTR.sub(lambda m: m[0] if m[1].lower() in ("class", "id", "role", "itemprop") else " ", attrs)
    return Element(tag, tuple(dict.fromkeys(words)), hidden or bool(re.search(r"\shidden(?=\s|$)", attrs)))


class _Tags:
    """Ends of a page's tags, whatever the length of their values, in time linear in the page."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.lasts = {q: page.rfind(q) for q in "\"'"}
        self.open_ended: set[int] = set()  # places after values from where no tag ends

    def end(self, at: int) -> int:
        """The place of the '>' of the tag whose attributes start here, -1 if there is none.

        With a value whose quote is never closed, the tag ends at the first '>'.
        """
        if self.last < at:
            return -1
        seen, place = [], at
        while m := _NAME_AND_VALUE.match(self.page, place):
            place = m.end()
            if m["end"]:
                return place - 1
            if m["quote"]:
                if self.lasts[m["quote"]] < place:
                    break
                place = self.page.find(m["quote"], place) + 1
                if place in self.open_ended:
                    break
                seen.append(place)
        self.open_ended.update(seen)
        return self.page.find(">", at)


def _self_closed(attrs: str) -> bool:
    """Whether the slash at the end is the tag's, not an unquoted value's."""
    if not attrs.endswith("/"):
        return False
    last = max(map(attrs.rfind, " \t\n\r\f\"'")) + 1
    return "=" not in attrs[last:] and not attrs[:last].rstrip().endswith("=")


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks in order. Text in UNSEEN elements, in comments and in attributes of any length is none."""
    blocks: list[Block] = []
    stack: list[Element] = []
    foreign: list[bool] = []  # whether '/>' ends what stands in the element of the stack
    text: list[str] = []
    path: tuple[Element, ...] = ()  # where the block's first text stands
    linked = links = unseen = annotations = 0
    cache: dict[tuple[str, str], Element] = {}
    tags = _Tags(page)

    def flush() -> None:
        nonlocal linked, path
        if annotations:
            return
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                blocks.append(Block(whole, path, linked))
            text.clear()
        linked, path = 0, ()

    def pop_to(size: int) -> None:
        nonlocal links, unseen, annotations
        while len(stack) > size:
            e = stack.pop()
            foreign.pop()
            links -= e.tag == "a"
            unseen -= e.tag in UNSEEN
            annotations -= e.tag in ANNOTATION

    at, end = 0, len(page)
    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            mark = end
        m = _TOKEN.match(page, mark) if mark <= tags.last or page.startswith("<!--", mark) else None
        after = m.end() if m else end
        if m and m["name"] and not m["end"]:
            after = tags.end(m.end()) + 1
            m = m if after else None
        stop = mark if m or mark == end else mark + 1
        if stop > at and stack and stack[-1].tag == "head" and not page[at:stop].isspace():
            pop_to(len(stack) - 1)
        if stop > at and not unseen:
            piece = html.unescape(page[at:stop]) if "&" in page[at:stop] else page[at:stop]
            if not path and not piece.isspace():
                path = tuple(e for e in stack if e.tag not in INLINE or e.words or e.hidden) or (Element("body"),)
            text.append(piece)
            if links:
                linked += len(piece.strip())
        if mark == end:
            break
        if not m:
            at = stop
            continue
        at = after
        if m["comment"] is not None:
            close = page.find("-->", max(mark + 2, at - 2))
            at = end if close < 0 else close + 3
            continue
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["close"]:
            if tag in ("br", "p") and not any(e.tag == tag for e in stack):
                text.append(" ")
                if tag == "p":
                    flush()
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    if tag in INLINE and tag not in ANNOTATION and tag != "math" and any(e.tag not in INLINE for e in stack[i:]):
                        break  # an inline end tag doesn't end the blocks inside
                    pop_to(i)
                    if tag not in INLINE:
                        flush()
                    break
            continue
        if stack and stack[-1].tag == "head" and tag not in IN_HEAD:
            pop_to(len(stack) - 1)
        elif tag == "body" and unseen:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "head":
                    pop_to(i)
                    break
                if stack[i].tag in ("template", "body"):
                    break
        if tag in BREAKS_OUT and foreign and foreign[-1]:
            size = len(stack)
            while size and foreign[size - 1]:
                size -= 1
            pop_to(size)
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == "p":
                        pop_to(i)
                        break
                    if stack[i].tag in _SCOPE or stack[i].tag not in INLINE and stack[i].tag != "p":
                        break
            if tag in SIBLINGS:
                ends, within = SIBLINGS[tag]
                first = None
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in within or stack[i].tag == "annotation-xml":
                        break
                    if stack[i].tag in ends:
                        first = i
                if first is not None:
                    pop_to(first)
        elif tag == "a" and links:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "a":
                    pop_to(i)
                    break
        if tag in VOID:
            continue
        attrs = page[m.end("name") : after - 1]
        around = bool(foreign) and foreign[-1]
        if attrs.endswith("/") and (tag in ("path", "circle", "rect") or (around or tag in FOREIGN) and _self_closed(attrs)):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            begin, at = at, close.start() if close else end
            if tag == "xmp" and not unseen and not page[begin:at].isspace():  # shown as it is written
                text.append(page[begin:at])
                path = path or (*(e for e in stack if e.tag not in INLINE or e.words or e.hidden), Element("xmp"))
            if tag in UNSEEN:
                gt = page.find(">", at)
                at = end if gt < 0 else gt + 1
                continue
        key = (tag, attrs)
        element = cache.get(key) or cache.setdefault(key, _element(tag, attrs))
        stack.append(element)
        foreign.append(tag in FOREIGN or around and tag not in HTML_AGAIN)
        links += tag == "a"
        unseen += tag in UNSEEN
        annotations += tag in ANNOTATION
    pop_to(0)
    flush()
    return blocks
