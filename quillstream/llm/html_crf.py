"""Main-text extraction: a linear-chain CRF over leaf blocks, decoded by Viterbi.

A page is cut into leaf blocks. Each has features of its ancestors (tags, and
words of their class, id and role, the innermost one apart) and of its text
(length, share of links, punctuation, ...). The chain has two labels, main text or
not; weights and transitions are learnt by maximum likelihood, with the forward
and backward recursions, from labelled pages. `labelled_pages` writes such pages
with a seed: menus, headers, notices, adverts, sidebars, forms, reader comments
and footers around, and inside, articles in many layouts.

Defined results: a null or empty page has empty text and 0 characters; text
outside of any block-level tag is a block, and is the text of a page that holds
nothing else; white space of any kind, no-break spaces included, becomes one space;
repeated pages give repeated rows; of two labellings that are equally likely, the one
with less text; an empty table gives no rows; only the three columns named are read, so
that others cannot clash. A page is handled whole, however long, one at a time, so
memory is bounded by the largest page.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .html_blocks import Block, Element, leaf_blocks
from .runtime import ship_package

# Words in class, id and role, by what they say about an element.
WORD_GROUPS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager toc skip tabs",
    "top": "header masthead topbar banner logo branding site hero",
    "bottom": "footer bottom copyright legal colophon contentinfo imprint",
    "side": "sidebar aside side rail widget widgets complementary secondary related recommended recommendations more trending popular",
    "notice": "notice notices cookie cookies consent gdpr alert alerts warning popup modal overlay dialog toast message announcement disclaimer",
    "advert": "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted dfp banner outbrain taboola",
    "form": "form login signin signup search subscribe subscription newsletter register contact",
    "comments": "comment comments commentlist reply replies respond response responses disqus discussion reviews feedback reader readers",
    "share": "share sharing social follow tweet facebook",
    "about": "meta byline author date tags tag category categories info caption credit",
    "main": "article content main post entry story body text articlebody single page prose markdown hentry",
}
_GROUP_OF = {w: g for g, ws in WORD_GROUPS.items() for w in reversed(ws.split())}
_MAIN_TAGS = ("article", "main")
_BESIDE_TAGS = ("nav", "header", "footer", "aside", "form", "dialog")


# Words of headings over reader comments, in several languages.
COMMENT_HEADINGS = (
    "comment comments replies responses discussion kommentar kommentare antworten diskussion commentaire commentaires réponses réactions "
    "comentario comentarios respuestas opiniones comentário comentários respostas commento commenti risposte reactie reacties opmerkingen "
    "kommentarer kommentaarit komentarz komentarze komentáře yorum yorumlar комментарий комментарии комментариев коментарі 评论 留言 評論 コメント 댓글"
)
_COMMENT_HEADING = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(COMMENT_HEADINGS.split(), key=len, reverse=True))})(?!\w)|评论|留言|評論|コメント|댓글")
_HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})


@functools.lru_cache(maxsize=20_000)
def _path_features(path: tuple[Element, ...]) -> tuple[str, ...]:
    found: dict[str, None] = {}
    near, inside = "none", False
    for e in path:
        found[f"in:{e.tag}"] = None
        if e.hidden:
            found["hidden"] = None
        groups = [g for w in e.words if (g := _GROUP_OF.get(w))]
        # A word for something beside the text outweighs one for the text on the same element.
        groups = sorted(groups, key=lambda g: g == "main")
        for g in groups:
            found[f"word:{g}"] = None
            if inside and g != "main":
                found[f"deeper:{g}"] = None
        if inside and e.tag in _BESIDE_TAGS:
            found[f"deeper:<{e.tag}>"] = None
        if groups:
            near = groups[0]
        elif e.tag in (*_MAIN_TAGS, *_BESIDE_TAGS):
            near = f"<{e.tag}>"
        inside = inside or e.tag in _MAIN_TAGS or groups[:1] == ["main"]
    blocks = [e.tag for e in path if e.tag not in ("a", "span", "b", "i", "em", "strong")]
    found[f"near:{near}"] = None
    found[f"own:{blocks[-1] if blocks else 'none'}"] = None
    if len(blocks) > 1:
        found[f"parent:{blocks[-2]}"] = None
    if any(e.tag in _MAIN_TAGS for e in path):
        found["inside"] = None
    return tuple(found)


def _near(features: tuple[str, ...]) -> str:
    return next(f for f in features if f.startswith("near:"))


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that each block has."""
    paths = [_path_features(b.path) for b in blocks]
    has_main = any("inside" in p for p in paths)
    named = any("word:main" in p for p in paths)
    under: tuple[Element, ...] | None = None  # what holds the last heading, if that announces comments
    out = []
    for i, (b, p) in enumerate(zip(blocks, paths, strict=True)):
        n = len(b.text)
        density = b.linked / n
        f = [*p, "bias", f"chars:{_bucket(n, (12, 30, 80, 200))}", f"links:{_bucket(density, (0.01, 0.35, 0.8))}"]
        last = b.text[-1]
        f.append("stop" if last in ".!?…" else "nostop")
        lowered = b.text.lower()
        if "©" in lowered or "(c)" in lowered or "copyright" in lowered or "rights reserved" in lowered:
            f.append("copyright")
        f.append(f"before:{_near(paths[i - 1])}" if i else "first")
        f.append(f"behind:{_near(paths[i + 1])}" if i + 1 < len(paths) else "last")
        if b.path[-1].tag in _HEADINGS:
            under = b.path[:-1] if len(b.text) < 60 and _COMMENT_HEADING.search(lowered) else None
        if under is not None and b.path[: len(under)] == under:
            f.append("under:comments")
        if len(blocks) == 1:
            f.append("alone")
        inside = "inside" in p
        f.append(f"page:{'main' if has_main else 'named' if named else 'plain'}:{'in' if inside or (not has_main and 'word:main' in p) else 'out'}")
        out.append(f)
    return out


class Crf:
    """Two labels; a weight per feature for label 1, transitions, and a start weight."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.index, self.weights, self.moves, self.start = index, weights, moves, start
        self.table = {f: float(weights[i]) for f, i in index.items()}

    def emissions(self, blocks: list[Block]) -> list[float]:
        get = self.table.get
        return [sum(get(f, 0.0) for f in fs) for fs in block_features(blocks)]

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi: the likeliest labels."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        scores = self.emissions(blocks)
        a, b = float(self.start[0]), float(self.start[1]) + scores[0]
        back = []
        for e in scores[1:]:
            stay0, from1 = a + m00, b + m10
            from0, stay1 = a + m01, b + m11
            back.append((stay0 < from1, from0 < stay1))
            a, b = max(stay0, from1), max(from0, stay1) + e
        label = int(b > a)
        labels = [label]
        for pointers in reversed(back):
            label = int(pointers[label])
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 250, ridge: float = 0.002) -> Crf:
    """Maximum likelihood with a ridge, by Adam; all pages advance together through the recursions."""
    pages = [p for p in pages if p[0]]
    named = [block_features(b) for b, _ in pages]
    index: dict[str, int] = {}
    for page in named:
        for fs in page:
            for f in fs:
                index.setdefault(f, len(index))
    widest, n = max(map(len, named)), len(named)
    where = [(i, t, index[f]) for i, page in enumerate(named) for t, fs in enumerate(page) for f in fs]
    slot = np.array([i * widest + t for i, t, _ in where])
    feature = np.array([f for _, _, f in where])
    length = np.array([len(p) for p in named])
    y = np.zeros((n, widest), dtype=np.int64)
    for i, (_, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
    mask = np.arange(widest)[None, :] < length[:, None]
    pair = mask[:, 1:]
    w, moves, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    params = [w, moves, start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        e1 = np.bincount(slot, weights=w[feature], minlength=n * widest).reshape(n, widest)
        emit = np.stack([np.zeros_like(e1), e1], axis=2)
        forward, backward = np.zeros((n, widest, 2)), np.zeros((n, widest, 2))
        forward[:, 0] = start + emit[:, 0]
        for t in range(1, widest):
            new = np.logaddexp(forward[:, t - 1, 0, None] + moves[0], forward[:, t - 1, 1, None] + moves[1]) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(widest - 2, -1, -1):
            nxt = emit[:, t + 1] + backward[:, t + 1]
            new = np.stack([np.logaddexp(moves[s, 0] + nxt[:, 0], moves[s, 1] + nxt[:, 1]) for s in (0, 1)], axis=1)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        p1 = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * mask
        wrong = ((p1 - y) * mask).ravel()
        grads = [np.bincount(feature, weights=wrong[slot], minlength=len(index)) / n + ridge * w]
        move_grad = np.zeros((2, 2))
        for s in (0, 1):
            for u in (0, 1):
                joint = np.exp(forward[:, :-1, s] + moves[s, u] + emit[:, 1:, u] + backward[:, 1:, u] - total[:, None]) * pair
                move_grad[s, u] = (joint.sum() - ((y[:, :-1] == s) & (y[:, 1:] == u) & pair).sum()) / n
        begin = p1[:, 0].sum() - y[:, 0].sum()
        grads += [move_grad + ridge * moves, np.array([-begin, begin]) / n + ridge * start]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Crf(index, w, moves, start)


class _Writer:
    """Writes one labelled page."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: set[str] = set()
        self.parts = "ta ren ko li sum pre dor ve nal ist or qua fen mi ul ger ich é ñ ö the on er".split()

    def word(self) -> str:
        return "".join(self.r.choices(self.parts, k=self.r.randint(1, 4)))

    def sentence(self, least: int = 1, most: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(least, most))]
        junk = self.r.random()
        if junk < 0.08:
            words = [w + self.r.choice(["***", "%%%", "###", "!!"]) for w in words]
        elif junk < 0.12:
            words = [w.upper() for w in words]
        return (" ".join(words)).capitalize() + ("." if self.r.random() < 0.8 else "")

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 6])))

    def attr(self, *names: str) -> str:
        name = self.r.choice(names)
        kind = self.r.choice(["class", "class", "id"])
        extra = self.r.choice(["", "", "-box", " wide", "-1", " clearfix"])
        return f' {kind}="{name}{extra}"'

    def links(self, n: int) -> list[str]:
        return [f'<a href="/{i}">{self.sentence(1, 3)}</a>' for i in range(n)]

    def menu(self) -> str:
        n = self.r.randint(2, 8)
        items = "".join(f"<li>{x}</li>" for x in self.links(n))
        return self.r.choice([
            f"<nav><ul>{items}</ul></nav>",
            f"<ul{self.attr('nav', 'menu', 'navbar', 'breadcrumbs')}>{items}</ul>",
            f"<div{self.attr('menu', 'main-menu', 'navigation', 'pagination', 'top-nav')}>{' | '.join(self.links(n))}</div>",
            f"<div role=\"navigation\">{' '.join(self.links(n))}</div>",
        ])

    def top(self) -> str:
        inner = self.r.choice([f"<h1>{self.sentence(1, 4)}</h1>", f"<p>{self.sentence()}</p>", f"<div>{self.sentence(1, 6)}</div>", self.sentence(1, 5)])
        inner += self.menu() if self.r.random() < 0.4 else ""
        return self.r.choice([f"<header>{inner}</header>", f"<div{self.attr('header', 'masthead', 'site-header', 'topbar', 'banner')}>{inner}</div>"])

    def bottom(self) -> str:
        inner = self.r.choice([f"&copy; {self.word()}.example {self.sentence()}", f"<p>{self.prose()}</p>", "<ul>" + "".join(f"<li>{x}</li>" for x in self.links(3)) + "</ul>"])
        if self.r.random() < 0.25:
            mark = self.r.choice(["&copy;", "(c)", "Copyright", "&copy; 2020", "All rights reserved"])
            return f"<{(t := self.r.choice(['div', 'p', 'small', 'address']))}>{mark} {self.sentence(1, 5)}</{t}>"
        return self.r.choice([f"<footer>{inner}</footer>", f"<div{self.attr('footer', 'site-footer', 'copyright', 'legal')}>{inner}</div>"])

    def notice(self) -> str:
        inner = self.r.choice([self.prose(), f"<p>{self.prose()}</p>", f"{self.sentence()} <button>{self.sentence(1, 2)}</button>"])
        if self.r.random() < 0.2:
            return self.r.choice([f"<dialog open>{inner}</dialog>", f'<div role="alert">{inner}</div>', f'<div style="display:none">{inner}</div>', f"<p hidden>{self.sentence()}</p>"])
        return f"<{(t := self.r.choice(['div', 'section', 'aside']))}{self.attr('cookie-banner', 'notice', 'alert', 'consent', 'cookies', 'popup', 'gdpr', 'warning')}>{inner}</{t}>"

    def advert(self) -> str:
        inner = self.r.choice([self.prose(), f"<p>{self.prose()}</p>", f"<a href='x'>{self.sentence()}</a>", f"<h3>{self.sentence(1, 4)}</h3><p>{self.prose()}</p>"])
        kinds = ["div", "div", "aside", "section"] + ["p", "ins"] * ("<p" not in inner and "<h3" not in inner)
        return f"<{(t := self.r.choice(kinds))}{self.attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot', 'adsbygoogle')}>{inner}</{t}>"

    def side(self) -> str:
        inner = self.r.choice([f"<h3>{self.sentence(1, 4)}</h3><ul>" + "".join(f"<li>{x}</li>" for x in self.links(4)) + "</ul>", f"<p>{self.prose()}</p>", f"<div>{self.prose()}</div>", self.sentence()])
        return self.r.choice([f"<aside>{inner}</aside>", f"<div{self.attr('sidebar', 'side', 'widget', 'related', 'recommended', 'right-sidebar')}>{inner}</div>", f"<aside{self.attr('sidebar')}>{inner}</aside>"])

    def form(self) -> str:
        inner = f"<label>{self.sentence(1, 3)}</label><input name='a'>" + self.r.choice(["", f"<p>{self.prose()}</p>"]) + f"<button>{self.sentence(1, 2)}</button>"
        inner = self.r.choice([inner, f"<fieldset><legend>{self.sentence(1, 3)}</legend>{inner}<select><option>{self.word()}</select></fieldset>"])
        if self.r.random() < 0.3:
            return f"<div{self.attr('newsletter', 'newsletter-signup', 'subscribe-box', 'login', 'register', 'contact')}><p>{self.prose()}</p></div>"
        return self.r.choice([f"<form action='/s'>{inner}</form>", f"<div{self.attr('newsletter', 'subscribe', 'search', 'login')}><form>{inner}</form></div>"])

    def comments(self) -> str:
        one = lambda: self.r.choice([
            f'<div class="comment"><b>{self.word()}</b><p>{self.prose()}</p></div>',
            f'<li class="comment"><p>{self.prose()}</p></li>',
            f'<article class="comment"><p>{self.prose()}</p></article>',
            f"<article><p>{self.prose()}</p></article>",
            f"<li><p>{self.prose()}</p></li>",
            f"<p>{self.prose()}</p>",
            f"<div>{self.prose()}</div>",
        ])
        inner = self.r.choice(["", f"<h3>{self.sentence(1, 3)}</h3>", f"<h2>{self.sentence(1, 3)}</h2>"]) + "".join(one() for _ in range(self.r.randint(1, 5)))
        if self.r.random() < 0.3:  # told by the heading alone
            word = self.r.choice(COMMENT_HEADINGS.split())
            said = self.r.choice([f"{self.r.randint(1, 90)} {word}", word.capitalize(), f"{word.capitalize()} ({self.r.randint(1, 90)})"])
            plain = "".join(one() for _ in range(self.r.randint(1, 4))).replace(' class="comment"', "")
            return f"<{(t := self.r.choice(['section', 'div']))}><{(h := self.r.choice(['h2', 'h3', 'h4']))}>{said}</{h}>{plain}</{t}>"
        title = self.r.choice(["", "", "", f"<h3>{self.sentence(1, 3)}</h3>", f"<h2>{self.sentence(1, 3)}</h2>"])
        return title + f"<{(t := self.r.choice(['div', 'section', 'ol']))}{self.attr('comments', 'user-comments', 'commentlist', 'disqus_thread', 'comment-list', 'comments-area', 'discussion', 'responses', 'reader-comments', 'reviews')}>{inner}</{t}>"

    def said(self, text: str) -> str:
        self.main.add(" ".join(text.split()))
        return text.replace("&", "&amp;").replace("<", "&lt;")

    def paragraph(self) -> str:
        r, text = self.r, self.said(self.prose())
        shape = r.random()
        if shape < 0.08:
            return f"<p><b>{text}</b></p>"
        if shape < 0.14:
            return f"<p><b>{text}<br>"
        if shape < 0.2:
            head, _, tail = text.partition(" ")
            return f'<p><a href="/x">{head}</a> {tail}</p>' if tail else f"<p>{head}</p>"
        if shape < 0.25:
            return f"<blockquote>{text}</blockquote>"
        if shape < 0.3:
            return "<ul>" + "".join(f"<li>{self.said(self.sentence())}</li>" for _ in range(3)) + f"</ul><p>{text}</p>"
        if shape < 0.33:
            return f"<pre>{text}</pre>"
        if shape < 0.36:
            return f"<table><tr><td>{text}<td>{self.said(self.sentence())}</table>"
        if shape < 0.42:
            return f"<div>{text}</div>"
        if shape < 0.5:
            return f"<{(t := r.choice(['h2', 'h3', 'h4']))}>{self.said(self.sentence(1, 5))}</{t}><p>{text}</p>"
        return f"<p>{text}" + r.choice(["</p>", "</p>", "</p>\n", ""])

    def article(self) -> str:
        r = self.r
        inner = f"<h1>{self.said(self.sentence(1, 6))}</h1>" if r.random() < 0.8 else ""
        for _ in range(r.choice([1, 1, 2, 4, 8, 20])):
            inner += self.paragraph()
            if r.random() < 0.15:
                inner += r.choice([self.advert, self.notice, self.form, self.side])()
        if r.random() < 0.1:
            inner += self.comments()
        shape = r.random()
        if shape < 0.4:
            return f"<article>{inner}</article>"
        if shape < 0.5:
            return f"<main>{inner}</main>"
        if shape < 0.62:
            return f"<main><article{self.attr('post', 'entry')}>{inner}</article></main>"
        if shape < 0.88:
            return f"<div{self.attr('content', 'post', 'entry-content', 'article-body', 'story', 'main', 'text', 'main-content', 'post-body')}>{inner}</div>"
        return r.choice([f"<section>{inner}</section>", f"<div>{inner}</div>", inner])

    def table_page(self) -> str:
        """A page laid out by a table: menus and links in cells beside the article's."""
        cell = lambda inner: f"<td{self.r.choice(['', ' width=160', ' valign=top'])}>{inner}</td>"
        menu = cell(self.r.choice([" ", "<br>", " | "]).join(self.links(self.r.randint(2, 7))))
        story = cell("".join(f"<p>{self.said(self.prose())}</p>" for _ in range(self.r.randint(1, 6))))
        top = f"<tr><td colspan=2>{self.menu()}</td></tr>" if self.r.random() < 0.3 else ""
        row = menu + story if self.r.random() < 0.7 else story + menu
        return f"<html><body><table>{top}<tr>{row}</tr></table></body></html>"

    def bare_page(self) -> str:
        """Text without block-level tags."""
        text = [self.prose() for _ in range(self.r.choice([1, 1, 2, 4]))]
        self.main.add(" ".join(" ".join(text).split()))
        plain = "<br>\n".join(text).replace("&", "&amp;")
        return self.r.choice([plain, f"<html><body>{plain}</body></html>", f"<title>{self.word()}</title>{plain}"])

    def page(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.06:
            return self.table_page()
        if kind < 0.1:
            return self.bare_page()
        some = lambda *kinds: "".join(k() for k in kinds if r.random() < 0.45)
        before = some(self.notice, self.top, self.menu, self.advert, self.form, self.side)
        after = some(self.advert, self.side, self.comments, self.form, self.notice, self.bottom)
        if r.random() < 0.5:
            before = self.menu() + before
        middle = before + self.article() + after
        if r.random() < 0.3:
            middle = f"<div{self.attr('wrapper', 'container', 'page', 'site')}>{middle}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{}}</style></head><body>{middle}</body></html>"


def labelled_pages(count: int = 1000, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of written pages."""
    out = []
    for k in range(count):
        writer = _Writer(seed * 100_000 + k)
        blocks = leaf_blocks(writer.page())
        out.append((blocks, [int(b.text in writer.main) for b in blocks]))
    return out


@functools.cache
def default_model() -> Crf:
    return train(labelled_pages())


def main_text(page: str | None, model: Crf) -> str:
    blocks = leaf_blocks(page) if page else []
    return "\n\n".join(b.text for b, label in zip(blocks, model.decode(blocks), strict=True) if label)


def extract(spark: SparkSession, pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    ship_package(spark)
    model = model or default_model()
    rows = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(p.as_py(), model) for p in part.column("html")]
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *made], ["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select("page_id", "url").schema)
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
