"""HTML main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between block-level tags, each with its open
ancestors. Features of a block are its ancestor tags, the words of their class, id and role
attributes, and properties of its text (length, words, links, marks, place). A two-state chain
(main text or not) is trained by maximum likelihood on labelled pages, by forward-backward on all
pages at once, and decoded by Viterbi.

Labelled pages are (html, main text) pairs, a line of text for each block; `example_pages` lays out a fixed number of them in the
usual page designs. Training takes a bounded list of them on the driver; extraction runs page by page
over Arrow batches and has no shuffle. Open elements are linked to their parents and share what is known of
their ancestors, so a page takes time and memory in proportion to its length.

Defined results: null and empty pages, and pages without main text, give an empty text; character
references are decoded; white space in a block becomes one space; unclosed and stray tags, comments
and raw scripts are read as browsers do in the common cases; elements nested deeper than MAX_DEPTH are
siblings at that depth, as in browsers, and an element lends MAX_NAMES words of its names at most; very
long pages are read whole; every row gives one row, in whatever number it is repeated; an empty table
gives no rows; only the html and carried columns are read.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterable, Iterator, Set
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_batches, schema_of, text_or_empty
from ._text import slices

#: How a comment, a declaration or a tag begins, and what matters inside a tag.
OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*+))")
SPECIAL = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Depth of open elements, and words of an element's class, id and role that are looked at.
MAX_DEPTH, MAX_NAMES = 512, 32

# HTML elements by kind.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
INERT = frozenset("noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math mi mn mo ms mrow msub msup msubsup mfrac msqrt mroot mtext mspace semantics".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
LISTS = frozenset("ul ol dl table select".split())
END_OF = {name: re.compile(rf"</{name}\b", re.I) for name in RAW | INERT}


class Element:
    """An open element: its tag and parent, whether it is inside a link, and what its leaves inherit."""

    __slots__ = ("tag", "inside", "linked", "told", "leaf", "depth")

    def __init__(self, tag: str, parent: Element | None, names: tuple[str, ...]) -> None:
        self.tag = tag
        self.linked = tag == "a" or parent is not None and parent.linked
        told, leaf, depth = (parent.told, parent.leaf, parent.depth) if parent else (frozenset(), "none", 0)
        if tag in INLINE or tag in ("html", "body"):
            own = ()
        else:
            leaf, depth, own = tag, depth + 1, (f"in={tag}",)
        if tag not in INLINE:
            own = (*own, *(f"name={w}" for w in names))
        new = [x for x in own if x not in told]
        self.told, self.leaf, self.depth = told.union(new) if new else told, leaf, depth


@dataclass
class Block:
    """Text of a leaf, what its ancestors tell (features), the innermost one's tag, their number, and how many of its characters are links."""

    text: str
    told: frozenset[str]
    leaf: str
    depth: int
    linked: int


class Tags:
    """The tags of a page from front to back, (start, end, close, name, rest), in time linear in its length.

    A tag ends at the first ``>`` outside quotes or, where all are in quotes, at the first one. A search that
    meets the end of the page notes the quotes that it opened: whichever search opens one of them again meets it too.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.dead, self.endless = page, page.rfind(">"), set(), set()

    def _end(self, at: int) -> int:
        path: list[int] = []
        while at <= self.last and (m := SPECIAL.search(self.page, at)) is not None and m.start() <= self.last:
            if m[0] == ">":
                return m.end()
            quote = m.start()
            if quote in self.dead or (close := self.page.find(m[0], quote + 1)) < 0:
                path.append(quote)
                break
            path.append(quote)
            at = close + 1
        self.dead.update(path)
        return self.page.find(">", at if not path else path[0]) + 1

    def after(self, name: str, at: int) -> int | None:
        """The place after the end tag of a raw element, or None if there is none."""
        if name not in self.endless and at <= self.last and (m := END_OF[name].search(self.page, at)) and m.end() <= self.last:
            return self.page.index(">", m.end()) + 1
        self.endless.add(name)
        return None

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        while at <= self.last and (m := OPENS.search(self.page, at)) is not None:
            if m[1]:
                end = self.page.find("-->", m.end()) + 3
                return m.start(), end if end > 2 else len(self.page), "", "", ""
            if m.end() > self.last:
                at = m.start()
                break
            end = self._end(m.end()) if m[4] else self.page.index(">", m.end()) + 1
            return m.start(), end, m[3] or "", m[4] or "", self.page[m.end() : end - 1] if m[4] else ""
        # A comment that nothing closes swallows the rest.
        start = self.page.find("<!--", at)
        return None if start < 0 else (start, len(self.page), "", "", "")


def _names(attributes: str) -> tuple[str, ...]:
    found: list[str] = []
    for key, *values in ATTRIBUTE.findall(attributes):
        if key.lower() in ("hidden", "aria-hidden"):
            found += ["hidden"] if "false" not in values else []
        else:
            found += [w.lower() for w in islice((m[0] for m in NAME_PARTS.finditer("".join(values))), MAX_NAMES)]
    return tuple(found[:MAX_NAMES])


def leaf_blocks(page: str) -> list[Block]:
    blocks: list[Block] = []
    root = Element("html", None, ())
    stack: list[Element] = []
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html_lib.unescape("".join(buffer)).split())
            if text:
                top = stack[-1] if stack else root
                blocks.append(Block(text, top.told, top.leaf, top.depth, linked))
            buffer.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            buffer.append(text)
            if stack and stack[-1].linked:
                linked += len(text)

    at, tags = 0, Tags(page)
    while (found := tags.next(at)) is not None:
        start, end, close, name, rest = found
        say(page[at:start])
        at = end
        if not name:
            continue
        name = name.lower()
        if close:
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if name in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if name == "br":
            say(" ")
            continue
        if name in END_OF and not rest.endswith("/"):
            if (end := tags.after(name, at)) is not None:
                at = end
            elif name in RAW:  # what an unclosed one swallows, browsers do not show either
                at = len(page)
            continue
        if name not in INLINE:
            flush()
            # A block closes an open paragraph with what is inside it; list and table parts their like.
            closes = CLOSES.get(name, frozenset())
            for k in range(len(stack) - 1, -1, -1):
                tag = stack[k].tag
                if tag in LISTS or tag not in INLINE and tag != "p" and tag not in closes:
                    break
                if tag == "p" or tag in closes:
                    del stack[k:]
        if name not in VOID and not rest.endswith("/"):
            if len(stack) >= MAX_DEPTH:
                flush()
                stack.pop()
            stack.append(Element(name, stack[-1] if stack else root, _names(rest) if "=" in rest or "hidden" in rest else ()))
    say(page[at:])
    flush()
    return blocks


def _bucket(n: int, marks: tuple[int, ...]) -> int:
    return sum(n >= m for m in marks)


def features(blocks: list[Block], known: Set[str] | None = None) -> list[list[str]]:
    """The features of every block; of what ancestors tell only the known ones, if given."""
    out = []
    for k, b in enumerate(blocks):
        text, n = b.text, len(b.text)
        n_words = text.count(" ") + 1
        own = ["bias", f"leaf={b.leaf}", f"words={_bucket(n_words, (2, 4, 8, 16, 32, 64))}", f"links={_bucket(100 * b.linked // n, (1, 30, 70))}"]
        own += b.told if known is None else b.told & known
        own += [f"end={'dot' if text[-1] in '.!?:;…”\"»)' else 'open'}", f"marks={_bucket(text.count(',') + text.count('. '), (1, 3, 6))}", f"depth={min(b.depth, 6)}"]
        if k == 0 or k == len(blocks) - 1:
            own.append("first" if k == 0 else "last")
        if "©" in text or "(c)" in text:
            own.append("copyright")
        out.append(sorted(own))
    return out


@dataclass(frozen=True)
class Field:
    """Trained weights: feature -> (not main, main), transitions and start scores."""

    weights: dict[str, tuple[float, float]]
    moves: np.ndarray
    start: np.ndarray

    def decode(self, found: list[list[str]]) -> list[bool]:
        """Viterbi: the most likely states of a page's blocks."""
        if not found:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        none, back = (0.0, 0.0), []
        a, b = self.start.tolist()
        for k, own in enumerate(found):
            if k:
                from_a, from_b = a + m00 >= b + m10, a + m01 >= b + m11
                a, b = (a + m00 if from_a else b + m10), (a + m01 if from_b else b + m11)
                back.append((not from_a, not from_b))
            for name in own:
                x, y = self.weights.get(name, none)
                a += x
                b += y
        state, states = b > a, []
        for from_a, from_b in reversed(back):
            states.append(state)
            state = from_b if state else from_a
        return [*reversed([*states, state])]


def fit(pages: Iterable[tuple[str, str]], steps: int = 300, ridge: float = 0.002, rate: float = 0.5) -> Field:
    """Maximum likelihood by forward-backward and AdaGrad. pages: (html, main text); a block is main
    if its text is a line of the main text."""
    found, states = [], []
    for page, main in pages:
        if blocks := leaf_blocks(page):
            found.append(features(blocks))
            lines = set(main.split("\n"))
            states.append([b.text in lines for b in blocks])
    names = {name: i for i, name in enumerate(sorted({n for page in found for own in page for n in own}))}
    length = np.array([len(p) for p in found])
    n, longest = len(found), length.max()
    y = np.zeros((n, longest), dtype=np.int64)
    on = np.arange(longest)[None, :] < length[:, None]
    x = np.zeros((int(length.sum()), len(names)), dtype=np.float32)  # the blocks of all pages in a row
    row = 0
    for i, page in enumerate(found):
        y[i, : len(page)] = states[i]
        for own in page:
            x[row, [names[name] for name in own]] = 1
            row += 1
    w, moves, start = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    past = [np.full_like(p, 1e-8) for p in (w, moves, start)]
    for _ in range(steps):
        unary = np.zeros((n, longest, 2))
        unary[on] = x @ w.astype(np.float32)
        single, pair, first = gradients(unary, moves, start, y, on)
        grads = (x.T @ single[on].astype(np.float32) / n - ridge * w, pair / n - ridge * moves, first / n - ridge * start)
        for value, seen, grad in zip((w, moves, start), past, grads, strict=True):
            seen += grad**2
            value += rate * grad / np.sqrt(seen)
    return Field({name: (float(w[i, 0]), float(w[i, 1])) for name, i in names.items()}, moves, start)


def _log_sum(v: np.ndarray, axis: int) -> np.ndarray:
    top = v.max(axis=axis, keepdims=True)
    return (np.log(np.exp(v - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def gradients(unary: np.ndarray, moves: np.ndarray, start: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed minus expected states (pages x blocks x 2), moves (2 x 2) and first states (2), by forward-backward."""
    n, longest, _ = unary.shape
    hot = np.eye(2)[y] * on[:, :, None]
    both = on[:, 1:, None, None] * hot[:, :-1, :, None] * hot[:, 1:, None, :]
    ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    ahead[:, 0] = unary[:, 0] + start
    for t in range(1, longest):
        step = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + unary[:, t]
        ahead[:, t] = np.where(on[:, t, None], step, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        step = _log_sum(moves + (unary[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(on[:, t + 1, None], step, 0)
    total = _log_sum(ahead[:, -1], 1)
    p = np.exp(ahead + behind - total[:, None, None]) * on[:, :, None]
    pair = np.exp(ahead[:, :-1, :, None] + moves + (unary[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * on[:, 1:, None, None]
    return hot - p, (both - pair).sum(axis=(0, 1)), (hot - p)[:, 0].sum(axis=0)


@lru_cache(maxsize=1)
def usual_field() -> Field:
    """The field fitted on `example_pages`, once a process."""
    return fit(example_pages())


def example_pages(n: int = 160, seed: int = 7) -> list[tuple[str, str]]:
    """Labelled pages in the usual designs, with invented words."""
    draw = random.Random(seed)
    syllables = "ba ce di fo gu la me ni or pu ra se ti un va wi xe yo zu ert ing ous ély ße ñar".split()

    def sentence(low: int, high: int) -> str:
        words = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(draw.randint(low, high))]
        return (" ".join(words)).capitalize().replace(" ", draw.choice([" ", ", "]), 1) + draw.choice("....!?")

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence(4, 18) for _ in range(draw.randint(low, high)))

    def title() -> str:
        return sentence(3, 9).rstrip(".!?")

    def menu(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{title() if draw.random() < 0.3 else draw.choice(syllables) * 2}</a></li>' for i in range(k)) + "</ul>"

    def pick(*options: str) -> str:
        return draw.choice(options)

    pages = []
    for _ in range(n):
        main: list[str] = []

        def told(tag: str, text: str, main: list[str] = main) -> str:
            main.append(text)
            cut = text.find(" ", len(text) // 2)
            shown = f"{text[:cut]} <{(i := pick('b', 'em', 'a'))}>{text[cut + 1:]}</{i}>" if cut > 0 and draw.random() < 0.2 else text
            return f"<{tag}>{shown}" + (f"</{tag}>" if draw.random() < 0.9 else "")

        body = told(pick("h1", "h1", "h2"), title())
        for _ in range(draw.randint(1, 8)):
            kind = draw.random()
            if kind < 0.72:
                body += told("p", prose(1, 6))
            elif kind < 0.8:
                body += told("h2", title())
            elif kind < 0.87:
                body += "<ul>" + "".join(told("li", sentence(3, 14)) for _ in range(3)) + "</ul>"
            elif kind < 0.92:
                body += "<blockquote>" + told("p", prose(1, 2)) + "</blockquote>"
            elif kind < 0.94:
                kin = pick("comments", "comment", "reader-comments", "responses", "discussion")
                body += f'<{(t := pick("div", "section"))} {pick("id", "class")}="{kin}">' + "".join(f"<p>{prose(1, 3)}</p>" for _ in range(draw.randint(1, 2))) + f"</{t}>"
            elif kind < 0.97:
                body += f'<div class="{pick("ad", "advert", "ads banner", "sponsored promo")}">{prose(1, 2)}</div>'
            else:
                body += f'<{(t := pick("aside", "div"))} class="{pick("related", "share social", "newsletter signup")}"><p>{sentence(3, 12)}</p></{t}>'
        nav = pick(f"<nav>{menu(6)}</nav>", f'<div class="{pick("menu", "nav navbar", "navigation", "breadcrumb")}">{menu(4)}</div>', f'<div id="menu">{menu(5)}</div>')
        head = pick(f"<header><p>{title()}</p></header>", f'<div id="{pick("header", "masthead", "top")}"><span>{title()}</span></div>', f'<header class="site-header">{title()}</header>', "")
        ad = pick(f'<div class="ad">{prose(1, 2)}</div>', f'<div class="{pick("advertisement", "banner ad", "ads", "promo")}"><p>{prose(1, 2)}</p></div>', "")
        side = pick(f'<aside>{menu(3)}<p>{prose(1, 2)}</p></aside>', f'<div class="{pick("sidebar", "side widget", "related")}"><h3>{title()}</h3>{menu(4)}<p>{prose(1, 2)}</p></div>', "", "")
        notice = pick(f'<div class="{pick("cookie-notice", "cookie-banner", "consent", "notice", "alert popup", "gdpr-modal")}"><p>{prose(1, 2)}</p><button>{draw.choice(syllables)}</button></div>', "", "")
        form = pick(f'<form class="{pick("search", "login", "subscribe")}"><label>{title()}</label><select><option>{draw.choice(syllables)}<option>{title()}</select><input><button>{draw.choice(syllables)}</button></form>', "", "")
        said = "".join(f'<{(t := pick("div", "li", "p"))} class="{pick("comment", "reply", "comment-body")}">{prose(1, 4)}</{t}>' for _ in range(draw.randint(1, 4)))
        comments = pick(f'<{(t := pick("section", "div"))} {pick("id", "class")}="{pick("comments", "comment-list", "discussion responses", "disqus comments")}"><h3>{title()}</h3>{said}</{t}>', "", "")
        foot = pick(f"<footer>&copy; {title()} &middot; {prose(1, 2)}</footer>", f'<div id="footer"><p>{prose(1, 2)}</p></div>', f'<footer class="site-footer"><p>&copy; {title()}</p>{menu(3)}</footer>', f'<div class="{pick("footer", "copyright", "bottom")}">{prose(1, 1)}</div>')
        inside = draw.random() < 0.4 and comments
        open_, close = draw.choice([("<article>", "</article>"), ('<article class="post">', "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="content"><div class="post entry">', "</div></div>"), ('<div class="article-body">', "</div>"), ('<section class="story">', "</section>"), ('<div role="main">', "</div>"), ('<div class="text">', "</div>"), ("", ""), ("<table><tr><td>", "</td></tr></table>")])
        parts = [notice if draw.random() < 0.5 else "", head, nav, ad if draw.random() < 0.6 else "", form if draw.random() < 0.5 else "", open_ + body + (comments if inside else "") + close, "" if inside else comments, side, ad if draw.random() < 0.3 else "", form if draw.random() < 0.3 else "", notice if draw.random() < 0.3 else "", foot]
        whole = f"<!DOCTYPE html><html><head><title>{title()}</title><style>p{{margin:0}}</style></head><body>{''.join(parts)}" + pick("</body></html>", "")
        pages.append((whole, "\n".join(main)))
    return pages


def extract(pages: DataFrame, field: Field, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Carried columns (default page_id, url), text, n_blocks and n_main (leaf blocks in all and of main text)."""
    carry = ["page_id", "url"] if carry is None else carry
    plain = pages.select(*(F.col(f"`{c}`") for c in carry), text_or_empty(html).alias("_text"))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "_text"):
            texts, n_blocks, n_main = [], [], []
            for page in part.column("_text"):
                blocks = leaf_blocks(page.as_py())
                main = [b.text for b, m in zip(blocks, field.decode(features(blocks, field.weights.keys())), strict=True) if m]
                texts.append(" ".join(main))
                n_blocks.append(len(blocks))
                n_main.append(len(main))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(texts, pa.string()), pa.array(n_blocks, pa.int64()), pa.array(n_main, pa.int64())], names=[*carry, "text", "n_blocks", "n_main"])

    return map_batches(plain, rows, schema_of(plain.drop("_text"), ("text", "string"), ("n_blocks", "bigint"), ("n_main", "bigint")))
