"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tokens: words, and tags. Each has a score: the log-odds of its features, learned by counting on labelled pages. Words score
positive where main text stands and negative where boilerplate does; tags score negative. One linear scan finds the contiguous run of tokens
with the largest sum: the content region. What lies outside it is dropped for no other reason than that.

A word's features are the kind of element it stands in (paragraph, heading, item, cell, link in one of these, bare text), where it stands, or, if an element around
it is marked as boilerplate by its name, class, id or role, that mark alone. Where: in an element that holds main text (an article, a
main part, a class of content; on a page without any, the element with the most words in paragraphs of its own, and all that is in it unless it is the
page's body), off it on a page that has one, or apart on a page that has none; words of paragraphs there count by their block's length: short, middling, long. Names of classes only
shift weights: a class counts as a mark if its last part is a word of boilerplate, or if all of its parts are words of
boilerplate or of layout and one of boilerplate is among them; not if it begins with "has", "no" or the like. So "user-comments" is one, and
"form-factor" and "has-sidebar" are none. An element with a class of content isn't marked by its other classes, and within main text one whose class is a word of navigation
isn't marked if it has hardly any links.

Gaps: an element so marked whose own sum is below 0, with unmarked words that score positive both before and after it, is an island: its tokens count 0 in the scan,
so that the run can go on behind it, and its words are left out of the region. So an article in several parts with adverts, forms or menus between them is one run, if its parts score for themselves. Blocks
that the region cuts are taken whole if most of their words lie in it.

``labelled_pages`` writes labelled pages from layouts by rule; other pages can be given to ``fit``. Blocks are joined by one line feed; white space
inside a block becomes one space; character references are decoded. Whole pages are read, in one pass where they lie, in time linear in their
length; nothing is shuffled.

Defined cases: null or empty html, or no run with a positive sum: "". Markup that is cut off or nested wrongly ends elements as a browser would,
roughly: an unknown end tag is ignored, a missing one ends with its parent. Repeated rows give repeated results. Extra columns aren't read.
"""

from __future__ import annotations

import html as entities
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import LONG, STRING, batch_of, few_rows_a_batch, schema, small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: Elements whose content is no text of the page.
RAW = ("script", "style", "textarea", "noscript", "template", "svg", "iframe", "object", "select")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
_HINT = re.compile(r"\b(?:class|id|role|itemprop|aria-label|data-role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Kinds of the blocks that hold words of their own.
#: Words from which a block isn't short, and is long.
SHORT_BLOCK, LONG_BLOCK = 10, 25
KINDS = {"p": "flow", "pre": "flow", "blockquote": "flow", "figcaption": "flow", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "li": "item", "dt": "item", "dd": "item", "td": "cell", "th": "cell", "caption": "cell"}
#: Elements whose names mark boilerplate.
MARKED = frozenset("head title nav footer aside form button input label option menu dialog canvas audio video".split())
#: Words of a class, id or role that mark boilerplate, and words of layout that may stand beside them.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent cookie cookies copyright disqus footer form login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion promos reaction reactions reader recommended related replies reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets contentinfo alert".split())
#: Those that mark links only.
LINKS = frozenset("breadcrumb breadcrumbs menu menubar nav navbar navigation pager pagination tags toolbar topbar".split())
LAYOUT = frozenset("area bar block body bottom box button buttons center col column container content count cta feed fixed global group header holder inner item items label left line link links list main module outer page panel post posts primary right row secondary section site slot text this thread title top unit us wrap wrapper".split())
#: First parts with which a class says what an element has or lacks, not what it is.
SAYS = frozenset("has hide is no show with without".split())
#: Words in class, id, role or itemprop of elements that hold the main text, as article and main do.
CONTENT_WORDS = frozenset("article article-body article-content articlebody content entry entry-content main main-content page-content post post-body post-content story story-body".split())
#: Elements that an opening tag of a block closes, if the nearest open block is one of them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}


def names(attributes: str) -> list[str]:
    """Classes, ids and roles, lower-cased."""
    return [w for m in _HINT.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()]


def marks(name: str) -> bool:
    """Whether a class is one of boilerplate, see above; numbers among its parts don't count."""
    parts = [p for p in re.split(r"[-_]+", name) if p and not p.isdigit()]
    if not parts or (len(parts) > 1 and parts[0] in SAYS):
        return False
    return parts[-1] in MARKS or (any(p in MARKS for p in parts) and all(p in MARKS or p in LAYOUT for p in parts))


def only_links(tag: str, attributes: str) -> bool:
    """Whether what marks an element are classes of navigation alone, so that it has to have links."""
    own = [x for x in names(attributes) if marks(x)]
    return tag not in MARKED and not _HIDDEN.search(attributes) and bool(own) and all(MARKS.isdisjoint(set(re.split(r"[-_]+", x)) - LINKS) for x in own)


def marked(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element's name or attributes mark it as boilerplate; a header is one outside elements that hold main text."""
    if tag in MARKED or (tag == "header" and not in_main):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    own = names(attributes)
    return bool(_HIDDEN.search(attributes)) or (any(map(marks, own)) and CONTENT_WORDS.isdisjoint(own))


def holds_content(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or (bool(attributes) and tag in ("div", "section", "td") and not CONTENT_WORDS.isdisjoint(names(attributes)))


class Page:
    """The tokens of a page in order, one list an attribute: whether text, feature, whether marked, block, number of words, and the text."""

    def __init__(self, page: str) -> None:
        self.is_text: list[bool] = []
        self.feature: list[str] = []
        self.out: list[bool] = []
        self.block: list[int] = []
        self.words: list[int] = []
        self.text: list[str] = []
        #: Marked elements that stand in no other: first item, end, and whether in main text and marked by words of navigation only.
        self.islands: list[tuple[int, int, bool]] = []
        #: Whether an element says that it holds main text; of each element the first item, and where it ends; the page's body.
        self.explicit = False
        self.span: dict[int, tuple[int, int]] = {}
        self.body = 0
        #: Words in paragraphs and headings, and bare words, by the element around them.
        self.flow: Counter[int] = Counter()
        self.bare: Counter[int] = Counter()
        self.around: list[int] = []
        self.read(page)
        self.unmark()
        most = self.flow or self.bare
        #: The element with the most words in paragraphs of its own; on a page without paragraphs, with the most bare words.
        self.holder = max(most, key=lambda e: (most[e], -e)) if most and not self.explicit else None
        self.place()

    def unmark(self) -> None:
        """Takes marks of navigation off elements of main text without links to speak of."""
        kept = []
        for start, end, doubtful in self.islands:
            links = sum(n for f, n, t in zip(self.feature[start:end], self.words[start:end], self.is_text[start:end]) if t and f.startswith("link-"))
            every = sum(n for n, t in zip(self.words[start:end], self.is_text[start:end]) if t)
            if doubtful and 4 * links <= every:
                self.out[start:end] = [False] * (end - start)
            else:
                kept.append((start, end, doubtful))
        self.islands = kept

    def place(self) -> None:
        """Says of each word where it stands."""
        start, end = self.span.get(self.holder, (0, -1)) if self.holder is not None and self.holder != self.body else (0, -1)
        size: Counter[int] = Counter()
        for block, n, t in zip(self.block, self.words, self.is_text, strict=True):
            size[block] += n * t
        for i, f in enumerate(self.feature):
            if not self.is_text[i] or f.endswith("-in"):
                continue
            if not self.explicit and (start <= i < end or (self.holder is not None and self.around[i] == self.holder)):
                self.feature[i] = f + "-in"
                continue
            if f == "flow" and not self.explicit:
                n = size[self.block[i]]
                f += "-short" if n < SHORT_BLOCK else "-long" if n >= LONG_BLOCK else ""
            self.feature[i] = f + "-off" * self.explicit

    def add(self, is_text: bool, feature: str, out: bool, block: int, text: str = "", around: int = -1) -> None:
        self.around.append(around)
        self.is_text.append(is_text)
        self.feature.append(feature)
        self.out.append(out)
        self.block.append(block)
        self.words.append(len(text.split()) if is_text else 1)
        self.text.append(text)

    def read(self, page: str) -> None:
        # Of each open element: tag, number, kind of block, element around that block, whether it marks, holds main text, is a link.
        stack: list[tuple[str, int, str, int, bool, bool, bool]] = [("", 0, "bare", 0, False, False, False)]
        places: dict[str, list[int]] = {}
        blocks: list[int] = [0]
        number = itertools.count(1)
        begun = {}
        out = holders = links = mains = block = at = 0
        island = None
        n = len(page)

        def text(piece: str) -> None:
            if piece:
                kind, around = stack[-1][2:4]
                before = len(self.text)
                self.add(True, ("link-" if links else "") + kind + ("-in" if holders else ""), out > 0, block, piece, around)
                if not out and not links and kind in ("flow", "heading", "bare"):
                    (self.bare if kind == "bare" else self.flow)[around] += self.words[before]

        def close(to: int) -> None:
            nonlocal out, holders, links, mains, island
            while len(stack) > to:
                tag, me, _, _, marks_, holds, link = stack.pop()
                self.span[me] = (begun[me], len(self.text))
                places[tag].pop()
                if blocks[-1] == len(stack):
                    blocks.pop()
                holders -= holds
                links -= link
                mains -= tag in ("article", "main")
                if marks_:
                    out -= 1
                    if not out and island is not None:
                        self.islands.append((island[0], len(self.text), island[1]))
                        island = None

        while at < n:
            m = _TOKEN.search(page, at)
            if not m:
                text(page[at:])
                break
            text(page[at : m.start()])
            at = max(m.end(), at + 1)
            if not m[2]:
                continue
            tag, attributes = m[2].lower(), m[3] or ""
            if tag in BLOCKS or tag == "hr":
                block += 1
            if m[1]:
                self.add(False, tag, out > 0, block)
                if places.get(tag):
                    close(places[tag][-1])
                continue
            if tag in CLOSES or tag in BLOCKS:
                shut = CLOSES.get(tag, {"p"})
                top = len(stack) - 1 if tag == "option" else blocks[-1]
                if stack[top][0] in shut:
                    close(top)
            item = len(self.text)
            mark = marked(tag, attributes, mains > 0 or holders > 0)
            # A page inside one large form, as some servers write them: an article or main part of its own ends the mark.
            if tag in ("article", "main") and out and not mark and all(e[0] == "form" for e in stack if e[4]):
                out, island = 0, None
                for i, e in enumerate(stack):
                    if e[4]:
                        stack[i] = (*e[:4], False, *e[5:])
            self.add(False, tag, out > 0 or mark, block)
            if tag == "br":
                self.add(True, stack[-1][2] + ("-in" if holders else ""), out > 0, block, " ", stack[-1][3])
            if tag in _RAW_END:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else n
                continue
            if tag in VOID:
                if mark and not out:
                    self.islands.append((item, len(self.text), False))
                continue
            if mark and not out:
                island = (item, holders > 0 and only_links(tag, attributes))
            holds = not out and not mark and holds_content(tag, attributes)
            me = next(number)
            begun[me] = item
            self.explicit = self.explicit or holds
            self.body = me if tag == "body" else self.body
            kind, around = (KINDS[tag], stack[-1][1]) if tag in KINDS else ("bare", me) if tag in BLOCKS else stack[-1][2:4]
            if tag in BLOCKS:
                blocks.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, me, kind, around, mark, holds, tag == "a"))
            out += mark
            holders += holds
            links += tag == "a"
            mains += tag in ("article", "main")
        close(1)


def features(page: Page) -> Iterator[tuple[list[str], int]]:
    """Features of each item, and how often they count: an unmarked word's kind and place, a word's mark, a tag's name."""
    for is_text, feature, out, n in zip(page.is_text, page.feature, page.out, page.words, strict=True):
        yield [f"t:{feature}"] if not is_text else ["w:out"] if out else [f"w:{feature}", "w:clear"], n


def fit(pages: Iterable[tuple[str, str, str]]) -> dict[str, float]:
    """Weights from labelled pages: the markup before the main part, the main part's, and what comes after it.

    Smoothed log-odds of words' kinds, of words' marks and of tags, each among its own. Tags score negative, as the method has it: -0.02 at least.
    A kind of word that no page has in its place scores 0.
    """
    inside, outside = Counter(), Counter()
    for before, main, after in pages:
        page = Page(before + main + after)
        a, z = len(Page(before).text), len(Page(before + main).text)
        for i, (own, n) in enumerate(features(page)):
            for f in own:
                (inside if a <= i < z else outside)[f] += n
    families = {"kind": lambda f: f[0] == "w" and f not in ("w:out", "w:clear"), "mark": lambda f: f in ("w:out", "w:clear"), "tag": lambda f: f[0] == "t"}
    weights = {}
    for family, own in families.items():
        known = [f for f in inside.keys() | outside.keys() if own(f)]
        total_in, total_out = (sum(c[f] for f in known) for c in (inside, outside))
        for f in known:
            odds = math.log((inside[f] + 0.5) / (total_in + 0.5 * len(known))) - math.log((outside[f] + 0.5) / (total_out + 0.5 * len(known)))
            weights[f] = min(-0.02, odds) if family == "tag" else odds
    return weights


def labelled_pages() -> list[tuple[str, str, str]]:
    """Pages in three parts by rule: layouts of menus, headers, adverts, notices, asides, forms, comments, footers, marked by class, by element or not
    at all, around articles of several shapes: paragraphs, lists, tables, quotations, formulas, links in paragraphs, bare text with line breaks."""
    say = lambda n, k: " ".join(f"w{(k * 7 + i * 13) % 97}" for i in range(n))
    menu = lambda k: "<ul>" + "".join(f'<li><a href="/{i}">{say(1 + i % 2, k + i)}</a></li>' for i in range(4 + k % 4)) + "</ul>"

    def body(k: int) -> str:
        parts = [f"<h1>{say(4 + k % 6, k)}</h1>"]
        for i in range(1 + k % 6):
            inner = say(3 + 17 * (i + k) % 90, k + i) + (f" <b>{say(2, i)}</b>" if i % 3 == 0 else "") + (f' <a href="/x">{say(2, i)}</a> {say(9, i)}' if i % 2 else "")
            parts.append(f"<p>{inner}</p>" if (k + i) % 7 else f"{inner}<br><br>")
        if k % 3 == 2:
            parts.append(f"<h2>{say(4, k)}</h2><ul>" + "".join(f"<li>{say(7 + i, k + i)}</li>" for i in range(3)) + f"</ul><blockquote>{say(15, k)}</blockquote>")
        if k % 5 == 1:
            parts.append("<table>" + "".join(f"<tr><td>{say(1, i)}</td><td>{say(2, k + i)}</td></tr>" for i in range(5 + k % 9)) + f"</table><p>{say(12, k)}</p>")
        if k % 7 == 3:
            parts.append(f"<p>{say(5, k)} <math><mi>{say(1, k)}</mi><mo>=</mo><mn>{k}</mn></math> {say(4, k)}</p>")
        if k % 5 == 3:  # lists of links, of one or many, between paragraphs
            parts.insert(1 + k % 2, "<ul>" + "".join(f'<li><a href="/{i}">{say(1 + (i + k) % 5, k + i)}</a></li>' for i in range(2 + k % 19)) + "</ul>")
            parts.append(f"<p>{say(20, k)}</p>")
        if k % 6 == 4:
            parts.append("<ol>" + "".join(f'<li>{say(3, k + i)} <a href="/{i}">{say(2, i)}</a></li>' for i in range(3)) + f"</ol><h3>{say(3, k)}</h3><p>{say(40, k)}</p>")
        return "".join(parts)

    out = []
    for k in range(120):
        marked_ = k % 4 != 3
        ad = f'<div class="ad">{say(8 + k % 9, k)}</div>' if marked_ else f"<div>{say(8 + k % 9, k)}</div>"
        top = f"<!DOCTYPE html><html><head><title>{say(6, k)}</title></head><body>" + (f"<nav>{menu(k)}</nav>" if marked_ else f"<div>{menu(k)}</div>")
        top += f'<div><a href="/a">{say(1, k)}</a> | <a href="/b">{say(2, k)}</a></div>' if k % 6 == 1 else ""
        top += (f"<header>{say(5, k)}</header>" if k % 3 else "") + (ad if k % 2 else "") + (f'<div class="cookie-notice"><p>{say(11, k)}</p><button>{say(1, k)}</button></div>' if k % 5 == 2 else "")
        end = (f'<section class="comments"><h3>{say(2, k)}</h3><p>{say(12, k)}</p><p>{say(9, k)}</p></section>' if k % 3 == 0 else f"<aside>{menu(k + 1)}</aside>" if marked_ else f"<div>{menu(k + 2)}</div>")
        if k % 10 in (4, 9):  # readers' words in elements without names
            end = f"<div><h3>{say(1, k)}</h3>" + "".join(f"<div><p>{say(1 + i % 2, k + i)}</p><p>{say(3 + (5 * i + k) % 7, k + i)}</p></div>" for i in range(3 + k % 5)) + "</div>" + end
        end += (f'<form><label>{say(2, k)}</label><input name="q"><button>{say(1, k)}</button></form>' if k % 4 == 1 else "") + (f"<footer>&copy; {say(9, k)}</footer>" if k % 5 else f"<div>&copy; {say(9, k)}</div>") + "</body></html>"
        shell = (("<article>", "</article>"), ('<div class="content">', "</div>"), ("<main>", "</main>"), ("<div>", "</div>"))[k % 4 if k % 8 else 3]
        between = (ad if marked_ else "") if k % 16 else f"<aside>{say(9, k)}</aside>"
        main = between.join(f"<div>{body(k + j)}</div>" for j in range(2)) if k % 8 == 0 else body(k)  # some articles stand in sections without names
        out.append((top, shell[0] + main + shell[1], end))
    return out


_weights: dict[str, float] = {}


def default_weights() -> dict[str, float]:
    if not _weights:
        _weights.update(fit(labelled_pages()))
    return _weights


def region(scores: list[float]) -> tuple[int, int]:
    """From and to of the contiguous run with the largest sum; the first, if several have it; (0, 0) if none is over 0."""
    best, where, now, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if now <= 0:
            now, start = 0.0, i
        now += s
        if now > best:
            best, where = now, (start, i + 1)
    return where


def score(page: Page, weights: dict[str, float]) -> list[float]:
    """The score of each item: the sum of its features' weights times its words."""
    # A kind that no labelled page has in its place counts nothing there; a tag that none has counts as the least of tags.
    of = lambda f: weights.get(f, 0.0 if f[0] == "w" else -0.02)
    known = {f: of(f) for f in {"w:out", "w:clear", *(("w:" if t else "t:") + f for t, f in zip(page.is_text, page.feature, strict=True))}}
    return [(known["w:out"] if out else known["w:" + f] + known["w:clear"]) * n if is_text else known["t:" + f] for is_text, f, out, n in zip(page.is_text, page.feature, page.out, page.words, strict=True)]


def extract(page: str | None, weights: dict[str, float] | None = None, choose=region) -> str:
    """The main text of a page. ``choose``: finds the region from the scores."""
    if not page:
        return ""
    weights = weights or default_weights()
    items = Page(page)
    scores = score(items, weights)
    gap = [False] * len(scores)
    told = [i for i, (s, t, out) in enumerate(zip(scores, items.is_text, items.out, strict=True)) if s > 0 and t and not out]
    for start, end, _ in items.islands:
        if told and told[0] < start and end <= told[-1] and sum(scores[start:end]) < 0:
            gap[start:end] = [True] * (end - start)
            scores[start:end] = [0.0] * (end - start)
    a, z = choose(scores)
    parts: dict[int, list[str]] = {}
    inside: Counter[int] = Counter()
    every: Counter[int] = Counter()
    for i, (is_text, block, n, text) in enumerate(zip(items.is_text, items.block, items.words, items.text, strict=True)):
        if is_text and not gap[i]:
            parts.setdefault(block, []).append(text)
            every[block] += n
            inside[block] += n * (a <= i < z)
    lines = (" ".join(entities.unescape("".join(t)).split()) for b, t in parts.items() if 2 * inside[b] > every[b])
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, weights: dict[str, float] | None = None, carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``carry`` of pages (html) with text and n_chars."""
    few_rows_a_batch(pages.sparkSession)
    weights = weights or default_weights()
    chosen = pages.select(*carry, "html")
    kinds = T.StructType([*chosen.schema.fields[:-1], *schema(text=STRING, n_chars=LONG).fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = [extract(h, weights) for h in b.column("html").to_pylist()]
            yield batch_of(kinds, {c: b.column(c) for c in carry} | {"text": out, "n_chars": list(map(len, out))})

    return chosen.mapInArrow(rows, kinds)


def op1(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
