"""Main text of web pages by two passes over their blocks.

First every block is classified on its own: by the element it stands in, link density, length and the density of stop words.
A form, or a word in class, id or role that names page furniture, only counts as evidence against the blocks inside.
Then blocks that this left open take the label of the nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from recordmill.session import widen

# Element names, and words in class, id or role that mark what isn't the article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
                   "tfoot th thead tr ul".split())
UNSEEN = frozenset("head script style noscript template iframe object svg math canvas audio video select datalist button textarea".split())
APART = frozenset("nav aside footer menu search dialog".split())
ARTICLE = frozenset(("article", "main"))
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
                  "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
                  "signup login share sharing social related recommended comment comments commentlist respond replies disqus pagination "
                  "pager widget toolbar skip complementary contentinfo search".split())
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())  # what may well outweigh its article
STOP_WORDS = frozenset(
    "the of and to in is it that for was on are as with be by at from or an this have not he she they his her you we which but had has were a "
    "le la les de des du un une et est en que qui dans pour par sur au aux avec il elle pas ne ce se son sa ou "
    "der die das den dem des ein eine einer und ist in zu mit von auf für im nicht sich es als auch an bei er sie aus "
    "el los las del y es por con para se su al lo como más o pero una".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What a head may hold, and the elements that a start tag ends where their own end tag was left out.
HEAD = frozenset("html head title meta link base script style noscript template".split())
_CELLS = frozenset("p caption td th".split())
ENDS = dict.fromkeys(BLOCKS - {"html", "body"}, frozenset(("p",))) | {
    "li": frozenset(("p", "li")), **dict.fromkeys(("dt", "dd"), frozenset(("p", "dt", "dd"))), **dict.fromkeys(("td", "th"), _CELLS),
    "tr": _CELLS | {"tr"}, **dict.fromkeys(("thead", "tbody", "tfoot"), _CELLS | {"tr", "thead", "tbody", "tfoot"})}

MANY_LINKS = 0.5           # share of a block's characters inside links
LONG, LONG_MARKED = 70, 200  # characters; the latter where an element around the block is marked
STOPS_LOW, STOPS_HIGH = 0.1, 0.2
_WORDS = re.compile(r"\w+")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_PARTS = re.compile(r"[^a-z0-9]+")

GOOD, BAD, OPEN = 1, -1, 0


class Mark(NamedTuple):
    """A marked element: the mark around it or -1, its names, those of no element around it, and how many articles (2: or more) are."""

    outer: int
    names: frozenset[str]
    first: frozenset[str]
    depth: int


class Block(NamedTuple):
    """Text, characters inside links, whether it stands in an element apart from the article, and what is around it.

    That is the number of its outermost article or 0, how many articles (2: or more), and the innermost mark or -1.
    """

    text: str
    linked: int
    apart: bool
    article: int
    depth: int
    mark: int


class _Blocks(HTMLParser):
    """Blocks and marked elements of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.marks: list[Mark] = []
        self.mark = -1
        # Elements that hold blocks, what they are, the mark around them, and the place here of the innermost that isn't inline.
        self.open: list[tuple[str, str, int, int]] = []
        self.title = False
        self.names: Counter = Counter()
        self.marking: Counter = Counter()
        self.kinds: Counter = Counter()
        self.link = False
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.article = 0
        self.articles = 0

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            linked = len(" ".join("".join(self.linked).split()))
            self.blocks.append(Block(text, linked, self.kinds["apart"] > 0, self.article, self.depth(), self.mark))
        self.parts, self.linked = [], []

    def depth(self) -> int:
        return min(self.kinds["article"], 2)

    def kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[str, frozenset[str]]:
        """What an element is, and the names that mark it."""
        none: frozenset[str] = frozenset()
        if tag in UNSEEN:
            return "unseen", none
        if tag in ARTICLE:
            return "article", none
        if tag in APART or tag == "header" and not self.kinds["article"]:
            return "apart", none
        if tag in ("html", "body"):
            return "plain", none
        names = {"form"} if tag == "form" else set()
        for name, value in attrs:
            if name in ("class", "id", "role"):
                names.update(x for x in (value or "").lower().split() if not MARKS.isdisjoint(_PARTS.split(x)))
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return "unseen", none
        return ("marked", frozenset(names)) if names else ("plain", none)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.names["head"] and (tag == "body" or tag not in HEAD and not self.names["noscript"] and not self.names["template"]):
            self.end_head()
        if tag == "title":
            self.title = True
        if tag == "br":
            self.handle_data(" ")
        if tag == "a":
            self.link = any(name == "href" for name, _ in attrs)
        if tag in BLOCKS:
            self.end_block()
            self.link = False  # a link that was never closed
            while self.open and (at := self.open[-1][3]) >= 0 and self.open[at][0] in ENDS.get(tag, ()):
                while len(self.open) > at:
                    self.leave()
        kind, names = self.kind(tag, attrs) if tag not in VOID else ("plain", frozenset())
        if tag in VOID or tag not in BLOCKS and tag not in UNSEEN and kind == "plain":
            return
        if kind == "article" and not self.kinds["article"]:
            self.articles += 1
            self.article = self.articles
        if kind != "plain":
            self.end_block()
        inline = tag not in BLOCKS and tag not in UNSEEN
        self.open.append((tag, kind, self.mark, len(self.open) if not inline else self.open[-1][3] if self.open else -1))
        if kind == "marked":
            self.marks.append(Mark(self.mark, names, frozenset(x for x in names if not self.marking[x]), self.depth()))
            self.mark = len(self.marks) - 1
            self.marking.update(names)
        self.names[tag] += 1
        self.kinds[kind] += 1

    def leave(self) -> str:
        tag, kind, outer, _ = self.open.pop()
        if kind == "marked":
            self.marking.subtract(self.marks[self.mark].names)
        self.mark = outer
        self.names[tag] -= 1
        self.kinds[kind] -= 1
        if kind == "article" and not self.kinds["article"]:
            self.article = 0
        return tag

    def end_head(self) -> None:
        self.title = False
        while self.leave() != "head":
            pass

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.title = False
        if tag == "a":
            self.link = False
        if tag in BLOCKS or self.names[tag]:
            self.end_block()
        if self.names[tag]:
            while self.leave() != tag:
                pass

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not self.title and data.strip():
            self.end_head()
        if not self.kinds["unseen"]:
            self.parts.append(data)
            if self.link:
                self.linked.append(data)


def blocks(html: str) -> tuple[list[Block], list[Mark]]:
    reader = _Blocks()
    reader.feed(html)
    reader.close()  # text after the last tag
    reader.end_block()
    return reader.blocks, reader.marks


def _weight(block: Block) -> int:
    """Characters outside links; none for what stands apart or is mostly links."""
    return 0 if block.apart or block.linked > MANY_LINKS * len(block.text) else len(block.text) - block.linked


def _width(text: str) -> int:
    """Length of a text; a sign of the scripts that write words without blanks counts as three letters."""
    return len(text) + 2 * len(_UNSPACED.findall(text)) if not text.isascii() else len(text)


def classify(block: Block, marked: bool, by_length: bool = False) -> int:
    """A block's own label; a mark that holds lowers it by a step, further for what isn't long.

    A long block without any known stop word may be of another language, or code: it is left open. ``by_length``: such a
    block is good, for pages on which stop words tell nothing.
    """
    text, linked, apart, article, *_ = block
    if apart or linked > MANY_LINKS * len(text):
        return BAD
    if _width(text) < (LONG_MARKED if marked else LONG):
        return BAD if marked else OPEN
    words = _WORDS.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if density >= STOPS_HIGH or by_length:
        return OPEN if marked else GOOD
    if (density >= STOPS_LOW or not density or article) and not marked:
        return OPEN
    return BAD


def _of_comments(name: str) -> bool:
    return set() < MARKS.intersection(_PARTS.split(name)) <= COMMENTS


def _holding(found: list[Block], marks: list[Mark]) -> list[bool]:
    """Whether each mark, or one around it, holds on this page.

    A name marks nothing where its elements have most of the page's text between them; names of comments are judged element by
    element. And no mark holds around an article or main element with a long block of running text (names of comments
    aside), or with half of the text that such elements have.
    """
    weights, long = [[0, 0, 0] for _ in marks], [[False] * 3 for _ in marks]
    total = [0, 0, 0]
    for b in found:
        total[b.depth] += _weight(b)
        if b.mark >= 0:
            weights[b.mark][b.depth] += _weight(b)
            long[b.mark][b.depth] |= classify(b, True) == OPEN
    for i in range(len(marks) - 1, -1, -1):  # inner marks come after outer ones
        outer = marks[i].outer
        if outer >= 0:
            weights[outer] = [x + y for x, y in zip(weights[outer], weights[i], strict=True)]
            long[outer] = [x or y for x, y in zip(long[outer], long[i], strict=True)]
    shares: Counter = Counter()
    for mark, weight in zip(marks, weights, strict=True):
        for name in mark.first:
            shares[name] += sum(weight)
    out: list[bool] = []
    for mark, weight, runs in zip(marks, weights, long, strict=True):
        holds = any(2 * (sum(weight) if _of_comments(x) else shares[x]) <= sum(total) for x in mark.names)
        deeper = sum(weight[mark.depth + 1:])
        if holds and deeper:
            holds = 2 * deeper < sum(total[mark.depth + 1:]) and (not any(runs[mark.depth + 1:]) or all(map(_of_comments, mark.names)))
        out.append(holds or mark.outer >= 0 and out[mark.outer])
    return out


def _nearest(labels: list[int], places: list[int], order: range) -> list[tuple[int, int]]:
    """For every block the nearest decided label before it in ``order`` within its article, and its distance."""
    out: list[tuple[int, int]] = [(OPEN, 0)] * len(labels)
    at, label, place = 0, OPEN, None
    for i in order:
        if places[i] != place:
            place, label = places[i], OPEN
        out[i] = (label, abs(i - at))
        if labels[i] != OPEN:
            at, label = i, labels[i]
    return out


def _settled(labels: list[int], places: list[int]) -> list[int]:
    """The labels with every open one settled by the nearer decided neighbour, or by whether it stands in an article."""
    before = _nearest(labels, places, range(len(labels)))
    after = _nearest(labels, places, range(len(labels) - 1, -1, -1))
    out = []
    for label, place, (one, near_one), (two, near_two) in zip(labels, places, before, after, strict=True):
        if label == OPEN:
            if one == OPEN or two == OPEN:
                label = one or two or (GOOD if place else BAD)
            elif near_one != near_two:
                label = one if near_one < near_two else two
            else:
                label = max(one, two)
        out.append(label)
    return out


def _kept(found: list[Block], marked: list[bool], by_length: bool = False) -> list[str]:
    labels = [classify(b, m, by_length) for b, m in zip(found, marked, strict=True)]
    places = [b.article for b in found]
    settled = _settled(labels, places)
    own = [i for i, m in enumerate(marked) if not (m and places[i])]
    for i, label in zip(own, _settled([labels[i] for i in own], [places[i] for i in own]), strict=True):
        settled[i] = label
    return [b.text for b, label in zip(found, settled, strict=True) if label == GOOD]


def main_text(html: str | None) -> str:
    """Good blocks in page order, one a line.

    An open block takes the label of the nearer decided neighbour, good where both are as near. Inside an article or main
    element only neighbours that stand in the same one count, and what stands apart there (a note, an advert) or is marked is
    no neighbour of what isn't; with none, the block is good there and bad elsewhere. Blocks outside such elements are bad
    where these have at least as much text as the good blocks outside have, comments and marked blocks aside. A marked block is
    never good on its own; marks are left out of account on a page that would have no text with them. On a page without any
    text by stop words, as in a language that STOP_WORDS does not hold, length and links alone decide.
    """
    if not html:
        return ""
    found, marks = blocks(html)
    holding = _holding(found, marks)
    marked = [b.mark >= 0 and holding[b.mark] for b in found]
    comments: list[bool] = []
    for mark in marks:
        comments.append(mark.outer >= 0 and comments[mark.outer] or any(map(_of_comments, mark.names)))
    inside = sum(_weight(b) for b in found if b.article)
    outside = sum(
        _weight(b) for b, m in zip(found, marked, strict=True)
        if not b.article and not (b.mark >= 0 and comments[b.mark]) and classify(b, m) == GOOD
    )
    only = 0 < inside >= outside
    chosen = [(b, m) for b, m in zip(found, marked, strict=True) if (not b.apart if b.article else not only)]
    found, marked = [b for b, _ in chosen], [m for _, m in chosen]
    kept = _kept(found, marked)
    if not kept:
        kept = _kept(found, marked, True)
    if not kept and any(marked):
        plain = [False] * len(found)
        kept = _kept(found, plain) or _kept(found, plain, True)
    return "\n".join(kept)


def extract_main(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty pages, and pages without a good block, have the text ''. Rows are independent: repeated rows give repeated
    results, a null url stays null, other columns are ignored. Whole pages are read, in one pass; only in broken markup
    (very many tags or comments that never end) does the standard reader search the rest of the page again for each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return widen(pages.select("page_id", "url", "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
