"""The parts of one page's markup: table cells, labelled times, links and dates.

This is the only per-row Python. Each part is one linear pass that looks only at the tags it
needs; what the parts mean is decided later, in Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache, partial
from html import unescape
from itertools import count, product

from recordmill import fixed

# A quote opens a value right after = only; elsewhere it is an ordinary character.
_ATTRS = r"""[^<>=]*+(?:=(?:\s*"[^"]*"|\s*'[^']*')?+[^<>=]*+)*+"""
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.I | re.S)
_TAG = re.compile(rf"<(/?)([a-z][a-z0-9:_-]*)({_ATTRS})>", re.I)
_GRID_TAG = re.compile(rf"<(/?)(table|t[rdh])\b({_ATTRS})>", re.I)
_OTHER_TAG = re.compile(rf"</?(?!(?:table|t[rdh])\b)[a-z]{_ATTRS}>", re.I)
# In markup where no quoted value holds a bracket, a tag simply ends at its first one: the same tags, found far sooner.
_QUOTED_BRACKET = re.compile(r"""=\s*(?:"[^"<>]*[<>]|'[^'<>]*[<>])""")
_PLAIN_GRID_TAG = re.compile(r"<(/?)(table|t[rdh])\b([^<>]*)>", re.I)
_PLAIN_OTHER_TAG = re.compile(r"</?(?!(?:table|t[rdh])\b)[a-z][^<>]*>", re.I)
_TOLD_TAG = re.compile(r"<([a-z][a-z0-9:_-]*)\s([^<>]*)>", re.I)
_GRID_HEAD = re.compile(r"(/?)(table|t[rdh])\b(.*)", re.I | re.S)
_OTHER_HEAD = re.compile(r"/?[a-z]", re.I)
_TOLD = re.compile(r"time|ng-bind", re.I)
_ATTR = re.compile(r"""([^\s=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def visible(markup: str) -> str:
    """Markup without comments, declarations, scripts and styles."""
    return _HIDDEN.sub("", markup)


def clean(text: str) -> str:
    if "&" not in text:
        return " ".join(text.split())
    text = " ".join(unescape(text).split())
    for entity, char in fixed.ENTITIES:
        text = text.replace(entity, char)
    return text.strip()


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTR.findall(raw)} if "=" in raw else {}


@lru_cache(maxsize=4096)
def _classes(raw: str) -> str:
    return _attributes(raw).get("class", "")


# --- tables ---------------------------------------------------------------------------------

TABLE_FIELDS = ("table_no", "marked", "classes", "text", "rows", "spans", "grid")
_RANK = {"table": 0, "tr": 1, "td": 2, "th": 2}
_MARKED = frozenset(fixed.TABLE_CLASSES)


class _Box:
    """A table, row or cell: its attributes, text pieces [first, last) and parts; what was read of it is kept."""

    __slots__ = ("rank", "attrs", "first", "last", "parts", "text", "cells")

    def __init__(self, rank: int, attrs: str, first: int):
        self.rank, self.attrs, self.first, self.last = rank, attrs, first, None
        self.parts: list[_Box] = []
        self.text: str | None = None
        self.cells: list[str] | None = None


def _boxes(shown: str) -> tuple[list[str], list[_Box]]:
    """Text pieces and tables in page order. Boxes inside a nested table count for the outer one too.

    A new cell ends the open cell of its row and a new row that of its table.
    """
    bare = (_OTHER_TAG if _QUOTED_BRACKET.search(shown) else _PLAIN_OTHER_TAG).sub("", shown)
    plain = _QUOTED_BRACKET.search(bare) is None
    tables: list[_Box] = []
    stack: list[_Box] = []
    tokens = (_PLAIN_GRID_TAG if plain else _GRID_TAG).split(bare)
    pieces = tokens[::4]
    for last, (closing, name, attrs) in enumerate(zip(tokens[1::4], tokens[2::4], tokens[3::4], strict=True), 1):
        rank = _RANK[name if name in _RANK else name.lower()]
        if closing or rank:
            while stack and stack[-1].rank >= rank:
                box = stack.pop()
                box.last = last
                if box.rank == rank:
                    break
        if not closing:
            box = _Box(rank, attrs, last)
            if rank == 0:
                tables.append(box)
            else:
                for outer in stack:
                    if outer.rank == rank - 1:
                        outer.parts.append(box)
            stack.append(box)
    for box in stack:
        box.last = len(pieces)
    return pieces, tables


class _Kinds(dict):
    """What a tag with this inside is to a table: its rank, that less 3 if it closes, 3 for another tag, 4 if it is none; and its attributes."""

    def __missing__(self, inside: str) -> tuple[int, str]:
        tag = _GRID_HEAD.match(inside)
        if tag:
            rank = _RANK[tag[2].lower()]
            kind = (rank - 3, "") if tag[1] else (rank, tag[3])
        else:
            kind = (3 if _OTHER_HEAD.match(inside) else 4, "")
        if len(self) >= 4096:
            self.clear()
        self[inside] = kind
        return kind


_KINDS = _Kinds()


def _flat_boxes(markup: str) -> list[tuple[str, Callable]] | None:
    """As ``_nested_tables``, in one look at each tag, where no quoted value holds a bracket, no table opens inside an open element and
    every ``<`` begins a tag; else None. A cell ends at the next tag of a table here.
    """
    if _QUOTED_BRACKET.search(markup):
        return None
    tables: list[tuple] = []
    shown = rows = row = cell = None  # the open table's text pieces and rows, the open row, and the open cell's text
    for tag in markup.split("<")[1:]:
        inside, ended, text = tag.partition(">")
        if not ended:
            return None
        part, attrs = _KINDS[inside]
        if part == 3:
            if text:
                if shown is not None:
                    shown.append(text)
                if cell is not None:
                    cell += text
            continue
        if part == 4 or part == 0 and (cell is not None or row is not None or shown is not None):
            return None
        if cell is not None:
            if row is not None:
                row.append(cell)
            cell = None
        if part == 0:
            shown, rows = [text], []
            spans = []
            tables.append((attrs, partial(_read_flat, shown, rows, spans)))
            continue
        if part == -3:
            shown = rows = row = None
            continue
        if shown is not None and text:
            shown.append(text)
        if part == 2:
            cell = text
            if attrs and row is not None and rows is not None and "span" in attrs.lower() and (size := _spans(attrs)) != (1, 1):
                spans.append({"row_no": len(rows), "cell_no": len(row) + 1, "rowspan": size[0], "colspan": size[1]})
        elif part == 1:
            row = []
            if rows is not None:
                rows.append(row)
        elif part == -2:
            row = None
    if cell is not None and row is not None:
        row.append(cell)
    return tables


def _read_flat(shown: list[str], rows: list[list[str]], spans: list[dict], whole: bool, cells: bool) -> tuple[str | None, list[list[str]], list[dict]]:
    text = clean("".join(shown)) if whole else None
    return text, [[clean(cell) for cell in row] for row in rows] if cells else rows, spans


def _nested_tables(shown: str) -> list[tuple[str, Callable]]:
    """Each table's attributes, and a function that reads its text if asked, its rows, of cell texts if asked, and its merged cells."""
    pieces, found = _boxes(shown)

    # Rows and cells of nested tables belong to every outer table: each is read once.
    def text(box: _Box) -> str:
        if box.text is None:
            box.text = clean(pieces[box.first] if box.last - box.first == 1 else "".join(pieces[box.first:box.last]))
        return box.text

    def cells(row: _Box) -> list[str]:
        if row.cells is None:
            row.cells = [cell.text if cell.text is not None else text(cell) for cell in row.parts]
        return row.cells

    def read(table: _Box, whole: bool, texts: bool) -> tuple[str | None, list[list[str]], list[dict]]:
        spans = [
            {"row_no": y, "cell_no": x, "rowspan": size[0], "colspan": size[1]}
            for y, row in enumerate(table.parts, 1)
            for x, cell in enumerate(row.parts, 1)
            if cell.attrs and "span" in cell.attrs.lower() and (size := _spans(cell.attrs)) != (1, 1)
        ]
        return text(table) if whole else None, [cells(row) if texts else row.parts for row in table.parts], spans

    return [(table.attrs, partial(read, table)) for table in found]


def table_rows(shown: str, candidates_only: bool = False, fields: tuple[str, ...] = TABLE_FIELDS) -> list[dict]:
    """Cell texts row by row; only merged cells are listed in ``spans`` (numbered from 1). Of the fields only those asked are there."""
    found = _flat_boxes(shown)
    if found is None:
        found = _nested_tables(shown)
    tables = [(no, read, _classes(attrs)) for no, (attrs, read) in enumerate(found, 1)]
    marked = {no for no, _, classes in tables if not _MARKED.isdisjoint(classes.split())}
    whole, grid = "text" in fields, "grid" in fields
    cells = grid or "rows" in fields
    out = []
    for no, read, classes in tables:
        if candidates_only and marked and no not in marked:
            continue
        text, rows, spans = read(whole, cells)
        merged = grid and len(rows) > 2 and any(s["row_no"] > 1 for s in spans)
        table = {
            "table_no": no,
            "marked": no in marked,
            "classes": classes,
            "text": text,
            "rows": rows,
            "spans": spans,
            "grid": spread(rows, spans) if merged else None,
        }
        out.append(table if fields is TABLE_FIELDS else {f: table[f] for f in fields})
    return out


@lru_cache(maxsize=4096)
def _spans(raw: str) -> tuple[int, int]:
    attrs = _attributes(raw)
    given = [attrs.get(k, "").strip() for k in ("rowspan", "colspan")]
    # ``spread`` cuts at the table's edges; here a span only has to fit the column's type.
    down, across = [min(max(int(v.lstrip("0")[:11] or 0), 1), 2**31 - 1) if v.isascii() and v.isdigit() else 1 for v in given]
    return down, across


def spread(rows: list[list[str]], spans: list[dict]) -> list[list[str | None]]:
    """Text at every position below the header row, cut at the header's width.

    A position left empty takes the text of the nearest one above whose span, counted from
    there, reaches it.
    """
    header, *data = rows
    sizes = {(s["row_no"] - 2, s["cell_no"] - 1): (s["rowspan"], s["colspan"]) for s in spans}
    held: dict[tuple[int, int], tuple[str, int]] = {}
    for y, cells in enumerate(data):
        x = 0
        for i, text in enumerate(cells):
            down, across = sizes.get((y, i), (1, 1))
            x = next(at for at in count(x) if (y, at) not in held)
            reach = range(y, min(y + down, len(data))), range(x, min(x + across, len(header)))
            held.update(dict.fromkeys(product(*reach), (text, down)))
            x += across

    grid: list[list[str | None]] = [[None] * len(header) for _ in data]
    for x in range(len(header)):
        reaching: list[tuple[int, str]] = []  # (row a text no longer reaches, text), the nearest last
        for y in range(len(data)):
            while reaching and reaching[-1][0] <= y:
                reaching.pop()
            text, down = held.get((y, x), (None, 0))
            grid[y][x] = text or (reaching[-1][1] if reaching else text)
            if down:
                reaching.append((y + down, text))
    return grid


# --- labelled times -------------------------------------------------------------------------


@lru_cache(maxsize=256)
def _tags_of(names: frozenset, attrs: str) -> re.Pattern:
    return re.compile(rf"<(/?)({'|'.join(map(re.escape, sorted(names)))})(?![\w:-])({attrs})>", re.I)


def times(shown: str) -> list[dict]:
    """Texts of elements that look like a time label, with how telling each looks (0 is best).

    What stands before the first such tag, or after the last one's element has ended, cannot change them.
    """
    told = [tag for tag in _TOLD_TAG.finditer(shown) if _TOLD.search(tag[2])]
    if not told:
        return []
    plain = _QUOTED_BRACKET.search(shown) is None
    names = frozenset(tag[1].lower() for tag in told)
    first, last = (told[0].start(), told[-1].start()) if plain else (0, len(shown))
    found: list[list] = []
    stack: list[tuple[str, int | None]] = []
    still = 0
    for tag in _tags_of(names, "[^<>]*" if plain else _ATTRS).finditer(shown, first):
        if not still and tag.start() > last:
            break
        closing, name, attrs = tag.groups()
        name = name.lower()
        if not closing:
            rank = _time_rank(name, _attributes(attrs)) if "time" in attrs or "ng-bind" in attrs else None
            stack.append((name, None if rank is None else len(found)))
            if rank is not None:
                found.append([rank, tag.end(), len(shown)])
                still += 1
        elif stack and stack[-1][0] == name:
            _, at = stack.pop()
            if at is not None:
                found[at][2] = tag.start()
                still -= 1
    return [{"rank": rank, "text": clean(_TAG.sub("", shown[start:stop]))} for rank, start, stop in found]


def _time_rank(name: str, attrs: dict) -> int | None:
    classes = attrs.get("class", "")
    words = classes.split()
    if name == "span" and "ng-binding" in words:
        return 0
    if name == "span" and "time" in attrs.get("ng-bind", ""):
        return 1
    for rank, word in enumerate(("publish-time", "pub-time", "time"), 2):
        if word in words:
            return rank
    return 5 if "time" in classes else None


# --- links and dates ------------------------------------------------------------------------

_DAY = re.compile(f"(?=({fixed.ISO_DAY}))")
_DAY_LEN = 10
_YEAR = re.compile(r"\d{4}")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b em font i label mark o:p s small span strong sub sup u".split())
_DATED = frozenset(("td", "span", "div"))


class _Element:
    """An element's reach over the text as shown, with line breaks between blocks."""

    __slots__ = ("name", "rank", "start", "stop", "own_year", "cells")

    def __init__(self, name: str, start: int):
        self.name, self.rank, self.start, self.stop = name, _RANK.get(name), start, None
        self.own_year = False
        self.cells: list[_Element] = []  # of a row


class ListPage:
    """Links of a page and the dates on and around them."""

    def __init__(self, shown: str):
        self.lines: list[str] = []
        self.size = 0
        self.open: list[_Element] = []
        self.links: list[tuple[_Element, str, list[_Element], _Element | None]] = []
        self.dated: list[_Element] = []
        at = 0
        for tag in _TAG.finditer(shown):
            self._text(shown[at:tag.start()])
            at = tag.end()
            closing, name, attrs = tag.groups()
            if closing:
                self._close(name.lower())
            else:
                self._start(name.lower(), attrs)
        self._text(shown[at:])
        while self.open:
            self._pop()
        self.text = "".join(self.lines)
        self._days = [(m.start(), m[1]) for m in _DAY.finditer(self.text)]
        self._starts = [start for start, _ in self._days]

    def _text(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self._add(text)
            if self.open and _YEAR.search(text):
                self.open[-1].own_year = True

    def _add(self, text: str) -> None:
        self.lines.append(text)
        self.size += len(text)

    def _start(self, name: str, attrs: str) -> None:
        rank = _RANK.get(name)
        if rank:
            self._end_rank(rank)
        if name not in _INLINE:
            self._add("\n")
        if name in _VOID:
            return
        element = _Element(name, self.size)
        row = next((e for e in reversed(self.open) if e.rank == 1), None) if name in ("a", "td") else None
        if name == "td" and row:
            row.cells.append(element)
        if name in _DATED:
            self.dated.append(element)
        if name == "a" and (href := _attributes(attrs).get("href", "").strip()):
            self.links.append((element, href, self.open[: -fixed.NEAR_LEVELS - 1 : -1], row))
        self.open.append(element)

    def _end_rank(self, rank: int) -> None:
        """End the open cell or row this one replaces, within the innermost table."""
        last = next((e for e in reversed(self.open) if e.rank is not None and e.rank <= rank), None)
        if last and last.rank == rank:
            while self._pop() is not last:
                pass

    def _close(self, name: str) -> None:
        """End the named element; the end tag of an inner one never ends a cell, row or table around."""
        rank = _RANK.get(name, 3)
        for i in range(len(self.open) - 1, -1, -1):
            element = self.open[i]
            if element.name == name:
                while len(self.open) > i:
                    self._pop()
                return
            if element.rank is not None and element.rank < rank:
                return

    def _pop(self) -> _Element:
        element = self.open.pop()
        element.stop = self.size
        if element.name not in _INLINE:
            self._add("\n")
        return element

    def first_day(self, e: _Element | None) -> str | None:
        if e is None:
            return None
        i = bisect_left(self._starts, e.start)
        if i < len(self._days) and self._days[i][0] + _DAY_LEN <= e.stop:
            return self._days[i][1]
        return None

    def link_rows(self) -> list[dict]:
        out = []
        cell_days: dict[int, str | None] = {}
        for pos, (a, href, around, row) in enumerate(self.links, 1):
            if row and id(row) not in cell_days:
                cell_days[id(row)] = next((d for d in map(self.first_day, row.cells) if d), None)
            out.append({
                "pos": pos,
                "href": href,
                "text": clean(self.text[a.start:a.stop]),
                "cell_day": cell_days[id(row)] if row else None,
                "row_day": self.first_day(row),
                "near_day": next((d for d in map(self.first_day, around) if d), None),
            })
        return out

    def days(self) -> list[str]:
        """First date of each cell, span or division that itself holds a four-digit number."""
        return [d for e in self.dated if e.own_year and (d := self.first_day(e))]


def page_parts(markup: str, parts: tuple[str, ...], candidates_only: bool, fields: tuple[str, ...] = TABLE_FIELDS) -> dict[str, list]:
    """The asked parts of a page, and of its tables the asked fields."""
    shown = visible(markup)
    listing = ListPage(shown) if "links" in parts or "days" in parts else None
    build = {
        "links": lambda: listing.link_rows(),
        "days": lambda: listing.days(),
        "times": lambda: times(shown),
        "tables": lambda: table_rows(shown, candidates_only, fields),
    }
    return {part: build[part]() for part in parts}
