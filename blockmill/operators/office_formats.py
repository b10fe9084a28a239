"""Extractors of zipped XML formats: documents, sheets, slides and books."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

from blockmill.functions.text import clean, trim
from blockmill.operators.blocks import HEADING, LIST_ITEM, PARAGRAPH, Block, prose, sheet_row, slide_body
from blockmill.operators.number_formats import BUILT_IN, shown, shown_by
from blockmill.operators.plain_formats import html_blocks
from blockmill.sources.archives import MAX_ARCHIVE, Archive, Node, each_element, invalid, is_plain_xml, read_xml, resolve

#: Fixed value: the widest row of an OpenDocument sheet.
MAX_COLUMNS = 8192


def _number(text: str | None, default: int) -> int:
    t = text or ""
    if t.isascii() and t.isdigit():
        return int(t)
    t = trim(t)
    return int(t) if re.fullmatch(r"[+-]?[0-9]+", t) else default


def _clamped(level: int) -> int:
    return min(6, max(1, level))


# ---- word processing ----


def style_level(style: str) -> int:
    """The heading level that a paragraph style stands for, 0 for none."""
    s = trim(style).lower()
    if s in ("title", "subtitle"):
        return 1 if s == "title" else 2
    if not s.startswith("heading"):
        return 0
    rest = trim(s[len("heading") :])
    if not rest:
        return 2
    n = _number(rest, 0)
    return min(n, 6) if n > 0 else 0


#: Elements that stand for a character, by format.
_WORD_MARKS = {"tab": " ", "br": "\n", "cr": "\n"}
_OPEN_MARKS = {"tab": " ", "s": " ", "line-break": "\n"}


def _word_paragraphs(node: Node) -> Iterator[list[Node]]:
    """The leaves of each paragraph of a paragraph: nested ones by themselves, then what follows the last of them."""
    own: list[Node] = []
    todo = list(reversed(node.children))
    while todo:
        child = todo.pop()
        if not isinstance(child, Node):
            continue
        if child.name == "p":
            yield from _word_paragraphs(child)
            own = []
        elif child.name == "t":
            own.append(child)
        else:
            own.append(child)
            todo += reversed(child.children)
    yield own


def docx_blocks(data: bytes) -> list[Block]:
    """Paragraphs: text runs, with tabs and breaks; the style says the level of a heading, numbering makes a list item. Runs that stand in
    no paragraph count where none follows them."""
    blocks: list[Block] = []
    loose: list[Node] = []

    def add(leaves: list[Node]) -> None:
        body = trim("".join(x.text(_WORD_MARKS) if x.name == "t" else _WORD_MARKS.get(x.name, "") for x in leaves))
        styles = [x.attributes.get("val", "") for x in leaves if x.name == "pStyle"]
        level = style_level(styles[-1]) if styles else 0
        listed = any(x.name == "numPr" for x in leaves)
        if body:
            blocks.append(prose(HEADING if level else LIST_ITEM if listed else PARAGRAPH, body, level))

    def take(node: Node) -> None:
        if node.name != "p":
            loose.append(node)
            return
        loose.clear()
        for leaves in _word_paragraphs(node):
            add(leaves)

    if not each_element(Archive(data).need("word/document.xml"), ["p", "t", "pStyle", "numPr", *_WORD_MARKS], take):
        raise invalid("the text of the document is no well-formed XML")
    add(loose)
    return blocks


def _open_paragraphs(node: Node, held: list[str] | None = None) -> Iterator[tuple[Node, str]]:
    """(element, text) of the paragraphs and headings of one. A paragraph within a paragraph ends both; one within a heading is part of
    it; a heading always begins anew. What follows such an end is no one's text."""
    held = [] if held is None else held
    open_ = True

    def walk(children: list) -> Iterator[tuple[Node, str]]:
        nonlocal open_
        for child in children:
            if isinstance(child, str):
                if open_:
                    held.append(child)
            elif child.name == "h" or child.name == "p" and (node.name == "p" or not open_):
                yield from _open_paragraphs(child, held if open_ and child.name == "p" else None)
                open_ = False
            else:
                if open_:
                    held.append(_OPEN_MARKS.get(child.name, ""))
                yield from walk(child.children)

    yield from walk(node.children)
    if open_:
        yield node, "".join(held)


def odt_blocks(data: bytes) -> list[Block]:
    blocks: list[Block] = []

    def take(outer: Node) -> None:
        for element, body in _open_paragraphs(outer):
            if trim(body):
                level = _clamped(_number(element.attributes.get("outline-level"), 1)) if element.name == "h" else 0
                blocks.append(prose(HEADING if level else PARAGRAPH, body, level))

    if not each_element(Archive(data).need("content.xml"), ["p", "h"], take):
        raise invalid("the content of the text is no well-formed XML")
    return blocks


# ---- sheets ----

#: Fixed value: the kinds of cells whose stored value is taken instead of the text shown.
_VALUE_TYPES = ("float", "currency", "percentage")


def _open_cells(row: Node) -> list[str]:
    """The cells of a row in their columns, up to the last that is not blank."""
    spans: list[tuple[int, int, str]] = []
    at = 0
    for cell in row.find("table-cell", "covered-table-cell"):
        repeat = max(1, _number(cell.attributes.get("number-columns-repeated"), 1))
        stored = cell.attributes.get("value", "") if cell.attributes.get("value-type") in _VALUE_TYPES else ""
        value, end = stored or trim(cell.text()), min(at + repeat, MAX_COLUMNS)
        if value and at < end:
            spans.append((at, end, value))
        at += repeat
    while spans and not trim(spans[-1][2]):
        spans.pop()
    cells = [""] * (spans[-1][1] if spans else 0)
    for start, end, value in spans:
        cells[start:end] = [value] * (end - start)
    return cells


def ods_blocks(data: bytes) -> list[Block]:
    """Rows that are not blank, each once, under the number at which its repeats begin."""
    blocks: list[Block] = []
    sheet, number = "", 1

    def entered(name: str, attributes: dict[str, str]) -> None:
        nonlocal sheet, number
        if name == "table":
            sheet, number = attributes.get("name", ""), 1

    def take(row: Node) -> None:
        nonlocal number
        if cells := _open_cells(row):
            blocks.append(sheet_row(cells, number, sheet))
        number += _number(row.attributes.get("number-rows-repeated"), 1)

    if not each_element(Archive(data).need("content.xml"), ["table-row"], take, entered):
        raise invalid("the content of the sheets is no well-formed XML")
    return blocks


_LETTERS = re.compile("[A-Za-z]+")


@lru_cache(maxsize=1 << 16)
def _place(reference: str | None) -> int | None:
    """Column of a cell reference, from 0."""
    m = _LETTERS.match(reference or "")
    if not m:
        return None
    n = 0
    for c in m.group().upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def _rels(archive: Archive, part: str) -> dict[str, str]:
    """Relationship targets by id, the last of equal ids."""
    out: dict[str, str] = {}

    def take(node: Node) -> None:
        if node.attributes.get("Id") and node.attributes.get("Target"):
            out[node.attributes["Id"]] = node.attributes["Target"]

    if part in archive:
        each_element(archive.read(part)[0], ["Relationship"], take)
    return out


def _relation_ids(data: bytes, element: str, at_root: str) -> list[tuple[str, dict[str, str]]]:
    """(relationship id, attributes) of each element: the id attribute whose prefix stands for a namespace of relationships."""
    spaces: dict[str, str] = {}
    out = []

    def start(name, attributes, raw):
        for k, v in raw.items():
            if k.startswith("xmlns:"):
                spaces[k[6:]] = v
        if name == element:
            for k, v in raw.items():
                prefix, _, local = k.rpartition(":")
                if local == "id" and prefix and "relationships" in spaces.get(prefix, prefix if prefix not in spaces else "") and v:
                    out.append((v, attributes))
                    break

    read_xml(data, start)
    return out


def _shared_strings(archive: Archive) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in archive:
        each_element(archive.read("xl/sharedStrings.xml")[0], ["si"], lambda node: out.append(node.text(within="t", without="rPh")) if node.whole else None)
    return out


def _cell_formats(archive: Archive) -> list[str]:
    """The format code of each cell style."""
    own: dict[int, str] = {}
    styles: list[int] = []

    def take(node: Node) -> None:
        if node.name == "numFmt":
            own[_number(node.attributes.get("numFmtId"), -1)] = node.attributes.get("formatCode", "")
        else:
            styles.extend(_number(x.attributes.get("numFmtId"), 0) for x in node.find("xf"))

    if "xl/styles.xml" in archive:
        each_element(archive.read("xl/styles.xml")[0], ["numFmt", "cellXfs"], take)
    return [own.get(n) or BUILT_IN.get(n, "General") for n in styles]


class _Book(NamedTuple):
    strings: list[str]
    formats: list[str]
    from_1904: bool


def xlsx_blocks(data: bytes) -> list[Block]:
    """Rows of the sheets that are shown, with values as their formats show them."""
    archive = Archive(data, bounded=False)
    if "xl/workbook.xml" not in archive:
        raise invalid("the archive holds no workbook")
    workbook = archive.need("xl/workbook.xml")
    dates: list[str] = []
    each_element(workbook, ["workbookPr"], lambda node: dates.append(node.attributes.get("date1904", "")))
    book = _Book(_shared_strings(archive), _cell_formats(archive), any(d in ("1", "true") for d in dates))
    rels = _rels(archive, "xl/_rels/workbook.xml.rels")
    blocks: list[Block] = []
    for rid, attributes in _relation_ids(workbook, "sheet", "workbook"):
        part = resolve("xl", rels.get(rid, ""))
        if attributes.get("state") not in ("hidden", "veryHidden") and part in archive:
            blocks += _sheet_rows(archive.read(part)[0], attributes.get("name", ""), book)
    return blocks


def _code(style: int, book: _Book) -> str:
    return book.formats[style] if style < len(book.formats) else "General"


def _value(kind: str, style: int, value: str, book: _Book) -> str:
    if kind == "s":
        at = _number(value, -1)
        return book.strings[at] if 0 <= at < len(book.strings) else value
    if kind == "b":
        return {"1": "TRUE", "0": "FALSE"}.get(value, value)
    return shown(value, _code(style, book), book.from_1904) if kind == "n" and value else value


def _cell_value(cell: Node, book: _Book) -> str:
    kind, style = cell.attributes.get("t", "n"), _number(cell.attributes.get("s"), 0)
    if kind == "inlineStr":
        return "".join(x.text(without="rPh") for x in cell.find("v", "t", "is") if x.name != "is") + "".join(x.text(within="t", without="rPh") for x in cell.find("is"))
    return _value(kind, style, "".join(x.text() for x in cell.find("v")), book)


#: Values of one kind and style, and format codes, that are remembered.
REMEMBERED, REMEMBERED_CODES = 1 << 14, 16

#: Cells of a row that one pattern is made for.
MAX_LAYOUT = 256


class _Values(dict):
    """Stored values of cells of one kind and style, as they are shown."""

    def __init__(self, read: Callable[[str], str]):
        self.read = read

    def __missing__(self, value: str) -> str:
        text = self.read(value)
        if not text.isascii():
            text = clean(text)
        if len(self) < REMEMBERED:
            self[value] = text
        return text


@lru_cache(maxsize=REMEMBERED_CODES)
def _numbers(code: str, from_1904: bool) -> _Values:
    read = shown_by(code, from_1904)
    return _Values(lambda value: read(value) if value else value)


class _Styles(dict):
    """The values of a sheet by the attributes of their cells, as _CELL has them."""

    def __init__(self, book: _Book):
        self.book = book

    def __missing__(self, attributes: str) -> _Values:
        style, kind = _KIND.fullmatch(attributes).groups("")
        at, book = _number(style, 0), self.book
        values = self[attributes] = _numbers(_code(at, book), book.from_1904) if kind in ("", "n") else _Values(lambda value: _value(kind, at, value, book))
        return values


#: The start tag of a row whose number, if it has one, comes first; a cell that is empty or holds nothing but a value; style and kind of a cell.
_ROW_START = re.compile(r"""<row(?: r="([0-9]+)")?((?:\s+[^\s=<>"'/]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*)\s*(/?)>""")
_CELL = re.compile(r"""<c r="([A-Za-z]+)[0-9]*"((?: s="[0-9]+")?(?: t="[A-Za-z]+")?)(?:(/)>|><v>([^<&\r]*)</v></c>)""")
_KIND = re.compile(r"""(?: s="([0-9]+)")?(?: t="([A-Za-z]+)")?""")


@lru_cache(maxsize=1 << 10)
def _layout(others: str, columns: tuple[str, ...], attributes: tuple[str, ...]) -> re.Pattern:
    """A row of these cells, as _ROW_START and _CELL would find it: its number and values."""
    cells = (f'<c r="{column}[0-9]*"{re.escape(a)}><v>([^<&\r]*)</v></c>' for column, a in zip(columns, attributes))
    return re.compile(f'\\s*<row r="([0-9]+)"{re.escape(others)}>{"".join(cells)}</row>')


def _sheet_rows(data: bytes, sheet: str, book: _Book) -> list[Block]:
    blocks: list[Block] = []
    last = 0

    def take(row: Node) -> None:
        nonlocal last
        last = _number(row.attributes.get("r"), last + 1)
        cells: list[str] = []
        for cell in row.find("c"):
            place = _place(cell.attributes.get("r"))
            at = len(cells) if place is None else place
            cells += [""] * (at + 1 - len(cells))
            cells[at] = clean(_cell_value(cell, book))
        if row.whole and any(cells):
            blocks.append(sheet_row(cells, last, sheet))

    def scanned(text: str) -> bool:
        """Takes the rows of a sheet in which every `<` begins a tag; rows with other cells than _CELL go to take(), neighbours at once.
        False, perhaps after some rows, if rows are not to be told by their tags alone."""
        nonlocal last
        styles = _Styles(book)
        layout, before, filled = None, None, []  # of rows that follow each other with the same cells, without gaps
        left, told, starts = -1, 0, 0  # where rows for take() begin, where the row before ended

        def rest() -> None:
            nonlocal left
            if left >= 0:
                each_element(f"<rows>{text[left:told]}</rows>".encode(), ["row"], take)
                left = -1

        while True:
            if layout and (row := layout.match(text, told)):
                starts += 1
                told = row.end()
                number, *values = row.groups()
                last = int(number)
                cells = [shown_as[v] for shown_as, v in zip(filled, values)]
                if any(cells):
                    blocks.append(sheet_row(cells, last, sheet))
                continue
            start = _ROW_START.search(text, told)
            if not start:
                break
            starts += 1
            number, others, closed = start.groups()
            opened = start.end()
            end = opened if closed else text.find("</row>", opened)
            if end < 0:
                return False
            body = text[opened:end]
            found = _CELL.findall(body)
            tags = body.count("<")
            if others and not number or tags != sum(1 if empty else 4 for _, _, empty, _ in found):
                if "<row" in body:
                    return False
                left, layout = start.start() if left < 0 else left, None
                told = end if closed else end + len("</row>")
                continue
            rest()
            told = end if closed else end + len("</row>")
            last = int(number) if number else last + 1
            cells = []
            for column, a, _, v in found:
                at = _place(column)
                cells += [""] * (at + 1 - len(cells))
                cells[at] = styles[a][v]
            if any(cells):
                blocks.append(sheet_row(cells, last, sheet))
            columns, attributes = tuple(c for c, _, _, _ in found), tuple(a for _, a, _, _ in found)
            same, before = before == (others, columns, attributes), (others, columns, attributes)
            if same and number and len(found) == len(cells) <= MAX_LAYOUT and tags == 4 * len(found) and [*map(_place, columns)] == [*range(len(cells))]:
                layout, filled = _layout(others, columns, attributes), [styles[a] for a in attributes]
        rest()
        return starts == text.count("<row") - text.count("<rowBreaks")

    if is_plain_xml(data) and b":row" not in data and scanned(data.decode()):
        return blocks
    blocks, last = [], 0
    each_element(data, ["row"], take)
    return blocks


# ---- slides ----


def slide_order(archive: Archive) -> list[str]:
    """Slide parts in the order of the presentation, else of their numbers."""
    order = []
    if "ppt/presentation.xml" in archive:
        rels = _rels(archive, "ppt/_rels/presentation.xml.rels")
        ids = _relation_ids(archive.read("ppt/presentation.xml")[0], "sldId", "presentation")
        order = [resolve("ppt", rels[rid]) for rid, _ in ids if rid in rels]
    if order:
        return order
    named = [n for n in archive.members if n.startswith("ppt/slides/slide") and n.endswith(".xml")]

    def ordinal(name: str) -> int:
        digits = posixpath.basename(name).removesuffix(".xml").removeprefix("slide")
        return int(digits) if re.fullmatch("[0-9]+", digits) else 0

    return sorted(named, key=ordinal)


def _runs(data: bytes) -> str:
    """The text runs of a slide, each on a line."""
    runs: list[str] = []
    each_element(data, ["t"], lambda node: runs.append(node.text()))
    return trim("\n".join(runs))


def pptx_blocks(data: bytes) -> list[Block]:
    archive = Archive(data)
    blocks = []
    for number, part in enumerate(slide_order(archive), 1):
        text = _runs(archive.read(part)[0]) if part in archive else ""
        if text:
            blocks.append(slide_body(text, number))
    return blocks


def _page_text(node: Node) -> str:
    """All text of a page, paragraphs and headings on lines."""
    parts = (c if isinstance(c, str) else _page_text(c) for c in node.children)
    return "".join(parts) + ("\n" if node.name in ("p", "h") else "")


def odp_blocks(data: bytes) -> list[Block]:
    pages: list[str] = []
    if not each_element(Archive(data).need("content.xml"), ["page"], lambda node: pages.append(trim(_page_text(node)))):
        raise invalid("the content of the slides is no well-formed XML")
    return [slide_body(text, number) for number, text in enumerate(pages, 1) if text]


# ---- books ----


def epub_blocks(data: bytes) -> list[Block]:
    """The chapters that the spine lists, in its order."""
    archive = Archive(data)
    nodes = lambda part, *names: _nodes(archive.read(part)[0], names) if part in archive else []
    package = next((p for n in nodes("META-INF/container.xml", "rootfile") if (p := n.attributes.get("full-path"))), None)
    if package is None:
        raise invalid("the book names no package")
    listed = nodes(package, "item", "itemref")
    files = {n.attributes.get("id"): n.attributes["href"] for n in listed if n.name == "item" and n.attributes.get("id") and n.attributes.get("href")}
    blocks: list[Block] = []
    total = 0
    for ref in (n.attributes.get("idref") for n in listed if n.name == "itemref"):
        part = resolve(posixpath.dirname(package), files[ref].partition("#")[0]) if ref in files else ""
        if part not in archive:
            continue
        body, error = archive.read(part)
        total += len(body)
        if total > MAX_ARCHIVE:
            raise invalid(f"the chapters unpack to more than {MAX_ARCHIVE} bytes")
        blocks += html_blocks(body) if body or not error else []
    return blocks


def _nodes(data: bytes, names: tuple[str, ...]) -> list[Node]:
    out: list[Node] = []
    each_element(data, names, out.append)
    return out
