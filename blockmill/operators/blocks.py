"""The block: the unit that every extractor emits and every chunker takes."""

from __future__ import annotations

from typing import NamedTuple

PARAGRAPH, HEADING, LIST_ITEM, CAPTION, SHEET_ROW, SLIDE_BODY = "Paragraph", "Heading", "ListItem", "Caption", "SheetRow", "SlideBody"
SECTION, EMAIL, SHEET, SLIDE = "Section", "Email", "Sheet", "Slide"

#: The codes of anchor kinds.
ANCHOR_CODES = {"Unspecified": 0, "Page": 1, "Slide": 2, "Sheet": 3, "Section": 4, "Email": 5}

SHAPES = {
    **dict.fromkeys(("txt", "html", "docx", "odt", "epub", "eml", "rtf"), "prose"),
    **dict.fromkeys(("csv", "tsv", "xlsx", "ods"), "sheets"),
    **dict.fromkeys(("pptx", "odp"), "slides"),
}


class Block(NamedTuple):
    kind: str
    level: int = 0
    text: str = ""
    cells: list[str] | None = None
    row: int = 0
    anchor_kind: str = SECTION
    slide: int = 0
    sheet: str = ""


def prose(kind: str, text: str, level: int = 0, anchor: str = SECTION) -> Block:
    return Block(kind, level, text, None, 0, anchor)


def sheet_row(cells: list[str], row: int, sheet: str = "") -> Block:
    return Block(SHEET_ROW, 0, "", cells, row, SHEET, 0, sheet)


def slide_body(text: str, number: int) -> Block:
    return Block(SLIDE_BODY, 0, text, None, 0, SLIDE, number)
