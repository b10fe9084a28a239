"""The chunks of one document, from its blocks: the kernel of the pipelines.

A document is one row (at most 150 MiB), so it is parsed and chunked in one place and nothing of it is shuffled. The chunkers of
operators/chunk.py do the same for tables of blocks; tests hold both against each other.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from blockmill.functions.text import byte_pieces, closing_words, column_letter, trim
from blockmill.operators.blocks import EMAIL, HEADING, SECTION, SHAPES, SHEET, SHEET_ROW, SLIDE, Block

PATH_MARK = " › "
SAMPLE_ROWS = 3


class Chunk(NamedTuple):
    text: str
    source_label: str
    anchor_kind: str
    slide: int = 0
    sheet: str = ""
    cell_range: str = ""
    heading_path: tuple[str, ...] = ()


def size_of(text: str) -> int:
    return len(text.encode("utf-8", "replace"))


def opens_group(held: int | None, size: int, target: int, alone: bool = False) -> bool:
    """The rule of the greedy fill: whether an item begins a group. `held` is the size of the group that is open, None if none is."""
    return held is None or alone or held + size > target


def groups_of(sizes: Iterable[int], target: int, most: int | None = None) -> list[int]:
    """The group of each item; one beyond `most` is a group by itself."""
    out: list[int] = []
    held: int | None = None
    for size in sizes:
        alone = most is not None and size > most
        new = opens_group(held, size, target, alone)
        out.append((out[-1] if out else -1) + new)
        held = None if alone else size if new else held + size
    return out


# ---- prose ----


def below(path: tuple[tuple[int, str], ...], level: int, text: str) -> tuple[tuple[int, str], ...]:
    """The path of (level, heading) after a heading: it ends what is not above it."""
    return (*(step for step in path if step[0] < level), (level, text))


def labels(path: tuple[tuple[int, str], ...]) -> tuple[str, ...]:
    return tuple(text for _, text in path if text)


def fill_section(texts: list[str], label: str, target: int, overlap: int, maximum: int) -> list[str]:
    """The chunks of one section's bodies, in order. A full group hands its last words on to the next; a body beyond the maximum
    stands alone, in pieces."""
    crumb = f"{label}\n\n" if label else ""
    bodies: list[tuple[str, bool]] = []
    held: int | None = None
    for text in texts:
        size = size_of(text)
        alone = size > maximum
        if not opens_group(held, size, target, alone):
            bodies[-1] = (f"{bodies[-1][0]}\n\n{text}", False)
            held += size
            continue
        tail = closing_words(bodies[-1][0], overlap) if held is not None and not alone else ""
        bodies.append((f"{tail}\n\n{text}" if tail else text, alone))
        held = None if alone else size + size_of(tail)
    parts = (part for body, alone in bodies for part in (byte_pieces(body, maximum) if alone else [body]))
    return [piece for part in parts for piece in byte_pieces(crumb + part, maximum)]


def prose_chunks(blocks: list[Block], target: int, overlap: int, maximum: int) -> list[Chunk]:
    anchor = EMAIL if any(b.anchor_kind == EMAIL and b.kind != HEADING for b in blocks) else SECTION
    sections: list[tuple[tuple[str, ...], list[str]]] = [((), [])]
    path: tuple[tuple[int, str], ...] = ()
    for b in blocks:
        text = trim(b.text or "")
        if b.kind == HEADING:
            path = below(path, max(1, b.level or 1), text)
            sections.append((labels(path), []))
        elif text:
            sections[-1][1].append(text)
    return [Chunk(text, PATH_MARK.join(steps), anchor, heading_path=steps) for steps, texts in sections for text in fill_section(texts, PATH_MARK.join(steps), target, overlap, maximum)]


# ---- sheets ----


def named(sheet: str) -> str:
    shown = sheet
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        shown = shown.replace(raw, escaped)
    return f'Sheet "{shown}"'


def row_line(cells: list[str], header: list[str], sheet: str) -> str:
    """The cells that are not blank as `label: value`, after the name of the sheet."""
    parts = [named(sheet)] if sheet else []
    for at, cell in enumerate(cells):
        if value := trim(cell or ""):
            name = trim(header[at] or "") if at < len(header) else ""
            parts.append(f"{name or 'Col ' + column_letter(at)}: {value}")
    return " | ".join(parts)


def sheet_chunks(blocks: list[Block], target: int, maximum: int) -> list[Chunk]:
    sheets: dict[str, list[Block]] = {}
    for b in blocks:
        if b.kind == SHEET_ROW:
            sheets.setdefault(b.sheet or "", []).append(b)
    out: list[Chunk] = []
    for sheet, rows in sheets.items():
        header = list(rows[0].cells or [])
        last = column_letter(max(len(b.cells or []) for b in rows) - 1)
        title = named(sheet) + " " if sheet else ""

        def add(text: str, what: str, first: int, end: int) -> None:
            label = title + what if title else what[0].upper() + what[1:]
            out.extend(Chunk(piece, label, SHEET, sheet=sheet, cell_range=f"A{first}:{last}{end}") for piece in byte_pieces(text, maximum))

        lines = [(row_line(list(b.cells or []), header, sheet), b.row) for b in rows[1:]]
        columns = ", ".join(name for h in header if (name := trim(h or "")))
        sample = "".join("\n" + line for line, _ in lines[:SAMPLE_ROWS])
        add(f"{title}{'— ' if title else ''}columns: {columns}. {len(lines)} data rows." + ("\nSample rows:" + sample if lines else ""), "summary", rows[0].row, rows[-1].row)
        data = [(line, row) for line, row in lines if line]
        grouped: dict[int, list[tuple[str, int]]] = {}
        for item, group in zip(data, groups_of((size_of(line) for line, _ in data), target, maximum)):
            grouped.setdefault(group, []).append(item)
        for items in grouped.values():
            first, end = items[0][1], items[-1][1]
            alone = len(items) == 1 and size_of(items[0][0]) > maximum
            add("\n".join(line for line, _ in items), f"row {first}" if alone else f"rows {first}-{end}", first, end)
    return out


# ---- slides ----


def slide_chunks(blocks: list[Block], target: int, maximum: int) -> list[Chunk]:
    slides: dict[int, list[str]] = {}
    for b in blocks:
        slides.setdefault(b.slide or 0, []).append(trim(b.text or ""))
    shown = [(n, f"Slide {n}\n" + "\n".join(filter(None, texts))) for n, texts in slides.items() if any(texts)]
    grouped: dict[int, list[tuple[int, str]]] = {}
    for item, group in zip(shown, groups_of((size_of(text) for _, text in shown), target)):
        grouped.setdefault(group, []).append(item)
    out = []
    for items in grouped.values():
        first, last = items[0][0], items[-1][0]
        label = f"Slide {first}" if first == last else f"Slides {first}-{last}"
        out += [Chunk(piece, label, SLIDE, slide=first) for piece in byte_pieces("\n\n".join(text for _, text in items), maximum)]
    return out


def chunks_of(format_name: str, blocks: list[Block], target: int, overlap: int, maximum: int) -> list[Chunk]:
    """The chunks of a document of a format, or of a shape, under the sizes in force."""
    shape = SHAPES.get(format_name, format_name)
    if shape == "sheets":
        return sheet_chunks(blocks, target, maximum)
    return slide_chunks(blocks, target, maximum) if shape == "slides" else prose_chunks(blocks, target, overlap, maximum)
