"""Containers written from plain values: for round trips through the extractors and for tests."""

from __future__ import annotations

import base64
import io
import quopri
import re
import warnings
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
ODF = 'xmlns:office="o" xmlns:text="t" xmlns:table="tb" xmlns:draw="d"'


def zipped(members: dict[str, str | bytes], then: dict[str, str | bytes] | None = None) -> bytes:
    """An archive of members; those in `then` follow, also under names that are taken."""
    out = io.BytesIO()
    with warnings.catch_warnings(action="ignore"), zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in [*members.items(), *(then or {}).items()]:
            z.writestr(name, content)
    return out.getvalue()


def docx(paragraphs: list[tuple[str, str]]) -> bytes:
    """(style, text) of each paragraph; the style List makes a list item."""
    body = []
    for style, text in paragraphs:
        mark = "<w:numPr/>" if style == "List" else f"<w:pStyle w:val={quoteattr(style)}/>" if style else ""
        runs = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(t)}</w:t>' for t in text.split("\n"))
        body.append(f"<w:p><w:pPr>{mark}</w:pPr><w:r>{runs}</w:r></w:p>")
    return zipped({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>"})


def odt(paragraphs: list[tuple[int, str]], then: dict[str, str | bytes] | None = None) -> bytes:
    """(heading level or 0, text) of each paragraph."""
    inner = lambda t: "<text:line-break/>".join(escape(x) for x in t.split("\n"))
    body = "".join(f'<text:h text:outline-level="{n}">{inner(t)}</text:h>' if n else f"<text:p>{inner(t)}</text:p>" for n, t in paragraphs)
    return zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f"<office:document-content {ODF}><office:text>{body}</office:text></office:document-content>"}, then)


def ods(sheets: dict[str, list[list[str]]]) -> bytes:
    body = ""
    for name, rows in sheets.items():
        cells = "".join("<table:table-row>" + "".join(f'<table:table-cell office:value-type="string"><text:p>{escape(c)}</text:p></table:table-cell>' if c else "<table:table-cell/>" for c in row) + "</table:table-row>" for row in rows)
        body += f"<table:table table:name={quoteattr(name)}>{cells}</table:table>"
    return zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": f"<office:document-content {ODF}>{body}</office:document-content>"})


def ods_values(rows: list[list[tuple[str, str, int]]]) -> bytes:
    """Cells as (text shown, stored number or nothing, times): repeated cells are written once."""
    cell = lambda shown, value, times: f'<table:table-cell table:number-columns-repeated="{times}"' + (f' office:value-type="float" office:value="{value}"' if value else "") + f"><text:p>{escape(shown)}</text:p></table:table-cell>"
    body = "".join("<table:table-row>" + "".join(cell(*c) for c in row) + "</table:table-row>" for row in rows)
    return zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": f'<office:document-content {ODF}><table:table table:name="s">{body}</table:table></office:document-content>'})


def odp(slides: list[str]) -> bytes:
    pages = "".join("<draw:page>" + "".join(f"<text:p>{escape(t)}</text:p>" for t in s.split("\n")) + "</draw:page>" for s in slides)
    return zipped({"mimetype": "application/vnd.oasis.opendocument.presentation", "content.xml": f"<office:document-content {ODF}>{pages}</office:document-content>"})


def pptx(slides: list[str]) -> bytes:
    """Slides in order of presentation; their parts are numbered the other way round."""
    n = len(slides)
    members: dict[str, str | bytes] = {"[Content_Types].xml": "<Types/>"}
    members["ppt/presentation.xml"] = f"<p:presentation xmlns:p='p' {R}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + k}" r:id="rId{n - k}"/>' for k in range(n)) + "</p:sldIdLst></p:presentation>"
    members["ppt/_rels/presentation.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="slides/slide{k}.xml"/>' for k in range(1, n + 1)) + "</Relationships>"
    for k, s in enumerate(slides):
        members[f"ppt/slides/slide{n - k}.xml"] = "<p:sld xmlns:p='p' xmlns:a='a'>" + "".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in s.split("\n")) + "</p:sld>"
    return zipped(members)


def pptx_linked(listed: list[str], declared: list[tuple[str, str]], parts: dict[str, str]) -> bytes:
    """A deck that lists relationship ids, declares (id, part) in order and holds the texts of parts."""
    members: dict[str, str | bytes] = {"[Content_Types].xml": "<Types/>"}
    members["ppt/presentation.xml"] = f"<p:presentation xmlns:p='p' {R}><p:sldIdLst>" + "".join(f"<p:sldId r:id={quoteattr(i)}/>" for i in listed) + "</p:sldIdLst></p:presentation>"
    members["ppt/_rels/presentation.xml.rels"] = "<Relationships>" + "".join(f"<Relationship Id={quoteattr(i)} Target={quoteattr('slides/' + part)}/>" for i, part in declared) + "</Relationships>"
    for part, text in parts.items():
        members[f"ppt/slides/{part}"] = f"<s><t>{escape(text)}</t></s>"
    return zipped(members)


def pptx_loose(slides: list[str]) -> bytes:
    """A deck without a presentation part: its slides have only the numbers in their names."""
    named = {f"ppt/slides/slide{n}.xml": f"<s><t>{escape(t)}</t></s>" for n, t in enumerate(slides, 1)}
    return zipped({"[Content_Types].xml": "<Types/>", **dict(sorted(named.items()))})


def _reference(column: int, row: int) -> str:
    name = ""
    n = column + 1
    while n:
        n, d = divmod(n - 1, 26)
        name = chr(65 + d) + name
    return f"{name}{row}"


def xlsx(sheets: dict[str, list[list[str]]], hidden: tuple[str, ...] = ()) -> bytes:
    strings: dict[str, int] = {}
    members: dict[str, str | bytes] = {"[Content_Types].xml": "<Types/>"}
    members["xl/workbook.xml"] = f"<workbook {R}><sheets>" + "".join(f'<sheet name={quoteattr(s)} sheetId="{k}" r:id="rId{k}"' + (' state="hidden"' if s in hidden else "") + "/>" for k, s in enumerate(sheets, 1)) + "</sheets></workbook>"
    members["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>"
    for k, rows in enumerate(sheets.values(), 1):
        body = ""
        for r, row in enumerate(rows, 1):
            cells = "".join(f'<c r="{_reference(c, r)}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>' for c, v in enumerate(row) if v)
            body += f'<row r="{r}">{cells}</row>'
        members[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet><sheetData>{body}</sheetData></worksheet>"
    members["xl/sharedStrings.xml"] = "<sst>" + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings) + "</sst>"
    return zipped(members)


def typed_xlsx(rows: list[list[tuple[str, str | None]]], sheet: str = "s") -> bytes:
    """Cells of numbers as (stored value, format code or None); what is no number is written as it is."""
    return _typed_book([([v for v, _ in row], tuple(code for _, code in row)) for row in rows], sheet)


def coded_xlsx(rows: list[list[str]], codes: list[str | None], sheet: str = "s") -> bytes:
    """The same where a column has one format code."""
    every = {n: tuple(codes[:n]) for n in {len(row) for row in rows}}
    return _typed_book([(row, every[len(row)]) for row in rows], sheet)


def _typed_book(rows: list[tuple[list[str], tuple[str | None, ...]]], sheet: str) -> bytes:
    codes = list(dict.fromkeys(code for row in dict.fromkeys(row for _, row in rows) for code in row if code))
    styles = "<styleSheet><numFmts>" + "".join(f"<numFmt numFmtId='{164 + k}' formatCode={quoteattr(c)}/>" for k, c in enumerate(codes)) + "</numFmts><cellXfs><xf numFmtId='0'/>" + "".join(f"<xf numFmtId='{164 + k}'/>" for k in range(len(codes))) + "</cellXfs></styleSheet>"
    number = re.compile(r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?").fullmatch
    tag = lambda column, row, code: f'<c r="{_reference(column, 0)[:-1]}{row}" s="{codes.index(code) + 1 if code else 0}"'
    cell = lambda value: f"><v>{value}</v></c>" if number(value) else f' t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    # Rows of numbers alone are written by one template for each list of codes.
    of_numbers: dict[tuple[str | None, ...], Callable[..., str]] = {}
    lines = []
    for r, (values, shown) in enumerate(rows, 1):
        if all(map(number, values)):
            if shown not in of_numbers:
                of_numbers[shown] = ('<row r="{0}">' + "".join(f"{tag(c, '{0}', code)}><v>{{{c + 1}}}</v></c>" for c, code in enumerate(shown)) + "</row>").format
            lines.append(of_numbers[shown](r, *values))
        else:
            lines.append(f'<row r="{r}">' + "".join(tag(c, r, code) + cell(v) for c, (v, code) in enumerate(zip(values, shown)) if v) + "</row>")
    body = "".join(lines)
    book = f"<workbook {R}><sheets><sheet name={quoteattr(sheet)} r:id='rId1'/></sheets></workbook>"
    rels = "<Relationships><Relationship Id='rId1' Target='/xl/sheet.xml'/></Relationships>"
    return zipped({"[Content_Types].xml": "<Types/>", "xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/styles.xml": styles, "xl/sheet.xml": f"<worksheet><sheetData>{body}</sheetData></worksheet>"})


def epub(chapters: list[str]) -> bytes:
    """XHTML bodies in reading order; their files are numbered the other way round."""
    n = len(chapters)
    items = "".join(f'<item id="c{k}" href="text/c{n - k}.xhtml"/>' for k in range(n))
    refs = "".join(f'<itemref idref="c{k}"/>' for k in range(n))
    members: dict[str, str | bytes] = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>', "OPS/book.opf": f"<package><manifest>{items}</manifest><spine>{refs}</spine></package>"}
    for k, body in enumerate(chapters):
        members[f"OPS/text/c{n - k}.xhtml"] = f"<html><head><title>no</title></head><body>{body}</body></html>"
    return zipped(members)


def eml(text: str, html: bool = False, quoted_printable: bool = False) -> bytes:
    """A multipart message with an attachment before its body."""
    kind = "html" if html else "plain"
    body = quopri.encodestring(text.encode()).decode() if quoted_printable else base64.encodebytes(text.encode()).decode()
    coding = "quoted-printable" if quoted_printable else "base64"
    return f"From: a@b.example\r\nSubject: =?x?=\r\nContent-Type: multipart/mixed; boundary=\"=b=\"\r\n\r\npreamble\r\n--=b=\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=x.txt\r\n\r\nnot this\r\n--=b=\r\nContent-Type: text/{kind}; charset=utf-8\r\nContent-Transfer-Encoding: {coding}\r\n\r\n{body}\r\n--=b=--\r\n".encode()


def rtf(text: str) -> bytes:
    out = []
    for c in text:
        x = ord(c)
        if c in "\\{}":
            out.append("\\" + c)
        elif c == "\n":
            out.append("\\par ")
        elif c == "\t":
            out.append("\\tab ")
        elif x < 0x80:
            out.append(c)
        else:
            out.append(f"\\u{x - 65536 if 32767 < x < 0x10000 else x}?")
    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Font;}}\\uc1 " + "".join(out) + "}").encode()


def delimited(rows: list[list[str]], comma: str = ",") -> bytes:
    quote = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in (comma, '"', "\n", "\r")) or c == "" else c
    return "".join(comma.join(map(quote, row)) + "\n" for row in rows).encode()
