"""Extractors of formats that are text: paragraphs, delimited rows, HTML, mail and RTF."""

from __future__ import annotations

import base64
import binascii
import quopri
import re
from html.parser import HTMLParser

from blockmill.functions.text import clean, collapse, paragraphs, trim, valid_text
from blockmill.operators.blocks import CAPTION, EMAIL, HEADING, LIST_ITEM, PARAGRAPH, Block, prose, sheet_row
from blockmill.sources.archives import MAX_MEMBER, invalid


def text_blocks(data: bytes) -> list[Block]:
    return [prose(PARAGRAPH, p) for p in paragraphs(valid_text(data))]


# ---- delimited rows ----


def delimited_records(data: bytes, comma: bytes) -> list[list[bytes]]:
    """Records of a delimited file, leniently quoted: a quote within a bare field is text; within a quoted field, a quote that
    closes nothing is text too. Empty lines are no records. CR LF counts as LF, also within quotes."""
    lines = data.splitlines(keepends=True) if b"\r" not in data and b"\v" not in data and b"\f" not in data and b"\x1c" not in data and b"\x1d" not in data and b"\x1e" not in data else re.findall(rb"[^\n]*\n|[^\n]+", data)
    lines = [x[:-2] + b"\n" if x.endswith(b"\r\n") else x for x in lines]
    if lines and lines[-1].endswith(b"\r"):
        lines[-1] = lines[-1][:-1]
    records, at = [], 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if line in (b"\n", b""):
            continue
        fields: list[bytes] = []
        while True:
            if not line.startswith(b'"'):
                field, found, line = line.partition(comma)
                fields.append(field if found else field.removesuffix(b"\n"))
                if found:
                    continue
                break
            line, held, more = line[1:], [], False
            while True:
                before, quote, after = line.partition(b'"')
                held.append(before)
                if quote:
                    if after.startswith(b'"'):
                        held.append(b'"')
                        line = after[1:]
                    elif after.startswith(comma):
                        line, more = after[len(comma) :], True
                        break
                    elif after in (b"", b"\n"):
                        break
                    else:
                        held.append(b'"')
                        line = after
                elif at < len(lines):
                    line = lines[at]
                    at += 1
                else:
                    break
            fields.append(b"".join(held))
            if not more:
                break
        records.append(fields)
    return records


def delimited_blocks(data: bytes, comma: str) -> list[Block]:
    return [sheet_row([valid_text(c) for c in record], n) for n, record in enumerate(delimited_records(data, comma.encode()), 1)]


# ---- HTML ----

# Elements and what becomes of them.
_KINDS = {"p": PARAGRAPH, "li": LIST_ITEM, "blockquote": PARAGRAPH, "pre": PARAGRAPH, "td": PARAGRAPH, "th": PARAGRAPH, "caption": CAPTION, "figcaption": CAPTION}
_HEADINGS = {f"h{k}": k for k in range(1, 7)}
_HIDDEN = {"script", "style", "head", "noscript", "template"}
_HIDDEN_WITHIN = {"script", "style", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "keygen", "frame", "basefont", "bgsound"}
_ENDS_P = {
    *"address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre search section summary table ul listing plaintext xmp li dd dt".split(),
    *_HEADINGS,
}
_FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
#: The parts of a table, with the elements that each may stand in; other content of a table belongs before it.
_TABLE_PARTS = {**dict.fromkeys(("caption", "colgroup", "tbody", "thead", "tfoot"), {"table"}), "tr": {"table", "tbody", "thead", "tfoot"}, **dict.fromkeys(("td", "th"), {"table", "tbody", "thead", "tfoot", "tr"})}
_TABLE_FRAME = {"table", "tbody", "thead", "tfoot", "tr", "colgroup"}
_CELLS = {"td", "th", "caption"}
_SCOPE = {"table", "td", "th", "caption", "html", "button", "template", "object", "marquee", "applet"}


class _Tree(HTMLParser):
    """Follows open elements with the end tags that HTML implies, and collects the text of the outermost block elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.blocks: list[Block] = []
        self.inside = 0  # depth at which the block being collected was opened, 0 for none
        self.held: list[str] = []
        self.hidden = 0  # depth at which a hidden element was opened
        self.seen_body = False
        #: Of each open table: its depth, and where in the blocks and in the text being collected it began.
        self.tables: list[list[int]] = []
        self.before: list[int] | None = None  # the table before which the block being collected belongs

    def _misplaced(self) -> bool:
        """Whether content here stands in a table but in none of its cells."""
        nearest = next((t for t in reversed(self.open) if t in _TABLE_FRAME or t in _CELLS), None)
        return nearest in _TABLE_FRAME and bool(self.tables)

    def _pop(self) -> None:
        tag = self.open.pop()
        depth = len(self.open) + 1
        if self.hidden == depth:
            self.hidden = 0
        if self.inside == depth:
            self.inside = 0
            text = collapse("".join(self.held))
            self.held = []
            if text:
                level = _HEADINGS.get(tag, 0)
                at = self.before[1] if self.before else len(self.blocks)
                self.blocks.insert(at, prose(HEADING if level else _KINDS[tag], text, level))
                for table in self.tables:
                    table[1] += table[1] >= at and (table is self.before or table[1] > at)
            self.before = None
        if tag == "table" and self.tables and self.tables[-1][0] == depth:
            self.tables.pop()

    def _close_to(self, tags: set[str], bound: set[str]) -> bool:
        """Closes everything down to the nearest of `tags`, unless one of `bound` lies between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] in tags:
                while len(self.open) > k:
                    self._pop()
                return True
            if self.open[k] in bound:
                return False
        return False

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            if tag == "body":
                self._close_to({"head"}, set())
                self.seen_body = True
            return
        if tag == "head":
            if self.seen_body or "head" in self.open:
                return
        elif "head" in self.open and tag not in _HIDDEN_WITHIN and tag not in ("title", "meta", "link", "base", "basefont", "bgsound", "noframes"):
            self._close_to({"head"}, set())
            self.seen_body = True
        if tag in _TABLE_PARTS:
            if "table" not in self.open:
                return
            while self.open[-1] not in _TABLE_PARTS[tag]:
                self._pop()
        elif tag == "table" and self.open and self.open[-1] in _TABLE_FRAME:
            self._close_to({"table"}, set())
        if tag in _ENDS_P:
            self._close_to({"p"}, _SCOPE)
        if tag in _HEADINGS and self.open and self.open[-1] in _HEADINGS:
            self._pop()
        elif tag == "li":
            self._close_to({"li"}, _SCOPE | {"ul", "ol", "menu", "dir"})
        elif tag in ("dt", "dd"):
            self._close_to({"dt", "dd"}, _SCOPE | {"dl"})
        elif tag == "option":
            if self.open and self.open[-1] == "option":
                self._pop()
        elif tag == "a":
            self._close_to({"a"}, _SCOPE)
        elif tag == "button":
            self._close_to({"button"}, _SCOPE - {"button"})
        if tag in _VOID:
            return
        misplaced = tag not in _TABLE_PARTS and self._misplaced()
        self.open.append(tag)
        depth = len(self.open)
        if tag == "table":
            self.tables.append([depth, len(self.blocks), len(self.held)])
        if not self.hidden and tag in (_HIDDEN_WITHIN if self.inside else _HIDDEN):
            self.hidden = depth
        elif not self.hidden and not self.inside and (tag in _KINDS or tag in _HEADINGS):
            self.inside = depth
            self.held = []
            self.before = self.tables[-1] if misplaced else None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag):
        if tag in ("html", "body", "br"):
            return
        if tag in _HEADINGS:
            self._close_to(set(_HEADINGS), _SCOPE)
            return
        if tag in _FORMATTING and tag in self.open:
            self._end_formatting(tag)
            return
        bound = {"table", "template", "html"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "caption") else _SCOPE
        if tag == "table":
            bound = {"template", "html"}
        elif tag in bound:
            bound = bound - {tag}
        if tag in ("li",):
            bound = bound | {"ul", "ol"}
        elif tag not in _ENDS_P and tag not in _TABLE_PARTS and tag != "table" and tag not in _SCOPE and tag not in _HIDDEN:
            bound = bound | _ENDS_P  # the end of an inline element ends no block
        if tag in self.open:
            self._close_to({tag}, bound)
        if tag == "head":
            self.seen_body = True

    def _end_formatting(self, tag: str) -> None:
        """Ends the nearest element of a formatting tag; blocks that began within it stay open."""
        k = max(at for at, t in enumerate(self.open) if t == tag)
        above = self.open[k + 1 :]
        if any(t in _SCOPE for t in above):
            return
        if not any(t in _ENDS_P for t in above):
            self._close_to({tag}, set())
            return
        del self.open[k]
        self.inside -= self.inside > k + 1
        self.hidden -= self.hidden > k + 1
        for table in self.tables:
            table[0] -= table[0] > k + 1

    def handle_data(self, data):
        if not self.inside or self.hidden:
            return
        table = self.tables[-1] if data.strip() and self._misplaced() else None
        if table and table[0] > self.inside:
            self.held.insert(table[2], data)
            for other in self.tables:
                other[2] += other[2] >= table[2]
        else:
            self.held.append(data)

    def finish(self) -> list[Block]:
        self.close()
        while self.open:
            self._pop()
        return self.blocks


def html_blocks(data: bytes, anchor: str = "Section") -> list[Block]:
    tree = _Tree()
    tree.feed(valid_text(data).replace("\r\n", "\n").replace("\r", "\n").replace("\x00", ""))
    blocks = tree.finish()
    return blocks if anchor == "Section" else [b._replace(anchor_kind=anchor) for b in blocks]


# ---- mail ----

_TOKEN = r"[!#$%&'*+\-.0-9A-Z^_`a-z{|}~]+"
_MEDIA = re.compile(rf"\s*({_TOKEN}(?:/{_TOKEN})?)\s*(?=;|$)")
_PARAMETER = re.compile(rf"\s*;\s*({_TOKEN})\s*=\s*(?:\"((?:\\.|[^\"\\])*)\"|({_TOKEN}))\s*")
#: Fixed value: multiparts are followed to this depth.
MAX_DEPTH = 8


def media_type(value: str) -> tuple[str, dict[str, str], bool]:
    """(type in lower case, parameters, whether all of it is well formed)."""
    m = _MEDIA.match(value)
    if not m:
        return "", {}, False
    kind, at, found, good = m.group(1).lower(), m.end(), {}, True
    while p := _PARAMETER.match(value, at):
        key = p.group(1).lower()
        good = good and key not in found
        found[key] = re.sub(r"\\(.)", r"\1", p.group(2)) if p.group(2) is not None else p.group(3)
        at = p.end()
    return kind, found, good and not value[at:].strip(" \t;")


def split_headers(data: bytes, strict: bool) -> tuple[dict[str, str], bytes]:
    """(first value of each header by lower-case name, body). `strict`: a line that is no header rejects the message."""
    headers: dict[str, str] = {}
    at, key = 0, None
    if strict and data[:1] in (b" ", b"\t"):
        raise invalid("the mail does not begin with a header")
    while at < len(data):
        end = data.find(b"\n", at)
        line, following = (data[at:], len(data)) if end < 0 else (data[at:end], end + 1)
        line = line.removesuffix(b"\r")
        at = following
        if not line:
            return headers, data[at:]
        if line[:1] in (b" ", b"\t"):
            if key is not None:
                headers[key] += " " + valid_text(line).strip(" \t")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            if strict:
                raise invalid("a header of the mail has no colon")
            key = None
            continue
        name = valid_text(name).rstrip(" \t").lower()
        key = name if name not in headers else None
        if key is not None:
            headers[key] = valid_text(value).strip(" \t")
    if strict and not headers:
        raise invalid("the mail has no header")
    return headers, b""


def transferred(body: bytes, encoding: str) -> bytes:
    kind = encoding.strip().lower()
    if kind == "base64":
        packed = b"".join(body.split())
        try:
            return base64.b64decode(packed, validate=True) if len(packed) % 4 == 0 else body
        except (binascii.Error, ValueError):
            return body
    return quopri.decodestring(body) if kind == "quoted-printable" else body


def _parts(body: bytes, boundary: str) -> list[bytes]:
    mark = b"--" + boundary.encode("utf-8", "replace")
    parts, at, start = [], 0, None
    for m in re.finditer(rb"(?:^|(?<=\n))" + re.escape(mark) + rb"(--)?[ \t]*(?:\r?\n|$)", body):
        if start is not None:
            parts.append(re.sub(rb"\r?\n\Z", b"", body[start : m.start()]))
        if m.group(1):
            return parts
        start = m.end()
    if start is not None:
        parts.append(body[start:])
    return parts


def _multipart(body: bytes, boundary: str, depth: int) -> tuple[bytes, bool] | None:
    """(text, whether it is HTML) of the first plain part, else of the first HTML part."""
    if not boundary or depth >= MAX_DEPTH:
        return None
    html = None
    for part in _parts(body, boundary):
        headers, content = split_headers(part, strict=False)
        if media_type(headers.get("content-disposition", ""))[0] == "attachment":
            continue
        kind, found, _ = media_type(headers.get("content-type", ""))
        if kind.startswith("multipart/"):
            inner = _multipart(content, found.get("boundary", ""), depth + 1)
            if inner and not inner[1]:
                return inner
            if inner and html is None:
                html = inner[0]
        elif kind in ("text/plain", "text/html"):
            text = transferred(content[:MAX_MEMBER], headers.get("content-transfer-encoding", ""))
            if kind == "text/plain":
                return text, False
            html = text if html is None else html
    return (html, True) if html else None


def mail_body(data: bytes) -> tuple[bytes, bool]:
    headers, body = split_headers(data, strict=True)
    kind, found, good = media_type(headers.get("content-type", ""))
    kind = kind if good else "text/plain"
    if kind.startswith("multipart/"):
        return _multipart(body, found.get("boundary", ""), 0) or (b"", False)
    return transferred(body[:MAX_MEMBER], headers.get("content-transfer-encoding", "")), kind == "text/html"


def unquoted(body: str) -> str:
    kept = []
    for line in body.replace("\r\n", "\n").split("\n"):
        if line == "-- ":
            break
        if not trim(line).startswith(">"):
            kept.append(line)
    return "\n".join(kept)


def mail_blocks(data: bytes) -> list[Block]:
    body, is_html = mail_body(data)
    if is_html:
        blocks = html_blocks(body, EMAIL)
        if blocks:
            return blocks
    text = unquoted(body.decode("utf-8", "surrogateescape"))
    return [prose(PARAGRAPH, clean(p), 0, EMAIL) for p in paragraphs(text)]


# ---- RTF ----

# Groups that hold no text of the document, and control words that end a line.
_RTF_SKIPPED = set("fonttbl colortbl stylesheet info pict object themedata colorschememapping latentstyles datastore generator header footer headerl headerr headerf footerl footerr footerf".split())
_RTF_LINES = {"par", "line", "sect", "pard"}
_RTF = re.compile(rb"\\(?:([\\{}])|(\*)|'(..)|([A-Za-z]*)(-?[0-9]*) ?)|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)


def _rune(code: int) -> bytes:
    return chr(code).encode() if 0 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else "�".encode()


def _hex(pair: bytes) -> int:
    digit = lambda c: int(chr(c), 16) if chr(c) in "0123456789abcdefABCDEF" else 0
    return digit(pair[0]) * 16 + digit(pair[1])


def rtf_text(data: bytes) -> bytes:
    out: list[bytes] = []
    # Of each open group: dropped or not, whether a word may still name it, characters that replace a \u.
    groups: list[list] = [[False, False, 1]]
    skip = at = 0
    while at < len(data):
        m = _RTF.match(data, at)
        if m is None or data[at : at + 2] == b"\\'" and m.group(3) is None:  # an unfinished escape at the end
            break
        at = m.end()
        group = groups[-1]
        literal, star, pair, word, number, brace, char = m.groups()
        if brace is not None:
            if brace == b"{":
                groups.append([group[0], True, group[2]])
            elif len(groups) > 1:
                groups.pop()
            skip = 0
        elif literal is not None or char is not None or pair is not None:
            if char is not None:
                dropped = min(skip, len(char))
                skip, char = skip - dropped, char[dropped:]
                if not char:
                    continue
            elif skip:
                skip -= 1
                if pair is not None:
                    group[1] = False
                continue
            if not group[0]:
                out.append(_rune(_hex(pair)) if pair is not None else literal if literal is not None else char)
            group[1] = False
        elif star is not None:
            group[0] = True
        elif word is not None:
            name = word.decode()
            if group[1] and name in _RTF_SKIPPED:
                group[0] = True
            group[1] = False
            value = int(number) if number.lstrip(b"-") else None
            if name == "uc":
                if value is not None and value >= 0:
                    group[2] = value
            elif name == "u":
                if value is not None:
                    if not group[0]:
                        out.append(_rune(value + 65536 if value < 0 else value))
                    skip = group[2]
            elif not group[0]:
                if name in _RTF_LINES:
                    out.append(b"\n")
                elif name == "tab":
                    out.append(b"\t")
    return b"".join(out)


def rtf_blocks(data: bytes) -> list[Block]:
    return [prose(PARAGRAPH, clean(p)) for p in paragraphs(rtf_text(data).decode("utf-8", "surrogateescape"))]
