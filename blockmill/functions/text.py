"""Text kernels: Column expressions where Catalyst can state them, plain Python for byte-exact work."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is trimmed.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = re.compile(f"[{WHITE_SPACE}]+")
_STRAY = re.compile("[\udc80-\udcff]+")

# ---- Python ----


def trim(text: str) -> str:
    return text.strip(WHITE_SPACE)


def collapse(text: str) -> str:
    """Runs of white space as one blank, none at the ends."""
    return _BLANKS.sub(" ", text).strip(" ")


def valid_text(data: bytes) -> str:
    """UTF-8 decoded; each run of invalid bytes gives one replacement character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return _STRAY.sub("�", data.decode("utf-8", "surrogateescape"))


def clean(text: str) -> str:
    """The same for text that was decoded with surrogate escapes."""
    return _STRAY.sub("�", text) if not text.isascii() else text


def paragraphs(text: str) -> list[str]:
    return [t for p in text.replace("\r\n", "\n").split("\n\n") if (t := trim(p))]


def byte_pieces(text: str, limit: int) -> list[str]:
    """Consecutive pieces of at most `limit` bytes, cut before a character; where not one character fits, its bytes are
    parted, and what is no character by itself shows as a replacement character. A limit of 0 or less: the whole text."""
    data = text.encode("utf-8", "replace")
    if limit <= 0 or len(data) <= limit:
        return [text]
    out = []
    while len(data) > limit:
        cut = limit
        while cut and data[cut] & 0xC0 == 0x80:
            cut -= 1
        cut = cut or limit
        out.append(valid_text(data[:cut]))
        data = data[cut:]
    return [*out, valid_text(data)] if data else out


def closing_words(text: str, size: int) -> str:
    """At most the last `size` bytes, from the start of a character and, where a blank follows, of a word."""
    if size <= 0:
        return ""
    data = text.encode("utf-8", "replace")
    if len(data) <= size:
        return trim(text)
    start = len(data) - size
    while start < len(data) and data[start] & 0xC0 == 0x80:
        start += 1
    tail = data[start:].decode("utf-8")
    gap = re.search("[ \n\t]", tail)
    if gap and gap.start() < len(tail) - 1:
        tail = tail[gap.start() + 1 :]
    return trim(tail)


def quoted(name: str) -> str:
    """A name between double quotes, with escapes for quotes, backslashes and what does not print."""
    short = {'"': '\\"', "\\": "\\\\", "\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}
    out = []
    for c in name:
        x = ord(c)
        if c in short:
            out.append(short[c])
        elif c == " " or c.isprintable():
            out.append(c)
        else:
            out.append(f"\\x{x:02x}" if x < 0x80 else f"\\u{x:04x}" if x < 0x10000 else f"\\U{x:08x}")
    return '"' + "".join(out) + '"'


def column_letter(index: int) -> str:
    """0 is A, 25 Z, 26 AA; below 0 also A."""
    name, rest = "", max(0, index) + 1
    while rest:
        rest, digit = divmod(rest - 1, 26)
        name = chr(65 + digit) + name
    return name


# ---- Columns ----

_CLASS = "[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_CLASS}+|{_CLASS}+$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{_CLASS}+", " "))


def paragraph_list(text: Column) -> Column:
    """The paragraphs of a text: what stands between two line feeds, trimmed, without empty ones."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n", -1)
    return F.filter(F.transform(parts, trimmed), lambda p: p != "")


def tokens_estimated(text: Column) -> Column:
    n = F.octet_length(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).cast("int")


def column_name(index: Column) -> Column:
    """column_letter as an expression, for up to three letters."""
    n = F.greatest(index, F.lit(0))
    letter = lambda k: F.char(F.lit(65) + k)
    one = letter(n)
    m = n - 26
    two = F.concat(letter(F.floor(m / 26)), letter(m % 26))
    k = n - 702
    three = F.concat(letter(F.floor(k / 676)), letter(F.floor(k / 26) % 26), letter(k % 26))
    return F.when(n < 26, one).when(n < 702, two).otherwise(three)


def without_quotes(body: Column) -> Column:
    """A plain mail body up to the signature mark, without quoted lines."""
    lines = F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    mark = F.array_position(lines, "-- ")
    kept = F.when(mark > 0, F.slice(lines, F.lit(1), (mark - 1).cast("int"))).otherwise(lines)
    return F.array_join(F.filter(kept, lambda x: ~F.startswith(trimmed(x), F.lit(">"))), "\n")
