"""Stored numbers of a workbook as its format codes show them."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from fractions import Fraction
from functools import lru_cache

# The codes of built-in formats.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "hh:mm", 21: "hh:mm:ss", 22: "m/d/yy hh:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[red](#,##0)", 39: "#,##0.00 ;(#,##0.00)", 40: "#,##0.00 ;[red](#,##0.00)",
    41: '_(* #,##0_);_(* \\(#,##0\\);_(* "-"_);_(@_)', 42: '_("$"* #,##0_);_("$"* \\(#,##0\\);_("$"* "-"_);_(@_)',
    43: '_(* #,##0.00_);_(* \\(#,##0.00\\);_(* "-"??_);_(@_)', 44: '_("$"* #,##0.00_);_("$"* \\(#,##0.00\\);_("$"* "-"??_);_(@_)',
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}

_TOKEN = re.compile(
    r'"(?P<quoted>[^"]*)"?|\\(?P<escaped>.)|_(?P<space>.)|\*(?P<fill>.)|\[\$(?P<currency>[^\]-]*)[^\]]*\]|\[(?P<elapsed>h+|m+|s+)\]|\[(?P<other>[^\]]*)\]|'
    r"(?P<general>General)|(?P<noon>AM/PM|A/P)|(?P<date>y+|m+|d+|h+|s+)|(?P<part>\.0+(?=$|[^0#?.]))|(?P<exponent>E[+-])|(?P<digit>[0#?])|(?P<sign>[.,%/@])|(?P<literal>.)",
    re.I | re.S,
)
Token = tuple[str, str]


@lru_cache(maxsize=4096)
def sections_of(code: str) -> tuple[tuple[Token, ...], ...]:
    """The sections of a code as tokens (kind, text): for positive numbers, negative ones, zero and text."""
    out: list[list[Token]] = [[]]
    for m in _TOKEN.finditer(code):
        kind = m.lastgroup or "literal"
        text = m.group(kind) if m.lastgroup else ""
        if kind == "literal" and text == ";":
            out.append([])
        elif kind in ("quoted", "escaped", "literal", "currency"):
            out[-1].append(("literal", text))
        elif kind == "space":
            out[-1].append(("literal", " "))
        elif kind == "part" and not any(k in ("date", "elapsed") for k, _ in out[-1]):
            out[-1].append(("sign", "."))
            out[-1] += [("digit", c) for c in text[1:]]
        elif kind not in ("fill", "other"):
            out[-1].append((kind, text))
    return tuple(tuple(s) for s in out)


def general(value: str) -> str:
    """A number without a format: as stored, or with at most 15 digits and no exponent where it was stored longer."""
    if not re.search("[eE]", value) and len(value) <= 16:
        return value
    number = float(value)
    short = f"{number:.15g}"
    return short if "e" not in short else f"{number:.20f}".rstrip("0").rstrip(".") if abs(number) < 1 else f"{number:.0f}"


#: Codes of one section with fixed places; numbers up to so many characters need no more digits than a Decimal keeps.
_FIXED = re.compile(r"(#,##)?0(?:\.(0{1,8}))?(%)?")
SIMPLE_CHARS = 16


@lru_cache(maxsize=4096)
def shown_by(code: str, from_1904: bool = False) -> Callable[[str], str]:
    """shown() for one code."""
    m = _FIXED.fullmatch(code)
    places, moved = (len(m[2] or ""), 2 if m[3] else 0) if m else (0, 0)
    kept, power, grouping, percent = places + moved, 10**places, bool(m and m[1]), "%" if moved else ""

    def other(value: str) -> str:
        return _shown(value, code, from_1904)

    def simple(value: str) -> str:
        whole, point, part = value.partition(".")
        if len(value) > SIMPLE_CHARS or not whole.isdigit() or point and not part.isdigit() or not value.isascii():
            return other(value)
        if not m:
            return value
        if moved or len(part) > places:
            units = int(whole + part[:kept].ljust(kept, "0")) + (part[kept : kept + 1] >= "5")
            head, tail = divmod(units, power)
            part = f"{tail:0{places}}"
        else:
            head = int(whole)
        left = f"{head:,}" if grouping else str(head)
        return f"{left}.{part.ljust(places, '0')}{percent}" if places else left + percent

    return simple if m or code == "General" else other


def shown(value: str, code: str, from_1904: bool = False) -> str:
    """A stored number under a format code; what is no number, or cannot be shown so, as stored."""
    return shown_by(code, from_1904)(value)


@lru_cache(maxsize=1 << 16)
def _shown(value: str, code: str, from_1904: bool) -> str:
    try:
        number = Decimal(value.strip())
        if not number.is_finite():
            return value
        sections = sections_of(code)
        at = 1 if number < 0 and len(sections) > 1 else 2 if number == 0 and len(sections) > 2 else 0
        tokens, size = sections[at], abs(number) if at == 1 else number
        kinds = {k for k, _ in tokens}
        if "date" in kinds or "elapsed" in kinds:
            return _date(tokens, size, from_1904)
        if not kinds & {"digit", "general", "sign"} and not any(t == "." for _, t in tokens):
            return "".join(t for _, t in tokens)
        if "general" in kinds or ("sign", "@") in tokens:
            return "".join(general(str(size) if at == 1 else value) if k == "general" or t == "@" else t for k, t in tokens)
        return _number(tokens, size)
    except (InvalidOperation, ValueError, OverflowError, ArithmeticError):
        return value


def _number(tokens: tuple[Token, ...], number: Decimal) -> str:
    digits = [k for k, (kind, _) in enumerate(tokens) if kind == "digit"]
    first, last = digits[0], digits[-1]
    while ("sign", "/") in tokens and last + 1 < len(tokens) and (tokens[last + 1] == ("sign", "/") or tokens[last + 1][1].isdigit()):
        last += 1  # a fixed denominator
    before, body, after = tokens[:first], list(tokens[first : last + 1]), list(tokens[last + 1 :])
    if before and before[-1] == ("sign", "."):
        before, body = before[:-1], [("sign", "."), *body]
    number = number.scaleb(2 * sum(t == ("sign", "%") for t in tokens))
    while after and after[0] == ("sign", ","):  # thousands left out
        number, after = number.scaleb(-3), after[1:]
    sign, number = ("-", -number) if number < 0 else ("", number)
    text = _exponent(body, number) if any(k == "exponent" for k, _ in body) else _fraction(body, number) if ("sign", "/") in body else _decimal(body, number)
    if not any(c in "123456789" for c in text):
        sign = ""
    return sign + "".join(t for _, t in before) + text + "".join(t for _, t in after)


def _padded(pattern: list[str], digits: str) -> str:
    """Digits under placeholders 0 (always shown), ? (a blank) and #."""
    digits = digits.lstrip("0")
    missing = pattern[: max(0, len(pattern) - len(digits))]
    return "".join("0" if p == "0" else " " if p == "?" else "" for p in missing) + digits


def _decimal(body: list[Token], number: Decimal) -> str:
    point = body.index(("sign", ".")) if ("sign", ".") in body else len(body)
    whole = [t for k, t in body[:point] if k == "digit"]
    grouped = ("sign", ",") in body[:point]
    places = [t for k, t in body[point:] if k == "digit"]
    head, _, tail = f"{number.quantize(Decimal(1).scaleb(-len(places)), ROUND_HALF_UP):f}".partition(".")
    left = _padded(whole, head)
    if grouped:
        left = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", left)
    keep = max((k + 1 for k, p in enumerate(places) if p == "0" or tail[k] != "0"), default=0)
    right = tail[:keep] + "".join(" " for p in places[keep:] if p == "?")
    # Literals between the placeholders stand where they are written, counted from the right.
    inner = [(sum(k == "digit" for k, _ in body[at:point]), t) for at, (kind, t) in enumerate(body[:point]) if kind == "literal"]
    for behind, t in inner:
        cut = max(0, len(left) - behind)
        left = left[:cut] + t + left[cut:]
    return left + ("." if point < len(body) else "") + right


def _exponent(body: list[Token], number: Decimal) -> str:
    at = next(k for k, (kind, _) in enumerate(body) if kind == "exponent")
    step = max(1, sum(k == "digit" for k, _ in (body[: body.index(("sign", "."))] if ("sign", ".") in body[:at] else body[:at])))
    power = 0 if number == 0 else number.adjusted() // step * step
    mantissa = _decimal(body[:at], number.scaleb(-power))
    mark = body[at][1]
    shown_sign = "-" if power < 0 else "+" if mark[1] == "+" else ""
    return f"{mantissa}{mark[0]}{shown_sign}{_padded([t for k, t in body[at + 1 :] if k == 'digit'], str(abs(power)))}"


def _fraction(body: list[Token], number: Decimal) -> str:
    at = body.index(("sign", "/"))
    below = [t for k, t in body[at + 1 :] if k == "digit"]
    fixed = "".join(t for k, t in body[at + 1 :] if k == "literal" and t.isdigit())
    above = 0
    while above < at and body[at - 1 - above][0] == "digit":
        above += 1
    whole = [t for k, t in body[: at - above] if k == "digit"]
    ratio = Fraction(number)
    units = int(ratio) if whole else 0
    rest = ratio - units
    part = Fraction(round(rest * int(fixed)), int(fixed)) if fixed else rest.limit_denominator(10 ** len(below) - 1)
    if whole and part == 1:
        units, part = units + 1, Fraction(0)
    left = _padded(whole, str(units)) if whole else ""
    if part == 0 and whole:
        return left or "0"
    top, low = (part.numerator * int(fixed) // part.denominator, int(fixed)) if fixed else (part.numerator, part.denominator)
    return f"{left}{' ' if whole and left else ''}{str(top).rjust(sum(t == '?' for _, t in body[at - above : at]))}/{str(low).ljust(sum(t == '?' for t in below))}"


def _date(tokens: tuple[Token, ...], number: Decimal, from_1904: bool) -> str:
    places = max((len(t) - 1 for k, t in tokens if k == "part"), default=0)
    seconds = (number * 86400).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30)
    moment = start + datetime.timedelta(seconds=int(seconds))
    noon = any(k == "noon" for k, _ in tokens)
    clock = [(n, t[0].lower()) for n, (k, t) in enumerate(tokens) if k in ("date", "elapsed")]
    out = []
    for n, (kind, text) in enumerate(tokens):
        low = text.lower()
        if kind == "elapsed":
            out.append(str(int(seconds) // {"h": 3600, "m": 60, "s": 1}[low[0]]).zfill(len(low)))
        elif kind == "part":
            out.append(f"{seconds % 1:.{places}f}"[1:])
        elif kind == "noon":
            half = "AM" if moment.hour < 12 else "PM"
            out.append(half if len(text) > 3 else half[0])
        elif kind != "date":
            out.append(text)
        elif low[0] == "m":
            at = clock.index((n, "m"))
            # Minutes stand after hours or before seconds.
            minutes = at > 0 and clock[at - 1][1] == "h" or at + 1 < len(clock) and clock[at + 1][1] == "s"
            out.append(str(moment.minute).zfill(min(2, len(low))) if minutes else moment.strftime({3: "%b", 4: "%B"}[len(low)]) if len(low) in (3, 4) else moment.strftime("%b")[0] if len(low) > 4 else str(moment.month).zfill(len(low)))
        elif low[0] == "d":
            out.append(moment.strftime("%a" if len(low) == 3 else "%A") if len(low) > 2 else str(moment.day).zfill(len(low)))
        elif low[0] == "y":
            out.append(f"{moment.year:04d}" if len(low) > 2 else f"{moment.year % 100:02d}")
        elif low[0] == "h":
            out.append(str((moment.hour % 12 or 12) if noon else moment.hour).zfill(min(2, len(low))))
        else:
            out.append(str(moment.second).zfill(min(2, len(low))))
    return "".join(out)
