"""Problem 1: only what its sender newly wrote, out of the lines of each mail.

History first: for each thread an automaton of every sentence and every line of its messages, of any length, is run over all
lines of each message; matches of what an earlier message held are merged into intervals, and lines that they cover
are taken away. Then the sender's closing blocks: runs of lines whose sentences recur over the threads of one sender, or over many
senders, with names, numbers and addresses masked, are a second automaton, run over what is left, from the end upwards. Marks of quoting,
heads, introductions and the usual closing formulas support both where an original is not in the tables.

Threads are components of replies; an answer without a known reference counts to the mails of its subject. A thread of more than
SLICE_CHARS characters is dealt into slices of its messages. To a slice come those patterns of the thread of which it holds
a gram that every match must hold (see routes), one after another in bounded batches, so the result is the same as
for the whole thread and no task holds a thread. A mail itself is bounded by the size of an upload (150 MiB).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.llm.components import connected_components
from blockmill.sources.tables import latest_rows, with_checkpoints

# ---- fixed values: words of the mail conventions that are recognised ----

CLOSINGS = """
best|best wishes|best regards|kind regards|kindest regards|warm regards|warmly|regards|many regards|yours|yours truly|yours sincerely|yours faithfully|sincerely|cheers|thanks|thanks again|thanks a lot|many thanks|thank you|thx|ta|br|kr|rgds|
many thanks and see you soon|thanks and regards|thanks and best regards|see you soon|talk soon|take care|all the best|with best wishes|with kind regards|with thanks|cordially|respectfully|
mit freundlichen grüßen|mit freundlichem gruß|freundliche grüße|viele grüße|beste grüße|liebe grüße|schöne grüße|herzliche grüße|gruß|grüße|vg|lg|mfg|bg|danke|vielen dank|danke und gruß|danke und bis bald|bis bald|besten dank|
cordialement|bien cordialement|bien à vous|bien à toi|merci|merci d'avance|merci et à bientôt|merci beaucoup|à bientôt|amicalement|salutations|sincères salutations|cdlt|
saludos|saludos cordiales|un saludo|un cordial saludo|atentamente|gracias|muchas gracias|gracias y hasta pronto|muchas gracias y hasta pronto|cordialmente|hasta pronto|abrazos|un abrazo|
abraços|um abraço|atenciosamente|obrigado|obrigada|muito obrigado|muito obrigada|obrigado e até breve|obrigada e até breve|cumprimentos|até breve|att|saudações|
pozdrawiam|z poważaniem|dziękuję|с уважением|спасибо|всего доброго|με εκτίμηση|ευχαριστώ|cordiali saluti|grazie|distinti saluti|met vriendelijke groet|groeten|med vänliga hälsningar|hälsningar
"""
GREETINGS = "hi|hello|hey|dear|good morning|good afternoon|good evening|good day|greetings|morning|hallo|guten|moin|lieber|liebe|sehr|servus|bonjour|bonsoir|salut|cher|chère|hola|buenos|buenas|estimado|estimada|querido|querida|olá|oi|bom|boa|caro|cara|prezado|prezada|dzień|cześć|witam|szanowny|szanowna|здравствуйте|привет|добрый|γεια|καλημέρα|ciao|buongiorno|beste|hej"
VERBS = "wrote|said|writes|schrieb|schreibt|écrit|escribió|escribio|escreveu|napisał|napisała|scritto|schreef|skrev|писал|писала|написал|написала|έγραψε"
HEADER_KEYS = "from|sent|to|cc|bcc|subject|date|reply-to|von|gesendet|an|betreff|datum|de|envoyé|à|objet|para|enviado|enviado el|asunto|assunto|data|fecha|da|inviato|oggetto|od|wysłano|do|temat|от|кому|тема|дата"
FROM_KEYS = "from|von|de|da|od|от"

DEVICE = r"sent (?:from|via|by|with|on) \w+|get \w+ for (?:your|my|i?os|android)|envoyé de(?:puis)? mon|von meinem .{2,30} gesendet|gesendet (?:von|mit) meinem|enviado (?:desde|d[oe]) m[ei]u?|inviato d|wysłane z|отправлено с|verzonden vanaf|skickat från"

_CLOSE = {c.strip() for c in CLOSINGS.replace("\n", "").split("|")}
_GREET = re.compile(rf"(?:{GREETINGS})\b.{{0,40}}|[^\W\d_][\w'’.-]{{0,24}}(?: [^\W\d_][\w'’.-]{{0,24}})?\s*[,:!]", re.I)
_MARK = re.compile(r"\s*(?:[A-Z]{1,3}>|[>»|]|Â»|В»|┬╗|¬ª|: |:$)")
_STRIP = re.compile(r"(?:\s*(?:[A-Z]{1,3}>|[>»|:]|Â»|В»|┬╗|¬ª))+ ?")
_DATE = re.compile(r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\b\d{1,2}\.? [^\W\d_]{3,9}\.?,? \d{4}\b|\b[^\W\d_]{3,9}\.? \d{1,2}, ?\d{4}\b|\b\d{4}-\d\d-\d\d\b")
_ADDRESS = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")
_VERB = re.compile(rf"\b(?:{VERBS})\b", re.I)
_HEADER = re.compile(rf"[*_]?(?:{HEADER_KEYS})\s?:[*_]?(?:\s|$)", re.I)
_FROM = re.compile(rf"[*_]?(?:{FROM_KEYS})\s?:[*_]?\s", re.I)
_RULED = re.compile(r"[-_=*~]{3,}\s*[^-_=*~\s].*?[-_=*~]{3,}")
_LINE = re.compile(r"[_=*#~—–-]{2,}\s*")
_FORWARD = re.compile(r"(?:begin forwarded message|(?:fw|fwd|forwarded|wg|tr|rv|enc)\b:?(?: from| by| von| de)? .{2,60}):\s*|begin forwarded message:?", re.I)
_POSTSCRIPT = re.compile(r"(?:p\.? ?){1,3}s\b|n\.?b\b", re.I)
_PHONE = re.compile(r"\+\d[\d ()../-]{5,}\d|\b(?:ext|tel|fax|mob|phone|desk|room|durchwahl)\b\.?:? ?\+?\d+", re.I)
_SITE = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,7}\b", re.I)
_DEVICE = re.compile(DEVICE, re.I)
_SENTENCE = re.compile(r"(?<=[.!?…。])\s+")
_SPACES = re.compile(r"\s+")

#: A run of lines is history if its intervals hold at least so many characters together, and a line of it this share; fewer
#: characters (a greeting, a thanks) are written anew again and again.
HISTORY_CHARS, HISTORY_SHARE = 24, 0.8
#: A sentence or line closes mails if it stands in this many threads of a sender, or with this many senders.
SENDER_THREADS, ANY_SENDERS = 2, 3
#: The share of a closing block that recurring sentences cover, and the least words of one that nothing else shows to be one.
CLOSING_SHARE, CLOSING_WORDS = 0.6, 4
#: Characters of a thread, or of a slice of one, that are taken together; patterns in one automaton where they come by route.
SLICE_CHARS, ROUTED = 1 << 20, 20_000


def plain(text: str) -> str:
    """White space as single blanks, none at the ends."""
    return _SPACES.sub(" ", text).strip()


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass(slots=True)
class Line:
    block_id: int
    block: int
    number: int
    text: str
    bare: str
    why: str = ""
    history: bool = False


@dataclass
class Mail:
    lines: list[Line] = field(default_factory=list)
    name: str = ""
    address: str = ""
    #: Places in `lines` at which what is passed on below a head begins.
    heads: list[int] = field(default_factory=list)


def read_mail(blocks: list[tuple[int, int, str]], sender: str | None) -> Mail:
    """Lines of the blocks (block_no, block_id, text) in order, those of white space alone left out."""
    mail = Mail()
    mail.name, mail.address = sender_of(sender)
    for at, (_, block_id, text) in enumerate(sorted(blocks, key=lambda b: (b[0], b[1]))):
        for number, line in enumerate((text or "").split("\n"), 1):
            if bare := plain(line):
                mail.lines.append(Line(block_id, at, number, line, bare))
    return mail


def sender_of(sender: str | None) -> tuple[str, str]:
    """(name, address) of `Name <address>`."""
    m = re.fullmatch(r"\s*\"?(.*?)\"?\s*<([^>]*)>\s*", sender or "")
    return (plain(m.group(1)), m.group(2).lower()) if m else ("", (sender or "").lower())


# ---- marks ----


def mark_structure(mail: Mail) -> None:
    """Marks quoted lines and the lines that introduce or head passed-on text, and notes where that begins."""
    _mark_quoted(mail.lines)
    _mark_heads(mail)
    _mark_introductions(mail.lines)


def _mark_quoted(lines: list[Line]) -> None:
    marks = [m.group().strip() if (m := _MARK.match(x.text)) else None for x in lines]
    for x, mark in zip(lines, marks):
        if mark is not None and (mark not in ("|", ":") or marks.count(mark) > 1):
            x.why = "quoted"


def _mark_heads(mail: Mail) -> None:
    lines, n, i = mail.lines, len(mail.lines), 0
    while i < n:
        if lines[i].why or not _HEADER.match(lines[i].bare):
            i += 1
            continue
        j = i
        while j < n and not lines[j].why and (_HEADER.match(lines[j].bare) or _folded(lines, i, j)):
            j += 1
        own = [x.bare for x in lines[i:j]]
        first = next((t for t in own if _FROM.match(t)), None)
        above = lines[i - 1].bare if i else ""
        ruled = bool(_RULED.fullmatch(above) or _LINE.fullmatch(above) or _FORWARD.fullmatch(above))
        if first is not None and (ruled or _ADDRESS.search(first) or len(own) > 2 or len(own) > 1 and _DATE.search(" ".join(own))):
            for x in lines[i - ruled : j]:
                x.why = "head"
            mail.heads.append(j)
        i = j
    for i, x in enumerate(lines):
        if not x.why and len(x.bare) < 90 and (_FORWARD.fullmatch(x.bare) or _RULED.fullmatch(x.bare)):
            x.why = "head"
            mail.heads.append(i + 1)
    mail.heads.sort()


def _folded(lines: list[Line], i: int, j: int) -> bool:
    """Whether line j continues a header line above it: another one follows it soon in the same block."""
    block = lines[j].block
    return j > i and block == lines[j - 1].block and any(x.block == block and _HEADER.match(x.bare) for x in lines[j + 1 : j + 3])


def _mark_introductions(lines: list[Line]) -> None:
    """Lines that introduce a quotation, on up to three lines."""
    for i in range(len(lines)):
        for span in (1, 2, 3):
            part = lines[i : i + span]
            if len(part) < span or any(x.why for x in part) or part[0].block != part[-1].block:
                break
            text = " ".join(x.bare for x in part)
            dated = _DATE.search(text) or _ADDRESS.search(text)
            if not text.endswith(":") or len(text) >= 200 or not (dated or _VERB.search(text)) or _GREET.fullmatch(text):
                continue
            sure = dated and (_VERB.search(text) or text[0] in "[*" or text.count(" ") < 14)
            follows = i + span < len(lines) and bool(lines[i + span].why)
            if (sure or follows) and (span == 1 or not _ends_sentence(part[0].bare)):
                for x in part:
                    x.why = "introduction"
                break


def _ends_sentence(text: str) -> bool:
    return text[-1:] in ".!?"


# ---- history ----


_BEYOND = re.compile("(?:[^\x00-\x7f]|&#x?[0-9a-fA-F]+;)+")


def folded(text: str) -> str:
    """The text without characters beyond ASCII, where most of its letters are left: they are what a wrong decoding garbles, so
    a message and a garbled copy of it agree."""
    if text.isascii() and "&#" not in text:
        return text
    short = plain(_BEYOND.sub("", text))
    return short if 2 * sum(map(str.isalpha, short)) > sum(map(str.isalpha, text)) else text


def stream_of(lines: list[Line]) -> tuple[str, list[tuple[int, int]]]:
    """The texts of lines without quote marks, joined by blanks, and the place of each line in it."""
    out, spans, at = [], [], 0
    for x in lines:
        m = _STRIP.match(x.text)
        t = plain(x.text[m.end() :]) if m else x.bare
        t = folded(t)
        out.append(t)
        spans.append((at, at + len(t)))
        at += len(t) + 1
    return " ".join(out), spans


def patterns_of(mail: Mail) -> set[str]:
    """All sentences and lines of a message, of any length, quoted or not, without quote marks."""
    out: set[str] = set()
    at = 0
    while at < len(mail.lines):
        end = at + 1
        while end < len(mail.lines) and mail.lines[end].block == mail.lines[at].block:
            end += 1
        text, spans = stream_of(mail.lines[at:end])
        out.update(s.strip() for s in _SENTENCE.split(text))
        out.update(text[a:b] for a, b in spans)
        at = end
    return {p for p in out if any(c.isalnum() for c in p)}


class Scan:
    """A message under an automaton: which characters of its lines earlier messages hold."""

    def __init__(self, mail: Mail, stamp: tuple):
        self.mail, self.stamp = mail, stamp
        self.text, self.spans = stream_of(mail.lines)
        self.covered = bytearray(len(self.text))

    def run(self, automaton) -> None:
        text, covered, stamp, size = self.text, self.covered, self.stamp, len(self.text)
        for end, (length, first) in automaton.iter(text):
            start = end + 1 - length
            if first < stamp and (start == 0 or not text[start - 1].isalnum() or not text[start].isalnum()) and (end + 1 == size or not text[end + 1].isalnum() or not text[end].isalnum()):
                covered[start : end + 1] = b"\x01" * length

    def subtract(self) -> None:
        """Marks as history the lines that merged intervals cover, where they hold enough together or a mark says so too."""
        lines, covered = self.mail.lines, self.covered
        held = [covered.count(1, a, b) for a, b in self.spans]
        hit = [n >= HISTORY_SHARE * (b - a) and n > 0 for n, (a, b) in zip(held, self.spans)]
        at = 0
        while at < len(lines):
            end = at
            while end < len(lines) and hit[end] and bool(lines[end].why) == bool(lines[at].why):
                end += 1
            # A greeting that opens a mail is written anew, whatever follows it.
            first = at + (at == 0 and end > 0 and not lines[0].why and bool(_GREET.fullmatch(lines[0].bare)) and (end < 2 or lines[1].block != lines[0].block))
            enough = sum(held[first:end]) >= HISTORY_CHARS
            for x in lines[first:end]:
                x.history = enough or bool(x.why)
            at = max(end, at + 1)


def automaton_of(patterns: dict[str, tuple]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for text, first in patterns.items():
        automaton.add_word(text, (len(text), first))
    automaton.make_automaton()
    return automaton


def subtract_passed_on(mail: Mail) -> None:
    """Marks what is passed on below a head. Where the thread holds the original, that is everything up to the first line of history
    and what history covers; other lines are the sender's own. Where it does not, everything below the head."""
    for start, end in zip(mail.heads, [*mail.heads[1:], len(mail.lines)]):
        rest = [x for x in mail.lines[start:end] if not x.why]
        known = [k for k, x in enumerate(rest) if x.history]
        for k, x in enumerate(rest):
            if x.history or 2 * len(known) <= len(rest) or k < known[0]:
                x.why = "history" if x.history else "passed on"


def subtract_indented(mail: Mail) -> None:
    """Marks a quotation that follows its introduction indented or without any mark. Blocks are trimmed, so the
    first line of a block has lost its indent: such a line counts by the lines below it, or, alone, if it is history or if
    nothing of the mail after it is shown to be new."""
    lines = mail.lines
    for k, x in enumerate(lines[:-1]):
        if x.why != "introduction" or lines[k + 1].why:
            continue
        rest = [y for y in lines[k + 1 :] if not y.why]
        last = max((y.block for y in rest if y.text[:1] in " \t"), default=None)
        blocks: dict[int, list[Line]] = {}
        for y in rest:
            blocks.setdefault(y.block, []).append(y)
        for at, own in blocks.items():
            below = [y for y in own if y.number > 1]
            if below and all(y.text[:1] in " \t" for y in below):
                why = "indented"
            elif below and last is not None:
                return  # lines without the indent of the quotation: an answer
            elif last is None or own[0].history:
                why = "passed on"
            else:
                why = "indented" if last > at else ""
            for y in own:
                y.why = why
        return


# ---- closings ----


def runs_of(mail: Mail) -> list[tuple[int, list[Line]]]:
    """(stretch, lines) of the unmarked lines, by runs within a block; runs that are history throughout are left out, and they
    and marked lines end a stretch."""
    out: list[tuple[int, list[Line]]] = []
    stretch, at, lines = 0, 0, mail.lines
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end].block == lines[at].block and not lines[end].why:
            end += 1
        if end == at or all(x.history for x in lines[at:end]):
            stretch += 1
        else:
            out.append((stretch, lines[at:end]))
        at = max(end, at + 1)
    return out


_REFERENCE = re.compile("(?:&#x?[0-9a-f]+;)+")
_DIGITS = re.compile(r"\d+(?:[ :./-]\d+)*")
_RULE = re.compile(r"[_=*#~—–-]{2,}")


class Masked:
    """Texts of a sender with names, firm, numbers, addresses and rules masked, so that closings of different senders are alike."""

    def __init__(self, name: str, address: str):
        domain = address.rpartition("@")[2]
        firm = domain.split(".")[0].replace("-", " ")
        said = [re.escape(w) for w in sorted({name.lower(), *name.lower().split(" "), firm} - {""}, key=lambda w: (-len(w), w)) if len(w) > 1]
        self.own = re.compile(r"\b(?:" + "|".join(said) + r")\b") if said else None

    def __call__(self, text: str) -> str:
        t = _REFERENCE.sub("", plain(text).lower())
        if "@" in t:
            t = _ADDRESS.sub("@", t)
        t = _SITE.sub("@", t)
        if self.own:
            t = self.own.sub("&", t)
        return folded(_RULE.sub("--", _DIGITS.sub("0", t)))


def units_of(run: list[str], mask: Masked) -> dict[str, set[int]]:
    """The lines, the sentences and the whole of a run, masked, with the keys of their plain forms."""
    whole = " ".join(run)
    out: dict[str, set[int]] = {}
    for u in (*run, *_SENTENCE.split(whole), whole):
        masked = mask(u)
        if "&" in masked or any(c.isalpha() for c in masked):
            out.setdefault(masked, set()).add(_key("plain " + folded(u.lower())))
    return out


_MASKED_CLOSE = {Masked("", "")(c) for c in _CLOSE}


def _closing(text: str) -> bool:
    t = text.strip(" ,.!;:-–—").replace("’", "'")
    return t.lower() in _CLOSE or not t.isascii() and Masked("", "")(t).strip(" ,.!;:-") in _MASKED_CLOSE


def _is_name(text: str, name: str) -> bool:
    name, t = name.lower(), text.lower().strip(" ,.~/-–—*")
    if not name or not t:
        return False
    first, last = name.split(" ")[0], name.split(" ")[-1]
    initials = "".join(p[0] for p in name.split(" "))
    return t in (name, first, last, f"{first} {last[0]}", f"{first[0]}. {last}", f"{first[0]} {last}") or text.strip() in (initials.upper(), f"-{initials.upper()}")


def _is_card(text: str, name: str, address: str) -> bool:
    """A line of a visiting card: name, firm, address, telephone, site."""
    low, domain = text.lower(), address.rpartition("@")[2]
    firm = domain.split(".")[0].replace("-", " ")
    return len(text) <= 100 and bool((name and name.lower() in low) or (domain and domain in low) or (firm and firm in low.replace("-", " ")) or _PHONE.search(text) or _SITE.fullmatch(text))


class Closer:
    """Tells the closing blocks of a sender's mails by an automaton of the units that recur, and by convention."""

    def __init__(self, name: str, address: str, automaton, recurring: set[str]):
        self.name, self.address, self.automaton, self.recurring = name, address, automaton, recurring
        self.mask = Masked(name, address)

    def conventional(self, t: str) -> bool:
        return _closing(t) or bool(_LINE.fullmatch(t)) or _is_name(t, self.name) or _is_card(t, self.name, self.address) or len(t) < 60 and bool(_DEVICE.match(t))

    def signs_off(self, texts: list[str]) -> bool:
        """Whether lines are a closing formula with the sender's name, or a name under a rule: nothing new but postscripts follows."""
        return (_closing(texts[0]) or bool(_LINE.fullmatch(texts[0]))) and any(_is_name(t, self.name) or _is_card(t, self.name, self.address) for t in texts[1:])

    def share(self, texts: list[str]) -> float:
        """The share of the masked texts that intervals of recurring units cover."""
        text = " ".join(map(self.mask, texts))
        if not self.recurring or not text:
            return 0.0
        covered = bytearray(len(text))
        for end, unit in self.automaton.iter(text):
            start = end + 1 - len(unit)
            if unit in self.recurring and (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                covered[start : end + 1] = b"\x01" * len(unit)
        return (covered.count(1) + text.count(" ") - sum(covered[k] for k, c in enumerate(text) if c == " ")) / len(text)

    def closes(self, texts: list[str]) -> bool:
        if self.conventional(texts[0]) and len(texts) <= 9:
            rest = [t for t in texts[1:] if not self.conventional(t)]
            if all(len(t) < 45 and not _ends_sentence(t) or len(t) < 25 for t in rest):
                return True
        words = sum(t.count(" ") + 1 for t in texts)
        if words < CLOSING_WORDS and not self.conventional(texts[0]) or _GREET.fullmatch(texts[0]) and not self.conventional(texts[0]):
            return False
        share = self.share(texts)
        return share >= CLOSING_SHARE or share >= CLOSING_SHARE / 2 and any(_is_card(t, self.name, self.address) for t in texts)


def closing_lines(runs: list[tuple[int, list[tuple]]], closer: Closer) -> list[tuple[int, int]]:
    """(block_id, line) of the closings of a mail, given as (stretch, lines as (block_id, line, text, history)): from the end of each stretch upwards
    until a run that is no closing, which may end with one. Runs that nothing shows to close, but which stand below a sign-off, are
    notes under it."""
    out: list[tuple[int, int]] = []
    for stretch in dict.fromkeys(s for s, _ in runs):
        own = [lines for s, lines in runs if s == stretch]
        below: list[list[tuple]] = []
        for k in range(len(own) - 1, -1, -1):
            lines = own[k]
            texts = [t for _, _, t, _ in lines]
            if _POSTSCRIPT.match(texts[0]):
                continue
            if k == 0 and stretch == runs[0][0] and _GREET.fullmatch(texts[0]) and not _closing(texts[0]) and not _is_name(texts[0], closer.name):
                break
            fresh = [x for x in lines if not x[3]]
            if closer.closes(texts) or len(fresh) < len(lines) and closer.closes([x[2] for x in fresh]):
                end = next((n for n, t in enumerate(texts) if _POSTSCRIPT.match(t)), len(lines))
                if below and not closer.signs_off(texts[:end]):
                    break
                out += [x[:2] for part in (lines[:end], *below) for x in part]
                below = []
                continue
            at = next((n for n in range(1, len(lines)) if (_closing(texts[n]) or texts[n] == "--" or n == len(lines) - 1 and closer.conventional(texts[n])) and closer.closes(texts[n:])), None)
            if at is not None:
                if not below or closer.signs_off(texts[at:]):
                    out += [x[:2] for part in (lines[at:], *below) for x in part]
                break
            below.append(lines)
    return out


# ---- routes to the slices of large threads ----

#: Characters of a gram, grams of a window, and characters of a prefix by which short patterns are looked up.
GRAM, WINDOW, PREFIX = 16, 25, 8


def _gram_hashes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h ^ points[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def route_of(pattern: str) -> int:
    """What a pattern is routed by: the least gram of its first window, which every text that holds the pattern chooses too; for a pattern
    without a whole window, its first characters."""
    if len(pattern) >= GRAM + WINDOW - 1:
        return int(_gram_hashes(pattern[: GRAM + WINDOW - 1]).min())
    return _key(pattern[:PREFIX])


def routes_of(text: str) -> set[int]:
    """All routes that a text asks for: the least gram of every window, and the prefixes of up to PREFIX characters at the
    start of every word or sign."""
    out: set[int] = set()
    if len(text) >= GRAM + WINDOW - 1:
        h = _gram_hashes(text)
        out.update(np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1)).tolist())
    starts = {m.start() for m in re.finditer(r"\b\w|[^\w\s]", text)}
    out.update(map(_key, {text[k : k + n] for k in starts for n in range(1, PREFIX + 1)}))
    return out


# ---- over DataFrames ----

_PREFIX = r"^(\s*(re|aw|fwd?|wg|tr|rv|sv|antw|enc|odp)\s*(\[\d+\])?:\s*)+"


def mail_threads(heads: DataFrame) -> DataFrame:
    """(upload_id, thread): components of replies. An answer (by the prefix of its subject) whose message is not known, or that names
    none, counts to the mails of its subject; a subject that no such answer has joins nothing. A mail without either is a thread of its own."""
    node = lambda kind, c: F.xxhash64(F.lit(kind), c)
    subject = F.trim(F.regexp_replace(F.lower("subject"), _PREFIX, ""))
    rows = heads.select(
        "upload_id",
        node("u", F.col("upload_id").cast("string")).alias("u"),
        F.when(F.col("message_id").isNotNull(), node("m", F.col("message_id"))).alias("m"),
        F.when(F.col("in_reply_to").isNotNull(), node("m", F.col("in_reply_to"))).alias("r"),
        F.when(F.length(subject) > 0, node("s", subject)).alias("s"),
        F.lower("subject").rlike(_PREFIX).alias("answer"),
    ).checkpoint()
    known = rows.select(F.col("m").alias("r"), F.lit(True).alias("known")).where("r IS NOT NULL").distinct()
    asked = rows.where("answer AND s IS NOT NULL").join(known, "r", "left").where("known IS NULL").select("s").distinct()
    by_subject = rows.join(asked, "s", "left_semi").select(F.col("u").alias("a"), F.col("s").alias("b"))
    edges = rows.select(F.col("u").alias("a"), F.explode(F.array("m", "r")).alias("b")).where("b IS NOT NULL").union(by_subject)
    parts = connected_components(edges)
    return rows.join(parts, rows["u"] == parts["node"], "left").select("upload_id", F.coalesce("component", "u").alias("thread"))


_NEVER = 1 << 62
_ROWS = "thread bigint, slice int, part int, mail bigint, sent bigint, upload_id bigint, sender string, body string"
_SEEN = "block_id bigint, line_no int, why string, mail bigint, thread bigint, sender string, runs string"


def _mails(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """(mail, upload_id, thread, sent, sender, body, chars): each mail with its blocks as JSON [[block_no, block_id, text]...]."""
    mine = blocks.where((F.col("anchor_kind") == "Email") & F.col("text").isNotNull() & F.col("block_id").isNotNull())
    mine = mine.select("block_id", "upload_id", F.coalesce("block_no", F.lit(0)).alias("no"), F.col("text").cast("string").alias("text"), "loaded_at")
    mine = mine.withColumn("mail", F.when(F.col("upload_id").isNull(), F.xxhash64(F.lit("b"), "block_id")).otherwise(F.xxhash64(F.lit("u"), F.col("upload_id").cast("string"))))
    bodies = mine.groupBy("mail", "upload_id").agg(F.to_json(F.collect_list(F.struct(F.col("block_id").alias("b"), F.col("loaded_at").cast("string").alias("l"), "no", F.col("text").alias("t")))).alias("body"))
    known = latest_rows(heads.where("upload_id IS NOT NULL"), ["upload_id"], "sent_at", ["upload_id", "message_id", "in_reply_to", "subject", "sender"]).join(heads.groupBy("upload_id").agg(F.max("sent_at").alias("sent_at")), "upload_id")
    known = known.checkpoint()
    known = known.select("upload_id", "sender", F.coalesce(F.unix_micros(F.col("sent_at").cast("timestamp")), F.lit(_NEVER)).alias("sent")).join(mail_threads(known), "upload_id", "left")
    return bodies.join(known, "upload_id", "left").select("mail", F.coalesce("upload_id", F.lit(0)).alias("upload_id"), F.coalesce("thread", "mail").alias("thread"), F.coalesce("sent", F.lit(_NEVER)).alias("sent"), "sender", "body", F.length("body").alias("chars"))


def _blocks(body: str) -> list[tuple[int, int, str]]:
    """The blocks of a mail, of those sent again the latest (ties: the greatest)."""
    best: dict[int, tuple] = {}
    for b in json.loads(body):
        key = (b.get("l") or "", b["no"], b["t"])
        if b["b"] not in best or key > best[b["b"]]:
            best[b["b"]] = key
    return [(no, block_id, text) for block_id, (_, no, text) in best.items()]


def _seen(mail: Mail, scan: Scan, mail_id: int, thread: int, sender: str | None) -> list[tuple]:
    """The lines of a mail that are not new by history or marks, and its other runs as JSON."""
    scan.subtract()
    subtract_passed_on(mail)
    subtract_indented(mail)
    runs = runs_of(mail)
    out = [(x.block_id, x.number, "history" if x.history else x.why, None, None, None, None) for x in mail.lines if x.why or x.history]
    if runs:
        out.append((None, None, None, mail_id, thread, sender, json.dumps([(s, [(x.block_id, x.number, x.bare, x.history) for x in lines]) for s, lines in runs])))
    return out


def _scan_threads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (thread, slice, part): the mails of a slice (part 0), then the patterns routed to it (part 1). A whole thread has none:
    its patterns are those of its mails. Holds one slice and one batch of patterns."""
    now, held, routed = None, [], {}
    out: list[tuple] = []

    def scan_routed() -> None:
        automaton = automaton_of(routed)
        for _, _, _, scan in held:
            scan.run(automaton)
        routed.clear()

    def close() -> None:
        if routed:
            scan_routed()
        if now is not None and now[1] < 0 and len(held) > 1:
            patterns: dict[str, tuple] = {}
            for _, _, _, scan in sorted(held, key=lambda h: h[3].stamp):
                for p in patterns_of(scan.mail):
                    patterns.setdefault(p, scan.stamp)
            automaton = automaton_of(patterns)
            for _, _, _, scan in held:
                scan.run(automaton)
        for mail_id, thread, sender, scan in held:
            out.extend(_seen(scan.mail, scan, mail_id, thread, sender))
        held.clear()

    def frame_of() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["block_id", "line_no", "why", "mail", "thread", "sender", "runs"])
        for c, kind in (("block_id", "Int64"), ("line_no", "Int32"), ("mail", "Int64"), ("thread", "Int64")):
            made[c] = made[c].astype(kind)
        out.clear()
        return made

    for frame in frames:
        for thread, part_of, part, mail_id, sent, upload, sender, body in frame.itertuples(index=False):
            if (thread, part_of) != now:
                close()
                now = (thread, part_of)
            if part:
                routed[body] = (sent, upload)
                if len(routed) >= ROUTED:
                    scan_routed()
            else:
                mail = read_mail(_blocks(body), sender)
                mark_structure(mail)
                held.append((mail_id, thread, sender, Scan(mail, (sent, upload))))
        if len(out) > 20_000:
            yield frame_of()
    close()
    yield frame_of()


def _routed(large: DataFrame) -> DataFrame:
    """The patterns of large threads as rows for those slices that may hold them."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 100):
                out = []
                for thread, part_of, sent, upload, sender, body in frame.iloc[at : at + 100][["thread", "slice", "sent", "upload_id", "sender", "body"]].itertuples(index=False):
                    mail = read_mail(_blocks(body), sender)
                    out += [(thread, part_of, k, None, sent, upload) for k in routes_of(stream_of(mail.lines)[0])]
                    out += [(thread, -1, route_of(p), p, sent, upload) for p in patterns_of(mail)]
                yield pd.DataFrame(out, columns=["thread", "slice", "route", "pattern", "sent", "upload_id"])

    rows = large.mapInPandas(ask, "thread bigint, slice int, route bigint, pattern string, sent bigint, upload_id bigint").checkpoint()
    patterns = rows.where("pattern IS NOT NULL").groupBy("thread", "route", "pattern").agg(F.min(F.struct("sent", "upload_id")).alias("first"))
    asked = rows.where("pattern IS NULL").select("thread", "route", "slice").distinct()
    return patterns.join(asked, ["thread", "route"]).select("thread", "slice", F.lit(1).alias("part"), F.lit(None).cast("bigint").alias("mail"), F.col("first.sent").alias("sent"), F.col("first.upload_id").alias("upload_id"), F.lit(None).cast("string").alias("sender"), F.col("pattern").alias("body"))


def _recurring(seen: DataFrame) -> DataFrame:
    """(mail, keys): the keys of those units of each mail that recur: as they stand over the threads of its sender, or masked over
    senders. (Masked ones of one sender may be reports that differ by a number.)"""

    def keys_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for mail, thread, sender, runs in frame[["mail", "thread", "sender", "runs"]].itertuples(index=False):
                name, address = sender_of(sender)
                if address:
                    mask, who = Masked(name, address), _key(address)
                    units = [units_of([x[2] for x in lines], mask) for _, lines in json.loads(runs)]
                    out += [(k, True, who, thread, mail) for k in {_key(u) for x in units for u in x}]
                    out += [(k, False, who, thread, mail) for k in {k for x in units for plain in x.values() for k in plain}]
            yield pd.DataFrame(out, columns=["key", "masked", "who", "thread", "mail"])

    rows = seen.mapInPandas(keys_of, "key bigint, masked boolean, who bigint, thread bigint, mail bigint").checkpoint()
    # Combined by key and sender before anything is counted, so a closing of very many mails is few rows.
    held = rows.groupBy("key", "who", "masked").agg(F.count_distinct("thread").alias("threads"))
    anyone = held.where("masked").groupBy("key").agg(F.count("*").alias("senders")).where(F.col("senders") >= ANY_SENDERS).select("key")
    often = held.where(~F.col("masked") & (F.col("threads") >= SENDER_THREADS)).select("key", "who").union(held.where("masked").join(anyone, "key", "left_semi").select("key", "who"))
    return rows.join(often, ["key", "who"], "left_semi").groupBy("mail").agg(F.collect_set("key").alias("keys"))


def _close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The closing lines of (sender, runs, keys)."""
    import ahocorasick

    for frame in frames:
        texts = [json.loads(r) for r in frame["runs"]]
        senders = [sender_of(s) for s in frame["sender"]]
        keys = [set(map(int, k)) if k is not None else set() for k in frame["keys"]]
        recurring = []
        for (name, address), runs, own in zip(senders, texts, keys):
            mask = Masked(name, address)
            recurring.append({u for _, lines in runs for u, plain in units_of([x[2] for x in lines], mask).items() if not own.isdisjoint(plain) or _key(u) in own} if own else set())
        automaton = ahocorasick.Automaton()
        for u in set().union(*recurring):
            automaton.add_word(u, u)
        automaton.make_automaton()
        out = []
        for (name, address), runs, own in zip(senders, texts, recurring):
            out += closing_lines(runs, Closer(name, address, automaton, own))
        yield pd.DataFrame(out, columns=["block_id", "line_no"]).assign(why="closing")


def marked_lines(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """(block_id, line_no, why): the lines of 'Email' blocks that the sender did not newly write, with what marks them.

    Rows sent again count once (by block_id, the latest). Null and blank texts and lines of white space have no rows;
    blocks without an upload stand alone as a mail each. A mail without a head has no sender, no thread and no time, and is
    read by its own marks. Messages without a time count as later than all others of their thread. Equal times: the lower
    upload_id is the earlier. Other columns are not read. Empty tables give an empty result.
    """
    with_checkpoints(blocks.sparkSession)
    mails = _mails(blocks, heads).checkpoint()
    sizes = mails.groupBy("thread").agg(F.ceil(F.sum("chars") / SLICE_CHARS).cast("int").alias("slices")).where("slices > 1")
    dealt = mails.join(sizes, "thread", "left").withColumn("slice", F.coalesce(F.pmod("mail", F.col("slices")).cast("int"), F.lit(-1)))
    rows = dealt.select("thread", "slice", F.lit(0).alias("part"), "mail", "sent", "upload_id", "sender", "body")
    if not sizes.isEmpty():
        rows = rows.union(_routed(dealt.where("slice >= 0")))
    seen = rows.repartition("thread", "slice").sortWithinPartitions("thread", "slice", "part").mapInPandas(_scan_threads, _SEEN).checkpoint()
    own = seen.where("runs IS NOT NULL").select("mail", "thread", "sender", "runs")
    closing = own.join(_recurring(own), "mail", "left").select("sender", "runs", "keys").mapInPandas(_close, "block_id bigint, line_no int, why string")
    found = seen.where("runs IS NULL").select("block_id", "line_no", "why").union(closing)
    return found.groupBy("block_id", "line_no").agg(F.max("why").alias("why"))


def new_texts(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """(upload_id, text): each mail reduced to what its sender newly wrote, lines in order and blocks parted by an empty
    line. A mail of which nothing is new has an empty text."""
    lines = blocks.where((F.col("anchor_kind") == "Email") & F.col("upload_id").isNotNull()).select("block_id", "upload_id", "block_no", "text", "loaded_at")
    latest = latest_rows(lines, ["block_id"], "loaded_at", ["block_id", "upload_id", "block_no", "text"])
    gone = marked_lines(blocks, heads).groupBy("block_id").agg(F.collect_set("line_no").alias("gone"))
    parts = latest.join(gone, "block_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = parts.withColumn("kept", F.expr("array_join(filter(transform(split(coalesce(text, ''), '\n', -1), (t, k) -> if(array_contains(gone, k + 1), null, t)), t -> t is not null and trim(t) <> ''), '\n')"))
    rows = kept.groupBy("upload_id").agg(F.sort_array(F.collect_list(F.struct("block_no", "block_id", "kept"))).alias("x"))
    return rows.select("upload_id", F.expr("array_join(filter(transform(x, b -> b.kept), t -> t <> ''), '\n\n')").alias("text"))
