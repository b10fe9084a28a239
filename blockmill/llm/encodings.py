"""Problem 2: text that was decoded with the wrong character encoding, found and restored.

Characters are mapped back to the bytes of a legacy encoding; a byte-structure automaton (one regular expression over
the classes lead and continuation byte of each encoding) finds the maximal spans of well-formed multibyte
characters, and only those spans are decoded. Bytes of one single-byte encoding read as another have no such
structure. For them, and to judge spans that correct text could form by chance, a word and its possible originals
are weighed by a character model counted over the whole corpus.

The model is a count-min sketch of a fixed size (counts of character and character-class trigrams and of words under two
hashes, the lesser of which holds, less the mean load of a slot), so what is gathered and broadcast does not grow with the data. Records themselves
are never shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.sources.tables import spread

# Single-byte encodings that texts are misread in, or written in.
SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp866", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp1253", "iso8859_7", "cp1254", "iso8859_5", "cp852")
MULTI = ("cp932", "euc_jp")
#: Slots of each of the two rows of the model.
SLOTS = 1 << 20
#: Characters after which an endless word is parted, at the next place where two characters of ASCII meet: no multibyte span crosses it.
WORD_CHARS = 4096
#: Characters of different words that a task gathers before it counts them.
GATHERED_CHARS = 1 << 22
#: So many times the mean load of a slot by words is taken for chance.
NOISE = 2.0
#: What a reading must gain in log likelihood to be taken.
GAIN_STRUCTURE, GAIN_STRUCTURE_OTHER, GAIN_SINGLE, GAIN_ODD = -15.0, 1.0, 2.5, 0.0
#: A word may be so many times as frequent as what it is read for, if nothing else tells it to be garbled.
RARER = 3.0
#: A word below this gain, or of fewer letters, counts only beside another garbled word in the same record.
GAIN_ALONE, LETTERS_ALONE = 6.0, 3

_WORD = re.compile(r"\S+", re.ASCII)
_EAST = re.compile("[　-ヿ㐀-鿿가-힯＀-￯]+")
_KANA = re.compile("[぀-ヿ]")
_MIXED = re.compile("[A-Za-z][\u0370-\u052f]|[\u0370-\u052f][A-Za-z]")
_BAD = "\x00"


@lru_cache(maxsize=None)
def legacy_bytes(encoding: str) -> dict[str, int]:
    """Character -> byte for the upper half of an encoding. Bytes it leaves undefined stand for the C1 control of
    the same number, as lenient decoders read them; so does every C1 control that no byte claims."""
    table: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            table.setdefault(bytes([b]).decode(encoding), b)
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    for b in range(0x80, 0xA0):
        table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=None)
def _translation(read_as: str, written_in: str) -> dict[int, str]:
    """What each character was, if bytes of `written_in` were read as `read_as`."""
    out = {}
    for char, b in legacy_bytes(read_as).items():
        try:
            out[ord(char)] = bytes([b]).decode(written_in)
        except UnicodeDecodeError:
            out[ord(char)] = _BAD
    return out


def _class(encoding: str, lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in legacy_bytes(encoding).items() if lo <= b <= hi) + "]"


@lru_cache(maxsize=None)
def automaton(read_as: str) -> re.Pattern:
    """Maximal runs of characters whose bytes are well-formed UTF-8 sequences of two to four bytes."""
    c = lambda lo, hi: _class(read_as, lo, hi)
    more = c(0x80, 0xBF)
    return re.compile(f"(?:{c(0xC2, 0xDF)}{more}|{c(0xE0, 0xEF)}{more}{{2}}|{c(0xF0, 0xF4)}{more}{{3}})+")


@lru_cache(maxsize=None)
def _east_automaton(read_as: str, written_in: str) -> re.Pattern:
    c = lambda lo, hi: _class(read_as, lo, hi)
    if written_in == "cp932":
        lead = f"(?:{c(0x81, 0x9F)}|{c(0xE0, 0xFC)})"
        return re.compile(f"(?:{lead}(?:[@-~]|{c(0x80, 0xFC)}))+")
    return re.compile(f"(?:{c(0xA1, 0xFE)}{{2}})+")


def _plausible(char: str) -> bool:
    """Characters that a text of some living language may well hold."""
    x = ord(char)
    return (
        0xA0 <= x <= 0x17F and char not in "ĲĳĸĿŀŉŦŧſ"
        or 0x218 <= x <= 0x21B
        or 0x386 <= x <= 0x3CE
        or 0x400 <= x <= 0x45F
        or 0x490 <= x <= 0x491
        or 0x1EA0 <= x <= 0x1EF9
        or 0x2010 <= x <= 0x203A
        or x in (0x192, 0x2C6, 0x2DC, 0x20AC, 0x2116, 0x2122, 0x2190, 0x2191, 0x2192, 0x2193, 0x2212, 0x2260, 0x2264, 0x2265, 0xFEFF, 0xFFFD)
        or 0x2500 <= x <= 0x257F
        or 0x3000 <= x <= 0x30FF
        or 0x4E00 <= x <= 0x9FFF
        or 0xAC00 <= x <= 0xD7AF
        or 0xFF00 <= x <= 0xFFEF
        or 0x1F300 <= x <= 0x1FAFF
    )


#: Marks in the places where correct text has them: quotes and dots at the rims, signs beside numbers.
_BENIGN = re.compile("[\\x00-\\x7f‘’“”„‚«»…–—™®©]*(?:[€£¥¤]?[0-9][0-9.,:]*[€£¥°%½¼¾²³]?)?[\\x00-\\x7f‘’“”«»…–—™®©]*")
_EDGE = re.compile("[A-Za-z][‘“”„‚«»–—™®©…][A-Za-z]")
_LATE_CAPITAL = re.compile("[a-zß-öø-ÿ][À-ÖØ-ÞŠŽŸŒ]")


#: A word that cannot be sound: a sign between its letters, letters of two scripts, a capital amid small letters.
_TRAIT = re.compile("[A-Za-z][¡-¬®-¿×÷ˆ˜˙˛ˇ˘˝‚„†‡•…‰‹›⁄™∂∆∏∑−√∞∫≈≠≤≥◊─-▟]+[a-z]|" + _MIXED.pattern + "|" + _LATE_CAPITAL.pattern)


def _unlikely(word: str, other: str) -> bool:
    """Whether a reading has traits of garbled text that the word itself has not: scripts mixed within it, a capital
    amid small letters, nothing but accented Latin letters, or a mark for a letter of a capitalised word."""
    if _MIXED.search(other) and not _MIXED.search(word) or _LATE_CAPITAL.search(other) and not _LATE_CAPITAL.search(word):
        return True
    letters = [c for c in other if c.isalpha()]
    if len(letters) > 1 and all("\xc0" <= c <= "\u024f" for c in letters):
        return True
    return word.isupper() and all(c.isalpha() for c in word if c > "\x7f") and not all(c.isalpha() for c in other if c > "\x7f")


def _decode_spans(word: str, read_as: str) -> str | None:
    """The word with its well-formed spans decoded, if all they give is plausible."""
    table, changed = legacy_bytes(read_as), False

    def fix(m: re.Match) -> str:
        nonlocal changed
        try:
            text = bytes(table[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        if all(_plausible(c) or (0x80 <= ord(c) < 0xA0 and read_as == "cp1252") for c in text):
            changed = True
            return text
        return m.group()

    out = automaton(read_as).sub(fix, word)
    return out if changed else None


#: Numeric character references to single bytes or to what lenient readers make of them.
_REFERENCES = re.compile(r"(?:&#(?:[xX][0-9a-fA-F]{1,4}|[0-9]{2,5});)+")


def _decode_references(text: str) -> tuple[str, int]:
    """The text with those runs of references decoded that spell the bytes of multibyte characters; their number."""
    found = 0

    def fix(m: re.Match) -> str:
        nonlocal found
        codes = [int(x[1:], 16) if x[0] in "xX" else int(x) for x in re.findall(r"&#([^;]+);", m.group())]
        if any(c < 0x80 or 0xD800 <= c < 0xE000 for c in codes):
            return m.group()
        other = _decode_spans("".join(map(chr, codes)), "cp1252")
        if other is None:
            return m.group()
        found += 1
        return other

    return _REFERENCES.sub(fix, text), found


def _decode_east(word: str, read_as: str, written_in: str) -> str | None:
    table, changed = legacy_bytes(read_as), False

    def fix(m: re.Match) -> str:
        nonlocal changed
        raw = m.group()
        try:
            text = bytes(table.get(c, ord(c) & 0xFF) for c in raw).decode(written_in)
        except UnicodeDecodeError:
            return raw
        kana = len(_KANA.findall(text))
        if len(text) >= 4 and kana > 1 and kana * 4 >= len(text) and all(_EAST.fullmatch(c) for c in text):
            changed = True
            return text
        return raw

    out = _east_automaton(read_as, written_in).sub(fix, word)
    return out if changed else None


# ---- records whose words all are of another script ----

#: Encodings of a script other than Latin, its letters, and those of them that make up most of a text.
_SCRIPTS = (
    (("cp1251", "koi8_r", "iso8859_5", "cp866"), re.compile("[Ѐ-џҐґ]+"), set("оеаинтсрвлі")),
    (("cp1253", "iso8859_7"), re.compile("[Ά-ώ]+"), set("αοιετσςνηάέίό")),
)
#: So many different words, of which that share has a sound reading, of so many different letters and so great a share of
#: common ones, are proof.
SCRIPT_WORDS, SCRIPT_SHARE, SCRIPT_LETTERS, SCRIPT_COMMON = 3, 0.8, 5, 0.5
_NO_LETTER = re.compile("[\\x00-@\\[-`{-\x7f\xa0‘’“”„«»…–—№°]+")


@lru_cache(maxsize=1 << 16)
def _core(word: str) -> str:
    """The word without signs that a text of any script may hold; empty if it holds letters of ASCII."""
    core = _NO_LETTER.sub("", word)
    return "" if any(c.isascii() for c in core) else core


@lru_cache(maxsize=1 << 16)
def _scriptless(word: str) -> bool:
    """Whether a word is of a sort that no language writes: three or more characters, all of them accented Latin
    letters, or letters of several scripts, or such and signs."""
    core = _core(word)
    return len(core) > 2 and any(c.isalpha() for c in core) and not _EAST.search(core) and not any(letters.fullmatch(core) for _, letters, _ in _SCRIPTS) and not any(0x530 <= ord(c) < 0x1E00 for c in core)


def _script_readings(words: list[str]) -> dict[str, str]:
    """Readings of the words of a record, if its words of no script are, read one and the same way, words of one."""
    odd = [w for w in words if _scriptless(w)]
    if len(odd) < SCRIPT_WORDS:
        return {}
    best, joined = (0.0, None), "\n".join(odd)
    for read_as in SINGLE:
        for written_in, letters, common in ((e, *rest) for encodings, *rest in _SCRIPTS for e in encodings if e != read_as):
            cores = [_core(o) if _BAD not in o else "" for o in joined.translate(_translation(read_as, written_in)).split("\n")]
            sound = [c for c in cores if letters.fullmatch(c) and (c[1:].islower() or c.isupper())]
            if len(sound) >= max(SCRIPT_WORDS, SCRIPT_SHARE * len(odd)):
                text = "".join(sound).lower()
                share = sum(c in common for c in text) / len(text)
                if share >= SCRIPT_COMMON and len(set(text)) >= SCRIPT_LETTERS and share + len(sound) / len(odd) > best[0]:
                    best = (share + len(sound) / len(odd), (read_as, written_in, letters))
    if best[1] is None:
        return {}
    table, letters = _translation(*best[1][:2]), best[1][2]
    # A single letter may be a word of another language, if the record holds accented words of one.
    least = 2 if any(not _core(w) and _LATIN.search(w) for w in words) else 1
    out = {w: w.translate(table) for w in words if len(_core(w)) >= least and any(c.isalpha() for c in w)}
    return {w: o for w, o in out.items() if _BAD not in o and letters.fullmatch(_core(o))}


_LATIN = re.compile("[À-ɏ]")

# ---- the character model ----

_CLASSES = np.zeros(0x110000, np.uint8)


def _fill_classes() -> None:
    import unicodedata

    table = _CLASSES
    for x in range(0x3000):
        char = chr(x)
        kind = unicodedata.category(char)
        script = 0 if x < 0x80 else 1 if x < 0x250 or 0x1E00 <= x < 0x1F00 else 2 if 0x370 <= x < 0x400 or 0x1F00 <= x < 0x2000 else 3 if 0x400 <= x < 0x530 else 4
        if kind in ("Lu", "Lt"):
            table[x] = 10 + script
        elif kind[0] in "LM":
            table[x] = 20 + script
        elif kind == "Nd":
            table[x] = 30
        elif kind[0] == "C":
            table[x] = 31 if x > 0x7F else 32 + x % 8
        elif kind == "Sc":
            table[x] = 41
        elif kind in ("Pi", "Pf"):
            table[x] = 42
        elif x < 0x80:
            table[x] = 50 + (x % 40)
        else:
            table[x] = 43 + ("S" in kind) + 2 * (x >= 0x2000)
    table[0x3000:0x3100] = 100
    table[0x3100:0xFFFD] = 101
    table[0xFFFD] = 102
    table[0x10000:] = 103


_fill_classes()
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _slot(kind: int, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of values in the two rows of the model."""
    h = np.full(len(parts[0]), kind * 0x632BE5AB + 1, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * _A
        h ^= h >> np.uint64(29)
    h = (h * _B) ^ ((h * _C) >> np.uint64(31))
    mask = np.uint64(SLOTS - 1)
    return ((h >> np.uint64(20)) & mask).astype(np.int64), ((h >> np.uint64(42)) & mask).astype(np.int64) + SLOTS


def _word_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h = np.fromiter((zlib.crc32(b) << 32 | zlib.crc32(b, 0x5F3759DF) for b in (w.encode("utf-8", "surrogatepass") for w in words)), np.uint64, len(words))
    return _slot(7, h)


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two start marks and an end mark; the number of each one's word."""
    shown = [_EAST.sub("漢", w) for w in words]
    text = "".join(f"\x02\x02{w}\x03" for w in shown)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points >= 0x30) & (points <= 0x39)] = 0x30
    return points, np.repeat(np.arange(len(shown)), [len(w) + 3 for w in shown])


def _features(points: np.ndarray):
    a, b, c = points[:-2], points[1:-1], points[2:]
    x, y, z = _CLASSES[a], _CLASSES[b], _CLASSES[c]
    inside = (c != 2) & (b != 3)
    return inside, (_slot(1, a, b, c), _slot(2, a, b), _slot(3, x, y, z), _slot(4, x, y), _slot(5, c), _slot(6, z))


def _count_words(words: dict[str, list[int]]) -> np.ndarray:
    """Counts of the slots, and last the number of words."""
    counts = np.zeros((2, 2 * SLOTS + 1), np.int64)
    if words:
        points, of = _laid_out(list(words))
        inside, slots = _features(points)
        word_slots = _word_slots(list(words))
        for k, each in enumerate(np.array(list(words.values()), np.int64).T):
            weight = each[of[2:]][inside]
            for row in (s for pair in slots for s in pair):
                counts[k, :-1] += np.bincount(row[inside], weights=weight, minlength=2 * SLOTS).astype(np.int64)
            for row in word_slots:
                counts[k, :-1] += np.bincount(row, weights=each, minlength=2 * SLOTS).astype(np.int64)
            counts[k, -1] += each.sum()
    return counts


_SAFE_CUT = re.compile("(?<=[\x21-\x7e])(?=[\x21-\x7e])")


def parts_of(word: str) -> list[str]:
    """The word, or where it is overlong its parts: each of WORD_CHARS or more, up to a place that no multibyte span crosses."""
    out, at = [], 0
    while len(word) - at > WORD_CHARS and (m := _SAFE_CUT.search(word, at + WORD_CHARS)):
        out.append(word[at : m.start()])
        at = m.start()
    return [*out, word[at:]]


def words_of(text: str) -> list[str]:
    """The words that hold a character beyond ASCII; a word is what stands between ASCII white space, in parts where it
    is overlong."""
    return [p for w in _WORD.findall(text) if not w.isascii() for p in parts_of(w) if not p.isascii()]


def character_model(texts: DataFrame) -> np.ndarray:
    """Counts over all words beyond ASCII in the column `text`: two rows of 2 * SLOTS numbers, whatever the
    size of the corpus. In the first row, copies of a text count by their logarithm, or a garbled one that stands in very
    many rows would pass for normal; in the second, each row counts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 2 * SLOTS + 1), np.int64)
        seen: dict[str, list[int]] = {}
        gathered = 0
        for frame in frames:
            for text, copies in zip(frame["text"], frame["copies"]):
                copies = int(copies)
                for w in words_of(text):
                    held = seen.get(w)
                    if held is None:
                        held = seen[w] = [0, 0]
                        gathered += len(w) + 16
                    held[0] += copies.bit_length()
                    held[1] += copies
                if gathered > GATHERED_CHARS:
                    counts += _count_words(seen)
                    seen, gathered = {}, 0
        counts += _count_words(seen)
        at = np.flatnonzero(counts[1])
        yield pd.DataFrame({"slot": at, "few": counts[0, at], "n": counts[1, at]})

    parts = texts.groupBy("text").agg(F.count("*").alias("copies")).mapInPandas(count, "slot bigint, few bigint, n bigint").groupBy("slot").agg(F.sum("few").alias("few"), F.sum("n").alias("n"))
    frame = parts.toPandas()  # at most 2 * SLOTS + 1 rows
    # Only ratios of counts matter, so the 24 bits of a float are enough at any size of the corpus.
    model = np.zeros((2, 2 * SLOTS + 1), np.float32)
    model[:, frame["slot"].to_numpy(np.int64)] = frame[["few", "n"]].to_numpy(np.float32).T
    model[:, -1] /= SLOTS
    return model


class Reader:
    """Judges words by the model and keeps its verdicts."""

    def __init__(self, model: np.ndarray):
        self.model, self.load = model[:, : 2 * SLOTS], model[:, 2 * SLOTS]
        self.verdicts: dict[str, tuple[str, bool] | None] = {}
        self.held = 0

    def _counts(self, slots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.minimum(self.model[:, slots[0]], self.model[:, slots[1]])

    def _known(self, words: list[str]) -> np.ndarray:
        """How often words stand in the corpus, less what other words leave in their slots on average: in a corpus of any size a word is
        known if it is frequent beyond that, not because its slots are never empty."""
        return np.maximum(0.0, self._counts(_word_slots(words)) - NOISE * self.load[:, None])

    def _scores(self, words: list[str]) -> np.ndarray:
        points, of = _laid_out(words)
        inside, slots = _features(points)
        tri, pair, ctri, cpair, one, cone = map(self._counts, slots)
        within = (one + 0.05) / (cone + 5.0)
        general = (ctri + 0.02) / (cpair + 2.0) * within
        p = np.clip((tri + 4.0 * general) / (pair + 4.0), 1e-12, 1.0)
        return np.stack([np.bincount(of[2:], weights=np.where(inside, x, 0.0), minlength=len(words)) for x in np.log(p)])

    def _candidates(self, words: list[str]) -> list[list[tuple[str, float]]]:
        """For each word, other readings and the gain each must show."""
        out: list[dict[str, float]] = [{} for _ in words]
        for read_as in SINGLE:
            need = GAIN_STRUCTURE if read_as == "cp1252" else GAIN_STRUCTURE_OTHER
            for k, w in enumerate(words):
                if automaton(read_as).search(w):
                    other = _decode_spans(w, read_as)
                    if other:
                        out[k][other] = min(out[k].get(other, 99.0), need)
                for written_in in MULTI if len(w) >= 6 and read_as in ("cp1252", "cp1251", "mac_roman", "cp437", "cp850") else ():
                    if _east_automaton(read_as, written_in).search(w):
                        other = _decode_east(w, read_as, written_in)
                        if other:
                            out[k][other] = min(out[k].get(other, 99.0), -99.0)
        plain = [k for k, w in enumerate(words) if not _EAST.search(w) and (_EDGE.search(w) or not _BENIGN.fullmatch(w))]
        for read_as in SINGLE if plain else ():
            known = legacy_bytes(read_as)
            fits = [k for k in plain if all(c in known for c in words[k] if c > "\x7f")]
            joined = "\n".join(words[k] for k in fits)
            for written_in in SINGLE if fits else ():
                if written_in != read_as:
                    for k, other in zip(fits, joined.translate(_translation(read_as, written_in)).split("\n")):
                        need = GAIN_ODD if _TRAIT.search(words[k]) and not _TRAIT.search(other) else GAIN_SINGLE
                        if other != words[k] and _BAD not in other and not _unlikely(words[k], other) and all(_plausible(c) for c in other if c > "\x7f"):
                            out[k].setdefault(other, need)
        return [list(x.items()) for x in out]

    def learn(self, words: list[str]) -> None:
        """Fills the verdicts of new words: None for a sound one, else its restored form and whether it is proof by
        itself."""
        new = [w for w in dict.fromkeys(words) if w not in self.verdicts]
        self.held += sum(map(len, new))
        if self.held > GATHERED_CHARS:
            self.held = sum(map(len, words))
            self.verdicts.clear()
            new = list(dict.fromkeys(words))
        current = {w: w for w in new}
        for w in new:
            self.verdicts[w] = None
        for _ in range(4):  # text may have been misread more than once
            todo = [w for w in current if not current[w].isascii()]
            if not todo:
                return
            forms = [current[w] for w in todo]
            options = self._candidates(forms)
            flat = [o for opts in options for o, _ in opts]
            known = self._known(flat) if flat else np.zeros((2, 0))
            own_known = self._known(forms)
            base, scores, at = self._scores(forms), self._scores(flat) if flat else np.zeros((2, 0)), 0
            following = {}
            for k, (w, opts) in enumerate(zip(todo, options)):
                best = None
                # A word that one row of the model lets pass may be one by the other; signs alone go by the first.
                rows = [1, 0] if any(c.isalpha() for c in forms[k]) else [0]
                for row in rows:
                    for n, (other, need) in enumerate(opts, at):
                        gain, seen = scores[row, n] - base[row, k], known[row, n]
                        # A word without any trait of garbling is one only if what it was is known, and not much rarer.
                        if need == GAIN_SINGLE and seen < max(1.0, own_known[row, k] / RARER):
                            continue
                        if gain >= need and (best is None or (need < -50, gain) > best[0]):
                            best = ((need < -50, gain), other, need, max(scores[r, n] - base[r, k] for r in rows))
                    if best:
                        break
                at += len(opts)
                if best:
                    earlier = self.verdicts[w]
                    letters = sum(c.isalpha() for c in best[1])
                    shorter, gain = len(best[1]) < len(w), best[3]  # shorter: a span of bytes, not a word read otherwise
                    alone = best[2] < 0 or best[2] == GAIN_ODD and letters >= LETTERS_ALONE or shorter and gain >= GAIN_ALONE / 2 or (letters >= LETTERS_ALONE or shorter) and (gain >= GAIN_ALONE or len(w) > LETTERS_ALONE)
                    self.verdicts[w] = (best[1], alone or bool(earlier and earlier[1]))
                    following[w] = best[1]
            current = following

    def restore(self, text: str) -> tuple[str, int, int]:
        """(text with all garbled words restored, number of garbled words, number of lost characters)."""
        lost, spelled = lost_characters(text), 0
        if "&#" in text:
            text, spelled = _decode_references(text)
        words = list(dict.fromkeys(words_of(text)))
        found = [v for w in words if (v := self.verdicts.get(w))]
        # Words without a verdict; in them, what a whole record shows stands in for knowing their originals.
        script = _script_readings([w for w in words if not (v := self.verdicts.get(w)) or len(v[0]) == len(w)])
        if not lost and not spelled and not script and not any(alone for _, alone in found) and len({o for o, _ in found}) < 2:
            return text, 0, 0
        changed = spelled

        def fix(m: re.Match) -> str:
            nonlocal changed
            w = m.group()
            if w.isascii():
                return w
            parts = parts_of(w)
            out = [script.get(p) or (self.verdicts.get(p) or (p,))[0] for p in parts]
            changed += out != parts
            return "".join(out)

        return _WORD.sub(fix, text), changed, lost


def lost_characters(text: str) -> int:
    """Replacement characters and C1 controls: marks of a misreading whether or not a passage can be restored."""
    return sum(c == "�" or "\x80" <= c <= "\x9f" for c in text)


def find_garbled(records: DataFrame) -> DataFrame:
    """(rec, rec_id, restored, garbled_words, lost) for the records of (rec, rec_id, text) that hold a passage
    misread from another encoding.

    `restored` is the text with every garbled word that can be read given back; where characters were replaced on the way
    (U+FFFD) they stay. Null, empty and pure ASCII texts are no cases. A record sent again counts once. Extra
    columns are not read. An empty table gives an empty result.
    """
    texts = records.select("rec", "rec_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]|&#"))
    model = character_model(texts.select("text"))
    held = records.sparkSession.sparkContext.broadcast(model)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(held.value)
        for frame in frames:
            for at in range(0, len(frame), 2000):
                part = frame.iloc[at : at + 2000]
                reader.learn([w for text in part["text"] for w in words_of(text)])
                rows = []
                for rec, rec_id, text in part.itertuples(index=False):
                    restored, changed, lost = reader.restore(text)
                    if changed or lost:
                        rows.append((rec, rec_id, restored, changed, lost))
                yield pd.DataFrame(rows, columns=["rec", "rec_id", "restored", "garbled_words", "lost"])

    kind = records.schema["rec_id"].dataType.simpleString()
    found = spread(texts).mapInPandas(judge, f"rec string, rec_id {kind}, restored string, garbled_words int, lost int")
    return found.dropDuplicates(["rec", "rec_id"])


def block_and_chunk_texts(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    one = blocks.select(F.lit("block").alias("rec"), F.col("block_id").alias("rec_id"), "text")
    return one.unionByName(chunks.select(F.lit("chunk").alias("rec"), F.col("chunk_id").alias("rec_id"), "text"))
