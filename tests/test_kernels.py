from hypothesis import given
from hypothesis import strategies as st

from blockmill.functions.sizing import resolve
from blockmill.functions.text import byte_pieces, closing_words, collapse, column_letter, paragraphs, quoted, trim, valid_text


def test_sizes_in_force():
    assert resolve(0, 0, 0) == (5500, 0, 6000)
    assert resolve(None, None, None) == (5500, 0, 6000)
    assert resolve(8000, 200, 6000) == (8000, 200, 8000)
    assert resolve(1200, 1300, 1500) == (1200, 1199, 1500)
    assert resolve(-1, -5, 10) == (5500, 0, 5500)


def test_column_letters():
    assert [column_letter(n) for n in (-1, 0, 25, 26, 27, 51, 52, 701, 702)] == ["A", "A", "Z", "AA", "AB", "AZ", "BA", "ZZ", "AAA"]


def test_trim_knows_unicode_blanks_but_not_separators():
    assert trim("　\xa0 a \x85") == "a"
    assert trim("\x1ca\x1f") == "\x1ca\x1f"
    assert collapse(" a \n b ") == "a b"


def test_paragraphs():
    assert paragraphs("a\r\n\r\nb\n \nc\n\n\n\n d ") == ["a", "b\n \nc", "d"]


def test_runs_of_invalid_bytes_give_one_mark():
    assert valid_text(b"a\xff\xfeb\xe2\x82c") == "a�b�c"


def test_pieces_end_before_a_character():
    assert byte_pieces("aé", 2) == ["a", "é"]
    assert byte_pieces("abc", 0) == ["abc"]
    assert byte_pieces("€", 1) == ["�", "�", "�"]


@given(st.text(max_size=300), st.integers(4, 50))
def test_pieces_put_together_are_the_text(text, limit):
    text = text.encode("utf-8", "replace").decode()
    parts = byte_pieces(text, limit)
    assert "".join(parts) == text
    assert all(len(p.encode()) <= limit for p in parts)


def test_closing_words():
    assert closing_words("alpha bravo charlie", 12) == "charlie"
    assert closing_words("abc", 5) == "abc"
    assert closing_words("abc", 0) == ""
    assert closing_words("ééé", 3) == "é"


def test_quoted_names():
    assert quoted('a"b\\c\n\x01é') == '"a\\"b\\\\c\\n\\x01é"'
