"""Extractors on documents built in memory."""

import cProfile

import pytest

from blockmill.operators.blocks import Block
from blockmill.operators.detect import archive_format, hint_of
from blockmill.operators.extract import blocks_of
from blockmill.operators.number_formats import BUILT_IN, shown as shown_number
from blockmill.operators.office_formats import style_level
from blockmill.sources import builders as make
from blockmill.sources.archives import Archive, Rejected, resolve


def texts(kind, data):
    return [b.text for b in blocks_of(kind, data)[0]]


def shown(kind, data):
    return [(b.kind, b.level, b.text) for b in blocks_of(kind, data)[0]]


def cells(kind, data):
    return [(b.row, b.cells) for b in blocks_of(kind, data)[0]]


def test_text():
    assert texts("txt", b"The mill stood idle.\r\n\r\n  Rain came \n\n\n\nat last.") == ["The mill stood idle.", "Rain came", "at last."]


def test_delimited_rows():
    assert cells("csv", b"Crop,Sacks\nrye,12\n\noats,7,wet\nbran") == [(1, ["Crop", "Sacks"]), (2, ["rye", "12"]), (3, ["oats", "7", "wet"]), (4, ["bran"])]
    assert cells("csv", b'a"b,"c ""d"" e"\r\n"x\r\ny",') == [(1, ['a"b', 'c "d" e']), (2, ["x\ny", ""])]
    assert cells("csv", b'"a"b,c') == [(1, ['a"b,c'])]
    assert cells("tsv", b"a\tb,c\n d ") == [(1, ["a", "b,c"]), (2, [" d "])]


def test_html_blocks():
    page = b"<html><head><title>no</title><style>p{}</style></head><body><h4>Sluice</h4><p>Lift the <i>gate</i> and<br>wait.</p></body></html>"
    assert shown("html", page) == [("Heading", 4, "Sluice"), ("Paragraph", 0, "Lift the gate andwait.")]


def test_html_implied_ends_and_dropped_text():
    page = b"<div>bare</div><p>one<p>two<script>var a='</p>';</script><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>x<td>y<th>z</table><blockquote><p>in</p>out</blockquote>"
    assert shown("html", page) == [("Paragraph", 0, "one"), ("Paragraph", 0, "two"), ("ListItem", 0, "a"), ("ListItem", 0, "bc"), ("Paragraph", 0, "x"), ("Paragraph", 0, "y"), ("Paragraph", 0, "z"), ("Paragraph", 0, "inout")]
    assert texts("html", b"<p>a &amp; b &copy;<!-- no --></p><figure><figcaption>c</figcaption></figure>") == ["a & b ©", "c"]
    assert texts("html", b"<p>open") == ["open"]


@pytest.mark.parametrize(
    ("page", "found"),
    [
        ("<table><tr><td>a</td></tr><p>before</p><tr><td>b</td></tr></table><p>after</p>", ["before", "a", "b", "after"]),
        ("<table><div><p>one</p><h2>two</h2></div><tr><p>three<td>a<td>b</table>", ["one", "two", "three", "a", "b"]),
        ("<blockquote>in <table>moved <tr>too <td>cell</td></tr></table> out</blockquote>", ["in moved too cell out"]),
        ("<table><tr><td>x<table><tr><td>y</td></tr><tr>inner</tr></table>z</td></tr></table>", ["xinneryz"]),
        ("<table><tr><td>a</td></tr><table><tr><td>b</td></tr></table>", ["a", "b"]),
        ("<td>no cell</td><p>yes</p>", ["yes"]),
        ("<b><p>x</b>y</p><p>z", ["xy", "z"]),
        ("<span><p>x</span>y</p>", ["xy"]),
        ("<p>a<b>b<p>c</b>d", ["ab", "cd"]),
        ("<i><li>one</i> still<li>two</i>", ["one still", "two"]),
        ("<table><caption>cap<tr><td>a</table><figcaption>fig", ["cap", "a", "fig"]),
        ("<ul><li>a<table><tr><td>c</td></tr></table>d</ul>", ["acd"]),
    ],
)
def test_html_content_that_is_moved_or_unclosed(page, found):
    assert texts("html", page.encode()) == found


def test_docx():
    found = shown("docx", make.docx([("Title", "The mill"), ("heading 4", "Wheel"), ("", "Oil it\nweekly."), ("List", "grease"), ("Quote", "So be it."), ("", " ")]))
    assert found == [("Heading", 1, "The mill"), ("Heading", 4, "Wheel"), ("Paragraph", 0, "Oil it\nweekly."), ("ListItem", 0, "grease"), ("Paragraph", 0, "So be it.")]
    boxed = "<d><p><pStyle val='Heading2'/><t>lost</t><box><p><t>in</t><tab/><t>box</t></p></box><t>after</t></p><t>loose</t></d>"
    assert shown("docx", make.zipped({"word/document.xml": boxed})) == [("Paragraph", 0, "in box"), ("Paragraph", 0, "after"), ("Paragraph", 0, "loose")]
    assert blocks_of("docx", make.zipped({"word/document.xml": "<d><p><t>&grain;</t></p></d>"}))[1] == "INVALID"
    assert blocks_of("docx", make.zipped({"x": "y"}))[1] == "INVALID"


def test_styles():
    assert [style_level(s) for s in ("Title", "subtitle", "Heading", "heading 3", "Heading9", "Heading0", "Normal", "")] == [1, 2, 2, 3, 6, 0, 0, 0]


def test_open_document_text():
    assert shown("odt", make.odt([(1, "Top"), (9, "Deep"), (0, "a\nb")])) == [("Heading", 1, "Top"), ("Heading", 6, "Deep"), ("Paragraph", 0, "a\nb")]


def test_open_document_text_within_text():
    body = "<d><p>one<note><p>two</p></note>lost</p><h outline-level='2'>a<p>b</p>c</h><list><p>x<s/>y</p></list></d>"
    assert shown("odt", make.zipped({"content.xml": body})) == [("Paragraph", 0, "onetwo"), ("Heading", 2, "abc"), ("Paragraph", 0, "x y")]


def test_open_document_sheet_keeps_places():
    body = "<table name='Grain'><table-row number-rows-repeated='4'/><table-row><table-cell number-columns-repeated='2'><p>rye</p></table-cell><covered-table-cell number-columns-repeated='2'/><table-cell value-type='percentage' value='0.5'><p>50 %</p></table-cell><table-cell value-type='date' value='x'><p>May</p></table-cell><table-cell number-columns-repeated='9000'/></table-row><table-row><table-cell/></table-row></table>"
    assert cells("ods", make.zipped({"content.xml": f"<d>{body}</d>"})) == [(5, ["rye", "rye", "", "", "0.5", "May"])]
    wide = "<table><table-row><table-cell number-columns-repeated='9999'><p>z</p></table-cell></table-row></table>"
    assert [(n, len(row)) for n, row in cells("ods", make.zipped({"content.xml": wide}))] == [(1, 8192)]


def test_sheet_formats():
    book = make.xlsx({"Grain": [["Crop", "Sacks"], [], ["", "12"]], "Off": [["x"]]}, hidden=("Off",))
    assert cells("xlsx", book) == [(1, ["Crop", "Sacks"]), (3, ["", "12"])]
    typed = make.typed_xlsx([[("45000", "yyyy-mm-dd"), ("0.125", "0.0%"), ("41200", "#,##0.00"), ("1.5", None)]])
    assert cells("xlsx", typed) == [(1, ["2023-03-15", "12.5%", "41,200.00", "1.5"])]
    rich = "<worksheet><row><c t='inlineStr'><is><r><t>a</t></r><rPh><t>no</t></rPh><r><t>b</t></r></is></c><c t='b'><v>1</v></c><c r='E1' t='str'><f>x</f><v>s</v></c></row><row><c><v>cut"
    assert cells("xlsx", make.zipped({"xl/workbook.xml": f"<workbook {make.R}><sheet name='s' r:id='a'/></workbook>", "xl/_rels/workbook.xml.rels": "<r><Relationship Id='a' Target='w.xml'/></r>", "xl/w.xml": rich})) == [(1, ["ab", "TRUE", "", "", "s"])]


def workbook(sheet):
    styles = "<s><numFmt numFmtId='164' formatCode='#,##0.00'/><cellXfs><xf numFmtId='0'/><xf numFmtId='164'/><xf numFmtId='9'/></cellXfs></s>"
    return make.zipped({"xl/workbook.xml": f"<workbook {make.R}><sheet name='s' r:id='a'/></workbook>", "xl/_rels/workbook.xml.rels": "<r><Relationship Id='a' Target='w.xml'/></r>", "xl/styles.xml": styles, "xl/sharedStrings.xml": "<sst><si><t>oats</t></si></sst>", "xl/w.xml": sheet})


def test_rows_of_numbers_cost_few_calls():
    lines = [[str(n), f"{n}.5", "0.07", f"{n * 37 % 1000}.25", str(36000 + n)] for n in range(2000)]
    codes = [None, "0.0", "0%", "#,##0.00", "yyyy-mm-dd"]
    profile = cProfile.Profile()
    found = profile.runcall(lambda: cells("xlsx", make.typed_xlsx([list(zip(line, codes)) for line in lines])))
    assert found[1999] == (2000, ["1999", "1999.5", "7%", "963.25", "2004-01-13"]) and len(found) == 2000
    assert sum(e.callcount for e in profile.getstats()) / 2000 < 150


@pytest.mark.parametrize(
    "row",
    [
        '<row r="7" spans="1:3"><c r="A7" s="1"><v>1234.5</v></c><c r="C7" t="s"><v>0</v></c><c r="D7" s="2"/></row>',
        '<row spans="1:3" r="7"><c r="A7" s="1"><v>1</v></c></row>', "<row><c><v>1</v></c></row>", '<row r="7"/>', '<row r="7"><c r="B7" t="inlineStr"><is><t>a&amp;b</t></is></c></row>',
        # As many tags as two cells of a value have.
        '<row r="7"><c r="A7" s="1" t="s"/><c r="B7" t="str"><v>x</v></c><c R="C7"><v/></c></row>', '<row r="7"><c r="A7"><f></f></c></row>', '<row r="7"><c r="A7"><row><c r="B1"><v>2</v></c></row></c></row>', '<row a=">" r="7"><c r="A7"><v>1</v></c></row >',
        '<rowBreaks count="1"/>', '<x:row r="9"><c r="A9"><v>9</v></c></x:row>', '<row r="7"><c r="a7" s="2" t="n"><v>0.125</v></c></row>', '<row r="7"><c r="A7"><v>\r\n1</v></c></row>', '<row r="7"><c r="A7"><v>cut',
    ],
)
def test_rows_read_by_patterns_are_those_of_their_trees(row):
    number = lambda n: f'<row r="{n}"><c r="A{n}" s="1"><v>{n}000</v></c><c r="B{n}"><v>{n}</v></c></row>'
    sheet = f"<worksheet><sheetData>{number(1)}{number(2)}{number(3)}{row}{row}{number(20)}{number(21)}{number(22)}</sheetData></worksheet>"
    # A comment leaves it to trees.
    assert cells("xlsx", workbook(sheet)) == cells("xlsx", workbook(sheet.replace("<sheetData>", "<sheetData><!-- -->")))
    assert cells("xlsx", workbook(sheet))[:3] == [(1, ["1,000.00", "1"]), (2, ["2,000.00", "2"]), (3, ["3,000.00", "3"])]


@pytest.mark.parametrize(
    ("value", "code", "text"),
    [
        ("99.995", "0.00", "100.00"), ("1234567.5", "#,##0", "1,234,568"), ("0.005", "0%", "1%"), ("-0.4", "0", "0"), ("007", "0", "7"), ("12345678901234567.5", "0.0", "12345678901234567.5"), ("1.", "0.0", "1.0"), ("٣", "0.0", "3.0"), ("1234.5", "#,##0.000%", "123,450.000%"),
        ("0.5", 0, "0.5"), ("0.5", 2, "0.50"), ("0.5", 9, "50%"), ("0.5", 10, "50.00%"), ("45000", 14, "03-15-23"), ("45000", 15, "15-Mar-23"), ("45000.5", 22, "3/15/23 12:00"),
        ("12345", 11, "1.23E+04"), ("0.25", 12, "1/4"), ("-1234.5", 39, "(1,234.50)"), ("-1234.5", 44, " $(1,234.50)"), ("1.5", 46, "36:00:00"), ("0.001", 47, "01:26.4"), ("12345", 48, "12.3E+3"), ("text", 4, "text"),
        ("45000.75", "d/m/yyyy h:mm AM/PM", "15/3/2023 6:00 PM"), ("45000", "dddd, mmmm d", "Wednesday, March 15"), ("1234567", '0.0,,"M"', "1.2M"), ("5", "[$€-407] 0.00", "€ 5.00"), ("5551234", "000-0000", "555-1234"),
        ("-0.001", "0.00", "0.00"), ("0.3333", "# ?/8", "3/8"), ("-12", "0;;;", ""), ("3", "0.##", "3."), ("0.5", "mm:ss", "00:00"), ("2", "@", "2"), ("1E-7", "General", "0.0000001"), ("0.30000000000000004", 0, "0.3"), ("1e400", 2, "1e400"),
    ],
)
def test_number_formats(value, code, text):
    assert shown_number(value, BUILT_IN[code] if isinstance(code, int) else code) == text


def test_slides_come_in_order_of_presentation():
    assert [(b.slide, b.text) for b in blocks_of("pptx", make.pptx(["Weir", "", "Sluice\nGate"]))[0]] == [(1, "Weir"), (3, "Sluice\nGate")]
    loose = make.zipped({"ppt/slides/slide10.xml": "<s><t>ten</t></s>", "ppt/slides/slide2.xml": "<s><t>two</t><t>broken", "[Content_Types].xml": ""})
    assert [(b.slide, b.text) for b in blocks_of("pptx", loose)[0]] == [(1, "two"), (2, "ten")]
    assert [(b.slide, b.text) for b in blocks_of("odp", make.odp(["one\ntwo", "", "three"]))[0]] == [(1, "one\ntwo"), (3, "three")]


def test_book_follows_its_spine():
    assert shown("epub", make.epub(["<h1>Of wheels</h1><p>a</p>", "<p>b</p>"])) == [("Heading", 1, "Of wheels"), ("Paragraph", 0, "a"), ("Paragraph", 0, "b")]
    assert blocks_of("epub", make.zipped({"META-INF/container.xml": "<c/>"}))[1] == "INVALID"


def test_mail_without_quotes_and_signature():
    message = b"From: cid@weir.example\r\nSubject: oats\r\n\r\nSend nine.\r\n > send ten?\r\n\r\nBy rail.\r\n-- \r\nCid"
    found = blocks_of("eml", message)[0]
    assert [(b.text, b.anchor_kind) for b in found] == [("Send nine.", "Email"), ("By rail.", "Email")]
    assert texts("eml", make.eml("the body")) == ["the body"]
    assert texts("eml", make.eml("<p>hi</p>", html=True)) == ["hi"]
    assert blocks_of("eml", b"no header\n\nx")[1] == "INVALID"
    nested = b'Content-Type: multipart/mixed; boundary=a\n\n--a\nContent-Type: multipart/alternative; boundary="b"\n\n--b\nContent-Type: text/html\n\n<p>h</p>\n--b\nContent-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\npl=C3=A4in=\n text\n--b--\n--a--\n'
    assert texts("eml", nested) == ["pläin text"]
    assert texts("eml", b"Content-Type: multipart/mixed; boundary=a\n\n--a\n\nno type\n--a--") == []


def test_rtf():
    assert texts("rtf", rb"{\rtf1{\colortbl;}{\fonttbl{\f1 Slab;}}\i Wet\i0  oats\par\par Dry rye.}") == ["Wet oats", "Dry rye."]
    assert texts("rtf", rb"{\rtf1 cut\'4") == ["cut"]
    assert texts("rtf", rb"Q\u8226?B\'e9 \uc0\u-10179 x\{y\}") == ["Q•Bé �x{y}"]
    assert texts("rtf", rb"{\*\generator no}{\info no}a\~b\-1c\line d") == ["a~bc\nd"]


def test_detection_and_hints():
    assert archive_format(make.docx([])) == "docx"
    assert archive_format(make.xlsx({"a": []})) == "xlsx"
    assert archive_format(make.pptx(["a"])) == "pptx"
    assert [archive_format(f) for f in (make.odt([]), make.ods({}), make.odp([]), make.epub([]))] == ["odt", "ods", "odp", "epub"]
    assert archive_format(make.zipped({"a": "b"})).startswith("UNSUPPORTED")
    assert archive_format(b"PK\x03\x04garbage").startswith("INVALID")
    assert [hint_of(*x) for x in (("a/b.CSV", "text/html"), ("noext", "Text/HTML"), ("a.b/c", ""), ("x.unknown", "text/csv"), (None, "message/rfc822"), ("x.", "text/csv"))] == [".csv", ".html", "", ".unknown", ".eml", "."]


def test_archive_bounds():
    archive = Archive(make.zipped({"big": "x" * 5000}))
    assert archive.read("big", 5000) == (b"x" * 5000, None)
    assert archive.read("big", 4999)[1].code == "INVALID"
    with pytest.raises(Rejected):
        Archive(make.zipped({str(n): "" for n in range(8193)}))
    assert resolve("ppt", "../x/a.xml") == "x/a.xml"
    assert resolve("ppt", "/x.xml") == "x.xml"


def test_block_fields():
    assert Block("Paragraph").anchor_kind == "Section"
