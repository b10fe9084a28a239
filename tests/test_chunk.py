"""Chunkers on hand-built blocks."""

from pyspark.sql import functions as F

from blockmill.operators.chunk import chunk_blocks, chunk_prose, chunk_sheets, chunk_slides, fill_section, heading_paths

SCHEMA = "doc_id int, block_no int, kind string, block_level int, text string, cells array<string>, row_no int, anchor_kind string, slide int, sheet string"


def frame(spark, rows, target=5500, overlap=0, maximum=6000):
    full = [(1, n, r.get("kind", "Paragraph"), r.get("level", 0), r.get("text", ""), r.get("cells"), r.get("row", 0), r.get("anchor", "Section"), r.get("slide", 0), r.get("sheet", "")) for n, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).withColumns({"target": F.lit(target), "overlap": F.lit(overlap), "maximum": F.lit(maximum)})


def heading(level, text):
    return {"kind": "Heading", "level": level, "text": text}


def para(text, anchor="Section"):
    return {"text": text, "anchor": anchor}


def taken(df):
    return df.orderBy("idx").collect()


def test_labels_follow_the_headings(spark):
    rows = taken(chunk_prose(frame(spark, [para("Opening."), heading(1, "Mill"), heading(2, "Stones"), para("Dress them yearly."), heading(2, "Sluice"), para("Rake it."), para("Oil it.")], 900), ["doc_id"]))
    assert [(r.source_label, r.text) for r in rows] == [("", "Opening."), ("Mill › Stones", "Mill › Stones\n\nDress them yearly."), ("Mill › Sluice", "Mill › Sluice\n\nRake it.\n\nOil it.")]
    assert [list(r.heading_path) for r in rows] == [[], ["Mill", "Stones"], ["Mill", "Sluice"]]


def test_a_section_beyond_the_target_keeps_its_label(spark):
    rows = taken(chunk_prose(frame(spark, [heading(3, "Weir"), para("m" * 70), para("n" * 50), para("o" * 20)], 100, 0, 400), ["doc_id"]))
    assert [(r.source_label, len(r.text)) for r in rows] == [("Weir", 76), ("Weir", 78)]


def test_the_last_words_of_a_full_group_open_the_next():
    texts = ["the miller grinds rye", "and barley at dusk", "x" * 50, "then sleeps"]
    assert fill_section(texts[:2], "Mill", 30, 0, 900) == ["Mill\n\nthe miller grinds rye", "Mill\n\nand barley at dusk"]
    assert fill_section(texts[:2], "", 30, 11, 900)[1] == "grinds rye\n\nand barley at dusk" or fill_section(texts[:2], "", 30, 11, 900)[1] == "rye\n\nand barley at dusk"
    # A body that stands alone neither takes nor leaves last words.
    assert fill_section(texts, "", 45, 11, 45) == ["the miller grinds rye\n\nand barley at dusk", "x" * 45, "x" * 5, "then sleeps"]


def test_a_paragraph_beyond_the_maximum_is_cut_and_the_crumb_counts():
    assert fill_section(["aaaa bbbb"], "", 4, 0, 5) == ["aaaa ", "bbbb"]
    assert fill_section(["xxxxx"], "H", 5, 0, 5) == ["H\n\nxx", "xxx"]


def test_heading_alone_gives_nothing_and_levels_may_be_skipped(spark):
    assert taken(chunk_prose(frame(spark, [heading(1, "A")]), ["doc_id"])) == []
    paths = heading_paths(frame(spark, [heading(1, "A"), heading(4, "D"), para("x"), heading(2, " "), para("y"), heading(0, "Z"), para("z")]), ["doc_id"]).orderBy("block_no").collect()
    assert [list(p.heading_path) for p in paths] == [["A"], ["A", "D"], ["A", "D"], ["A"], ["A"], ["Z"], ["Z"]]


def test_mail_anchor(spark):
    assert [r.anchor_kind for r in taken(chunk_prose(frame(spark, [para("a", "Email")]), ["doc_id"]))] == ["Email"]


def test_sheet(spark):
    rows = [{"kind": "SheetRow", "cells": c, "row": r, "sheet": "Grain"} for r, c in ((3, ["Crop", "Sacks"]), (4, ["rye", "12"]), (9, ["oats", "7"]))]
    got = taken(chunk_sheets(frame(spark, rows, 30, 0, 9000), ["doc_id"]))
    assert [(r.source_label, r.cell_range) for r in got] == [('Sheet "Grain" summary', "A3:B9"), ('Sheet "Grain" rows 4-4', "A4:B4"), ('Sheet "Grain" rows 9-9', "A9:B9")]
    assert got[0].text == 'Sheet "Grain" — columns: Crop, Sacks. 2 data rows.\nSample rows:\nSheet "Grain" | Crop: rye | Sacks: 12\nSheet "Grain" | Crop: oats | Sacks: 7'


def test_sheet_rows_that_are_blank_long_or_ragged(spark):
    rows = [{"kind": "SheetRow", "cells": c, "row": n} for n, c in enumerate((["h", ""], ["a", "b", "c"], [" "], ["x" * 50], ["d"]), 1)]
    got = taken(chunk_sheets(frame(spark, rows, 20, 0, 30), ["doc_id"]))
    assert [r.source_label for r in got if not r.source_label.startswith("Summary")] == ["Rows 2-2", "Row 4", "Row 4", "Rows 5-5"]
    assert got[-1].text == "h: d"
    assert "h: a | Col B: b | Col C: c" in [r.text for r in got]
    named = [{"kind": "SheetRow", "cells": c, "row": n, "sheet": "S"} for n, c in enumerate((["h"], [" "]), 1)]
    assert [r.text for r in taken(chunk_sheets(frame(spark, named), ["doc_id"]))][1] == 'Sheet "S"'


def test_sheets_of_one_name_merge(spark):
    rows = [{"kind": "SheetRow", "cells": [c], "row": n, "sheet": s} for n, (s, c) in enumerate((("a", "h"), ("b", "k"), ("a", "x")), 1)]
    assert [r.source_label for r in taken(chunk_sheets(frame(spark, rows), ["doc_id"]))] == ['Sheet "a" summary', 'Sheet "a" rows 3-3', 'Sheet "b" summary']


def test_slides(spark):
    rows = [{"kind": "SlideTitle", "text": "T", "slide": 1}, {"kind": "SlideBody", "text": "B", "slide": 1}, {"kind": "SlideBody", "text": "U", "slide": 2}, {"kind": "SlideBody", "text": " ", "slide": 3}]
    one = taken(chunk_slides(frame(spark, rows, 100000), ["doc_id"]))
    assert [(r.source_label, r.slide, r.text) for r in one] == [("Slides 1-2", 1, "Slide 1\nT\nB\n\nSlide 2\nU")]
    two = taken(chunk_slides(frame(spark, rows, 1), ["doc_id"]))
    assert [r.source_label for r in two] == ["Slide 1", "Slide 2"]


def test_heading_paths_of_any_depth(spark):
    import random

    rng = random.Random(2)
    rows = [heading(rng.randint(1, 30), f"h{n}") if rng.random() < 0.6 else para(f"p{n}") for n in range(400)]
    got = heading_paths(frame(spark, rows), ["doc_id"]).orderBy("block_no").collect()
    open_ones: dict[int, str] = {}
    for r, found in zip(rows, got):
        if r.get("kind") == "Heading":
            open_ones = {k: v for k, v in open_ones.items() if k < r["level"]} | {r["level"]: r["text"]}
        assert list(found.heading_path) == [open_ones[k] for k in sorted(open_ones)]


def test_documents_and_tables_of_blocks_agree(spark):
    import random

    rng = random.Random(8)
    word = lambda: rng.choice(["rye", "", " ", "sluice gate", "é漢" * 9, "x" * 70, 'q"t\\', None])
    shapes = {
        "prose": lambda: heading(rng.randint(0, 12), word()) if rng.random() < 0.3 else para(word(), rng.choice(["Section", "Section", "Email"])),
        "sheets": lambda: {"kind": "SheetRow", "cells": [word() for _ in range(rng.randint(0, 5))], "row": rng.randint(1, 99), "sheet": rng.choice(["", "a", 'b"'])},
        "slides": lambda: {"kind": "SlideBody", "text": word(), "slide": rng.randint(1, 6), "anchor": "Slide"},
    }
    single = {"prose": chunk_prose, "sheets": chunk_sheets, "slides": chunk_slides}
    for shape, make in shapes.items():
        for target, overlap, maximum in ((60, 0, 90), (60, 20, 60), (5000, 10, 6000)):
            blocks = frame(spark, [make() for _ in range(120)], target, overlap, maximum).withColumn("shape", F.lit(shape))
            columns = ["idx", "text", "source_label", "anchor_kind", "anchor_code", "slide", "sheet", "cell_range", "heading_path", "token_count"]
            assert taken(chunk_blocks(blocks, ["doc_id"]).select(columns)) == taken(single[shape](blocks, ["doc_id"]).select(columns)), (shape, target)


def test_dispatch_by_shape_and_an_empty_table(spark):
    rows = frame(spark, [para("a")]).withColumn("shape", F.lit("prose"))
    assert chunk_blocks(rows, ["doc_id"]).count() == 1
    assert chunk_blocks(rows.where("false"), ["doc_id"]).count() == 0
