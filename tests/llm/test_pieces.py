from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockmill.llm import pieces

SCHEMA = "id bigint, text string, limit_bytes int, over int, piece_no string"


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return pieces.split_oversized(df, id_col="id", text_col="text", limit_col="limit_bytes", overlap_col="over", **options)


def check(text, limit, overlap, parts):
    data = text.encode()
    used = pieces.usable_overlap(limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(data)
    for start, end, piece in parts:
        assert data[start:end].decode() == piece and (len(piece.encode()) <= limit or len(piece) == 1)
    for (_, end, _), (start, _, _) in zip(parts, parts[1:]):
        assert 0 <= end - start <= used and end - start > used - 4
        assert start <= end


@settings(max_examples=200)
@given(st.text(alphabet="ab. \n,é漢。🎉", min_size=1, max_size=400), st.integers(4, 90), st.integers(0, 100))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    parts = pieces.split_text(text, limit, overlap)
    check(text, limit, overlap, parts)


def test_cuts_fall_where_the_text_pauses():
    text = "One sentence here. Another one there, with a clause. Third.\n\nA new paragraph starts now. And goes on."
    parts = [p for _, _, p in pieces.split_text(text, 64, 0)]
    assert parts[0].endswith("Third.\n\n")
    assert all(p[-1] in " \n." for p in parts)


def test_an_unbroken_run_is_cut_off_at_the_pause_before_it():
    text = "One sentence here. Then a key follows: " + "x" * 300
    parts = [p for _, _, p in pieces.split_text(text, 100, 0)]
    assert parts == ["One sentence here. ", "Then a key follows: ", *parts[2:]] and set("".join(parts[2:])) == {"x"}
    check(text, 100, 10, pieces.split_text(text, 100, 10))


def test_limits_below_a_character():
    assert [p for _, _, p in pieces.split_text("🎉é", 1, 0)] == ["🎉", "é"]
    assert "".join(p for _, _, p in pieces.split_text("abc", 1, 9)) == "abc"


def test_ranges_give_the_same_pieces(spark):
    text = "".join(f"Word{n} and more, é漢 text{'.' if n % 7 == 0 else ''}{chr(10) * (n % 23 == 0)} " for n in range(3000)) + " " * 400 + "x" * 5000
    rows = [(1, text, 700, 90), (2, "漢" * 3000, 500, 499), (3, "short", 700, 0)]
    whole = {(r.id, r.piece_no): (r.start_byte, r.end_byte, r.piece) for r in run(spark, rows).collect()}
    ranged = {(r.id, r.piece_no): (r.start_byte, r.end_byte, r.piece) for r in run(spark, rows, range_bytes=4096).collect()}
    assert whole == ranged and {k[0] for k in whole} == {1, 2}
    check(text, 700, 90, [whole[k] for k in sorted(whole) if k[0] == 1])


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet="ab. \n\t,)é漢。🎉", min_size=1, max_size=700), st.integers(4, 60), st.integers(0, 60), st.integers(1, 200))
def test_the_size_of_a_range_has_no_part_in_the_pieces(text, limit, overlap, size):
    assert pieces.split_text(text, limit, overlap, size) == pieces.split_text(text, limit, overlap)


def test_long_white_space_is_one_pause():
    data = b"end." + b"\n" + b" " * 300 + b"\nnext"
    assert max(pieces.boundaries(data, 0, 0, len(data), 64).table, key=lambda x: x[1]) == (306, pieces.PARAGRAPH)


def test_many_ranges_in_spark(spark):
    import random

    rng = random.Random(4)
    rows = [(n, "".join(rng.choice(["ab ", "c", "é", "漢", "。", ". ", "\n\n", " " * 40, "x" * 30]) for _ in range(rng.randint(100, 900))), rng.randint(4, 60), rng.randint(0, 50)) for n in range(60)]
    ranged = {(r.id, r.piece_no): (r.start_byte, r.end_byte, r.piece) for r in run(spark, rows, range_bytes=1).collect()}
    assert ranged == {(n, k): p for n, text, limit, over in rows for k, p in enumerate(pieces.split_text(text, limit, over), 1)}


def test_files_are_read_by_ranges(spark, tmp_path):
    text = "".join(f"Word{n} and more, é漢 text{'.' if n % 7 == 0 else ''}{chr(10) * (n % 23 == 0)} " for n in range(20000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "b.txt").write_text("short")
    got = {(r.path.rpartition("/")[2], r.piece_no): (r.start_byte, r.end_byte, r.piece) for r in pieces.split_files(spark, str(tmp_path), 700, 90, range_bytes=20000).collect()}
    assert got == {("b.txt", 1): (0, 5, "short")} | {("a.txt", k): p for k, p in enumerate(pieces.split_text(text, 700, 90), 1)}


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, 5, 0), (2, "", 5, 0), (3, "abcdefgh", None, 0), (4, "abcdefgh", 0, 0), (5, "ab cd ef gh", 6, None), (5, "ab cd ef gh", 6, None)]
    got = run(spark, rows).collect()
    assert {r.id for r in got} == {5} and sorted(r.piece for r in got if r.piece_no == 1) == ["ab cd ", "ab cd "]
    assert run(spark, []).count() == 0


def test_resent_chunks_and_unknown_uploads(spark):
    chunks = spark.createDataFrame([(1, 7, "x" * 700, "2024-01-01"), (1, 7, "x" * 700, "2024-01-02"), (2, 8, "y" * 6001, None), (3, 7, None, None), (4, None, "z" * 6001, None)], "chunk_id bigint, upload_id bigint, text string, loaded_at string")
    uploads = spark.createDataFrame([(7, 400, 50, 500, "2024-01-01"), (7, 500, 0, 650, "2024-02-01")], "upload_id bigint, target_chars int, overlap_chars int, max_chars int, received_at string")
    got = pieces.chunk_pieces(chunks, uploads)
    assert {r.chunk_id: r.n for r in got.groupBy("chunk_id").agg(F.count("*").alias("n")).collect()} == {1: 2, 2: 2, 4: 2}
