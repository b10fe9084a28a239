import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockmill.llm import packing

ITEMS = "rec string, upload_id bigint, item_id bigint, piece_no int, bytes int, queue string, capacity int, container string"


@given(st.lists(st.integers(0, 50), max_size=40), st.integers(50, 120))
def test_every_item_once_and_no_container_too_full(sizes, capacity):
    queues = [f"q{k % 3}" for k in range(len(sizes))]
    for found in (packing.pack(sizes, queues, capacity)[0], packing.best_fit(sizes, capacity), packing.fullest(sizes, capacity) if sizes else []):
        assert sorted(k for c in found for k in c) == list(range(len(sizes)))
        assert all(sum(sizes[k] for k in c) <= capacity for c in found)
    assert len(packing.pack(sizes, queues, capacity)[0]) <= max(1 if sizes else 0, len(packing.best_fit(sizes, capacity)))


def test_fewest_containers_where_the_plain_order_needs_more():
    # Best fit in decreasing order takes three, two are enough.
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 10, 10]
    assert len(packing.pack(sizes, ["a"] * len(sizes), 100)[0]) == 2


def test_containers_keep_the_mixture():
    sizes, queues = [10] * 90, ["a"] * 60 + ["b"] * 30
    found, owed = packing.pack(sizes, queues, 90)
    for c in found:
        assert 5 <= sum(queues[k] == "a" for k in c) <= 7
    assert all(abs(x) < 90 for x in owed.values())


def test_given_shares_and_debts_where_a_fuller_packing_wins():
    sizes, queues = [10] * 60, ["a"] * 30 + ["b"] * 30
    found = packing.round_robin(sizes, queues, 40, share={"a": 0.25, "b": 0.75})
    assert all(sum(queues[k] == "a" for k in c) == 1 for c in found[:9])
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 10, 10]
    queues = ["a", "b"] * 6
    containers, debts = packing.pack(sizes, queues, 100, {"a": 5.0, "b": -3.0})
    assert len(containers) == 2 and sum(debts.values()) == pytest.approx(2 + 200 - 200)
    share = packing.shares_of(sizes, queues)
    assert debts["a"] == pytest.approx(5 + 200 * share["a"] - sum(sizes[::2]))


def test_large_capacities_are_searched_in_units():
    sizes = [440_000, 240_000, 240_000, 220_000, 210_000, 170_000, 80_000, 80_000, 60_000, 60_000, 99_000, 99_000]
    found = packing.fullest(sizes, 1_000_000)
    assert len(found) == 2 and all(sum(sizes[k] for k in c) <= 1_000_000 for c in found)
    assert sorted(packing.fullest([999_999, 1_000_000], 1_000_000)) == [[0], [1]]


def test_debts_are_divided_among_slices_and_none_is_lost(spark):
    packed = [("block", 1, slice_no << 26, n, 0, 1, queue, 100, True, owed) for n, (slice_no, queue, owed) in enumerate([(0, "a", 9.0), (0, "b", -2.0), (1, "a", 3.0), (2, "a", 6.0), (2, "b", 4.0), (2, "b", 4.0)])]
    first = packing.debts_of(spark.createDataFrame(packed, packing._PACKED), None)
    assert {(r.queue, r.owed) for r in first.collect()} == {("a", 18.0), ("b", 2.0)}
    later = packing.debts_of(spark.createDataFrame(packed[:1], packing._PACKED), first)
    assert {(r.queue, r.owed) for r in later.collect()} == {("a", 9.0), ("b", 2.0)}


def test_large_uploads_are_packed_in_slices(spark):
    rng = random.Random(1)
    rows = [("block", 1, n, 0, rng.randint(1, 60), f"q{n % 2}", 100, "") for n in range(900)] + [("block", 2, 5000 + n, 0, 40, None, 100, "") for n in range(5)] + [("chunk", 1, 1, 0, 0, "q", 100, "")]
    df = spark.createDataFrame(rows, ITEMS)
    got = packing.pack_items(df, slice_items=100).cache()
    full = got.groupBy("rec", "upload_id", "container").agg(F.sum("bytes").alias("n")).collect()
    assert got.count() == len(rows) and got.select("rec", "item_id", "piece_no").distinct().count() == len(rows)
    assert max(r.n for r in full) <= 100
    least = -(-sum(r[4] for r in rows if r[1] == 1) // 100)
    assert sum(r.upload_id == 1 and r.rec == "block" for r in full) <= least * 1.03 + 1
    assert sum(r.upload_id == 2 for r in full) == 3
    assert packing.pack_items(df.where("false")).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_result_does_not_depend_on_the_order_of_rows(spark, order):
    rows = [("block", 1, n, 0, (n * 37) % 50 + 1, "q", 100, "") for n in range(80)][::order]
    got = packing.pack_items(spark.createDataFrame(rows, ITEMS).repartition(3 if order > 0 else 1))
    one = sorted((r.item_id, r.container) for r in got.collect())
    two = sorted((r.item_id, r.container) for r in packing.pack_items(spark.createDataFrame(rows[::-1], ITEMS)).collect())
    assert one == two


def test_items_of_uploads(spark):
    blocks = spark.createDataFrame([(1, 1, "Paragraph", "a" * 30, "2024-01-01"), (1, 1, "Paragraph", "a" * 30, "2024-01-02"), (2, 1, "SheetRow", None, None), (3, 1, "Paragraph", "word " * 30, None), (4, None, None, "x", None)], "block_id bigint, upload_id bigint, kind string, text string, loaded_at string")
    chunks = spark.createDataFrame([(1, 1, None, "c", None)], "chunk_id bigint, upload_id bigint, source_label string, text string, loaded_at string")
    uploads = spark.createDataFrame([(1, 40, None)], "upload_id bigint, target_chars int, received_at string")
    got = packing.pack_items(packing.upload_items(blocks, chunks, uploads)).collect()
    assert {(r.rec, r.item_id) for r in got} == {("block", n) for n in (1, 2, 3, 4)} | {("chunk", 1)}
    pieces = [r for r in got if r.item_id == 3]
    assert sum(r.bytes for r in pieces) == 150 and all(r.bytes <= 40 for r in pieces) and min(r.piece_no for r in pieces) == 1
