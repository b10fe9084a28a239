import pytest
from pyspark.sql import functions as F

from blockmill.llm import mixing

SIZED = "doc_id bigint, source string, n_tokens bigint, weight double, times string"
TARGETS = "mix_name string, source_name string, target_share double, max_repeats int, total_factor double"


def docs(spark, rows):
    return spark.createDataFrame([(n, s, t, w, "") for n, (s, t, w) in enumerate(rows)], SIZED)


def mixed(spark, sized, targets, **options):
    goals = spark.createDataFrame(targets, TARGETS)
    taken = mixing.mix_sources(sized, goals, **options)
    return taken, {(r.mix_name, r.source_name): r for r in mixing.reached_shares(taken, sized, goals).collect()}


def test_shares_are_reached_and_repeats_capped(spark):
    sized = docs(spark, [("big", 10 + n % 7, 1.0) for n in range(3000)] + [("small", 12, 1.0) for _ in range(50)] + [(None, 500, 1.0)])
    taken, got = mixed(spark, sized, [("m", "big", 0.7, 2, 1.0), ("m", "small", 0.3, 4, 1.0), ("m", "absent", 0.0, 1, 1.0), ("n", "big", 1.0, 1, 0.25)])
    total = sized.agg(F.sum("n_tokens")).first()[0]
    assert abs(got["m", "big"].reached_tokens - 0.7 * total) <= 10
    assert got["m", "small"].reached_tokens == 4 * 50 * 12  # capped
    assert abs(got["n", "big"].reached_tokens - 0.25 * total) <= 10
    assert got["m", "absent"].reached_tokens == 0
    assert abs(sum(r.reached_share for (m, _), r in got.items() if m == "m") - 1) < 1e-9
    assert taken.where("source_name = 'small'").select("times").distinct().collect()[0].times == 4
    assert taken.select("mix_name", "doc_id").distinct().count() == taken.count()


def test_complete_epochs_come_before_the_part(spark):
    sized = docs(spark, [("a", 10, 1.0) for _ in range(100)])
    taken, got = mixed(spark, sized, [("m", "a", 1.0, 9, 2.5)])
    counts = {r.times: r.n for r in taken.groupBy("times").agg(F.count("*").alias("n")).collect()}
    assert counts == {2: 50, 3: 50} and got["m", "a"].reached_tokens == 2500


def test_weights_favour_documents(spark):
    sized = docs(spark, [("a", 1, 8.0 if n % 2 else 1.0) for n in range(4000)])
    taken, _ = mixed(spark, sized, [("m", "a", 1.0, 1, 0.2)])
    heavy = taken.where("doc_id % 2 = 1").count()
    assert taken.count() == 800 and heavy > 600


@pytest.mark.parametrize("parts", [1, 7])
def test_same_result_for_any_order(spark, parts):
    rows = [("a", 5 + n % 3, 1.0) for n in range(500)]
    goal = [("m", "a", 1.0, 1, 0.33)]
    one = {r.doc_id for r in mixed(spark, docs(spark, rows), goal)[0].collect()}
    two = {r.doc_id for r in mixed(spark, docs(spark, rows).repartition(parts).orderBy(F.rand()), goal)[0].collect()}
    assert one == two and one != {r.doc_id for r in mixed(spark, docs(spark, rows), goal, seed=1)[0].collect()}


def test_nulls_zeros_and_empty_tables(spark):
    sized = docs(spark, [("a", 0, 1.0), ("a", 5, None), ("a", 5, -1.0), (None, 5, 1.0)])
    taken, got = mixed(spark, sized, [("m", "a", 1.0, None, 9.0), ("m", None, 0.5, 1, 1.0), (None, "a", 0.5, 1, 1.0), ("z", "a", None, 1, None)])
    assert {(r.doc_id, r.times) for r in taken.collect()} == {(1, 1), (2, 1)}
    assert mixed(spark, sized.where("false"), [("m", "a", 1.0, 1, 1.0)])[0].count() == 0
    goals = spark.createDataFrame([], TARGETS)
    assert mixing.mix_sources(sized, goals).count() == 0


def test_documents_are_sized_by_the_tokenizer(spark):
    table = spark.createDataFrame([(1, "a", "Hello world", 0), (1, "a", "Hello world", 0), (2, "a", None, 0), (3, None, "", 0)], "doc_id bigint, source string, text string, n_tokens int")
    assert {(r.doc_id, r.n_tokens) for r in mixing.weighed_documents(table).collect()} == {(1, 2), (2, 0), (3, 0)}
    goals = spark.createDataFrame([("m", "a", 1.0, 3, 3.0)], TARGETS)
    rows = mixing.mixture(table, goals).collect()
    assert [(r.doc_id, r.times, r.reached_share) for r in rows] == [(1, 3, 1.0)]


def test_weights_are_measured_against_the_source(spark):
    rows = [(n, "code", 100, 300 + n % 3, 1.0) for n in range(40)] + [(100, "code", 290, 300, 1.0), (101, "code", 100, 300, 0.25), (102, "code", 0, 0, 1.0), (103, None, 5, 10, 1.0), (104, "lone", 5, 10, 0.5)]
    got = {r.doc_id: r.weight for r in mixing.quality_weights(spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, n_chars int, fresh double")).collect()}
    assert len(got) == len(rows) and min(got[n] for n in range(40)) > 0.9
    assert got[100] < 0.05 and 0.2 < got[101] < 0.25 and got[102] == got[103] == 1.0 and got[104] == 0.5


def test_fresh_lines(spark):
    df = spark.createDataFrame([("a\nb\na\na",), ("a",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(mixing.fresh_lines(F.col("text"))).collect()] == [0.5, 1.0, 1.0, 1.0]
