import random

import numpy as np
import pytest

from blockmill.llm import spans


def corpus(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijé漢") for _ in range(rng.randint(2, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    shared = [fresh(n) for n in (10, 20, 40, 41, 42, 80, 200)]
    docs = []
    for n in range(60):
        parts = [fresh(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            cut = rng.randrange(len(s) // 2)
            parts += [s[cut : cut + rng.randint(100, 400)], fresh(rng.randint(1, 20))]
        docs.append((n, "".join(parts)))
    return docs


def brute(docs, span):
    where = {}
    for d, t in docs:
        for k in range(len(t) - span + 1):
            where.setdefault(t[k : k + span], set()).add(d)
    covered = {}
    for d, t in docs:
        mark = np.zeros(len(t), bool)
        for k in range(len(t) - span + 1):
            if len(where[t[k : k + span]]) > 1:
                mark[k : k + span] = True
        if mark.any():
            covered[d] = int(mark.sum())
    return covered


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, start int")


@pytest.mark.parametrize("span", [200, 60])
def test_spans_equal_brute_force(spark, span):
    docs = corpus()
    want = brute(docs, span)
    df = frame(spark, docs).cache()
    assert {r.doc_id for r in spans.documents_with_shared_spans(df, span=span).collect()} == set(want)
    share = spans.shared_share(df, span=span).collect()
    assert {r.doc_id: r.shared_chars for r in share} == want and all(0 < r.share <= 1 for r in share)
    rows, text = spans.shared_spans(df, span=span).collect(), dict(docs)
    covered = {d: np.zeros(len(t), bool) for d, t in docs}
    for r in rows:
        a, b, n = text[r.doc_id], text[r.partner_id], r.span_end - r.span_start
        end = r.partner_start + n
        assert r.doc_id != r.partner_id and n >= span and a[r.span_start : r.span_end] == b[r.partner_start : end]
        assert r.span_start == 0 or r.partner_start == 0 or a[r.span_start - 1] != b[r.partner_start - 1]
        assert r.span_end == len(a) or end == len(b) or a[r.span_end] != b[end]
        covered[r.doc_id][r.span_start : r.span_end] = True
    assert {d: int(c.sum()) for d, c in covered.items() if c.any()} == want
    assert len(rows) == len(set(rows))


def test_length_counts_to_the_character(spark):
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    exact, less = line(200), line(199)
    docs = [(1, line(50) + exact + "1" + line(50)), (2, line(70) + exact + "2"), (3, line(9) + "3" + less + "3"), (4, "4" + less + "4" + line(80)), (5, line(300))]
    assert {r.doc_id for r in spans.documents_with_shared_spans(frame(spark, docs)).collect()} == {1, 2}


def test_nulls_repeats_and_own_repetitions(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdef ") for _ in range(300))
    docs = [(1, text + text), (2, None), (3, ""), (None, text), (4, "short"), (1, text + text), (5, "a" * 1000)]
    assert spans.documents_with_shared_spans(frame(spark, docs)).count() == 0
    assert spans.shared_spans(frame(spark, docs)).count() == 0
    assert {r.doc_id for r in spans.documents_with_shared_spans(frame(spark, [*docs, (6, "a" * 250), (7, text)])).collect()} == {1, 5, 6, 7}
    assert spans.documents_with_shared_spans(frame(spark, [])).count() == 0


def test_a_repeated_text_counts_with_the_context_of_each_copy(spark):
    rng = random.Random(10)
    line = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    docs = []
    for n in range(30):
        twice, before, p = line(500), line(150), 20 + 2 * n
        docs.append((2 * n, line(150) + twice + before + twice + line(50)))
        docs.append((2 * n + 1, line(90) + "1" + before[-p:] + twice[: 200 - p] + "2" + line(90)))
    want = brute(docs, 200)
    assert len(want) == 60
    assert {r.doc_id for r in spans.documents_with_shared_spans(frame(spark, docs)).collect()} == set(want)


def test_segments_of_long_texts_choose_the_same_anchors(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    whole = [x.tolist() for x in spans.anchors(text, 200)]
    around = [x.tolist() for x in spans.spans_around(text, np.array(whole[0]), 200)]
    monkeypatch.setattr(spans, "SEGMENT", 700)
    assert [x.tolist() for x in spans.anchors(text, 200)] == whole
    parted = spans.spans_around(text, np.array(whole[0]), 200)
    assert dict(zip(*around)) == dict(zip(*(x.tolist() for x in parted)))
