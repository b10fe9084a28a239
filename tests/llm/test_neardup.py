import random

import pytest

from blockmill.llm import neardup
from blockmill.llm.components import connected_components

WORDS = [f"w{n}" for n in range(400)]


def shingles(text):
    w = neardup.words_of(text)
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 20 else None


def brute(rows, threshold=0.6):
    sets = {i: s for i, t in rows if t and i is not None and (s := shingles(t))}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n / (len(sets[a]) + len(sets[b]) - n) >= threshold:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def corpus(seed=1, families=25):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [rng.choice(WORDS) for _ in range(60)]
        for _ in range(rng.choice([1, 1, 2, 5])):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(60)] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(text)))
    return rows


def groups(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "chunk_id bigint, text string, group_id int")
    return {r.chunk_id: r.group_id for r in neardup.similar_groups(df, **options).collect()}


def test_groups_equal_brute_force(spark):
    rows = corpus() + [(900, None), (901, ""), (902, "too few words"), (903, "  ".join(WORDS[:30]).upper()), (904, "\n".join(WORDS[:30])), (None, "x " * 30)]
    rows += [rows[0], rows[3]]  # sent again
    assert groups(spark, rows) == brute(rows)


@pytest.mark.parametrize("small,deeper", [(3, 1), (2, 0)])
def test_buckets_that_stay_large(spark, small, deeper):
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(80)]
    rows = []
    for n in range(60):
        text = list(base)
        for _ in range(3):
            text[rng.randrange(80)] = rng.choice(WORDS)
        rows.append((n, " ".join(text)))
    rows += [(100 + n, t) for n, (_, t) in enumerate(corpus(7, 10))]
    assert groups(spark, rows, small=small, deeper=deeper, depth=1) == brute(rows)


def test_recall_of_a_pair_at_the_threshold():
    assert 0.5 < neardup.survival(2, 0.6) < 0.65
    runs = neardup.runs_needed(3, 0.6, 0.999)
    assert (1 - neardup.survival(3, 0.6)) ** runs <= 0.001


def test_pairs_and_empty_tables(spark):
    rows = [(1, " ".join(WORDS[:40])), (2, " ".join(WORDS[:40])), (3, " ".join(WORDS[:39])), (4, " ".join(WORDS[100:140]))]
    df = spark.createDataFrame(rows, "chunk_id bigint, text string")
    pairs = {tuple(r) for r in neardup.pairs_within(neardup.similar_groups(df)).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3)}
    tiled = {tuple(r) for r in neardup.pairs_within(neardup.similar_groups(df), tile=1).collect()}
    assert tiled == pairs
    assert neardup.similar_groups(df.where("false")).count() == 0


def test_sketches_let_likely_pairs_pass():
    rng = random.Random(9)
    missed = 0
    for _ in range(300):
        both, one, two = ({rng.getrandbits(60) for _ in range(n)} for n in (60, 20, 20))
        sig = neardup.np.stack([neardup.signature(neardup.np.array(sorted(x), neardup.np.uint64)) for x in (both | one, both | two)])
        a, b = neardup._sketches(sig)
        missed += not neardup._near(neardup.np.array([a]), b, 0.6)[0]
    assert missed <= 1


def test_a_third_of_all_rows_are_copies(spark):
    rows = corpus(11, 30)
    copies = [(1000 + n, rows[0][1]) for n in range(len(rows) // 2)]
    assert groups(spark, rows + copies) == brute(rows + copies)


def test_very_long_text(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60_000))
    assert groups(spark, [(1, text), (2, text + " end")]) == {1: 1, 2: 1}


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(n, n + 1) for n in range(1, 40)] + [(100, n) for n in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5), (None, 1)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{n: 1 for n in range(1, 41)}, **{n: 100 for n in range(100, 160)}, **{n: 200 for n in range(200, 203)}}
    assert connected_components(df.where("false")).count() == 0
