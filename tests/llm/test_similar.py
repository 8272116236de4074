import random
import re

from lumenspark.llm import similar


def brute(rows):
    sets = [(i, frozenset(re.findall("[a-z0-9]+", (t or "").lower()))) for i, t in dict(rows).items()]
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 10 * len(x & y) >= 7 * len(x | y)}


def make(rng):
    vocab = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.6:
            ws = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(0, 6)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            rng.shuffle(ws)
        else:
            ws = rng.sample(vocab, rng.randrange(5, 40))
        rows.append((i, " ".join(ws)))
    return rows


def test_pairs_against_brute_force(spark):
    rows = make(random.Random(2)) + [(500, None), (501, ""), (502, "!?"), (503, "one"), (504, "ONE one."), (505, " ".join(f"u{i}" for i in range(50_000))), (506, " ".join(f"u{i}" for i in range(45_000)))]
    rows += [(600, " ".join(f"k{i}" for i in range(10))), (601, " ".join(f"k{i}" for i in range(7)))]  # exactly 0.7
    df = spark.createDataFrame([(*r, 1) for r in rows], "question_id bigint, question string, words int")
    assert set(map(tuple, similar.similar_pairs(df).collect())) == brute(rows)
    assert similar.similar_pairs(df.limit(0)).count() == 0


def test_groups(spark):
    rows = make(random.Random(4))
    df = spark.createDataFrame(rows, "question_id bigint, question string")
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = brute(rows)
    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {i: root(i) for p in pairs for i in p}
    assert {r.question_id: r.group_id for r in similar.groups(df).collect()} == want


def test_voronoi_join_is_exact(spark):
    rows = make(random.Random(6))
    cls = similar.classes(similar.word_sets(spark.createDataFrame(rows, "question_id bigint, question string")))
    want = {(r.a, r.b, r.common, r.either) for r in similar.class_pairs(cls).collect()}
    for pivots, bound in ((4, 20), (8, 1000), (3, 7)):
        assert {(r.a, r.b, r.common, r.either) for r in similar.voronoi_pairs(cls, pivots, bound).collect()} == want
    regions = similar.voronoi_regions(cls, 4, 20)
    assert regions.filter("anchor").count() == cls.count() == regions.select("cls").distinct().count()
    assert similar.voronoi_pairs(cls.limit(0)).count() == 0
