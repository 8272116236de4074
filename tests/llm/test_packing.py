import random

import numpy as np
import pytest

from lumenspark.llm import packing


@pytest.mark.parametrize("capacity", [1, 7, 100, 512])
def test_plan_uses_every_length(capacity):
    rng = np.random.default_rng(capacity)
    hist = np.zeros(capacity + 1, np.int64)
    for n in rng.integers(1, capacity + 1, 500):
        hist[n] += 1
    plan = packing.plan_windows(hist, capacity)
    used = np.zeros_like(hist)
    for pattern, more, times in plan:
        assert sum(pattern) + sum(more) <= capacity and times > 0
        for a in pattern + more:
            used[a] += times
    assert (used == hist).all()
    assert packing.plan_windows(np.zeros(capacity + 1, np.int64), capacity) == []


def test_patterns_place_most_pieces():
    rng = np.random.default_rng(1)
    for capacity in (512, 2048, 8192):
        hist = np.bincount(np.minimum(capacity, rng.lognormal(5.2, 0.7, 40_000).astype(int) + 1), minlength=capacity + 1)
        plan = packing.plan_windows(hist, capacity)
        fitted, all_ = sum(len(p) * t for p, _, t in plan), sum((len(p) + len(m)) * t for p, m, t in plan)
        windows = sum(t for *_, t in plan)
        assert all_ == hist.sum() and fitted > (0.65 if capacity == 512 else 0.8) * all_
        assert (hist * np.arange(capacity + 1)).sum() > 0.995 * windows * capacity


def test_fit_is_the_least_squares_one():
    # Two kinds of pieces of 512 and 256 cells: all that fits a window is 2 + 0, 1 + 2 or 0 + 4 of them.
    rows, x = packing.fitted(np.array([1000.0, 1200.0]), np.array([512, 256]))
    assert np.allclose(x @ rows, [1000, 1200], rtol=0.01) and (x >= 0).all() and all((r @ [512, 256]) == 1024 for r in rows)


def test_places(spark):
    rng = random.Random(1)
    lengths = [(i, rng.choice([3, 3, 3, 17, rng.randrange(1, 300)])) for i in range(3000)] + [(9000, 1000), (9001, 128), (9002, 129)]
    df = spark.createDataFrame(lengths, "doc_id bigint, n_tokens bigint").repartition(3)
    rows = packing.pack_lengths(df, [64, 128]).collect()
    for c in (64, 128):
        mine = [r for r in rows if r.capacity_tokens == c]
        load, of = {}, {}
        for r in mine:
            load[r.window_no] = load.get(r.window_no, 0) + r.n_tokens
            of.setdefault(r.doc_id, []).append(r.n_tokens)
        assert max(load.values()) <= c and sorted(load) == list(range(len(load)))
        for i, n in lengths:
            assert sum(of[i]) == n and len(of[i]) == -(-n // c)
        assert sum(load.values()) / (c * len(load)) > 0.97
    # A length held by many pieces is ranked in parts, with the same number of windows.
    parts = packing.pack_lengths(df, [64, 128], part=100).collect()
    assert {(r.capacity_tokens, r.window_no) for r in parts} == {(r.capacity_tokens, r.window_no) for r in rows}
    load = {}
    for r in parts:
        load[r.capacity_tokens, r.window_no] = load.get((r.capacity_tokens, r.window_no), 0) + r.n_tokens
    assert all(v <= c for (c, _), v in load.items())
    assert packing.pack_lengths(df.limit(0), [64]).count() == 0 == packing.pack_lengths(df, []).count()


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, " "), (4, "<|endoftext|>"), (1, "Hello world"), (5, "word " * 20_000)], "doc_id bigint, text string")
    got = sorted(map(tuple, packing.token_counts(df).collect()))
    assert got[0] == got[1] == (1, 2) and [i for i, _ in got] == [1, 1, 4, 5] and got[2][1] > 1 and got[3][1] >= 20_000
