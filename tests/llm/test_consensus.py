import random

from lumenspark.llm import consensus

SCHEMA = "evaluation_id bigint, question_id bigint, evaluator_id string, question_clarity double, option_quality double, medical_accuracy double, overall_quality double, submitted_at timestamp_ntz, label int"


def form(i, q, e, s, day=1):
    import datetime as dt

    return (i, q, e, *([s] * 4 if not isinstance(s, tuple) else s), None if day is None else dt.datetime(2025, 1, day), 0)


def test_planted_scores_are_recovered(spark):
    rng = random.Random(1)
    truth = {q: rng.randrange(1, 6) for q in range(120)}
    rows = []
    for q, t in truth.items():
        for e in range(7):
            if e < 3:
                s = t if rng.random() < 0.9 else rng.randrange(1, 6)
            elif e < 5:
                s = max(1, t - 1) if rng.random() < 0.9 else rng.randrange(1, 6)  # strict
            else:
                s = rng.randrange(1, 6)  # careless
            rows.append(form(len(rows), q, f"ev{e}", float(s)))
    got = {(r.question_id, r.dimension): r.label for r in consensus.labels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 480
    assert sum(got[q, d] == t for q, t in truth.items() for d in consensus.DIMENSIONS) > 0.95 * 480
    few = consensus.fit(consensus.counting_scores(spark.createDataFrame(rows, SCHEMA)), shared=3)  # more evaluators than are shared: joins
    far = {(r.question_id, r.dimension): max(range(5), key=lambda k: r.q[k]) + 1 for r in few.items.collect()}
    assert sum(far[k] == v for k, v in got.items()) >= 478
    sure = {(r.evaluator, r.dimension): r for r in consensus.reliability(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sure["ev0", "option_quality"].accuracy > 0.8 > 0.45 > sure["ev6", "option_quality"].accuracy
    assert all(r.low < r.accuracy < r.high for r in sure.values())


def test_which_forms_count(spark):
    nan = None
    rows = [
        form(1, 1, "a", 2.0, 1), form(2, 1, " A ", 4.0, 2), form(2, 1, " A ", 4.0, 2), form(3, 1, "b", 4.0), form(4, 1, "c", 4.0), form(5, 1, "d", 3.5), form(6, 1, "e", 9.0), form(7, 1, None, 1.0), form(8, 1, " ", 1.0), form(9, None, "a", 1.0),
        form(10, 2, "a", (5.0, nan, 1.0, 0.0)), form(11, 2, "b", (5.0, 5.0, 1.0, 1.0)), form(12, 2, "c", (5.0, 5.0, 1.0, 1.0)),
        form(13, 3, "a", 5.0, None), form(14, 3, "a", 1.0, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    scores = {(r.question_id, r.evaluator, r.dimension): r.score for r in consensus.counting_scores(df).collect()}
    assert scores[1, "a", "option_quality"] == 4 and scores[3, "a", "option_quality"] == 1 and (1, "d", "option_quality") not in scores and (1, "e", "option_quality") not in scores
    got = {(r.question_id, r.dimension): r.label for r in consensus.labels(df).collect()}
    assert got == {**{(1, d): 4 for d in consensus.DIMENSIONS}, (2, "question_clarity"): 5, (2, "medical_accuracy"): 1}
    assert consensus.labels(df.limit(0)).count() == 0


def test_alpha(spark):
    agree = spark.createDataFrame([form(q * 2 + e, q, f"e{e}", float(1 + q % 5)) for q in range(10) for e in range(2)], SCHEMA)
    assert {r.alpha for r in consensus.agreement(agree).collect()} == {1.0}
    same = spark.createDataFrame([form(e, 1, f"e{e}", 3.0) for e in range(3)], SCHEMA)
    assert {r.alpha for r in consensus.agreement(same).collect()} == {None}
