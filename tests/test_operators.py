"""Small cases of the bank, usage, retrieval and text operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspark.functions import records, text
from lumenspark.operators import bank, retrieval, usage


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


def test_text_validity(spark):
    good = "What does the scan show in this patient?"
    assert [one(spark, v, text.valid_question_text) for v in (good, "", None, "...", "h d f", "ab", "What are the key concepts?")] == [True, False, False, False, False, False, False]
    assert [one(spark, v, text.valid_text_field) for v in (good, "short", "a b c d e f", None)] == [True, False, False, False]
    assert [one(spark, v, text.valid_clarification_text) for v in ("The duct stays blocked because of the stone.", "abcdefghijklmnopqrstuvwxyz", "clarify clarify clarify it now for them please", None)] == [True, False, False, False]


def test_records(spark):
    assert one(spark, "A) first\nB. second\nA) third one\nC) ab\nAdministration of drugs", records.option_lines) == {"B": "second", "A": "third one"}
    assert [one(spark, v, lambda c: records.label_score(c, "Total:")) for v in ("x 3 Total: 4.5 of 5", "scored 2", "none", None)] == [4.5, 2.0, None, None]
    assert [one(spark, float(s), records.duration, "double") for s in (1.5, 125, 3725)] == ["1.5s", "2m 5.0s", "1h 2m"]
    assert [one(spark, v, records.safe_name) for v in (" user:a/b ", "", None, "x" * 80)] == ["a_b", "unknown", "unknown", "x" * 64]
    assert [one(spark, v, records.salvaged) for v in ('```json\n{"a": 1}\n```', 'so: {"a": {}} end', "none")] == ['{"a": 1}', '{"a": {}}', None]
    assert [one(spark, v, records.container) for v in ("[1]", '{"data": [1]}', '{"domains": []}', '{"x": 1}', "{")] == ["list", "data", "domains", "other", "invalid"]
    options = one(spark, "Aspirin 12% Heparin 70% Warfarin 12%", records.percent_options)
    assert [(o.option, o.pct) for o in options] == [("Aspirin", 12), ("Heparin", 70)]
    assert one(spark, "Aspirin 12% Heparin 70%", lambda c: records.argmax_letter(records.percent_options(c))) == "B"
    assert one(spark, "none", lambda c: records.argmax_letter(records.percent_options(c))) == "A"
    assert one(spark, "a  b\n\n\n\nc ____", records.question_lines) == "a b\n\nc"
    assert one(spark, "sodium 161 mmol/L; leukocyte count 14,496 per mm3", records.lab_values) == ["sodium 161 mmol/L", "leukocyte count 14,496 per mm3"]


def test_bank(spark):
    rows = spark.createDataFrame([("q", 1, 2), ("q", 2, 5), ("r", 3, 1), (None, 4, 1)], "k string, id int, n int")
    best = {r.k: r.id for r in bank.keep_best(rows, ["k"], [-F.col("n"), F.col("id")]).collect()}
    assert best == {"q": 2, "r": 3, None: 4}
    new = spark.createDataFrame([(1, 9), (77, 8)], "id int, n int")
    assert {r.id: r.n for r in bank.override(rows, new, "id", "n").collect()} == {1: 9, 2: 5, 3: 1, 4: 1}
    assert [tuple(r) for r in bank.orphans(rows, new, "id").collect()] == [(77, 8)]
    pages = spark.createDataFrame([("s", p) for p in range(7)], "source string, page int")
    got = sorted((r.batch, r.page) for r in bank.overlapping_batches(pages, 3, 2).collect())
    assert got == sorted((b, p) for b in range(4) for p in range(7) if max(0, 3 * b - 2) <= p < 3 * b + 5)
    many = spark.createDataFrame([("g", i) for i in range(500)] + [("h", 1)], "source string, id int")
    assert {r["source"]: r["count"] for r in bank.sample_per_group(many, "source", "id", 5).groupBy("source").count().collect()} == {"g": 5, "h": 1}


def test_usage_edges(spark):
    s = 1_000_000
    rows = [(1, 1, 0, 0.3), (2, 1, 180 * s, 0.3), (3, 1, 180 * s, 0.1), (4, 1, 359_999_999, 0.1), (5, 2, 5, None)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, us bigint, cost double")
    window = {r.event_id: r.window_cost for r in usage.rolling_cost(df).collect()}
    assert window == {1: 0.3, 2: 0.4, 3: 0.4, 4: 0.5, 5: None}  # a charge exactly 180 s old is out
    admitted = {r.event_id: r.admitted for r in usage.admission(df, 180, 0.3).collect()}
    assert admitted == {1: True, 2: True, 3: False, 4: False, 5: True}  # a refusal adds nothing
    now = spark.createDataFrame([(360 * s - 1,)], "now_us bigint")
    wait = {r.user_id: r.retry_s for r in usage.retry_after(df, now, 180, 0.15).collect()}
    assert wait == {1: 0}
    assert usage.admission(df.limit(0), 180, 1.0).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 16)).astype(np.float32)
    m[7] = 0
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(m)], "vec_id bigint, embedding array<float>, label int")
    q = m[0].tolist()
    n = np.linalg.norm(m, axis=1)
    s = (m @ m[0]) / np.where(n > 0, n, 1) / n[0]
    assert [r.vec_id for r in retrieval.top_k(df, q, 5).collect()] == np.argsort(-s)[:5].tolist()
    per = {(r.label, r["rank"]): r.vec_id for r in retrieval.top_k_per_group(df, q, "label", 2).collect()}
    assert all(per[g, 1] == max(range(g, 300, 3), key=lambda i: s[i]) for g in range(3))
    u = m / np.where(n > 0, n, 1)[:, None]
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if u[a].astype(float) @ u[b].astype(float) >= 0.5}
    assert {(r.a, r.b) for r in retrieval.pairs_above(df, 0.5).collect()} == want
    assert retrieval.two_stage(df, q, 10, 3).first().vec_id == 0
    assert one(spark, [0.0, 0.0], retrieval.l2_normalised, "array<float>") == [0.0, 0.0]


def test_chunks_and_index(spark, tmp_path):
    long = "\n\n".join("Sentence number %d stands here. " % i * 9 for i in range(60))
    df = spark.createDataFrame([(1, long), (2, ""), (3, None), (4, "x" * 2500), (5, "short")], "doc_id bigint, text string")
    rows = retrieval.recursive_chunks(df, 1000, 100).collect()
    assert all(0 < len(r.chunk) <= 1000 for r in rows) and {r.doc_id for r in rows} == {1, 4, 5}
    fixed = retrieval.fixed_chunks(df, 1000, 100).filter("doc_id = 4").orderBy("chunk_no").collect()
    assert [len(r.chunk) for r in fixed] == [1000, 1000, 700]
    retrieval.build_index(retrieval.fixed_chunks(df), retrieval.hashed_encoder, str(tmp_path / "index"))
    assert retrieval.load_index(spark, str(tmp_path / "index")).filter("size(embedding) = 64").count() == retrieval.fixed_chunks(df).count()


@pytest.mark.parametrize("query,first", [("carotid bruit", 2), ("scan", 1)])
def test_keywords(spark, query, first):
    df = spark.createDataFrame([(1, "a scan of the neck"), (2, "Carotid bruit, no SCAN"), (3, None), (4, "")], "doc_id bigint, text string")
    assert retrieval.keyword_search(df, query).first().doc_id == first


def test_index_versions_and_rerank(spark, tmp_path):
    path = str(tmp_path / "index")
    one = spark.createDataFrame([(1, 0, "alpha beta")], "doc_id bigint, chunk_no int, chunk string")
    two = one.union(spark.createDataFrame([(2, 0, "gamma")], one.schema))
    assert retrieval.load_or_build(one, retrieval.hashed_encoder, path).count() == 1
    assert retrieval.load_or_build(two, retrieval.hashed_encoder, path).count() == 1  # there is one already
    retrieval.build_index(two, retrieval.hashed_encoder, path)
    assert retrieval.load_index(spark, path).count() == 2
    # A build that fails leaves the index as it was.
    def broken(texts):
        raise ValueError("no model")

    try:
        retrieval.build_index(one, broken, path)
    except Exception:  # noqa: BLE001
        pass
    assert retrieval.load_index(spark, path).count() == 2
    rows = spark.createDataFrame([(1, "a", 0.9), (2, "bbb", 0.5), (3, None, 0.7)], "vec_id bigint, chunk string, score double")
    assert [r.vec_id for r in retrieval.reranked(rows, lambda ts: [len(t) for t in ts], 2).collect()] == [2, 1]
    assert [r.vec_id for r in retrieval.reranked(rows, None, 2).collect()] == [1, 3]
    assert [r.vec_id for r in retrieval.reranked(rows, broken, 2).collect()] == [1, 3]


def test_rolling_windows_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(i, 1 if rng.random() < 0.7 else 2, rng.randrange(0, 1_000_000_000), rng.random()) for i in range(300)] + [(300, 3, 0, 1.0), (301, 3, 180_000_000, 1.0), (302, 3, 359_999_999, 1.0), (303, 3, -5, 1.0)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, us bigint, cost double")
    got = {r.event_id: r.window_cost for r in usage.rolling_cost(df).collect()}
    assert len(got) == len(rows)
    for i, u, t, _ in rows:
        assert abs(got[i] - sum(c for _, v, s, c in rows if v == u and t - 180_000_000 < s <= t)) < 1e-5
    now = 1_000_000_000
    waits = {r.user_id: (r.window_cost, r.retry_s) for r in usage.retry_after(df, spark.createDataFrame([(now,)], "now_us bigint"), 600, 20.0).collect()}
    for u in (1, 2):
        mine = sorted((t, c) for _, v, t, c in rows if v == u and t > now - 600_000_000)
        total = sum(c for _, c in mine)
        wait = next(max(0, (t + 600_000_000 - now) // 1_000_000) for t, _ in mine if sum(c for s, c in mine if s > t) < 20.0) if total >= 20 else 0
        assert abs(waits[u][0] - total) < 1e-5 and waits[u][1] == wait
