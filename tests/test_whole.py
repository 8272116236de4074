"""Queries over small tables of their own: nothing of the input is left out."""

import datetime

import __spark_entry__ as entry

TURNS = "conv_id bigint, messages array<struct<user string, assistant string, role string, content string>>, saved_at timestamp"


def rows(spark, path, name, **tables):
    for table, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{table}.parquet")
    return sorted(map(tuple, entry.queries()[name](spark, str(path)).collect()))


def conversations():
    at = datetime.datetime(2024, 1, 1)
    said = lambda t: (t, "ok", None, None)
    role = lambda r, t: (None, None, r, t)
    old = [x for i in range(5) for x in (role("user", f"older question number{i} word{i}"), role("assistant", f"answer{i}"))]
    return [(1, old, at), (2, [said("green apple tree"), said("green apple tree"), (None, "ok", None, None)], at), (3, [role("assistant", "hello")], at)], TURNS


def test_novel_turns_of_both_shapes(spark, tmp_path):
    # Any two of the older turns share two of six words.
    assert rows(spark, tmp_path, "novel_turns", tutor_conversations=conversations()) == [(1, 5, 1), (2, 2, 1)]


def test_last_turns_of_both_shapes(spark, tmp_path):
    got = rows(spark, tmp_path, "last_k_turns", tutor_conversations=conversations())
    assert [r for r in got if r[0] == 1] == [(1, k, f"older question number{5 - k} word{5 - k}") for k in (1, 2, 3, 4)]
    assert [r for r in got if r[0] != 1] == [(2, 1, None), (2, 2, "green apple tree"), (2, 3, "green apple tree")]


def test_nearest_page_against_all_pages(spark, tmp_path):
    pages, asked = [3, 38, 45, 79, 200, 200, None], [1, 3, 4, 40, 41, 42, 62, 139, 140, 500, -7, None]
    got = rows(spark, tmp_path, "nearest_page", documents=([(p,) for p in pages], "page int"), qbank_amboss_openai_evaluated=(list(enumerate(asked)), "question_id bigint, page_number int"))
    assert got == [(i, min((p for p in pages if p), key=lambda p: (abs(p - a), p))) for i, a in enumerate(asked) if a is not None]


def test_error_category_of_the_whole_text(spark, tmp_path):
    texts = ["Note\n\nThe request timed out.", "Timeout", "The rate is high.\nSee the limit.", "A limit\nof the rate", "Note\n" + "x" * 5000 + "\ncould not parse it", "Note\nof a ward", "y" * 81, None]
    got = {k: n for k, n in entry_rows(spark, tmp_path, texts)}
    assert got == {"timeout": 2, "rate": 2, "format": 1, "Note\nof a ward": 1, "y" * 80 + "...": 1, None: 1}


def entry_rows(spark, path, texts):
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{path}/documents.parquet")
    return entry.queries()["error_category"](spark, str(path)).collect()
