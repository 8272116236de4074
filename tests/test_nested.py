import json

import pytest

from lumenspark.operators import nested

SCHEMA = "file_id bigint, file_name string, campus string, domains array<struct<name:string,level:string,topics:array<struct<name:string,subtopics:array<string>>>>>, raw_json string, note string"


def rows(spark, *files):
    return spark.createDataFrame([(i, f"f{i}", "c", d, r, "x") for i, d, r in files], SCHEMA)


def leaves(df):
    return sorted(map(tuple, nested.leaves(nested.tagged_rows(df)).collect()))


def test_shapes_of_json(spark):
    tree = [{"name": "a", "topics": {"name": "t", "subtopics": "s"}}, None, {"name": " ", "topics": []}, {"name": "b"}]
    for root in (tree, {"domains": tree}, {"data": tree, "extra": 1}):
        assert leaves(rows(spark, (1, None, json.dumps(root)))) == [(1, 1, 1, 1), (1, 4, 0, 0)]
    single = {"name": "a", "topics": [{"name": "t", "subtopics": [{"name": "s", "hours": 2}, {"hours": 3}, None, "", "z"]}]}
    assert leaves(rows(spark, (1, None, json.dumps(single)))) == [(1, 1, 1, 1), (1, 1, 1, 5)]


@pytest.mark.parametrize("text", ["", "{", "Here: {}", '{"domains": [', "null", "3", '"x"', "[[]]", '{"domains": null}'])
def test_no_domains(spark, text):
    assert leaves(rows(spark, (1, None, text))) == []


def test_missing_parts_repeated_rows_and_empty(spark):
    domains = [("d", None, [("t", None), (None, ["x"]), ("u", ["", "y"])]), (None, "l", [("t", ["s"])]), ("e", None, None)]
    df = rows(spark, (1, domains, None), (1, domains, None), (2, None, None), (None, [("z", None, [])], None))
    assert leaves(df.filter("file_id is not null")) == [(1, 1, 1, 0), (1, 1, 3, 2), (1, 3, 0, 0)]
    assert leaves(df.filter("file_id is null")) == [(None, 1, 0, 0)]
    assert leaves(df.limit(0)) == []


def test_parents_and_tables(spark, tmp_path):
    df = rows(spark, (1, [("d", "L", [("t", ["s"])])], None))
    tagged = nested.tagged_rows(df)
    nested.write_tables(tagged, str(tmp_path / "t"))
    sub = nested.read_table(spark, str(tmp_path / "t"), "subtopic").first()
    assert (sub.key, sub.parent_key, sub.name) == ("1/1/1/1", "1/1/1", "s")
    keys = {r.key for r in tagged.collect()}
    assert all(r.parent_key in keys for r in tagged.collect() if r.parent_key)


def test_long_and_deep_text(spark):
    big = json.dumps([{"name": "d", "topics": [{"name": "t", "subtopics": ["s"] * 30_000}]}])
    assert len(leaves(rows(spark, (1, None, big)))) == 30_000
    assert leaves(rows(spark, (1, None, "[" * 100_000))) == []


def test_flattened_and_counted_read_both_columns(spark):
    raw = '{"data": [{"name": "D", "topics": {"name": "T", "subtopics": [{"name": "S", "hours": 1}, "U"]}}, {"name": "E", "topics": [{"name": "V"}, {"name": null}, 3]}, 4]}'
    kept = [{"name": "F", "level": None, "topics": [{"name": "W", "subtopics": ["S", None]}, {"name": "X", "subtopics": []}]}, {"name": "G", "level": None, "topics": None}]
    schema = "file_id bigint, domains array<struct<name string, level string, topics array<struct<name string, subtopics array<string>>>>>, raw_json string"
    df = spark.createDataFrame([(1, None, raw), (2, kept, None), (1, None, raw), (3, None, "{"), (4, None, None)], schema)
    got = sorted(map(tuple, nested.flattened(df).collect()))
    assert got == [(1, "D", "T", "S"), (1, "D", "T", "U"), (1, "E", "V", "V"), (2, "F", "W", "S"), (2, "F", "W", "W"), (2, "F", "X", "X")]
    assert tuple(nested.counted(df).first()) == (4, 4, 2)
