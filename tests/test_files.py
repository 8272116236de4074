import json

from lumenspark.sources import files
from lumenspark.streaming.usage import stream_totals, stream_windows


def test_questions_and_reports(spark, tmp_path):
    q = {"question": "Wer heißt so?", "options": {"B": "zwei", "A": "eins"}, "correct_answer": "A", "page_number": 3}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/list.json").write_text(json.dumps([q, {**q, "question": "b"}]))
    (tmp_path / "in/wrapped.json").write_text(json.dumps({"statistics": {}, "questions": [q]}))
    got = files.read_questions(spark, str(tmp_path / "in"))
    assert sorted(r.question for r in got.collect()) == ["Wer heißt so?", "Wer heißt so?", "b"]
    files.write_report(got.filter("question <> 'b'").limit(1), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[:4] == ["Wer heißt so?", "A. eins", "B. zwei", "Answer: A"]


def test_logs_domains_and_failures(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/ann.json").write_text(json.dumps({"events": [{"event": "login", "timestamp": "t"}]}))
    (tmp_path / "logs/bad.json").write_text("{")
    assert [r.user_name for r in files.read_user_logs(spark, str(tmp_path / "logs")).collect()] == ["ann"]
    (tmp_path / "d.json").write_text(json.dumps({"domains": [{"name": "x"}]}))
    assert files.read_domains(spark, str(tmp_path / "d.json")).first().domains[0].name == "x"
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "bin/b.pdf").write_bytes(b"\xff")
    rows = files.read_binary(spark, str(tmp_path / "bin"), "*.pdf", lambda c: c.decode().split("\f")).collect()
    assert sorted((r.page, r.text) for r in rows if r.error is None) == [(1, "one"), (2, "two")] and sum(r.error is not None for r in rows) == 1


def test_image_pages(spark):
    df = spark.createDataFrame([("a/page_12_img_3.png",), ("a/p4_1.png",), ("x.png",)], "n string")
    assert [r[0] for r in df.select(files.image_page(df.n)).collect()] == [12, 4, None]


def test_usage_streams(spark, tmp_path):
    rows = [(1, i * 30_000_000, 0.25) for i in range(40)] + [(2, 5, 1.0), (9, 10**11, 0.0)]
    schema = "user_id bigint, us bigint, cost double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, 10**11 + 1, 0.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        query = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / name)).format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name).collect()

    totals = {r.user_id: (r.cost_total, r.request_count) for r in run(stream_totals(read()), "complete", "totals")}
    assert totals[1] == (10.0, 40) and totals[2] == (1.0, 1)
    windows = [r for r in run(stream_windows(read()), "append", "windows") if r.user_id == 1]
    assert max(r.cost for r in windows) == 1.5  # six charges in 180 seconds


def test_json_keeps_letters(spark, tmp_path):
    files.write_json(spark.createDataFrame([(1, "Größe 体")], "id int, t string"), str(tmp_path / "j"))
    assert [tuple(r) for r in spark.read.schema("id int, t string").json(str(tmp_path / "j")).collect()] == [(1, "Größe 体")]
    assert "Größe 体" in "".join(x.value for x in spark.read.text(str(tmp_path / "j")).collect())
