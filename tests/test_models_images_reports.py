import json

from pyspark.sql import functions as F

from lumenspark.operators import images, models, reports
from lumenspark.streaming import state


def test_models(spark):
    rows = spark.createDataFrame([(1, "heart"), (2, None), (3, "bad")], "id bigint, topic string").withColumn("prompt", models.rendered("About $TOPIC$ for $N$", topic=F.col("topic"), n=F.lit(2)))
    assert [r.prompt for r in rows.orderBy("id").collect()] == ["About heart for 2", "About  for 2", "About bad for 2"]

    def reply(p, n):
        if "bad" in p:
            return "no json"
        return "```json\n" + json.dumps({"questions": [{"question": p, "options": {"A": "x"}, "correct_answer": "A"}, {"question": "two"}]}) + "\n```"

    got = models.questions(rows, "prompt", models.fake_model(reply)).orderBy("id", "question").collect()
    assert [(r.id, r.question) for r in got] == [(1, "About heart for 2"), (1, "two"), (2, "About  for 2"), (2, "two"), (3, None)]
    assert models.questions(rows, "prompt", lambda ps: [json.dumps([{"question": "q"}])] * len(ps)).filter("question = 'q'").count() == 3
    scores = models.judged(rows, "prompt", models.fake_model(lambda p, n: "clarity: 4 quality: 3.5"), ("clarity", "quality", "tone")).first()
    assert (scores.clarity, scores.quality, scores.tone) == (4.0, 3.5, None)
    calls = spark.sparkContext.accumulator(0)

    def failing(ps):
        calls.add(1)
        raise RuntimeError("down")

    broken = models.replied(rows.coalesce(1), "prompt", failing).collect()
    assert {r.error for r in broken} == {"down"} and all(r.reply is None for r in broken) and calls.value == 2
    assert models.classified(rows, "prompt", lambda ps: ['say {"level": "close", "done": false}'] * len(ps), "level string, done boolean").first().level == "close"
    parts = models.steps(rows.limit(1), "prompt", lambda ps: ['[{"question": "a"}, {"question": "b"}]'] * len(ps)).collect()
    assert [(r.place, r.question) for r in parts] == [(0, "a"), (1, "b")]
    assert models.replied(rows.limit(0), "prompt", failing).count() == 0


def test_images(spark):
    spans = spark.createDataFrame([("f", 1, "Chapter head", 10.0, 5.0, 90.0, 15.0), ("f", 1, "Which drug?", 10.0, 400.0, 90.0, 410.0), ("f", 1, " ", 0.0, 0.0, 999.0, 999.0)], "source string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in images.content_box(spans).collect()] == [("f", 1, 10.0, 5.0, 90.0, 410.0)]
    im = spark.createDataFrame([("f", 1, "head", 0.0, 0.0, 100.0, 20.0, 200, 200, 800.0), ("f", 1, "body", 0.0, 380.0, 100.0, 480.0, 200, 200, 800.0), ("f", 1, "tiny", 0.0, 380.0, 100.0, 480.0, 20, 20, 800.0), ("f", 2, "foot", 0.0, 780.0, 100.0, 799.0, 200, 200, 800.0)], "source string, page int, image string, x0 double, y0 double, x1 double, y1 double, width int, height int, page_height double")
    near = {r.image: r.near for r in images.near_spans(im, spans).collect()}
    assert near["head"] == "Chapter head" and near["body"] == "Which drug?" and near["foot"] == ""
    assert {r.image for r in images.kept_images(im, spans, "(?i)chapter", r"\?").collect()} == {"body", "foot"}
    q = spark.createDataFrame([(1, 3), (2, 4), (3, 9), (4, None)], "question_id bigint, page_number int")
    f = spark.createDataFrame([("page_3_img_1.png",), ("p3_1.png",), ("p4_1.png",), ("x.png",)], "image string")
    assert {r.question_id: r.images for r in images.images_of_questions(q, f).collect()} == {1: ["page_3_img_1.png"], 2: ["p4_1.png"], 3: [], 4: []}


def test_reports(spark):
    s = spark.createDataFrame([("u", "d1", "t", "a", "known", 3, 1, 1), ("u", "d1", "t", "b", "unknown", 9, 0, 2), ("u", "d2", "t", "a", "known", 5, 2, 2)], "user string, domain string, topic string, subtopic string, status string, updated int, correct int, attempted int")
    assert reports.mastery_report(s).first().report == "2 of 3 known (67%)\nd1: 1 of 2 known (50%, weak)\nd2: 1 of 1 known (100%, good)"
    assert reports.tracking_report(s, 2).first().report == "d1->t->b: unknown, 0 of 2\nd2->t->a: known, 2 of 2"
    keys = spark.createDataFrame([(" a ", "s", "1"), (" ", "s", "1"), (None, None, "1"), (None, "", None)], "l string, s string, a string").select(reports.user_key(*map(F.col, "lsa")).alias("k"))
    assert [r.k for r in keys.collect()] == ["user:a", "sess:s", "ip:1", "ip:unknown"]
    many = spark.range(2000).select(reports.simulated_answer(F.col("id"), F.expr("map('A','x','B','y','C','z')"), F.lit("B"), 0.7).alias("a")).groupBy("a").count().collect()
    by = {r.a: r["count"] for r in many}
    assert 1300 < by["B"] < 1500 and set(by) == {"A", "B", "C"}
    sessions = spark.createDataFrame([("u", 61_500), ("u", 1_000)], "user_name string, duration_ms bigint")
    view = reports.user_log_view(sessions, spark.createDataFrame([("u", 3), ("v", 1)], "user_name string, turns bigint"), spark.createDataFrame([("v", 0.5, 2)], "user_name string, cost_total double, request_count bigint"))
    assert {tuple(r) for r in view.collect()} == {("u", 62, 1.03, 3, 0.0, 0), ("v", 0, 0.0, 1, 0.5, 2)}
    names = spark.createDataFrame([("Questions 1",), ("Questions and Answers",), ("Amboss Questions",)], "n string")
    assert [r.k for r in names.select(reports.bank_folder(F.col("n")).alias("k")).collect()] == [False, True, True]


def test_streamed_admission_equals_batch(spark, tmp_path):
    import random

    from lumenspark.operators import usage

    rng = random.Random(2)
    rows = [(i, rng.randrange(3), 1_000_000_000 + i * 7_000_000, 0.1 + rng.random() / 5) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, us bigint, cost double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.stream_admission(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 180, 0.5)
    q = stream.writeStream.format("memory").queryName("admitted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in usage.admission(df, 180, 0.5).collect()}
    assert {tuple(r) for r in spark.table("admitted").collect()} == want
