import random

from pyspark.sql import functions as F

from lumenspark.operators import sessions
from lumenspark.streaming.sessions import stream_sessions

SCHEMA = "user_name string, events array<struct<event:string,timestamp:string,profile:string>>, button_clicks array<struct<timestamp:string,button:string,question_id:bigint>>, extra int"


def found(df):
    return sorted(map(tuple, df.drop("duration_ms").collect()), key=str)


def test_time_forms(spark):
    good = {"2025-01-02T03:04:05Z": 1735787045000000, " 2025-01-02 03:04:05.5 ": 1735787045500000, "2025-01-02T03:04:05.123456-05:00": 1735805045123456, "2025-01-02T03:04:05+0130": 1735781645000000, "2025-01-02t03:04:05,25z": 1735787045250000, "2025-01-02T03:04": 1735787040000000, "2025-01-02T03:04:05+02": 1735779845000000}
    bad = ["", "T", "10:42", "2025-01-02", "0000-00-00 00:00:00", "2025-02-30T00:00:00Z", "2025-01-02T25:00:00Z", "n/a", None, "2025-01-02T03:04:05Zx"]
    rows = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    got = {r.t: r.us for r in rows.select("t", sessions.iso_micros(F.col("t")).alias("us")).collect()}
    assert {t: got[t] for t in good} == good
    assert all(got[t] is None for t in bad)


def test_gap_duplicates_and_lists(spark):
    t = lambda m, s=0, z="Z": f"2025-01-01T10:{m:02d}:{s:02d}.000{z}"
    rows = [
        ("u", [("login", t(0), None), ("login", "2025-01-01 10:00:00", "p"), None, ("logout", "bad", None)], [(t(15), "next", 1), (t(15), "next", 1), (t(15), "next", None)], 1),
        ("u", None, [("2025-01-01T10:30:00.001Z", "next", 1)], 1),
        (None, [("login", t(0), None)], None, 1),
        ("", [("login", t(0), None)], [], 1),
        ("v", None, None, 1),
    ]
    got = found(sessions.user_sessions(spark.createDataFrame(rows, SCHEMA)))
    base = 1735725600000
    assert got == [("", base, base, 1), ("u", base, base + 900_000, 3), ("u", base + 1_800_001, base + 1_800_001, 1)]
    assert found(sessions.user_sessions(spark.createDataFrame(rows, SCHEMA).limit(0))) == []


def brute(entries, gap):
    out, by = [], {}
    for u, us, *rest in set(entries):
        by.setdefault(u, []).append(us)
    for u, ts in by.items():
        ts.sort()
        start, n = ts[0], 0
        for a, b in zip(ts, [*ts[1:], None]):
            n += 1
            if b is None or b - a > gap:
                out.append((u, start // 1000, a // 1000, n))
                start, n = b, 0
    return sorted(out, key=str)


def test_against_brute_force_over_hours(spark):
    rng = random.Random(3)
    entries = [(rng.choice("ab"), rng.randrange(0, 40 * 3_600_000_000, 250_000_000), "event", rng.choice("xy"), None) for _ in range(3000)]
    entries += entries[:200]  # delivered again
    df = spark.createDataFrame(entries, "user_name string, us bigint, list string, name string, question_id bigint").repartition(5)
    for gap in (100_000, 900_000, 5_000_000):
        assert found(sessions.sessionize(df, gap)) == brute(entries, gap * 1000)


def test_long_session_crosses_many_hours(spark):
    entries = [("k", i * 600_000_000, "event", "x", None) for i in range(600)]
    df = spark.createDataFrame(entries, "user_name string, us bigint, list string, name string, question_id bigint")
    assert found(sessions.sessionize(df)) == [("k", 0, 599 * 600_000, 600)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    entries = sorted({("u%d" % rng.randrange(3), rng.randrange(1, 20 * 3_600_000_000, 300_000_000), "event", "x", None) for _ in range(400)}, key=lambda e: e[1])
    last = ("clock", 60 * 3_600_000_000, "event", "x", None)  # moves the watermark past all others
    schema = "user_name string, us bigint, list string, name string, question_id bigint"
    for i, part in enumerate((entries[:200], entries[200:], [last], [(*last[:1], last[1] + 1, *last[2:])])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_sessions(stream, lateness="30 hours").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("streamed").filter("user_name <> 'clock'").collect()), key=str)
    assert got == brute(entries, 900_000_000)
