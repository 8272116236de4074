import random

from lumenspark.llm import leaks


def test_against_brute_force_and_edges(spark):
    rng = random.Random(1)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["12", "7", "mg", "Zelan"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(30), text(25) if i % 3 else None, 0) for i in range(20)] + [(20, None, "", 0), (21, "too short for a window", None, 0)]
    docs = []
    for d in range(120):
        i = rng.randrange(20)
        n = rng.choice([8, 11, 12, 13, 20])
        ws = items[i][1].split()
        at = rng.randrange(len(ws) - n + 1)
        docs.append((d, f"{text(40)} {', '.join(ws[at:at + n]).upper()} -- {text(40)}" if d % 2 else text(80), "x"))
    docs += [(200, None, "x"), (201, "", "x"), (202, text(60_000) + " " + items[0][1], "x"), (202, items[0][1], "x")]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string, question string"), spark.createDataFrame(items, "item_id bigint, question string, rationale string, text int")
    windows = {}
    for i, q, r, _ in items:
        for part in (q, r):
            ws = leaks.words(part or "")
            for k in range(len(ws) - 11):
                windows.setdefault(tuple(ws[k : k + 12]), set()).add(i)
    true = {(d, i) for d, t, _ in docs for ws in [leaks.words(t or "")] for k in range(len(ws) - 11) for i in windows.get(tuple(ws[k : k + 12]), ())}
    assert set(map(tuple, leaks.leaked(df, it).collect())) == true
    # Beyond what is handed to every task the rows are the same.
    assert set(map(tuple, leaks.leaked(df, it, windows=0).collect())) == true == set(map(tuple, leaks.leaked(df, it, most_words=0).collect()))
    assert leaks.leaked(df.limit(0), it).count() == 0 == leaks.leaked(df, it.limit(0)).count()


def test_other_values(spark):
    item = "On day 8 the patient from Zelanmere received aspirin 370 mg and later walked 20 meters without any pain at all"
    other = item.replace("8", "3").replace("370", "90").replace("Zelanmere", "Brooktown").replace("20", "55")
    mixed = "On day 8 " + other
    df = spark.createDataFrame([(1, other), (2, item), (3, "nothing of that kind is written in this text although it is long enough")], "doc_id bigint, text string")
    it = spark.createDataFrame([(1, item, None)], "item_id bigint, question string, rationale string")
    got = leaks.reparameterised(df, it).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)] and got[0].n_changed == 4
    assert [tuple(r) for r in leaks.leaked(df, it).collect()] == [(2, 1)]
    assert mixed


def test_each_occurrence_is_judged_by_itself(spark):
    item = "On day 8 the patient from Zelanmere received aspirin 8 mg and later walked 20 meters without any pain at all while Zelanmere kept a record of it"
    one = item.replace("Zelanmere", "Brooktown").replace("day 8", "day 3").replace("aspirin 8", "aspirin 90")
    two = item.replace("Zelanmere", "Quillport").replace("20", "55")
    torn = item.replace("Zelanmere", "Brooktown", 1).replace("Zelanmere", "Quillport")
    docs = [(1, one), (2, f"{one}. Then {two}"), (3, torn), (4, f"{torn}. Then {two}"), (5, item)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame([(1, item, None)], "item_id bigint, question string, rationale string")
    got = {r.doc_id: r.n_changed for r in leaks.reparameterised(df, it).collect()}
    assert got == {1: 4, 2: 5, 4: 3}


def test_frames_shared_by_items_go_to_the_nearest(spark):
    frame = "A {} from {} walks 12 meters with {} and asks whether {} 40 mg should be taken before the next visit to the clinic"
    items = [(1, frame.format("baker", "Zelanmere", "fever", "aspirin"), None), (2, frame.format("tailor", "Brooktown", "nausea", "aspirin"), None)]
    docs = [(1, items[0][1].replace("12", "55").replace("Zelanmere", "Quillport")), (2, frame.format("farmer", "Quillport", "thirst", "metoprolol")[:60])]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, question string, rationale string")
    assert [(r.doc_id, r.item_id) for r in leaks.reparameterised(df, it).collect()] == [(1, 1)]


def test_slots_do_not_depend_on_what_is_shared(spark):
    item = "On day 8 the patient from Zelanmere received aspirin 370 mg and later walked 20 meters without any pain at all"
    # meters and clinic are rare words of the items, Zelanmere and Brooktown names, tailor a word of the documents only.
    items = [(1, item, None), (2, "The patient walked to the clinic and the patient from Brooktown without any pain asked for 40 mg on the next day", "the patient the patient"), (3, None, "")]
    other = item.replace("8", "3").replace("370", "90").replace("Zelanmere", "tailor").replace("20", "55")
    docs = [(1, other), (2, item), (3, f"{other}. {items[1][1].replace('Brooktown', 'Quillport')}"), (4, item.replace("meters", "miles").replace("walked", "ran")), (5, None), (6, ""), (7, other)]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, question string, rationale string")
    rows = lambda found: sorted(map(tuple, found.collect()))
    want, pairs = rows(leaks.shared_windows(df, it)), rows(leaks.reparameterised(df, it))
    assert [r[:2] for r in pairs] == [(1, 1), (3, 1), (3, 2), (7, 1)]
    for limits in ({"most_words": 0}, {"most_words": 4}, {"most_words": 12}, {"windows": 0}, {"windows": 0, "most_words": 4}):
        assert rows(leaks.shared_windows(df, it, **limits)) == want
        assert rows(leaks.reparameterised(df, it, **limits)) == pairs
