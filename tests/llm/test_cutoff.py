from lumenspark.llm import cutoff

SENTENCES = ["The valve cannot close in this case.", "Order a scan before the dose is given.", "Symptoms such as flank pain appear later, because the duct stays blocked.", "Giving aspirin would worsen the condition of the patient.", "Key signs: a wide gait; flank pain; a dry cough"]


def test_cut_and_complete(spark):
    base = [(i, "A", f"s{i % 2}", f"{SENTENCES[i % 4]} {SENTENCES[(i + 1) % 4]}") for i in range(400)]
    base += [(400 + i, "B", "s0", f"{SENTENCES[i % 4]} {SENTENCES[4]}") for i in range(40)]
    cases = {
        "The valve cannot close in this": True, "Order a scan before the dose is": True, "Symptoms such as flank pain appear later, because the": True, "Symptoms such as flank pa": True, "Giving aspirin would worsen the condi…": True, "Order a scan before the...": True, "Giving aspirin would worsen,": True, "The valve (first": True, "The valve cannot clo�": True, "Order a scan before the.": True, "Symptoms such as.": True,
        "The valve cannot close in this case": False, "Giving aspirin would worsen the condition of the patient": False, "The valve cannot close in this case...": False, "Order a scan before the dose is given. Key signs: a wide gait; flank pain; a dry cough": False, "The valve cannot close in this case.": False,
    }
    rows = base + [(1000 + i, "C", None, t) for i, t in enumerate(cases)] + [(2000, "A", "s", None), (2001, "A", "s", "  "), (2002, "A", "s", SENTENCES[0] + " " + " ".join(SENTENCES[:4] * 500)), (1000, "C", None, next(iter(cases)))]
    df = spark.createDataFrame(rows, "question_id bigint, letter string, source string, text string")
    got = {r.question_id for r in cutoff.cut_texts(df).collect()}
    assert got == {1000 + i for i, cut in enumerate(cases.values()) if cut}
    report = {r.source: (r.n_texts, r.n_cut) for r in cutoff.cut_report(df).collect()}
    assert report[None] == (len(cases), sum(cases.values())) and report["s1"] == (200, 0)
    assert cutoff.cut_texts(df.limit(0)).count() == 0


def test_texts(spark):
    made = spark.createDataFrame([(1, {"A": "a", "B": None}, "s"), (2, None, "s")], "question_id bigint, explanations map<string,string>, source string")
    bank = spark.createDataFrame([(3, {"A": "x", "B": "y"}, "t"), (4, {"B": "y"}, "t")], "question_id bigint, explanations map<string,string>, source string")
    assert sorted(tuple(r) for r in cutoff.explanation_texts(made, bank).collect()) == [(1, "A", "s", "a"), (3, "A", "t", "x")]


def test_copies_of_a_cut_text_lend_no_evidence(spark):
    heads = ["First", "Then", "Later", "Often", "Here", "Usually", "Again", "Now", "Today", "Indeed", "Maybe", "Also"]
    base = [(i, "A", "s", f"{h} the valve cannot close in this case. {h} giving aspirin would worsen the condition of the patient.") for i, h in enumerate(heads)]
    cut = ["Here we see that the valve cannot close in this", "They agree that giving aspirin would worsen the condi"]
    whole = "They agree that the valve cannot close in this case"
    rows = base + [(1000 * k + i, "C", f"s{i % 3}", t) for k, t in enumerate(cut, 1) for i in range(20)] + [(3000 + i, "C", "s", whole) for i in range(20)]
    df = spark.createDataFrame(rows, "question_id bigint, letter string, source string, text string")
    assert {r.question_id for r in cutoff.cut_texts(df).collect()} == {1000 * k + i for k in (1, 2) for i in range(20)}
    assert sum(r.n_cut for r in cutoff.cut_report(df).collect()) == 40
