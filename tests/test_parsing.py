import pytest
from pyspark.sql import functions as F

from lumenspark.functions import parsing, records, text

M = "map<string,string>"


def one(spark, schema, row, expr):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("option,lab", [("10.2 g/dL", True), ("Hemoglobin: 10", True), ("Give 500 mg/dL of it slowly", False), ("Aspirin", False), (None, False), ("", False)])
def test_lab_datum(spark, option, lab):
    assert one(spark, "t string", (option,), parsing.is_lab_datum(F.col("t"))) is lab


@pytest.mark.parametrize("t,want", [("Stem\nTip: look at\nthe age\n\nA) x", "look at\nthe age"), ("TIP : one", "one"), ("no", None), (None, None)])
def test_tip(spark, t, want):
    assert one(spark, "t string", (t,), parsing.tip(F.col("t"))) == want


@pytest.mark.parametrize("t,n,want", [("1. Stem\nCorrect Answer: A", 2, True), ("and so on\nCorrect Answer: A", 2, False), ("1. Stem", 2, False), ("1. Stem Correct Answer: A", 1, False), (None, 2, False)])
def test_whole_page(spark, t, n, want):
    assert one(spark, f"t string, o {M}", (t, {chr(65 + i): "x" for i in range(n)}), parsing.whole_page(F.col("t"), F.col("o"))) is want


def test_numbered_parts(spark):
    aged = "[PAGE:1]\n1. A 29-year-old man has pain.\n12. A 7-year-old boy coughs. 3. Then\n"
    assert one(spark, "t string", (aged,), parsing.numbered_parts(F.col("t"))) == ["1. A 29-year-old man has pain.\n", "12. A 7-year-old boy coughs. 3. Then\n"]
    assert one(spark, "t string", ("2. Which drug?\n10. Next one",), parsing.numbered_parts(F.col("t"))) == ["2. Which drug?\n", "10. Next one"]
    assert one(spark, "t string", ("no numbers",), parsing.numbered_parts(F.col("t"))) == []


def test_explanation_map(spark):
    row = ("A： right because\nB：wrong here", {"A": "x", "B": "y", "C": "z"}, "A")
    got = one(spark, f"e string, o {M}, a string", row, parsing.explanation_map(*map(F.col, "eoa")))
    assert got == {"A": "right because", "B": "wrong here", "C": parsing.WRONG_TEXT}
    assert one(spark, f"e string, o {M}, a string", (None, {"A": "x", "B": "y"}, "A"), parsing.explanation_map(*map(F.col, "eoa"))) == {"A": parsing.RIGHT_TEXT, "B": parsing.WRONG_TEXT}


def test_option_explanations(spark):
    whole = "Because it fits.\n\nIncorrect Answers: B, C, D.\n\nChoice B. too late\n\nand too weak\n\nC) too soon"
    row = (whole, {k: "x" for k in "ABCD"}, "A")
    got = one(spark, f"e string, o {M}, a string", row, parsing.option_explanations(*map(F.col, "eoa")))
    assert got == {"A": "Because it fits.", "B": "too late and too weak", "C": "too soon", "D": parsing.NO_TEXT}
    assert one(spark, f"e string, o {M}, a string", (None, {"A": "x"}, "A"), parsing.option_explanations(*map(F.col, "eoa"))) == {"A": parsing.NO_TEXT}


def test_lab_lines(spark):
    t = "Sodium :140mmol/L, leukocytes: 10,000/mm3; potassium 4.1 mmol/L"
    assert one(spark, "t string", (t,), parsing.lab_lines(F.col("t"))) == "Sodium: 140 mmol/L\nleukocytes: 10,000/mm3\npotassium 4.1 mmol/L"


@pytest.mark.parametrize("a,b,alike", [("Why?", "why", True), ("What lowers the heart rate here", "So what lowers the heart rate here in him", True), ("alpha beta gamma", "delta epsilon zeta", False), ("", "x", False), (None, "x", False), ("what is the", "how are these", True), ("典型症状是哪些", "常见症状有吗", True), ("one two three four five", "one two three nine ten eleven", True)])
def test_questions_alike(spark, a, b, alike):
    assert one(spark, "a string, b string", (a, b), parsing.questions_alike(F.col("a"), F.col("b"))) is alike


@pytest.mark.parametrize("t,kind", [("Invalid API key", "key"), ("account is not active", "billing"), ("Error 429", "quota"), ("rate\nlimit", "rate"), ("Request timed out", "timeout"), ("refused", "connection"), ("bad JSON", "format"), ("context\nlength", "length"), ("x" * 90, "x" * 80 + "..."), (None, None)])
def test_error_kind(spark, t, kind):
    assert one(spark, "t string", (t,), records.error_kind(F.col("t"))) == kind


@pytest.mark.parametrize("t,cleaned", [("[PAGE:3] a  b\nc", "a b c"), ("Venous insufficiency, ______ ", "Venous insufficiency"), ("ends here \\\" ~ F' r ,\"", "ends here"), ("ends ~ r-- r", "ends"), ("ends r", "ends"), ("a Previous  Next x Pause b", "a  b"), ("", "")])
def test_clean_text(spark, t, cleaned):
    assert one(spark, "t string", (t,), text.clean_text(F.col("t"))) == cleaned


def test_scores_and_signs(spark):
    assert one(spark, "t string", ("clarity: 0 quality: 4",), records.first_score(F.col("t"), "clarity", "quality")) == 4.0
    assert one(spark, "t string", ("clarity: 3 quality: 4",), records.first_score(F.col("t"), "clarity", "quality")) == 3.0
    many = "💡💡 💡💡 💡💡 💡💡 words here that say it"
    assert one(spark, "t string", (many,), text.valid_clarification_text(F.col("t"))) is True
    assert one(spark, "t string", (many + " 💡💡" * 3,), text.valid_clarification_text(F.col("t"))) is False
