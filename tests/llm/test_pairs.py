import pytest

from lumenspark.llm import pairs

Q = "What would happen if we gave him aspirin before the scan?"
CASES = [
    (None, "x", None), ("  ", "", None), (Q, None, "empty"), (Q, " \n", "empty"), (Q, "<p>&nbsp;</p>", "empty"), (Q, "[no response]", "empty"), (Q, "...", "empty"),
    (Q, "B", None), (Q, "Yes.", None), (Q, "Option C.", None), (Q, "Option C", None),
    (Q, Q, "copy"), (Q, Q.upper(), "copy"), (Q, f"You asked: {Q}", "copy"), (Q, f"{Q}\n{Q}", "copy"), (Q, Q.replace("aspirin", "asprin"), "copy"), (Q, Q[:-1], "copy"),
    (Q, f"You asked: {Q} Bleeding becomes more likely, because platelets are blocked. Wait for the result of the scan first.", None),
    (Q, "I'm sorry, but I can't help with that. Please ask a licensed clinician.", "refusal"), (Q, "Lo siento, no puedo ayudar con eso.", "refusal"), (Q, "抱歉，我无法回答这个问题。", "refusal"),
    (Q, "I am sorry this has been confusing. Aspirin blocks platelets.", None), (Q, "I cannot rule out stroke without a scan, so order it first.", None), (Q, "Unfortunately, aspirin is unable to reach the ward before noon, so the scan comes first.", None),
    (Q, "Aspirin blocks platelets. The risk of bl", "truncated"), (Q, "Aspirin blocks platelets,", "truncated"), (Q, "Steps:\n- scan\n- aspirin", None), (Q, "Steps:\n- scan\n-", "truncated"), (Q, "Steps:\n1. scan\n2. aspirin and", "truncated"),
    (Q, "Aspirin 300 mg twice daily", None), (Q, "The usual dose is e.g.", "truncated"), (Q, "The dose depends on the patient vs.", "truncated"), (Q, "Yes, it is", None), (Q, "Wait for it. Then the", "truncated"), (Q, "It blocks platelets in the", "truncated"), (Q, "1. Scan\n2. Give (first", "truncated"), (Q, "# Aspirin\nIt blocks platelets.", None), (Q, "| a | b |\n| 1 | 2 |", None), (Q, "He asked \"why?\" and left.", None),
    (Q, "Use this:\n```\ndose = 1\n", "truncated"), (Q, "Use this:\n```\ndose = 1\n```", None), (Q, "He said \"wait for it.", "truncated"), (Q, "The drug (first line.", "truncated"), (Q, "Bleeding is likely �", "truncated"),
    (Q, "Antes de la ecografía hay que revisar las alergias y la función del riñón.", "language"), (Q + " Please answer in Spanish.", "Antes de la ecografía hay que revisar las alergias y la función del riñón.", None),
    ("这道题为什么不选超声检查？", "对于肺栓塞，通常在2小时内安排血培养。", None), ("这道题为什么不选超声检查？", "Because the scan comes after the blood test and before the dose.", "language"), ("这道题为什么不选超声检查？", "对于肺栓塞，通常在", "truncated"),
]


@pytest.mark.parametrize("user,answer,kind", CASES)
def test_defects(user, answer, kind):
    assert pairs.defect(user, answer) == kind


def test_tiles_cover_once():
    a, t = "a b c d a b".split(), "x a b c d".split()
    assert pairs.tiles(a, t) == [(0, 1, 4)]  # a token of the text serves once
    assert sorted(pairs.tiles(a, t * 2)) == [(0, 1, 4), (4, 6, 2)]


def test_conversations(spark):
    schema = "conv_id bigint, messages array<struct<user:string,assistant:string,role:string,content:string>>, defect int"
    m = lambda u=None, a=None, r=None, c=None: (u, a, r, c)
    rows = [
        (1, [m(Q, "Yes."), m(Q, None), m(None, "")], 0),
        (1, [m(Q, "Yes."), m(Q, None)], 0),
        (2, [m(r="user", c=Q), m(r="user", c=Q), m(r="assistant", c=""), None, m(r="assistant", c="odd"), m(r="user", c=Q)], 0),
        (3, None, 0), (4, [], 0), (5, [m(Q, "word " * 200_000 + "and")], 0),
    ]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, pairs.defective_pairs(df).collect())) == [(1, 2, "empty"), (2, 1, "empty"), (5, 1, "truncated")]
    assert pairs.defective_pairs(df.limit(0)).count() == 0
