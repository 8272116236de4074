from lumenspark.llm import residue

CASES = [
    ("Dear {{name}}, your case is due.", True), ("Dear ${patient_name}, hello.", True), ("Start %(drug)s now.", True), ("Seen by [INSERT DOCTOR] today.", True), ("Give [your dose here] mg.", True), ("Dear __NAME__, hi.", True), ("Reviewed by <%= age %>.", True), ("Start <DRUG> at 5 mg.", True), ("In patients with {age}, wait.", True), ("Use $DOSE$ only.", True),
    ("A field such as {{name}} is filled by the server.", False), ("The set {A, B, D} is right.", False), ("A rise of [H+] by 4 nmol/L.", False), ("Values <4 mmol/L or >20 mmol/L need a call.", False), ("It costs $5 to $12 [see note 5].", False),
    ("Lorem ipsum dolor sit amet.", True), ("TODO add figure.", True), ("The heading now reads TODAY.", False), ("Todo paciente mejora.", False), ("Sample text.", True), ("Escriba aquí su texto.", True), ("xxxxx xxxxx", True), ("Text text text text.", True), ("Hay dolor abdominal.", False),
    ("404 Not Found", True), ("Please enable JavaScript to view this page.", True), ("The timer depends on JavaScript, so ask the desk.", False), ("Access denied.", True), ("The access denied by the artery was replaced.", False), ("If the quiz shows error 404, sign out.", False), ("请启用脚本后刷新页面。", True), ("Please try again later.", False), ("", False), (None, False),
    ("text, text, text", True), ("Bla, bla, bla.", True), ("Quis nunc sed vitae porta.", True), ("Dear {% patient_name %}, hello.", True), ("The access\ndenied page came up. Please enable\nJavaScript to view this page.", True), ("Oops! The key points are these.", False),
]


def test_documents(spark):
    rows = [(i, "Good text stands here.\n" + t if t else t, f"s{i}", 1) for i, (t, _) in enumerate(CASES)]
    rows += [(1000, "word " * 300_000 + "\n\n404 Not Found", None, 1), (1000, "404 Not Found", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, hash int")
    got = {r.doc_id for r in residue.residue_documents(df).collect()}
    assert got == {i for i, (_, bad) in enumerate(CASES) if bad} | {1000}
    assert residue.residue_documents(df.limit(0)).count() == 0


def test_beside_needs_several_sources(spark):
    one = [(1, "Please try again later.", "a"), (2, "Please try again later.", "a")]
    df = spark.createDataFrame(one, "doc_id bigint, text string, source string")
    assert residue.residue_documents(df).count() == 0
    two = df.union(spark.createDataFrame([(3, "Please try again later.", "b")], df.schema))
    assert {r.doc_id for r in residue.residue_documents(two).collect()} == {1, 2, 3}


def test_masks(spark):
    rows = [(1, "Error code 20: wait 7 seconds. See https://a.b/c on 2024-01-02", "a"), (2, "Error code 3: wait 99 seconds. See https://x.y/z on 2023-12-31", "b"), (3, "> Mail a.b@c.de\n> at 10:30 now", None)]
    found = residue.occurrences(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert {r.message for r in found if r.doc_id == 1} == {r.message for r in found if r.doc_id == 2} == {"Error code #: wait # seconds", "See # on #"}
    assert {r.message for r in found if r.doc_id == 3} == {"> Mail #", "> at # now", "> Mail # at # now"}


def test_kinds_and_recurrence(spark):
    rows = [(1, "Dear {{name}}, hi.", "a"), (2, "Service unavailable.\nOops!", "a"), (3, "Service unavailable.", "b"), (4, "Lorem ipsum dolor sit amet.", "a"), (5, "Oops!", "b"), (6, "Plain text.", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {tuple(r) for r in residue.residue_report(df).collect()} == {("placeholder", 1, 0), ("notice", 3, 3), ("filler", 1, 0)}
    assert {tuple(r) for r in residue.recurring_messages(df).collect()} >= {("Service unavailable", "notice", 2, 2), ("Oops", "notice", 2, 2)}
