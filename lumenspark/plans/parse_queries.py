"""Queries over texts of question files and over turns of conversations held against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions import parsing, text
from lumenspark.operators import bank
from lumenspark.plans.activity_queries import TURNS_DUCK
from lumenspark.plans.registry import Registry
from lumenspark.sources.tables import table

registry = Registry()
_BANK = "qbank_amboss_openai_evaluated"


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _BANK)


def _entries(name: str) -> str:
    return f"(SELECT question_id, e.key AS letter, e.value AS text FROM (SELECT question_id, unnest(map_entries({name})) AS e FROM {_BANK}))"


_UNITS = parsing.LAB_UNITS.replace("'", "''")


@registry.add("lab_datum_options", f"SELECT question_id, letter, coalesce((regexp_matches(text, '(?i)[0-9]+\\.?[0-9]*\\s*{_UNITS}') AND length(trim(text)) < 15) OR (contains(text, ':') AND regexp_matches(text, '[A-Za-z]+\\s*:\\s*[0-9]+') AND length(trim(text)) < 20), false) AS lab FROM {_entries('options')}")
def lab_datum_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _bank(spark, sf_dir).select("question_id", F.explode("options").alias("letter", "text"))
    return each.select("question_id", "letter", parsing.is_lab_datum(F.col("text")).alias("lab"))


@registry.add("tip_extract", r"SELECT question_id, trim(list_extract(regexp_extract_all('Tip: ' || tip || chr(10) || chr(10) || question, '(?is)Tip\s*:\s*(.*?)(?:\n\s*\n|\z)', 1), 1)) AS tip FROM qbank_amboss_openai_evaluated WHERE tip IS NOT NULL AND question IS NOT NULL")
def tip_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank's tips are put before their questions, as in a file, and taken out again."""
    rows = _bank(spark, sf_dir).filter("tip IS NOT NULL AND question IS NOT NULL")
    return rows.select("question_id", parsing.tip(F.concat(F.lit("Tip: "), "tip", F.lit("\n\n"), "question")).alias("tip"))


@registry.add("option_explanations")
def option_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each option's explanation, parsed from one text made of the bank's explanations."""
    others = F.transform(F.map_entries("explanations"), lambda e: F.concat(F.lit("Choice "), e["key"], F.lit(". "), F.coalesce(e["value"], F.lit(""))))
    whole = F.concat(F.coalesce("explanation", F.lit("")), F.lit("\n\nIncorrect Answers: "), F.array_join(F.map_keys("explanations"), ", "), F.lit(".\n\n"), F.array_join(others, "\n\n"))
    rows = _bank(spark, sf_dir).filter("options IS NOT NULL AND explanations IS NOT NULL")
    parsed = parsing.option_explanations(whole, F.col("options"), F.upper(F.trim("correct_answer")))
    return rows.select("question_id", F.explode(parsed).alias("letter", "explanation"))


@registry.add("explanation_map")
def explanation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each option's explanation from a text that marks options by their letter."""
    marked = F.array_join(F.transform(F.map_entries("explanations"), lambda e: F.concat(e["key"], F.lit("："), F.coalesce(e["value"], F.lit("")))), "\n")
    rows = _bank(spark, sf_dir).filter("options IS NOT NULL AND explanations IS NOT NULL")
    return rows.select("question_id", F.explode(parsing.explanation_map(marked, F.col("options"), F.upper(F.trim("correct_answer")))).alias("letter", "explanation"))


@registry.add("lab_lines", r"SELECT question_id, array_to_string(list_filter(list_transform(string_split(replace(lab, ', ', ';'), ';'), lambda x: regexp_replace(regexp_replace(regexp_replace(trim(x), '\s*:\s*', ': ', 'g'), '(\d)([A-Za-z%°µ])', '\1 \2', 'g'), '\s{2,}', ' ', 'g')), lambda x: x <> ''), chr(10)) AS lines FROM (SELECT question_id, regexp_extract(question, '(?:[a-z]+ ){1,2}[0-9][^.?]*') AS lab FROM generated_question)")
def lab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = F.regexp_extract("question", r"(?:[a-z]+ ){1,2}[0-9][^.?]*", 0)
    # In sentences only a comma before a blank cuts a list.
    return table(spark, sf_dir, "generated_question").select("question_id", parsing.lab_lines(F.replace(lab, F.lit(", "), F.lit(";"))).alias("lines"))


@registry.add("numbered_split")
def numbered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, part_no, part): the questions of a file put together with numbers and page tags, and cut again before numbered stems."""
    rows = _bank(spark, sf_dir).filter("question IS NOT NULL").select("source_file", "question_id", F.concat(F.lit("[PAGE:"), F.coalesce(F.col("page_number").cast("string"), F.lit("0")), F.lit("]\n"), F.col("question_id").cast("string"), F.lit(". "), "question").alias("t"))
    # A page of a file is a bounded group; whole files are not gathered.
    pages = rows.groupBy("source_file", F.floor(F.col("question_id") / 50).alias("sheet")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question_id", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return pages.select("source_file", "sheet", F.posexplode(parsing.numbered_parts(F.col("text"))).alias("part_no", "part"))


_FLAT = "lower(regexp_replace({c}, '[!-/:-@\\[-`{{-~]', '', 'g'))"
_WORDSET = "list_filter(list_distinct(regexp_split_to_array({t}, '\\s+')), lambda w: w <> '')"
_COMMON = "[" + ", ".join(f"'{w}'" for w in parsing.COMMON) + "]"
_KIND = " OR ".join(
    "(" + "({hx}) AND ({hy}) AND length({cx}) BETWEEN 1 AND 25 AND length({cy}) BETWEEN 1 AND 25".format(
        hx=" OR ".join(f"contains(x, '{p}')" for p in g), hy=" OR ".join(f"contains(y, '{p}')" for p in g),
        cx="".join("replace(" for _ in g) + "x" + "".join(f", '{p}', '')" for p in g), cy="".join("replace(" for _ in g) + "y" + "".join(f", '{p}', '')" for p in g),
    ) + ")" for g in parsing.KINDS
)
_ALIKE = f"""WITH t AS (SELECT conv_id, pos, said AS b, lag(said) OVER (PARTITION BY conv_id ORDER BY pos) AS a FROM {TURNS_DUCK.replace('@', '')}),
n AS (SELECT *, {_FLAT.format(c='a')} AS x, {_FLAT.format(c='b')} AS y FROM t WHERE a IS NOT NULL AND b IS NOT NULL),
w AS (SELECT *, {_WORDSET.format(t='x')} AS sx, {_WORDSET.format(t='y')} AS sy, CASE WHEN length(x) < length(y) THEN x ELSE y END AS s, CASE WHEN length(x) < length(y) THEN y ELSE x END AS l FROM n),
v AS (SELECT *, {_WORDSET.format(t='s')} AS ws, {_WORDSET.format(t='l')} AS wl, list_filter(sx, lambda q: NOT list_contains({_COMMON}, q)) AS wx, list_filter(sy, lambda q: NOT list_contains({_COMMON}, q)) AS wy FROM w),
u AS (SELECT *, CASE WHEN len(wx) = 0 OR len(wy) = 0 THEN sx ELSE wx END AS ux, CASE WHEN len(wx) = 0 OR len(wy) = 0 THEN sy ELSE wy END AS uy FROM v)
SELECT conv_id, pos, a <> '' AND b <> '' AND (x = y
  OR (length(x) > 10 AND length(y) > 10 AND length(s) >= 15 AND (contains(l, s) OR (len(list_filter(regexp_split_to_array(s, '\\s+'), lambda q: q <> '')) >= 4 AND len(list_intersect(ws, wl)) >= 0.7 * len(ws))))
  OR {_KIND} OR (len(wx) = 0 AND len(wy) = 0)
  OR (len(list_distinct(list_concat(ux, uy))) > 0 AND len(list_intersect(ux, uy)) >= 0.3 * len(list_distinct(list_concat(ux, uy))))) AS alike FROM u"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, said): the student's turns of the latest save, with nulls as they are, as (pos, said) entries."""
    last = table(spark, sf_dir, "tutor_conversations").groupBy("conv_id").agg(F.max_by("messages", F.struct("saved_at", F.size("messages"))).alias("m"))
    entries = F.transform("m", lambda x, i: F.struct(i.alias("pos"), F.coalesce(x["user"], F.when(x["role"] == "user", x["content"])).alias("said"), (x["user"].isNotNull() | (F.coalesce(x["role"], F.lit("user")) == "user")).alias("turn")))
    return last.select("conv_id", F.filter(entries, lambda e: e["turn"]).alias("t"))


@registry.add("question_similarity", _ALIKE)
def question_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn held against the one before it."""
    pairs = F.transform("t", lambda e, i: F.struct(e["pos"].alias("pos"), F.get("t", i - 1)["said"].alias("a"), e["said"].alias("b")))
    each = _turns(spark, sf_dir).select("conv_id", F.explode(pairs).alias("p")).select("conv_id", "p.*").filter("a IS NOT NULL AND b IS NOT NULL")
    return each.select("conv_id", "pos", parsing.questions_alike(F.col("a"), F.col("b")).alias("alike"))


_SETS = f"(SELECT conv_id, pos, list_filter(list_distinct(regexp_extract_all(lower(said), '[a-z0-9_]+')), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(repr(w) for w in text.STOP_WORDS)}], w)) AS w FROM {TURNS_DUCK.replace('@', '')} WHERE said IS NOT NULL)"
_SIMILAR = f"SELECT b.conv_id, a.pos AS earlier, b.pos FROM {_SETS} a JOIN {_SETS} b ON a.conv_id = b.conv_id AND a.pos < b.pos WHERE len(list_distinct(list_concat(a.w, b.w))) > 0 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.3"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.filter("t", lambda e: e["said"].isNotNull())
    return _turns(spark, sf_dir).select("conv_id", F.transform(said, lambda e: F.struct(e["pos"].alias("pos"), text.word_set(e["said"], list(text.STOP_WORDS), 2).alias("w"))).alias("s"))


@registry.add("similar_pairs_jaccard", _SIMILAR)
def similar_pairs_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a conversation's turns with similar words: found in the conversation's own list, whose length is that of a dialogue."""
    near = lambda e, i: F.transform(F.filter(F.slice("s", F.lit(1), i), lambda o: F.coalesce(text.jaccard(o["w"], e["w"]) >= 0.3, F.lit(False))), lambda o: F.struct(o["pos"].alias("earlier"), e["pos"].alias("pos")))
    return _sets(spark, sf_dir).select("conv_id", F.explode(F.flatten(F.transform("s", near))).alias("p")).select("conv_id", "p.earlier", "p.pos")


@registry.add("novel_texts_antijoin", f"SELECT s.conv_id, s.pos FROM {_SETS} s ANTI JOIN ({_SIMILAR}) r ON s.conv_id = r.conv_id AND s.pos = r.pos")
def novel_texts_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that are like no earlier one."""
    turns = _sets(spark, sf_dir).select("conv_id", F.explode("s.pos").alias("pos"))
    return turns.join(similar_pairs_jaccard(spark, sf_dir).select("conv_id", "pos").distinct(), ["conv_id", "pos"], "left_anti")


@registry.add("upsert_defaults", "SELECT user_id, source FROM (SELECT DISTINCT user_id, 'log' AS source FROM events UNION ALL SELECT c_custkey, 'default' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL))")
def upsert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known users, and default ones that are not known yet."""
    known = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("source", F.lit("log"))
    default = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("default").alias("source"))
    return known.unionByName(bank.orphans(known, default, "user_id"))
