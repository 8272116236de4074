"""Text extraction queries over the tables' own texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions import records, text
from lumenspark.operators.sessions import iso_micros
from lumenspark.plans.activity_queries import SAVED_DUCK, TURNS_DUCK
from lumenspark.plans.registry import Registry
from lumenspark.sources.tables import table

registry = Registry()


@registry.add(
    "extract_options",
    r"""WITH l AS (SELECT conv_id, saved_at, unnest(regexp_split_to_array(options, '\s*\n\s*')) AS x, generate_subscripts(regexp_split_to_array(options, '\s*\n\s*'), 1) AS i FROM (SELECT conv_id, min(saved_at) AS saved_at, min(options) AS options FROM tutor_conversations GROUP BY conv_id)),
o AS (SELECT conv_id, i, left(x, 1) AS letter, trim(regexp_replace(regexp_replace(x, '^[A-J][).]\s*', ''), '[,\s]*_{2,}\s*$', '')) AS v FROM l WHERE regexp_matches(x, '^[A-J][).]\s*\S'))
SELECT conv_id, letter, arg_max(v, i) AS option FROM o WHERE length(v) > 3 GROUP BY conv_id, letter""",
)
def extract_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "tutor_conversations").groupBy("conv_id").agg(F.min("options").alias("options"))
    return one.select("conv_id", F.explode(records.option_lines(F.col("options"))).alias("letter", "option"))


@registry.add("parse_iso_ts", r"""WITH e AS (SELECT log_id, unnest(events) AS e FROM user_logs), t AS (SELECT log_id, trim(e."timestamp", E' \t\r\n') AS b FROM e)
SELECT log_id, count(*) AS n, count(CASE WHEN regexp_matches(b, '^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d(:\d\d([.,]\d{1,9})?)?([Zz]|[+-]\d\d(:?\d\d)?)?$') AND try_cast(CASE WHEN regexp_matches(b, '(Z|[+-]\d\d(:?\d\d)?)$') AND length(b) > 16 THEN b ELSE b || 'Z' END AS TIMESTAMPTZ) IS NOT NULL THEN 1 END) AS n_readable FROM t GROUP BY log_id""")
def parse_iso_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "user_logs").select("log_id", F.explode("events").alias("e")).select("log_id", iso_micros(F.col("e.timestamp")).alias("us"))
    return e.groupBy("log_id").agg(F.count(F.lit(1)).alias("n"), F.count("us").alias("n_readable"))


@registry.add("format_duration", "SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || printf('m %.1fs', s % 60) ELSE CAST(floor(s / 3600) AS BIGINT) || 'h ' || CAST(floor((s % 3600) / 60) AS BIGINT) || 'm' END AS shown FROM (SELECT event_id, CAST(event_id * 7 % 9000 AS DOUBLE) + 0.5 AS s FROM events)")
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.col("event_id") * 7 % 9000).cast("double") + 0.5
    return table(spark, sf_dir, "events").select("event_id", records.duration(seconds).alias("shown"))


@registry.add("safe_username", "SELECT DISTINCT user_name, CASE WHEN s = '' THEN 'unknown' ELSE s END AS safe FROM (SELECT user_name, left(regexp_replace(regexp_replace(trim(coalesce(user_name, 'unknown')), '^user:', ''), '[<>:\"/\\\\|?*]', '_', 'g'), 64) AS s FROM user_logs)")
def safe_username(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "user_logs").select("user_name").distinct().select("user_name", records.safe_name(F.col("user_name")).alias("safe"))


@registry.add("mask_user", "SELECT DISTINCT file_name, CASE WHEN length(file_name) > 16 THEN left(file_name, 16) || '...' ELSE file_name END AS shown FROM human_evaluation")
def mask_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "human_evaluation").select("file_name").distinct().select("file_name", records.masked_name(F.col("file_name")).alias("shown"))


@registry.add("salvage_json", r"SELECT DISTINCT file_id, nullif(regexp_extract(raw_json, '(?s)\{.*\}', 0), '') AS held FROM all_domains_with_subtopics WHERE raw_json IS NOT NULL")
def salvage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "all_domains_with_subtopics").filter("raw_json IS NOT NULL")
    return rows.select("file_id", records.salvaged(F.col("raw_json")).alias("held")).distinct()


@registry.add("json_unwrap", "SELECT file_id, CASE WHEN NOT json_valid(raw_json) THEN 'invalid' WHEN json_type(raw_json) = 'ARRAY' THEN 'list' WHEN json_type(raw_json, '$.domains') = 'ARRAY' THEN 'domains' WHEN json_type(raw_json, '$.data') = 'ARRAY' THEN 'data' ELSE 'other' END AS container FROM all_domains_with_subtopics WHERE raw_json IS NOT NULL")
def json_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "all_domains_with_subtopics").filter("raw_json IS NOT NULL")
    return rows.select("file_id", records.container(F.col("raw_json")).alias("container"))


_LAB = r"[a-z]+ (?:count )?\d[\d,]*(?:\.\d+)? (?:mg/dL|g/dL|mmol/L|mU/L|U/L|ng/mL|ng/L|per mm3)"


@registry.add("lab_values_extract", f"SELECT question_id, array_to_string(regexp_extract_all(question, '{_LAB}'), '|') AS lab_values FROM generated_question")
def lab_values_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "generated_question").select("question_id", F.array_join(records.lab_values(F.col("question")), "|").alias("lab_values"))


@registry.add("judge_score_extract", r"SELECT question_id, CAST(nullif(regexp_extract(CASE WHEN contains(t, 'score') THEN split_part(t, 'score', 2) ELSE t END, '\d+(?:\.\d+)?', 0), '') AS DOUBLE) AS score FROM (SELECT question_id, llm_judge_evaluation.evaluation_text AS t FROM qbank_amboss_openai_evaluated) WHERE t IS NOT NULL")
def judge_score_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "qbank_amboss_openai_evaluated").select("question_id", F.col("llm_judge_evaluation.evaluation_text").alias("t")).filter("t IS NOT NULL")
    return rows.select("question_id", records.label_score(F.col("t"), "score").alias("score"))


@registry.add(
    "sectionise_lines",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(Section \d|Case discussion|Key points|When to refer)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM l WHERE trim(line) <> '')
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n_lines FROM m GROUP BY doc_id, section""",
)
def sectionise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the heading they follow: one fold over a document's lines, no window over exploded rows."""
    head = r"^(Section \d|Case discussion|Key points|When to refer)"
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    flags = F.transform(lines, lambda x: x.rlike(head).cast("int"))
    heads = F.filter(F.transform(flags, lambda f, i: F.when(f == 1, i)), lambda x: x.isNotNull())
    # A section runs from its heading to the next; section 0 is what stands before the first.
    starts = F.concat(F.array(F.lit(0)), heads)
    ends = F.concat(heads, F.array(F.size(lines)))
    zipped = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(zipped).alias("section", "z"))
    return rows.select("doc_id", F.col("section").cast("bigint"), (F.col("z.b") - F.col("z.a")).cast("bigint").alias("n_lines")).filter("n_lines > 0")


_SAID = "(SELECT conv_id, pos, said AS t FROM " + TURNS_DUCK.replace("@", "") + " WHERE said IS NOT NULL)"
_SET = "list_filter(list_distinct(regexp_extract_all(lower(t), '[a-z0-9_]+')), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], w))"


@registry.add(
    "novel_turns",
    f"WITH s AS (SELECT conv_id, pos, {_SET} AS w FROM {_SAID}), r AS (SELECT DISTINCT b.conv_id, b.pos FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.pos < b.pos WHERE len(list_distinct(list_concat(a.w, b.w))) > 0 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.3)"
    " SELECT s.conv_id, count(*) AS n_turns, count(*) - count(r.pos) AS n_novel FROM s LEFT JOIN r ON s.conv_id = r.conv_id AND s.pos = r.pos GROUP BY s.conv_id",
)
def novel_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student turns that are not similar (Jaccard 0.3) to an earlier one: looked up in the conversation's own list, no pairs are made."""
    last = table(spark, sf_dir, "tutor_conversations").groupBy("conv_id").agg(F.max_by("messages", F.struct("saved_at", F.size("messages"))).alias("m"))
    # Older saves hold role and content.
    said = F.filter(F.transform("m", lambda x: F.coalesce(x["user"], F.when(x["role"] == "user", x["content"]))), lambda t: t.isNotNull())
    sets = last.select("conv_id", F.transform(said, lambda t: text.word_set(t, text.STOP_WORDS, 2)).alias("s")).filter(F.size("s") > 0)
    similar = lambda w, i: F.exists(F.slice("s", F.lit(1), i), lambda e: F.coalesce(text.jaccard(e, w) >= 0.3, F.lit(False)))
    novel = F.filter("s", lambda w, i: ~F.coalesce(similar(w, i), F.lit(False)))
    return sets.select("conv_id", F.size("s").cast("bigint").alias("n_turns"), F.size(novel).cast("bigint").alias("n_novel"))


registry.add_sql("pass_rate_pivot", "SELECT source, count(CASE WHEN llm_judge_evaluation.overall_quality >= 4 THEN 1 END) AS passed, count(CASE WHEN llm_judge_evaluation.overall_quality < 4 THEN 1 END) AS failed, count(CASE WHEN llm_judge_evaluation.overall_quality IS NULL THEN 1 END) AS unrated FROM @qbank_amboss_openai_evaluated GROUP BY source")
registry.add_sql("window_usage_by_type", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd_value FROM @events GROUP BY event_type")


_PERCENT = r"([A-Z][^%\n]{2,200}?|\d+[^%\n]{1,200}?)\s+(\d{1,2})%"
_OPTIONS = f"""(SELECT doc_id, option, pct, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM (
SELECT *, row_number() OVER (PARTITION BY doc_id, pct ORDER BY i) AS again FROM (
SELECT doc_id, trim(unnest(regexp_extract_all(t, '{_PERCENT}', 1))) AS option, CAST(unnest(regexp_extract_all(t, '{_PERCENT}', 2)) AS INT) AS pct, generate_subscripts(regexp_extract_all(t, '{_PERCENT}', 2), 1) AS i
FROM (SELECT doc_id, replace(text, ' percent', '%') AS t FROM documents))) WHERE again = 1)"""


@registry.add("percent_options", f"SELECT doc_id, option, pct FROM {_OPTIONS} WHERE rn <= 10")
def percent_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = records.percent_options(F.replace(F.col("text"), F.lit(" percent"), F.lit("%")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(options).alias("o")).select("doc_id", "o.option", "o.pct")


@registry.add("argmax_option", f"SELECT d.doc_id, coalesce(m.letter, 'A') AS letter FROM documents d LEFT JOIN (SELECT doc_id, chr(64 + CAST(arg_max(rn, (pct, -rn)) AS INT)) AS letter FROM {_OPTIONS} WHERE rn <= 10 GROUP BY doc_id) m ON d.doc_id = m.doc_id")
def argmax_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = records.percent_options(F.replace(F.col("text"), F.lit(" percent"), F.lit("%")))
    return table(spark, sf_dir, "documents").select("doc_id", options.alias("o")).select("doc_id", records.argmax_letter(F.col("o")).alias("letter"))


_CLARIFIES = " OR ".join(f"contains(lower(t), '{w}')" for w in records.CLARIFIES)


@registry.add("extract_clarifications", f"SELECT conv_id, count(*) AS n FROM (SELECT conv_id, coalesce(m.assistant, CASE WHEN m.\"role\" = 'assistant' THEN m.\"content\" END) AS t FROM (SELECT conv_id, unnest(messages) AS m FROM {SAVED_DUCK.replace('@', '')})) WHERE ({_CLARIFIES}) AND length(trim(t)) > 20 AND NOT (trim(t) LIKE '%?' AND length(t) - length(replace(t, '.', '')) < 2) GROUP BY conv_id")
def extract_clarifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "tutor_conversations").groupBy("conv_id").agg(F.max_by("messages", F.struct("saved_at", F.size("messages"))).alias("messages"))
    m = last.select("conv_id", F.explode("messages").alias("m"))
    said = m.select("conv_id", F.coalesce("m.assistant", F.when(F.col("m.role") == "assistant", F.col("m.content"))).alias("t"))
    return said.filter(records.is_clarification(F.col("t"))).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def _holds(rule: tuple) -> str:
    return " OR ".join("(" + " AND ".join("(" + " OR ".join(f"contains(lower(t), '{w}')" for w in any_) + ")" for any_ in all_) + ")" for all_ in rule)


_KINDS = " ".join(f"WHEN {_holds(rule)} THEN '{k}'" for k, rule in records.ERROR_RULES)


@registry.add("error_category", f"SELECT kind, count(*) AS n FROM (SELECT CASE {_KINDS} WHEN length(t) > 80 THEN left(t, 80) || '...' ELSE t END AS kind FROM (SELECT text AS t FROM documents)) GROUP BY kind")
def error_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "documents").select(F.col("text").alias("t"))
    return whole.groupBy(records.error_kind(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "clean_question_lines",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '_{3,}\s*$', '')) AS x FROM l),
k AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c)
SELECT doc_id, regexp_replace(string_agg(x, chr(10) ORDER BY i), '^\n+|\n+$', '', 'g') AS cleaned FROM k WHERE x <> '' OR coalesce(before <> '', false) GROUP BY doc_id""",
)
def clean_question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", records.question_lines(F.col("text")).alias("cleaned"))


registry.add_sql("rerank_first_match", "SELECT q.question_id, f.doc_id FROM @qbank_amboss_openai_evaluated q JOIN (SELECT question, min(question_id) AS doc_id FROM @generated_question GROUP BY question) f ON q.question = f.question")
