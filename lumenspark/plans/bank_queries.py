"""Question bank, documents and curriculum queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.functions import text
from lumenspark.operators import bank, nested
from lumenspark.plans.registry import Registry
from lumenspark.sources.tables import table

registry = Registry()
_BANK, _MADE = "qbank_amboss_openai_evaluated", "generated_question"
_ASCII = r"^[\s!-/:-@\[-`{-~]*$"


def _q(spark: SparkSession, sf_dir: str, name: str = _BANK) -> DataFrame:
    return table(spark, sf_dir, name)


@registry.add(
    "generated_question_filter",
    """WITH k AS (SELECT question_id, upper(trim(correct_answer)) AS correct_answer, coalesce(lower(difficulty), 'medium') AS difficulty, options, explanations FROM generated_question)
SELECT question_id, correct_answer, difficulty, trim(coalesce(explanations['A'], '')) AS explanation_a FROM k
WHERE len(list_filter(map_keys(options), lambda x: x IN ('A', 'B', 'C', 'D'))) = 4 AND correct_answer IN ('A', 'B', 'C', 'D')""",
)
def generated_question_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = bank.generated_question_filter(_q(spark, sf_dir, _MADE))
    return good.select("question_id", "correct_answer", "difficulty", F.col("explanations")["A"].alias("explanation_a"))


@registry.add(
    "quality_issues",
    r"""WITH q AS (SELECT question_id, question, trim(coalesce(question, '')) AS t, coalesce(len(map_keys(options)), 0) AS n, map_keys(options) AS ks, coalesce(map_values(options), []) AS vs,
upper(trim(coalesce(correct_answer, ''))) AS a, trim(coalesce(explanation, '')) AS e, trim(coalesce(tip, '')) AS tip FROM qbank_amboss_openai_evaluated)
SELECT question_id, array_to_string(list_filter([
CASE WHEN length(t) < 20 THEN 'question_short' END, CASE WHEN n < 2 THEN 'few_options' END, CASE WHEN n > 10 THEN 'many_options' END, CASE WHEN a = '' THEN 'no_answer' END,
CASE WHEN a <> '' AND NOT coalesce(list_contains(ks, a), false) THEN 'answer_not_an_option' END,
CASE WHEN len(list_filter(vs, lambda v: coalesce(trim(v), '') = '')) > 0 THEN 'option_empty' END,
CASE WHEN len(list_filter(vs, lambda v: length(trim(v)) > 200)) > 0 THEN 'option_long' END,
CASE WHEN len(list_filter(vs, lambda v: length(regexp_replace(v, '[^.!?]', '', 'g')) > 2)) > 0 THEN 'option_sentences' END,
CASE WHEN len(list_filter(vs, lambda v: contains(v, '___') OR length(regexp_replace(v, '[^_]', '', 'g')) > 5)) > 0 THEN 'option_lines' END,
CASE WHEN len(list_filter(vs, lambda v: regexp_matches(lower(v), 'because|since|due to|as a result|therefore|thus|moreover|furthermore|additionally|incorrect|correct') AND length(trim(v)) > 50)) > 0 THEN 'option_explains' END,
CASE WHEN e = '' THEN 'no_explanation' END, CASE WHEN e <> '' AND length(e) < 20 THEN 'explanation_short' END,
CASE WHEN tip <> '' AND NOT coalesce(contains(question, tip), false) THEN 'tip_apart' END], lambda x: x IS NOT NULL), ',') AS issues FROM q""",
)
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.issues(*(F.col(c) for c in ("question", "options", "correct_answer", "explanation", "tip")))
    return _q(spark, sf_dir).select("question_id", F.array_join(found, ",").alias("issues"))


def _valid(name: str, function, sql: str) -> None:
    """A validity test over all answers of the conversations."""
    answers = "(SELECT conv_id, coalesce(m.assistant, m.\"content\") AS t FROM (SELECT conv_id, unnest(messages) AS m FROM (SELECT conv_id, arg_max(messages, (saved_at, len(messages))) AS messages FROM tutor_conversations GROUP BY conv_id)))"

    @registry.add(name, f"SELECT conv_id, count(*) AS n, count(CASE WHEN {sql} THEN 1 END) AS n_valid FROM {answers} GROUP BY conv_id")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        last = _q(spark, sf_dir, "tutor_conversations").groupBy("conv_id").agg(F.max_by("messages", F.struct("saved_at", F.size("messages"))).alias("messages"))
        said = last.select("conv_id", F.explode("messages").alias("m")).select("conv_id", F.coalesce("m.assistant", "m.content").alias("t"))
        return said.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(function(F.col("t"))).alias("n_valid"))


_TRIM = "trim(t, ' ')"
_WORDS = f"len(list_filter(regexp_split_to_array({_TRIM}, '\\s+'), lambda w: length(w) > 1))"
_MARKS = f"length(regexp_replace({_TRIM}, '[. ,!?。，！？]', '', 'g'))"
_BARE = f"NOT regexp_matches({_TRIM}, '{_ASCII}')"
_valid(
    "valid_question_text", text.valid_question_text,
    f"length({_TRIM}) >= 5 AND NOT contains(lower(t), 'key clinical features mentioned in this question about') AND NOT contains(lower(t), 'how do these clinical features relate to the different answer options') AND NOT (contains(lower(t), 'what are the key concepts') AND length(t) < 80) AND {_BARE} AND {_MARKS} >= 3 AND {_WORDS} > 0",
)
_valid("valid_text_field", text.valid_text_field, f"length({_TRIM}) >= 10 AND {_BARE} AND {_MARKS} >= 3 AND {_WORDS} > 0")
_valid(
    "valid_clarification_text", text.valid_clarification_text,
    f"length({_TRIM}) >= 20 AND {_BARE} AND length(regexp_replace({_TRIM}, '[. ,!?。，！？：:]', '', 'g')) >= 5 AND NOT (regexp_matches({_TRIM}, '[。，：；！？]$') AND length(trim(left({_TRIM}, length({_TRIM}) - 1))) < 5)"
    f" AND NOT (len(regexp_split_to_array({_TRIM}, '\\s+')) - 1 < 2 AND length({_TRIM}) > 10 AND NOT regexp_matches({_TRIM}, '[。，：；！？]')) AND {_WORDS} >= 5"
    f" AND NOT (len(string_split(lower({_TRIM}), 'clarify')) - 1 > 2 OR len(string_split(lower({_TRIM}), 'key concepts')) - 1 > 2)"
    f" AND len(list_filter(regexp_split_to_array(lower({_TRIM}), '\\s+'), lambda w: length(w) > 1 AND regexp_matches(w, '[💡🔍💬]'))) <= 0.5 * {_WORDS}",
)


@registry.add("distinct_texts", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _q(spark, sf_dir, "documents")
    # The digest, not the text, is what rows are grouped by.
    return docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.min("doc_id").alias("doc_id")).select("text", "doc_id")


@registry.add("dedup_keep_first", "SELECT question, min(question_id) AS question_id FROM generated_question GROUP BY question")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _q(spark, sf_dir, _MADE).select("question", "question_id")
    return bank.keep_best(rows, ["question"], ["question_id"])


@registry.add(
    "dedup_best",
    "SELECT question, question_id, n_options FROM (SELECT question, question_id, coalesce(len(map_keys(options)), 0)::INT AS n_options, row_number() OVER (PARTITION BY question ORDER BY coalesce(len(map_keys(options)), 0) DESC, coalesce(len(map_keys(explanations)), 0) DESC, question_id) AS rn FROM qbank_amboss_openai_evaluated) WHERE rn = 1",
)
def dedup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = F.coalesce(F.size("options"), F.lit(0)), F.coalesce(F.size("explanations"), F.lit(0))
    rows = _q(spark, sf_dir).select("question", "question_id", n.alias("n_options"), e.alias("n_explanations"))
    return bank.keep_best(rows, ["question"], [-F.col("n_options"), -F.col("n_explanations"), F.col("question_id")]).drop("n_explanations")


@registry.add("dedup_normalised_prefix", "SELECT lower(regexp_replace(left(question, 100), '[^a-zA-Z0-9_]', '', 'g')) AS k, min(question_id) AS question_id, count(*) AS n FROM generated_question GROUP BY 1")
def dedup_normalised_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.lower(F.regexp_replace(F.left("question", F.lit(100)), "[^a-zA-Z0-9_]", ""))
    return _q(spark, sf_dir, _MADE).groupBy(k.alias("k")).agg(F.min("question_id").alias("question_id"), F.count(F.lit(1)).alias("n"))


@registry.add("merge_banks", "SELECT 2 AS bank, question_id, NULL AS source_file, topic FROM generated_question UNION ALL SELECT 1, question_id, source_file, NULL FROM qbank_amboss_openai_evaluated")
def merge_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bank.merge_banks(_q(spark, sf_dir).select("question_id", "source_file"), _q(spark, sf_dir, _MADE).select("question_id", "topic"))
    return both.select("bank", "question_id", "source_file", "topic")


_NEW = "(SELECT question_id, max_page AS page_number FROM (SELECT question_id, CAST(max(question_id) % 90 AS INT) AS max_page FROM human_evaluation GROUP BY question_id))"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q(spark, sf_dir, "human_evaluation").groupBy("question_id").agg((F.max("question_id") % 90).cast("int").alias("page_number"))


@registry.add("override_merge", f"SELECT b.question_id, coalesce(n.page_number, b.page_number) AS page_number FROM qbank_amboss_openai_evaluated b LEFT JOIN {_NEW} n ON b.question_id = n.question_id")
def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.override(_q(spark, sf_dir).select("question_id", "page_number"), _pages(spark, sf_dir), "question_id", "page_number")


@registry.add("override_orphans", f"SELECT n.question_id, n.page_number FROM {_NEW} n WHERE n.question_id NOT IN (SELECT question_id FROM qbank_amboss_openai_evaluated)")
def override_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.orphans(_q(spark, sf_dir), _pages(spark, sf_dir), "question_id")


@registry.add(
    "left_join_default_array",
    "SELECT b.question_id, coalesce(i.images, '') AS images FROM qbank_amboss_openai_evaluated b LEFT JOIN (SELECT page_number, string_agg(x, ',' ORDER BY x) AS images FROM (SELECT DISTINCT page_number, unnest(images) AS x FROM qbank_amboss_openai_evaluated WHERE page_number IS NOT NULL) GROUP BY page_number) i ON b.page_number = i.page_number",
)
def left_join_default_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _q(spark, sf_dir)
    by_page = rows.filter("page_number IS NOT NULL").select("page_number", F.explode("images").alias("x")).groupBy("page_number").agg(F.array_sort(F.collect_set("x")).alias("images"))
    joined = rows.select("question_id", "page_number").join(by_page, "page_number", "left")
    return joined.select("question_id", F.array_join(F.coalesce("images", F.array().cast("array<string>")), ",").alias("images"))


@registry.add("page_mismatch", "SELECT question_id, image, page_number FROM (SELECT question_id, page_number, unnest(images) AS image FROM qbank_amboss_openai_evaluated) WHERE TRY_CAST(regexp_extract(image, 'page_(\\d+)_img', 1) AS INT) <> page_number")
def page_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _q(spark, sf_dir).select("question_id", "page_number", F.explode("images").alias("image"))
    return images.filter(F.regexp_extract("image", r"page_(\d+)_img", 1).try_cast("int") != F.col("page_number")).select("question_id", "image", "page_number")


@registry.add("render_options", "SELECT question_id, list_aggregate(list_transform(list_sort(list_filter(map_entries(options), lambda e: e.value IS NOT NULL)), lambda e: e.key || ') ' || e.value), 'string_agg', chr(10)) AS rendered FROM qbank_amboss_openai_evaluated WHERE options IS NOT NULL")
def render_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.array_sort(F.filter(F.map_entries("options"), lambda e: e["value"].isNotNull()))
    shown = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")
    return _q(spark, sf_dir).filter("options IS NOT NULL").select("question_id", shown.alias("rendered"))


@registry.add("sample_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents WHERE source IS NOT NULL) WHERE rn <= 5")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _q(spark, sf_dir, "documents").filter("source IS NOT NULL").select("source", "doc_id")
    return bank.sample_per_group(docs, "source", "doc_id", 5)


registry.add_sql("source_page_counts", "SELECT source, count(*) AS n_chunks, count(DISTINCT page) AS n_pages, sum(n_chars) AS n_chars FROM @documents GROUP BY source", "SELECT source, count(*) AS n_chunks, count(DISTINCT page) AS n_pages, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM @documents GROUP BY source")
registry.add_sql("doc_type_detect", "SELECT doc_id, CASE WHEN contains(lower(source), 'amboss') OR contains(upper(text), 'AMBOSS') THEN 'amboss' WHEN length(trim(text)) < 100 THEN 'scanned' WHEN contains(text, 'Correct Answer:') OR contains(upper(text), 'NBME') THEN 'surgery' ELSE 'surgery' END AS kind FROM @documents")
registry.add_sql("offset_limit", "SELECT question_id, source FROM @qbank_amboss_openai_evaluated ORDER BY question_id LIMIT 50 OFFSET 100")
# Pages, not rows, are sorted together: a page's nearest is the next lower or the next higher one of the documents.
registry.add_sql(
    "nearest_page",
    """WITH p AS (SELECT at, max(page) AS page FROM (SELECT DISTINCT page AS at, page FROM @documents WHERE page IS NOT NULL UNION ALL SELECT DISTINCT page_number, NULL FROM @qbank_amboss_openai_evaluated WHERE page_number IS NOT NULL) GROUP BY at),
n AS (SELECT at, last(page, true) OVER (ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low, first(page, true) OVER (ORDER BY at ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS high FROM p),
b AS (SELECT at, CASE WHEN low IS NULL OR high - at < at - low THEN high ELSE low END AS page FROM n WHERE low IS NOT NULL OR high IS NOT NULL)
SELECT q.question_id, min_by(b.page, struct(abs(b.page - q.page_number), b.page)) AS page FROM @qbank_amboss_openai_evaluated q JOIN b ON q.page_number = b.at GROUP BY q.question_id""",
    "SELECT q.question_id, arg_min(d.page, (abs(d.page - q.page_number), d.page)) AS page FROM @qbank_amboss_openai_evaluated q, (SELECT DISTINCT page FROM @documents WHERE page IS NOT NULL) d WHERE q.page_number IS NOT NULL GROUP BY q.question_id",
)
# A file is complete with 25 questions or more whose numbers are 1 to 25, each once.
registry.add_sql("sequence_complete", "SELECT source_file, count(*) AS n, count(*) >= 25 AND count(page_number) = 25 AND count(DISTINCT page_number) = 25 AND min(page_number) = 1 AND max(page_number) = 25 AS complete FROM @qbank_amboss_openai_evaluated GROUP BY source_file")
_NUMBERED = "CAST(NULLIF(regexp_extract(question, '^([0-9]+)[.][ ]', 1), '') AS BIGINT)"
registry.add_sql("question_number", f"SELECT question_id, {_NUMBERED} AS number FROM @qbank_amboss_openai_evaluated")
# Two questions to a page up to the last one of the file; page 1 without a number.
registry.add_sql("page_inference", f"SELECT q.question_id, CAST(coalesce(least(floor(({_NUMBERED} - 1) / 2) + 1, t.total), 1) AS BIGINT) AS page, CAST(least(floor((q.question_id - 1) / 2) + 1, t.total) AS BIGINT) AS page_by_id FROM @qbank_amboss_openai_evaluated q JOIN (SELECT coalesce(source_file, '') AS file, max(page_number) AS total FROM @qbank_amboss_openai_evaluated GROUP BY coalesce(source_file, '')) t ON coalesce(q.source_file, '') = t.file")
registry.add_sql("question_listing", "SELECT question_id, coalesce(NULLIF(regexp_extract(question, '^([0-9]+)[.]', 1), ''), '?') AS number, page_number, coalesce({n}, 0) > 0 AS has_image, left(replace(question, chr(10), ' '), 80) AS preview FROM @qbank_amboss_openai_evaluated".replace("{n}", "cardinality(images)"), "SELECT question_id, coalesce(NULLIF(regexp_extract(question, '^([0-9]+)[.]', 1), ''), '?') AS number, page_number, coalesce(len(images), 0) > 0 AS has_image, left(replace(question, chr(10), ' '), 80) AS preview FROM @qbank_amboss_openai_evaluated")
registry.add_sql("jump_to", "SELECT question_id, source FROM (SELECT question_id, source, row_number() OVER (ORDER BY question_id) AS n FROM (SELECT question_id, source FROM @qbank_amboss_openai_evaluated ORDER BY question_id LIMIT 17)) WHERE n = 17")
registry.add_sql("attach_evaluation", "SELECT q.question_id, e.n AS n_forms, e.total AS total_score FROM @qbank_amboss_openai_evaluated q LEFT JOIN (SELECT question_id, count(*) AS n, round(avg(total_score), 6) AS total FROM @human_evaluation GROUP BY question_id) e ON q.question_id = e.question_id")
registry.add_sql("question_vignette_age", "SELECT question_id, TRY_CAST(regexp_extract(question, '([0-9]+)-year-old', 1) AS INT) AS age FROM @generated_question")
registry.add_sql("answer_argmax", "SELECT question_id, max_by(k, struct(length(v), k)) AS longest FROM (SELECT question_id, explode(options) AS (k, v) FROM @generated_question) WHERE v IS NOT NULL GROUP BY question_id", "SELECT question_id, arg_max(e.key, (length(e.value), e.key)) AS longest FROM (SELECT question_id, unnest(map_entries(options)) AS e FROM @generated_question) WHERE e.value IS NOT NULL GROUP BY question_id")
registry.add_sql("option_letters_pivot", "SELECT source, count(CASE WHEN upper(trim(correct_answer)) = 'A' THEN 1 END) AS a, count(CASE WHEN upper(trim(correct_answer)) = 'B' THEN 1 END) AS b, count(CASE WHEN upper(trim(correct_answer)) = 'C' THEN 1 END) AS c, count(CASE WHEN upper(trim(correct_answer)) = 'D' THEN 1 END) AS d FROM @qbank_amboss_openai_evaluated GROUP BY source")
# The whole rule wants a number before the stem; rest is the rule without it.
_VALID = "SELECT question_id, rest AND regexp_extract(trim(coalesce(question, '')), '^[0-9]+[.][ ]', 0) <> '' AS ok, rest FROM (SELECT question_id, question, trim(coalesce(question, '')) <> '' AND coalesce({n}, 0) >= 1 AND trim(coalesce(correct_answer, '')) <> '' AS rest FROM @qbank_amboss_openai_evaluated)"
registry.add_sql("validate_question", _VALID.replace("{n}", "cardinality(options)"), _VALID.replace("{n}", "len(map_keys(options))"))


@registry.add("hierarchy_flatten")
def hierarchy_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files held as text are read too; their uneven JSON has no SQL here."""
    return nested.flattened(_q(spark, sf_dir, "all_domains_with_subtopics"))


@registry.add("hierarchy_counts")
def hierarchy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With files held as text."""
    return nested.counted(_q(spark, sf_dir, "all_domains_with_subtopics"))


@registry.add("overlapping_batches", "SELECT source, b AS batch, page FROM (SELECT DISTINCT source, page FROM documents WHERE page IS NOT NULL AND source IS NOT NULL) p JOIN (SELECT unnest(generate_series(0, 1000)) AS b) g ON p.page >= greatest(0, b * 3 - 2) AND p.page < b * 3 + 3 + 2 AND b * 3 - 2 <= p.page")
def overlapping_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _q(spark, sf_dir, "documents").filter("page IS NOT NULL AND source IS NOT NULL").select("source", "page").distinct()
    return bank.overlapping_batches(pages, 3, 2)


def _replaced(column: str) -> str:
    for pattern, by in text.CLEANED:
        pattern = pattern.replace("'", "''")
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return f"trim({column})"


@registry.add("clean_text", f"SELECT doc_id, {_replaced('text')} AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@registry.add(
    "split_paragraphs",
    r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(10) || chr(10) || '\2', 'g'), '\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''))::INT AS n FROM documents",
)
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q(spark, sf_dir, "documents").select("doc_id", F.size(text.split_paragraphs(F.col("text"))).alias("n"))


_SET = "list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9_]+')), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], w))"


@registry.add(
    "jaccard_similarity",
    f"WITH t AS (SELECT question_id, {_SET.format(c='question')} AS a, {_SET.format(c='explanation')} AS b FROM qbank_amboss_openai_evaluated WHERE question IS NOT NULL AND explanation IS NOT NULL) SELECT question_id, CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS similarity FROM t",
)
def jaccard_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (text.word_set(F.col(c), text.STOP_WORDS, 2) for c in ("question", "explanation"))
    rows = _q(spark, sf_dir).filter("question IS NOT NULL AND explanation IS NOT NULL")
    return rows.select("question_id", F.round(text.jaccard(a, b), 6).alias("similarity"))
