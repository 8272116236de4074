"""Judge and human evaluations of questions."""

from __future__ import annotations

from lumenspark.plans.registry import Registry

registry = Registry()

DIMENSIONS = ("question_clarity", "option_quality", "explanation_quality", "medical_accuracy", "overall_quality", "total_score")
_JUDGE = "(SELECT question_id, " + ", ".join(f"llm_judge_evaluation.{d} AS {d}" for d in DIMENSIONS) + " FROM @qbank_amboss_openai_evaluated WHERE llm_judge_evaluation IS NOT NULL)"
registry.add_sql("judge_scores", f"SELECT * FROM {_JUDGE}")
registry.add_sql("judge_statistics", "SELECT " + ", ".join(f"round(coalesce(avg({d}), 0), 6) AS average_{d}, count({d}) AS n_{d}" for d in DIMENSIONS) + f" FROM {_JUDGE}")

#: Each evaluator's latest form for a question.
_FORMS = "(SELECT * FROM (SELECT *, lower(trim(evaluator_id)) AS rater, row_number() OVER (PARTITION BY question_id, lower(trim(evaluator_id)) ORDER BY submitted_at DESC, evaluation_id DESC) AS rn FROM @human_evaluation) WHERE rn = 1)"
_LONG = " UNION ALL ".join(f"SELECT question_id, rater, '{d}' AS dimension, {d} AS score FROM {_FORMS} WHERE {d} BETWEEN 1 AND 5" for d in DIMENSIONS[:2] + DIMENSIONS[3:5])
_JUDGED = " UNION ALL ".join(f"SELECT question_id, '{d}' AS dimension, {d} AS judge FROM {_JUDGE} WHERE {d} IS NOT NULL" for d in DIMENSIONS[:2] + DIMENSIONS[3:5])
_JOINED = f"SELECT h.question_id, h.dimension, h.human, j.judge FROM (SELECT question_id, dimension, avg(score) AS human FROM ({_LONG}) GROUP BY question_id, dimension) h JOIN ({_JUDGED}) j ON h.question_id = j.question_id AND h.dimension = j.dimension"
registry.add_sql("judge_human_join", f"SELECT question_id, dimension, round(human, 6) AS human, judge FROM ({_JOINED})")
_CORR = "CASE WHEN count(*) >= 2 AND stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN round((avg({x} * {y}) - avg({x}) * avg({y})) / (stddev_pop({x}) * stddev_pop({y})), 6) END"
registry.add_sql("judge_human_corr", f"SELECT dimension, count(*) AS n, {_CORR.format(x='human', y='judge')} AS r FROM ({_JOINED}) GROUP BY dimension")
# Raters meet on questions they share: an equi-join whose size is that of the pairs of one question's raters.
_PAIRS = f"SELECT a.rater AS a, b.rater AS b, a.dimension, a.score AS x, b.score AS y FROM ({_LONG}) a JOIN ({_LONG}) b ON a.question_id = b.question_id AND a.dimension = b.dimension AND a.rater < b.rater"
registry.add_sql("interrater_corr", f"SELECT dimension, count(r) AS n_pairs, round(avg(r), 5) AS mean_r FROM (SELECT dimension, a, b, {_CORR.format(x='x', y='y')} AS r FROM ({_PAIRS}) GROUP BY dimension, a, b) GROUP BY dimension")
# The same over the questions that every rater of the dimension has scored; pairs of a question's raters above are the default.
_ALL = f"(SELECT l.* FROM ({_LONG}) l JOIN (SELECT i.question_id, i.dimension FROM (SELECT question_id, dimension, count(DISTINCT rater) AS n FROM ({_LONG}) GROUP BY question_id, dimension) i JOIN (SELECT dimension, count(DISTINCT rater) AS n FROM ({_LONG}) GROUP BY dimension) a ON i.dimension = a.dimension AND i.n = a.n) w ON l.question_id = w.question_id AND l.dimension = w.dimension)"
_ALL_PAIRS = f"SELECT a.rater AS a, b.rater AS b, a.dimension, a.score AS x, b.score AS y FROM {_ALL} a JOIN {_ALL} b ON a.question_id = b.question_id AND a.dimension = b.dimension AND a.rater < b.rater"
registry.add_sql("interrater_corr_common", f"SELECT d.dimension, count(r) AS n_pairs, round(avg(r), 5) AS mean_r FROM (SELECT DISTINCT dimension FROM ({_LONG})) d LEFT JOIN (SELECT dimension, a, b, {_CORR.format(x='x', y='y')} AS r FROM ({_ALL_PAIRS}) GROUP BY dimension, a, b) c ON d.dimension = c.dimension GROUP BY d.dimension")
_AGREE = f"SELECT dimension, count(*) AS n_pairs, count(CASE WHEN coalesce(abs(x - y) <= 1, false) THEN 1 END) AS n_agree FROM ({_PAIRS}) GROUP BY dimension"
registry.add_sql("scores_agree", _AGREE)
registry.add_sql("evaluators_common_items", f"SELECT question_id, count(DISTINCT rater) AS n_raters FROM {_FORMS} WHERE question_id IS NOT NULL GROUP BY question_id HAVING count(DISTINCT rater) >= 5")
registry.add_sql("items_intersect", "SELECT question_id FROM @human_evaluation INTERSECT SELECT question_id FROM @qbank_amboss_openai_evaluated")
#: Agreement within one point, every score held against the first rater's; dimensions with one score are passed over.
_AGREED = f"SELECT question_id, min(CASE WHEN n < 2 OR far <= 1 THEN 1 ELSE 0 END) = 1 AS agreed, max(n) AS n_raters FROM (SELECT question_id, dimension, count(*) AS n, max(abs(score - first)) AS far FROM (SELECT *, first_value(score) OVER (PARTITION BY question_id, dimension ORDER BY rater) AS first FROM ({_LONG})) GROUP BY question_id, dimension) GROUP BY question_id"
registry.add_sql("consensus_items", _AGREED)
registry.add_sql("agreement_rate", f"SELECT count(*) AS n_items, count(CASE WHEN agreed THEN 1 END) AS n_agreed, round(coalesce(avg(CAST(agreed AS INT)), 0), 6) AS rate FROM ({_AGREED})")
registry.add_sql(
    "collect_evaluators",
    f"SELECT question_id, array_join(array_sort(collect_list(rater)), ',') AS raters, count(*) AS n FROM {_FORMS} WHERE rater IS NOT NULL GROUP BY question_id",
    f"SELECT question_id, string_agg(rater, ',' ORDER BY rater) AS raters, count(*) AS n FROM {_FORMS} WHERE rater IS NOT NULL GROUP BY question_id",
)
