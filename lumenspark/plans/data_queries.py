"""Queries of the general data-processing problems (2 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenspark.operators import nested, sessions
from lumenspark.plans.registry import Registry
from lumenspark.sources.tables import table

registry = Registry()


@registry.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.leaves(nested.tagged_rows(table(spark, sf_dir, "all_domains_with_subtopics")))


@registry.add("p2_topics")
def p2_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of topics, traceable to domain and file."""
    return nested.flat_table(nested.tagged_rows(table(spark, sf_dir, "all_domains_with_subtopics")), "topic")


@registry.add("p2_domains")
def p2_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of domains, traceable to the file."""
    return nested.flat_table(nested.tagged_rows(table(spark, sf_dir, "all_domains_with_subtopics")), "domain")


@registry.add("p2_subtopics")
def p2_subtopics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of subtopics, traceable to topic, domain and file."""
    return nested.flat_table(nested.tagged_rows(table(spark, sf_dir, "all_domains_with_subtopics")), "subtopic")


_SESSIONS = r"""
WITH entries AS (
  SELECT user_name, 'event' AS list, e.event AS name, NULL::BIGINT AS question_id, e."timestamp" AS t
  FROM (SELECT user_name, unnest(events) AS e FROM user_logs WHERE user_name IS NOT NULL)
  UNION ALL
  SELECT user_name, 'button', e.button, e.question_id, e."timestamp"
  FROM (SELECT user_name, unnest(button_clicks) AS e FROM user_logs WHERE user_name IS NOT NULL)),
bare AS (SELECT *, trim(t, E' \t\r\n') AS b FROM entries),
timed AS (
  SELECT DISTINCT user_name, list, name, question_id,
    epoch_us(try_cast(CASE WHEN regexp_matches(b, '(Z|[+-]\d\d(:?\d\d)?)$') AND length(b) > 16 THEN b ELSE b || 'Z' END AS TIMESTAMPTZ)) AS us
  FROM bare WHERE regexp_matches(b, '^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d(:\d\d([.,]\d{1,9})?)?([Zz]|[+-]\d\d(:?\d\d)?)?$')),
gaps AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_name ORDER BY us) <= 900000000 THEN 0 ELSE 1 END AS opens
  FROM timed WHERE us IS NOT NULL),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY user_name ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM gaps)
SELECT user_name, min(us) // 1000 AS start_ms, max(us) // 1000 AS end_ms, count(*) AS n_events
FROM islands GROUP BY user_name, island"""


@registry.add("p6_found", _SESSIONS)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.user_sessions(table(spark, sf_dir, "user_logs")).drop("duration_ms")
