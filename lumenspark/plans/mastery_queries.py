"""Mastery of domain, topic and subtopic: region, nation and segment of the orders' customers stand in for them."""

from __future__ import annotations

from lumenspark.plans.registry import Registry

registry = Registry()

_ATTEMPTS = """SELECT r.r_name AS domain, n.n_name AS topic, c.c_mktsegment AS subtopic, o.o_orderstatus = 'F' AS correct, o.o_orderdate AS happened, o.o_orderkey AS id
FROM @orders o JOIN @customer c ON o.o_custkey = c.c_custkey JOIN @nation n ON c.c_nationkey = n.n_nationkey JOIN @region r ON n.n_regionkey = r.r_regionkey"""
_STATE = f"""SELECT domain, topic, subtopic, count(*) AS attempted, count(CASE WHEN correct THEN 1 END) AS n_correct,
{{last}} AS status, max(happened) AS updated FROM ({_ATTEMPTS}) GROUP BY domain, topic, subtopic"""
_SPARK = _STATE.replace("{last}", "max_by(CASE WHEN correct THEN 'known' ELSE 'unknown' END, struct(happened, id))")
_DUCK = _STATE.replace("{last}", "arg_max(CASE WHEN correct THEN 'known' ELSE 'unknown' END, (happened, id))")


def _state(name: str, text: str) -> None:
    """A query over the components' states."""
    registry.add_sql(name, text.replace("{state}", _SPARK), text.replace("{state}", _DUCK))


_state("component_state", "SELECT domain, topic, subtopic, attempted, n_correct, status FROM ({state})")
_state("component_key", "SELECT CASE WHEN coalesce(domain, '') <> '' AND coalesce(topic, '') <> '' AND coalesce(subtopic, '') <> '' THEN concat_ws('->', domain, topic, subtopic) ELSE CAST(attempted AS STRING) END AS component, status FROM ({state})")
_state("mastery_by_domain", "SELECT domain, count(*) AS total, count(CASE WHEN status = 'known' THEN 1 END) AS known, count(CASE WHEN status <> 'known' THEN 1 END) AS unknown FROM ({state}) GROUP BY domain")
_state("mastery_by_topic", "SELECT concat_ws('->', domain, topic) AS topic_key, count(*) AS total, count(CASE WHEN status = 'known' THEN 1 END) AS known FROM ({state}) GROUP BY domain, topic")
_state("coverage_overall", "SELECT count(*) AS total, count(CASE WHEN status = 'known' THEN 1 END) AS known, CAST(floor(1e2 * count(CASE WHEN status = 'known' THEN 1 END) / count(*) + 0.5) AS BIGINT) AS coverage_pct, min(CASE WHEN status = 'unknown' THEN 1 ELSE 0 END) = 1 AS all_unknown FROM ({state})")
_state("coverage_band", "SELECT domain, CASE WHEN pct >= 80 THEN 'high' WHEN pct >= 60 THEN 'middle' ELSE 'low' END AS band FROM (SELECT domain, 1e2 * count(CASE WHEN status = 'known' THEN 1 END) / count(*) AS pct FROM ({state}) GROUP BY domain)")
_TOTALS = """SELECT s.domain, s.topic, s.subtopic, s.n_correct, s.attempted, t.total FROM ({state}) s
LEFT JOIN (SELECT r.r_name AS domain, n.n_name AS topic, c.c_mktsegment AS subtopic, count(*) AS total FROM @customer c JOIN @nation n ON c.c_nationkey = n.n_nationkey JOIN @region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name, c.c_mktsegment) t
ON s.domain = t.domain AND s.topic = t.topic AND s.subtopic = t.subtopic"""
_state("component_totals_left_join", _TOTALS)
_state("coverage_diagnosis", f"SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN total IS NULL THEN 'no_total' WHEN total = 0 THEN 'zero_total' WHEN n_correct > total THEN 'over' WHEN n_correct = total THEN 'complete' WHEN attempted = 0 THEN 'untried' ELSE 'partial' END AS bucket FROM ({_TOTALS})) GROUP BY bucket")
_DOMAINS = "SELECT domain, round(1e2 * sum(n_correct) / sum(attempted), 4) AS accuracy, CAST(sum(attempted) AS BIGINT) AS attempted FROM ({state}) GROUP BY domain"
_state("weak_domains", f"SELECT * FROM ({_DOMAINS}) WHERE accuracy < 70 ORDER BY accuracy, domain")
_state("strong_domains", f"SELECT * FROM ({_DOMAINS}) WHERE accuracy >= 90 ORDER BY accuracy DESC, domain")
_state("review_topk", "SELECT domain, topic, subtopic, round(1e2 * n_correct / attempted, 6) AS accuracy FROM ({state}) WHERE attempted > 0 AND (status = 'unknown' OR 1e2 * n_correct / attempted < 50) ORDER BY round(1e2 * n_correct / attempted, 6), domain, topic, subtopic LIMIT 20")
_state("recent_components", "SELECT domain, topic, subtopic, status FROM ({state}) ORDER BY updated DESC, domain, topic, subtopic LIMIT 20")
registry.add_sql("attempts_rollup", f"SELECT domain, topic, subtopic, count(*) AS attempted, count(CASE WHEN correct THEN 1 END) AS n_correct, count(CASE WHEN NOT correct THEN 1 END) AS n_wrong FROM ({_ATTEMPTS}) GROUP BY ROLLUP (domain, topic, subtopic) HAVING domain IS NOT NULL")
