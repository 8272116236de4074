"""Usage metering, activity logs and tutor conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.operators import sessions, usage
from lumenspark.plans.registry import Registry
from lumenspark.sources.tables import table

registry = Registry()

_CHARGES = "(SELECT event_id, user_id, epoch_us(ts) AS us, value / 1000 AS cost FROM events)"


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", us.alias("us"), (F.col("value") / 1000).alias("cost"))


registry.add_sql(
    "usage_totals",
    "SELECT user_id, round(sum(value / 1000), 6) AS cost_total, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS prompt_tokens, sum(event_id % 50) AS completion_tokens, count(*) AS request_count FROM @events GROUP BY user_id",
    "SELECT user_id, round(sum(value / 1000), 6) AS cost_total, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 50) AS BIGINT) AS completion_tokens, count(*) AS request_count FROM @events GROUP BY user_id",
)
registry.add_sql(
    "usage_recent_cost",
    "SELECT user_id, round(sum(CASE WHEN ts > (SELECT max(ts) FROM @events) - INTERVAL '6' HOUR THEN value / 1000 ELSE 0 END), 6) AS recent_cost FROM @events GROUP BY user_id",
)
registry.add_sql(
    "users_union",
    "SELECT DISTINCT user_id FROM (SELECT user_id FROM @events UNION SELECT c_custkey AS user_id FROM @customer)",
)
registry.add_sql(
    "usage_full_outer",
    """SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS n_clicks, coalesce(b.n, 0) AS n_purchases
FROM (SELECT user_id, count(*) AS n FROM @events WHERE event_type = 'click' GROUP BY user_id) a
FULL JOIN (SELECT user_id, count(*) AS n FROM @events WHERE event_type = 'purchase' GROUP BY user_id) b ON a.user_id = b.user_id""",
)


@registry.add("rolling_cost", f"SELECT event_id, user_id, round(sum(cost) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 179999999 PRECEDING AND CURRENT ROW), 6) AS window_cost FROM {_CHARGES}")
def rolling_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.rolling_cost(charges(spark, sf_dir)).select("event_id", "user_id", "window_cost")


_RETRY = f"""WITH c AS (SELECT *, (SELECT max(epoch_us(ts)) FROM events) AS now_us FROM {_CHARGES}),
w AS (SELECT * FROM c WHERE us > now_us - 21600000000),
l AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM w),
s AS (SELECT user_id, round(sum(cost), 6) AS window_cost, min(CASE WHEN later < 0.2 THEN greatest(0, CAST(floor((us + 21600000000 - now_us) / 1e6) AS BIGINT)) END) AS first FROM l GROUP BY user_id)
SELECT user_id, window_cost, CAST(CASE WHEN window_cost >= 0.2 THEN first ELSE 0 END AS BIGINT) AS retry_s FROM s"""


@registry.add("retry_after", _RETRY)
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = charges(spark, sf_dir)
    return usage.retry_after(c, c.agg(F.max("us").alias("now_us")), 6 * 3600, 0.2)


@registry.add("limit_status", f"SELECT user_id, window_cost, window_cost >= 0.2 AS limited FROM ({_RETRY})")
def limit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retry_after(spark, sf_dir).select("user_id", "window_cost", (F.col("window_cost") >= 0.2).alias("limited"))


@registry.add("admission_control")
def admission_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.admission(charges(spark, sf_dir), 6 * 3600, 0.2)


_PAIRED = """
WITH e AS (SELECT user_id, event_id, event_type, {us} AS us FROM @events WHERE event_type IN ('signup', 'error')),
p AS (SELECT *, lag(event_type) OVER w AS before, lag(us) OVER w AS start_us, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS back FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
n AS (SELECT max({us}) AS now_us FROM @events)
"""
_INTERVALS = _PAIRED + """
SELECT user_id, start_us, us AS end_us, CAST(floor((us - start_us) / 1e6) AS BIGINT) AS seconds FROM p WHERE event_type = 'error' AND before = 'signup'
UNION ALL
SELECT user_id, us, now_us, CAST(floor((now_us - us) / 1e6) AS BIGINT) FROM p CROSS JOIN n WHERE back = 1 AND event_type = 'signup'"""


def _both(name: str, text: str) -> None:
    registry.add_sql(name, text.replace("{us}", "unix_micros(CAST(ts AS TIMESTAMP))"), text.replace("{us}", "epoch_us(ts)"))


_both("session_intervals", _INTERVALS)
_both("session_time", f"SELECT user_id, CAST(sum(seconds) AS BIGINT) AS total_seconds, count(*) AS n_sessions FROM ({_INTERVALS}) GROUP BY user_id")
_IDLE = """WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) <= 900000000 THEN 0 ELSE 1 END AS opens FROM events),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_events FROM i GROUP BY user_id, island"""


@registry.add("inactivity_sessions", _IDLE)
def inactivity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timer operator of p6 over the event table; an event's id keeps it apart from others of its instant."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    entries = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_name"), us.alias("us"), F.lit("event").alias("list"), F.col("event_type").alias("name"), F.col("event_id").alias("question_id"))
    found = sessions.sessions_us(entries, sessions.GAP_MS * 1000)
    return found.select(F.col("user_name").cast("bigint").alias("user_id"), "start_us", "end_us", F.col("n_events").cast("bigint").alias("n_events"))


registry.add_sql("activity_feed", "SELECT event_id, user_id, event_type, CAST(ts AS STRING) AS at FROM @events ORDER BY ts DESC, event_id DESC LIMIT 100")
registry.sql["activity_feed"] = "SELECT event_id, user_id, event_type, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 100"
registry.add_sql("list_users", "SELECT DISTINCT user_name FROM @user_logs WHERE user_name IS NOT NULL ORDER BY user_name")
registry.add_sql(
    "log_usage_totals",
    "SELECT user_name, max(usage.request_count) AS request_count, max(usage.total_tokens) AS total_tokens, round(max(usage.cost_total), 6) AS cost_total FROM @user_logs WHERE user_name IS NOT NULL GROUP BY user_name",
)
registry.add_sql(
    "button_counts",
    "SELECT b.button AS button, count(*) AS n, count(DISTINCT b.question_id) AS n_questions FROM (SELECT explode(button_clicks) AS b FROM @user_logs) GROUP BY b.button",
    "SELECT b.button AS button, count(*) AS n, count(DISTINCT b.question_id) AS n_questions FROM (SELECT unnest(button_clicks) AS b FROM @user_logs) GROUP BY b.button",
)

_LATEST = "SELECT conv_id, user_name, {size} AS n_messages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY saved_at DESC NULLS LAST, {size} DESC) AS rn FROM @tutor_conversations) WHERE rn = 1"
registry.add_sql("conversation_latest", _LATEST.replace("{size}", "coalesce(size(messages), 0)"), _LATEST.replace("{size}", "CAST(coalesce(len(messages), 0) AS INTEGER)"))

_TURNS = """SELECT conv_id, max(turns) AS turns FROM (SELECT conv_id, CAST({n} AS BIGINT) AS turns FROM @tutor_conversations) GROUP BY conv_id"""
registry.add_sql(
    "tutor_turns",
    _TURNS.replace("{n}", "size(filter(coalesce(messages, array()), m -> trim(coalesce(m.`user`, '')) <> '' OR (m.role = 'user' AND trim(coalesce(m.content, '')) <> '')))"),
    _TURNS.replace("{n}", "len(list_filter(coalesce(messages, []), lambda m: trim(coalesce(m.\"user\", '')) <> '' OR (m.\"role\" = 'user' AND trim(coalesce(m.\"content\", '')) <> '')))"),
)
#: Phrases by which a student says not to know.
DONT_KNOW = ("毫无头绪", "不知道", "不明白", "i don't know", "don't know", "no idea", "not sure", "have no idea", "不清楚", "不懂", "没头绪")
#: Phrases by which a student asks for the answer.
WANTS_ANSWER = (
    "show me the answer", "tell me the answer", "what is the answer", "give me the answer", "reveal the answer", "want to see the answer",
    "想看答案", "告诉我答案", "答案是什么", "给我答案", "can i see the answer", "i want the answer", "please give me the answer",
)
#: Phrases by which a response gives the answer away.
GIVES_ANSWER = ("the correct answer is", "the answer is", "correct answer:", "answer:", "the right answer", "正确答案是", "答案是")


def any_of(column: str, phrases: tuple[str, ...]) -> str:
    """SQL of both dialects: the lower-cased column holds one of the phrases."""
    quoted = [p.replace("'", "''") for p in phrases]
    return "(" + " OR ".join(f"contains(lower({column}), '{p}')" for p in quoted) + ")"


def any_of_spark(column: str, phrases: tuple[str, ...]) -> str:
    return any_of(column, phrases).replace("''", "\\'")


#: The latest save of each conversation; an earlier one holds its first messages only.
SAVED = "(SELECT conv_id, max_by(messages, struct(saved_at, size(messages))) AS messages FROM @tutor_conversations GROUP BY conv_id)"
SAVED_DUCK = "(SELECT conv_id, arg_max(messages, (saved_at, len(messages))) AS messages FROM @tutor_conversations GROUP BY conv_id)"
_TEXTS = f"(SELECT conv_id, coalesce(m.`user`, CASE WHEN m.role = 'user' THEN m.content END) AS said, coalesce(m.assistant, CASE WHEN m.role = 'assistant' THEN m.content END) AS answered FROM (SELECT conv_id, explode(messages) AS m FROM {SAVED}))"
_TEXTS_DUCK = f"(SELECT conv_id, coalesce(m.\"user\", CASE WHEN m.\"role\" = 'user' THEN m.\"content\" END) AS said, coalesce(m.assistant, CASE WHEN m.\"role\" = 'assistant' THEN m.\"content\" END) AS answered FROM (SELECT conv_id, unnest(messages) AS m FROM {SAVED_DUCK}))"
#: (conv_id, pos, said): the student's turns, of either shape of a save. In older ones a tutor's message is a row of its own and no turn.
TURNS = f"(SELECT conv_id, pos, coalesce(m.`user`, CASE WHEN m.role = 'user' THEN m.content END) AS said FROM (SELECT conv_id, posexplode(messages) AS (pos, m) FROM {SAVED}) WHERE m.`user` IS NOT NULL OR coalesce(m.role, 'user') = 'user')"
TURNS_DUCK = f"(SELECT conv_id, pos - 1 AS pos, coalesce(m.\"user\", CASE WHEN m.\"role\" = 'user' THEN m.\"content\" END) AS said FROM (SELECT conv_id, generate_subscripts(messages, 1) AS pos, unnest(messages) AS m FROM {SAVED_DUCK}) WHERE m.\"user\" IS NOT NULL OR coalesce(m.\"role\", 'user') = 'user')"
for _name, _phrases, _column in (("dont_know_turns", DONT_KNOW, "said"), ("wants_answer", WANTS_ANSWER, "said"), ("answer_leak", GIVES_ANSWER, "answered")):
    _text = "SELECT conv_id, count(*) AS n_turns, count(CASE WHEN {hit} THEN 1 END) AS n_hits FROM {from} GROUP BY conv_id"
    registry.add_sql(
        _name,
        _text.replace("{hit}", any_of_spark(_column, _phrases)).replace("{from}", _TEXTS),
        _text.replace("{hit}", any_of(_column, _phrases)).replace("{from}", _TEXTS_DUCK),
    )
_LAST = "SELECT conv_id, rn AS back, said FROM (SELECT conv_id, said, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS rn FROM {turns}) WHERE rn <= 4"
registry.add_sql("last_k_turns", _LAST.replace("{turns}", TURNS), _LAST.replace("{turns}", TURNS_DUCK))
_ROUNDS = "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS round, said FROM {turns}"
registry.add_sql("conversation_rounds", _ROUNDS.replace("{turns}", TURNS), _ROUNDS.replace("{turns}", TURNS_DUCK))
registry.add_sql("users_by_cost", "SELECT user_id, round(sum(value / 1000), 6) AS cost_total FROM @events GROUP BY user_id ORDER BY cost_total DESC, user_id")
_BAND = "SELECT user_id, CASE WHEN cost >= 0.5 THEN 'limit' WHEN cost >= 0.8 * 0.5 THEN 'warn' ELSE 'normal' END AS band FROM (SELECT user_id, round(sum(CASE WHEN ts > (SELECT max(ts) FROM @events) - INTERVAL '6' HOUR THEN value / 1000 ELSE 0 END), 6) AS cost FROM @events GROUP BY user_id)"
registry.add_sql("usage_band", _BAND)
# Prices of a million tokens are a table; an unknown model has the price of the first one.
_PRICES = "(SELECT * FROM (VALUES ('small', CAST(0.5 AS DOUBLE), CAST(1.5 AS DOUBLE)), ('large', 5, 15)) AS t(model, price_in, price_out))"
_COST = f"""SELECT u.user_id, round(sum((u.n_in * coalesce(p.price_in, CAST(0.5 AS DOUBLE)) + u.n_out * coalesce(p.price_out, CAST(1.5 AS DOUBLE))) / 1000000), 9) AS cost
FROM (SELECT user_id, CASE event_type WHEN 'view' THEN 'small' WHEN 'click' THEN 'large' ELSE event_type END AS model, CAST({{k}} AS BIGINT) AS n_in, event_id % 50 AS n_out FROM @events) u
LEFT JOIN {_PRICES} p ON u.model = p.model GROUP BY u.user_id"""
registry.add_sql("token_cost", _COST.replace("{k}", "get_json_object(props, '$.k')"), _COST.replace("{k}", "json_extract_string(props, '$.k')"))
#: Words by which a student asks for a hint.
ASKS_HINT = ("hint", "help", "clue", "guide", "stuck", "don't understand", "confused", "explain", "提示", "帮助", "不懂", "不明白", "给我提示")
# The letter a student names in a turn is the answer given; a request for a hint outweighs a wrong answer.
_HINT = """SELECT conv_id, pos, CASE WHEN {asks} THEN 'student_request' WHEN given <> '' AND answer <> '' AND given <> answer THEN 'wrong_answer' ELSE 'no_trigger' END AS reason
FROM (SELECT t.conv_id, t.pos, coalesce(t.said, '') AS said, coalesce(regexp_extract(t.said, '(?:^|[^A-Za-z])([A-H])(?:[^A-Za-z]|$)', 1), '') AS given, coalesce(upper(trim(b.correct_answer)), '') AS answer
FROM {turns} t JOIN (SELECT conv_id, max(question_id) AS question_id FROM @tutor_conversations GROUP BY conv_id) q ON t.conv_id = q.conv_id
LEFT JOIN (SELECT question_id, min(correct_answer) AS correct_answer FROM @qbank_amboss_openai_evaluated GROUP BY question_id) b ON q.question_id = b.question_id)"""
registry.add_sql("hint_trigger", _HINT.replace("{asks}", any_of_spark("said", ASKS_HINT)).replace("{turns}", TURNS), _HINT.replace("{asks}", any_of("said", ASKS_HINT)).replace("{turns}", TURNS_DUCK))
#: Marks of a tutor's message that holds hints.
HOLDS_HINTS = ("knowledge_blocks", "hint_questions")
_ROUND = "SELECT conv_id, 1 + count(CASE WHEN {hit} THEN 1 END) AS round FROM {from} GROUP BY conv_id"
registry.add_sql("hint_round", _ROUND.replace("{hit}", any_of_spark("answered", HOLDS_HINTS)).replace("{from}", _TEXTS), _ROUND.replace("{hit}", any_of("answered", HOLDS_HINTS)).replace("{from}", _TEXTS_DUCK))
#: A question put earlier stands after its mark in a tutor's message.
_PUT = r"[🤔❓]\s*([^\n]+)"
registry.add_sql(
    "earlier_questions",
    f"SELECT conv_id, trim(q) AS question FROM (SELECT conv_id, explode(regexp_extract_all(answered, r'{_PUT}', 1)) AS q FROM {_TEXTS}) WHERE trim(q) <> ''",
    f"SELECT conv_id, trim(q) AS question FROM (SELECT conv_id, unnest(regexp_extract_all(answered, '{_PUT}', 1)) AS q FROM {_TEXTS_DUCK}) WHERE trim(q) <> ''",
)
registry.add_sql(
    "profile_summary",
    "SELECT log_id, CASE WHEN get_json_object(knowledge_profile, '$.questionsAnswered') IS NOT NULL THEN concat('Answered: ', get_json_object(knowledge_profile, '$.questionsAnswered')) ELSE left(knowledge_profile, 80) END AS summary FROM @user_logs",
    "SELECT log_id, CASE WHEN json_valid(knowledge_profile) AND json_extract_string(knowledge_profile, '$.questionsAnswered') IS NOT NULL THEN concat('Answered: ', json_extract_string(knowledge_profile, '$.questionsAnswered')) ELSE left(knowledge_profile, 80) END AS summary FROM @user_logs",
)
