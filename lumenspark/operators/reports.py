"""Views and reports over logs and states: rendered as text columns, written by the usual sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band(share: Column) -> Column:
    return F.when(share >= 80, "good").when(share >= 60, "fair").otherwise("weak")


def mastery_report(states: DataFrame) -> DataFrame:
    """(user, report): for each user of (user, domain, topic, subtopic, status) a text with the overall share known, and each domain's."""
    domains = states.groupBy("user", "domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "known").alias("k"))
    share = lambda k, n: F.floor(F.lit(100.0) * k / n + 0.5).cast("int")
    line = F.format_string("%s: %d of %d known (%d%%, %s)", "domain", "k", "n", share(F.col("k"), F.col("n")), band(F.lit(100.0) * F.col("k") / F.col("n")))
    # A user's domains are a curriculum's: a short list.
    each = domains.withColumn("line", line).groupBy("user").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.array_sort(F.collect_list("line")).alias("lines"))
    head = F.format_string("%d of %d known (%d%%)", "k", "n", share(F.col("k"), F.col("n")))
    return each.select("user", F.concat(head, F.lit("\n"), F.array_join("lines", "\n")).alias("report"))


def tracking_report(states: DataFrame, recent: int = 20) -> DataFrame:
    """(user, report): the components updated last, by time, then by name."""
    order = Window.partitionBy("user").orderBy(F.desc("updated"), "domain", "topic", "subtopic")
    last = states.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= recent)
    line = F.format_string("%s->%s->%s: %s, %d of %d", "domain", "topic", "subtopic", "status", "correct", "attempted")
    return last.groupBy("user").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), "\n").alias("report"))


def dumped_texts(chunks: DataFrame) -> DataFrame:
    """(source, page, text): a row for each page, its pieces in order; files are never gathered whole."""
    return chunks.groupBy("source", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x["chunk"]), "\n\n").alias("text"))


def user_log_view(sessions: DataFrame, turns: DataFrame, usage: DataFrame) -> DataFrame:
    """(user_name, total_seconds, total_minutes, turns, cost_total, request_count): statistics are views of the appended rows, so nothing is rewritten; missing totals are 0."""
    time = sessions.groupBy("user_name").agg(F.sum(F.floor(F.col("duration_ms") / 1000)).alias("s"))
    said = turns.groupBy("user_name").agg(F.sum("turns").alias("turns"))
    both = time.join(said, "user_name", "full").join(usage.select("user_name", "cost_total", "request_count"), "user_name", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select("user_name", zero("s").cast("bigint").alias("total_seconds"), F.round(zero("s") / 60, 2).alias("total_minutes"), zero("turns").cast("bigint").alias("turns"), F.coalesce("cost_total", F.lit(0.0)).alias("cost_total"), zero("request_count").cast("bigint").alias("request_count"))


def user_key(login: Column, session: Column, address: Column) -> Column:
    """The first of login, session and address that isn't blank, with its kind, 64 characters of it; the address uncut, unknown without any."""
    of = lambda kind, v: F.when(F.trim(v) != "", F.left(F.concat(F.lit(kind), F.trim(v)), F.lit(64)))
    return F.coalesce(of("user:", login), of("sess:", session), F.concat(F.lit("ip:"), F.coalesce(F.nullif(address, F.lit("")), F.lit("unknown"))))


def simulated_answer(key: Column, options: Column, correct: Column, share: float) -> Column:
    """The correct letter with the given probability, else one of the others (the first letter if there is none); the same for the same key."""
    u = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1e6
    others = F.array_sort(F.filter(F.map_keys(options), lambda k: k != correct))
    pick = F.get(others, F.pmod(F.xxhash64(key, F.lit(1)), F.greatest(F.size(others), F.lit(1))).cast("int"))
    return F.when(u < share, correct).otherwise(F.coalesce(pick, F.get(F.array_sort(F.map_keys(options)), F.lit(0))))


def parsed_by_type(files: DataFrame, parsers: dict) -> DataFrame | None:
    """Files of (kind, ...) each given to the parser of its kind, the results together; kinds without a parser give nothing."""
    out = None
    for kind, parse in sorted(parsers.items()):
        part = parse(files.filter(F.col("kind") == kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def bank_folder(name: Column) -> Column:
    """Whether a folder is read: not those that hold questions without answers, but always those of the second kind of bank."""
    return ~(name.contains("Questions") & ~name.contains("Answers") & ~F.lower(name).contains("amboss"))
