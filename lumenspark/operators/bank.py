"""Question bank operators: filters, deduplication, merging, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LETTERS = ("A", "B", "C", "D")


def generated_question_filter(questions: DataFrame) -> DataFrame:
    """Questions with options A to D all present and an answer among them; explanations padded and trimmed, difficulty defaulted."""
    kept = F.map_filter("options", lambda k, v: k.isin(*LETTERS))
    answer = F.upper(F.trim("correct_answer"))
    padded = F.map_from_arrays(F.array(*map(F.lit, LETTERS)), F.array(*(F.trim(F.coalesce(F.element_at("explanations", F.lit(x)), F.lit(""))) for x in LETTERS)))
    good = questions.withColumn("options", kept).withColumn("correct_answer", answer)
    good = good.filter((F.size("options") == len(LETTERS)) & F.col("correct_answer").isin(*LETTERS))
    return good.withColumn("explanations", padded).withColumn("difficulty", F.coalesce(F.lower("difficulty"), F.lit("medium")))


def keep_best(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given, by aggregation; nothing is sorted within a key."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("best")).select("best.*")


def merge_banks(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of the second, then of the first, each with its bank; columns that one lacks are null."""
    return second.withColumn("bank", F.lit(2)).unionByName(first.withColumn("bank", F.lit(1)), allowMissingColumns=True)


def override(rows: DataFrame, news: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with the column's value replaced where a new one is given."""
    new = news.select(key, F.col(column).alias("__new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def orphans(rows: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """New values for rows that don't exist."""
    return news.join(rows.select(key), key, "left_anti")


def sample_per_group(rows: DataFrame, group: str, id_col: str, n: int) -> DataFrame:
    """n rows of each group in the order of the id's hash; a group's rows are first thinned in salted parts, so no task holds a whole group."""
    key = F.md5(F.col(id_col).cast("string"))
    salted = rows.withColumn("__k", key).withColumn("__salt", F.substring("__k", 1, 2))
    part = Window.partitionBy(group, "__salt").orderBy("__k", id_col)
    thinned = salted.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= n)
    whole = Window.partitionBy(group).orderBy("__k", id_col)
    return thinned.withColumn("__r", F.row_number().over(whole)).filter(F.col("__r") <= n).drop("__k", "__salt", "__r")


def overlapping_batches(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """(source, batch, page): each page in every batch that reaches it, through an equi-join of sequences instead of a range join."""
    first = F.greatest(F.lit(0), F.ceil((F.col("page") - size - overlap + 1) / size)).cast("bigint")
    last = F.floor((F.col("page") + overlap) / size).cast("bigint")
    return pages.select("source", "page", F.explode(F.sequence(first, last)).alias("batch")).select("source", "batch", "page")
