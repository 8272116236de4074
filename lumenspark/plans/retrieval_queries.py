"""Vector and keyword retrieval over the embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.operators import retrieval
from lumenspark.plans.registry import Registry
from lumenspark.sources.tables import table

registry = Registry()
_NORM = "(SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"
_SCORE = f"(SELECT d.vec_id, d.label, d.e, list_inner_product(d.e, q.e) / (d.n * q.n) AS score FROM {_NORM} d, (SELECT e, n FROM {_NORM} WHERE vec_id = 0) q)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _query(vectors: DataFrame) -> list[float]:
    """The query is one vector of the table."""
    return vectors.filter("vec_id = 0").select("embedding").first()[0]


@registry.add("l2_normalise", "SELECT vec_id, round(list_sum(list_transform(e, lambda x: (x / n) * (x / n))), 6) AS squares, round(e[1] / n, 6) AS first FROM " + _NORM)
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select("vec_id", retrieval.l2_normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squares"), F.round(F.col("v")[0], 6).alias("first"))


@registry.add("vector_topk", f"SELECT vec_id, round(score, 6) AS score FROM {_SCORE} ORDER BY score DESC, vec_id LIMIT 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return retrieval.top_k(v, _query(v), 5).select("vec_id", F.round("score", 6).alias("score"))


@registry.add("vector_topk_per_label", f"SELECT label, vec_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INT) AS rank FROM {_SCORE}) WHERE rank <= 3")
def vector_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return retrieval.top_k_per_group(v, _query(v), "label", 3).select("label", "vec_id", F.round("score", 6).alias("score"), "rank")


@registry.add("vector_all_pairs_threshold", f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.e, b.e) / (a.n * b.n), 6) AS score FROM {_NORM} a JOIN {_NORM} b ON a.vec_id < b.vec_id WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.35")
def vector_all_pairs_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.pairs_above(_vectors(spark, sf_dir), 0.35).select("a", "b", F.round("score", 6).alias("score"))


_TOKENS = "list_transform(generate_series(1, 57, 8), lambda i: list_slice({e}, i, i + 7))"
_UNIT = "list_transform({t}, lambda t: list_transform(t, lambda x: x / sqrt(list_inner_product(t, t))))"
_T = _UNIT.format(t=_TOKENS.format(e="{e}"))
_FIRST = f"(SELECT vec_id, e, score FROM {_SCORE} ORDER BY score DESC, vec_id LIMIT 30)"
_MAXSIM = f"""SELECT vec_id, sum(best) AS maxsim FROM (SELECT f.vec_id, qi, max(list_inner_product(q, d)) AS best
FROM (SELECT vec_id, unnest({_T.replace('{e}', 'e')}) AS d FROM {_FIRST}) f,
(SELECT generate_subscripts(ts, 1) AS qi, unnest(ts) AS q FROM (SELECT {_T.replace('{e}', 'e')} AS ts FROM {_NORM} WHERE vec_id = 0)) q GROUP BY f.vec_id, qi) GROUP BY vec_id"""


@registry.add("maxsim_rerank", f"SELECT vec_id, round(maxsim, 6) AS maxsim FROM ({_MAXSIM})")
def maxsim_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    q = _query(v)
    return retrieval.maxsim(retrieval.top_k(v, q, 30), q).select("vec_id", F.round("maxsim", 6).alias("maxsim"))


@registry.add("two_stage_search", f"SELECT vec_id, round(maxsim, 6) AS maxsim FROM ({_MAXSIM}) ORDER BY maxsim DESC, vec_id LIMIT 5")
def two_stage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return retrieval.two_stage(v, _query(v)).select("vec_id", F.round("maxsim", 6).alias("maxsim"))


_WANTED = ("duplex", "scanning", "carotid", "bruit", "stroke")


@registry.add("keyword_search", "SELECT doc_id, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ['duplex', 'scanning', 'carotid', 'bruit', 'stroke'])) AS BIGINT) AS hits FROM documents ORDER BY hits DESC, doc_id LIMIT 10")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_search(table(spark, sf_dir, "documents"), " ".join(_WANTED))


@registry.add("chunk_fixed_stride", "SELECT doc_id, CAST(c AS INT) AS chunk_no, substring(text, c * 900 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, length(text) - 101) // 900)) AS c FROM documents WHERE length(text) > 0)")
def chunk_fixed_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fixed_chunks(table(spark, sf_dir, "documents"))


@registry.add("chunk_recursive")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recursive_chunks(table(spark, sf_dir, "documents"))
