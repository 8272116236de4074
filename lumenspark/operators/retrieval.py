"""Vector retrieval: normalisation, exact top-k, late-interaction rerank, chunking, keyword search."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def l2_normalised(vector: Column) -> Column:
    """The vector in double precision divided by its norm; a zero vector stays as it is."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def scored(vectors: DataFrame, query: list[float], vector_col: str = "embedding") -> DataFrame:
    """Rows with the inner product of the normalised vector and the query: one matrix product for each Arrow batch."""
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf("double")
    def score(batch):  # noqa: ANN001, ANN202
        import pandas as pd

        m = np.stack(batch.to_numpy()).astype(np.float64)
        norms = np.linalg.norm(m, axis=1)
        return pd.Series((m @ q) / np.where(norms > 0, norms, 1.0))

    return vectors.filter(F.size(vector_col) == len(q)).withColumn("score", score(vector_col))


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id") -> DataFrame:
    """The k best rows; Spark takes k of each partition and merges, so nothing is sorted as a whole."""
    return scored(vectors, query).orderBy(F.desc("score"), id_col).limit(k)


def top_k_per_group(vectors: DataFrame, query: list[float], group: str, k: int, id_col: str = "vec_id") -> DataFrame:
    """The k best rows of each group, first of salted parts of the group, so no task sorts a whole one."""
    rows = scored(vectors, query).select(group, F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("id")).alias("r"), (F.xxhash64(id_col) % 64).alias("salt"))
    salted = Window.partitionBy(group, "salt").orderBy("r")
    first = rows.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= k)
    whole = Window.partitionBy(group).orderBy("r")
    best = first.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
    return best.select(group, F.col("r.id").alias(id_col), (-F.col("r.s")).alias("score"), "rank")


def pairs_above(vectors: DataFrame, threshold: float, id_col: str = "vec_id", seed: int = 7) -> DataFrame:
    """(a, b, score), a < b: pairs of normalised vectors whose inner product reaches the threshold, in blocks.

    The rows are dealt into blocks and each pair of blocks is one task's matrix
    product; every vector is sent to as many tasks as there are blocks.
    """
    n = vectors.count()
    blocks = max(1, int(np.ceil(n / 4096)))
    own = vectors.select(F.col(id_col).alias("id"), F.col("embedding").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = own.withColumn("o", other).select("id", "v", "block", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"))

    def compare(key, rows):  # noqa: ANN001, ANN202
        import pandas as pd

        m = np.stack(rows["v"].to_numpy()).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids, block = rows["id"].to_numpy(), rows["block"].to_numpy()
        left, right = np.flatnonzero(block == key[0]), np.flatnonzero(block == key[1])
        s = m[left] @ m[right].T
        i, j = np.nonzero(s >= threshold)
        a, b = ids[left[i]], ids[right[j]]
        keep = a != b if key[0] != key[1] else a < b
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        return pd.DataFrame({"a": lo[keep], "b": hi[keep], "score": s[i, j][keep]})

    return sent.groupBy("x", "y").applyInPandas(compare, "a bigint, b bigint, score double")


def tokens(vector: Column, width: int = 8) -> Column:
    """A vector as a list of normalised token vectors of the given width."""
    v = vector.cast("array<double>")
    cut = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(width)), lambda i: F.slice(v, i, width))
    return F.transform(cut, l2_normalised)


def maxsim(candidates: DataFrame, query: list[float], width: int = 8) -> DataFrame:
    """Candidates with their late-interaction score: for each query token the best of the candidate's tokens, summed."""
    q = np.asarray(query, np.float64).reshape(-1, width)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    query_tokens = F.array(*(F.array(*map(F.lit, map(float, t))) for t in q))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = tokens(F.col("embedding"), width)
    best = F.transform(query_tokens, lambda t: F.array_max(F.transform(own, lambda d: dot(t, d))))
    return candidates.withColumn("maxsim", F.aggregate(best, F.lit(0.0), lambda s, x: s + x))


def two_stage(vectors: DataFrame, query: list[float], k1: int = 30, k2: int = 5, id_col: str = "vec_id") -> DataFrame:
    """The k1 best by inner product, of them the k2 best by late interaction; at most k2 candidates are not reranked."""
    first = top_k(vectors, query, k1, id_col)
    return maxsim(first, query).orderBy(F.desc("maxsim"), id_col).limit(k2)


def fixed_chunks(documents: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(doc_id, chunk_no, chunk): windows of so many characters every size - overlap."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - F.lit(overlap + 1)).cast("int"), F.lit(stride))
    cut = documents.filter(F.length("text") > 0).select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "start"))
    return cut.select("doc_id", "chunk_no", F.substring("text", F.col("start") + 1, F.lit(size)).alias("chunk"))


def recursive_chunks(documents: DataFrame, size: int = 4096, overlap: int = 400) -> DataFrame:
    """(doc_id, chunk_no, chunk): pieces of at most size characters cut at the coarsest of blank line, line, sentence, space; neighbours share up to overlap characters."""
    separators = ("\n\n", "\n", ". ", " ", "")

    def cut(text: str, level: int = 0) -> list[str]:
        if len(text) <= size:
            return [text]
        if separators[level] == "":
            return [text[i : i + size] for i in range(0, len(text), size)]
        parts = [p + separators[level] for p in text.split(separators[level])]
        parts[-1] = parts[-1][: -len(separators[level])]
        return [y for p in parts if p for y in (cut(p, level + 1) if len(p) > size else [p])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, numbers, chunks = [], [], []
            for i in range(b.num_rows):
                held, n = "", 0
                out = []
                for p in cut(b.column("text")[i].as_py()):
                    if held and len(held) + len(p) > size:
                        out.append(held)
                        held = held[max(0, len(held) - min(overlap, size - len(p))) :] if len(p) < size else ""
                    held += p
                out.append(held)
                for c in (x.strip() for x in out):
                    if c:
                        ids.append(b.column("doc_id")[i].as_py())
                        numbers.append(n)
                        chunks.append(c)
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], names=["doc_id", "chunk_no", "chunk"])

    return documents.filter(F.length("text") > 0).select("doc_id", "text").mapInArrow(run, "doc_id bigint, chunk_no int, chunk string")


def keyword_search(documents: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(doc_id, hits): the documents with the most distinct words of the query."""
    wanted = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    hits = F.size(F.array_intersect(words, F.array(*map(F.lit, wanted))))
    return documents.select("doc_id", hits.cast("bigint").alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(k)


def embed(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], text_col: str = "text", batch: int = 100) -> DataFrame:
    """Rows with an embedding column, by an encoder that takes lists of texts (a model, or hashed_encoder in tests)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                m = np.asarray(encoder([x or "" for x in part.column(text_col).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(m), pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(run, f"{kept}, embedding array<float>")


def hashed_encoder(texts: list[str], width: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: word hashes added up and normalised."""
    import zlib

    out = np.zeros((len(texts), width), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % width] += 1 if h & 0x10000 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def build_index(chunks: DataFrame, encoder: Callable[[list[str]], np.ndarray], path: str) -> None:
    """Texts and normalised vectors in one table: a new version beside the old one, which readers see once it is whole.

    The name of the current version is a small table of its own, written last; older versions are deleted after that.
    """
    version = f"v{time.time_ns()}"
    embed(chunks, encoder, "chunk").withColumn("embedding", l2_normalised(F.col("embedding"))).write.parquet(f"{path}/{version}")
    spark = chunks.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/current")
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)):
        name = status.getPath().getName()
        if name.startswith("v") and name < version:
            files.delete(status.getPath(), True)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that is whole."""
    version = spark.read.schema("version string").parquet(f"{path}/current").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/{version}")


def load_or_build(chunks: DataFrame, encoder: Callable[[list[str]], np.ndarray], path: str) -> DataFrame:
    """The index at the path, built first where there is none."""
    spark = chunks.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build_index(chunks, encoder, path)
    return load_index(spark, path)


def reranked(candidates: DataFrame, scorer: Callable[[list[str]], Iterable[float]] | None, k: int, text_col: str = "chunk", id_col: str = "vec_id") -> DataFrame:
    """The k best candidates by a scorer of their texts; without one, or with at most k candidates, by their own score.

    A scorer that fails gives its batch no rerank score, and those rows keep their order behind the others.
    """
    if scorer is None:
        return candidates.orderBy(F.desc("score"), id_col).limit(k)

    @F.pandas_udf("double")
    def of(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        try:
            return pd.Series(list(scorer(texts.fillna("").tolist())), dtype="float64")
        except Exception:  # noqa: BLE001 - a plug-in may fail in any way
            return pd.Series([None] * len(texts), dtype="float64")

    return candidates.withColumn("rerank", of(text_col)).orderBy(F.desc_nulls_last("rerank"), F.desc("score"), id_col).limit(k)
