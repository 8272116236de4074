"""File sources and sinks with explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCORES = "struct<evaluation_text:string,question_clarity:double,option_quality:double,explanation_quality:double,medical_accuracy:double,overall_quality:double,total_score:double>"
QUESTION = f"question string, options map<string,string>, correct_answer string, tip string, explanation string, explanations map<string,string>, option_explanations map<string,string>, images array<string>, source string, source_file string, page_number int, llm_judge_evaluation {_SCORES}"
DOMAINS = "domains array<struct<name:string,level:string,topics:array<struct<name:string,subtopics:array<string>>>>>"
USER_LOG = "user string, events array<struct<event:string,timestamp:string,profile:string>>, button_clicks array<struct<timestamp:string,button:string,question_id:bigint>>, usage struct<cost_total:double,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,request_count:bigint>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question files, a list or an object with ``questions``; a question keeps its file and its place there."""
    held = QUESTION.replace("struct<", "STRUCT<")
    wrapped = spark.read.schema(f"questions array<struct<{_fields(held)}>>, {QUESTION}").json(path, multiLine=True)
    listed = F.when(F.col("questions").isNotNull(), F.col("questions")).otherwise(F.array(F.struct(*(F.col(c) for c in _names(QUESTION)))))
    rows = wrapped.select(F.col("_metadata.file_path").alias("file"), F.posexplode(listed).alias("position", "q"))
    return rows.select("file", "position", "q.*")


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f.name for f in StructType.fromDDL(schema).fields]


def _fields(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Curriculum files, one row for each, with the domains as received."""
    return spark.read.schema(DOMAINS).json(path, multiLine=True).select(F.col("_metadata.file_name").alias("file_name"), "domains")


def read_user_logs(spark: SparkSession, path: str) -> DataFrame:
    """A folder of user logs; malformed files are left out, the user is the file's name where the file doesn't say."""
    logs = spark.read.schema(USER_LOG).json(path, multiLine=True, mode="DROPMALFORMED")
    name = F.regexp_replace("_metadata.file_name", r"\.json$", "")
    return logs.select(F.coalesce("user", name).alias("user_name"), "events", "button_clicks", "usage")


def read_binary(spark: SparkSession, path: str, pattern: str, extract: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """(source, page, text, error) of files by an extractor of page texts; a file that fails gives a row with its error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows += [(source, n, t, None) for n, t in enumerate(extract(content), 1)]
                except Exception as e:  # noqa: BLE001 - a plug-in may fail in any way
                    rows.append((source, None, None, str(e)))
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["source", "page", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInArrow(run, "source string, page int, text string, error string")


def image_page(name: Column) -> Column:
    """The page of an image by its file's name, in the newer form (``page_3_img_1``) or the older (``p3_1``)."""
    new, old = F.regexp_extract(name, r"page_(\d+)_img", 1), F.regexp_extract(name, r"(?:^|/)p(\d+)_\d+", 1)
    return F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit(""))).cast("int")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, a file for each partition; non-ASCII letters are kept."""
    df.write.mode("overwrite").json(path)


def write_report(questions: DataFrame, path: str) -> None:
    """A text block for each question: text, options in order, answer."""
    entries = F.array_sort(F.map_entries("options"))
    shown = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(". "), F.coalesce(e["value"], F.lit("")))), "\n")
    block = F.concat_ws("\n", "question", shown, F.concat(F.lit("Answer: "), F.coalesce("correct_answer", F.lit("?"))), F.lit(""))
    questions.select(block.alias("value")).write.mode("overwrite").text(path)
