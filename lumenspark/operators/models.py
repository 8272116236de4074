"""External models as plug-in functions over Arrow batches: prompts in, replies out, replies parsed into typed columns.

A model is any function from a list of prompts to a list of replies. It runs where the
rows are, in batches; what a batch's call raises becomes the rows' error, and null or
broken replies become null fields, so one bad reply never ends a job. ``fake_model``
gives replies that hang on the prompt only, for tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.functions.records import label_score, salvaged

Model = Callable[[list[str]], list[str]]


def rendered(template: str, **values: Column) -> Column:
    """The template with each ``$NAME$`` replaced by its value; null values are empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"${name.upper()}$"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def replied(rows: DataFrame, prompt: str, model: Model, batch: int = 16, tries: int = 2) -> DataFrame:
    """Rows with ``reply`` and ``error``: the model is called with batches of prompts, again if it fails."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                prompts, replies, error = [p or "" for p in part.column(prompt).to_pylist()], None, None
                for _ in range(tries):
                    try:
                        replies, error = list(model(prompts)), None
                        if len(replies) != len(prompts):
                            raise ValueError("the model gave another number of replies")
                        break
                    except Exception as e:  # noqa: BLE001 - a plug-in may fail in any way
                        replies, error = None, str(e)
                n = len(prompts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(replies or [None] * n, pa.string()), pa.array([error] * n, pa.string())], names=[*part.schema.names, "reply", "error"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kept}, reply string, error string")


def objects(reply: Column, schema: str) -> Column:
    """The list of objects in a reply: its root, or the list under ``questions``, ``items`` or ``data``, or one object alone; null where nothing can be read."""
    list_ = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    one = salvaged(reply)
    under = F.from_json(one, f"questions array<{schema}>, items array<{schema}>, data array<{schema}>, domains array<{schema}>")
    held = F.coalesce(under["questions"], under["items"], under["data"], under["domains"])
    bare = F.ltrim(F.regexp_replace(reply, r"(?s)^.*?```(?:json)?\s*", "")).startswith("[")
    return F.when(bare, F.from_json(list_, f"array<{schema}>")).otherwise(F.coalesce(held, F.array(F.from_json(one, schema))))


QUESTION = "struct<question:string,options:map<string,string>,correct_answer:string,explanations:map<string,string>,difficulty:string>"


def questions(rows: DataFrame, prompt: str, model: Model) -> DataFrame:
    """Rows with the questions of the model's replies, one each; whether they are usable is told by ``generated_question_filter``."""
    asked = replied(rows, prompt, model)
    return asked.select(*rows.columns, "error", F.explode_outer(objects(F.col("reply"), QUESTION)).alias("q")).select(*rows.columns, "error", "q.*")


def judged(rows: DataFrame, prompt: str, model: Model, labels: tuple[str, ...]) -> DataFrame:
    """Rows with ``evaluation_text`` and a score under each label of the model's reply, null where it has none."""
    asked = replied(rows, prompt, model)
    return asked.select(*rows.columns, "error", F.col("reply").alias("evaluation_text"), *(F.when(F.contains("reply", F.lit(x)), label_score(F.col("reply"), x)).alias(x) for x in labels))


def steps(rows: DataFrame, prompt: str, model: Model) -> DataFrame:
    """Rows with the parts into which the model takes a question apart, and their place."""
    asked = replied(rows, prompt, model)
    held = objects(F.col("reply"), "struct<question:string,concept:string>")
    return asked.select(*rows.columns, "error", F.posexplode_outer(held).alias("place", "s")).select(*rows.columns, "error", "place", "s.*")


def classified(rows: DataFrame, prompt: str, model: Model, fields: str) -> DataFrame:
    """Rows with the fields (as a schema) of the one object in the model's reply."""
    asked = replied(rows, prompt, model)
    return asked.select(*rows.columns, "error", F.from_json(salvaged(F.col("reply")), fields).alias("v")).select(*rows.columns, "error", "v.*")


def fake_model(reply: Callable[[str, int], str]) -> Model:
    """A model whose reply hangs on the prompt and on a number made of it only."""
    return lambda prompts: [reply(p, int(hashlib.md5(p.encode()).hexdigest()[:8], 16)) for p in prompts]
