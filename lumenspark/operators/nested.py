"""Nested curriculum records turned into flat tables that keep parent and child.

One depth-first visit of a record emits each entity once, tagged with the table
it belongs to, its own key, its parent's key and its payload; the tagged rows are
written partitioned by tag, and each table is read back under its schema. A key
is the path of 1-based positions below the file (``17/2/1``), so it can be made
without a counter, a join or any exchange of rows.

Defined cases: an entry that is null, is no object (no text, for a subtopic), or
whose name is missing, blank or no text is left out with all below it and keeps
its position; a single value where a list is expected is a list of one; text that
is no valid JSON gives no rows; of repeated rows of a file one remains; a row with
both columns is read from ``domains``, one with neither gives only its file; other
columns are ignored, and an empty table gives empty tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGGED = "tag string, file_id bigint, key string, parent_key string, domain_no bigint, topic_no bigint, subtopic_no bigint, leaf boolean, payload string"
_ARROW = pa.schema([("tag", pa.string()), ("file_id", pa.int64()), ("key", pa.string()), ("parent_key", pa.string()), ("domain_no", pa.int64()), ("topic_no", pa.int64()), ("subtopic_no", pa.int64()), ("leaf", pa.bool_()), ("payload", pa.string())])
#: Schema of each table's payload.
PAYLOADS = {
    "file": "file_name string, campus string",
    "domain": "name string, level string",
    "topic": "name string, note string",
    "subtopic": "name string, hours bigint",
}
_BATCH = 20_000


def _list(value: object) -> list:
    if value is None:
        return []
    return value if isinstance(value, list) else [value]


def _name(value: object) -> str | None:
    name = value.get("name") if isinstance(value, dict) else None
    return name if isinstance(name, str) and name.strip() else None


def _domains(raw: str) -> list:
    """The list of domains of a file's JSON text."""
    try:
        root = json.loads(raw)
    except (ValueError, RecursionError):
        return []
    if isinstance(root, dict):
        for under in ("domains", "data"):
            if under in root:
                return _list(root[under])
    return _list(root)


def visit(file_id: int | None, domains: list, about: dict) -> Iterator[tuple]:
    """Depth-first: (tag, file, key, parent, the three positions, leaf, payload) of every entity."""
    top = str(file_id)
    yield "file", file_id, top, None, 0, 0, 0, False, about
    for d, domain in enumerate(domains, 1):
        if (name := _name(domain)) is None:
            continue
        topics = [(t, x) for t, x in enumerate(_list(domain.get("topics")), 1) if _name(x) is not None]
        yield "domain", file_id, f"{top}/{d}", top, d, 0, 0, not topics, {"name": name, "level": domain.get("level")}
        for t, topic in topics:
            leaves = []
            for s, sub in enumerate(_list(topic.get("subtopics")), 1):
                held = sub if isinstance(sub, str) and sub.strip() else _name(sub)
                if held is not None:
                    hours = sub.get("hours") if isinstance(sub, dict) else None
                    leaves.append((s, {"name": held, "hours": hours if isinstance(hours, int) else None}))
            note = topic.get("note")
            yield "topic", file_id, f"{top}/{d}/{t}", f"{top}/{d}", d, t, 0, not leaves, {"name": _name(topic), "note": None if note is None else json.dumps(note, ensure_ascii=False)}
            for s, payload in leaves:
                yield "subtopic", file_id, f"{top}/{d}/{t}/{s}", f"{top}/{d}/{t}", d, t, s, True, payload


def _emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    for b in batches:
        for i in range(b.num_rows):
            r = {k: b.column(k)[i].as_py() for k in ("file_id", "file_name", "campus", "domains", "raw_json")}
            domains = r["domains"] if r["domains"] is not None else _domains(r["raw_json"]) if r["raw_json"] is not None else []
            for *keys, payload in visit(r["file_id"], domains, {"file_name": r["file_name"], "campus": r["campus"]}):
                rows.append((*keys, json.dumps(payload, ensure_ascii=False)))
                if len(rows) >= _BATCH:
                    yield packed()
    if rows:
        yield packed()


def tagged_rows(files: DataFrame) -> DataFrame:
    """All entities of all files, each once, in one pass."""
    read = files.select("file_id", "file_name", "campus", "domains", "raw_json")
    return read.mapInArrow(_emit, TAGGED).dropDuplicates(["file_id", "key"])


#: The shape in which the ``domains`` column holds a file.
DOMAINS = "array<struct<name: string, topics: array<struct<name: string, subtopics: array<string>>>>>"
_SHAPED = pa.schema([("file_id", pa.int64()), ("domains", pa.list_(pa.struct([("name", pa.string()), ("topics", pa.list_(pa.struct([("name", pa.string()), ("subtopics", pa.list_(pa.string()))])))])))])


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def _shape(entry: object) -> dict | None:
    """An entry of a JSON file in the column's shape; every entry stays, blank or not."""
    if not isinstance(entry, dict):
        return None
    topics = []
    for t in _list(entry.get("topics")):
        subs = [_text(x.get("name")) if isinstance(x, dict) else _text(x) for x in _list(t.get("subtopics"))] if isinstance(t, dict) else []
        topics.append({"name": _text(t.get("name")), "subtopics": subs} if isinstance(t, dict) else None)
    return {"name": _text(entry.get("name")), "topics": topics}


def _read_raw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # A file at a time: a file may be long.
        for file_id, raw in zip(b.column("file_id"), b.column("raw_json")):
            yield pa.RecordBatch.from_pylist([{"file_id": file_id.as_py(), "domains": [_shape(x) for x in _domains(raw.as_py())]}], schema=_SHAPED)


def held_domains(files: DataFrame) -> DataFrame:
    """(file_id, domains) of every file, whether it is held in ``domains`` or as text; nothing is left out."""
    shape = "transform(domains, d -> if(d IS NULL, NULL, named_struct('name', d.name, 'topics', transform(d.topics, t -> if(t IS NULL, NULL, named_struct('name', t.name, 'subtopics', t.subtopics))))))"
    kept = files.filter("domains IS NOT NULL").select("file_id", F.expr(shape).cast(DOMAINS).alias("domains"))
    raw = files.filter("domains IS NULL AND raw_json IS NOT NULL").select("file_id", "raw_json")
    return kept.unionByName(raw.mapInArrow(_read_raw, f"file_id bigint, domains {DOMAINS}"))


def flattened(files: DataFrame) -> DataFrame:
    """(file_id, domain, topic, subtopic), each once; a topic without subtopics is its own."""
    d = held_domains(files).select("file_id", F.explode("domains").alias("d"))
    t = d.select("file_id", F.col("d.name").alias("domain"), F.explode("d.topics").alias("t")).filter("t.name IS NOT NULL")
    s = t.select("file_id", "domain", F.col("t.name").alias("topic"), F.explode_outer("t.subtopics").alias("subtopic"))
    return s.select("file_id", "domain", "topic", F.coalesce("subtopic", "topic").alias("subtopic")).distinct()


def counted(files: DataFrame) -> DataFrame:
    """One row: the numbers of different names of domains, topics and subtopics."""
    d = held_domains(files).select(F.explode("domains").alias("d"))
    t = d.select(F.col("d.name").alias("domain"), F.explode_outer("d.topics").alias("t"))
    s = t.select("domain", F.col("t.name").alias("topic"), F.explode_outer("t.subtopics").alias("subtopic"))
    return s.agg(*(F.count_distinct(c).alias(f"n_{c}s") for c in ("domain", "topic", "subtopic")))


def write_tables(tagged: DataFrame, path: str) -> None:
    """Write the tagged rows once, a folder for each table."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One of the written tables under its own schema."""
    rows = spark.read.parquet(path).filter(F.col("tag") == tag)
    return flat_table(rows, tag)


def flat_table(tagged: DataFrame, tag: str) -> DataFrame:
    rows = tagged.filter(F.col("tag") == tag).withColumn("p", F.from_json("payload", PAYLOADS[tag]))
    return rows.select("file_id", "key", "parent_key", "domain_no", "topic_no", "subtopic_no", "p.*")


def leaves(tagged: DataFrame) -> DataFrame:
    return tagged.filter("leaf").select("file_id", "domain_no", "topic_no", "subtopic_no")
