"""Named queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenspark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep

    def add_sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query declared in SQL; tables are written @name. Where the dialects differ, oracle holds the other text."""
        tables = sorted(set(re.findall(r"@(\w+)", text)))

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            plain = re.sub(r"@(\w+)", r"{\1}", text.replace("{", "{{").replace("}", "}}"))
            return spark.sql(plain, **{t: table(spark, sf_dir, t) for t in tables})

        self.add(name, re.sub(r"@(\w+)", r"\1", oracle or text))(run)
