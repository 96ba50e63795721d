"""Named queries with their result schema and, where SQL can express them, an independent oracle.

The schema text is the contract of a query: both the Spark result and the oracle are projected onto
it, so names and types agree.  An oracle names the fixture views and helper relations it reads; they
are put in front of it as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinchart.sources import fixtures
from kinchart.sources.fixtures import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    schema: str
    oracle: str | None

    def fields(self) -> list[tuple[str, str]]:
        """Names and types of the result; dates and times are shown as ISO text, which every client
        of both engines reads alike.
        """
        parts = [part.strip().split(" ", 1) for part in self.schema.split(", ")]
        return [(name, "string" if kind in ("date", "timestamp") else kind) for name, kind in parts]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.select(*[F.col(n).cast(t).alias(n) for n, t in self.fields()])

    def oracle_sql(self) -> str | None:
        if self.oracle is None:
            return None
        columns = ", ".join(f'cast("{n}" as {t}) as "{n}"' for n, t in self.fields())
        return with_relations(f"select {columns} from (\n{self.oracle.strip()}\n) q")


QUERIES: dict[str, Query] = {}
# Helper relations of the oracles, in the oracle's dialect.
RELATIONS: dict[str, str] = {}


def query(name: str, schema: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, schema, sql)
        return build

    return register


def relation(name: str, sql: str) -> None:
    RELATIONS[name] = sql


def _text(name: str) -> str:
    if name in RELATIONS:
        return RELATIONS[name].strip()
    text = fixtures.view_text(name, "duckdb")
    return re.sub(r"\{(\w+)\}", r"\1", text)


def with_relations(sql: str) -> str:
    """Put the views and helpers a text reads (directly or not) in front of it."""
    names = set(fixtures.VIEWS) | set(RELATIONS)
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(n for n in names if re.search(rf"\b{n}\b", text)):
            if name not in ordered:
                visit(_text(name))
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    parts = ",\n".join(f"{n} as materialized (\n{_text(n)}\n)" for n in ordered)
    recursive = "recursive " if any("recursive:" in _text(n) for n in ordered) else ""
    return f"with {recursive}{parts}\n{sql}"
