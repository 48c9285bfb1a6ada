"""Registry of runnable queries, each with the SQL that states the same result."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.plans.market import Market
from panelforge.plans.reference_sql import CTES
from panelforge.session import shared_folder


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Market], DataFrame]
    sql: str | None
    digits: dict[str, int]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Market(spark, sf_dir))
        return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in self.digits.items()}) if self.digits else df

    def full_sql(self) -> str | None:
        if self.sql is None:
            return None
        body = with_ctes(self.sql)
        if not self.digits:
            return body
        swaps = ", ".join(f'round("{c}", {n}) + 0.0 AS "{c}"' for c, n in self.digits.items())
        return f"SELECT * REPLACE ({swaps}) FROM ({body}) AS result"


QUERIES: dict[str, Query] = {}


def parse_digits(text: str, default: int = 6) -> dict[str, int]:
    out = {}
    for item in text.split():
        name, _, n = item.partition(":")
        out[name] = int(n) if n else default
    return out


def query(name: str, covers: str, sql: str | None = None, dbl: str = ""):
    """Register a plan; ``dbl`` lists double columns as ``name`` or ``name:digits``."""
    def add(build: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, tuple(covers.split()), build, sql, parse_digits(dbl))
        return build
    return add


def with_ctes(body: str) -> str:
    """Put the shared panels a statement names, and those they name, in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\bx_\w+", text)):
            if name in CTES and name not in needed:
                needed.add(name)
                visit(CTES[name])

    visit(body)
    if not needed:
        return body
    recursive = {n for n in needed if re.search(rf"\b{n}\b", CTES[n])}
    parts = [f"{n} AS {'' if n in recursive else 'MATERIALIZED '}({CTES[n]})" for n in CTES if n in needed]
    body = body.strip()
    if recursive and not body.startswith("WITH RECURSIVE "):
        body = body.replace("WITH ", "WITH RECURSIVE ", 1) if body.startswith("WITH ") else "WITH RECURSIVE x_none AS (SELECT 1)\n" + body
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            return opening + ",\n".join(parts) + ",\n" + body[len(opening):]
    return "WITH " + ",\n".join(parts) + "\n" + body


def scratch(spark: SparkSession) -> str:
    """A new folder for a round trip, below the folder all executors share."""
    return f"{shared_folder(spark)}/panelforge-{uuid.uuid4().hex}"
