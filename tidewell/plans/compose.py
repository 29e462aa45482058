"""Operators as named relations over named relations.

An operator is a function from a dialect to a SELECT over the relations that it needs. compose() puts what
it needs before it as common table expressions, so that one plan reaches Catalyst from the scan to the
result; apply() puts a caller's DataFrames in place of any of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewell import registry
from tidewell.functions.dialect import Duck, Spark

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPARK, DUCK = Spark(), Duck()


@dataclass
class Relation:
    name: str
    select: Callable[..., str]
    needs: tuple[str, ...]
    covers: str = ""


RELATIONS: dict[str, Relation] = {}


def relation(*needs: str, covers: str = "", oracle: Callable[[], str] | None = None):
    """Register a function(dialect, **parameters) -> SELECT under its own name. covers: operators it provides; it then is a query too.

    oracle: SQL of its own for DuckDB, where the operator's text shouldn't be the one to hold it against.
    """

    def put(f: Callable[..., str]) -> Callable[..., str]:
        if f.__name__ in RELATIONS or f.__name__ in TABLES:
            raise ValueError(f"{f.__name__} is registered twice")
        RELATIONS[f.__name__] = Relation(f.__name__, f, needs, covers)
        if covers:
            registry.query(f.__name__, oracle or (lambda: compose(f.__name__, DUCK)))(lambda spark, sf_dir, name=f.__name__: run(spark, sf_dir, name))
        return f

    return put


def compose(name: str, dialect: Spark, given: dict[str, str] | None = None, **parameters) -> str:
    """The SQL of a relation with all that it needs. given: SELECTs in place of relations or tables."""
    given, order = given or {}, []

    def visit(n: str) -> None:
        if n in order or n in TABLES and n not in given:
            return
        if n not in given:
            for m in RELATIONS[n].needs:
                visit(m)
        order.append(n)

    for n in RELATIONS[name].needs:
        visit(n)
    body = RELATIONS[name].select(dialect, **parameters)
    parts = [f"{n} AS ({given[n] if n in given else RELATIONS[n].select(dialect)})" for n in order]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def source(*names: str) -> str:
    """The start of a hand-written oracle: these relations as common table expressions of DuckDB, after which others may follow."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({compose(n, DUCK)})" for n in names)


def views(spark: SparkSession, sf_dir: str, tables: list[str]) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _tables(name: str) -> set[str]:
    return {name} if name in TABLES else set().union(*map(_tables, RELATIONS[name].needs), set())


def run(spark: SparkSession, sf_dir: str, name: str, **parameters) -> DataFrame:
    """A relation over the tables of sf_dir."""
    views(spark, sf_dir, sorted(_tables(name)))
    return spark.sql(compose(name, SPARK, **parameters))


def apply(spark: SparkSession, name: str, frames: dict[str, DataFrame], **parameters) -> DataFrame:
    """A relation over the caller's DataFrames, by the name of the relation or table that each stands for."""
    given = {}
    for n, df in frames.items():
        view = f"tw_{n}_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(view)
        given[n] = f"SELECT * FROM {view}"
    return spark.sql(compose(name, SPARK, given, **parameters))
