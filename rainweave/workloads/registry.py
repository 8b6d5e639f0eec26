"""Query registry and shared table access."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FAMILIES = ("allocation", "comparison", "verification", "series", "spatial", "forecast_windows",
            "intervals", "quality", "text", "ensembles", "rules", "models", "imports", "runs")


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"Query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = ddb(sql)
        return fn
    return register


_READ: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table's plan, with its footer read once per session."""
    key = (spark.sparkContext.applicationId, id(spark), sf, name)
    if key not in _READ:
        _READ[key] = spark.read.parquet(f"{sf}/{name}.parquet")
    return _READ[key]


def spread(df: DataFrame) -> DataFrame:
    """Deal the narrow rows of a scan evenly over the session's shuffle partitions, ahead of heavy per-row text work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spark_view(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """Run input-shaping SQL whose tables are written as {name}."""
    names = set(re.findall(r"\{([a-z]+)\}", text))
    return spark.sql(text, **{n: table(spark, sf, n) for n in names})


def ddb(text: str) -> str:
    return re.sub(r"\{([a-z]+)\}", r"\1", text)


def load_all() -> None:
    for family in FAMILIES:
        try:
            importlib.import_module(f"rainweave.workloads.{family}")
        except ModuleNotFoundError as exc:
            if exc.name != f"rainweave.workloads.{family}":
                raise
